"""Toxicity by class-conditional Kneser-Ney models over bytes (operator 6)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import words_of

DISCOUNT = 0.75
#: The n-grams of a longer text count as much as so many, all together.
WEIGHED = 5000


def grams(text: str | None, order: int) -> np.ndarray:
    """Keys of all byte n-grams of the lower-cased words, joined and enclosed by spaces; none for no word."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    a = np.frombuffer(b"\0" * (order - 2) + b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    n = len(a) - order + 1
    keys = np.zeros(n, np.uint64)
    for i in range(order):
        keys = (keys << np.uint64(8)) | a[i : i + n]
    return keys


def class_probabilities(keys: np.ndarray, counts: np.ndarray, order: int, levels: list) -> np.ndarray:
    """Kneser-Ney probability of each n-gram's last byte in either class (counts: 2 rows).

    Orders above the lowest discount a class's own counts, below the highest those of distinct left
    extensions, and back off to the next; the lowest order's counts are shared by both classes, as is an
    n-gram's backoff where a class never saw its context. levels gets a tuple per order, the lowest first: keys,
    probabilities, contexts and their backoff weights (of the lowest order: no context, and an unseen byte's share).
    """
    if order == 1:
        shared = counts.sum(0) + 0.5
        p = np.vstack([shared / shared.sum()] * 2)
        levels.append((keys, p, None, np.full((2, 1), 0.5 / shared.sum())))
        return p
    low, low_at = np.unique(keys & np.uint64((1 << 8 * (order - 1)) - 1), return_inverse=True)
    below = class_probabilities(low, np.vstack([np.bincount(low_at, c > 0, len(low)) for c in counts]), order - 1, levels)[:, low_at]
    contexts, at = np.unique(keys >> np.uint64(8), return_inverse=True)
    out, weights = [], []
    for c, back in zip(counts, below, strict=True):
        total, taken = np.bincount(at, c, len(contexts)), np.bincount(at, np.minimum(c, DISCOUNT), len(contexts))
        rest = np.where(total > 0, taken / np.where(total > 0, total, 1), 1.0)
        out.append(np.maximum(c - DISCOUNT, 0) / np.where(total > 0, total, 1)[at] + rest[at] * back)
        weights.append(rest)
    levels.append((keys, np.vstack(out), contexts, np.vstack(weights)))
    return np.vstack(out)


def backed_off(g: np.ndarray, levels: list) -> np.ndarray:
    """Probability of any n-gram's last byte in either class: that of its longest known suffix, times the backoff
    weights of the contexts above it (1 for a context that no class has seen)."""
    keys, p, contexts, rest = levels[-1]
    at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
    known = keys[at] == g
    out = p[:, at]
    if known.all():
        return out
    unseen = g[~known]
    if contexts is None:
        out[:, ~known] = rest
        return out
    h = unseen >> np.uint64(8)
    c = np.minimum(np.searchsorted(contexts, h), len(contexts) - 1)
    weight = np.where(contexts[c] == h, rest[:, c], 1.0)
    out[:, ~known] = weight * backed_off(unseen & np.uint64((1 << 8 * (len(levels) - 1)) - 1), levels[:-1])
    return out


def ratios(ordinary: Sequence[str], toxic: Sequence[str], order: int) -> tuple[np.ndarray, np.ndarray, list]:
    """(n-gram keys, log-likelihood ratio toxic to ordinary of the last byte, levels for others), sorted by key.

    All texts of either class count whole; in those of more than WEIGHED n-grams each counts in proportion less, so
    that a long text, most of which is of neither kind, is no more than a long text of that size. The counts of the class with more n-grams are scaled down to
    1.5 times the other's sum before they are discounted (a count under the discount goes to the backoff as a
    whole), so that neither class is smoothed much more than the other.
    """
    found = []
    for texts in (ordinary, toxic):
        each = [g for g in (grams(x, order) for x in texts) if len(g)]
        known, at = np.unique(np.concatenate(each or [np.zeros(0, np.uint64)]), return_inverse=True)
        weight = np.repeat([min(1.0, WEIGHED / len(g)) for g in each], [len(g) for g in each])
        found.append((known, np.bincount(at, weight, len(known))))
    keys = np.union1d(found[0][0], found[1][0])
    counts = np.zeros((2, len(keys)))
    for row, (k, n) in zip(counts, found, strict=True):
        row[np.searchsorted(keys, k)] = n
    counts *= np.minimum(1.0, 1.5 * counts.sum(1).min() / counts.sum(1, keepdims=True))
    levels: list = []
    p = class_probabilities(keys, counts, order, levels)
    return keys, np.log(p[1] / p[0]).astype(np.float32), levels


def features(text: str | None, model: tuple[np.ndarray, np.ndarray, list], order: int, spans: Sequence[int]) -> list[float]:
    """Log-likelihood ratio per byte of the whole text, and of its most toxic span of each length."""
    g, (keys, ratio, levels) = grams(text, order), model
    if not len(g):
        return [0.0] * (1 + len(spans))
    at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
    each, new = ratio[at], keys[at] != g
    if new.any():
        p = backed_off(g[new], levels)
        each[new] = np.log(p[1] / p[0])
    upto = np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
    out = [upto[-1] / len(g)]
    for n in spans:
        n = min(n, len(g))
        out.append((upto[n:] - upto[:-n]).max() / n)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights (intercept first) by Newton steps with a ridge penalty."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 4, spans: Sequence[int] = (10, 16), docs_per_class: int = 1500) -> DataFrame:
    """One row per input row: id, score (0 to 1), predicted (1 if score >= 0.5), llr, span_llr.

    labels (id, toxic 0/1) are the rows to learn from. The models are fitted on a bounded sample of them: for
    each class the first docs_per_class ids in the order of a hash, their texts whole. Every document is then scored by its whole text: log-likelihoods under
    the toxic and the ordinary model, per byte, over the text and over its most toxic spans, turned into a
    probability by a logistic curve that was fitted on five folds of the sample, each under models of the other four, and set to the rate of
    toxic labels. Only the text enters a score.

    Null or empty texts score as a text without evidence. Null labels are ignored, repeated labels of an id
    count as their maximum, repeated rows each get a row. Without a labelled text of both classes every score
    is the rate of toxic labels (0 without labels). An empty table gives no rows.
    """
    marks = labels.where("toxic is not null").groupBy(F.col(id_col).alias("id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    rate = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts: list[list[str]] = [[], []]
    for kind in (0, 1):
        ids = marks.where(F.col("toxic") == kind).orderBy(F.xxhash64("id"), "id").limit(docs_per_class).select("id")
        found = rows.join(F.broadcast(ids), "id").select(F.xxhash64("id").alias("h"), "id", "text")
        texts[kind] = [r[2] for r in sorted(found.collect(), key=lambda r: (r[0], r[1], r[2] or ""))[:docs_per_class]]
    base = rate.get(1, 0) / max(1, sum(rate.values()))
    model = weights = None
    if all(sum(1 for x in t if words_of(x)) >= 2 for t in texts):
        x, y = [], []
        folds = min(5, *map(len, texts))
        for fold in range(folds):
            rest = ratios(*([t for i, t in enumerate(texts[kind]) if i % folds != fold] for kind in (0, 1)), order)
            for kind in (0, 1):
                held = texts[kind][fold::folds]
                x += [features(t, rest, order, spans) for t in held]
                y += [kind] * len(held)
        weights = logistic(np.array(x), np.array(y))
        weights[0] += math.log(rate[1] / rate[0]) - math.log(sum(y) / (len(y) - sum(y)))
        model = ratios(texts[0], texts[1], order)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                f = np.zeros((len(part), 1 + len(spans)))
                p = np.full(len(part), base)
                if model:
                    f = np.array([features(t, model, order, spans) for t in part["text"].to_pylist()])
                    p = 1 / (1 + np.exp(-np.clip(weights[0] + f @ weights[1:], -30, 30)))
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(f[:, 0]), pa.array(f[:, 1])], names=["id", "score", "predicted", "llr", "span_llr"])

    return rows.mapInArrow(score, f"id {dict(rows.dtypes)['id']}, score double, predicted int, llr double, span_llr double").withColumnRenamed("id", id_col)
