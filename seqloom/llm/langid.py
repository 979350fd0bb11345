"""Language ID by a bidirectional gated recurrent network over bytes (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import LOWER_TABLE

#: A letter: a character of category L, for what is learned and what is read alike.
LETTER = r"\p{L}"
#: Symbols are the 256 bytes and the padding after a text's end, whose input is 0, so that the state stays 0.
PAD = 256


class ByteNetwork:
    """Two gated recurrent layers, one per direction, whose states together label every position.

    Parameters: x (2, 257, 3h) input of each symbol to update gate, reset gate and candidate, u (2, h, 3h)
    from the last state, out (2h, classes) and bias. Gates are 0.5 + 0.5 tanh(a / 2).
    """

    def __init__(self, hidden: int, classes: int, seed: int):
        r = np.random.default_rng(seed)
        self.h = hidden
        self.p = {
            "x": r.normal(0, 0.3, (2, 257, 3 * hidden)).astype(np.float32), "u": r.normal(0, hidden**-0.5, (2, hidden, 3 * hidden)).astype(np.float32),
            "out": r.normal(0, 0.3, (2 * hidden, classes)).astype(np.float32), "bias": np.zeros(classes, np.float32),
        }
        self.p["x"][:, PAD] = 0

    def states(self, text: np.ndarray, keep: bool = False):
        """States (time, 2, rows, h) for symbols (rows, time); the second direction's in reading order."""
        h, (rows, time) = self.h, text.shape
        half = self.p["u"].copy()
        x = self.p["x"].copy()
        half[..., : 2 * h] *= 0.5
        x[..., : 2 * h] *= 0.5
        x = x.reshape(2 * 257, 3 * h)
        both = np.stack([text.T, text.T[::-1] + 257], 1)  # time, direction, rows
        state, all_states, kept = np.zeros((2, rows, h), np.float32), np.empty((time, 2, rows, h), np.float32), []
        for t in range(time):
            a, b = x[both[t]], state @ half
            gates = np.tanh(a[..., : 2 * h] + b[..., : 2 * h])
            gates *= 0.5
            gates += 0.5
            z, r = gates[..., :h], gates[..., h:]
            new = np.tanh(a[..., 2 * h :] + r * b[..., 2 * h :])
            if keep:
                kept.append((state, z, r, b[..., 2 * h :], new))
            state = new + z * (state - new)
            all_states[t, 0], all_states[time - 1 - t, 1] = state[0], state[1]
        return all_states, both, kept

    def log_scores(self, states: np.ndarray) -> np.ndarray:
        """(time, rows, classes) log-probabilities of every position."""
        a = states[:, 0] @ self.p["out"][: self.h] + states[:, 1] @ self.p["out"][self.h :] + self.p["bias"]
        a -= a.max(-1, keepdims=True)
        return a - np.log(np.exp(a).sum(-1, keepdims=True))

    def gradients(self, text: np.ndarray, label: np.ndarray) -> tuple[dict, float]:
        """Backpropagation through time of the mean cross-entropy over all positions."""
        h = self.h
        states, both, kept = self.states(text, keep=True)
        real = (text.T != PAD)[..., None]
        logs = self.log_scores(states)
        d = np.exp(logs)
        d[:, np.arange(len(label)), label] -= 1
        d = d * real / real.sum()
        loss = -float((logs[:, np.arange(len(label)), label] * real[..., 0]).sum() / real.sum())
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["bias"] = d.sum((0, 1))
        flat = d.reshape(-1, d.shape[-1])
        g["out"] = np.concatenate([states[:, i].reshape(-1, h).T @ flat for i in (0, 1)])
        up = np.stack([d @ self.p["out"][:h].T, (d @ self.p["out"][h:].T)[::-1]], 1)  # in each direction's own order
        carry, u_t = np.zeros((2, len(label), h), np.float32), self.p["u"].transpose(0, 2, 1)
        gx = g["x"].reshape(2 * 257, 3 * h)
        for t in range(len(kept) - 1, -1, -1):
            state, z, r, b_new, new = kept[t]
            ds = carry + up[t]
            dn = ds * (1 - z) * (1 - new * new)
            dz = ds * (state - new) * z * (1 - z)
            dr = dn * b_new * r * (1 - r)
            inner = np.concatenate([dz, dr, dn * r], -1)
            g["u"] += state.transpose(0, 2, 1) @ inner
            np.add.at(gx, both[t], np.concatenate([dz, dr, dn], -1))
            carry = ds * z + inner @ u_t
        g["x"][:, PAD] = 0
        return g, loss

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int, rows: int, time: int, rate: float, seed: int) -> None:
        """Adam over windows drawn at random places of the texts, classes in equal parts."""
        r = np.random.default_rng(seed)
        of = [np.flatnonzero(labels == c) for c in range(labels.max() + 1)]
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            label = r.integers(0, len(of), rows)
            picked = [texts[r.choice(of[c])] for c in label]
            text = np.full((rows, time), PAD, np.int64)
            for row, x in zip(text, picked, strict=True):
                at = int(r.integers(0, max(1, len(x) - time + 1)))
                part = np.frombuffer(x[at : at + time], np.uint8)
                row[: len(part)] = part
            g, _ = self.gradients(text, label)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            now = rate * min(1.0, 3 * (1 - step / (steps + 1)))
            for k, v in g.items():
                v = v * min(1.0, 1.0 / max(norm, 1e-12))
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                self.p[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)

    def position_sums(self, text: np.ndarray, margin: int = 0) -> np.ndarray:
        """(rows, classes) sums of the probabilities of all real positions but `margin` at either end: states() and
        log_scores() for reading, with rows as the last axis and buffers that are used again."""
        h, (rows, time) = self.h, text.shape
        scale = np.repeat(np.float32([0.5, 0.5, 1]), h)[:, None]
        x, u = self.p["x"].transpose(0, 2, 1) * scale, self.p["u"].transpose(0, 2, 1) * scale
        x, u = np.ascontiguousarray(x), np.ascontiguousarray(u)
        out = [np.ascontiguousarray(self.p["out"][i * h : (i + 1) * h].T) for i in (0, 1)]
        cols = np.ascontiguousarray(text.T)
        states = np.zeros((2, time + 1, h, rows), np.float32)
        a, b, gates, new = (np.empty((n, rows), np.float32) for n in (3 * h, 3 * h, 2 * h, h))
        for i in (0, 1):
            for t in range(time):
                symbols = cols[t if i == 0 else time - 1 - t]
                np.take(x[i], symbols, axis=1, out=a, mode="clip")
                np.matmul(u[i], states[i, t], out=b)
                np.add(a[: 2 * h], b[: 2 * h], out=gates)
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                np.multiply(gates[h:], b[2 * h :], out=new)
                new += a[2 * h :]
                np.tanh(new, out=new)
                now = states[i, t + 1]
                np.subtract(states[i, t], new, out=now)
                now *= gates[:h]
                now += new
        total = np.zeros((len(self.p["bias"]), rows), np.float32)
        for t in range(margin, time - margin):
            score = out[0] @ states[0, t + 1]
            score += out[1] @ states[1, time - t]
            score += self.p["bias"][:, None]
            score -= score.max(0)
            np.exp(score, out=score)
            score *= (cols[t] != PAD) / score.sum(0)
            total += score
        return total.T

    def pooled(self, texts: list[bytes], time: int, rows: int, margin: int) -> np.ndarray:
        """Mean probabilities (texts, classes) over all positions of whole texts.

        A text is read in windows of `time` bytes; each overlaps its neighbours by `margin` bytes on either side,
        which only bring the states of both directions up to date and are not counted, so that no counted
        position but those next to the text's ends starts from an empty state.
        """
        step = time - 2 * margin
        counts = [max(0, -(-len(x) // step)) for x in texts]
        total = np.zeros((len(texts), len(self.p["bias"])))
        of = np.repeat(np.arange(len(texts)), counts)
        at = np.concatenate([[0], np.cumsum([n * step + 2 * margin for n in counts])]).astype(np.int64)
        flat = np.full(at[-1], PAD, np.int64)
        for x, start in zip(texts, at, strict=False):
            flat[start + margin : start + margin + len(x)] = np.frombuffer(x, np.uint8)
        first = np.concatenate([s + step * np.arange(n) for s, n in zip(at, counts, strict=False)]) if len(of) else np.zeros(0, np.int64)
        for i in range(0, len(first), rows):
            windows = flat[first[i : i + rows, None] + np.arange(time)]
            np.add.at(total, of[i : i + rows], self.position_sums(windows, margin))
        return total / np.maximum(1, [[len(x)] for x in texts])


def identify(docs: DataFrame, learn: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", hidden: int = 8, sample: int = 3000, sample_chars: int = 400, steps: int = 200, train_rows: int = 128, window: int = 48, read_window: int = 256, read_margin: int = 24, read_rows: int = 1024, seed: int = 7) -> DataFrame:
    """One row per input row: id, lang_pred, score.

    learn holds the rows to learn from; rows with null language or without a letter aside, about `sample` of them
    are taken by a hash of the id, as many of each language as there are, and of each one stretch of sample_chars
    characters at a hashed place (the bound of what reaches the driver). There a bidirectional gated
    recurrent network over lower-cased bytes is fitted by backpropagation through time on windows. It then
    labels every byte of every whole text, read in overlapping windows of read_window bytes; the document's
    probabilities are the mean over its bytes, lang_pred the largest (ties: the first by code point), score
    its probability.

    lang_pred is und, with score 0, for null texts and texts without a letter (category L), and for all where there
    is nothing to learn from. Repeated rows each get a row; an empty table gives none.
    """
    rows = learn.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(LETTER)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs, data, labels = sorted(counts), [], []
    if langs:
        most = max(1, sample // len(langs))
        h = F.xxhash64(F.lit(seed), "id")
        share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, int(1e6 * min(1.0, 1.5 * most / counts[lang] + 20 / counts[lang])))])
        near = rows.where(F.pmod(h, F.lit(1_000_000)) < share[F.col("lang")])
        start = F.pmod(F.xxhash64(h), F.greatest(F.lit(1), F.length("text") - sample_chars + 1)) + 1
        near = near.select("lang", h.alias("h"), F.substring("text", start.cast("int"), F.lit(sample_chars)).alias("t"))
        got = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))).where(F.col("k") <= most)
        for r in sorted(got.collect(), key=lambda r: (r.lang, r.h, r.t)):
            data.append(prepared(r.t))
            labels.append(langs.index(r.lang))
    network = ByteNetwork(hidden, max(1, len(langs)), seed)
    if len(langs) > 1:
        network.fit(data, np.array(labels), steps, train_rows, window, 0.02, seed)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                texts = part["text"].to_pylist()
                said = [bool(langs) and x is not None for x in texts]
                p = network.pooled([prepared(x) if ok else b"" for x, ok in zip(texts, said, strict=True)], read_window, read_rows, read_margin)
                best = p.argmax(1)
                yield pa.RecordBatch.from_arrays([
                    part["id"], pa.array([langs[k] if ok else "und" for k, ok in zip(best, said, strict=True)], pa.string()),
                    pa.array([float(min(1.0, q[k])) if ok else 0.0 for q, k, ok in zip(p, best, said, strict=True)], pa.float64()),
                ], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.when(F.col(text_col).rlike(LETTER), F.col(text_col)).alias("text"))
    return rows.mapInArrow(label, f"id {dict(rows.dtypes)['id']}, lang_pred string, score double").withColumnRenamed("id", id_col)


def prepared(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(LOWER_TABLE)
