"""Outliers by isolation forests, and the rank test of two halves of a quality string."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def mean_depth(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def drawn(*of: object) -> float:
    """A number from 0 to 1 (not reached), drawn by the MD5 of what it is for: 52 bits, which SQL can draw as well."""
    return int(hashlib.md5(":".join(map(str, of)).encode()).hexdigest()[:13], 16) / 16**13


def grown(x: np.ndarray, seed: int, number: int) -> np.ndarray:
    """The isolation tree of that number as rows (feature or -1, cut, left, right, path length at a leaf).

    Places are numbered as in a heap (1 above 2 and 3); a place's feature, among those that differ in its rows, and its
    cut between their least and greatest value are drawn for the seed, the tree and the place.
    """
    most, nodes, todo = math.ceil(math.log2(max(2, len(x)))), [[-1.0, 0.0, 0.0, 0.0, 0.0]], [(0, x, 0, 1)]
    while todo:
        at, rows, depth, place = todo.pop()
        wide = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
        if depth >= most or not len(wide):
            nodes[at][4] = depth + mean_depth(len(rows))
            continue
        f = int(wide[int(drawn(seed, number, place, 0) * len(wide))])
        low, high = rows[:, f].min(), rows[:, f].max()
        cut = low + drawn(seed, number, place, 1) * (high - low)
        below = rows[:, f] <= cut
        nodes[at][:4] = [f, cut, len(nodes), len(nodes) + 1]
        todo += [(len(nodes), rows[below], depth + 1, 2 * place), (len(nodes) + 1, rows[~below], depth + 1, 2 * place + 1)]
        nodes += [[-1.0, 0.0, 0.0, 0.0, 0.0] for _ in range(2)]
    return np.array(nodes)


def picked(hashes: list[int], x: np.ndarray, n: int, number: int) -> np.ndarray:
    """The n rows of a tree: the first by the MD5 of the tree's number and the row's hash (ties by value)."""
    names = [hashlib.md5(f"{number}:{h}".encode()).hexdigest()[:15] for h in hashes]
    return x[np.lexsort([*x.T[::-1], names])[:n]]


def path_length(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while (inner := tree[at, 0] >= 0).any():
        below = x[rows, np.maximum(tree[at, 0], 0).astype(np.int64)] <= tree[at, 1]
        at = np.where(inner, np.where(below, tree[at, 2], tree[at, 3]), at).astype(np.int64)
    return tree[at, 4]


class Forest:
    """Trees as heaps of one depth, whose cuts are numbered by feature: a row's values become numbers once, and all trees
    compare those. A leaf above the last level stands in all places below it."""

    def __init__(self, trees: list[np.ndarray], features: int):
        self.trees, inner = [], np.concatenate([t[t[:, 0] >= 0] for t in trees])
        self.cuts = [np.unique(inner[inner[:, 0] == f, 1]) for f in range(features)]
        for tree in trees:
            at, feature, cut = np.zeros(1, np.int64), [], []
            while (tree[at, 0] >= 0).any():
                f = np.maximum(tree[at, 0], 0).astype(np.intp)
                feature.append(f)
                cut.append(np.zeros(len(f), np.int32))
                for k in np.unique(f):
                    cut[-1][f == k] = np.searchsorted(self.cuts[k], tree[at[f == k], 1])
                at = np.where(tree[at, 0][:, None] >= 0, tree[at, 2:4], at[:, None]).astype(np.int64).ravel()
            self.trees.append((len(feature), np.concatenate([*feature, [0]]).astype(np.intp), np.concatenate([*cut, [0]]).astype(np.int32), tree[at, 4]))

    def mean_path(self, x: np.ndarray, rows: int = 8192) -> np.ndarray:
        """Mean path length of rows over the trees, some rows at a time, so that what the levels touch stays near."""
        out = np.empty(len(x))
        for start in range(0, len(x), rows):
            part = x[start : start + rows]
            numbers = np.stack([np.searchsorted(c, part[:, f]) for f, c in enumerate(self.cuts)], axis=1).astype(np.int32).ravel()
            base, total = np.arange(len(part), dtype=np.intp) * len(self.cuts), np.zeros(len(part))
            for depth, feature, cut, paths in self.trees:
                at = np.zeros(len(part), np.intp)
                for _ in range(depth):
                    above = numbers.take(feature.take(at) + base) > cut.take(at)
                    at *= 2
                    at += 1
                    at += above
                total += paths.take(at - (len(paths) - 1))
            out[start : start + rows] = total / len(self.trees)
        return out


def isolation_scores(df: DataFrame, group: str, features: Sequence[str], key: Sequence[str], train: Column, known: Column, trees: int = 100, rows_per_tree: int = 256, sample: int = 8192, most_groups: int = 64, slot: int = 50_000, seed: int = 42) -> DataFrame:
    """group, key columns, score (0 to 1, outliers high), pred (-1 for scores over 0.5, else 1; known rows always 1).

    One forest a group, fitted on a sample of about `sample` of its training rows, drawn by a hash of the key;
    so a group of any size fits into a task. All draws are MD5's of what they are for, so runs agree whatever the
    partitions, and SQL can grow the same trees. Forests are of fixed size: up to most_groups of them go to all tasks, where
    every row is scored; more stay a table that rows meet by group, in slots of about `slot` rows, so that a large group is
    spread. Null features count as 0; null is a group of its own; a group without training rows has score 0.5. An empty
    table gives no rows.
    """
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(features)]
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *key)), 1, 15), 16, 10).cast("long")
    rows = df.select(F.col(group).alias("g"), *key, F.coalesce(known, F.lit(False)).alias("known"), F.coalesce(train, F.lit(False)).alias("train"), h.alias("h"), *cols)
    sizes = rows.groupBy("g").agg(F.count_if("train").alias("n"), F.count(F.lit(1)).alias("m"))
    names = [f"f{i}" for i in range(len(features))]

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        x, hashes = frame[names].to_numpy(float), frame["h"].tolist()
        forest = [grown(picked(hashes, x, rows_per_tree, t), seed, t) for t in range(trees)]
        return pd.DataFrame({"g": frame["g"].iloc[:1].astype(object), "size": [min(rows_per_tree, len(x))], "ends": [np.cumsum([len(t) for t in forest]).tolist()], "nodes": [np.concatenate(forest).tobytes()]})

    kind = dict(rows.dtypes)["g"]
    share = F.coalesce(F.least(F.lit(1_000_000), F.floor(F.try_divide(F.lit(1e6 * sample), F.col("n"))) + 1), F.lit(0))
    of_group = sizes.select(F.col("g").alias("_g"), share.alias("share"), F.ceil(F.col("m") / slot).cast("int").alias("slots"))
    many = sizes.limit(most_groups + 1).count() > most_groups
    placed = rows.join(of_group if many else F.broadcast(of_group), rows["g"].eqNullSafe(of_group["_g"]))
    chosen = placed.where(F.col("train") & (F.pmod("h", F.lit(1_000_000)) < F.col("share"))).select(*rows.columns)
    forests = chosen.groupBy("g").applyInPandas(fit, f"g {kind}, size int, ends array<int>, nodes binary")

    def scores(frame: pd.DataFrame, size: int, forest: Forest) -> np.ndarray:
        x = frame[names].to_numpy(float)
        if size < 2 or not len(x):
            return np.full(len(x), 0.5)
        return 2.0 ** (-forest.mean_path(x) / max(mean_depth(size), 1e-9))

    def told(frame: pd.DataFrame, out: np.ndarray) -> pd.DataFrame:
        pred = np.where((out > 0.5) & ~frame["known"].to_numpy(bool), -1, 1)
        return frame[["g", *key]].assign(score=out, pred=pred.astype(np.int32))

    trees_of = lambda r: Forest(np.split(np.frombuffer(r.nodes).reshape(-1, 5), list(r.ends)[:-1]), len(names))
    known_forests = {} if many else {r.g: (r["size"], trees_of(r)) for r in forests.collect()}

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = np.full(len(frame), 0.5)
            groups = frame["g"].astype(object).where(frame["g"].notna(), None)
            for g, (size, forest) in known_forests.items():
                at = np.flatnonzero(groups.isna() if g is None else groups == g)
                out[at] = scores(frame.iloc[at], size, forest)
            yield told(frame, out)

    def score_group(frame: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        out = np.full(len(frame), 0.5)
        if len(forest):
            r = next(forest.itertuples(index=False))
            out = scores(frame, int(r.size), trees_of(r))
        return told(frame, out)

    of = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes if c in ("g", *key))
    schema = f"{of}, score double, pred int"
    if not many:
        return rows.drop("train", "h").mapInPandas(score, schema).withColumnRenamed("g", group)
    dealt = placed.withColumn("slot", F.pmod("h", F.col("slots")).cast("int")).select("slot", *rows.columns).drop("train", "h")
    copies = forests.join(of_group, forests["g"].eqNullSafe(of_group["_g"])).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).select("slot", *forests.columns)
    return dealt.groupBy("g", "slot").cogroup(copies.groupBy("g", "slot")).applyInPandas(score_group, schema).withColumnRenamed("g", group)


def mann_whitney(a: np.ndarray, b: np.ndarray) -> float:
    """Two-sided p of the rank-sum test: mid-ranks, tie correction, continuity correction, normal approximation.
    1 where a side is empty or all values are equal."""
    n, m = len(a), len(b)
    if not n or not m:
        return 1.0
    _, at, ties = np.unique(np.concatenate([a, b]), return_inverse=True, return_counts=True)
    ranks = np.cumsum(ties) - (ties - 1) / 2
    u = ranks[at[:n]].sum() - n * (n + 1) / 2
    t = ties.astype(float)
    spread = n * m / 12 * (n + m + 1 - (t**3 - t).sum() / ((n + m) * (n + m - 1)))
    if spread <= 0:
        return 1.0
    return math.erfc(max(0.0, abs(u - n * m / 2) - 0.5) / math.sqrt(2 * spread))


@F.pandas_udf(DoubleType())
def quality_shift(quality: pd.Series, at: pd.Series) -> pd.Series:
    """p that a quality string's values before and from a place (0-based) are of one distribution; null is 1."""
    values = [np.frombuffer((q or "").encode("utf-32-le", "surrogatepass"), np.uint32) for q in quality]
    return pd.Series([mann_whitney(v[:k], v[k:]) for v, k in zip(values, at.fillna(0).astype(int), strict=True)], dtype=float)
