"""Near-dedup by b-bit MinHash with links confirmed on full shingle sets (operator 3)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import saved, shared_folder, words_of
from seqloom.llm.components import connected

#: Low bits that a signature retains of each minimum; two minima to a byte.
BITS = 4
#: Rows of a bucket that are compared as one block.
BLOCK = 1000
ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of `size` words; fewer words are one shingle."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    acc = np.full(n, size, np.uint64)
    for i in range(size):
        acc = (acc ^ (acc >> np.uint64(29))) * ODD + h[i : i + n]
    return np.unique(acc)


class MinHash:
    """bands * rows multiply-shift hash functions."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        r = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = r.integers(0, 2**63, bands * rows, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 2**63, bands * rows, dtype=np.uint64)[:, None]

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        low = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint64)
        for i in range(0, len(hashes), 2048):
            low = np.minimum(low, ((hashes[None, i : i + 2048] * self.a + self.b) >> np.uint64(32)).min(1))
        return low.astype(np.uint32)

    def band_keys(self, low: np.ndarray) -> list[int]:
        return [xxhash.xxh64_intdigest(x.tobytes(), seed=i) - 2**63 for i, x in enumerate(low.reshape(self.bands, self.rows))]

    @staticmethod
    def packed(low: np.ndarray) -> bytes:
        bits = (low & (2**BITS - 1)).astype(np.uint8)
        return (bits[0::2] | bits[1::2] << 4).tobytes()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (last axis: bytes): minima that agree by bit counts, less the share
    2**-BITS in which different minima agree by chance."""
    x = a ^ b
    x = x | x >> 1
    x = (x | x >> 2) & 0x11
    same = 1 - np.bitwise_count(x).sum(-1, dtype=np.int64) / (2 * a.shape[-1])
    chance = 2.0**-BITS
    return (same - chance) / (1 - chance)


def least_estimate(threshold: float, hashes: int) -> float:
    """Six standard deviations below the threshold: the estimate of a pair at the threshold is under it once in 1e9."""
    p = threshold + (1 - threshold) * 2.0**-BITS
    return threshold - 6 * (p * (1 - p) / hashes) ** 0.5 / (1 - 2.0**-BITS)


def full_sets(need: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int, folder: str, name: str) -> DataFrame:
    """node, hashes of the needed classes; only texts that stand for one of them are read again."""
    ids = saved(classes.join(need, "node").select("id").distinct(), folder, f"{name}-ids")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 200):
                hashes = [shingle_set(x, shingle).tobytes() for x in batch.slice(i, 200)["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in hashes], pa.binary()), pa.array(hashes, pa.binary())], names=["node", "hashes"])

    # equal ids may stand for several texts: sets go by their digest, one row each
    full = docs.join(ids, docs["id"].eqNullSafe(ids["id"]), "left_semi").select("text").mapInArrow(sets, "node binary, hashes binary")
    return saved(full.join(need, "node", "left_semi").dropDuplicates(["node"]), folder, f"{name}-sets")


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int, percent: int, folder: str, name: str) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets reach the threshold; one side's set travels with each."""
    pairs = saved(pairs, folder, f"{name}-pairs")
    need = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    full = full_sets(need, docs, classes, shingle, folder, name)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x, np.uint64) for x in batch[c].to_pylist()] for c in ("x", "y"))
            good = [reaches(x, y, percent) for x, y in zip(a, b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    with_b = pairs.join(full.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    with_both = with_b.join(full.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    return saved(with_both.select("a", "b", "x", "y").mapInArrow(linked, "a binary, b binary"), folder, f"{name}-links")


def likely(pairs: DataFrame, classes: DataFrame, least: float, percent: int) -> DataFrame:
    """The pairs whose sizes and packed signatures allow the threshold."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(len(batch), -1) for c in ("s_a", "s_b"))
            yield batch.select(["a", "b"]).filter(pa.array(estimate(a, b) >= least) if len(batch) else pa.array([], pa.bool_()))

    return met.select("a", "b", "s_a", "s_b").mapInArrow(close, "a binary, b binary")


def rest_links(buckets: DataFrame, least: float, percent: int) -> DataFrame:
    """Links (a, b) within buckets between classes that were in different components, as many as join them.

    buckets: key, node, component, n, signature, hashes. A bucket of m rows is dealt to ceil(m / BLOCK) slots,
    and every two slots meet in a group of their own, so that no group holds more than about 2 * BLOCK rows.
    There pairs of different components that sizes and signatures allow are confirmed on full sets, the
    likeliest first; a confirmed link joins two components, whose other pairs need no look, so that a group
    emits fewer links than it has rows, and none that matters is lost.
    """
    sizes = buckets.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("slots"))
    rows = buckets.join(sizes, "key").withColumn("slot", F.pmod(F.xxhash64("node"), F.col("slots")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    rows = rows.withColumns({"low": F.least("slot", "other"), "high": F.greatest("slot", "other")})

    def meet(frame):
        import pandas as pd

        frame = frame.sort_values("node", ignore_index=True)
        node, n = frame["node"].to_numpy(), frame["n"].to_numpy()
        _, comp = np.unique(frame["component"].to_numpy(), return_inverse=True)
        root = list(range(comp.max() + 1))
        low, high, slot = frame["low"].iloc[0], frame["high"].iloc[0], frame["slot"].to_numpy()
        s = np.frombuffer(b"".join(frame["signature"]), np.uint8).reshape(len(frame), -1)
        found = []
        for i in range(len(frame)):
            js = np.arange(i + 1, len(frame))
            js = js[(comp[js] != comp[i]) & ((low == high) | (slot[js] != slot[i])) & (100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i]))]
            like = estimate(s[js], s[i])
            js, like = js[like >= least], like[like >= least]
            found.append(np.column_stack([-like, np.full(len(js), i), js]))

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        found = np.concatenate(found)
        out, sets = [], {}
        for _, i, j in found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]:
            i, j = int(i), int(j)
            if (x := top(comp[i])) == (y := top(comp[j])):
                continue
            for k in (i, j):
                if k not in sets:
                    sets[k] = np.frombuffer(frame["hashes"].iloc[k], np.uint64)
            if reaches(sets[i], sets[j], percent):
                root[max(x, y)] = min(x, y)
                out.append((node[i], node[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    cols = rows.select("key", "low", "high", "slot", "node", "component", "n", "signature", "hashes")
    # dealt anew, or the join's partitions by key would keep all slots of a bucket in one task
    return cols.repartition("key", "low", "high").groupBy("key", "low", "high").applyInPandas(meet, "a binary, b binary").distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = 36, rows: int = 5) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Documents are linked when 100 * shared >= percent * united of their sets of `shingle`-word shingles
    (lower-cased A-Z); component_id is the smallest id that links reach, kept says that it is the row's own.

    Rows with equal sets are one class first, so that copies are never paired. Classes that share a band of
    minima are candidates (36 bands of 5: a pair at 0.8 is missed once in a million). A bucket's leader and size come
    from an aggregation and a join, so no task holds a bucket. In a bucket each class is compared with the leader, confirmed on full sets; four different orders choose leaders. Where
    a bucket still spans several components, all its pairs between different ones follow, the likeliest first:
    their b-bit signatures give the collision-corrected similarity by bit counts, and those not six deviations
    under the threshold are confirmed on full sets. Pairs inside a component can't change it: no look at them.

    Null and empty texts, and those without a word, have an empty set and are linked with nothing; a text of
    fewer than `shingle` words has one shingle. Rows with one id are linked like others; null ids count in no
    minimum (a component of null ids has a null component_id and is kept). An empty table gives no rows; other
    columns are ignored.
    """
    folder = shared_folder(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    least = least_estimate(percent / 100, bands * rows)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = MinHash(bands, rows)
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                sets = [shingle_set(x, shingle) for x in part["text"].to_pylist()]
                low = [family.minima(x) if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays([
                    part["id"], pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets], pa.binary()),
                    pa.array([None if x is None else family.band_keys(x) for x in low], pa.list_(pa.int64())),
                    pa.array([None if x is None else family.packed(x) for x in low], pa.binary()),
                ], names=["id", "n", "node", "keys", "signature"])

    sets = saved(docs.mapInArrow(sketch, "id long, n long, node binary, keys array<long>, signature binary"), folder, "sketches")
    filled = sets.where("node is not null")
    classes = filled.groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("keys").alias("keys"))
    classes = saved(classes, folder, "classes")

    each = classes.select("node", F.posexplode("keys").alias("band", "key"))
    order = F.struct(F.xxhash64(F.col("band") % 4, "node").alias("h"), "node")
    leaders = each.groupBy("key").agg(F.min(order)["node"].alias("leader"), F.count(F.lit(1)).alias("m")).where("m > 1")
    buckets = saved(each.select("key", "node").join(leaders.select("key", "leader"), "key"), folder, "buckets")
    stars = buckets.where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    classes = classes.drop("keys")
    links = confirmed(likely(stars, classes, least, percent), docs, classes, shingle, percent, folder, "star")
    found = connected(links, folder, "star")

    placed = buckets.select("key", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # buckets with the same members (by count, ends and two checksums) ask the same: one of them is enough
    members = [F.min("node"), F.max("node"), F.count(F.lit(1)), F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64(F.lit(1), "node"))]
    open_keys = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.struct(*members).alias("members")).where("x <> y")
    open_keys = saved(open_keys.groupBy("members").agg(F.min("key").alias("key")).select("key"), folder, "open")
    rest = saved(placed.join(open_keys, "key", "left_semi"), folder, "rest")
    full = full_sets(rest.select("node").distinct(), docs, classes, shingle, folder, "rest")
    rest = rest.join(classes.select("node", "n", "signature"), "node").join(full, "node")
    more = saved(rest_links(rest, least, percent), folder, "more")
    if not more.isEmpty():
        found = connected(links.unionByName(more), folder, "all")

    of_class = classes.select("node", "id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = of_class.groupBy("component").agg(F.min("id").alias("component_id"))
    of_class = saved(of_class.join(least_id, "component").select("node", "component_id"), folder, "of-class")
    out = sets.select("id", "n", "node").join(of_class, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
