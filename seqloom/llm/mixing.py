"""Mixing sources to target weights by hash-threshold histograms (operator 7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import WORD, saved, shared_folder

#: 60 bits of MD5 in nested slices of 12: five histograms of at most 4,096 buckets a source.
HASH_BITS, LEVEL_BITS = 60, 12


def source_targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """source, source_size, target: shares by weight of all sizes, none above most times its source's size.

    Water filling in closed form: sources in the order of size over weight are capped while their cap is
    below the share that is left for them. One row per source passes here, never documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", weight)
    s = s.withColumn("cap", most * F.col("source_size"))
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    share = F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("capped", F.col("cap") / F.col("w") <= left / share)
    free = F.sum("source_size").over(all_rows) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(all_rows), F.lit(0.0))
    unit = F.coalesce(F.try_divide(free, F.sum(F.when(~F.col("capped"), F.col("w"))).over(all_rows)), F.lit(0.0))
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(unit * F.col("w")).alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame, most: int, folder: str) -> DataFrame:
    """source, source_size, target, copies (whole repeats of every document), below (hashes under it get one more).

    A histogram of sizes over the first 12 bits of the hash finds each source's boundary bucket, that is the
    bucket in which the sum passes the budget; only the rows of that bucket go on to the next 12 bits. Nothing
    is sorted but at most 4,096 sums a source.
    """
    copies = F.least(F.lit(most), F.floor(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)))).cast("long")
    budget = saved(
        targets.withColumn("copies", copies)
        .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long")), folder, "budget")
    open_rows = sizes.where("size > 0").select("source", "size", "h")
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        if level:
            here = budget.select("source", "prefix")
            open_rows = open_rows.join(here, open_rows["source"].eqNullSafe(here["source"]) & (F.shiftright("h", shift + LEVEL_BITS) == here["prefix"])).select(open_rows["source"], "size", "h")
        hist = open_rows.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        hist = hist.withColumn("upto", upto).withColumnRenamed("source", "src")
        step = budget.join(hist, budget["source"].eqNullSafe(hist["src"]) & (F.col("upto") > F.col("rest")), "left")
        first = F.min(F.struct("bucket", "upto", "size"))
        step = step.groupBy("source", "source_size", "target", "copies", "rest", "prefix").agg(first.alias("at"))
        # a source without a boundary takes all that is open: the bucket after its last
        step = step.select("source", "source_size", "target", "copies",
            (F.col("rest") - F.coalesce(F.col("at.upto") - F.col("at.size"), F.lit(0))).alias("rest"),
            F.coalesce(F.col("at.bucket"), F.shiftleft(F.col("prefix") + 1, LEVEL_BITS)).alias("prefix"))
        budget = saved(step, folder, f"budget{level}")
    return budget.select("source", "source_size", "target", "copies", F.col("prefix").alias("below"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken, repeats.

    size counts the words of the text. Every document is taken floor(target / source_size) times, and once
    more where its hash lies below the source's threshold, so no document passes most times its size and a
    source misses its target by less than the documents of one hash. The hash is of seed and id: reruns agree,
    and repeated rows with one id share their fate.

    Null and empty texts have size 0 and are taken 0 times. Null is a source of its own, the last. A source of
    size 0 has target 0. Null ids share a hash. An empty table gives no rows; other columns are ignored.
    """
    folder = shared_folder(docs.sparkSession)
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, HASH_BITS // 4), 16, 10).cast("long")
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    sizes = saved(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), h.alias("h")), folder, "sizes")
    cut = thresholds(sizes, source_targets(sizes, weights, float(most)), most, folder).withColumnRenamed("source", "src")
    extra = (F.col("h") < F.col("below")).cast("long")
    out = sizes.join(cut, sizes["source"].eqNullSafe(cut["src"])).withColumn("repeats", F.col("copies") + extra)
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats")
