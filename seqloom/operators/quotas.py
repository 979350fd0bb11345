"""Samples of a fixed number of rows by a hash: thresholds are found in nested histograms, no group is sorted.

Null is a group and a kind of its own. Names that begin with an underscore are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.scratch import saved, shared_folder

#: 60 bits of MD5 in nested slices of 12: a histogram of a group has at most 4,096 buckets.
HASH_BITS, LEVEL_BITS = 60, 12


def hash_of(seed: int, key: str) -> Column:
    """The first 60 bits of the MD5 of seed:key; by it rows are taken in ascending order."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), 1, HASH_BITS // 4), 16, 10).cast("long")


def first_by_hash(df: DataFrame, quota: DataFrame, group: list[str], key: str, seed: int = 1, few: int = 1000) -> DataFrame:
    """The first rows of each group by hash of seed and key (ties: the least key), as many as quota (group, quota) says.

    A histogram of 4,096 buckets finds the bucket in which a group's quota is reached; rows of lower buckets are taken.
    While such a bucket has more than `few` rows, a histogram over the next bits of its rows refines it. Only rows of the
    last bucket are put in order. Groups without a quota give no rows, those with fewer rows than their quota all.
    """
    folder = shared_folder(df.sparkSession)
    rows = df.withColumn("_h", hash_of(seed, key))
    same = lambda left, right, names: [left[c].eqNullSafe(right[f"_g_{c}"]) for c in names]
    of = quota.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("quota").cast("long").alias("_need"), F.lit(0).cast("long").alias("_prefix"), F.lit(HASH_BITS).alias("_shift"), F.lit(False).alias("_done"))
    at = saved(of.where("_need > 0"), folder, "quota")
    names = [f"_g_{c}" for c in group]
    level = 0
    while not at.where("not _done").isEmpty() and level < HASH_BITS // LEVEL_BITS:
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        still = at.where("not _done")
        met = rows.select(*group, "_h").join(still, same(rows, still, group)).where(F.shiftright("_h", shift + LEVEL_BITS) == F.col("_prefix"))
        hist = met.groupBy(*names, "_need", F.shiftright("_h", shift).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*names).orderBy("_bucket"))
        edge = hist.withColumn("_upto", upto).where(F.col("_upto") >= F.col("_need")).groupBy(*names, "_need").agg(F.min(F.struct("_bucket", "_upto", "_n")).alias("_at"))
        found = edge.select(*names, (F.col("_need") - F.col("_at._upto") + F.col("_at._n")).alias("_need"), F.col("_at._bucket").alias("_prefix"), F.lit(shift).alias("_shift"), (F.col("_at._n") <= few).alias("_done"))
        all_of = still.join(edge.select(*[F.col(c).alias(f"_e{c}") for c in names]), [F.col(c).eqNullSafe(F.col(f"_e{c}")) for c in names], "left_anti")  # fewer rows than asked for
        at = saved(at.where("_done").unionByName(found).unionByName(all_of.select(*names, "_need", "_prefix", (F.col("_shift") * 0 + HASH_BITS).alias("_shift"), F.lit(True).alias("_done")).withColumn("_prefix", F.lit(1).cast("long"))), folder, f"level{level}")
        level += 1
    bucket = F.expr("shiftright(_h, _shift)")
    met = rows.join(at, same(rows, at, group)).where(bucket <= F.col("_prefix")).withColumn("_below", bucket < F.col("_prefix"))
    order = Window.partitionBy(*names).orderBy("_h", key)
    last = met.where("not _below").withColumn("_rank", F.row_number().over(order)).where("_rank <= _need")
    return met.where("_below").select(*df.columns).unionByName(last.select(*df.columns))


def proportional_subsample(df: DataFrame, group: str, kind: str, most: int, key: str, seed: int = 1) -> DataFrame:
    """Rows of groups of at most `most`, and of larger ones that many, shared among their kinds in proportion and cut to
    whole numbers (so that a few less may come): of each kind the first by hash."""
    counts = df.groupBy(group, kind).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(group))
    share = F.floor(F.col("n") / F.col("total").cast("double") * most)
    quota = counts.withColumn("total", total).select(group, kind, F.when(F.col("total") > most, share).otherwise(F.col("n")).alias("quota"))
    return first_by_hash(df, quota, [group, kind], key, seed)
