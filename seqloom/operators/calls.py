"""What is decided on clusters, chunks and pileups of reads before they become calls.

Null is a contig of its own; null strands and values differ from all others but null. Names that begin with an underscore are
taken by these operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.clustering import gap_clusters, ranged, with_previous
from seqloom.operators.sweeps import any_overlap


def strand_switch_clusters(reads: DataFrame, spacing: int, key: str = "id") -> DataFrame:
    """contig, cluster, n of the gap clusters in which strand and mate strand switch once each, at the same row.

    Rows are compared with the row before over range partitions and only counted by cluster, so that a cluster of
    any size is spread.
    """
    cols = ["contig", "s", key, "e", "strand", "mate_strand", "cluster"]
    clustered = gap_clusters(reads.select(*cols[:-1]), spacing, key)
    rows = with_previous(ranged(clustered.select(*cols), cols), cols)
    inside = F.col("_prev").isNotNull() & F.col("_prev.contig").eqNullSafe(F.col("contig")) & (F.col("_prev.cluster") == F.col("cluster"))
    own, mate = (inside & ~F.col(f"_prev.{c}").eqNullSafe(F.col(c)) for c in ("strand", "mate_strand"))
    counts = rows.groupBy("contig", "cluster").agg(F.count(F.lit(1)).alias("n"), F.count_if(own).alias("a"), F.count_if(mate).alias("b"), F.count_if(own & mate).alias("both"))
    return counts.where("a = 1 and b = 1 and both = 1").select("contig", "cluster", "n")


def consecutive_distinct(df: DataFrame, value: str, key: str = "id") -> DataFrame:
    """contig, s, key, value of the rows whose value is not that of the row before on their contig."""
    cols = ["contig", "s", key, value]
    rows = with_previous(ranged(df.select(*cols), cols), cols)
    same = F.col("_prev").isNotNull() & F.col("_prev.contig").eqNullSafe(F.col("contig")) & F.col(f"_prev.{value}").eqNullSafe(F.col(value))
    return rows.where(~same).select(*cols)


def over_dense(n: Column, length: Column, most: int, density: float) -> Column:
    """Whether a chunk has too many reads: by base where it is longer than most, else against most * density."""
    return F.when(length > most, n / length > density).otherwise(n > most * density)


def seeded_subsample(df: DataFrame, group: str, n: int, seed: int, key: str = "id") -> DataFrame:
    """n rows of each group by a hash of seed and key (ties: the least key); each task keeps n a group at most."""
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col(key)))
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(h, key))).where(F.col("_k") <= n).drop("_k")


def pileup_majority(seqs: DataFrame, least_depth: int) -> DataFrame:
    """contig, pos, base, n, depth where more than half of at least least_depth sequences (contig, seq) agree."""
    bases = seqs.select("contig", F.posexplode(F.split("seq", "")).alias("pos", "base")).where("base <> ''")
    counts = bases.groupBy("contig", "pos", "base").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("contig", "pos").agg(F.sum("n").alias("depth"), F.max(F.struct("n", "base")).alias("x"))
    return best.where((F.col("depth") >= least_depth) & (2 * F.col("x.n") > F.col("depth"))).select("contig", "pos", "x.base", "x.n", "depth")


def near_known(reads: DataFrame, known: DataFrame, key: str, pad: int) -> DataFrame:
    """key, near: whether a known interval lies within pad of the row; true as well on contigs without any."""
    seen = known.select("contig").distinct().withColumn("_seen", F.lit(True))
    rows = any_overlap(reads.select(key, "contig", "s", "e"), known, pad=pad, name="_hit").join(seen, "contig", "left")
    return rows.select(key, (F.col("_hit") | F.col("_seen").isNull()).alias("near"))


def run_times(started: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """key, took: seconds from the first start to the last finish as text, UNFINISHED without one."""
    first = started.groupBy(key).agg(F.min("s").alias("_from"))
    last = finished.groupBy(key).agg(F.max("s").alias("_to"))
    return first.join(last, key, "left").select(key, F.coalesce((F.col("_to") - F.col("_from")).cast("string"), F.lit("UNFINISHED")).alias("took"))


def variants(seqs: DataFrame, reference: DataFrame, least_depth: int) -> DataFrame:
    """contig, pos, variant (pos:ref>alt) where more than half of at least least_depth sequences (contig, seq) agree on another
    base than the reference's (contig, seq). A base more frequent by one wins; N is no base."""
    best = pileup_majority(seqs.withColumn("seq", F.upper("seq")), least_depth).where("base <> 'N'")
    ref = reference.select("contig", F.posexplode(F.split(F.upper("seq"), "")).alias("pos", "ref")).where("ref <> ''")
    met = best.join(ref, ["contig", "pos"]).where("ref <> base and ref <> 'N'")
    return met.select("contig", "pos", F.concat(F.col("pos").cast("string"), F.lit(":"), "ref", F.lit(">"), "base").alias("variant"))
