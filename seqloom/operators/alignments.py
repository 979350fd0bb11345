"""What is decided on single alignments and their mates.

An alignment has id, qname, flag, contig, s, e (half-open), mapq, cigar, seq, sample, mate_contig, mate_s. Null
flags, positions or qualities satisfy no predicate: such rows are in no result that asks for one. Repeated rows are
judged each on their own; where one of several is chosen, ties go to the smallest id. Empty tables give no rows. Other columns
pass through filters and are ignored elsewhere; names that begin with an underscore are taken by these operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of an alignment's flag.
PAIRED, UNMAPPED, MATE_UNMAPPED, REVERSE, FIRST, SECOND, SECONDARY, DUPLICATE, SUPPLEMENTARY = 1, 4, 8, 16, 64, 128, 256, 1024, 2048
#: Tags that a reduced alignment keeps.
KEPT_TAGS = ("NM", "MC", "MD", "MQ", "AS", "XS", "RG")


def has(bit: int, flag: Column | str = "flag") -> Column:
    flag = F.col(flag) if isinstance(flag, str) else flag
    return flag.bitwiseAND(F.lit(bit)) != 0


def is_primary() -> Column:
    return ~has(SECONDARY) & ~has(SUPPLEMENTARY)


def mate_is_mapped() -> Column:
    return F.col("mate_s").isNotNull() & ~has(MATE_UNMAPPED)


def clip(cigar: Column, left: bool) -> Column:
    """Length of the soft clip at one end, 0 without one."""
    n = F.regexp_extract(cigar, r"^(\d+)S" if left else r"(\d+)S$", 1)
    return F.when(n == "", 0).otherwise(n.try_cast("bigint"))


def cigar_sum(cigar: Column, operations: str) -> Column:
    """Sum of the lengths of the named operations."""
    lengths = F.transform(F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{operations}]")), lambda v: v.cast("bigint"))
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, v: a + v)


def region(alignments: DataFrame, contig: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows that overlap [start, end) of a contig; all rows where any bound is None.

    Over a table partitioned by contig and sorted by s, partitions and row groups are pruned by these predicates.
    """
    if contig is None or start is None or end is None:
        return alignments
    return alignments.where((F.col("contig") == contig) & (F.col("s") < end) & (F.col("e") > start))


def clipped(alignments: DataFrame, least_clip: int = 3, most_other_clip: int = 2, most_n: int = 4, least_p: float = 0.01) -> DataFrame:
    """Mapped, not duplicate reads whose query exceeds their reference span by least_clip, with at most
    most_other_clip clipped at the less clipped end, at most most_n N, rank test p (column p) of least_p or more
    and at least one aligned base; adds breakpos (the reference end that the longer clip is at) and dir."""
    if least_clip < 2:
        raise ValueError("least_clip under 2")
    left, right = clip(F.col("cigar"), True), clip(F.col("cigar"), False)
    query, span = cigar_sum(F.col("cigar"), "MIS=X"), cigar_sum(F.col("cigar"), "MDN=X")
    good = ~has(UNMAPPED) & ~has(DUPLICATE) & (query - span >= least_clip) & (F.least(left, right) <= most_other_clip)
    good &= (F.regexp_count(F.upper("seq"), F.lit("N")) <= most_n) & (F.col("p") >= least_p) & (cigar_sum(F.col("cigar"), "M=X") >= 1)
    at_left = left > right
    return alignments.where(good).withColumns({"dir": F.when(at_left, "left").otherwise("right"), "breakpos": F.when(at_left, F.col("s")).otherwise(F.col("e") - 1), "clipped": F.greatest(left, right)})


def mate_distance() -> Column:
    return F.when(F.col("mate_contig") == F.col("contig"), F.abs(F.col("mate_s") - F.col("s")))


def discordant(alignments: DataFrame, distance: int = 10_000) -> DataFrame:
    """Paired, mapped, primary, not duplicate reads of mapq above 0 whose mate is unmapped, on another contig, or
    more than distance away; adds kind (unmapped, mapped)."""
    rows = alignments.where(has(PAIRED) & ~has(UNMAPPED) & is_primary() & ~has(DUPLICATE) & (F.col("mapq") > 0))
    far = F.col("mate_contig").isNotNull() & ((F.col("mate_contig") != F.col("contig")) | (mate_distance() > distance))
    return rows.withColumn("kind", F.when(has(MATE_UNMAPPED), "unmapped").when(far, "mapped")).where("kind is not null")


def anchored(alignments: DataFrame, distance: int = 10_000, least_mapq: int = 1) -> DataFrame:
    """Mapped, not duplicate reads of least_mapq whose mapped mate is on another contig or at least distance away."""
    far = (F.col("mate_contig") != F.col("contig")) | (mate_distance() >= distance)
    return alignments.where(~has(UNMAPPED) & mate_is_mapped() & ~has(DUPLICATE) & (F.col("mapq") >= least_mapq) & far)


def worth_keeping(alignments: DataFrame, least_clip: int = 10, most_n: int = 3, distance: int = 10_000) -> DataFrame:
    """Rows of a reduced table: unmapped, mate unmapped, clipped by least_clip, or discordant; no duplicates, no
    hard clips, at most most_n N."""
    cigar = F.coalesce("cigar", F.lit(""))
    ok = ~has(DUPLICATE) & ~cigar.contains("H") & (F.regexp_count(F.upper("seq"), F.lit("N")) <= most_n)
    wide = F.greatest(clip(cigar, True), clip(cigar, False)) >= least_clip
    far = F.coalesce((F.col("mate_contig") != F.col("contig")) | (mate_distance() > distance), F.lit(False))
    return alignments.where(ok & (has(UNMAPPED) | has(MATE_UNMAPPED) | wide | far))


def kept_tags(tags: Column, names: tuple[str, ...] = KEPT_TAGS) -> Column:
    return F.map_filter(tags, lambda k, v: k.isin(*names))


def mates(alignments: DataFrame) -> DataFrame:
    """id, mate_id: each read's mate, the primary row of its name and sample with another flag of first and second,
    at the mate's place; of several the first by s and id. Rows without one are left out."""
    end = F.col("flag").bitwiseAND(F.lit(FIRST | SECOND))
    other = alignments.where(is_primary()).select("sample", "qname", F.col("contig").alias("_contig"), F.col("s").alias("_s"), F.col("id").alias("_id"), end.alias("_end"))
    met = alignments.withColumn("_own", end).join(other, ["sample", "qname"]).where("_id <> id and _end <> _own and _contig <=> mate_contig and _s <=> mate_s")
    return met.groupBy("id").agg(F.min(F.struct("_s", "_id"))["_id"].alias("mate_id"))


def mapped_mates(alignments: DataFrame) -> DataFrame:
    """id, mate_id: for reads whose mate is mapped, the first record at the mate's place (by s, then id; it covers the base
    mate_s) of the same sample and name that is primary and whose bases differ. Reads without one are left out."""
    other = alignments.where(is_primary()).select("sample", "qname", F.col("contig").alias("_contig"), F.col("s").alias("_s"), F.col("e").alias("_e"), F.col("id").alias("_id"), F.col("seq").alias("_seq"))
    asked = alignments.where(mate_is_mapped()).select("id", "sample", "qname", "mate_contig", "mate_s", "seq")
    met = asked.join(other, ["sample", "qname"]).where("_contig = mate_contig and _s <= mate_s and mate_s < _e and _seq <> seq")
    return met.groupBy("id").agg(F.min(F.struct("_s", "_id"))["_id"].alias("mate_id"))


def first_unmapped_mates(alignments: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, sample, id: of each cluster's (cluster, sample, qname) unmapped mates only the first of each sample."""
    found = clusters.join(alignments.where(has(UNMAPPED)).select("sample", "qname", "id"), ["sample", "qname"])
    return found.groupBy("cluster", "sample").agg(F.min("id").alias("id"))


def soft_clips_at(alignments: DataFrame, sites: DataFrame, flex: int = 1, least: int = 5) -> DataFrame:
    """tid, n: reads clipped by more than least that start or end within flex of a site's (tid, contig, pos)."""
    rows = alignments.where(cigar_sum(F.col("cigar"), "MIS=X") - cigar_sum(F.col("cigar"), "MDN=X") > least)
    ends = rows.select("id", "contig", F.explode(F.array_distinct(F.flatten(F.transform(F.array("s", "e"), lambda x: F.sequence(x - flex, x + flex))))).alias("pos"))
    counts = ends.join(sites, ["contig", "pos"]).groupBy("tid").agg(F.count_distinct("id").alias("n"))
    return sites.select("tid").join(counts, "tid", "left").select("tid", F.coalesce("n", F.lit(0)).alias("n"))


def read_kind(qname: Column) -> Column:
    """SR or DR by the part of the name that says so; null for neither."""
    return F.nullif(F.regexp_extract(qname, r"\.(SR|DR)(?:/|$)", 1), F.lit(""))


def remap_summary(alignments: DataFrame, group: str) -> DataFrame:
    """Per group: least and greatest aligned position, and remapped reads by kind; unmapped rows count nowhere."""
    kind = read_kind(F.col("qname"))
    return alignments.where(~has(UNMAPPED)).groupBy(group).agg(F.min("s").alias("min_pos"), (F.max("e") - 1).alias("max_pos"), F.count_if(kind == "DR").alias("dr"), F.count_if(kind == "SR").alias("sr"))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def least_quality(alignments: DataFrame, order: list[str], first: int = 10_001) -> DataFrame:
    """One row, minqual: the least code of a quality character in the first rows of the order."""
    head = alignments.orderBy(*order).limit(first).where(F.length("qual") > 0)
    least = F.array_min(F.transform(F.filter(F.split("qual", ""), lambda c: c != ""), lambda c: F.ascii(c)))
    return head.agg(F.min(least).alias("minqual"))


def pairs_and_singletons(alignments: DataFrame) -> DataFrame:
    """pairs, singletons: names with both and with one of the ends."""
    ends = alignments.groupBy("qname").agg(F.count_distinct(has(FIRST)).alias("ends"))
    return ends.agg(F.count_if(F.col("ends") == 2).alias("pairs"), F.count_if(F.col("ends") == 1).alias("singletons"))


def unclipped_start() -> Column:
    return F.col("s") - clip(F.col("cigar"), True)


def last_by_name(sets: list[DataFrame]) -> DataFrame:
    """Union of sets with one row per qname, that of the last set which has it (there the one with the largest id)."""
    rows = [df.withColumn("_at", F.lit(k)) for k, df in enumerate(sets)]
    whole = rows[0]
    for df in rows[1:]:
        whole = whole.unionByName(df)
    return first_by_name(whole, ["qname"], [F.desc("_at"), F.desc("id")]).drop("_at")


def first_by_name(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key, the first in the order; each task passes on one row a key at most."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")
