"""From split-read clusters to breakends, insertions and target-site duplications.

Null contigs, clusters and positions are groups of their own in counts, and overlap nothing in joins. Repeated rows count each;
empty tables give no rows. Other columns are ignored; names that begin with an underscore are taken by these operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import sequences as seqs
from seqloom.operators.alignments import DUPLICATE, UNMAPPED, clip, has
from seqloom.operators.evidence import SHORT, counted, of_every_sample, of_sites
from seqloom.operators.intervals import listed_once, many_pairs, overlap_pairs, with_hits
from seqloom.operators.sweeps import medians, without_overlap


def break_groups(members: DataFrame) -> DataFrame:
    """Per cluster, break position and direction: n, longest and shortest clip, exact median of p, samples.

    members: contig, cluster, breakpos, dir, clipped, p, sample. Null p counts in no median.
    """
    group = ["contig", "cluster", "breakpos", "dir"]
    out = members.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.max("clipped").alias("longest_clip"), F.min("clipped").alias("shortest_clip"), F.count_distinct("sample").alias("samples"))
    middle = medians(members, group, "p", "median_p").withColumnsRenamed({c: f"_m_{c}" for c in group})
    return out.join(middle, [out[c].eqNullSafe(middle[f"_m_{c}"]) for c in group], "left").select(*group, "n", "longest_clip", "shortest_clip", "median_p", "samples")


def break_positions(members: DataFrame) -> DataFrame:
    """contig, cluster, positions: distinct break positions of each cluster, in order."""
    return members.groupBy("contig", "cluster").agg(F.array_sort(F.collect_set("breakpos")).alias("positions"))


def added_mean(value: str) -> Column:
    """Aggregate: the mean of doubles as adding them gives it, in no certain order. One or two values have one sum; of three the greatest
    of their sums counts, so that a mean at a limit stands if some order reaches it; more are added as decimals of nine places."""
    v, exact = F.col(value), F.col(value).cast("decimal(18,9)")
    low, high, middle = F.min(v), F.max(v), (F.sum(exact) - F.min(exact) - F.max(exact)).cast("double")
    three = F.greatest(low + middle + high, low + high + middle, middle + high + low) / 3
    return F.when(F.count(v) < 3, F.avg(v)).when(F.count(v) == 3, three).otherwise(F.avg(exact).cast("double"))


def accepted(least_reads: int = 4, least_clip: int = 10, least_score: float = 0.95, most_n: int = 4) -> Column:
    """Whether a breakend (n, longest_clip, seq, score) stands: enough reads, a long clip, a consensus that is not
    empty, of a good score and with few N."""
    ok = (F.col("n") >= least_reads) & (F.col("longest_clip") >= least_clip) & (F.col("seq") != "") & (F.col("score") >= least_score)
    return F.coalesce(ok & (F.regexp_count(F.upper("seq"), F.lit("N")) <= most_n), F.lit(False))


def with_proximal(insertions: DataFrame, mappings: str = "mappings", at: str = "breakpos") -> DataFrame:
    """Insertions whose first breakend has a mapping that contains its break position."""
    return insertions.where(F.size(seqs.holding(F.col(mappings), F.col(at), True)) > 0)


def most_per_sample(reads: DataFrame, group: str) -> DataFrame:
    """group, num_sr, most_sr_of_sample, samples: both breakends' reads together."""
    counts = reads.groupBy(group, "sample").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(group).agg(F.sum("n").alias("num_sr"), F.max("n").alias("most_sr_of_sample"), F.array_sort(F.collect_set(F.col("sample").cast("string"))).alias("samples"))


def site_duplications(pairs: DataFrame) -> DataFrame:
    """Adds tsd_1, tsd_2 to pairs (s1, e1, seq1, q1, s2, e2, seq2, q2; ends are bases of their own, q the first aligned
    base of the read): the bases of either read within the overlap of both; null where they do not overlap."""
    over = seqs.overlap_of(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2"))
    tsd = lambda i: seqs.duplicated_bases(F.col(f"seq{i}"), F.col(f"s{i}"), F.col(f"q{i}"), over)
    return pairs.withColumns({"tsd_1": tsd(1), "tsd_2": tsd(2)})


def break_counts(alignments: DataFrame, sites: DataFrame, pad: int = 5, flex: int = 1, least_mapq: int = 10) -> DataFrame:
    """tid, sample, alt, ref of every site (tid, contig, s, e: the least and greatest break position) and sample.

    Of mapped, not duplicate reads of least_mapq in the padded site: alt if clipped by more than the site's length and
    pad at a break within flex of s or e; else ref if unclipped and spanning the site. An end without such a clip breaks
    at 0. The site starts at pad at least, but for its length. Sites without reads have 0, 0.
    """
    good = alignments.where(~has(UNMAPPED) & ~has(DUPLICATE) & (F.col("mapq") >= least_mapq))
    good = good.select("contig", "s", "e", "sample", clip(F.col("cigar"), True).alias("lclip"), clip(F.col("cigar"), False).alias("rclip"))
    good = good.groupBy("contig", "s", "e", "sample", "lclip", "rclip").agg(F.count(F.lit(1)).alias("_n"))
    at = sites.select("contig", F.col("s").alias("p1"), F.col("e").alias("p2")).distinct().withColumns({"len": F.col("p2") - F.col("p1"), "from": F.greatest(F.col("p1"), F.lit(pad))})
    met = overlap_pairs(at.withColumns({"s": F.col("from"), "e": F.col("p2")}), good, SHORT, pad)
    least = F.greatest(F.col("len"), F.lit(pad))
    right, left = F.when(F.col("rclip") > least, F.col("r_e")).otherwise(0), F.when(F.col("lclip") > least, F.col("r_s")).otherwise(0)
    near = lambda x: (F.abs(x - F.col("p1")) <= flex) | (F.abs(x - F.col("p2")) <= flex)
    alt = near(right) | near(left)
    ref = ~alt & (F.col("lclip") + F.col("rclip") == 0) & (F.col("r_s") < F.col("from")) & (F.col("r_e") > F.col("p2"))
    of = met.groupBy("contig", F.col("p1").alias("s"), F.col("p2").alias("e"), "sample").agg(counted(alt), counted(ref, "ref"))
    counts = of_sites(sites, of)
    none = of_every_sample(sites.select("tid"), alignments).withColumns({"alt": F.lit(0).cast("long"), "ref": F.lit(0).cast("long")})
    return none.unionByName(counts).groupBy("tid", "sample").agg(F.sum("alt").alias("alt"), F.sum("ref").alias("ref"))


def mappings_by_breakend(breakends: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """breakends with mappings, all records (key, s, e, mapq) of their key in order of place; an empty array for none."""
    lists = records.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("s", "e", "mapq"))).alias("mappings"))
    kind = dict(lists.dtypes)["mappings"]
    return breakends.join(lists, key, "left").withColumn("mappings", F.coalesce("mappings", F.array().cast(kind)))


def genome_windows(contigs: DataFrame, n: int, pad: int = 0, order: str = "ordinal") -> DataFrame:
    """contig, s, e of n windows of equal length over all contigs (contig, length, ordinal) end to end, padded within
    their contig; a window that crosses a border gives a row for each contig. At most n - 1 trailing bases are left over.
    A row per contig passes one window; that list is small whatever the data."""
    w = Window.orderBy(order)
    placed = contigs.withColumn("_to", F.sum("length").over(w)).withColumn("_from", F.col("_to") - F.col("length"))
    size = (contigs.agg(F.sum("length")).first()[0] or 0) // n
    cut = placed.where((F.col("length") > 0) & F.lit(size > 0)).withColumn("_size", F.lit(max(1, size)))
    last = F.least(F.floor((F.col("_to") - 1) / F.col("_size")), F.lit(n - 1))
    first = F.floor(F.col("_from") / F.col("_size"))
    cut = cut.where(first <= last).withColumn("window", F.explode(F.sequence(first, last)))
    s = F.greatest(F.col("window") * F.col("_size") - F.col("_from"), F.lit(0))
    e = F.least((F.col("window") + 1) * F.col("_size") - F.col("_from"), F.col("length"))
    return cut.select("contig", "window", F.greatest(s - pad, F.lit(0)).alias("s"), F.least(e + pad, "length").alias("e"))


def not_in_targets(clusters: DataFrame, targets: DataFrame) -> DataFrame:
    """Clusters that overlap no target."""
    return without_overlap(clusters, targets)


def annotated_records(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, annotation: of overlapping rows their fields joined by commas, Y for a track without fields, several rows in
    order joined by ; and NA for none."""
    text = F.concat_ws(",", *[F.col(f).cast("string") for f in fields]) if fields else F.lit("Y")
    track = right.select("contig", "s", "e", text.alias("_text"))

    def lists(rows: DataFrame, by: list[str]) -> DataFrame:
        met = overlap_pairs(rows, track).groupBy(*by)
        return met.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_s", "r_e", "_text"))), lambda x: x["_text"]), ";").alias("_a"))

    def alone(places: DataFrame) -> DataFrame:
        of_place = track.groupBy("contig", "s", "e").agg(F.array_join(F.array_sort(F.collect_list("_text")), ";").alias("_text"))
        met = with_hits(places, of_place, ["contig"], ["r_s", "r_e", "_text"])
        return met.withColumn("_a", joined("_hits", "_text", ";"))

    return listed_once(left, key, ["contig", "s", "e"], lists, alone if many_pairs(left, track, ["contig"]) else None)


def joined(hits: str, field: str, by: str, distinct: bool = False) -> Column:
    """A field of the listed rows, joined; null for no rows."""
    texts = F.transform(hits, lambda x: x[field])
    return F.when(F.size(hits) > 0, F.array_join(F.array_distinct(texts) if distinct else texts, by))


def annotated_by_family(left: DataFrame, right: DataFrame, key: str, family: str, fields: list[str]) -> DataFrame:
    """key, annotation: distinct records (fields joined by |) of overlapping rows of the row's own family, in order,
    joined by commas; NA for none."""
    record = F.concat_ws("|", *[F.col(f).cast("string") for f in fields])
    track = right.select("contig", "s", "e", F.col(family).alias("_other"), record.alias("_record")).distinct()

    def lists(rows: DataFrame, by: list[str]) -> DataFrame:
        met = overlap_pairs(rows, track).where("_family = _other").groupBy(*by)
        return met.agg(F.array_join(F.array_sort(F.collect_set("_record")), ",").alias("_a"))

    def alone(places: DataFrame) -> DataFrame:
        met = with_hits(places, own, ["contig", "_family"], ["_record"])
        return met.withColumn("_a", joined("_hits", "_record", ",", True))

    rows, own = left.withColumn("_family", F.col(family)), track.withColumnRenamed("_other", "_family")
    return listed_once(rows, key, ["contig", "s", "e", "_family"], lists, alone if many_pairs(rows, own, ["contig", "_family"]) else None)
