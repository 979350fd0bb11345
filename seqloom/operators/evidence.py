"""Counts of evidence: genotypes, coverage, support of samples, rule lists.

Rows with a null contig, start or end overlap nothing and count nowhere; a null mapq is under every limit. A null sample
is a sample of its own. r_s, r_e and names that begin with an underscore are taken by these operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.clustering import ranged
from seqloom.operators.intervals import SHORT, overlap_pairs
from seqloom.scratch import saved, shared_folder


def genotype_counts(reads: DataFrame, sites: DataFrame, pad: int = 5, flex: int = 1, least_mapq: int = 10) -> DataFrame:
    """tid, sample, alt, ref: reads that break within flex of a site's ends, else those that span it. Reads of one place and
    sample are compared once, and so are sites of one place."""
    good = reads.where(F.col("mapq") >= least_mapq).groupBy("contig", "s", "e", "sample").agg(F.count(F.lit(1)).alias("_n"))
    met = overlap_pairs(sites.select("contig", "s", "e").distinct(), good, SHORT, pad)
    near = lambda x, y: F.abs(F.col(x) - F.col(y)) <= flex
    alt = near("r_s", "s") | near("r_s", "e") | near("r_e", "s") | near("r_e", "e")
    spans = (F.col("r_s") < F.col("s")) & (F.col("r_e") > F.col("e"))
    counts = met.groupBy("contig", "s", "e", "sample").agg(counted(alt), counted(~alt & spans, "ref"))
    return of_sites(sites, counts)


def counted(holds: Column, name: str = "alt") -> Column:
    """Rows for which it holds, of rows that stand for _n each."""
    return F.sum(F.when(holds, F.col("_n")).otherwise(0)).alias(name)


def of_sites(sites: DataFrame, counts: DataFrame) -> DataFrame:
    """tid, sample, alt, ref of sites (tid, contig, s, e) from the counts of each distinct contig, s, e and sample."""
    return sites.select("tid", "contig", "s", "e").join(counts, ["contig", "s", "e"]).groupBy("tid", "sample").agg(F.sum("alt").alias("alt"), F.sum("ref").alias("ref"))


def of_every_sample(sites: DataFrame, reads: DataFrame, slot: int = 1000) -> DataFrame:
    """A row of sites for each sample of the reads. The names are dealt into slots of about `slot`, and each site
    meets every slot, so that any number of samples is a table and no task has all of them for a site. A slot's
    sites are dealt into `DEALS` by hash, each with a copy of its names, so that no task has all sites either."""
    names = reads.select("sample").distinct()
    slots = max(1, -(-names.count() // slot))
    names = names.withColumns({"_slot": F.pmod(F.xxhash64("sample"), F.lit(slots)).cast("int"), "_deal": F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1)))})
    dealt = sites.withColumns({"_deal": F.pmod(F.xxhash64(*sites.columns), F.lit(DEALS)).cast("int"), "_slot": F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))})
    return dealt.join(names, ["_slot", "_deal"]).drop("_slot", "_deal")


#: Fixed value: parts into which sites are dealt to meet names of samples.
DEALS = 256


def genotype_counts_all(reads: DataFrame, sites: DataFrame, pad: int = 5, flex: int = 1, least_mapq: int = 10) -> DataFrame:
    """tid, sample, alt, ref as genotype_counts, with a row for every site and every sample of the reads (whatever
    their mapq), 0 and 0 where no read lies. Zero rows are added in one aggregation."""
    none = of_every_sample(sites.select("tid"), reads).withColumns({"alt": F.lit(0).cast("long"), "ref": F.lit(0).cast("long")})
    counts = none.unionByName(genotype_counts(reads, sites, pad, flex, least_mapq))
    return counts.groupBy("tid", "sample").agg(F.sum("alt").alias("alt"), F.sum("ref").alias("ref"))


def fraction(alt: Column, ref: Column) -> Column:
    return F.coalesce(F.try_divide(alt, alt + ref), F.lit(0.0))


#: Doses between which a call is heterozygous.
LOW_DOSE, HIGH_DOSE = 0.3, 1.7


def genotype_call(alt: Column, ref: Column, least_depth: int = 10) -> Column:
    """./. under the depth; dose = 2 - 2 * fraction; 0/1 strictly between 0.3 and 1.7, 0/0 under 0.3, else 1/1."""
    dose = 2 - 2 * fraction(alt, ref)
    return F.when(alt + ref < least_depth, "./.").when((dose > LOW_DOSE) & (dose < HIGH_DOSE), "0/1").when(dose < LOW_DOSE, "0/0").otherwise("1/1")


def bin_cpm(reads: DataFrame, size: int, least_mapq: int) -> DataFrame:
    """contig, bin, n, cpm, z over tumbling bins, empty ones included: reads per million and base, deviations."""
    good = reads.where(F.col("mapq") > least_mapq)
    bins = F.sequence(F.floor(F.col("s") / size), F.floor((F.col("e") - 1) / size))
    counts = good.select("contig", F.explode(bins).alias("bin")).groupBy("contig", "bin").agg(F.count(F.lit(1)).alias("n"))
    spine = counts.groupBy("contig").agg(F.max("bin").alias("last")).select("contig", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("bin"))
    total = good.count()
    all_bins = spine.join(counts, ["contig", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    all_bins = saved(all_bins.withColumn("cpm", F.col("n") / F.lit(total / 1e6) / size), shared_folder(reads.sparkSession), "bins")
    of = all_bins.agg(F.avg("cpm").alias("mean"), F.stddev_pop("cpm").alias("sd")).first()
    return all_bins.withColumn("z", F.try_divide(F.col("cpm") - F.lit(of["mean"]), F.lit(of["sd"])))


def depth_segments(reads: DataFrame, least_depth: int, least_length: int) -> DataFrame:
    """contig, start, end of stretches that more than least_depth reads cover, at least least_length long.

    Depth comes from +1 at starts and -1 at ends, summed by position first and then along range partitions, each
    of which starts from the sum of those below it. Only the positions where depth passes the limit go on: they
    open and close stretches in turn.
    """
    steps = reads.select("contig", F.col("s").alias("at"), F.lit(1).alias("d")).unionByName(reads.select("contig", F.col("e").alias("at"), F.lit(-1).alias("d")))
    parts = ranged(steps.groupBy("contig", "at").agg(F.sum("d").alias("d")), ["contig", "at"])
    in_part, of_contig = Window.partitionBy("contig", "_part").orderBy("at"), Window.partitionBy("contig").orderBy("_part")
    totals = parts.groupBy("contig", "_part").agg(F.sum("d").alias("_t"))
    below = F.coalesce(F.sum("_t").over(of_contig.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    depths = parts.join(totals.select("contig", "_part", below.alias("_below")), ["contig", "_part"]).withColumn("depth", F.col("_below") + F.sum("d").over(in_part))
    deep, was = F.col("depth") > least_depth, F.col("depth") - F.col("d") > least_depth
    turns = depths.where(deep != was).select("contig", "_part", "at", deep.alias("opens"))
    after = turns.groupBy("contig", "_part").agg(F.min("at").alias("_first")).select("contig", "_part", F.lead("_first").over(of_contig).alias("_after"))
    spans = turns.join(after, ["contig", "_part"]).select("contig", F.col("at").alias("start"), F.coalesce(F.lead("at").over(in_part), "_after").alias("end"), "opens")
    return spans.where(F.col("opens") & (F.col("end") - F.col("start") >= least_length)).drop("opens")


def list_field_max(listed: Column, field: int) -> Column:
    """Largest number in a field (from 1) of a list such as a|2|x,b|5|y; null without one."""
    return F.array_max(F.transform(F.split(listed, ","), lambda x: F.get(F.split(x, r"\|"), F.lit(field - 1)).try_cast("double")))


def sample_support(reads: DataFrame, group: list[str]) -> DataFrame:
    """Per group: sample|count in order of sample, number of samples, and the most rows of one sample."""
    counts = reads.groupBy(*group, "sample").agg(F.count(F.lit(1)).alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("sample", "n"))), lambda x: F.concat_ws("|", x["sample"], x["n"]))
    return counts.groupBy(*group).agg(F.array_join(listed, ",").alias("support"), F.count(F.lit(1)).alias("samples"), F.max("n").alias("most"))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that fails (its condition holds); null if none does."""
    return F.coalesce(*[F.when(bad, name) for name, bad in rules])


def all_reasons(rules: list[tuple[str, Column]]) -> Column:
    """Names of all rules that fail, joined by commas; PASS if none does."""
    text = F.array_join(F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules])), ",")
    return F.when(text == "", "PASS").otherwise(text)


def covered_segments(reads: DataFrame, least_depth: int, least_length: int) -> DataFrame:
    """contig, start, end of runs of covered positions, both within, end - start at least least_length.

    A run goes on over the next position if more than least_depth reads cover it; its first position needs one read
    only. So the position before each deep stretch begins it, if it is covered. Runs come from depth changes, not
    positions: see depth_segments for how depth is summed over range partitions.
    """
    deep = depth_segments(reads, least_depth, 1)
    any_depth = depth_segments(reads, 0, 1).select("contig", F.col("start").alias("s"), F.col("end").alias("e"))
    before = deep.select("contig", F.col("start").alias("at"), "start", "end", (F.col("start") - 1).alias("s"), F.col("start").alias("e")).drop("at")
    covered = overlap_pairs(before, any_depth).select("contig", "start").distinct().withColumn("_before", F.lit(1))
    rows = deep.join(covered, ["contig", "start"], "left")
    start = F.col("start") - F.coalesce("_before", F.lit(0))
    return rows.select("contig", start.alias("start"), (F.col("end") - 1).alias("end")).where(F.col("end") - F.col("start") >= least_length)


def bin_rates(reads: DataFrame, contigs: DataFrame, size: int, least_mapq: int) -> DataFrame:
    """contig, bin, start, end, n, cpm of every bin of contigs (contig, length): reads of more than least_mapq in each bin that
    they touch, per million of all such reads and per base. The last bin ends with its contig; a bin without length has 0.0."""
    good = reads.where(F.col("mapq") > least_mapq)
    total = good.count()
    touched = F.sequence(F.floor(F.col("s") / size), F.floor((F.col("e") - 1) / size))
    counts = good.select("contig", F.explode(touched).alias("bin")).groupBy("contig", "bin").agg(F.count(F.lit(1)).alias("n"))
    spine = contigs.select("contig", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / size))).alias("bin"))
    rows = spine.join(counts, ["contig", "bin"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "start": F.col("bin") * size, "end": F.least((F.col("bin") + 1) * size, "length")})
    cpm = F.coalesce(F.try_divide(F.col("n") / F.lit(max(total, 1) / 1e6), F.col("end") - F.col("start")), F.lit(0.0))
    return rows.select("contig", "bin", "start", "end", "n", cpm.alias("cpm"))
