"""Registered queries of the package and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom import adapters
from seqloom.adapters import table
from seqloom.functions import sequences as seqs
from seqloom.operators import clustering, evidence, intervals, outliers, sweeps
from seqloom.sources import text

DISTANT = 10_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: SQL of the adapters, put before each query's own.
WITH = r"""
WITH RECURSIVE reads AS (
  SELECT event_id AS id, event_type AS contig, date_diff('second', TIMESTAMP '2024-01-01', ts) AS s,
    date_diff('second', TIMESTAMP '2024-01-01', ts) + 1 + floor(value)::BIGINT AS e, CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END AS strand,
    user_id % 3 AS sample, regexp_extract(props, '"k": *(\d+)', 1)::INT AS mapq, user_id FROM events),
mates AS (
  SELECT *, lead(contig) OVER w AS mate_contig, lead(s) OVER w AS mate_s, lead(strand) OVER w AS mate_strand FROM reads WINDOW w AS (PARTITION BY user_id ORDER BY s, id)),
targets AS (
  SELECT o_orderkey AS tid, list_extract(['click', 'error', 'purchase', 'signup', 'view'], (o_custkey % 5 + 1)::INT) AS contig, (o_orderkey * 173) % 2592000 AS s,
    (o_orderkey * 173) % 2592000 + 300 AS e, o_orderpriority AS class FROM orders),
breakends AS (
  SELECT id, contig, CASE WHEN id % 2 = 0 THEN 'left' ELSE 'right' END AS dir, CASE WHEN id % 2 = 0 THEN s ELSE e - 1 END AS pos, mapq % 10 AS n, s, e FROM reads),
discordant AS (SELECT * FROM mates WHERE mapq >= 1 AND mate_s IS NOT NULL AND (mate_contig <> contig OR abs(mate_s - s) >= 10000)),
seqs AS (
  SELECT doc_id, translate(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]', '', 'g'),
    'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = WITH + (", " if sql.lstrip().startswith("x") else "") + sql
        return f

    return add


def discordant(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = adapters.mates(adapters.reads(spark, sf_dir))
    far = (F.col("mate_contig") != F.col("contig")) | (F.abs(F.col("mate_s") - F.col("s")) >= DISTANT)
    return m.where((F.col("mapq") >= 1) & F.col("mate_s").isNotNull() & far)


@query("SELECT id, contig, s, e, strand, mate_contig, mate_s, mate_strand FROM discordant")
def discordant_reads(spark, sf_dir):
    return discordant(spark, sf_dir).select("id", "contig", "s", "e", "strand", "mate_contig", "mate_s", "mate_strand")


CLUSTERS = """x1 AS (SELECT *, CASE WHEN s - lag(e) OVER w <= {gap} THEN 0 ELSE 1 END AS new FROM discordant WINDOW w AS (PARTITION BY contig ORDER BY s, id)),
x2 AS (SELECT *, sum(new) OVER (PARTITION BY contig ORDER BY s, id) AS k FROM x1),
x3 AS (
  SELECT contig, k, first(id ORDER BY s, id) AS cluster, min(s) AS "start", last(e ORDER BY s, id) AS "end", first(strand = mate_strand ORDER BY s, id) AS f,
    last(strand = mate_strand ORDER BY s, id) AS l, count(*) AS n, count(DISTINCT sample) AS samples FROM x2 GROUP BY contig, k)
SELECT contig, cluster, "start", "end", CASE WHEN f AND l THEN '-' WHEN NOT f AND NOT l THEN '+' ELSE 'NA' END AS strand, n, samples FROM x3 WHERE n >= 4"""


def clusters_of_discordant(spark, sf_dir, spacing: int, least: int = 4) -> DataFrame:
    return clustering.cluster_summary(clustering.gap_clusters(discordant(spark, sf_dir), spacing), least)


@query(CLUSTERS.format(gap=250))
def discordant_clusters(spark, sf_dir):
    return clusters_of_discordant(spark, sf_dir, 250)


@query("""x1 AS (SELECT id, r.contig, r.s, r.e, tid, t.s AS r_s, class, row_number() OVER (PARTITION BY id ORDER BY t.s, tid) AS k
  FROM reads r JOIN targets t ON r.contig = t.contig AND r.s < t.e AND t.s < r.e) SELECT id, contig, s, e, tid, r_s, class FROM x1 WHERE k = 1""")
def anchored_reads_first_hit(spark, sf_dir):
    hit = intervals.first_hit(adapters.reads(spark, sf_dir), adapters.targets(spark, sf_dir), "id", ["r_s", "tid"])
    return hit.select("id", "contig", "s", "e", "tid", "r_s", "class")


@query("SELECT id, contig, s FROM reads r WHERE NOT EXISTS (SELECT 1 FROM targets t WHERE r.contig = t.contig AND r.s < t.e AND t.s < r.e)")
def mask_anti_join(spark, sf_dir):
    return sweeps.without_overlap(adapters.reads(spark, sf_dir).select("id", "contig", "s", "e"), adapters.targets(spark, sf_dir)).select("id", "contig", "s")


@query("""x1 AS (SELECT tid, CASE WHEN r.s = 0 THEN 0 ELSE greatest(0, least(r.e, t.e) - greatest(r.s + 1, t.s) + 1) END AS k, mapq
  FROM targets t JOIN reads r ON r.contig = t.contig AND r.s < t.e AND t.s < r.e),
x2 AS (SELECT tid, sum(k * mapq)::DOUBLE / nullif(sum(k), 0) AS m FROM x1 GROUP BY tid)
SELECT tid, round(coalesce(m, 0.0), 6)::DOUBLE AS mean FROM targets LEFT JOIN x2 USING (tid)""")
def track_mean_per_interval(spark, sf_dir):
    track = adapters.reads(spark, sf_dir).select("contig", "s", "e", "mapq")
    return sweeps.track_mean(adapters.targets(spark, sf_dir), track, "tid", "mapq").select("tid", F.round("mean", 6).alias("mean"))


@query("""x1 AS (SELECT id, string_agg(DISTINCT class, ',' ORDER BY class) AS a FROM reads r JOIN targets t ON r.contig = t.contig AND r.s < t.e AND t.s < r.e GROUP BY id)
SELECT id, coalesce(a, 'NA') AS annotation FROM reads LEFT JOIN x1 USING (id)""")
def annotate_intervals(spark, sf_dir):
    return intervals.annotated(adapters.reads(spark, sf_dir), adapters.targets(spark, sf_dir), "id", "class")


@query("""SELECT id, contig, s, e, mapq FROM reads a WHERE NOT EXISTS (
  SELECT 1 FROM reads b WHERE a.contig = b.contig AND a.s - 500 < b.e AND b.s < a.e + 500 AND b.mapq > a.mapq)""")
def drop_weaker_neighbours(spark, sf_dir):
    return sweeps.drop_weaker(adapters.reads(spark, sf_dir).select("id", "contig", "s", "e", "mapq"), "id", "mapq", 500)


GENOTYPES = """x1 AS (
  SELECT tid, sample, abs(r.s - t.s) <= 1 OR abs(r.s - t.e) <= 1 OR abs(r.e - t.s) <= 1 OR abs(r.e - t.e) <= 1 AS alt, r.s < t.s AND r.e > t.e AS spans
  FROM targets t JOIN reads r ON r.contig = t.contig AND t.s - 5 < r.e AND r.s < t.e + 5 WHERE mapq >= 10),
x2 AS (SELECT tid, sample, count(*) FILTER (alt) AS alt, count(*) FILTER (NOT alt AND spans) AS ref FROM x1 GROUP BY tid, sample)
"""


@query(GENOTYPES + "SELECT * FROM x2")
def genotype_counts(spark, sf_dir):
    return evidence.genotype_counts(adapters.reads(spark, sf_dir), adapters.targets(spark, sf_dir))


@query(GENOTYPES + """, x3 AS (SELECT *, coalesce(alt::DOUBLE / nullif(alt + ref, 0), 0.0)::DOUBLE AS vaf FROM x2)
SELECT tid, sample, round(vaf, 6) AS vaf, CASE WHEN alt + ref < 1 THEN './.' WHEN 2 - 2 * vaf > 0.3 AND 2 - 2 * vaf < 1.7 THEN '0/1' WHEN 2 - 2 * vaf < 0.3 THEN '0/0' ELSE '1/1' END AS gt FROM x3""")
def genotype_calls(spark, sf_dir):
    counts = evidence.genotype_counts(adapters.reads(spark, sf_dir), adapters.targets(spark, sf_dir))
    alt, ref = F.col("alt"), F.col("ref")
    return counts.select("tid", "sample", F.round(evidence.fraction(alt, ref), 6).alias("vaf"), evidence.genotype_call(alt, ref, 1).alias("gt"))


ALL_GENOTYPES = GENOTYPES + """, x3 AS (
  SELECT t.tid, n.sample, coalesce(alt, 0) AS alt, coalesce(ref, 0) AS ref FROM targets t CROSS JOIN (SELECT DISTINCT sample FROM reads) n
  LEFT JOIN x2 ON x2.tid = t.tid AND x2.sample = n.sample)
"""


@query(ALL_GENOTYPES + "SELECT * FROM x3")
def genotype_counts_all(spark, sf_dir):
    return evidence.genotype_counts_all(adapters.reads(spark, sf_dir), adapters.targets(spark, sf_dir))


@query(ALL_GENOTYPES + """, x4 AS (SELECT *, coalesce(alt::DOUBLE / nullif(alt + ref, 0), 0.0)::DOUBLE AS vaf FROM x3)
SELECT tid, sample, round(vaf, 6) AS vaf, CASE WHEN alt + ref < 1 THEN './.' WHEN 2 - 2 * vaf > 0.3 AND 2 - 2 * vaf < 1.7 THEN '0/1' WHEN 2 - 2 * vaf < 0.3 THEN '0/0' ELSE '1/1' END AS gt FROM x4""")
def genotype_calls_all(spark, sf_dir):
    counts = evidence.genotype_counts_all(adapters.reads(spark, sf_dir), adapters.targets(spark, sf_dir))
    alt, ref = F.col("alt"), F.col("ref")
    return counts.select("tid", "sample", F.round(evidence.fraction(alt, ref), 6).alias("vaf"), evidence.genotype_call(alt, ref, 1).alias("gt"))


@query("""x0 AS (SELECT * FROM reads WHERE mapq > 10),
x1 AS (SELECT contig, unnest(range(s // 3600, (e - 1) // 3600 + 1)) AS bin FROM x0), x2 AS (SELECT contig, bin, count(*) AS n FROM x1 GROUP BY contig, bin),
x3 AS (SELECT contig, unnest(range(0, max(bin) + 1)) AS bin FROM x2 GROUP BY contig),
x4 AS (SELECT contig, bin, coalesce(n, 0) / ((SELECT count(*) FROM x0) / 1e6::DOUBLE) / 3600 AS cpm FROM x3 LEFT JOIN x2 USING (contig, bin)),
x5 AS (SELECT contig, bin, cpm, (cpm - avg(cpm) OVER ()) / stddev_pop(cpm) OVER () AS z FROM x4)
SELECT contig, bin, round(cpm, 6)::DOUBLE AS cpm, round(z, 6)::DOUBLE AS z FROM x5 WHERE z > 2""")
def bin_cpm_zscore_mask(spark, sf_dir):
    bins = evidence.bin_cpm(adapters.reads(spark, sf_dir), 3600, 10)
    return bins.where("z > 2").select("contig", "bin", F.round("cpm", 6).alias("cpm"), F.round("z", 6).alias("z"))


@query("""x1 AS (SELECT contig, s AS p, 1 AS d FROM reads UNION ALL SELECT contig, e, -1 FROM reads), x2 AS (SELECT contig, p, sum(d) AS d FROM x1 GROUP BY contig, p),
x3 AS (SELECT contig, p, sum(d) OVER w AS depth, lead(p) OVER w AS nxt FROM x2 WINDOW w AS (PARTITION BY contig ORDER BY p)),
x4 AS (SELECT *, CASE WHEN depth > 1 AND coalesce(lag(depth) OVER w, 0) <= 1 THEN 1 ELSE 0 END AS new FROM x3 WINDOW w AS (PARTITION BY contig ORDER BY p)),
x5 AS (SELECT *, sum(new) OVER (PARTITION BY contig ORDER BY p) AS k FROM x4),
x6 AS (SELECT contig, k, min(p) AS "start", max(nxt) AS "end" FROM x5 WHERE depth > 1 GROUP BY contig, k)
SELECT contig, "start", "end" FROM x6 WHERE "end" - "start" >= 20""")
def depth_segments(spark, sf_dir):
    return evidence.depth_segments(adapters.reads(spark, sf_dir), 1, 20)


def end_pairs(spark, sf_dir, left_also: DataFrame | None = None, right_also: DataFrame | None = None) -> DataFrame:
    """Pairs of breakends within 100 bases; further columns of either side, joined by a and b before pairs are made."""
    return pairs_of_ends(adapters.breakends(adapters.reads(spark, sf_dir)).withColumnsRenamed({"s": "s0", "e": "e0"}), left_also, right_also)


def pairs_of_ends(ends: DataFrame, left_also: DataFrame | None = None, right_also: DataFrame | None = None) -> DataFrame:
    ends = ends.withColumns({"s": F.col("pos"), "e": F.col("pos") + 1})
    left = ends.where("dir = 'left'").select("contig", "s", "e", F.col("id").alias("a"), F.col("n").alias("n1"), F.col("s0").alias("as0"), F.col("e0").alias("ae0"))
    right = ends.where("dir = 'right'").select("contig", "s", "e", F.col("id").alias("b"), F.col("n").alias("n2"), F.col("s0").alias("bs0"), F.col("e0").alias("be0"))
    left, right = left if left_also is None else left.join(left_also, "a"), right if right_also is None else right.join(right_also, "b")
    return intervals.overlap_pairs(left, right, evidence.SHORT, pad=100).where("abs(s - r_s) <= 100")


def pair_scores(met: DataFrame) -> DataFrame:
    overlap = F.greatest(F.lit(0), F.least("ae0", "be0") - F.greatest("as0", "bs0")).cast("double")
    return met.select("contig", "s", "a", "b", F.round(seqs.breakend_score(F.abs(F.col("s") - F.col("r_s")).cast("double"), overlap, F.col("n1"), F.col("n2")), 6).alias("score"))


@query("""x1 AS (SELECT a.id AS a, b.id AS b, abs(a.pos - b.pos)::DOUBLE AS dist, greatest(0, least(a.e, b.e) - greatest(a.s, b.s))::DOUBLE AS ov, a.n AS n1, b.n AS n2
  FROM breakends a JOIN breakends b ON a.contig = b.contig AND a.dir = 'left' AND b.dir = 'right' AND abs(a.pos - b.pos) <= 100)
SELECT a, b, round(CASE WHEN ov > 0 THEN pow(ov, 1.5) * exp(-ov / 3) / (1.329340388179137 * pow(3, 2.5)) * ov * ov - abs(dist - ov) ELSE -dist END + n1 + n2, 6)::DOUBLE AS score FROM x1""")
def breakend_pair_scores(spark, sf_dir):
    return pair_scores(end_pairs(spark, sf_dir)).select("a", "b", "score")


@query("""x1 AS (SELECT a.id AS a, b.id AS b, abs(a.pos - b.pos)::DOUBLE AS dist, greatest(0, least(a.e, b.e) - greatest(a.s, b.s))::DOUBLE AS ov, a.n AS n1, b.n AS n2
  FROM breakends a JOIN breakends b ON a.contig = b.contig AND a.dir = 'left' AND b.dir = 'right' AND abs(a.pos - b.pos) <= 100),
x2 AS (SELECT a, b, round(CASE WHEN ov > 0 THEN pow(ov, 1.5) * exp(-ov / 3) / (1.329340388179137 * pow(3, 2.5)) * ov * ov - abs(dist - ov) ELSE -dist END + n1 + n2, 6)::DOUBLE AS score FROM x1),
x3 AS (SELECT *, row_number() OVER (ORDER BY score DESC, a, b) AS k FROM x2),
x4(k, used, taken) AS (
  SELECT 0::BIGINT, []::BIGINT[], false UNION ALL
  SELECT x3.k, CASE WHEN list_contains(used, a) OR list_contains(used, b) THEN used ELSE list_concat(used, [a, b]) END, NOT (list_contains(used, a) OR list_contains(used, b)) FROM x4 JOIN x3 ON x3.k = x4.k + 1)
SELECT a, b, score FROM x3 JOIN x4 USING (k) WHERE taken""")
def breakend_greedy_pairs(spark, sf_dir):
    """Ends without evidence have no score; a null end bounds no overlap."""
    ends = adapters.breakends(adapters.reads(spark, sf_dir)).where("n is not null and s is not null").select("contig", "dir", "id", "pos", "n", F.col("s").alias("s0"), F.coalesce("e", F.lit(2**62)).alias("e0"))

    def score(left, right):
        overlap = np.minimum(left["e0"], right["e0"]) - np.maximum(left["s0"], right["s0"])
        return seqs.breakend_scores(np.abs(left["pos"] - right["pos"]), overlap, left["n"], right["n"])

    return clustering.greedy_near(ends, 100, score, lambda rest: pair_scores(pairs_of_ends(rest)), ["n", "s0", "e0"])


@query("""x1 AS (SELECT id, contig, s AS pos, ((s + e) / 2)::DOUBLE AS m, row_number() OVER (PARTITION BY contig ORDER BY s, id) AS k FROM reads),
x2(contig, k, id, head, members, median) AS (
  SELECT contig, k, id, id, [pos], floor(m)::BIGINT FROM x1 WHERE k = 1 UNION ALL
  SELECT x1.contig, x1.k, x1.id, CASE WHEN abs(median - pos) > 100 THEN x1.id ELSE head END, CASE WHEN abs(median - pos) > 100 THEN [pos] ELSE list_append(members, pos) END,
    CASE WHEN abs(median - pos) > 100 THEN floor(m)::BIGINT ELSE list_append(members, pos)[(len(members) + 1) // 2 + 1] END
  FROM x2 JOIN x1 ON x1.contig = x2.contig AND x1.k = x2.k + 1)
SELECT contig, id, head AS cluster FROM x2""")
def split_clusters(spark, sf_dir):
    r = adapters.reads(spark, sf_dir).select("id", "contig", F.col("s").alias("pos"), ((F.col("s") + F.col("e")) / 2).cast("long").alias("mid"))
    return clustering.median_clusters(r, 100, 500)


@query("""x1 AS (SELECT id, contig, s, e, row_number() OVER (PARTITION BY contig ORDER BY s, id, e) AS k, count(*) OVER (PARTITION BY contig) AS n FROM reads),
x2(contig, k, n, s, e, id, os, oe, oid) AS (
  SELECT contig, k, n, s, e, id, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM x1 WHERE k = 1 UNION ALL
  SELECT x1.contig, x1.k, x1.n, CASE WHEN o AND x2.e - x2.s >= x1.e - x1.s THEN x2.s ELSE x1.s END, CASE WHEN o AND x2.e - x2.s >= x1.e - x1.s THEN x2.e ELSE x1.e END, CASE WHEN o AND x2.e - x2.s >= x1.e - x1.s THEN x2.id ELSE x1.id END,
    CASE WHEN NOT o THEN x2.s END, CASE WHEN NOT o THEN x2.e END, CASE WHEN NOT o THEN x2.id END
  FROM (SELECT x2.*, least(x1.e, x2.e) - greatest(x1.s, x2.s) > 0 AS o FROM x2 JOIN x1 ON x1.contig = x2.contig AND x1.k = x2.k + 1) x2 JOIN x1 ON x1.contig = x2.contig AND x1.k = x2.k + 1)
SELECT contig, os AS s, oe AS e, oid AS id FROM x2 WHERE oid IS NOT NULL UNION ALL SELECT contig, s, e, id FROM x2 WHERE k = n""")
def overlap_dedup(spark, sf_dir):
    return clustering.overlap_dedup(adapters.reads(spark, sf_dir).select("id", "contig", "s", "e"))


PREFILTER = [("minmatch", "l_discount < 0.02"), ("mindisc", "l_quantity < 4"), ("minsplit", "l_linenumber < 2"), ("mapends", "l_tax > 0.07")]
CALL = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount < 0.02 THEN 'minmatch' WHEN l_quantity < 4 THEN 'mindisc'
  WHEN l_linenumber < 2 THEN 'minsplit' WHEN l_tax > 0.07 THEN 'mapends' END AS reason FROM lineitem""")
def prefilter_reason(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*CALL, evidence.first_reason([(k, F.expr(x)) for k, x in PREFILTER]).alias("reason"))


@query("""x1 AS (SELECT *, concat_ws(',', CASE WHEN l_discount < 0.02 THEN 'minmatch' END, CASE WHEN l_quantity < 4 THEN 'mindisc' END, CASE WHEN l_linenumber < 2 THEN 'minsplit' END,
  CASE WHEN l_tax > 0.07 THEN 'mapends' END) AS t FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN t = '' THEN 'PASS' ELSE t END AS filter FROM x1""")
def filter_reasons(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*CALL, evidence.all_reasons([(k, F.expr(x)) for k, x in PREFILTER]).alias("filter"))


@query("""x1 AS (SELECT contig, s // 86400 AS day, sample, count(*) AS n FROM reads GROUP BY ALL)
SELECT contig, day, string_agg(sample || '|' || n, ',' ORDER BY sample) AS support, count(*) AS samples, max(n) AS most FROM x1 GROUP BY contig, day""")
def sample_support(spark, sf_dir):
    r = adapters.reads(spark, sf_dir).withColumn("day", F.floor(F.col("s") / 86400))
    return evidence.sample_support(r, ["contig", "day"])


@query("""x1 AS (SELECT contig, s // 86400 AS day, sample FROM reads) SELECT contig, day, count(*) FILTER (sample = 0) AS sample_0, count(*) FILTER (sample = 1) AS sample_1,
  count(*) FILTER (sample = 2) AS sample_2 FROM x1 GROUP BY contig, day""")
def per_sample_pivot(spark, sf_dir):
    r = adapters.reads(spark, sf_dir).groupBy("contig", F.floor(F.col("s") / 86400).alias("day")).pivot("sample", [0, 1, 2]).count()
    return r.select("contig", "day", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"sample_{k}") for k in range(3)])


@query(GENOTYPES + """, x3 AS (SELECT tid, sample, CASE WHEN alt + ref < 1 THEN 0.0 ELSE 2 - 2 * coalesce(alt::DOUBLE / nullif(alt + ref, 0), 0.0) END::DOUBLE AS dose, alt + ref AS n FROM x2),
x4 AS (SELECT tid, sample, (CASE WHEN n < 1 THEN './.' WHEN dose > 0.3 AND dose < 1.7 THEN '0/1' WHEN dose < 0.3 THEN '0/0' ELSE '1/1' END) || ':' || printf('%.3f', round(dose, 3)) AS f FROM x3),
x5 AS (SELECT tid, max(f) FILTER (sample = 0) AS f0, max(f) FILTER (sample = 1) AS f1, max(f) FILTER (sample = 2) AS f2 FROM x4 GROUP BY tid)
SELECT tid, concat_ws(chr(9), contig, s::VARCHAR, '.', 'REF', 'ALT', '100', 'PASS', 'ELT=' || class, 'GT:DS', coalesce(f0, './.:0.000'), coalesce(f1, './.:0.000'), coalesce(f2, './.:0.000')) AS line
FROM targets LEFT JOIN x5 USING (tid)""")
def vcf_genotypes(spark, sf_dir):
    sites = adapters.targets(spark, sf_dir)
    counts = evidence.genotype_counts(adapters.reads(spark, sf_dir), sites)
    alt, ref = F.col("alt"), F.col("ref")
    dose = F.when(alt + ref < 1, 0.0).otherwise(2 - 2 * evidence.fraction(alt, ref))
    calls = counts.select("tid", "sample", evidence.genotype_call(alt, ref, 1).alias("gt"), dose.alias("dose"))
    info = F.concat(F.lit("ELT="), "class")
    samples = text.vcf_samples(adapters.reads(spark, sf_dir))
    return text.vcf_lines(sites.withColumn("pos", F.col("s")), calls, samples, info).select("tid", "line")


@query("""x1 AS (SELECT user_id, sample, count(*) AS n, max(mapq) AS m FROM reads GROUP BY ALL)
SELECT user_id, max(n)::DOUBLE AS most_reads, max(m)::DOUBLE AS most_mapq FROM x1 GROUP BY user_id""")
def list_field_maxima(spark, sf_dir):
    r = adapters.reads(spark, sf_dir).groupBy("user_id", "sample").agg(F.count(F.lit(1)).alias("n"), F.max("mapq").alias("m"))
    listed = r.groupBy("user_id").agg(F.array_join(F.collect_list(F.concat_ws("|", "sample", "n", "m")), ",").alias("l"))
    return listed.select("user_id", evidence.list_field_max(F.col("l"), 2).alias("most_reads"), evidence.list_field_max(F.col("l"), 3).alias("most_mapq"))


@query()
def isolation_scores(spark, sf_dir):
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    out = outliers.isolation_scores(table(spark, sf_dir, "lineitem"), "l_returnflag", features, CALL, train=F.col("l_linenumber") > 1, known=F.col("l_quantity") > 49)
    return out.withColumn("score", F.round("score", 6))


@query("""x1 AS (SELECT doc_id, regexp_extract_all(text, '(?s).') AS c FROM documents), x2 AS (SELECT doc_id, len(c) // 2 AS n, len(c) - len(c) // 2 AS m, unicode(unnest(c)) AS v, unnest(range(len(c))) AS k FROM x1),
x3 AS (SELECT doc_id, n::DOUBLE AS n, m::DOUBLE AS m, v, count(*)::DOUBLE AS t, (count(*) FILTER (k < n))::DOUBLE AS a FROM x2 GROUP BY doc_id, n, m, v),
x4 AS (SELECT *, sum(t) OVER (PARTITION BY doc_id ORDER BY v) - (t - 1) / 2 AS rank FROM x3),
x5 AS (SELECT doc_id, n, m, sum(a * rank) - n * (n + 1) / 2 AS u, n * m / 12 * (n + m + 1 - sum(t * t * t - t) / ((n + m) * (n + m - 1))) AS spread FROM x4 GROUP BY doc_id, n, m),
x6 AS (SELECT doc_id, CASE WHEN n * m > 0 AND spread > 0 THEN greatest(0, abs(u - n * m / 2) - 0.5) / sqrt(2 * spread) ELSE 0 END AS z FROM x5),
x7 AS (SELECT doc_id, CASE WHEN z = 0 THEN 1 WHEN z > 6 THEN 0 ELSE 1 - 2 / sqrt(pi()) * exp(-z * z) * list_sum(list_transform(range(0, 150), lambda i: exp(i * ln(4) + lgamma(i + 1) + (2 * i + 1) * ln(z) - lgamma(2 * i + 2)))) END AS p FROM x6)
SELECT doc_id, round(coalesce(p, 1), 6)::DOUBLE AS p FROM documents LEFT JOIN x7 USING (doc_id)""")
def quality_shift(spark, sf_dir):
    half = F.floor(F.char_length("text") / 2).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(outliers.quality_shift("text", half), 6).alias("p"))


@query("SELECT doc_id, md5(reverse(translate(seq, 'acgtrymkbdhvACGTRYMKBDHV', 'tgcayrkmvhdbTGCAYRKMVHDB'))) AS rc_md5 FROM seqs")
def seq_revcomp(spark, sf_dir):
    return adapters.sequences(spark, sf_dir).select("doc_id", F.md5(seqs.reverse_complement(F.col("seq"))).alias("rc_md5"))


@query("SELECT doc_id, coalesce(list_max(list_transform(regexp_extract_all(seq, 'A+'), lambda r: len(r))) - 1, 0) AS run FROM seqs")
def seq_homopolymer(spark, sf_dir):
    return adapters.sequences(spark, sf_dir).select("doc_id", seqs.homopolymer(F.col("seq"), "A").alias("run"))


@query("""SELECT doc_id, round(coalesce(greatest(len(seq) - len(replace(seq, 'A', '')), len(seq) - len(replace(seq, 'T', '')))::DOUBLE / nullif(len(seq), 0), 0.0), 6)::DOUBLE AS fraction FROM seqs""")
def seq_polya_fraction(spark, sf_dir):
    return adapters.sequences(spark, sf_dir).select("doc_id", F.round(seqs.poly_at_fraction(F.col("seq")), 6).alias("fraction"))


@query("SELECT doc_id, nullif(instr(seq, 'ACGTA'), 0) - 1 AS at FROM seqs")
def seq_locate(spark, sf_dir):
    return adapters.sequences(spark, sf_dir).select("doc_id", seqs.locate_first(F.col("seq"), "ACGTA").alias("at"))


@query("SELECT p_partkey, levenshtein(p_name, p_type) AS distance FROM part")
def seq_edit_distance(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"))


@query("SELECT id, contig, s FROM reads WHERE id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def name_semi_join(spark, sf_dir):
    names = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return adapters.reads(spark, sf_dir).join(names, "id", "left_semi").select("id", "contig", "s")


@query("SELECT id, contig, s FROM reads WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def name_anti_join(spark, sf_dir):
    names = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return adapters.reads(spark, sf_dir).join(names, "id", "left_anti").select("id", "contig", "s")


@query("""x1 AS (SELECT *, row_number() OVER (PARTITION BY contig, s // 1000 ORDER BY mapq DESC, e - s DESC, id) AS k FROM reads)
SELECT contig, s // 1000 AS slot, id, mapq FROM x1 WHERE k = 1""")
def merge_prefer_evidence(spark, sf_dir):
    r = adapters.reads(spark, sf_dir).withColumn("slot", F.floor(F.col("s") / 1000))
    best = r.groupBy("contig", "slot").agg(F.max(F.struct("mapq", (F.col("e") - F.col("s")).alias("n"), (-F.col("id")).alias("id"))).alias("x"))
    return best.select("contig", "slot", (-F.col("x.id")).alias("id"), "x.mapq")


@query("""x1 AS (SELECT contig, s, (row_number() OVER (PARTITION BY contig ORDER BY s, id) - 1) // 100 AS "window" FROM reads)
SELECT contig, "window", min(s) AS "start", max(s) AS "end", count(*) AS rows FROM x1 GROUP BY contig, "window" """)
def equal_count_windows(spark, sf_dir):
    return clustering.equal_count_windows(adapters.reads(spark, sf_dir), 100)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters_of_discordant(spark, sf_dir, 3600).orderBy("contig", "start")
