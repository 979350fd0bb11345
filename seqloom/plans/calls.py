"""More registered queries: what is decided on clusters, chunks, pileups and strings before calls are made."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom import adapters
from seqloom.adapters import table
from seqloom.functions import sequences as seqs
from seqloom.operators import calls, intervals
from seqloom.plans.catalogue import discordant, prefilter_reason, query


@query("""x1 AS (SELECT *, CASE WHEN s - lag(e) OVER w <= 250 THEN 0 ELSE 1 END AS new FROM discordant WINDOW w AS (PARTITION BY contig ORDER BY s, id)),
x2 AS (SELECT *, sum(new) OVER (PARTITION BY contig ORDER BY s, id) AS k FROM x1),
x3 AS (SELECT *, first_value(id) OVER v AS cluster, lag(strand) OVER v <> strand AS a, lag(mate_strand) OVER v <> mate_strand AS b FROM x2 WINDOW v AS (PARTITION BY contig, k ORDER BY s, id))
SELECT contig, cluster, count(*) AS n FROM x3 GROUP BY contig, cluster HAVING count(*) FILTER (a) = 1 AND count(*) FILTER (b) = 1 AND count(*) FILTER (a AND b) = 1""")
def strand_switch_clusters(spark, sf_dir):
    return calls.strand_switch_clusters(discordant(spark, sf_dir), 250)


@query("""x1 AS (SELECT CASE WHEN l_discount < 0.02 THEN 'minmatch' WHEN l_quantity < 4 THEN 'mindisc' WHEN l_linenumber < 2 THEN 'minsplit' WHEN l_tax > 0.07 THEN 'mapends' ELSE 'PASS' END AS reason FROM lineitem)
SELECT reason, count(*) AS n FROM x1 GROUP BY reason""")
def reason_histogram(spark, sf_dir):
    reasons = prefilter_reason(spark, sf_dir).select(F.coalesce("reason", F.lit("PASS")).alias("reason"))
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""x1 AS (SELECT doc_id % 8 AS contig, unnest(range(0, len(seq))) AS pos, unnest(string_split(seq, '')) AS base FROM seqs WHERE seq <> ''),
x2 AS (SELECT contig, pos, base, count(*) AS n FROM x1 GROUP BY ALL),
x3 AS (SELECT *, sum(n) OVER (PARTITION BY contig, pos) AS depth FROM x2)
SELECT contig, pos, base, n, depth::BIGINT AS depth FROM x3 WHERE depth >= 8 AND 2 * n > depth""")
def pileup_majority(spark, sf_dir):
    s = adapters.sequences(spark, sf_dir).select((F.col("doc_id") % 8).alias("contig"), "seq")
    return calls.pileup_majority(s, 8)


@query(r"""x1 AS (SELECT l_orderkey, l_linenumber, concat(l_quantity::INT, 'M', l_linenumber, 'I', l_suppkey, 'M') AS cigar FROM lineitem),
x2 AS (SELECT l_orderkey, l_linenumber, list_sum(list_transform(regexp_extract_all(cigar, '(\d+)M', 1), lambda v: v::BIGINT))::BIGINT AS matched FROM x1)
SELECT l_orderkey, l_linenumber, matched, round(1 - l_linenumber::DOUBLE / matched, 6)::DOUBLE AS fraction FROM x2""")
def cigar_matches(spark, sf_dir):
    cigar = F.concat(F.col("l_quantity").cast("int"), F.lit("M"), "l_linenumber", F.lit("I"), "l_suppkey", F.lit("M"))
    matched = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", seqs.cigar_matched(cigar).alias("matched"))
    return matched.withColumn("fraction", F.round(seqs.match_fraction(F.col("l_linenumber"), F.col("matched")), 6))


@query("""SELECT p_partkey, len(p_name)::BIGINT AS tsd_len, levenshtein(p_name, p_type)::BIGINT AS tsd_dist, len(list_distinct(string_split(p_name, '')))::BIGINT AS tsd_bases,
  len(string_split(p_type, ' '))::BIGINT AS nr_count FROM part""")
def call_features(spark, sf_dir):
    count = lambda c: c.cast("long")
    return table(spark, sf_dir, "part").select(
        "p_partkey", count(F.length("p_name")).alias("tsd_len"), count(F.levenshtein("p_name", "p_type")).alias("tsd_dist"),
        count(F.size(F.array_distinct(F.split("p_name", "")))).alias("tsd_bases"), count(F.size(F.split("p_type", " "))).alias("nr_count"))


@query("""x1 AS (SELECT * FROM targets WHERE class = '1-URGENT' AND contig <> 'view'),
x2 AS (SELECT DISTINCT id FROM reads r JOIN x1 t ON r.contig = t.contig AND r.s - 100 < t.e AND t.s < r.e + 100)
SELECT r.id, x2.id IS NOT NULL OR r.contig NOT IN (SELECT contig FROM x1) AS near FROM reads r LEFT JOIN x2 ON r.id = x2.id""")
def near_known_elements(spark, sf_dir):
    known = adapters.targets(spark, sf_dir).where("class = '1-URGENT' and contig <> 'view'")
    return calls.near_known(adapters.reads(spark, sf_dir), known, "id", 100)


@query("""SELECT DISTINCT id FROM reads r JOIN targets t ON r.contig = t.contig AND r.s < t.e AND t.s < r.e AND substr(class, 1, 1) = (mapq % 5 + 1)::VARCHAR""")
def gene_overlaps(spark, sf_dir):
    r = adapters.reads(spark, sf_dir).select("id", "contig", "s", "e", (F.col("mapq") % 5 + 1).cast("string").alias("gene"))
    met = intervals.overlap_pairs(r, adapters.targets(spark, sf_dir).select("contig", "s", "e", "class"))
    return met.where(F.substring("class", 1, 1) == F.col("gene")).select("id").distinct()


@query("""x1 AS (SELECT contig, s // 3600 AS chunk, count(*) AS n FROM reads GROUP BY ALL) SELECT contig, chunk, n, n / 3600::DOUBLE > 0.001 AS skipped FROM x1""")
def dense_chunks(spark, sf_dir):
    chunks = adapters.reads(spark, sf_dir).groupBy("contig", F.floor(F.col("s") / 3600).alias("chunk")).agg(F.count(F.lit(1)).alias("n"))
    return chunks.withColumn("skipped", calls.over_dense(F.col("n"), F.lit(3600), 1000, 0.001))


@query("""x1 AS (SELECT *, lag(mapq) OVER (PARTITION BY contig ORDER BY s, id) AS p FROM reads) SELECT contig, s, id, mapq FROM x1 WHERE p IS DISTINCT FROM mapq""")
def consecutive_distinct(spark, sf_dir):
    return calls.consecutive_distinct(adapters.reads(spark, sf_dir), "mapq")


@query("""x1 AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY md5('1:' || id), id) AS k FROM reads) SELECT contig, id, s FROM x1 WHERE k <= 50""")
def seeded_subsample(spark, sf_dir):
    return calls.seeded_subsample(adapters.reads(spark, sf_dir).select("contig", "id", "s"), "contig", 50, 1)


@query("""SELECT contig, sample, min(s) AS first_base, max(e) - 1 AS last_base, min(e - s) AS shortest, max(e - s) AS longest, round(avg(mapq), 6)::DOUBLE AS mean_mapq FROM reads GROUP BY contig, sample""")
def read_extrema(spark, sf_dir):
    length = F.col("e") - F.col("s")
    return adapters.reads(spark, sf_dir).groupBy("contig", "sample").agg(
        F.min("s").alias("first_base"), (F.max("e") - 1).alias("last_base"), F.min(length).alias("shortest"), F.max(length).alias("longest"), F.round(F.avg("mapq"), 6).alias("mean_mapq"))


@query("""SELECT doc_id, CASE WHEN contains(seq, 'ACGTA') THEN len(seq) - instr(reverse(seq), 'ATGCA') - 4 END AS at,
  CASE WHEN contains(seq, 'ACGGT') THEN 'ACGGT' WHEN contains(seq, 'ACCGT') THEN 'ACCGT' END AS oriented FROM seqs""")
def seq_last_and_oriented(spark, sf_dir):
    s = F.col("seq")
    return adapters.sequences(spark, sf_dir).select("doc_id", seqs.locate_last(s, "ACGTA").alias("at"), seqs.oriented(s, F.lit("ACGGT")).alias("oriented"))


@query("""x1 AS (SELECT user_id, min(s) AS b FROM reads WHERE contig = 'signup' GROUP BY user_id), x2 AS (SELECT user_id, max(s) AS f FROM reads WHERE contig = 'purchase' GROUP BY user_id)
SELECT user_id, coalesce((f - b)::VARCHAR, 'UNFINISHED') AS took FROM x1 LEFT JOIN x2 USING (user_id)""")
def run_times(spark, sf_dir):
    r = adapters.reads(spark, sf_dir)
    return calls.run_times(r.where("contig = 'signup'"), r.where("contig = 'purchase'"), "user_id")
