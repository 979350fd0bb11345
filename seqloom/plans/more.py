"""Further registered queries: genes and families, screens, features, variants, bins and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom import adapters
from seqloom.adapters import table
from seqloom.functions import sequences as seqs
from seqloom.operators import alignments as aln
from seqloom.operators import callset, calls, clustering, evidence, intervals
from seqloom.plans.records import query


@query("""x1 AS (SELECT id, contig, s, e, 'G' || (mapq % 5) AS gene FROM reads), x2 AS (SELECT contig, s, e, 'G' || (tid % 5) AS gene FROM targets)
SELECT DISTINCT id FROM x1 JOIN x2 ON x1.contig = x2.contig AND x1.s < x2.e AND x2.s < x1.e AND x1.gene = x2.gene""")
def gene_copies_in_genes(spark, sf_dir):
    reads = adapters.reads(spark, sf_dir).withColumn("family", F.concat(F.lit("G"), (F.col("mapq") % 5).cast("string"), F.lit("."), F.col("id").cast("string")))
    genes = adapters.targets(spark, sf_dir).withColumn("gene", F.concat(F.lit("G"), (F.col("tid") % 5).cast("string")))
    return callset.overlapping_genes(reads, genes, "id", "family")


@query("""x1 AS (SELECT * FROM targets WHERE contig <> 'view'), x2 AS (SELECT DISTINCT id FROM reads r JOIN x1 t ON r.contig = t.contig AND r.s - 200 < t.e AND t.s < r.e + 200
  WHERE tid % 20 < 10 AND (t.tid % 4 = r.mapq % 4 OR t.tid % 4 = (r.mapq + 1) % 4))
SELECT r.id, x2.id IS NOT NULL OR r.contig = 'view' AS near FROM reads r LEFT JOIN x2 ON r.id = x2.id""")
def near_families(spark, sf_dir):
    text = lambda c: (c % 4).cast("string")
    reads = adapters.reads(spark, sf_dir).withColumn("families", F.concat_ws(",", text(F.col("mapq")), text(F.col("mapq") + 1)))
    known = adapters.targets(spark, sf_dir).where("contig <> 'view'").select("contig", "s", "e", text(F.col("tid")).alias("family"), (F.col("tid") % 20).cast("double").alias("divergence"))
    return callset.near_family(reads, known, "id", "families", 200, 10.0)


SCREEN = """SELECT o_orderkey FROM orders o WHERE {no} EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND 1 - l_linenumber / nullif(l_quantity::INT, 0)::DOUBLE > 0.9)"""


def screen(spark, sf_dir, invert):
    maps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("mismatches"), F.col("l_quantity").cast("int").alias("aligned"))
    return callset.screened(table(spark, sf_dir, "orders").select("o_orderkey"), maps, "o_orderkey", 0.9, invert)


@query(SCREEN.format(no=""))
def screened_calls(spark, sf_dir):
    return screen(spark, sf_dir, False)


@query(SCREEN.format(no="NOT"))
def screened_out_calls(spark, sf_dir):
    return screen(spark, sf_dir, True)


@query("""SELECT id, tid FROM reads r JOIN targets t ON r.contig = t.contig AND least(r.e, t.e) - greatest(r.s, t.s) > 0""")
def inclusive_overlaps(spark, sf_dir):
    met = intervals.overlap_pairs(adapters.reads(spark, sf_dir).select("id", "contig", "s", "e"), adapters.targets(spark, sf_dir).select("tid", "contig", "s", "e"), evidence.SHORT, pad=1)
    return met.where(intervals.overlaps_inclusive(F.col("s"), F.col("e"), F.col("r_s"), F.col("r_e"))).select("id", "tid")


@query("""SELECT contig, sample, round(avg(1 - nm / nullif(e - s, 0)::DOUBLE), 6) AS match, count(*) FILTER (mate_unmapped) AS unmapped_mates, count(*) FILTER (NOT mate_unmapped) AS mapped_mates FROM alns GROUP BY contig, sample""")
def match_and_mates(spark, sf_dir):
    alen = aln.cigar_sum(F.col("cigar"), "MDN=X")
    return adapters.alignments(spark, sf_dir).groupBy("contig", "sample").agg(
        F.round(F.avg(seqs.match_fraction(F.col("nm").cast("double"), alen)), 6).alias("match"), F.count_if(aln.has(aln.MATE_UNMAPPED)).alias("unmapped_mates"), F.count_if(~aln.has(aln.MATE_UNMAPPED)).alias("mapped_mates"))


@query("""x0 AS (SELECT * FROM reads WHERE mapq > 10), x1 AS (SELECT contig, max(e) - 100 AS len FROM reads GROUP BY contig), x2 AS (SELECT contig, len, unnest(range(0, len // 3600 + 1)) AS bin FROM x1),
x3 AS (SELECT contig, unnest(range(s // 3600, (e - 1) // 3600 + 1)) AS bin FROM x0), x4 AS (SELECT contig, bin, count(*) AS n FROM x3 GROUP BY contig, bin)
SELECT contig, bin, least((bin + 1) * 3600, len) AS "end", coalesce(n, 0) AS n, round(coalesce(coalesce(n, 0) / ((SELECT count(*) FROM x0) / 1e6::DOUBLE) / nullif(least((bin + 1) * 3600, len) - bin * 3600, 0), 0.0), 6)::DOUBLE AS cpm
FROM x2 LEFT JOIN x4 USING (contig, bin)""")
def bin_rates(spark, sf_dir):
    reads = adapters.reads(spark, sf_dir)
    contigs = reads.groupBy("contig").agg((F.max("e") - 100).alias("length"))
    return evidence.bin_rates(reads, contigs, 3600, 10).select("contig", "bin", "end", "n", F.round("cpm", 6).alias("cpm"))


@query("""SELECT uuid, greatest(CASE WHEN tsd5 = 'NA' THEN 0 ELSE len(tsd5) END, CASE WHEN tsd3 = 'NA' THEN 0 ELSE len(tsd3) END) AS tsd_len, CASE WHEN tsd5 = 'NA' OR tsd3 = 'NA' THEN 0 ELSE levenshtein(tsd5, tsd3) END AS tsd_dist,
  greatest(CASE WHEN tsd5 = 'NA' THEN 0 ELSE len(list_distinct(string_split(tsd5, ''))) END, CASE WHEN tsd3 = 'NA' THEN 0 ELSE len(list_distinct(string_split(tsd3, ''))) END) AS tsd_bases, (te_e - te_s)::DOUBLE AS elt_len,
  CASE WHEN q % 3 = 0 THEN 0 ELSE n END AS nr_count, round(CASE WHEN q % 4 = 0 THEN 0.0 ELSE n / (q % 4)::DOUBLE END, 6)::DOUBLE AS support FROM final""")
def outlier_features(spark, sf_dir):
    q = F.col("Remapped_Discordant").cast("int")
    rows = adapters.calls(spark, sf_dir).withColumns({"NonRef": F.when(q % 3 == 0, "NA").otherwise(F.col("Variants")), "Sample_count": (q % 4).cast("string")})
    return rows.select(F.col("UUID").alias("uuid"), *[v.alias(k) for k, v in callset.outlier_features().items()], F.round(callset.per_sample("Split_reads_5prime"), 6).alias("support"))


@query("""x1 AS (SELECT id, substr(seq, 1, 10) AS b, substr(seq, 11, 8) AS l, substr(translate(md5((id // 4)::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGN'), 1, 10) AS a, substr(seq, 11, (id % 9)::INT) || substr(seq, 22, 4) AS r FROM alns),
x2 AS (SELECT *, coalesce(list_min(list_filter(range(1, 9), lambda i: i > len(r) OR l[i] <> r[i])) - 1, 8) AS fwd, coalesce(list_min(list_filter(range(1, 11), lambda i: b[-i] <> a[-i])) - 1, 10) AS back FROM x1)
SELECT id, CASE WHEN fwd + back = 0 THEN 'NA' ELSE right(b, back::INT) || substr(l, 1, fwd::INT) END AS tsd FROM x2""")
def walked_duplications(spark, sf_dir):
    s = F.col("seq")
    other = F.translate(F.md5(F.floor(F.col("id") / 4).cast("string")), "0123456789abcdef", "ACGTACGTACGTACGN")
    right = F.concat(F.substring(s, F.lit(11), (F.col("id") % 9).cast("int")), F.substring(s, 22, 4))
    return adapters.alignments(spark, sf_dir).select("id", seqs.walked_duplication(F.substring(s, 1, 10), F.substring(s, 11, 8), right, F.substring(other, 1, 10)).alias("tsd"))


@query("""x1 AS (SELECT doc_id % 8 AS contig, unnest(range(0, len(seq))) AS pos, unnest(string_split(seq, '')) AS base FROM seqs WHERE seq <> ''), x2 AS (SELECT contig, pos, base, count(*) AS n FROM x1 GROUP BY ALL),
x3 AS (SELECT *, sum(n) OVER (PARTITION BY contig, pos) AS depth FROM x2), x4 AS (SELECT * FROM x3 WHERE depth >= 8 AND 2 * n > depth),
x5 AS (SELECT doc_id AS contig, unnest(range(0, len(seq))) AS pos, unnest(string_split(seq, '')) AS ref FROM seqs WHERE doc_id < 8 AND seq <> '')
SELECT contig, pos, pos || ':' || ref || '>' || base AS variant FROM x4 JOIN x5 USING (contig, pos) WHERE ref <> base""")
def variant_calls(spark, sf_dir):
    s = adapters.sequences(spark, sf_dir)
    reference = s.where("doc_id < 8").select(F.col("doc_id").alias("contig"), "seq")
    return calls.variants(s.select((F.col("doc_id") % 8).alias("contig"), "seq"), reference, 8)


@query("""SELECT id FROM breakends WHERE dir = 'left' AND n / 10.0 > 0.4 AND abs(s % 40 - id % 30) <= 10""")
def standing_breaks(spark, sf_dir):
    ends = adapters.breakends(adapters.reads(spark, sf_dir))
    return ends.where(callset.break_stands(F.col("dir"), True, F.col("n") / 10.0, F.col("s") % 40, F.col("id") % 30, 10, 0.4)).select("id")


@query("""SELECT id, row_number() OVER (PARTITION BY contig ORDER BY s, id) - 1 AS place FROM reads""")
def sorted_places(spark, sf_dir):
    return clustering.placed(adapters.reads(spark, sf_dir).select("contig", "s", "id"), ["s", "id"], "place").select("id", F.col("place").cast("long").alias("place"))
