"""Registered queries on alignments, breakends and calls. Their SQL is written from the rules, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from seqloom import adapters
from seqloom.adapters import table
from seqloom.functions import sequences as seqs
from seqloom.operators import alignments as aln
from seqloom.operators import breakends as brk
from seqloom.operators import callset, clustering, evidence, intervals
from seqloom.plans.catalogue import QUERIES, SQL, WITH
from seqloom.sources import genome

RECORDS = WITH + r""", numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, id) AS rk FROM reads),
paired AS (
  SELECT *, CASE WHEN rk % 2 = 1 THEN lead(contig) OVER w ELSE lag(contig) OVER w END AS mate_contig, CASE WHEN rk % 2 = 1 THEN lead(s) OVER w ELSE lag(s) OVER w END AS mate_s
  FROM numbered WINDOW w AS (PARTITION BY user_id ORDER BY s, id)),
alns AS (
  SELECT *, 'u' || user_id || '.' || ((rk - 1) // 2) AS qname, CASE id % 3 WHEN 0 THEN 'SR' WHEN 1 THEN 'DR' END AS kind, id % 7 AS nm, mapq / 100.0::DOUBLE AS p,
    id % 13 * 2 AS lclip, user_id % 11 * 3 AS rclip, translate(md5(id::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGN') AS seq, md5('q' || id) AS qual,
    id % 17 = 0 AS unmapped, mate_s IS NULL OR id % 19 = 0 AS mate_unmapped, rk % 2 = 1 AS is_first, id % 23 = 0 AS secondary, id % 29 = 0 AS duplicate, id % 31 = 0 AS supplementary FROM paired),
calls AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS uuid, l_quantity::INT AS q, l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber AS n, l_tax AS tax, l_discount AS disc,
    list_extract(['L1', 'ALU', 'SVA', 'NA', 'LTR', 'SINE'], (l_partkey % 6 + 1)::INT) AS super, list_extract(['L1Ta', 'AluYa5', 'SVA_E', 'NA', 'ERVK', 'B2'], (l_partkey % 6 + 1)::INT) AS sub,
    l_quantity::INT * 3 AS te_s, l_quantity::INT * 3 + l_suppkey * 7 AS te_e, l_suppkey * 5 AS cons5, l_partkey % 400 AS cons3, l_partkey % 6 = 0 AS no_ins5, l_partkey % 4 = 0 AS no_ins3,
    CASE WHEN l_quantity::INT % 9 = 0 THEN 'NA' WHEN l_quantity::INT % 11 = 0 THEN repeat('A', l_quantity::INT)
      ELSE translate(substr(md5(l_partkey::VARCHAR), 1, l_quantity::INT % 14 + 1), '0123456789abcdef', 'ACGTACGTACGTACGT') END AS tsd5,
    translate(substr(md5((l_partkey + 1)::VARCHAR), 1, l_quantity::INT % 14 + 1), '0123456789abcdef', 'ACGTACGTACGTACGT') AS other
  FROM lineitem),
final AS (SELECT *, CASE WHEN n = 3 THEN other ELSE tsd5 END AS tsd3, s / 100.0::DOUBLE - floor(s / 100.0::DOUBLE) AS mappability FROM calls)
"""


def query(sql: str) -> Callable:
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = RECORDS + (", " if sql.lstrip().startswith("x") else "") + sql
        return f

    return add


@query("""SELECT id, CASE WHEN lclip > rclip THEN 'left' ELSE 'right' END AS dir, CASE WHEN lclip > rclip THEN s ELSE e - 1 END AS breakpos, greatest(lclip, rclip) AS clipped
FROM alns WHERE NOT unmapped AND NOT duplicate AND lclip + rclip >= 3 AND least(lclip, rclip) <= 2 AND len(seq) - len(replace(seq, 'N', '')) <= 4 AND p >= 0.01""")
def clipped_reads(spark, sf_dir):
    return aln.clipped(adapters.alignments(spark, sf_dir)).select("id", "dir", "breakpos", "clipped")


@query("""SELECT id, CASE WHEN mate_unmapped THEN 'unmapped' ELSE 'mapped' END AS kind FROM alns
WHERE NOT unmapped AND NOT secondary AND NOT supplementary AND NOT duplicate AND mapq > 0 AND (mate_unmapped OR mate_contig <> contig OR abs(mate_s - s) > 10000)""")
def discordant_mates(spark, sf_dir):
    return aln.discordant(adapters.alignments(spark, sf_dir)).select("id", "kind")


ANCHORED = """x1 AS (SELECT * FROM alns WHERE NOT unmapped AND NOT mate_unmapped AND NOT duplicate AND mapq >= 1 AND (mate_contig <> contig OR abs(mate_s - s) >= 10000))"""


@query(ANCHORED + " SELECT id, mate_contig, mate_s FROM x1")
def anchored_mates(spark, sf_dir):
    return aln.anchored(adapters.alignments(spark, sf_dir)).select("id", "mate_contig", "mate_s")


@query(ANCHORED + """, x2 AS (SELECT id, t.tid, t.class, row_number() OVER (PARTITION BY id ORDER BY t.s, t.e, class, tid) AS k
  FROM x1 JOIN targets t ON mate_contig = t.contig AND mate_s < t.e AND t.s < mate_s + len(seq)) SELECT id, tid, class FROM x2 WHERE k = 1""")
def mates_in_targets(spark, sf_dir):
    reads = aln.anchored(adapters.alignments(spark, sf_dir))
    probes = reads.select("id", F.col("mate_contig").alias("contig"), F.col("mate_s").alias("s"), (F.col("mate_s") + F.length("seq")).alias("e"))
    return intervals.first_hit(probes, adapters.targets(spark, sf_dir), "id", ["r_s", "r_e", "class", "tid"]).select("id", "tid", "class")


@query("""SELECT id FROM alns WHERE NOT duplicate AND len(seq) - len(replace(seq, 'N', '')) <= 3
AND (unmapped OR mate_unmapped OR greatest(lclip, rclip) >= 10 OR coalesce(mate_contig <> contig OR abs(mate_s - s) > 10000, false))""")
def reduced_reads(spark, sf_dir):
    return aln.worth_keeping(adapters.alignments(spark, sf_dir)).select("id")


@query("SELECT id, NOT secondary AND NOT supplementary AS is_primary, supplementary AS is_supplementary, mate_s IS NOT NULL AND NOT mate_unmapped AS mate_mapped FROM alns")
def flag_predicates(spark, sf_dir):
    return adapters.alignments(spark, sf_dir).select("id", aln.is_primary().alias("is_primary"), aln.has(aln.SUPPLEMENTARY).alias("is_supplementary"), aln.mate_is_mapped().alias("mate_mapped"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'MD,NM,RG' ELSE 'NM,RG' END AS tags FROM reads")
def tag_projection(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    tags = F.create_map(F.lit("NM"), text("nm"), F.lit("XA"), text("s"), F.when(F.col("id") % 2 == 0, "MD").otherwise("ZZ"), text("e"), F.lit("RG"), text("sample"))
    return adapters.alignments(spark, sf_dir).select("id", F.array_join(F.array_sort(F.map_keys(aln.kept_tags(tags))), ",").alias("tags"))


@query("""x1 AS (SELECT a.id, b.id AS mate_id, row_number() OVER (PARTITION BY a.id ORDER BY b.s, b.id) AS k FROM alns a JOIN alns b ON a.sample = b.sample AND a.qname = b.qname AND a.id <> b.id
  AND a.is_first <> b.is_first AND a.mate_contig = b.contig AND a.mate_s = b.s WHERE NOT b.secondary AND NOT b.supplementary) SELECT id, mate_id FROM x1 WHERE k = 1""")
def mate_lookup(spark, sf_dir):
    return aln.mates(adapters.alignments(spark, sf_dir))


@query("""x1 AS (SELECT a.id, b.id AS mate_id, row_number() OVER (PARTITION BY a.id ORDER BY b.s, b.id) AS k FROM alns a JOIN alns b ON a.sample = b.sample AND a.qname = b.qname AND a.seq <> b.seq
  AND a.mate_contig = b.contig AND b.s <= a.mate_s AND a.mate_s < b.e WHERE NOT b.secondary AND NOT b.supplementary AND NOT a.mate_unmapped) SELECT id, mate_id FROM x1 WHERE k = 1""")
def mapped_mate_lookup(spark, sf_dir):
    return aln.mapped_mates(adapters.alignments(spark, sf_dir))


@query("""SELECT a.contig AS cluster, a.sample, min(b.id) AS id FROM alns a JOIN alns b ON a.sample = b.sample AND a.qname = b.qname WHERE b.unmapped GROUP BY ALL""")
def first_unmapped_mates(spark, sf_dir):
    a = adapters.alignments(spark, sf_dir)
    return aln.first_unmapped_mates(a, a.select(F.col("contig").alias("cluster"), "sample", "qname"))


@query("""SELECT tid, count(DISTINCT r.id) AS n FROM targets t LEFT JOIN alns r ON r.contig = t.contig AND lclip + rclip > 5 AND (abs(r.s - t.s) <= 1 OR abs(r.e - t.s) <= 1) GROUP BY tid""")
def soft_clips_at_sites(spark, sf_dir):
    sites = adapters.targets(spark, sf_dir).select("tid", "contig", F.col("s").alias("pos"))
    return aln.soft_clips_at(adapters.alignments(spark, sf_dir), sites)


@query("""x1 AS (SELECT contig, min(s) AS min_pos, max(e) - 1 AS max_pos, count(*) FILTER (kind = 'DR') AS dr, count(*) FILTER (kind = 'SR') AS sr FROM alns WHERE NOT unmapped GROUP BY contig),
x2 AS (SELECT contig, count(*) FILTER (kind = 'DR') AS dr_all FROM alns GROUP BY contig) SELECT contig, min_pos, max_pos, dr, sr, round(coalesce(dr / nullif(dr_all, 0)::DOUBLE, 0.0), 6) AS dr_share FROM x1 JOIN x2 USING (contig)""")
def remap_summaries(spark, sf_dir):
    rows = adapters.alignments(spark, sf_dir).withColumn("qname", F.col("read_name"))
    whole = rows.groupBy("contig").agg(F.count_if(aln.read_kind(F.col("qname")) == "DR").alias("dr_all"))
    return aln.remap_summary(rows, "contig").join(whole, "contig").select("contig", "min_pos", "max_pos", "dr", "sr", F.round(aln.share(F.col("dr"), F.col("dr_all")), 6).alias("dr_share"))


@query("""x1 AS (SELECT qual FROM alns ORDER BY contig, s, id LIMIT 10001) SELECT min(list_min(list_transform(string_split(qual, ''), lambda c: ascii(c))))::INT AS minqual FROM x1""")
def minimum_quality(spark, sf_dir):
    return aln.least_quality(adapters.alignments(spark, sf_dir), ["contig", "s", "id"])


@query("""x1 AS (SELECT qname, count(DISTINCT is_first) AS k FROM alns GROUP BY qname) SELECT count(*) FILTER (k = 2) AS pairs, count(*) FILTER (k = 1) AS singletons FROM x1""")
def pair_counts(spark, sf_dir):
    return aln.pairs_and_singletons(adapters.alignments(spark, sf_dir))


@query("SELECT id, row_number() OVER (PARTITION BY contig, s // 10000 ORDER BY s - lclip, id) AS place, kind FROM alns")
def unclipped_order(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("contig", F.floor(F.col("s") / 10000)).orderBy(aln.unclipped_start(), "id"))
    return adapters.alignments(spark, sf_dir).select("id", place.alias("place"), aln.read_kind(F.col("read_name")).alias("kind"))


@query("""x1 AS (SELECT id, user_id % 50 AS name, sample, row_number() OVER (PARTITION BY user_id % 50 ORDER BY sample DESC, id DESC) AS k FROM reads) SELECT name, id, sample FROM x1 WHERE k = 1""")
def last_wins(spark, sf_dir):
    rows = adapters.reads(spark, sf_dir).select((F.col("user_id") % 50).alias("qname"), "id", "sample")
    return aln.last_by_name([rows.where(F.col("sample") == k) for k in range(3)]).select(F.col("qname").alias("name"), "id", "sample")


@query("""x1 AS (SELECT qname, is_first, id, row_number() OVER (PARTITION BY qname, is_first ORDER BY CASE kind WHEN 'SR' THEN 0 WHEN 'DR' THEN 1 ELSE 2 END, id) AS k FROM alns) SELECT qname, is_first, id FROM x1 WHERE k = 1""")
def first_seen_reads(spark, sf_dir):
    kind = aln.read_kind(F.col("read_name"))
    rows = adapters.alignments(spark, sf_dir).withColumn("is_first", aln.has(aln.FIRST))
    return aln.first_by_name(rows, ["qname", "is_first"], [F.when(kind == "SR", 0).when(kind == "DR", 1).otherwise(2), "id"]).select("qname", "is_first", "id")


GROUPS = """x1 AS (SELECT contig, s // 1000 AS cluster, CASE WHEN lclip > rclip THEN s ELSE e - 1 END // 10 AS breakpos, CASE WHEN lclip > rclip THEN 'left' ELSE 'right' END AS dir,
  greatest(lclip, rclip) AS clipped, p, sample, seq FROM alns)"""


def members(spark, sf_dir):
    left, right = (aln.clip(F.col("cigar"), k) for k in (True, False))
    at = F.floor(F.when(left > right, F.col("s")).otherwise(F.col("e") - 1) / 10)
    return adapters.alignments(spark, sf_dir).select("contig", F.floor(F.col("s") / 1000).alias("cluster"), at.alias("breakpos"), F.when(left > right, "left").otherwise("right").alias("dir"), F.greatest(left, right).alias("clipped"), "p", "sample", "seq")


@query(GROUPS + """ SELECT contig, cluster, breakpos, dir, count(*) AS n, max(clipped) AS longest_clip, min(clipped) AS shortest_clip, round(median(p), 6) AS median_p, count(DISTINCT sample) AS samples FROM x1 GROUP BY ALL""")
def break_groups(spark, sf_dir):
    return brk.break_groups(members(spark, sf_dir)).withColumn("median_p", F.round("median_p", 6))


@query(GROUPS + """ SELECT contig, cluster, string_agg(DISTINCT breakpos, ',' ORDER BY breakpos) AS positions FROM x1 GROUP BY ALL""")
def break_positions(spark, sf_dir):
    return brk.break_positions(members(spark, sf_dir)).withColumn("positions", F.array_join(F.transform("positions", lambda x: x.cast("string")), ","))


@query(GROUPS + """, x2 AS (SELECT contig, cluster, breakpos, dir, count(*) AS n, max(clipped) AS longest_clip, max(seq) AS seq, avg(p) AS score FROM x1 GROUP BY ALL)
SELECT contig, cluster, breakpos, dir FROM x2 WHERE n >= 2 AND longest_clip >= 10 AND seq <> '' AND score >= 0.4 AND len(seq) - len(replace(seq, 'N', '')) <= 3""")
def accepted_breakends(spark, sf_dir):
    """The mean does not hang on the order in which rows are added; where all orders give one verdict for up to three rows, it is that."""
    groups = members(spark, sf_dir).groupBy("contig", "cluster", "breakpos", "dir").agg(F.count(F.lit(1)).alias("n"), F.max("clipped").alias("longest_clip"), F.max("seq").alias("seq"), brk.added_mean("p").alias("score"))
    return groups.where(brk.accepted(least_reads=2, least_score=0.4, most_n=3)).select("contig", "cluster", "breakpos", "dir")


@query("""x1 AS (SELECT tid, sample, CASE WHEN rclip > greatest(t.e - t.s, 5) THEN r.e ELSE 0 END AS rb, CASE WHEN lclip > greatest(t.e - t.s, 5) THEN r.s ELSE 0 END AS lb, t.s AS p1, t.e AS p2,
    lclip + rclip = 0 AND r.s < greatest(t.s, 5) AND r.e > t.e AS spans
  FROM short t JOIN alns r ON r.contig = t.contig AND greatest(t.s, 5) - 5 < r.e AND r.s < t.e + 5 WHERE NOT unmapped AND NOT duplicate AND mapq >= 10),
x2 AS (SELECT tid, sample, abs(rb - p1) <= 1 OR abs(rb - p2) <= 1 OR abs(lb - p1) <= 1 OR abs(lb - p2) <= 1 AS alt, spans FROM x1),
x3 AS (SELECT tid, sample, count(*) FILTER (alt) AS alt, count(*) FILTER (NOT alt AND spans) AS ref FROM x2 GROUP BY tid, sample)
SELECT t.tid, n.sample, coalesce(alt, 0) AS alt, coalesce(ref, 0) AS ref FROM short t CROSS JOIN (SELECT DISTINCT sample FROM reads) n LEFT JOIN x3 ON x3.tid = t.tid AND x3.sample = n.sample""".replace("x1 AS (", "x0 AS (SELECT tid, contig, s, s + tid % 12 AS e FROM targets), x1 AS (", 1).replace("short", "x0"))
def genotype_break_counts(spark, sf_dir):
    sites = adapters.targets(spark, sf_dir).select("tid", "contig", "s", (F.col("s") + F.col("tid") % 12).alias("e"))
    return brk.break_counts(adapters.alignments(spark, sf_dir), sites)


EVIDENCE = """x1 AS (SELECT user_id, sample, contig, count(*) AS n FROM reads GROUP BY ALL),
x2 AS (SELECT user_id, sum(n)::BIGINT AS num_sr, max(n) AS most_sr_of_sample, string_agg(DISTINCT contig, ',' ORDER BY contig) AS samples, count(DISTINCT contig) AS k FROM x1 GROUP BY user_id)"""


def evidence_of_users(spark, sf_dir):
    return brk.most_per_sample(adapters.reads(spark, sf_dir).select("user_id", F.col("contig").alias("sample")), "user_id")


@query(EVIDENCE + " SELECT user_id, num_sr, most_sr_of_sample, samples FROM x2")
def most_per_sample(spark, sf_dir):
    return evidence_of_users(spark, sf_dir).withColumn("samples", F.array_join("samples", ","))


@query("""x1 AS (SELECT *, user_id % 20 || '.' || user_id // 20 // 16 || '.' || id % 40 AS ins FROM reads), x2 AS (SELECT ins, contig, count(*) AS n, max(mapq) AS m, sum(mapq) AS t, count(*) FILTER (mapq IN (13, 57)) AS listed FROM x1 GROUP BY ins, contig),
x3 AS (SELECT ins, sum(n) AS num_sr, max(n) AS most, max(m) AS m, sum(t)::DOUBLE / sum(n) / 100 AS mappability, count(*) AS k, sum(listed) AS listed, count(*) FILTER (contig = 'error') AS bad FROM x2 GROUP BY ins)
SELECT ins FROM x3 WHERE m >= 10 AND num_sr >= 4 AND most >= 3 AND bad = 0 AND listed = 0 AND k <= 4 AND mappability >= 0.3""")
def kept_insertions(spark, sf_dir):
    """Reads by a part of their user's number and of their own as insertions, contigs as samples, qualities as read groups."""
    u = F.col("user_id")
    rows = adapters.reads(spark, sf_dir).withColumn("ins", F.concat_ws(".", u % 20, F.floor(F.floor(u / 20) / 16), F.col("id") % 40))
    of = rows.groupBy("ins").agg(F.collect_set("mapq").alias("mapqs"), F.collect_set(F.concat_ws("|", F.concat(F.lit("g"), F.col("mapq").cast("string")), "contig")).alias("groups"), (F.avg("mapq") / 100).alias("mappability"))
    met = brk.most_per_sample(rows.select("ins", F.col("contig").alias("sample")), "ins").join(of, "ins")
    return met.where(callset.insertion_passes(least_sr_of_sample=3, excluded=["error"], most_samples=4, least_mappability=0.3, excluded_groups=["g13", "g57"])).select("ins")


@query("""x1 AS (SELECT a.id AS a, b.id AS b, a.s AS s1, a.e - 1 AS e1, b.s AS s2, b.e - 1 AS e2, x.seq AS seq1, y.seq AS seq2 FROM breakends a JOIN breakends b ON a.contig = b.contig AND a.dir = 'left' AND b.dir = 'right' AND abs(a.pos - b.pos) <= 100
  JOIN alns x ON x.id = a.id JOIN alns y ON y.id = b.id),
x2 AS (SELECT *, greatest(s1, s2) AS o1, least(e1, e2) AS o2 FROM x1)
SELECT a, b, o1 - o2 AS dist, CASE WHEN o2 > o1 THEN substr(seq1, (o1 - s1 + 1)::INT, (o2 - o1 + 1)::INT) END AS tsd_1, CASE WHEN o2 > o1 THEN substr(seq2, (o1 - s2 + 1)::INT, (o2 - o1 + 1)::INT) END AS tsd_2 FROM x2""")
def site_duplications(spark, sf_dir):
    from seqloom.plans.catalogue import end_pairs

    side = lambda k, name: adapters.alignments(spark, sf_dir).select(F.col("id").alias(name), F.col("s").alias(f"s{k}"), (F.col("e") - 1).alias(f"e{k}"), F.col("seq").alias(f"seq{k}"), F.lit(0).alias(f"q{k}"))
    pairs = end_pairs(spark, sf_dir, side(1, "a"), side(2, "b"))
    dist = seqs.distance_of(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2"))
    return brk.site_duplications(pairs).select("a", "b", dist.alias("dist"), "tsd_1", "tsd_2")


MAPPINGS = """x1 AS (SELECT id, (20 + id % 30)::INT AS len, (id % 10)::INT AS a, (id % 10 + 8)::INT AS b, (15 + id % 4)::INT AS c, (22 + id % 6)::INT AS d, (id % 40)::INT AS bp FROM reads)"""


def mappings(spark, sf_dir):
    i = F.col("id")
    at = lambda s, e: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))
    return adapters.reads(spark, sf_dir).select("id", (20 + i % 30).cast("int").alias("len"), F.array(at(i % 10, i % 10 + 8), at(15 + i % 4, 22 + i % 6)).alias("m"), (i % 40).cast("int").alias("bp"))


@query(MAPPINGS + """, x2 AS (SELECT id, unnest(range(len)) AS p, a, b, c, d FROM x1), x3 AS (SELECT id, p FROM x2 WHERE NOT (p >= a AND p < b) AND NOT (p >= c AND p < d)),
x4 AS (SELECT id, p, p - row_number() OVER (PARTITION BY id ORDER BY p) AS g FROM x3), x5 AS (SELECT id, min(p) AS s, max(p) AS e FROM x4 GROUP BY id, g),
x6 AS (SELECT id, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY s) = 1 THEN s ELSE s + 1 END AS s, e FROM x5)
SELECT x1.id, coalesce(string_agg(s || '-' || e, ',' ORDER BY s) FILTER (s <= e), '') AS segments FROM x1 LEFT JOIN x6 ON x1.id = x6.id GROUP BY x1.id""")
def uncovered_segments(spark, sf_dir):
    text = F.transform(seqs.uncovered(F.col("len"), F.col("m")), lambda x: F.concat(x["s"].cast("string"), F.lit("-"), x["e"].cast("string")))
    return mappings(spark, sf_dir).select("id", F.array_join(text, ",").alias("segments"))


@query(MAPPINGS + """ SELECT id, ((bp BETWEEN a AND b)::INT + (bp BETWEEN c AND d)::INT) AS near, 2 - ((bp BETWEEN a AND b)::INT + (bp BETWEEN c AND d)::INT) AS far FROM x1""")
def proximal_mappings(spark, sf_dir):
    return mappings(spark, sf_dir).select("id", F.size(seqs.holding(F.col("m"), F.col("bp"), True)).alias("near"), F.size(seqs.holding(F.col("m"), F.col("bp"), False)).alias("far"))


@query(MAPPINGS + " SELECT id FROM x1 WHERE bp BETWEEN a AND b OR bp BETWEEN c AND d")
def with_proximal_mapping(spark, sf_dir):
    return brk.with_proximal(mappings(spark, sf_dir), "m", "bp").select("id")


@query(MAPPINGS + " SELECT id, coalesce(a <= 2 OR b >= len - 2 OR c <= 2 OR d >= len - 2, false) AS flush FROM x1")
def flush_ends(spark, sf_dir):
    locations = F.transform("m", lambda x: F.array(x["s"], x["e"]))
    return mappings(spark, sf_dir).select("id", callset.ends_flush(locations, F.col("len")).alias("flush"))


@query("""x1 AS (SELECT p_partkey, p_name, len(list_filter(list_zip(string_split(upper(p_name), ''), string_split(upper(p_type), '')), lambda z: z[1] = z[2] AND z[1] <> '-'))::INT AS matched FROM part)
SELECT p_partkey, matched, round(matched / nullif(len(replace(p_name, '-', '')), 0)::DOUBLE, 6)::DOUBLE AS share FROM x1""")
def matched_columns(spark, sf_dir):
    name, kind = F.col("p_name"), F.col("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", seqs.columns_matched(name, kind).alias("matched"), F.round(seqs.share_matched(name, kind), 6).alias("share"))


@query("""x1 AS (SELECT id, CASE WHEN e < 1000000 THEN substr(seq, 1, 32 - rclip::INT) ELSE seq END AS seq, CASE WHEN e < 1000000 THEN substr(qual, 1, 32 - rclip::INT) ELSE qual END AS qual, s, lclip FROM alns),
x2 AS (SELECT id, CASE WHEN s > 1 THEN substr(seq, lclip::INT + 1) ELSE seq END AS seq, list_transform(string_split(CASE WHEN s > 1 THEN substr(qual, lclip::INT + 1) ELSE qual END, ''), lambda c: ascii(c) - 35) AS q FROM x1),
x3 AS (SELECT id, seq, list_min(list_filter(range(1, len(seq) - 3), lambda i: list_avg(q[i:i + 3]) < 20)) AS cut FROM x2) SELECT id, CASE WHEN cut IS NULL THEN seq ELSE substr(seq, 1, (cut - 1)::INT) END AS trimmed FROM x3""")
def chopped_and_trimmed(spark, sf_dir):
    """Soft clips come off before qualities are looked at, where the alignment ends inside its contig."""
    clips = (aln.clip(F.col("cigar"), True), aln.clip(F.col("cigar"), False))
    chop = lambda c: seqs.chopped(F.col(c), *clips, F.col("s"), F.col("e"), F.lit(1_000_000))
    return adapters.alignments(spark, sf_dir).select("id", seqs.quality_trimmed(chop("seq"), chop("qual"), mean=20).alias("trimmed"))


@query("""x1 AS (SELECT id, seq, list_transform(string_split(qual, ''), lambda c: ascii(c) - 35) AS q FROM alns),
x2 AS (SELECT id, seq, list_min(list_filter(range(1, 29), lambda i: list_avg(q[i:i + 3]) < 20)) AS cut FROM x1) SELECT id, CASE WHEN cut IS NULL THEN seq ELSE substr(seq, 1, (cut - 1)::INT) END AS trimmed FROM x2""")
def quality_trimmed(spark, sf_dir):
    return adapters.alignments(spark, sf_dir).select("id", seqs.quality_trimmed(F.col("seq"), F.col("qual"), mean=20).alias("trimmed"))


@query("""SELECT id, len(replace(seq, 'A', '')) < len(replace(seq, 'T', '')) AS forward, starts_with(seq, 'AA') AS a_first, ends_with(seq, 'TT') AS t_last, contains(seq, 'ACG') AS has_acg,
  greatest(len(seq) - len(replace(seq, 'A', '')), len(seq) - len(replace(seq, 'T', ''))) / 32.0 > 0.4 AS only_poly, translate(strand, '+-', '-+') AS swapped, contig || ':' || s || '-' || e AS region,
  coalesce(instr(seq, repeat('A', list_max(list_transform(regexp_extract_all(seq, 'A+'), lambda r: len(r)))::INT)) - 1, 0) AS run_at FROM alns""")
def sequence_predicates(spark, sf_dir):
    s = F.col("seq")
    return adapters.alignments(spark, sf_dir).select(
        "id", seqs.more_a_than_t(s).alias("forward"), seqs.tail_at(s, "A", 2, True).alias("a_first"), seqs.tail_at(s, "T", 2, False).alias("t_last"), F.contains(s, F.lit("ACG")).alias("has_acg"),
        seqs.only_poly_at(s, 0.4).alias("only_poly"), seqs.swap_strand(F.col("strand")).alias("swapped"), seqs.region_text(F.col("contig"), F.col("s"), F.col("e")).alias("region"), seqs.homopolymer_start(s, "A").alias("run_at"))


@query("""x1 AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::INT AS m, l_linenumber AS r, (l_tax * 100)::INT AS x, l_suppkey % 3 AS qg, l_partkey % 4 AS tg, l_quantity::INT + l_partkey % 9 AS qs, l_quantity::INT AS ts FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, m + (r >> 1) - x - qg - tg AS score, round(100 - 0.1 * (1000 * (x + qg + round(3 * ln(1 + greatest(qs - ts, 0)::DOUBLE))) / (m + r + x)), 6)::DOUBLE AS identity FROM x1""")
def block_scores(spark, sf_dir):
    m, r, x = F.col("l_quantity").cast("int"), F.col("l_linenumber"), F.round(F.col("l_tax") * 100).cast("int")
    qg, tg = F.col("l_suppkey") % 3, F.col("l_partkey") % 4
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", seqs.blocks_score(m, r, x, qg, tg).alias("score"), F.round(seqs.blocks_identity(m, r, x, qg, m + F.col("l_partkey") % 9, m), 6).alias("identity"))


@query("""x1 AS (SELECT doc_id, substr(seq, 1, len(seq) // 4) || substr(seq, len(seq) // 2 + 1) AS w FROM seqs)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN w ELSE reverse(translate(w, 'ACGT', 'TGCA')) END AS transcript FROM x1""")
def spliced_transcripts(spark, sf_dir):
    """The first quarter and the second half of each text as exons."""
    n = F.length("seq")
    starts, ends = F.array(F.lit(0).cast("long"), F.floor(n / 2)), F.array(F.floor(n / 4), n.cast("long"))
    strand = F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-")
    return adapters.sequences(spark, sf_dir).select("doc_id", seqs.spliced(F.col("seq"), starts, ends, strand).alias("transcript"))


@query("""SELECT tid, substr(seq, (o.tid * 37 % 5000)::INT + 1, 300) AS bases FROM targets o JOIN seqs ON doc_id = tid % 1000""")
def tiled_fetch(spark, sf_dir):
    tiled = genome.tiles(adapters.sequences(spark, sf_dir).select(F.col("doc_id").alias("contig"), "seq"), 128)
    s = F.col("tid") * 37 % 5000
    regions = adapters.targets(spark, sf_dir).select("tid", (F.col("tid") % 1000).alias("contig"), s.alias("s"), (s + 300).alias("e"))
    known = adapters.sequences(spark, sf_dir).select(F.col("doc_id").alias("contig"))
    return genome.fetched(regions.join(known, "contig", "left_semi"), tiled, "tid", 128).select("tid", F.col("seq").alias("bases"))


@query("SELECT id, s, e FROM reads WHERE contig = 'click' AND s < 1500000 AND e > 1000000")
def region_scan(spark, sf_dir):
    return aln.region(adapters.reads(spark, sf_dir), "click", 1_000_000, 1_500_000).select("id", "s", "e")
