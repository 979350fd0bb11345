"""Registered queries that depend on an order: sessions, cascades, quotas, walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom import adapters
from seqloom.adapters import table
from seqloom.functions import sequences as seqs
from seqloom.operators import callset, quotas
from seqloom.plans.callsets import raw_calls
from seqloom.plans.catalogue import SQL
from seqloom.plans.records import query
from seqloom.streaming.sessions import SessionStream


@query("""x1 AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL),
x2 AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM x1)
SELECT user_id, date_diff('microsecond', TIMESTAMP '2024-01-01', min(ts)) AS "start", date_diff('microsecond', TIMESTAMP '2024-01-01', max(ts) + INTERVAL 6 HOUR) AS "end",
  count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks, max(value) AS most FROM x2 GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    """events as a file stream, all files in one batch, so that no event is late."""
    schema = table(spark, sf_dir, "events").schema
    stream = SessionStream(spark, f"{sf_dir}/event[s].parquet", schema, "user_id", "ts", "6 hours", "1 hour", clicks=F.count_if(F.col("event_type") == "click"), most=F.max("value"))
    since = lambda c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', `{c}`)").alias(c)
    return stream.close().select("user_id", since("start"), since("end"), "n", "clicks", "most")


@query("""x1 AS (SELECT uuid, o // 100 AS contig, o % 100 AS be1, CASE WHEN q % 2 = 0 THEN o % 100 ELSE o % 100 + 7 END AS be2, {'uuid': uuid, 'two': q % 2 > 0, 'sr': (n + q % 6)::BIGINT, 'dr': q::BIGINT} AS c FROM calls),
x2 AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY be1, uuid) AS k FROM x1),
x3 AS (
  SELECT DISTINCT contig, 0::BIGINT AS k, MAP([-1::BIGINT], [{'uuid': '', 'two': false, 'sr': 0::BIGINT, 'dr': 0::BIGINT}]) AS held FROM x2
  UNION ALL SELECT x2.contig, x2.k, CASE WHEN NOT map_contains(held, be1) OR c.two AND NOT held[be1].two OR c.sr > held[be1].sr OR c.dr > held[be1].dr THEN map_concat(held, MAP([be1], [c]), MAP([be2], [c])) ELSE held END
  FROM x3 JOIN x2 ON x2.contig = x3.contig AND x2.k = x3.k + 1),
x4 AS (SELECT contig, max_by(held, k) AS held FROM x3 GROUP BY contig), x5 AS (SELECT DISTINCT unnest(map_values(held)).uuid AS uuid FROM x4)
SELECT uuid FROM x5 WHERE uuid <> ''""")
def cascaded_duplicates(spark, sf_dir):
    """Calls of chunks of 100 orders, which share places with their own kind and with what lies 7 before."""
    o = F.col("l_orderkey")
    rows = raw_calls(spark, sf_dir, "l_orderkey").withColumns({"chrom": F.floor(o / 100), "be1_breakpos": o % 100})
    rows = rows.withColumn("be2_breakpos", F.when(F.col("dr_count") % 2 == 0, o % 100).otherwise(o % 100 + 7))
    return callset.cascaded(rows, "uuid")


@query("""x1 AS (SELECT contig, mapq % 3 = 0 AS unmapped, id, s FROM reads), x2 AS (SELECT contig, unmapped, count(*) AS n FROM x1 GROUP BY contig, unmapped),
x3 AS (SELECT x1.*, n, sum(1) OVER (PARTITION BY contig) AS total, row_number() OVER (PARTITION BY contig, unmapped ORDER BY md5('1:' || id), id) AS k FROM x1 JOIN x2 USING (contig, unmapped))
SELECT contig, unmapped, id, s FROM x3 WHERE k <= CASE WHEN total > 500 THEN floor(n / total::DOUBLE * 500) ELSE n END""")
def proportional_reads(spark, sf_dir):
    reads = adapters.reads(spark, sf_dir).select("contig", (F.col("mapq") % 3 == 0).alias("unmapped"), "id", "s")
    return quotas.proportional_subsample(reads, "contig", "unmapped", 500, "id")


@query("""x1 AS (SELECT id, substr(seq, 1, 20) AS l, translate(md5((id // 4)::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGN') AS o, seq FROM alns),
x2 AS (SELECT id, l, substr(o, 1, 5) || substr(seq, (6 + id % 3 - 1)::INT, 9) || substr(o, 15, 6) AS r FROM x1),
x3 AS (SELECT id, l, r, 9 + unnest([0, 1, -1, 0, -1, 1, 0]) AS p, 9 + unnest([0, 1, -1, -1, 0, 0, 1]) AS q, unnest(range(7)) AS k FROM x2),
x4 AS (SELECT *, coalesce(list_min(list_filter(range(0, 21), lambda i: i > p OR i > q OR l[(p - i + 1)::INT] <> r[(q - i + 1)::INT])), 21) AS back,
  coalesce(list_min(list_filter(range(0, 21), lambda i: p + i >= len(l) OR q + i >= len(r) OR l[(p + i + 1)::INT] <> r[(q + i + 1)::INT])), 21) AS fwd FROM x3),
x5 AS (SELECT id, k, CASE WHEN back > 0 AND fwd > 0 AND back < 100 AND fwd < 100 THEN substr(l, (p - back + 2)::INT, (back + fwd - 1)::INT) ELSE '' END AS t FROM x4),
x6 AS (SELECT id, arg_max(t, len(t) * 10 - k) AS t FROM x5 GROUP BY id) SELECT id, CASE WHEN t = '' THEN 'NA' ELSE t END AS tsd FROM x6""")
def longest_duplications(spark, sf_dir):
    s, other = F.col("seq"), F.translate(F.md5(F.floor(F.col("id") / 4).cast("string")), "0123456789abcdef", "ACGTACGTACGTACGN")
    right = F.concat(F.substring(other, 1, 5), F.substring(s, (F.col("id") % 3 + 5).cast("int"), F.lit(9)), F.substring(other, 15, 6))
    rows = adapters.alignments(spark, sf_dir).select("id", F.substring(s, 1, 20).alias("l"), right.alias("r"))
    return rows.select("id", seqs.longest_duplication(F.col("l"), F.col("r"), F.lit(9), F.lit(9)).alias("tsd"))


def forest_sql(trees: int = 100, rows_per_tree: int = 256, sample: int = 8192, seed: int = 42) -> str:
    """The isolation forests of lineitem by return flag in SQL: trees are tables of places, a level after the other."""
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    names = [f"f{i}" for i in range(len(features))]
    cols = ", ".join(f"coalesce({c}::DOUBLE, 0.0) AS f{i}" for i, c in enumerate(features))
    lists = lambda of: "[" + ", ".join(f"{of}({c})" for c in names) + "]"
    drawn = lambda k: f"('0x' || substr(md5('{seed}:' || t || ':' || place || ':{k}'), 1, 13))::BIGINT / {16**13}.0::DOUBLE"
    depth_of = lambda n: f"CASE WHEN {n} < 2 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE 2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1) / {n}::DOUBLE END"
    value = "CASE f WHEN " + " WHEN ".join(f"{i} THEN f{i}" for i in range(len(names))) + " END"
    levels = rows_per_tree.bit_length() - 1
    out = [
        f"r AS (SELECT row_number() OVER () AS rid, l_returnflag AS g, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_linenumber > 1 AS train, l_quantity > 49 AS known, ('0x' || substr(md5(concat_ws(':', {seed}, l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 15))::BIGINT AS h, {cols} FROM lineitem)",
        f"share AS (SELECT g, least(1000000, floor(1e6 * {sample} / count(*)) + 1) AS share FROM r WHERE train GROUP BY g)",
        "chosen AS (SELECT r.* FROM r JOIN share USING (g) WHERE train AND h % 1000000 < share)",
        f"dealt AS (SELECT g, t, {', '.join(names)}, row_number() OVER (PARTITION BY g, t ORDER BY substr(md5(t || ':' || h), 1, 15), {', '.join(names)}) AS k FROM chosen, range({trees}) AS n(t))",
        f"m0 AS (SELECT g, t, 1 AS place, {', '.join(names)} FROM dealt WHERE k <= {rows_per_tree})",
        f"sizes AS (SELECT g, least({rows_per_tree}, count(*)) AS n FROM chosen GROUP BY g)",
    ]
    for d in range(levels + 1):
        out.append(f"a{d} AS (SELECT g, t, place, count(*) AS n, {lists('min')} AS lo, {lists('max')} AS hi FROM m{d} GROUP BY g, t, place)")
        out.append(f"w{d} AS (SELECT a{d}.*, list_filter(range({len(names)}), lambda i: hi[i + 1] > lo[i + 1]) AS wide, {d} < ceil(log2(greatest(2, s.n))) AS more FROM a{d} JOIN sizes s USING (g))")
        out.append(f"n{d} AS (SELECT g, t, place, n, more AND len(wide) > 0 AS inner_node, wide[(1 + floor({drawn(0)} * len(wide)))::INT] AS f, {drawn(1)} AS u, lo, hi FROM w{d})")
        out.append(f"c{d} AS (SELECT g, t, place, CASE WHEN inner_node THEN f ELSE -1 END AS f, lo[(f + 1)::INT] + u * (hi[(f + 1)::INT] - lo[(f + 1)::INT]) AS cut, {d} + {depth_of('n')} AS path FROM n{d})")
        out.append(f"m{d + 1} AS (SELECT g, t, 2 * place + CASE WHEN {value} <= cut THEN 0 ELSE 1 END AS place, {', '.join(names)} FROM m{d} JOIN c{d} USING (g, t, place) WHERE f >= 0)")
    keys = "rid, g, l_orderkey, l_partkey, l_suppkey, l_linenumber"
    out.append(f"p0 AS (SELECT {keys}, known, t, 1 AS place, {', '.join(names)} FROM r JOIN sizes USING (g), range({trees}) AS n(t))")
    for d in range(levels + 1):
        out.append(f"e{d} AS (SELECT p{d}.*, f, cut, path FROM p{d} JOIN c{d} USING (g, t, place))")
        out.append(f"p{d + 1} AS (SELECT {keys}, known, t, 2 * place + CASE WHEN {value} <= cut THEN 0 ELSE 1 END AS place, {', '.join(names)} FROM e{d} WHERE f >= 0)")
    ended = " UNION ALL ".join(f"SELECT {keys}, known, path FROM e{d} WHERE f < 0" for d in range(levels + 1))
    out.append(f"scored AS (SELECT {keys}, known, pow(2.0, -avg(path) / (SELECT {depth_of('n')} FROM sizes WHERE sizes.g = x.g)) AS score FROM ({ended}) x GROUP BY {keys}, known)")
    return f"WITH {', '.join(out)} SELECT g AS l_returnflag, l_orderkey, l_partkey, l_suppkey, l_linenumber, round(score, 6) AS score, CASE WHEN score > 0.5 AND NOT known THEN -1 ELSE 1 END AS pred FROM scored"


SQL["isolation_scores"] = forest_sql()
