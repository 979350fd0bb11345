"""The queries of this subpackage, one opN_<name> per operator, and SQL where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import alignment, bpe, fingerprint, hard_negatives, host_reputation, langid, minhash, mixing, pitman_yor, quality, stream_dedup, toxicity, warc
from seqloom.llm.common import crc_mod, table


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 10) == 0
    return pitman_yor.score_texts(table(spark, sf_dir, "documents"), ~held_out).withColumn("held_out", held_out)


def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict; labels.quality of the document with the page's id is its labelled outcome."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    rules = spark.createDataFrame([*host_reputation.RULES], "verdict string, host string, path string")
    return host_reputation.judge_urls(table(spark, sf_dir, "pages"), outcomes, rules).select("page_id", "host", "path", "rule", "verdict")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op4_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_archives(table(spark, sf_dir, "pages")).drop("payload")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0)
    out = toxicity.score_toxicity(table(spark, sf_dir, "documents"), labels)
    return out.withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 0)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("locator")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    return out.withColumn("held_out", crc_mod(F.col("doc_id"), 4) == 2)


def op10_bpe_tree(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components are finite or their row takes no part; a label moves on by one where the id is divisible by 7."""
    rows = table(spark, sf_dir, "embeddings").where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vec = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    return hard_negatives.hard_negatives(rows.select("vec_id", label.alias("label"), vec.alias("vec")), F.col("vec_id") % 100 == 0)


def op12_pair_alignment(spark: SparkSession, sf_dir: str, tokenizer_a: str | None = None, tokenizer_b: str | None = None) -> DataFrame:
    if tokenizer_a is None or tokenizer_b is None:
        import public_tokenizers

        tokenizer_a, tokenizer_b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    out = alignment.align(table(spark, sf_dir, "documents"), tokenizer_a, tokenizer_b)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)


def op13_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(table(spark, sf_dir, "documents")).drop("lost", "n_lost", "cleaned")


SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = r"""
WITH urls AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
good AS (SELECT doc_id, count(*) AS n, sum(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
parts AS (
  SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS good, regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':[0-9]*$', '') AS name
  FROM urls LEFT JOIN good ON page_id = doc_id GROUP BY host),
cut AS (SELECT *, string_split(name, '.') AS l, regexp_full_match(name, '[0-9]+(\.[0-9]+){3}|\[.*\]') AS address FROM parts),
two AS (
  SELECT *, CASE WHEN len(l) > 2 AND length(l[-1]) = 2 AND l[-2] IN ('ac', 'co', 'com', 'edu', 'go', 'gob', 'gov', 'mil', 'ne', 'net', 'nom', 'or', 'org', 'sch') THEN 2 ELSE 1 END AS k FROM cut),
hosts AS (
  SELECT host, n, good, CASE WHEN address THEN name ELSE array_to_string(l[-k:], '.') END AS suffix, CASE WHEN address THEN name ELSE array_to_string(l[-k-1:], '.') END AS domain FROM two),
s0 AS (
  SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT (sum(good) + 0.5) / (sum(n) + 1) FROM hosts) AS mu FROM hosts GROUP BY suffix),
s1 AS (SELECT sum(pow(good - n * mu, 2) - n * mu * (1 - mu)) / nullif(sum(n * (n - 1) * mu * (1 - mu)), 0) AS rho FROM s0),
s2 AS (SELECT CASE WHEN rho > 0 THEN least(1000, greatest(1, 1 / rho - 1)) ELSE 1000 END::DOUBLE AS s FROM s1),
suffixes AS (SELECT suffix, (good + s * mu) / (n + s) AS mean FROM s0, s2),
d0 AS (SELECT suffix, domain, sum(n) AS n, sum(good) AS good, any_value(mean) AS mu FROM hosts JOIN suffixes USING (suffix) GROUP BY suffix, domain),
d1 AS (SELECT sum(pow(good - n * mu, 2) - n * mu * (1 - mu)) / nullif(sum(n * (n - 1) * mu * (1 - mu)), 0) AS rho FROM d0),
d2 AS (SELECT CASE WHEN rho > 0 THEN least(1000, greatest(1, 1 / rho - 1)) ELSE 1000 END::DOUBLE AS s FROM d1),
domains AS (SELECT suffix, domain, (good + s * mu) / (n + s) AS mean FROM d0, d2),
h0 AS (SELECT host, n, good, mean AS mu FROM hosts JOIN domains USING (suffix, domain)),
h1 AS (SELECT sum(pow(good - n * mu, 2) - n * mu * (1 - mu)) / nullif(sum(n * (n - 1) * mu * (1 - mu)), 0) AS rho FROM h0),
h2 AS (SELECT CASE WHEN rho > 0 THEN least(1000, greatest(1, 1 / rho - 1)) ELSE 1000 END::DOUBLE AS s FROM h1),
h3 AS (SELECT host, n + s AS ns, (good + s * mu) / (n + s) AS mean FROM h0, h2),
bounds AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (ns + 1)) AS bound FROM h3),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fits AS (
  SELECT page_id, max({'n': length(rhost || rpath), 'rule': rhost || rpath, 'verdict': verdict}) AS best
  FROM urls JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN bound >= 0.75 THEN 'allow' ELSE 'block' END) AS verdict
FROM urls JOIN bounds USING (host) LEFT JOIN fits USING (page_id)
"""

OP3_SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({SQL_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS sh FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.seen = e.x)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(seen) AS component_id, d.doc_id = min(seen) AS kept
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY html)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (html)
"""

OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM sized GROUP BY source),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap FROM s),
o AS (
  SELECT *, cap / w <= (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped FROM c),
u AS (SELECT (sum(source_size) - coalesce(sum(cap) FILTER (capped), 0)) / nullif(sum(w) FILTER (NOT capped), 0) AS unit FROM o),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE coalesce(unit, 0) * w END::DOUBLE AS target FROM o, u),
k AS (SELECT *, least(3, floor(coalesce(target / nullif(source_size, 0), 0)))::BIGINT AS copies FROM t),
x AS (
  SELECT doc_id, size, source_size, target, copies, sum(size) OVER (PARTITION BY sized.source ORDER BY h) AS upto
  FROM sized JOIN k ON sized.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target, (size * (copies + CASE WHEN upto <= target - copies * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
"""

OP8_SQL = f"""
WITH n AS (SELECT doc_id, {SQL_LOWER} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, keep_id IS NULL) AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)
"""


OP11_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score, a.label = b.label AS same
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.ar, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank,
    s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

OP13_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS five FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
d AS (SELECT r, five FROM g GROUP BY r, five HAVING count(*) > 1),
p AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT g.r, unnest(range(i, i + 5)) AS p FROM g JOIN d ON g.r = d.r AND g.five = d.five) GROUP BY r),
l0 AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM t),
l1 AS (
  SELECT r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, row_number() OVER (PARTITION BY r, line ORDER BY k) AS again,
    len(regexp_extract_all(line, '[|»›·•→]')) AS links, len(regexp_extract_all(line, '[^\x20\x09-\x0D]*(?:[#*$%&<>]|[!?]{2})[^\x20\x09-\x0D]*')) AS noisy FROM l0),
l2 AS (
  SELECT r, n, again, regexp_matches(lower(line), '(STOCK)') OR (links >= 2 AND links * 4 >= n) OR noisy * 3 >= n
    OR (n >= 20 AND NOT regexp_matches(line, '[.!?…:;。！？；।؟۔]["''”’»)\]\x20\x09-\x0D]*$')) AS bad FROM l1 WHERE n > 0),
l AS (SELECT r, sum(CASE WHEN bad OR again > 1 THEN n ELSE 0 END) AS lost, sum(CASE WHEN again > 1 THEN 1 ELSE 0 END) AS dup FROM l2 GROUP BY r),
o AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost FROM w LEFT JOIN p USING (r) LEFT JOIN l USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost <= 50 * n_words AS kept FROM o
""".replace("STOCK", "|".join(re.escape(x) for x in quality.STOCK))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pitman_yor, op2_host_reputation, op3_near_dedup, op4_warc_chain, op5_fingerprints, op6_toxicity, op7_mix_sources, op8_stream_dedup, op9_language_id, op10_bpe_tree, op11_hard_negatives, op12_pair_alignment, op13_line_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op2_host_reputation": OP2_SQL, "op3_near_dedup": OP3_SQL, "op4_warc_chain": OP4_SQL, "op7_mix_sources": OP7_SQL, "op8_stream_dedup": OP8_SQL, "op11_hard_negatives": OP11_SQL, "op13_line_quality": OP13_SQL}
