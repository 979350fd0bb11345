"""Operators against plain Python where SQL can't say it, and what earlier versions got wrong."""

import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import bpe, fingerprint, host_reputation, langid, minhash, stream_dedup, warc
from tests.llm.test_operators import brute_components

SIGN = 1 << 63


def signed(x: int) -> int:
    return (x + SIGN) % (1 << 64) - SIGN


def hash_longs(values, seed=42) -> int:
    for v in values:
        seed = xxhash.xxh64_intdigest((v % (1 << 64)).to_bytes(8, "little"), seed)
    return signed(seed)


def plain_fingerprint(text: str, size: int) -> list[int]:
    words = [signed(xxhash.xxh64_intdigest(w, 42)) for w in text.encode().split()]
    if not words:
        return []
    hashes = {hash_longs(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}
    least: dict[int, int] = {}
    for h in sorted(hashes):
        least.setdefault((h % (1 << 64)) >> (64 - fingerprint.BIN_BITS), h)
    out = []
    for k in range(fingerprint.BINS):
        if k in least:
            out.append(least[k] & 255)
        else:  # the filled bin that comes first in this bin's own order of bins
            order = min((hash_longs([k, b]) & ~255 | h & 255) for b, h in least.items())
            out.append(order & 255)
    return out


def test_fingerprints_are_plain_binning_and_densification(spark):
    texts = {1: "a b c d e f g h", 2: "one two", 5: "", 7: " ".join(f"w{i % 50}" for i in range(400)), 9: " ".join(f"w{i}" for i in range(900)), 12: "é ü \x1fx  y\t\nz a b"}
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    order = sorted(texts)

    def like(a, b):
        if not a or not b:
            return float(a == b)
        same = sum(x == y for x, y in zip(a, b, strict=True)) / fingerprint.BINS
        return min(1.0, max(0.0, (same - 1 / 256) / (1 - 1 / 256)))

    for k, i in enumerate(order):
        t, after = texts[i], texts[order[(k + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, new, following = (plain_fingerprint(x, 5) for x in (t, edited, after))
        assert got[i].fingerprint == bytes(own).hex() and got[i].edited_fingerprint == bytes(new).hex()
        assert got[i].near_edited == pytest.approx(like(own, new)) and got[i].near_next == pytest.approx(like(own, following))


def test_fingerprint_likeness_follows_overlap(spark):
    r = np.random.default_rng(1)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(40):
        a = list(r.choice(words, 600))
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(a[: 300 + 7 * i] + list(r.choice(words, 300 - 7 * i))))]
    got = {x.doc_id: x.near_next for x in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(596)} for i, t in rows}
    off = [got[2 * i] - len(sets[2 * i] & sets[2 * i + 1]) / len(sets[2 * i] | sets[2 * i + 1]) for i in range(40)]
    assert abs(np.mean(off)) < 0.03 and np.max(np.abs(off)) < 0.2


def test_digest_collisions_are_told_apart_by_bytes(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["a", "A", "b", "c", None, "", "b", "dd", "c", "e"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    for docs in (spark.read.parquet(str(tmp_path / "docs")), spark.createDataFrame(rows, "doc_id long, text string")):
        plain = sorted(map(tuple, stream_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
        forced = stream_dedup.exact_dedup(docs, digest=lambda norm: F.substring(stream_dedup.sha256(norm), 1, 0))
        assert sorted(map(tuple, forced.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == plain
        assert [r[1] for r in plain] == [1, 1, 6, 8, 5, 5, 6, 7, 8, 9]
    files = {r.locator.file for r in stream_dedup.exact_dedup(spark.read.parquet(str(tmp_path / "docs"))).collect()}
    assert all("/docs/" in f for f in files)


def test_only_letters_are_letters(spark):
    docs = [(1, "² ½"), (2, "① Ⅷ 5"), (3, "word"), (4, "слово"), (5, None), (6, "_ 9")]
    learn = [(10, "some words in one tongue " * 9, "en"), (11, "какие то слова " * 9, "ru")] * 3
    out = langid.identify(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(learn, "doc_id long, text string, lang string"), steps=30)
    assert {r.doc_id for r in out.collect() if r.lang_pred == "und"} == {1, 2, 5, 6}


def test_windows_read_as_whole_texts():
    net = langid.ByteNetwork(3, 2, 1)
    r = np.random.default_rng(0)
    texts = [bytes(r.integers(97, 103, n, dtype=np.uint8)) for n in (0, 1, 40, 63, 64, 65, 500)]
    got = net.pooled(texts, 128, 7, 24)
    for x, p in zip(texts, got, strict=True):
        whole = np.exp(net.log_scores(net.states(np.frombuffer(x, np.uint8).astype(np.int64)[None])[0])).mean((0, 1)) if x else np.zeros(2)
        assert np.abs(p - whole).max() < 0.02


def test_ids_stay_whole_beside_nulls(spark):
    vocabulary = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    big = 2**53 + 1
    rows = [(None, "ab " * 900), (big, "cd " * 900), (big + 2, "ef " * 900), (None, "x")]
    got = bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), vocabulary, piece_chars=500).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in got) == sorted((str(i), t) for i, t in rows)


def test_hosts_with_ports_addresses_and_suffixes(spark):
    hosts = ["a.b.co.uk", "b.co.uk:8080", "co.uk", "user@x.example.com", "10.0.0.1:80", "10.0.0.1", "[::1]:8", "", "a.com.br", "x.pvt.k12.ma.us", "localhost"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    suffix, domain = host_reputation.suffix_and_domain(F.col("host"), host_reputation.SECOND_LEVELS)
    got = {r.host: (r.s, r.d) for r in df.select("host", suffix.alias("s"), domain.alias("d")).collect()}
    assert got["a.b.co.uk"] == got["b.co.uk:8080"] == ("co.uk", "b.co.uk") and got["user@x.example.com"] == ("com", "example.com")
    assert got["10.0.0.1:80"] == got["10.0.0.1"] == ("10.0.0.1", "10.0.0.1") and got["a.com.br"] == ("com.br", "a.com.br") and got["localhost"] == ("localhost", "localhost")
    listed = F.array(F.lit("k12.ma.us"), F.lit("us"), F.lit("pvt.k12.ma.us"))
    suffix, domain = host_reputation.suffix_and_domain(F.col("host"), host_reputation.SECOND_LEVELS, listed)
    assert tuple(df.where("host like 'x.pvt%'").select(suffix, domain).first()) == ("pvt.k12.ma.us", "x.pvt.k12.ma.us")


def test_pages_of_every_kind(spark):
    kind = "page_id long, url string, html string, host string, path string, id long, rule string, key string"
    rows = [(1, "http://a.com/x", "<p>", "clash", "c", 9, "r", "k")] * 2 + [(None, None, None, "h", "p", 1, "r", "k"), (3, "http://" + "a." * 30_000 + "com/en/" + "y" * 100_000, "z" * 200_000, "h", "p", 1, "r", "k")]
    rules = spark.createDataFrame([*host_reputation.RULES], "verdict string, host string, path string")
    outcomes = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "page_id long, good int")
    for n, pages in ((4, spark.createDataFrame(rows, kind)), (0, spark.createDataFrame([], kind))):
        assert host_reputation.judge_urls(pages, outcomes, rules).count() == n
        assert warc.through_archives(pages).count() == n


def test_pipeline_decides_on_rows(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    long_a, long_b = "one two three four five six seven eight nine ten " * 8, "red green blue pink grey teal cyan navy lime gold " * 8
    rows = [(5, long_a, "en", "a", 1), (5, long_b, "en", "a", 1), (2, long_a, "en", "a", 1), (None, long_b, "en", "b", 1), (None, "other words " * 9, "en", None, 1), (7, None, "en", "a", 0), (7, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, kind)
    got = sorted((str(r.doc_id), r.text or "") for r in corpus_pipeline.exact(spark, docs, "").collect())
    assert got == sorted([("5", long_a), ("5", long_b), ("None", "other words " * 9), ("7", "")])
    got = corpus_pipeline.near(spark, docs, "").collect()
    assert sorted((r.text or "") for r in got) == sorted([long_a, long_b, "other words " * 9, "", ""])
    assert {(str(r.doc_id), r.text) for r in got if r.text == long_b} == {("None", long_b)}
    taken = corpus_pipeline.mixed(spark, docs, "").collect()
    assert all(r.text for r in taken) and corpus_pipeline.mixed(spark, docs.limit(0), "").count() == 0
    for stage in (corpus_pipeline.language, corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.tokens):
        assert stage(spark, docs.limit(0), "").count() == 0


def test_near_dedup_recall_over_all_rows(spark):
    """Measured on the smallest tables: every link that brute force finds is found."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    texts = [r.text for r in docs.collect()]
    got = [r.component_id for r in minhash.near_dedup(docs).orderBy("doc_id").collect()]
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert got == [ids[k] for k in brute_components(texts, 5, 80)]


def test_likeness_of_equal_bits_is_one():
    assert math.isclose(minhash.estimate(np.zeros(90, np.uint8), np.zeros(90, np.uint8)), 1.0)
