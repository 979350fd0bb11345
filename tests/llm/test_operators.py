"""Operators on small tables with nulls, ties, repeated rows, long texts and clashing columns, and against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import bpe, components, fingerprint, host_reputation, langid, minhash, mixing, pitman_yor, stream_dedup, toxicity, warc
from seqloom.llm.common import shared_folder, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, key string, node string, size long"
LONG = " ".join(f"w{i % 977}" for i in range(20_000))
ROWS = [
    (1, "The cat sat on the mat", "en", "b"), (2, "the CAT sat on the mat", "en", "b"), (3, None, "en", None), (4, "", None, "a"),
    (5, "der Hund und die Katze", "de", "a"), (5, "der Hund und die Katze", "de", "a"), (6, LONG, "en", "c"), (7, "x", "de", "c"),
    (None, "the cat", "en", None), (8, "  \t\n ", "en", "a"), (9, "123 %%% 456", "de", "b"), (10, "ÄÖ äö " * 3, "de", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "clash", 2, "k", "x", 3) for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_no_operator_loses_or_adds_rows(docs, empty, vocabulary):
    labels = docs.select("doc_id", (F.length("text") % 2).alias("toxic"))
    for apply in (
        lambda d: pitman_yor.score_texts(d, F.lit(True)), minhash.near_dedup, fingerprint.fingerprints, mixing.mix_sources, stream_dedup.exact_dedup,
        lambda d: toxicity.score_toxicity(d, labels), lambda d: langid.identify(d, d, steps=5), lambda d: bpe.encode_decode(d, vocabulary, piece_chars=1000),
    ):
        out = apply(docs)
        assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r[0]) for r in ROWS)
        assert apply(empty).count() == 0


def test_exact_dedup(docs):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in stream_dedup.exact_dedup(docs).collect()}
    groups = collections.defaultdict(list)
    for i, text, *_ in ROWS:
        groups["".join(c.lower() if c.isascii() else c for c in text or "")].append(i)
    top = lambda g: max([i for i in g if i is not None], default=None)
    assert got == {(i, top(g), len(g), i == top(g)) for g in groups.values() for i in g}


def brute_components(texts, size, percent):
    def shingles(t):
        w = words_of(t)
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    top = lambda i: i if root[i] == i else top(root[i])
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(texts))]


def test_near_dedup_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 10)
    r = random.Random(1)
    texts = []
    for _ in range(12):
        base = [f"w{r.randrange(400)}" for _ in range(60)]
        for k in range(12):
            w = list(base)
            for _ in range(k):
                w[r.randrange(60)] = f"v{r.randrange(9999)}"
            texts.append(" ".join(w))
    out = minhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shingle=2).collect()
    assert [x.component_id for x in sorted(out, key=lambda x: x.doc_id)] == brute_components(texts, 2, 80)


def test_estimate_is_corrected_for_chance():
    r = np.random.default_rng(2)
    family = minhash.MinHash(60, 5)
    a = r.integers(0, 2**63, 500, dtype=np.uint64)
    for shared in (0, 250, 450):
        b = np.concatenate([a[:shared], r.integers(0, 2**63, 500 - shared, dtype=np.uint64)])
        x, y = (np.frombuffer(family.packed(family.minima(np.unique(s))), np.uint8) for s in (a, b))
        assert abs(minhash.estimate(x, y) - shared / (1000 - shared)) < 0.12


def test_components(spark):
    r = random.Random(3)
    links = [(bytes([i]), bytes([j])) for i, j in ((r.randrange(90), r.randrange(90)) for _ in range(60))] + [(bytes([100 + i]), bytes([101 + i])) for i in range(20)]
    root = {}
    top = lambda i: i if root.setdefault(i, i) == i else top(root[i])
    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    got = components.connected(spark.createDataFrame(links, "a binary, b binary"), shared_folder(spark), "t").collect()
    found = collections.defaultdict(set)
    for row in got:
        found[bytes(row.component)].add(bytes(row.node))
    want = collections.defaultdict(set)
    for i in {n for a, b in links if a != b for n in (a, b)}:
        want[top(i)].add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_mixing_by_a_plain_scan(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" * r.randrange(40)), r.choice(["a", "b", "c", "d", None])) for i in range(400)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    size = {i: len(t.split()) for i, t, _ in rows}
    names = ["a", "b", "c", "d", None]
    total, weight = sum(size.values()), {s: k % 3 + 1 for k, s in enumerate(names)}
    full = {s: sum(size[i] for i, _, x in rows if x == s) for s in names}
    target, free = {}, set(names)
    while True:
        unit = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > 3 * full[s]}
        if not over:
            break
        target |= {s: 3 * full[s] for s in over}
        free -= over
    target |= {s: unit * weight[s] for s in free}
    for s in names:
        mine = [x for x in got if x.source == s]
        assert abs(mine[0].target - target[s]) < 1e-6
        assert target[s] - 40 <= sum(x.taken for x in mine) <= target[s]
        assert all(x.size == size[x.doc_id] and x.taken <= 3 * x.size for x in mine)


def test_archives_reject_magic_inside_payloads(spark):
    trap = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/\r\nx", trap * 40), (2, None, "b" * 2000), (3, "u", "b" * 2000), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (None, "u", trap)]
    got = warc.through_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, _, html in rows:
        assert by[i].payload_digest == hashlib.sha1((html or "").encode()).hexdigest() and by[i].payload_bytes == len(html or "")
    assert (by[2].record_type, by[2].refers_to, by[2].payload) == ("revisit", 3, None)
    assert by[1].payload == trap * 40 and by[5].record_type == by[6].record_type == "response"


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://A.example.com/en/71?x"), (2, "http://a.example.com/en/8"), (3, None), (4, "no scheme"), (5, "x://de.example.net/de/8/y#z"), (6, "x://h")], "page_id long, url string")
    outcomes = spark.createDataFrame([(1, 1), (2, 0), (6, None)], "page_id long, good int")
    rules = spark.createDataFrame([*host_reputation.RULES], "verdict string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in host_reputation.judge_urls(pages, outcomes, rules).collect()}
    assert got == {1: ("a.example.com", "/en/71", "example.com/en/7"), 2: ("a.example.com", "/en/8", "com/en/"), 3: ("", "", None), 4: ("", "", None), 5: ("de.example.net", "/de/8/y", "example.net/de/8"), 6: ("h", "", None)}


def test_reputation_shrinks_to_the_domain(spark):
    hosts = [("big.bad.com", 200, 20), ("new.bad.com", 0, 0), ("one.good.org", 1, 0)] + [(f"h{i}.good.org", 50, 48) for i in range(8)]
    rows = [(h, ".".join(h.split(".")[1:]), h.split(".")[-1], n, g) for h, n, g in hosts]
    df = spark.createDataFrame(rows, "host string, domain string, suffix string, n long, good long")
    mean = {r.host: r["mean"] for r in host_reputation.host_posteriors(df, 1.645).collect()}
    assert mean["big.bad.com"] < 0.2 and mean["new.bad.com"] < 0.5 < mean["one.good.org"] and mean["h1.good.org"] > 0.9


def test_fingerprints_by_hand(spark):
    texts = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, ""), (4, "one two"), (9, None)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    order = [t or "" for _, t in texts]
    for k, (i, _) in enumerate(texts):
        t, after = order[k], order[(k + 1) % len(order)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[1].fingerprint == got[2].fingerprint and len(got[1].fingerprint) == 256 and got[1].near_next == 1.0
    assert got[3].fingerprint == "" and got[3].near_next == 0.0 and got[3].near_edited == 1.0


def test_bpe_is_the_tokenizers_library(spark, vocabulary):
    from tokenizers import Tokenizer

    t, enc = Tokenizer.from_file(vocabulary), bpe.encoding(open(vocabulary, encoding="utf-8").read())
    r = random.Random(7)
    parts = ["a", "the", " ", "  ", "\n", "'s", "1", "é", "字", "😀", "<|endoftext|>", "<|end", "\t", ".", "　", "ing", "́"]
    for _ in range(300):
        x = "".join(r.choice(r.sample(parts, 5)) for _ in range(r.choice([5, 60, 300])))
        ids = t.encode(x, add_special_tokens=False).ids
        assert bpe.encoded(enc, x).tolist() == ids and bpe.decoded(enc, np.array(ids)) == t.decode(ids, skip_special_tokens=False)
        level = [(p, bpe.encoded(enc, p)) for p in bpe.halves(x, max(1, len(x) // 5))]
        while len(level) > 1:
            level = [(level[k][0] + level[k + 1][0], bpe.joined(enc, *level[k], *level[k + 1])) for k in range(0, len(level), 2)]
        assert level[0][1].tolist() == ids
    rows = [(1, "ab" * 5000), (1, "ab" * 5000), (2, LONG)]
    for x in bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary, piece_chars=700).collect():
        assert np.frombuffer(x.ids, "<u4").tolist() == t.encode(dict(rows)[x.doc_id], add_special_tokens=False).ids and x.decoded == dict(rows)[x.doc_id]


def test_network_gradients_and_reading():
    net = langid.ByteNetwork(3, 2, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    text = np.random.default_rng(0).integers(97, 103, (4, 6))
    text[0, 4:] = langid.PAD
    label = np.array([0, 1, 1, 0])
    g, _ = net.gradients(text, label)
    for k, at in (("x", (1, 98, 4)), ("u", (0, 1, 2)), ("out", (2, 1)), ("bias", (0,))):
        net.p[k][at] += 1e-3
        up = net.gradients(text, label)[1]
        net.p[k][at] -= 2e-3
        down = net.gradients(text, label)[1]
        net.p[k][at] += 1e-3
        assert abs(g[k][at] - (up - down) / 2e-3) < 1e-5
    p = np.exp(net.log_scores(net.states(text)[0])) * (text.T != langid.PAD)[..., None]
    assert np.abs(p.sum(0) - net.position_sums(text)).max() < 1e-4


def test_language_and_toxicity_on_held_out_documents(spark):
    from seqloom.llm import queries

    data = "/root/testdata/sf0.01"
    langs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    held = queries.op9_language_id(spark, data).where("held_out").join(langs, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "toxic")
    held = queries.op6_toxicity(spark, data).where("held_out").join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 for r in held) and np.mean([r.predicted == r.toxic for r in held]) > 0.93
