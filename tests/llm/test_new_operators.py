"""Hard negatives, cross-tokenizer alignment and quality rules against brute force, with nulls, ties and repeats."""

import collections
import random

import numpy as np
import public_tokenizers
import pytest

from seqloom.llm import alignment, hard_negatives, quality

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_negatives(rows, anchor, positives=5, negatives=10):
    live = [(i, v, x) for i, v, x in rows if i is not None and v is not None and x is not None and None not in x]
    wide = max([len(x) for _, _, x in live], default=0)
    live = [(i, v, [*x, *[0] * (wide - len(x))]) for i, v, x in live]
    out = []
    for k, (i, v, x) in enumerate(live):
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j, w) for m, (j, w, y) in enumerate(live) if m != k)
        for p, j, _ in [s for s in scored if s[2] == v][:positives]:
            fit = [s for s in scored if s[2] != v and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
            out += [(i, j, r + 1, s[1], -p, -s[0]) for r, s in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("case", ["spread", "ties", "wide", "nulls"])
def test_hard_negatives(spark, case):
    rng = np.random.default_rng(5)
    n, d = 600, {"spread": 12, "ties": 2, "wide": 6, "nulls": 4}[case]
    middle = rng.integers(-60, 60, (9, d))
    x = middle[rng.integers(0, 9, n)] + rng.integers(-3, 4, (n, d)) * (0 if case == "ties" else 1)
    x = x * (1 << 22 if case == "wide" else 1)
    rows = [(int(i), int(v), y.tolist()) for i, v, y in zip(range(n), rng.integers(0, 4, n), x)]
    if case == "ties":  # repeated rows, and one vector for half of all
        rows = [(i, v, [30, 10] if i % 2 else y) for i, v, y in rows] + rows[:50]
    if case == "nulls":
        rows += [(None, 1, [1] * d), (700, None, [1] * d), (800, 1, None), (900, 1, [1, None, 2, 3]), (1000, 2, []), (1100, 3, [50, 2])]
    docs = spark.createDataFrame(rows, "vec_id long, label int, vec array<bigint>").withColumn("qid", hard_negatives.F.lit("clash"))
    out = hard_negatives.hard_negatives(docs, docs["vec_id"] % 50 == 0, sample=64, tree_rows=48, query_rows=4)
    assert sorted(map(tuple, out.collect())) == brute_negatives(rows, lambda i: i % 50 == 0)


def test_hard_negatives_empty(spark):
    docs = spark.createDataFrame([], "vec_id long, label int, vec array<bigint>")
    assert hard_negatives.hard_negatives(docs, docs["vec_id"] % 50 == 0).count() == 0


def test_cover_tree_covers():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(300, 5)), np.repeat(rng.normal(size=(1, 5)), 100, 0)])
    labels = rng.integers(0, 3, 400)
    order, nodes = hard_negatives.cover_tree(points, labels, leaf=8)
    assert sorted(order.tolist()) == list(range(400))

    def below(i):
        n = nodes[i]
        return [*range(n["own"], n["own_end"]), *(k for c in range(n["child"], n["child_end"]) for k in below(c))]

    for i, n in enumerate(nodes):
        at = order[below(i)]
        assert (np.linalg.norm(points[at] - points[order[n["centre"]]], axis=1) <= n["radius"]).all()
        assert n["low"] == labels[at].min() and n["high"] == labels[at].max()


TEXTS = [
    None, "", " ", "  ", "a", "a ", " a", "a  b", "the cat sat on the mat. The cat!", "\n", "\n a\t b \n\n", "▁", "a▁b", "<s> </s> <unk>", "<|endoftext|> x",
    "é\x00ü", " x  ", "日本語 テスト", "x" * 3000, "don't they're 'twas", "ﬁne ½ Ⅷ", "😀 👩‍👩‍👧 ok", "word " * 400, "a\x1c b\x85 c", "the cat", "the cat", "1234567 89",
]


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))}
    entry = {v: bytes(byte[c] for c in k) for k, v in tok.get_vocab().items() if v != 50256}
    piece = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for t in texts:
        a, b = (tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)) if t else ([], [])
        x, y = [entry[i] for i in a], [piece(i) for i in b]
        if not t or not b"".join(x) == b"".join(y) == (" " + t).encode():
            found.append(None)
            continue
        side = lambda parts: [k for k, p in enumerate(parts) for _ in p]
        links = [(a[i], b[j]) for i, j in dict.fromkeys(zip(side(x), side(y)))]  # tokens byte by byte
        ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
        common = sorted(set(ends(x)) & set(ends(y)))
        cut = lambda ids, stops, lo, hi: ",".join(str(i) for i, e in zip(ids, stops) if lo < e <= hi)
        groups = ";".join(f"{cut(a, ends(x), lo, hi)}|{cut(b, ends(y), lo, hi)}" for lo, hi in zip([0, *common], common))
        found.append((len(a), len(b), len(common), links, groups))
    count = collections.Counter(p for f in found if f for p in set(f[3]))
    top = {}
    for (i, _), n in count.items():
        top[i] = max(n, top.get(i, 0))
    return [(0,) * 6 + ("",) if f is None else (*f[:3], len(f[3]), sum(count[p] == top[p[0]] for p in f[3]), sum(count[p] for p in f[3]), f[4]) for f in found]


@pytest.mark.parametrize("table_pairs", [1 << 22, 20])
def test_alignment(spark, table_pairs):
    rows = [(i % 20 if i else None, t, "x") for i, t in enumerate(TEXTS)]  # null and repeated ids
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(5)
    out = alignment.align(docs, A, B, table_pairs=table_pairs)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, out.collect()), key=key) == sorted(((r[0], *w) for r, w in zip(rows, brute_alignment(TEXTS))), key=key)


def test_alignment_empty(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_units_forgotten():
    known = alignment.aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    small, large = alignment.Units(known, most_chars=10), alignment.Units(known)
    rng = random.Random(3)
    for _ in range(5):
        texts = [" ".join(rng.choice(["red", "blue.", "grün", "x1"]) for _ in range(9)) for _ in range(4)]
        got = [[u.groups[i] for i in u(texts)[0]] for u in (small, large)]
        assert got[0] == got[1]
    assert small.turn > large.turn


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = rng.choice(1 << 40, n, replace=False).astype(np.int64)
    bucket = alignment.bucket_of(keys)
    parts = [alignment.PerfectHash.bits_of(keys[bucket == b]) for b in range(alignment.BUCKETS)]
    plain = alignment.PerfectHash([p[0] for p in parts], np.concatenate([p[1] for p in parts]), np.empty(0))
    at = plain.slots(keys)
    assert sorted(at.tolist()) == list(range(n))
    placed = np.empty(n, np.int64)
    placed[at] = keys
    sure = alignment.PerfectHash([p[0] for p in parts], np.concatenate([p[1] for p in parts]), placed)
    others = keys + (1 << 41)
    assert (sure.slots(keys) == at).all() and (sure.slots(others) == -1).all()


def brute_repeats(words):
    five = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return len({i + k for i in range(len(words) - 4) if five[tuple(words[i : i + 5])] > 1 for k in range(5)})


def test_repeated_words():
    rng = random.Random(2)
    texts = [[bytes([rng.randrange(97, 100)]) for _ in range(rng.randrange(0, 60))] for _ in range(200)]
    assert quality.repeated_words(texts).tolist() == [brute_repeats(t) for t in texts]
    assert quality.repeated_words([]).tolist() == []


def test_clean_lines(spark):
    prose = "One two three four five six seven.\nEight nine ten eleven twelve."
    menu = "Home | News | Sport | Contact | About | Shop"
    rows = [
        (1, prose), (1, prose), (None, None), (2, ""), (3, "short text."), (4, prose + "\n" + menu), (5, menu + "\n" + " | ".join("abcdef") + "\na b c d e f g h."),
        (6, prose + "\nAll rights reserved."), (7, " \n" + prose + "\n" + "so " * 30), (8, "\n".join(["one two three."] * 9)), (9, prose + "\n x | y"), (10, "BUY!! NOW!! " * 40),
    ]
    got = {(r["doc_id"], k): r for k, r in enumerate(quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())}
    at = {r["doc_id"]: r for r in got.values()}
    assert len(got) == len(rows)
    assert at[1]["kept"] and at[1]["cleaned"] == prose and at[1]["n_lost"] == 0
    assert not at[None]["kept"] and at[None]["base_failed"] and at[2]["n_words"] == 0 and not at[3]["kept"]
    assert at[4]["kept"] and at[4]["cleaned"] == prose and at[4]["lost"] == {"navigation": 11} and at[4]["n_symbols"] == 5
    assert not at[5]["kept"] and not at[5]["base_failed"] and at[5]["n_dup_lines"] == 0
    assert at[6]["kept"] and at[6]["lost"] == {"boilerplate": 3}
    assert not at[7]["kept"] and at[7]["n_repeat_words"] == 30 and at[7]["lost"] == {"punctuation": 30}
    assert at[8]["base_failed"] and at[8]["n_dup_lines"] == 8 and at[8]["cleaned"] == "one two three."
    assert at[9]["kept"] and at[9]["word_chars"] == sum(map(len, (prose + "\n x | y").replace("\n", " ").split(" ")))
    assert not at[10]["kept"]
