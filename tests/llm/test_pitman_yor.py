"""The hierarchical Pitman-Yor operator against plain seating, a plain Gibbs sampler, and as a distribution."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm import pitman_yor as py
from seqloom.llm.common import words_of


def corpus():
    r = random.Random(5)
    return [(i, " ".join(r.choice("the of a b c d e".split()) + str(r.randrange(3)) for _ in range(30))) for i in range(60)]


def test_words_are_those_of_the_contract():
    texts = ["a b", None, "", " \t A  b\n", "x" * 3_000_000 + " a", "\xa0 \x1f b", "ab", "ba", "a", "ÄB äb"]
    keys, n = py.tokens_of(py.Words(), pa.array(texts, pa.string()))
    want = [[*words_of(t), b""] for t in texts]
    assert n.tolist() == [len(w) for w in want]
    seen = {}
    for k, w in zip(keys.tolist(), (x for w in want for x in w), strict=True):
        assert seen.setdefault(w, k) == k
    assert len(set(seen.values())) == len(seen)
    sliced = py.tokens_of(py.Words(), pa.array(texts, pa.string()).slice(3, 3))[0]
    assert sliced.tolist() == keys[sum(n[:3]) : sum(n[:6])].tolist()


@pytest.mark.parametrize("part_tokens", [py.PART_TOKENS, 100])
def test_base_and_counts_are_exact_however_dealt(spark, part_tokens):
    rows = corpus()
    got = py.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 50, part_tokens=part_tokens, block_tokens=500, rounds=1)
    got = {x.doc_id: x for x in got.collect()}
    c = collections.Counter(w for i, t in rows if i < 50 for w in [*t.split(), None])
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        want = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*t.split(), None])
        assert abs(got[i].base_score - want) < 1e-6 and (got[i].train_tokens, got[i].n_tokens, got[i].n_known) == (n, 31, 31)


def weighted_tables(n, d, rest, p, r):
    """Tables of customers seated one by one, and the log of all their steps' sums of weights."""
    t, w = 1, 0.0
    for i in range(1, n):
        fresh = (py.CONCENTRATION + d * (rest + t)) * p
        z = i - d * t + fresh
        w += math.log(z)
        t += r.random() < fresh / z
    return t, w


def exact_weights(d, n, widest):
    """log weight of n customers at 1..widest tables by the recurrence, nothing else."""
    w = np.full(widest + 1, -np.inf)
    w[1] = 0
    t = np.arange(widest + 1)
    for i in range(1, n):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = w + np.log(np.maximum(i - d * t, 0))
            w[1:] = np.logaddexp(w[:-1], stay[1:])
        w[0] = -np.inf
    return w[1:]


@pytest.mark.parametrize(("n", "rest", "p"), [(2, 3.0, 0.3), (10, 30.0, 0.02), (100, 30.0, 0.02), (100, 5000.0, 0.3), (1000, 200.0, 0.1), (10_000, 30.0, 0.02), (10_000, 3000.0, 0.05), (10_000, 20_000.0, 0.1)])
def test_seating_at_every_size(n, rest, p, d=0.7, draws=3000):
    widest = min(n, 4000)
    k = np.arange(1, widest + 1)
    x = exact_weights(d, n, widest) + np.cumsum(np.log(1 + d * (rest + k - 1))) + k * math.log(p)
    x = np.exp(x - x.max())
    x /= x.sum()
    mean = (x * k).sum()
    spread = math.sqrt((x * k * k).sum() - mean**2)
    got = py.seated(np.full(draws, n), d, np.full(draws, rest), np.full(draws, p), np.random.default_rng(6))
    assert abs(got.mean() - mean) < 5 * spread / math.sqrt(draws) + 0.002 * mean
    assert got.std() == pytest.approx(spread, rel=0.12, abs=0.02) and got.min() >= 1 and got.max() <= n


def test_plain_seating_has_these_weights():
    """A few customers seated in all ways."""
    d, n = 0.7, 6
    ways = collections.Counter()

    def seat(sizes, weight):
        if sum(sizes) == n:
            ways[len(sizes)] += weight
            return
        for i, m in enumerate(sizes):
            seat((*sizes[:i], m + 1, *sizes[i + 1 :]), weight * (m - d))
        seat((*sizes, 1), weight)

    seat((1,), 1.0)
    got = np.exp(exact_weights(d, n, n))
    assert got == pytest.approx([ways[t] for t in range(1, n + 1)])
    assert py.seating_weights(d)[0][n, 1 : n + 1] + math.lgamma(n) == pytest.approx(np.log(got))


class Plain:
    """Customer by customer Gibbs sampling of the same model, all seating explicit."""

    def __init__(self, d, v, seed):
        self.d, self.v, self.r, self.seats = d, v, random.Random(seed), collections.defaultdict(lambda: collections.defaultdict(list))

    def p(self, u, w):
        if u is None:
            return 1 / (self.v + 1)
        room, d = self.seats[u], self.d[len(u)]
        c, t = sum(map(sum, room.values())), sum(map(len, room.values()))
        own = room.get(w, ())
        return (sum(own) - d * len(own) + (1 + d * t) * self.p(u[1:] if u else None, w)) / (1 + c)

    def add(self, u, w):
        if u is None:
            return
        room, d, up = self.seats[u], self.d[len(u)], u[1:] if u else None
        tables = room[w]
        weights = [n - d for n in tables] + [(1 + d * sum(map(len, room.values()))) * self.p(up, w)]
        k = self.r.choices(range(len(weights)), weights)[0]
        if k == len(tables):
            tables.append(1)
            self.add(up, w)
        else:
            tables[k] += 1

    def remove(self, u, w):
        if u is None:
            return
        tables = self.seats[u][w]
        k = self.r.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            tables.pop(k)
            self.remove(u[1:] if u else None, w)


def test_scores_are_those_of_a_plain_sampler(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(["a", "b", "c", "d"], [4, 2, 1, 1], k=12))) for i in range(30)]
    got = {x.doc_id: x.score for x in py.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 20, rounds=7, burn=1, sweeps=4).collect()}
    texts = [[None, None, *t.split(), None] for _, t in rows]
    triples = lambda t: [((t[i - 2], t[i - 1]), t[i]) for i in range(2, len(t))]
    train = [x for t in texts[:20] for x in triples(t)]
    once = lambda c: py.discount(sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values()))
    types = collections.Counter(train)
    doubles = collections.Counter((u[1], w) for u, w in types)
    words = collections.Counter(w for _, w in doubles)
    m = Plain([once(words), once(doubles), once(types)], len(words), 4)
    for u, w in train:
        m.add(u, w)
    total = collections.Counter()
    for sweep in range(60):
        for u, w in train:
            m.remove(u, w)
            m.add(u, w)
        if sweep >= 10:
            for k, t in enumerate(texts):
                for i, (u, w) in enumerate(triples(t)):
                    total[k, i] += m.p(u, w) / 50
    for k, t in enumerate(texts):
        want = sum(math.log10(total[k, i]) for i in range(len(t) - 2))
        assert abs(got[k] - want) < 0.03 * abs(want) + 0.05, (k, got[k], want)


def test_few_own_words_beside_common_ones(spark):
    rows = [(i, "the cat sat on the mat " * 3 + ("rare" if i == 7 else "")) for i in range(8)] + [(None, None), (9, "")]
    got = py.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True), rounds=2).collect()
    assert len(got) == len(rows) and {r.doc_id: r.n_tokens for r in got}[7] == 20 and all(r.score < 0 for r in got)


@pytest.mark.parametrize("docs", [True, False])
def test_probabilities_after_a_context_add_up_to_one(docs):
    texts = ["a b c", "a b d", "a b c", "b c d d"] + [f"a b {w}" for w in ("a", "b", "c", "d", "new")] + ["a b"]
    train = [True] * 4 + [False] * 6
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(texts), pa.array(train)], names=["id", "text", "train"])
    deal, keys = py.Deal(1, *[np.zeros(0, np.uint64)] * 3), py.tokens_of(py.Words(), pa.array(["a b"]))[0]
    rows = []
    import seqloom.llm.pitman_yor as module

    class Context:
        partitionId = staticmethod(lambda: 0)
        get = classmethod(lambda cls: cls)

    before, module.TaskContext = module.TaskContext, Context
    try:
        rows = list(py.dealt(deal, 10**6, docs)(iter([batch])))
    finally:
        module.TaskContext = before
    part = py.Part(pa.Table.from_batches(rows), deal)
    x = part.totals(*part.start().values())
    v = float((np.bincount(part.w, part.c, len(part.words)) > 0).sum())
    rule = py.Rule(0.6, 0.5, 0.4, v, float(part.c.sum()), float(x["root"].sum()), v)
    p0 = rule.root(x["root"], np.minimum(x["root"], 1))
    p = part.predictive(*part.start().values(), rule, p0, (np.zeros(0), np.zeros(0)), (np.zeros(0), np.zeros(0)))
    a, b = (int(np.flatnonzero(part.words == k)[0]) for k in keys[:2])
    assert p[(part.u == a) & (part.v == b)].sum() == pytest.approx(1)  # of the four words, the end and the one unknown
