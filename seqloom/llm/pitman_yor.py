"""LM scoring by a hierarchical Pitman-Yor model of word triples (operator 1).

The word after each pair of words is a dish of that pair's restaurant; all pairs that end in one word share its
restaurant as parent, all of these the root, whose base is uniform over the known words and one unknown. There is
a restaurant for every pair and word of the corpus.

Tokens are dealt into parts by their middle word v: the restaurants of v and of all pairs (u, v) then lie in one
part, and only totals go between parts, those of words at the root and those of split restaurants. A word so
frequent that it would fill a part is split over several by the following word. What a part sends is packed: a
row holds many tokens, words as numbers in a list of that row's.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import LOWER_TABLE, delete, drop_shuffles, exists, saved, shared_folder

CONCENTRATION = 1.0
#: Tokens of a block of texts (a task's unit of work before the shuffle) and of a part (its unit after it).
BLOCK_TOKENS, PART_TOKENS = 1_500_000, 1_500_000
#: Words that all tasks know by their rank; the others travel with their keys. A block reports half as many.
COMMON = 1 << 17
#: Customers and tables up to which the weights of seatings are laid out, and the steps of a walk beyond these tables.
EXACT, METROPOLIS = 1000, 25
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Key of the end token, also the words before a text's first.
END = np.uint64(0x5EED)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWERED = np.frombuffer(LOWER_TABLE, np.uint8)
BYTE_KEYS = mixed(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
STEP = np.uint64(0xD6E8FEB86659FD93)


class Words:
    """64-bit keys of words: polynomials in an odd STEP over keys of the lower-cased bytes, mixed with the length.

    A chunk's prefix sums give all its words at once: the difference of two sums, divided by STEP to the start.
    """

    def __init__(self):
        self.grow(CHUNK)

    def grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, STEP)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, np.uint64(pow(int(STEP), -1, 2**64)))]), dtype=np.uint64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys of all words in order, words of each text) of texts data[offsets[i]:offsets[i + 1]]."""
        out, starts = [], []
        at, end = int(offsets[0]), int(offsets[-1])
        borders = np.unique(offsets)
        while at < end:
            to = min(end, at + CHUNK)
            if to < end:  # cut between words or texts, however long a word is
                space = np.flatnonzero(SPACE[data[at:to]])
                last = borders[np.searchsorted(borders, to, "right") - 1]
                cut = max(int(space[-1]) + 1 + at if len(space) else at, int(last))
                if cut <= at:
                    later = np.flatnonzero(SPACE[data[to:end]])
                    cut = min(int(later[0]) + to if len(later) else end, int(borders[np.searchsorted(borders, to)]))
                to = cut
            part = data[at:to]
            word = ~SPACE[part]
            inner = borders[(borders > at) & (borders < to)] - at
            begins, ends = word.copy(), word.copy()
            begins[1:] &= ~word[:-1]
            begins[inner] = word[inner]
            ends[:-1] &= ~word[1:]
            ends[inner - 1] = word[inner - 1]
            a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            if len(part) >= len(self.up):
                self.grow(len(part))
            with np.errstate(over="ignore"):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_KEYS[LOWERED[part]] * self.up[: len(part)], dtype=np.uint64)])
                out.append(mixed((sums[b] - sums[a]) * self.down[a] + (b - a).astype(np.uint64) * GOLDEN))
            starts.append(a + at)
            at = to
        keys, starts = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((out, np.uint64), (starts, np.int64)))
        return keys, np.diff(np.searchsorted(starts, offsets))


def tokens_of(words: Words, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(keys of words and ends, tokens of each text); null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] and offsets[-1] else np.zeros(0, np.uint8)
    keys, n = words(data, offsets)
    out = np.full(len(keys) + len(n), END)
    out[np.arange(len(keys)) + np.repeat(np.arange(len(n)), n)] = keys
    return out, n + 1


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(keys, tokens of each text, whether it is learned from, ids) of blocks of a task's texts, each text in one."""
    words, held, size = Words(), [], 0
    join = lambda: (*(np.concatenate([h[i] for h in held]) for i in range(3)), pa.concat_arrays([h[3] for h in held]))
    for batch in batches:
        for i in range(0, len(batch), 200):
            part = batch.slice(i, 200)
            keys, n = tokens_of(words, part["text"])
            held.append((keys, n, part["train"].to_numpy(zero_copy_only=False).astype(bool), part["id"]))
            size += len(keys)
            if size >= most:
                yield join()
                held, size = [], 0
    if held:
        yield join()


class Deal(NamedTuple):
    """How tokens are dealt: number of parts, the words that are split (sorted) and into how many, and the most frequent
    words (at most COMMON, by rank), which need no key on the way."""

    parts: int
    hot: np.ndarray
    splits: np.ndarray
    common: np.ndarray

    def ranks(self, words: np.ndarray) -> np.ndarray:
        """Ranks of words, -1 for those that are not common."""
        if not len(self.common):
            return np.full(len(words), -1)
        order = np.argsort(self.common)
        at = order[np.minimum(np.searchsorted(self.common, words, sorter=order), len(order) - 1)]
        return np.where(self.common[at] == words, at, -1)

    def of(self, words: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Parts of tokens whose middle and last words are words[v] and words[w]."""
        with np.errstate(over="ignore"):
            h, n = mixed(words), self.splits_of(words)
            return ((h[v] + h[w] % n[v] if len(self.hot) else h[v]) % np.uint64(self.parts)).astype(np.int32)

    def splits_of(self, v: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.ones(len(v), np.uint64)
        at = np.minimum(np.searchsorted(self.hot, v), len(self.hot) - 1)
        return np.where(self.hot[at] == v, self.splits[at], np.uint64(1))


def small(x: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs, byte planes one after the other, compressed."""
    n = 1 + (int(x.max()).bit_length() - 1) // 8 if len(x) and x.max() else 1
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T)
    return bytes([n]) + len(x).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unsmall(b: bytes) -> np.ndarray:
    n, size = b[0], int.from_bytes(b[1:9], "little")
    out = np.zeros((size, 8), np.uint8)
    out[:, :n] = np.frombuffer(pa.decompress(b[9:], n * size, "zstd", asbytes=True), np.uint8).reshape(n, size).T
    return out.view("<u8").reshape(-1).astype(np.int64)


def frequent_words(rows: DataFrame, parts: int, block_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, reported counts) of the most frequent words, at most COMMON or those that may take much of a part.

    A block reports its most frequent words: COMMON / 2 of them, and all that are over 1 / (8 * parts) of it; so a
    word of over 1 / (4 * parts) of the corpus is reported with at least half of its count.
    """

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, _, _ in blocks(batches, block_tokens):
            coded = pa.array(keys).dictionary_encode()
            found, counts = coded.dictionary.to_numpy(), np.bincount(coded.indices.to_numpy())
            least = np.partition(counts, -COMMON // 2)[-COMMON // 2] if len(counts) > COMMON // 2 else 0
            many = (counts > max(1, least)) | (counts > len(keys) / (8 * parts))
            yield pa.RecordBatch.from_arrays([pa.array(found[many].view(np.int64)), pa.array(counts[many])], names=["w", "n"])

    got = rows.mapInArrow(report, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    got = got.orderBy(F.desc("n"), "w").limit(max(COMMON, 8 * parts)).toArrow()
    return got["w"].to_numpy().view(np.uint64), got["n"].to_numpy()


ASKED = ["part", "block", "words", "v", "u", "w", "train", "counts", "docs", "each", "ids", "sizes"]
ASKED_SCHEMA = "part int, block long, " + ", ".join(f"{x} binary" for x in ASKED[2:])


def stream(ids: pa.Array) -> bytes:
    """Ids of any type as bytes, in Arrow's own format."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, pa.schema([("id", ids.type)])) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays([ids], names=["id"]))
    return out.getvalue().to_pybytes()


def dealt(deal: Deal, block_tokens: int, with_docs: bool):
    """mapInArrow function: a row per block and part. Without docs the distinct triples of the block's tokens in order,
    with how often they are learned from; with docs the tokens in their order, which of them are learned from, the texts
    they are of and how many of each, and in the block's first row its ids and sizes. Words are ranks of common ones, or from
    the number of these on places in the row's own list of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        for keys, n, train, ids in blocks(batches, block_tokens):
            coded = pa.array(keys).dictionary_encode()
            w, found = coded.indices.to_numpy(), coded.dictionary.to_numpy()
            end = int(np.flatnonzero(found == END)[0])
            v = np.concatenate([np.int32([end]), w[:-1]])
            u = np.concatenate([np.int32([end]), v[:-1]])
            u[v == end] = end
            part = deal.of(found, v, w)
            doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
            order = np.argsort(part, kind="stable").astype(np.int32)
            edges = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=deal.parts))])
            number, rows = deal.ranks(found), []
            rare = number < 0
            for p in np.flatnonzero(np.diff(edges)):
                at = order[edges[p] : edges[p + 1]]
                triple = [x[at] for x in (v, u, w)]
                own = np.unique(np.concatenate([x[rare[x]] for x in triple]))
                number[own] = len(deal.common) + np.arange(len(own))
                row = [int(p), block, found[own].tobytes()]
                if with_docs:
                    docs, each = np.unique(doc[at], return_counts=True)
                    row += [*(small(number[x]) for x in triple), np.packbits(train[doc[at]]).tobytes(), None, small(np.diff(docs, prepend=0)), small(each), *((None, None) if rows else (stream(ids), small(n)))]
                else:
                    a, b, c = (number[x].astype(np.uint64) for x in triple)
                    code = np.sort(a << np.uint64(43) | b << np.uint64(22) | c << np.uint64(1) | train[doc[at]].astype(np.uint64))
                    first = np.flatnonzero(np.concatenate([[True], code[1:] >> np.uint64(1) != code[:-1] >> np.uint64(1)]))
                    counts, code = np.add.reduceat((code & np.uint64(1)).astype(np.int64), first), code[first]
                    a, b, c = code >> np.uint64(43), code >> np.uint64(22) & np.uint64(2**21 - 1), code >> np.uint64(1) & np.uint64(2**21 - 1)
                    row += [small(np.diff(a, prepend=np.uint64(0))), small(b), small(c), None, small(counts), *[None] * 4]
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int64(), *[pa.binary()] * 10], strict=True)], names=ASKED)
            block += 1

    return run


class Part:
    """All that a part's tokens (rows of dealt()) say: words, types of triples and doubles, restaurants.

    Words are in the order of their keys and types in that of (v, u, w), so that the same tokens, however they were
    dealt to rows, always give the same numbering: what rounds of sampling know goes by place.
    """

    def __init__(self, rows: pa.Table, deal: Deal):
        lists = [np.frombuffer(x, np.uint64) for x in rows["words"].to_pylist()]
        n, below = len(deal.common), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        own, place = np.unique(np.concatenate(lists), return_inverse=True)
        sorted_v = rows["counts"].null_count == 0
        each = lambda c: [unsmall(x) for x in rows[c].to_pylist()]
        triple = [[np.cumsum(x) for x in each("v")] if sorted_v else each("v"), each("u"), each("w")]
        sizes = [len(x) for x in triple[0]]
        triple = [np.concatenate([np.where(x < n, x, n + place[np.clip(x - n + b, 0, len(place) - 1)]) if len(place) else x for x, b in zip(of, below, strict=False)]) for of in triple]
        met = np.zeros(n + len(own), bool)
        for x in triple:
            met[x] = True
        met, keys = np.flatnonzero(met), np.concatenate([deal.common, own])
        met = met[np.argsort(keys[met])]
        number = np.zeros(n + len(own), np.int64)
        number[met], self.words = np.arange(len(met)), keys[met]
        v, u, w = (number[x] for x in triple)
        if sorted_v:
            learned = np.concatenate(each("counts"))
        else:
            learned = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=m) for x, m in zip(rows["train"].to_pylist(), sizes, strict=True)])
        k = len(self.words)
        if k**3 < 2**63:
            code, self.type = np.unique((v * k + u) * k + w, return_inverse=True)
            pair, self.w = np.divmod(code, k)
        else:
            pairs, of = np.unique(v * k + u, return_inverse=True)
            code, self.type = np.unique(of * k + w, return_inverse=True)
            pair, self.w = np.divmod(code, k)
            pair = pairs[pair]
        self.v, self.u = np.divmod(pair, k)
        self.token_word = w
        self.c = np.bincount(self.type, learned, len(code)).astype(np.int64)
        self.r3 = np.cumsum(np.concatenate([[0], (np.diff(pair) != 0)]))[: len(code)]
        self.pairs = int(self.r3[-1]) + 1 if len(code) else 0
        doubles, self.b = np.unique(self.v * k + self.w, return_inverse=True)
        self.bv, self.bw = np.divmod(doubles, k)
        self.n2 = np.bincount(self.b, self.c, len(doubles)).astype(np.int64)
        self.many3, self.many2 = np.flatnonzero(self.c > 1), np.flatnonzero(self.n2 > 1)
        self.c3 = np.bincount(self.r3, self.c, self.pairs)
        # restaurants that other parts have dishes of as well: v, and its pairs
        split = deal.splits_of(self.words) > 1
        self.split2 = np.flatnonzero(split & (np.bincount(self.v, minlength=k) > 0))
        first = np.flatnonzero(np.diff(self.r3, prepend=-1))
        self.split3 = np.flatnonzero(split[self.v[first]])
        at = first[self.split3]
        with np.errstate(over="ignore"):
            keys = np.concatenate([mixed(self.words[self.split2] + GOLDEN), mixed(mixed(self.words[self.u[at]]) + self.words[self.v[at]] * STEP)])
        self.context_order = np.argsort(keys, kind="stable")
        self.context_keys = keys[self.context_order]

    def start(self) -> dict[str, np.ndarray]:
        """One table for every dish."""
        return {"t3": np.ones(len(self.many3), np.int64), "t2": np.ones(len(self.many2), np.int64)}

    def totals(self, t3: np.ndarray, t2: np.ndarray) -> dict[str, np.ndarray]:
        """Tables of triples, customers and tables of doubles, and their sums by restaurant and word."""
        tables3 = np.minimum(self.c, 1)
        tables3[self.many3] = t3
        customers2 = np.bincount(self.b, tables3, len(self.bv)).astype(np.int64)
        tables2 = np.minimum(customers2, 1)
        tables2[self.many2] = t2
        k = len(self.words)
        return {
            "tables3": tables3, "customers2": customers2, "tables2": tables2, "T3": np.bincount(self.r3, tables3, self.pairs),
            "C2": np.bincount(self.bv, customers2, k), "T2": np.bincount(self.bv, tables2, k), "root": np.bincount(self.bw, tables2, k),
        }

    def sent(self, x: dict[str, np.ndarray]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(kind, keys, customers, tables) that other parts share: words at the root (0), split restaurants (1)."""
        c = np.concatenate([x["C2"][self.split2], self.c3[self.split3]])[self.context_order]
        t = np.concatenate([x["T2"][self.split2], x["T3"][self.split3]])[self.context_order]
        counts = np.bincount(self.w, self.c, len(self.words))
        return [(0, self.words, counts.astype(np.int64), x["root"].astype(np.int64)), (1, self.context_keys, c.astype(np.int64), t.astype(np.int64))]

    def contexts(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What sent() has put in order for kind 1, again for split2 and split3."""
        out = np.empty(len(values))
        out[self.context_order] = values
        return out[: len(self.split2)], out[len(self.split2) :]

    def predictive(self, t3: np.ndarray, t2: np.ndarray, rule: Rule, p0: np.ndarray, customers: tuple, tables: tuple) -> np.ndarray:
        """Probability of every triple's last word after its first two, given one sample of tables, the words'
        probabilities at the root, and the customers and tables of split restaurants (of words, of pairs)."""
        x, c3 = self.totals(t3, t2), self.c3.astype(float)
        for whole, at, value in ((x["C2"], self.split2, customers[0]), (x["T2"], self.split2, tables[0]), (c3, self.split3, customers[1]), (x["T3"], self.split3, tables[1])):
            whole[at] = value
        p2 = (x["customers2"] - rule.d2 * x["tables2"] + (CONCENTRATION + rule.d2 * x["T2"][self.bv]) * p0[self.bw]) / (CONCENTRATION + x["C2"][self.bv])
        return (self.c - rule.d3 * x["tables3"] + (CONCENTRATION + rule.d3 * x["T3"][self.r3]) * p2[self.b]) / (CONCENTRATION + c3[self.r3])


class Rule(NamedTuple):
    """Discounts by level, words, training tokens, and of the root its customers and tables."""

    d3: float
    d2: float
    d0: float
    v: float
    n: float
    customers: float
    tables: float

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        base = (CONCENTRATION + self.d0 * self.tables) / (self.v + 1)
        return (customers - self.d0 * tables + base) / (CONCENTRATION + self.customers)


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0, by Stirling's series at x + 8."""
    y = x + 8
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3)
    for i in range(8):
        out -= np.log(x + i)
    return out


@functools.lru_cache(8)
def seating_weights(d: float, most: int = EXACT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log of the weight of all seatings of n customers at t tables, each table of m worth (1 - d)...(m - 1 - d), less
    lgamma(n): [n, t] up to `most` of either by the recurrence, and rows for larger n at steps of 0.02 of log n.

    With weights over gamma(n), one customer more gives w(n + 1, t) = w(n, t - 1) / n + (1 - d * t / n) * w(n, t). For
    large n that is a differential equation in log n, whose steps here are far below its error at n = most.
    """
    out, t = np.full((most + 1, most + 1), -np.inf), np.arange(most + 1)
    out[1, 1] = 0
    with np.errstate(divide="ignore", invalid="ignore"):
        for n in range(1, most):
            stay = out[n] + np.log(np.maximum(1 - d * t / n, 0))
            out[n + 1, 1:] = np.logaddexp(out[n, :-1] - math.log(n), stay[1:])
        at, row = math.log(most), out[most].copy()
        logs, rows, step = [at], [row.copy()], 0.00125

        def slope(x, log_n):
            up = np.zeros(most + 1)
            up[2:] = np.exp(x[1:-1] - x[2:])
            n = math.exp(log_n)
            return n * np.log1p(np.maximum((up - d * t) / n, -0.999))

        row[0] = 0
        for k in range(1, 11_201):  # to 14 in log n beyond most, a million times as many; above, what changes is far below 1e-6
            a = slope(row, at)
            b = slope(row + step / 2 * a, at + step / 2)
            row, at = row + step * b, at + step
            row[0] = 0
            if k % 16 == 0:
                logs.append(at)
                rows.append(row.copy())
    rows = np.array(rows)
    rows[:, 0] = -np.inf
    return out, np.array(logs), rows


def many_tables(n: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The same log weight for many tables, by the saddle point of its generating function
    n! / t! [x**n] ((1 - (1 - x)**d) / d)**t."""
    low, high = np.full(len(n), -600.0), np.full(len(n), -1e-12)
    mean = lambda log_q: t * d * np.exp((d - 1) * log_q) * -np.expm1(log_q) / -np.expm1(d * log_q)
    for _ in range(70):
        mid = (low + high) / 2
        more = mean(mid) > n
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    log_q = (low + high) / 2
    x, h = -np.expm1(log_q), 1e-5
    up, down = (np.log1p(-np.minimum(x * math.exp(e), 1 - 1e-15)) for e in (h, -h))
    spread = np.maximum((mean(up) - mean(down)) / (2 * h), 1e-300)
    return np.log(n) - lgamma(t + 1) - t * math.log(d) + t * np.log(-np.expm1(d * log_q)) - n * np.log(x) - 0.5 * np.log(2 * np.pi * spread)


def seated(n: np.ndarray, d: float, rest: np.ndarray, p: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """Tables of dishes given their customers, their restaurants' other tables and their parent probabilities: a draw
    from the posterior, in which t tables have the weight of all seatings times prod (concentration + d * (rest + k))
    times p**t.

    The distribution is laid out over 4, 16, 64, then EXACT tables, until its tail is below 1e-13 of its top (it
    falls on from there). Where even EXACT tables do not hold it, Metropolis steps around its top draw from it.
    """
    t, log_p = np.minimum(n, 1).astype(np.int64), np.log(np.maximum(p, 1e-300))
    left = np.flatnonzero(n > 1)
    if not len(left):
        return t
    exact, logs, rows = seating_weights(d)
    for width in (4, 16, 64, EXACT):
        now, wait = (left, left[:0]) if width >= 16 else (left[n[left] <= width], left[n[left] > width])
        failed = [wait]
        for lo in range(0, len(now), max(1, 400_000 // width)):
            at = now[lo : lo + max(1, 400_000 // width)]
            x = np.log(CONCENTRATION + d * (rest[at, None] + np.arange(width)))
            np.cumsum(x, axis=1, out=x)
            x += log_p[at, None] * np.arange(1, width + 1)
            few = n[at] <= EXACT
            x[few] += exact[n[at[few]], 1 : width + 1]
            if not few.all():
                k = (np.log(n[at[~few]]) - logs[0]) / (logs[1] - logs[0])
                i = np.minimum(k.astype(np.int64), len(logs) - 2)
                share = np.minimum(k - i, 1.0)[:, None]
                x[~few] += (1 - share) * rows[i, 1 : width + 1] + share * rows[i + 1, 1 : width + 1]
            top = x.max(1, keepdims=True)
            whole = (n[at] <= width) | (x[:, -1] < top[:, 0] - 30)
            x -= top
            np.exp(x, out=x)
            np.cumsum(x, axis=1, out=x)
            t[at] = 1 + (x < (r.random(len(at)) * x[:, -1])[:, None]).sum(1)
            failed.append(at[~whole])
        left = np.sort(np.concatenate(failed))
    if len(left):
        t[left] = walked(n[left].astype(float), d, rest[left], log_p[left], r)
    return t


def walked(n: np.ndarray, d: float, rest: np.ndarray, log_p: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """seated() for dishes of many tables: a search for the top, then METROPOLIS steps of about one deviation."""
    a = CONCENTRATION / d + rest
    weight = lambda t: many_tables(n, t, d) + t * math.log(d) + lgamma(a + t) - lgamma(a) + t * log_p
    low, high = np.ones(len(n)), n - 1
    for _ in range(60):
        x, y = low + (high - low) * 0.382, low + (high - low) * 0.618
        left = weight(x) > weight(y)
        low, high = np.where(left, low, x), np.where(left, y, high)
    t = np.clip(np.rint((low + high) / 2), 1, n - 1)
    now, deviation = weight(t), np.sqrt(np.maximum(1.0, np.minimum(t, n - t)))
    for _ in range(METROPOLIS):
        new = t + np.rint(r.normal(size=len(t)) * deviation)
        inside = (new >= 1) & (new <= n - 1)
        then = np.where(inside, weight(np.clip(new, 1, n - 1)), -np.inf)
        take = np.log(r.random(len(t)) + 1e-300) < then - now
        t, now = np.where(take, new, t), np.where(take, then, now)
    return t.astype(np.int64)


#: A part's fixed numbers of sampling: see Still.
STILL = ["c", "r3", "b3", "T3", "B", "bv", "bw", "C2", "T2", "W", "split2", "split3", "order", "C3"]
STILL_COLUMNS = [f"still_{x}" for x in STILL]


class Still:
    """What a part's sampling needs besides tables: its triples and doubles of more than one occurrence, the
    restaurants and words they belong to, and the sums of all others, which keep their one table."""

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @staticmethod
    def of(p: Part) -> Still:
        k = len(p.words)
        place = np.full(len(p.bv), -1)
        place[p.many2] = np.arange(len(p.many2))
        once3, once2 = p.c == 1, p.n2 == 1
        return Still(
            c=p.c[p.many3], r3=p.r3[p.many3], b3=place[p.b[p.many3]], T3=np.bincount(p.r3, once3, p.pairs).astype(np.int64),
            B=np.bincount(p.b, once3, len(p.bv)).astype(np.int64)[p.many2], bv=p.bv[p.many2], bw=p.bw[p.many2],
            C2=np.bincount(p.bv, once2, k).astype(np.int64), T2=np.bincount(p.bv, once2, k).astype(np.int64), W=np.bincount(p.bw, once2, k).astype(np.int64),
            split2=p.split2, split3=p.split3, order=p.context_order, C3=p.c3[p.split3].astype(np.int64))

    def packed(self) -> list[bytes]:
        return [small(getattr(self, name)) for name in STILL]

    @staticmethod
    def unpacked(row: dict[str, bytes]) -> Still:
        return Still(**{name: unsmall(row[column]) for name, column in zip(STILL, STILL_COLUMNS, strict=True)})

    def totals(self, t3: np.ndarray, t2: np.ndarray) -> dict[str, np.ndarray]:
        b = self.B + np.bincount(self.b3, t3, len(self.B)).astype(np.int64)
        n = len(self.W)
        return {
            "B": b, "T3": self.T3 + np.bincount(self.r3, t3, len(self.T3)), "C2": self.C2 + np.bincount(self.bv, b, n),
            "T2": self.T2 + np.bincount(self.bv, t2, n), "root": self.W + np.bincount(self.bw, t2, n),
        }

    def shared(self, x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of split restaurants in the order of their keys."""
        c, t = np.concatenate([x["C2"][self.split2], self.C3]), np.concatenate([x["T2"][self.split2], x["T3"][self.split3]])
        return c[self.order], t[self.order]

    def sweep(self, t3, t2, sweeps: int, rule: Rule, p0: np.ndarray, others: tuple[np.ndarray, np.ndarray], r: np.random.Generator):
        """Gibbs sweeps: every dish's tables are drawn given those of all others, triples before doubles.

        In a restaurant the first four dishes are drawn one after the other, the many after them at once, given
        the tables that each of them had. others: customers and tables that other parts have of split restaurants.
        """
        far_c, far_t = (np.empty(len(x)) for x in others)
        far_c[self.order], far_t[self.order] = others
        n2 = len(self.split2)
        turns = [[np.flatnonzero(np.minimum(self._rank(x), 4) == i) for i in range(5)] for x in (self.r3, self.bv)]
        for _ in range(sweeps):
            x = self.totals(t3, t2)
            c2, tables2, tables3 = x["C2"].astype(float), x["T2"].astype(float), x["T3"].astype(float)
            c2[self.split2] += far_c[:n2]
            tables2[self.split2] += far_t[:n2]
            tables3[self.split3] += far_t[n2:]
            p2 = (x["B"] - rule.d2 * t2 + (CONCENTRATION + rule.d2 * tables2[self.bv]) * p0[self.bw]) / (CONCENTRATION + c2[self.bv])
            t3, t2 = t3.copy(), t2.copy()
            for at in turns[0]:
                new = seated(self.c[at], rule.d3, tables3[self.r3[at]] - t3[at], p2[self.b3[at]], r)
                tables3 += np.bincount(self.r3[at], new - t3[at], len(tables3))
                t3[at] = new
            b = self.B + np.bincount(self.b3, t3, len(self.B)).astype(np.int64)
            for at in turns[1]:
                new = seated(b[at], rule.d2, tables2[self.bv[at]] - t2[at], p0[self.bw[at]], r)
                tables2 += np.bincount(self.bv[at], new - t2[at], len(tables2))
                t2[at] = new
        return t3, t2

    @staticmethod
    def _rank(of: np.ndarray) -> np.ndarray:
        """How many of the same number come before (of is sorted)."""
        first = np.flatnonzero(np.diff(of, prepend=-1))
        return np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))


SENT = ["part", "kind", "bucket", "keys", "c", "t"]
SENT_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
SENT_SCHEMA = "part int, kind int, bucket long, keys binary, c binary, t binary"
STATE_SCHEMA = SENT_SCHEMA + ", t3 binary, t2 binary, stats array<double>, " + ", ".join(f"{x} binary" for x in ["keys_0", "keys_1", *STILL_COLUMNS])


def slices(part: int, kind: int, keys: np.ndarray, c: np.ndarray | None, t: np.ndarray, bits: int) -> list[tuple]:
    """Rows of SENT: what a part sends, cut by the highest bits of its sorted keys."""
    edges = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.int64)
    edges = np.append(edges, len(keys))
    return [(part, kind, b, keys[i:j].tobytes(), None if c is None else small(c[i:j]), small(t[i:j])) for b, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if j > i]


def rows_of(columns: list[list], names: list[str], types: list) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def state_rows(part: int, sent: list[tuple], t3: np.ndarray, t2: np.ndarray, stats: list[float] | None, still: list[bytes] | None) -> pa.Table:
    """A part's rows of STATE_SCHEMA: what it sends, then (kind -1) its tables and, the first time, its fixed numbers."""
    fixed = 2 + len(STILL)
    rows = [(*s, None, None, None, *[None] * fixed) for s in sent]
    rows.append((part, -1, 0, None, None, None, small(t3), small(t2), stats, *(still or [None] * fixed)))
    names = [*SENT, "t3", "t2", "stats", "keys_0", "keys_1", *STILL_COLUMNS]
    return rows_of([list(c) for c in zip(*rows, strict=True)], names, [*SENT_TYPES, pa.binary(), pa.binary(), pa.list_(pa.float64()), *[pa.binary()] * fixed])


def summed(sent: DataFrame, rule: Rule | None, seed: int) -> DataFrame:
    """part, kind, bucket, n, a, b: sums over all parts of what each of them has sent, in its own order: of words
    (kind 0) training tokens (only if sent), customers and tables at the root; of split restaurants customers and tables.
    Rows of part -1 have the root's numbers: words, tokens, customers, tables, words of one and of two customers."""

    def add(group: pa.Table) -> pa.Table:
        kind, bucket = group["kind"][0].as_py(), group["bucket"][0].as_py()
        keys = [np.frombuffer(x, np.uint64) for x in group["keys"].to_pylist()]
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = lambda c: np.bincount(at, np.concatenate([unsmall(x) for x in group[c].to_pylist()]), len(found)).astype(np.int64)
        n = total("c") if group["c"].null_count == 0 else None
        t, stats = total("t"), None
        a, b = (n, t) if kind else (t, np.minimum(t, 1))
        if not kind:
            if rule is not None:
                parent = np.full(len(t), 1 / (rule.v + 1))
                b = seated(t, rule.d0, np.full(len(t), max(0.0, rule.tables - 1)), parent, np.random.default_rng([seed, bucket]))
            stats = [float(x) for x in ((n > 0).sum() if n is not None else 0, n.sum() if n is not None else 0, t.sum(), b.sum(), (t == 1).sum(), (t == 2).sum())]
        edges = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
        rows = [(p, kind, bucket, small(n[w]) if n is not None and not kind else None, small(a[w]), small(b[w]), None) for p, w in zip(group["part"].to_pylist(), (at[i:j] for i, j in zip(edges, edges[1:], strict=False)), strict=True)]
        rows.append((-1, kind, bucket, None, None, None, stats))
        return rows_of([list(c) for c in zip(*rows, strict=True)], SUMMED, SUMMED_TYPES)

    return sent.where("kind >= 0").select(SENT).groupBy("kind", "bucket").applyInArrow(add, SUMMED_SCHEMA)


SUMMED = ["part", "kind", "bucket", "n", "a", "b", "stats"]
SUMMED_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64())]
SUMMED_SCHEMA = "part int, kind int, bucket long, n binary, a binary, b binary, stats array<double>"


def answers(rows: pa.Table, kind: int, column: str) -> np.ndarray:
    """A part's sums of a kind, in the order of its keys."""
    got = sorted((r for r in rows.select(["kind", "bucket", column]).to_pylist() if r["kind"] == kind and r[column] is not None), key=lambda r: r["bucket"])
    return np.concatenate([np.zeros(0, np.int64), *(unsmall(r[column]) for r in got)])


def totals_of(df: DataFrame, n: int) -> list[float]:
    got = df.where("stats is not null").agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(n)]).first()
    return [float(x) for x in got]


def discount(once: float, twice: float) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


#: A part's sums by text of a block: which texts, their sums, and in one of the block's rows its ids and sizes.
TEXT_SUMS = ["block", "docs", "score", "base", "known", "ids", "sizes"]


def settled(rows: DataFrame, folder: str) -> DataFrame:
    """rows, written once if they come out of a shuffle: a task that is run again then meets the same rows in order."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return saved(rows, folder, "texts") if "Exchange" in plan else rows


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, sweeps: int = 2, burn: int = 1, seed: int = 1, block_tokens: int = BLOCK_TOKENS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """One row per input row: id, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Tokens are the words of the text (A-Z lower-cased, parted by x20 and x09-x0D) and one end. The model and the base
    learn from all rows where `train` holds. Seating starts from one table a dish; in each of `rounds` rounds every
    part runs `sweeps` sweeps of Gibbs sampling over the tables that it had, then all parts' totals are summed, so that
    each round ends in one consistent sample. The predictive probabilities of the samples after the first `burn`
    are averaged token by token; score is the sum of their log10 over the text, perplexity 10 ** (-score / n_tokens).
    A part sees the root and its split restaurants as they were when its round began, apart from its own tables.

    Texts are read three times: for words that may have to be split, for the types of all parts, and for scoring,
    where each token is scored in its part, and a part's sums by text go back to the text's block, packed: a row
    for each block and part, then one per text. Words are known by 64-bit keys.

    Null and empty texts have the end as their only token. Repeated rows and null ids each give a row. Without
    training rows every token is unknown to a model of nothing (probability 1 of the one unknown word). An
    empty table gives no rows; other columns are ignored.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    kind = dict(rows.dtypes)["id"]
    rows = settled(rows, folder)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, math.ceil(chars / 6 / part_tokens))
    common, counts = frequent_words(rows, parts, block_tokens)
    hot = sorted(zip(common.tolist(), counts.tolist(), strict=True)) if parts > 1 else []
    hot = [(w, math.ceil(2 * n / part_tokens)) for w, n in hot if n > part_tokens // 2]
    deal = Deal(parts, np.array([w for w, _ in hot], np.uint64), np.array([n for _, n in hot], np.uint64), common[:COMMON])
    bits = math.ceil(math.log2(parts))

    def first(group: pa.Table) -> pa.Table:
        number, p = group["part"][0].as_py(), Part(group, deal)
        x = p.totals(*p.start().values())
        sent = [s for kind, keys, c, t in p.sent(x) for s in slices(number, kind, keys, c, t, bits)]
        stats = [float((p.c == 1).sum()), float((p.c == 2).sum()), float((x["customers2"] == 1).sum()), float((x["customers2"] == 2).sum())]
        return state_rows(number, sent, *p.start().values(), stats, [p.words.tobytes(), p.context_keys.tobytes(), *Still.of(p).packed()])

    def held(result: DataFrame, r: int) -> tuple[DataFrame, DataFrame]:
        """(parts' own rows, sums over all parts) of a round; what the parts sent goes once it is summed."""
        result.withColumn("sent", F.col("kind") >= 0).write.mode("overwrite").option("compression", "zstd").partitionBy("sent").parquet(f"{folder}/round{r}")
        empty = spark.createDataFrame([], STATE_SCHEMA)
        del result  # else its shuffles can't go
        drop_shuffles(spark)
        table = lambda sent: spark.read.schema(STATE_SCHEMA).parquet(f"{folder}/round{r}/sent={sent}")
        own, sent = (table(x) if exists(spark, f"{folder}/round{r}/sent={x}") else empty for x in ("false", "true"))
        sums = saved(summed(sent, rules[-1] if r else None, seed + r), folder, f"sums{r}")
        delete(spark, f"{folder}/round{r}/sent=true")
        drop_shuffles(spark)
        return own, sums

    rules: list[Rule] = []
    state, total = held(rows.mapInArrow(dealt(deal, block_tokens, False), ASKED_SCHEMA).groupBy("part").applyInArrow(first, STATE_SCHEMA), 0)
    still = state.where("kind = -1").select("part", "keys_0", "keys_1", *STILL_COLUMNS)
    sums = [total]
    n31, n32, n21, n22 = totals_of(state.where("kind = -1"), 4)
    v, n, customers, tables, once, twice = totals_of(sums[0], 6)
    rule = Rule(discount(n31, n32), discount(n21, n22), discount(once, twice), v, n, customers, tables)
    states = [state]
    rules.append(rule)

    def round_of(r: int, rule: Rule):
        def sampled(own: pa.Table, got: pa.Table) -> pa.Table:
            row = own.filter(pc.is_valid(own["still_c"])).slice(0, 1).to_pylist()[0]
            tables = own.filter(pc.is_valid(own["t3"])).slice(0, 1).to_pylist()[0]
            s, t3, t2 = Still.unpacked(row), unsmall(tables["t3"]), unsmall(tables["t2"])
            c, t = s.shared(s.totals(t3, t2))
            others = answers(got, 1, "a") - c, answers(got, 1, "b") - t
            p0 = rule.root(answers(got, 0, "a"), answers(got, 0, "b"))
            t3, t2 = s.sweep(t3, t2, sweeps, rule, p0, others, np.random.default_rng([seed, r, row["part"]]))
            x = s.totals(t3, t2)
            c, t = s.shared(x)
            sent = slices(row["part"], 0, np.frombuffer(row["keys_0"], np.uint64), None, x["root"], bits)
            sent += slices(row["part"], 1, np.frombuffer(row["keys_1"], np.uint64), c.astype(np.int64), t.astype(np.int64), bits)
            return state_rows(row["part"], sent, t3, t2, None, None)

        return sampled

    nothing = lambda *names: [F.lit(None).cast("binary").alias(x) for x in names]
    for r in range(1, rounds + 1):
        own = still.select("*", *nothing("t3", "t2"))
        own = own.unionByName(states[-1].where("kind = -1").select("part", *nothing("keys_0", "keys_1", *STILL_COLUMNS), "t3", "t2"))
        told = sums[-1].where("part >= 0").select("part", "kind", "bucket", "a", "b")
        state, total = held(own.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(round_of(r, rule), STATE_SCHEMA), r)
        states.append(state)
        sums.append(total)
        _, _, customers, tables, _, _ = totals_of(sums[-1], 6)
        rule = rule._replace(customers=customers, tables=tables)
        rules.append(rule)
    kept = range(min(burn, rounds - 1) + 1, rounds + 1)
    for r in range(rounds + 1):  # what scoring does not read goes before it begins
        if r not in kept:
            delete(spark, f"{folder}/round{r}")
        if r and r not in kept:
            delete(spark, f"{folder}/sums{r}")

    def scored(asked: pa.Table, known: pa.Table) -> pa.Table:
        p, out = Part(asked, deal), None
        for r in kept:
            got, rule = known.filter(pc.equal(known["round"], r)), rules[r]
            tables = got.filter(pc.is_valid(got["t3"])).to_pylist()[0]
            split = p.contexts(answers(got, 1, "a")), p.contexts(answers(got, 1, "b"))
            p3 = p.predictive(unsmall(tables["t3"]), unsmall(tables["t2"]), rule, rule.root(answers(got, 0, "a"), answers(got, 0, "b")), *split)
            out = p3 if out is None else out + p3
        log_p = np.log10(out / len(kept))[p.type]
        count = answers(known.filter(pc.equal(known["round"], 0)), 0, "n")
        base = np.log10((count + 0.1) / (rules[0].n + 0.1 * (rules[0].v + 1)))[p.token_word]
        seen = (count > 0)[p.token_word]
        rows, at = [], 0
        for block, docs, counts, ids, sizes in zip(*(asked[c].to_pylist() for c in ("block", "docs", "each", "ids", "sizes")), strict=True):
            counts = unsmall(counts)
            edges = at + np.concatenate([[0], np.cumsum(counts)[:-1]])
            at += int(counts.sum())
            to = slice(edges[0], at)
            sums = [np.add.reduceat(x[to].astype(float), edges - edges[0]) for x in (log_p, base, seen)]
            rows.append((block, docs, sums[0].tobytes(), sums[1].tobytes(), small(sums[2].astype(np.int64)), ids, sizes))
        return rows_of([list(c) for c in zip(*rows, strict=True)], TEXT_SUMS, [pa.int64(), *[pa.binary()] * 6])

    known = None
    for r in (0, *kept):
        of = sums[r].where("part >= 0").select("part", F.lit(r).alias("round"), "kind", "bucket", *(["n", *nothing("a", "b")] if r == 0 else [*nothing("n"), "a", "b"]), *nothing("t3", "t2"))
        if r == 0:
            of = of.where("kind = 0")
        else:
            of = of.unionByName(states[r].where("kind = -1").select("part", F.lit(r).alias("round"), "kind", "bucket", *nothing("n", "a", "b"), "t3", "t2"))
        known = of if known is None else known.unionByName(of)
    asked = rows.mapInArrow(dealt(deal, block_tokens, True), ASKED_SCHEMA)
    by_text = asked.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(scored, "block long, " + ", ".join(f"{x} binary" for x in TEXT_SUMS[1:]))

    def whole(got: pa.Table) -> pa.Table:
        got = got.to_pylist()
        own = next(row for row in got if row["ids"] is not None)
        ids, sizes = pa.ipc.open_stream(own["ids"]).read_all()["id"], unsmall(own["sizes"])
        out = np.zeros((3, len(sizes)))
        for row in got:
            at = np.cumsum(unsmall(row["docs"]))
            for total, x in zip(out, (np.frombuffer(row["score"]), np.frombuffer(row["base"]), unsmall(row["known"])), strict=True):
                total[at] += x
        return pa.table([ids, pa.array(sizes), pa.array(out[2].astype(np.int64)), pa.array(out[1]), pa.array(out[0])], names=["id", "n_tokens", "n_known", "base_score", "score"])

    done = by_text.groupBy("block").applyInArrow(whole, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return done.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(int(rules[0].n)).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
