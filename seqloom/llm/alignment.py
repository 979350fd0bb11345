"""Cross-tokenizer alignment with corpus-wide counts behind a minimal perfect hash (operator 12)."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.bpe import by_bytes, encoding
from seqloom.llm.common import own_ids, saved, shared_folder

#: Pairs are dealt into so many buckets by their hash; a bucket holds at most |A| * |B| / 256 of them, roughly.
BUCKETS = 256
#: Tables of so many tasks are merged by one node of a tree.
FAN = 64
#: A space behind white space is no border: runs of it may be one token. Elsewhere both tokenizers part before a space.
BORDER, NO_BORDER = re.compile(r"(?<=\S) "), re.compile(r"\A |\s ")


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """64 bits of each key, another function at each level; distinct keys stay distinct."""
    x = keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bucket_of(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, -1) >> np.uint64(32)).astype(np.int64) % BUCKETS


class PerfectHash:
    """Minimal perfect hashes of many buckets, laid out one behind the other: a key's slot is the rank of its bit.

    Each bucket is a cascade of bit arrays: a key alone at its place of a level sets the bit there, keys that
    meet go on to the next level. Every key owns one bit, so the bits before it number it without a gap.
    keys in the order of slots tell members from others.
    """

    def __init__(self, sizes: list[list[int]], bits: np.ndarray, keys: np.ndarray):
        self.levels = max(map(len, sizes), default=0)
        self.sizes = np.zeros((BUCKETS, self.levels), np.int64)
        for i, s in enumerate(sizes):
            self.sizes[i, : len(s)] = s
        self.starts = np.concatenate([[0], np.cumsum(self.sizes.ravel())[:-1]]).reshape(self.sizes.shape) if self.levels else self.sizes
        self.words, self.keys = bits.view("<u8"), keys
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    @staticmethod
    def bits_of(keys: np.ndarray, spread: float = 2.0) -> tuple[list[int], np.ndarray]:
        """The levels' sizes (multiples of 64 bits) and bits of one bucket of distinct keys."""
        sizes, parts = [], [np.empty(0, np.uint8)]
        while len(keys):
            size = -(-int(spread * len(keys)) // 64) * 64
            at = (mixed(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little"))
            keys = keys[~alone[at]]
        return sizes, np.concatenate(parts)

    def slots(self, keys: np.ndarray, bucket: np.ndarray | None = None) -> np.ndarray:
        """The slot of each key, -1 for keys that are no members."""
        bucket = bucket_of(keys) if bucket is None else bucket
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level in range(self.levels):
            size = self.sizes[bucket[rest], level]
            rest, size = rest[size > 0], size[size > 0]
            at = self.starts[bucket[rest], level] + (mixed(keys[rest], level) % size.astype(np.uint64)).astype(np.int64)
            word, shift = self.words[at >> 6], (at & 63).astype(np.uint64)
            own = (word >> shift & np.uint64(1)) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1)))
            out[rest[own]] = (self.before[at >> 6] + below)[own]
            rest = rest[~own]
        if len(self.keys):
            out[(out >= 0) & (self.keys[np.maximum(out, 0)] != keys)] = -1
        return out


class Aligner:
    """Token alignment of two tokenizers, unit by unit.

    A unit is a space, what follows it, and all up to the next space that stands behind something else than
    white space. Both tokenizers end a token before such a space whatever stands around it: A's pattern matches
    no space behind another character, and no piece of B has one (else, or if B normalises texts, the whole
    text is one unit). A text's alignment is then that of its units one after the other, and a unit that
    occurs again is looked up.
    """

    def __init__(self, spec_a: str, model_b: bytes):
        import sentencepiece

        self.a, self.b = encoding(spec_a), sentencepiece.SentencePieceProcessor(model_proto=model_b)
        self.n_b = self.b.get_piece_size()
        ids = sorted(set(self.a.encode_single_token(x) for x in self.a.token_byte_values()))
        self.a_len = np.zeros(self.a.n_vocab, np.int64)
        self.a_len[ids] = [len(self.a.decode_single_token_bytes(i)) for i in ids]
        piece = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(piece)]
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.cut = not any("▁" in p.lstrip("▁") for p in piece) and self.b.normalize(" a  \tﬁ ") == "▁▁a▁▁\tﬁ▁"
        self.pairs = self.a.n_vocab * self.n_b
        if self.pairs >= 1 << 46:
            raise ValueError("the vocabularies have too many pairs for a 64-bit key with a document's number")
        self.of_text = max(self.a.n_vocab, self.n_b)
        self.texts = np.array([f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(self.of_text)], object)

    def units(self, text: str) -> list[str]:
        """The units of space + text, each without its first space."""
        if not self.cut:
            return [text]
        return BORDER.split(text) if NO_BORDER.search(text) else text.split(" ")

    def encoded(self, units: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray, np.ndarray]:
        """A's and B's ids of stretches of units, how many units each has, whether B's bytes are the text's.

        Units that end in no white space keep their tokens behind one another, so many are encoded as one text; where
        that changes under B, each unit is encoded on its own.
        """
        parts, sizes, first = [], [], 0
        step = 64 if self.cut else 1
        while first < len(units):
            part = units[first : first + step]
            whole = [u[-1:].isspace() or not u for u in part]
            part = part[: whole.index(True)] or part[:1] if any(whole) else part
            parts.append(" ".join(part))
            sizes.append(len(part))
            first += len(part)
        a_ids, b_ids = self.a.encode_ordinary_batch([" " + x for x in parts], num_threads=1), self.b.encode(parts, num_threads=1)
        b_ids = [x if t else [self.b.piece_to_id("▁")] for t, x in zip(parts, b_ids, strict=True)]  # a last space alone: the library adds none to an empty text
        of_b = self.b_bytes.__getitem__
        ok = np.fromiter((b"".join(map(of_b, b)) == b" " + x.encode() for x, b in zip(parts, b_ids, strict=True)), bool, len(parts))
        return a_ids, b_ids, np.array(sizes, np.int64), ok

    def aligned(self, units: list[str], write: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """For each unit n_a, n_b, n_groups, n_links; whether B's bytes are the unit's (else all is 0); the links
        (a * n_b + b) of all units one after the other; with write the units' groups.

        All units are laid out behind each other. Every end of a token ends the overlap of one A and one B token, so
        the union of the ends has a link each, and what both have in common ends the groups.
        """
        a_ids, b_ids, sizes, ok = self.encoded(units)
        if not ok.all() and (sizes[~ok] > 1).any():  # those stretches unit by unit
            got = [self.encoded([u]) for u in itertools.compress(units, np.repeat(~ok, sizes).tolist())]
            alone = iter([(x[0][0], x[1][0], bool(x[3][0])) for x in got])
            made = [(a, b, True, n) for a, b, good, n in zip(a_ids, b_ids, ok, sizes, strict=True)]
            made = [y for (a, b, _, n), good in zip(made, ok, strict=True) for y in ([(a, b, True, n)] if good else [(*next(alone), 1) for _ in range(n)])]
            a_ids, b_ids, ok, sizes = ([x[0] for x in made], [x[1] for x in made], np.array([x[2] for x in made]), np.array([x[3] for x in made], np.int64))
        a_ids, b_ids = ([x if good else [] for x, good in zip(ids, ok.tolist(), strict=True)] for ids in (a_ids, b_ids))
        ok = np.repeat(ok, sizes)
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (a_ids, b_ids))
        a, b = (np.fromiter(itertools.chain.from_iterable(ids), np.int64, n.sum()) for ids, n in ((a_ids, n_a), (b_ids, n_b)))
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        unit_end = np.cumsum(np.where(ok, [1 + len(u.encode()) for u in units], 0))
        upto_a, upto_b = np.searchsorted(a_end, unit_end, "right"), np.searchsorted(b_end, unit_end, "right")
        n_a, n_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        ends, common = np.union1d(a_end, b_end), np.intersect1d(a_end, b_end, assume_unique=True)
        links = a[np.searchsorted(a_end, ends)] * self.n_b + b[np.searchsorted(b_end, ends)]
        n_links, n_groups = (np.bincount(np.searchsorted(unit_end, x), minlength=len(units)) for x in (ends, common))

        numbers = np.stack([n_a, n_b, n_groups, n_links], 1)
        if not write:
            return numbers, ok, links, []
        # a group's A tokens, then its B tokens, each with the mark that follows it
        of_a, of_b = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        many_a, many_b = (np.bincount(x, minlength=len(common)) for x in (of_a, of_b))
        last_a, last_b = (common[x] == e if len(e) else np.empty(0, bool) for x, e in ((of_a, a_end), (of_b, b_end)))
        at_end = last_b & np.isin(b_end, unit_end)
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + (np.cumsum(many_b) - many_b)[of_a]] = self.texts[a + self.of_text * last_a]
        out[np.arange(len(b)) + np.cumsum(many_a)[of_b]] = self.texts[b + self.of_text * (2 * last_b + at_end)]
        stops, words = np.cumsum(n_a + n_b).tolist(), out.tolist()
        return numbers, ok, links, ["".join(words[i:j]) for i, j in zip([0, *stops], stops, strict=False)]


class Numbered(dict):
    """Numbers keys in the order in which they are asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Units:
    """The units met by a task and their alignments, forgotten now and then so that they stay within bounds."""

    def __init__(self, aligner: Aligner, most_chars: int = 1 << 26, write: bool = True):
        self.aligner, self.most_chars, self.write, self.turn = aligner, most_chars, write, 0
        self.forget()

    def forget(self) -> None:
        self.turn += 1
        self.index = Numbered()
        self.chars, self.numbers, self.ok, self.links, self.groups = 0, np.empty((0, 4), np.int64), np.empty(0, bool), np.empty(0, np.int64), []

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each unit of the texts, and how many units each text has; numbers hold within a turn."""
        if self.chars > self.most_chars:
            self.forget()
        parts = [self.aligner.units(t) if t else [] for t in texts]
        known, of_known = self.index, len(self.index)
        numbers = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(parts)), np.int64)
        if len(known) > of_known:
            new = list(itertools.islice(known, of_known, None))
            self.chars += sum(map(len, new)) + 100 * len(new)
            got, ok, links, groups = self.aligner.aligned(new, self.write)
            self.numbers, self.ok, self.links = np.concatenate([self.numbers, got]), np.concatenate([self.ok, ok]), np.concatenate([self.links, links])
            self.groups += groups
        self.stops = np.cumsum(self.numbers[:, 3])
        return numbers, np.array([len(p) for p in parts], np.int64)

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of units one after the other, and how many each has."""
        n = self.numbers[numbers, 3]
        first = self.stops[numbers] - n
        return self.links[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


@functools.lru_cache(maxsize=2)
def aligner(spec_a: str, model_b: bytes) -> Aligner:
    return Aligner(spec_a, model_b)


def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of so many values, empty ones too."""
    upto = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def sound(units: Units, numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether all units of a text are aligned; an empty text has none."""
    return (sizes > 0) & (summed((~units.ok[numbers]).astype(np.int64), sizes) == 0)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their sums."""
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, counts, len(keys)).astype(np.int64) if len(keys) else np.empty(0, np.int64)


def ints(x) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), "<i8")


def task_counts(texts: DataFrame, spec_a: str, model_b: bytes) -> DataFrame:
    """bucket, part (task), keys, counts: in how many of a task's documents each distinct pair is linked."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(aligner(spec_a, model_b), write=False)
        pairs = units.aligner.pairs
        total, waiting, size = (np.empty(0, np.int64), np.empty(0, np.int64)), [], 0
        for batch in batches:
            for at in by_bytes(batch["text"], 1 << 20):
                numbers, sizes = units(batch["text"][at.start : at.stop].to_pylist())
                ok, many = sound(units, numbers, sizes), max(1, len(units.index))
                doc = np.repeat(np.arange(len(sizes)), np.where(ok, sizes, 0))
                own = np.unique(doc * many + numbers[np.repeat(ok, sizes)])  # a unit once a text
                links, n = units.joined(own % many)
                held = np.unique(np.repeat(own // many, n) * pairs + links) % pairs
                keys, counts = added(held, np.ones(len(held)))
                waiting.append((keys, counts))
                size += len(keys)
                if size > max(1 << 20, len(total[0])):
                    total, waiting, size = added(*map(np.concatenate, zip(total, *waiting, strict=True))), [], 0
        keys, counts = added(*map(np.concatenate, zip(total, *waiting, strict=True)))
        bucket, part = bucket_of(keys), TaskContext.get().partitionId()
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(BUCKETS), "right").tolist()
        for b, (i, j) in enumerate(zip([0, *ends], ends, strict=False)):
            if j > i:
                yield pa.RecordBatch.from_pylist([{"bucket": b, "part": part, "keys": keys[order[i:j]].tobytes(), "counts": counts[order[i:j]].tobytes()}], pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return texts.mapInArrow(count, "bucket int, part int, keys binary, counts binary")


def hashed(parts: DataFrame, tasks: int) -> DataFrame:
    """bucket, sizes, bits, keys (in the order of slots): the distinct keys of all parts, merged as a tree, and their hash."""

    def union(group: pa.Table) -> pa.Table:
        keys = functools.reduce(np.union1d, map(ints, group["keys"]), np.empty(0, np.int64))
        return pa.table([group["bucket"].slice(0, 1), pa.array([group["part"][0].as_py() // FAN], pa.int32()), pa.array([keys.tobytes()], pa.binary())], names=["bucket", "part", "keys"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, x in zip(batch["bucket"].to_pylist(), batch["keys"], strict=True):
                keys = ints(x)
                sizes, bits = PerfectHash.bits_of(keys)
                at = PerfectHash([sizes] * BUCKETS, np.concatenate([bits] * BUCKETS), np.empty(0)).slots(keys, np.zeros(len(keys), np.int64)) if len(keys) else keys
                placed = np.empty_like(keys)
                placed[at] = keys
                yield pa.RecordBatch.from_pylist([{"bucket": bucket, "sizes": sizes, "bits": bits.tobytes(), "keys": placed.tobytes()}], pa.schema([("bucket", pa.int32()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("keys", pa.binary())]))

    keys = parts.select("bucket", "part", "keys")
    while True:
        keys = keys.groupBy("bucket", F.expr(f"part div {FAN}")).applyInArrow(union, "bucket int, part int, keys binary")
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            return keys.mapInArrow(build, "bucket int, sizes array<bigint>, bits binary, keys binary")


def counted(parts: DataFrame, hashes: DataFrame, tasks: int) -> DataFrame:
    """bucket, counts: dense vectors indexed by the hash, of FAN tasks each, then summed as a tree."""
    groups = -(-tasks // FAN)

    def dense(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table({"bucket": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), "counts": pa.array([], pa.binary())})
        h = PerfectHash([right["sizes"][0].as_py()] * BUCKETS, np.tile(np.frombuffer(right["bits"][0].as_buffer(), np.uint8), BUCKETS), np.empty(0))
        keys, out = ints(right["keys"][0]), np.zeros(len(ints(right["keys"][0])), np.int64)
        for own, n in zip(left["keys"], left["counts"], strict=True):
            at = h.slots(ints(own), np.zeros(len(ints(own)), np.int64))
            if not (keys[at] == ints(own)).all():
                raise ValueError("a pair is missing from the hash of its bucket")
            out[at] += ints(n)
        return pa.table([right["bucket"].slice(0, 1), left["group"].slice(0, 1), pa.array([out.tobytes()], pa.binary())], names=["bucket", "part", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = functools.reduce(np.add, map(ints, group["counts"]))
        return pa.table([group["bucket"].slice(0, 1), pa.array([group["part"][0].as_py() // FAN], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["bucket", "part", "counts"])

    left = parts.withColumn("group", F.expr(f"part div {FAN}").cast("int"))
    right = hashes.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(max(groups, 1) - 1))))
    vectors = left.groupBy("bucket", "group").cogroup(right.groupBy("bucket", "group")).applyInArrow(dense, "bucket int, part int, counts binary")
    while groups > 1:
        vectors = vectors.groupBy("bucket", F.expr(f"part div {FAN}")).applyInArrow(add, "bucket int, part int, counts binary")
        groups = -(-groups // FAN)
    return vectors.select("bucket", "counts")


def highest(table: DataFrame, n_b: int) -> DataFrame:
    """a, best: the highest count of each A id, at most one row an id of the vocabulary."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch["keys"], batch["counts"], strict=True):
                a, n = ints(keys) // n_b, ints(counts)
                order = np.lexsort([n, a])
                last = np.flatnonzero(np.append(a[order][1:] != a[order][:-1], True)) if len(a) else order
                yield pa.RecordBatch.from_arrays([pa.array(a[order][last], pa.int64()), pa.array(n[order][last], pa.int64())], names=["a", "best"])

    return table.select("keys", "counts").mapInArrow(best, "a long, best long").groupBy("a").agg(F.max("best").alias("best"))


def looked_up(docs: DataFrame, spec_a: str, model_b: bytes, table: Broadcast, best: Broadcast, whole: bool) -> DataFrame:
    """Align documents again and look up the counts of their links in one part of the table (a broadcast).

    Columns row, n_best, count_sum of the links that this part holds; with whole the numbers and groups too.
    """
    kind = f"row {dict(docs.dtypes)['row']}, n_best long, count_sum long" + ", n_a long, n_b long, n_groups long, n_links long, groups string" * whole

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, (sizes, bits, keys, counts), highest = Units(aligner(spec_a, model_b), write=whole), table.value, best.value
        h, n_b, values, turn = PerfectHash(sizes, bits, keys), units.aligner.n_b, np.empty((0, 2), np.int64), 0
        for batch in batches:
            for at in by_bytes(batch["text"], 1 << 20):
                numbers, n_units = units(batch["text"][at.start : at.stop].to_pylist())
                if turn != units.turn:
                    values, turn = values[:0], units.turn
                new = np.arange(len(values), len(units.ok))
                links, n = units.joined(new)
                slot = h.slots(links)
                count = np.where(slot >= 0, counts[np.maximum(slot, 0)], 0) if len(keys) else np.zeros(len(links), np.int64)
                most = (slot >= 0) & (count == highest[links // n_b])
                values = np.concatenate([values, summed(np.stack([most.astype(np.int64), count], 1), n)])
                ok = sound(units, numbers, n_units)
                got = np.where(ok[:, None], summed(values[numbers], n_units), 0)
                out = [batch["row"][at.start : at.stop], pa.array(got[:, 0]), pa.array(got[:, 1])]
                if whole:
                    own = np.where(ok[:, None], summed(units.numbers[numbers], n_units), 0)
                    ends = np.cumsum(n_units).tolist()
                    texts = [";".join(map(units.groups.__getitem__, numbers[i:j].tolist())) if good else "" for good, i, j in zip(ok.tolist(), [0, *ends], ends, strict=False)]
                    out += [pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(own[:, 2]), pa.array(own[:, 3]), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in kind.split(", ")])

    return docs.select("row", "text").mapInArrow(look, kind)


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text_col: str = "text", table_pairs: int = 1 << 22) -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (text `a1,a2|b1;a3|b2,b3`).

    A encodes space + text by a byte-level BPE file of the tokenizers library, B the text by a sentencepiece model that
    adds the space; strings of special tokens are plain text. Where both end a token at the same byte a group
    ends. A link is a token of A and one of B that share bytes; its count is the number of documents in which
    that pair of ids is linked, n_best how many links have the highest count of their A id, count_sum the sum.

    The first pass aligns the documents and leaves each task's distinct pairs with their counts. The pairs of all
    tasks, merged as a tree, get a minimal perfect hash; dense count vectors indexed by it are summed as a tree.
    The second pass aligns the documents again and looks the counts up, every key verified. The table of pairs goes
    to the tasks in parts of at most about table_pairs pairs (one bucket at least), each of them a pass
    whose partial sums are added; the highest count of every A id is a table of the vocabulary's size.

    Texts that are null or empty, or that B changes, have zeros and empty groups. Repeated rows each give a row
    and count as documents; null and repeated ids each give a row. An empty table gives no rows; other columns are ignored.
    """
    spec_a, model_b = Path(tokenizer_a).read_text(encoding="utf-8"), Path(tokenizer_b).read_bytes()
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    known, n_b = aligner(spec_a, model_b), aligner(spec_a, model_b).n_b
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = saved(task_counts(rows.select("text"), spec_a, model_b), folder, "parts")
    tasks = (parts.agg(F.max("part")).first()[0] or 0) + 1
    hashes = saved(hashed(parts, tasks), folder, "hashes")
    table = saved(hashes.join(counted(parts, hashes, tasks), "bucket"), folder, "table")
    best = np.full(known.a.n_vocab, -1, np.int64)
    for a, n in highest(table, n_b).collect():  # at most one row an id of A
        best[a] = n
    best = spark.sparkContext.broadcast(best)

    sizes, turns = {r[0]: r[1] for r in table.select("bucket", F.expr("octet_length(keys) div 8")).collect()}, [[]]
    for b in range(BUCKETS):
        if turns[-1] and sum(sizes.get(x, 0) for x in turns[-1]) + sizes.get(b, 0) > table_pairs:
            turns.append([])
        turns[-1].append(b)

    def part_of(turn: list[int]):
        got = {r["bucket"]: r for r in table.where(F.col("bucket").between(turn[0], turn[-1])).collect()}
        order = [got.get(b) for b in range(BUCKETS)]
        bits, keys, counts = (np.concatenate([np.empty(0, kind), *[np.frombuffer(r[name], kind) for r in order if r]]) for name, kind in (("bits", np.uint8), ("keys", np.int64), ("counts", np.int64)))
        return spark.sparkContext.broadcast(([list(r["sizes"]) if r else [] for r in order], bits, keys, counts))

    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    if len(turns) == 1:
        return looked_up(rows.withColumnRenamed("id", "row"), spec_a, model_b, part_of(turns[0]), best, True).select(F.col("row").alias(id_col), *columns)
    rows = own_ids(rows, "id", "row", folder)
    first, *others = (saved(looked_up(rows, spec_a, model_b, part_of(t), best, k == 0), folder, f"turn-{k}") for k, t in enumerate(turns))
    sums = functools.reduce(DataFrame.unionByName, [x.select("row", "n_best", "count_sum") for x in (first, *others)]).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.select("id", "row").join(first.drop("n_best", "count_sum"), "row").join(sums, "row").select(F.col("id").alias(id_col), *columns)
