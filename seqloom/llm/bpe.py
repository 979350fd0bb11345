"""BPE encoding and decoding with tree concatenation of long texts (operator 10)."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern by which byte-level BPE vocabularies of this kind part a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters before which a letter's run always ends, whatever follows.
BREAKS = frozenset(" \n\r\t,.;:!?\"()")
#: Columns of a piece of a long text: its row, how often that row occurs, its place, its ids once encoded.
WORK = ["id", "sha", "n", "piece", "text", "ids"]


@functools.cache
def encoding(spec: str):
    """tiktoken's encoder for a tokenizers-library JSON file of byte-level BPE (its content), one per worker.

    The vocabulary writes each byte as one printable character: the printable ones stand for themselves, the
    others follow from code point 256 on. Ids of merged tokens rise in the order of the merges.
    """
    import tiktoken

    got = json.loads(spec)
    if got["model"]["type"] != "BPE" or (got["pre_tokenizer"] or {}).get("type") != "ByteLevel" or got["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("only byte-level BPE without a prefix space is read here")
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))}
    special = {x["content"]: x["id"] for x in got["added_tokens"]}
    ranks = {bytes(byte[c] for c in k): v for k, v in got["model"]["vocab"].items() if k not in special}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encoded(enc, text: str) -> np.ndarray:
    return enc.encode_to_numpy(text, allowed_special="all").astype("<u4")


def decoded(enc, ids: np.ndarray) -> str:
    return enc.decode_bytes(ids.tolist()).decode("utf-8", "replace")


def edge(enc, text: str, ids: np.ndarray, tokens: int, left: bool) -> tuple[int, int, bool]:
    """Where the window of about so many tokens at the joined end of a side begins (left) or ends (right).

    Returns (tokens in it, characters in it, sure). Sure: the cut is at the far end of the side, or between a
    letter and a character of BREAKS; there both sides of the cut are encoded independently in any text.
    Else the cut is at a token's border between characters, and the caller must see the tokens agree.
    """
    if tokens >= len(ids):
        return len(ids), len(text), True
    breaks = BREAKS - frozenset("".join(enc.special_tokens_set))
    part = ids[-tokens:] if left else ids[:tokens]
    lengths = [len(enc.decode_single_token_bytes(int(x))) for x in part]
    size = sum(lengths)
    near = (text[-size:] if left else text[:size]).encode("utf-8", "surrogatepass")
    base = len(near) - size if left else 0
    borders = {base: 0} | {base + int(n): i + 1 for i, n in enumerate(np.cumsum(lengths))}  # byte offset in near: tokens before it

    def window(i: int, sure: bool) -> tuple[int, int, bool]:
        inside = near[i:] if left else near[:i]
        return (len(part) - borders[i] if left else borders[i]), len(inside.decode("utf-8", "surrogatepass")), sure

    cuts = [i for i in sorted(borders, reverse=not left) if 0 < i < len(near) and near[i] & 0xC0 != 0x80]  # the widest window first
    for i in cuts:
        if chr(near[i]) in breaks and chr(near[i - 1]).isascii() and chr(near[i - 1]).isalpha():
            return window(i, True)
    return window(cuts[0], False) if cuts else (len(ids), len(text), True)


def joined(enc, a: str, a_ids: np.ndarray, b: str, b_ids: np.ndarray, window: int = 32, agree: int = 4) -> np.ndarray:
    """Ids of a + b from those of a and b: a window around the join is encoded again, and doubled until each
    of its ends either is at a sure cut or repeats `agree` tokens of its side. Between such ends every pair of
    neighbouring tokens occurs in a valid encoding, so that the result is that of the whole text."""
    if not len(a_ids) or not len(b_ids):
        return np.concatenate([a_ids, b_ids])
    window = max(window, agree + max([0, *map(len, enc.special_tokens_set)]))  # a special token may be cut in two
    while True:
        n, chars_n, sure_n = edge(enc, a, a_ids, window, True)
        m, chars_m, sure_m = edge(enc, b, b_ids, window, False)
        mid = encoded(enc, a[len(a) - chars_n :] + b[:chars_m])
        if (sure_n or n > agree and len(mid) > agree and (mid[:agree] == a_ids[len(a_ids) - n :][:agree]).all()) and (
            sure_m or m > agree and len(mid) > agree and (mid[-agree:] == b_ids[:m][-agree:]).all()
        ):
            return np.concatenate([a_ids[: len(a_ids) - n], mid, b_ids[m:]])
        window *= 2


def halves(text: str, most: int) -> list[str]:
    """2**k pieces by halving until none is longer than most."""
    pieces = [text]
    while len(pieces[0]) > most:
        pieces = [x for p in pieces for x in (p[: (len(p) + 1) // 2], p[(len(p) + 1) // 2 :])]
    return pieces


def by_bytes(texts: pa.Array, most: int) -> Iterator[slice]:
    """Slices of consecutive texts of about `most` bytes each, at least one text a slice."""
    first, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + n > most:
            yield slice(first, i)
            first, size = i, 0
        size += n
    if first < len(texts):
        yield slice(first, len(texts))


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", piece_chars: int = 32768) -> DataFrame:
    """One row per input row: id, ids (binary: little-endian unsigned 32-bit), decoded.

    Ids are those of the tokenizers library for the JSON file `tokenizer`, without special tokens added;
    strings of special tokens in a text become these tokens, as there. Texts of more than piece_chars
    characters are halved into rows, encoded in parallel, and joined pairwise as a tree: each round joins
    neighbours of the same text by re-encoding a growing window around the cut; the first round encodes the
    pieces that it joins, the last one decodes. Every stage runs one Python worker a core, on a few megabytes of
    text at a time. The file is read by the driver; its content (a vocabulary of fixed size) goes to the tasks.

    Null text is empty: no ids, empty decoded text. Repeated rows, ids or null ids each give a row. An empty
    table gives no rows; other columns are ignored.
    """
    spec = Path(tokenizer).read_text(encoding="utf-8")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(spec)
        for batch in batches:
            for at in by_bytes(batch["text"], 1 << 20):
                part = batch.slice(at.start, at.stop - at.start)
                ids = [encoded(enc, x) for x in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["id"], pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([decoded(enc, x) for x in ids], pa.string())], names=["id", "ids", "decoded"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch["text"]):
                cut, one = halves(text.as_py(), piece_chars), batch.slice(i, 1)
                for first in range(0, len(cut), 16):
                    part = cut[first : first + 16]
                    same = one.take(pa.array([0] * len(part)))
                    yield pa.RecordBatch.from_arrays([same["id"], same["sha"], same["n"], pa.array(range(first, first + len(part)), pa.int32()), pa.array(part, pa.string()), pa.nulls(len(part), pa.binary())], names=WORK)

    def join(pair: pa.Table, last: bool) -> pa.Table:
        enc, pair = encoding(spec), pair.sort_by("piece")
        texts, ids = pair["text"].to_pylist(), [None if x is None else np.frombuffer(x, "<u4") for x in pair["ids"].to_pylist()]
        ids = [encoded(enc, x) if got is None else got for x, got in zip(texts, ids, strict=True)]
        out = joined(enc, texts[0], ids[0], texts[1], ids[1]) if len(texts) > 1 else ids[0]
        one = pair.slice(0, 1)
        if last:
            return pa.table([one["id"], one["n"], pa.array([out.tobytes()], pa.binary()), pa.array([decoded(enc, out)], pa.string())], names=["id", "n", "ids", "decoded"])
        return pa.table([one["id"], one["sha"], one["n"], pa.array([one["piece"][0].as_py() // 2], pa.int32()), pa.array(["".join(texts)], pa.string()), pa.array([out.tobytes()], pa.binary())], names=WORK)

    def next_joined(pair: pa.Table) -> pa.Table:
        return join(pair, False)

    def last_joined(pair: pa.Table) -> pa.Table:
        return join(pair, True)

    short = rows.where(F.length("text") <= piece_chars).mapInArrow(whole, f"id {kind}, ids binary, decoded string")
    long = rows.where(F.length("text") > piece_chars)
    longest = docs.select(F.length(text_col).alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= piece_chars:
        return short.withColumnRenamed("id", id_col)
    # a row is known by its id and text from here on; equal rows are worked on once and counted
    texts = long.groupBy("id", F.sha2("text", 256).alias("sha"), "text").agg(F.count(F.lit(1)).alias("n"))
    of = f"id {kind}, sha string, n long, piece int, text string, ids binary"
    work = texts.select("id", "sha", "n", "text").mapInArrow(pieces, of)
    while longest > piece_chars:
        longest = (longest + 1) // 2
        last = longest <= piece_chars
        pairs = work.groupBy("id", "sha", F.expr("piece div 2"))
        work = pairs.applyInArrow(last_joined if last else next_joined, f"id {kind}, n long, ids binary, decoded string" if last else of)
    repeated = work.select("id", F.explode(F.array_repeat(F.struct("ids", "decoded"), F.col("n").cast("int"))).alias("x")).select("id", "x.ids", "x.decoded")
    return short.unionByName(repeated).withColumnRenamed("id", id_col)
