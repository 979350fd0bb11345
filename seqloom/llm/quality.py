"""Line-first cleaning by quality rules (operator 13)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.bpe import by_bytes

#: The symbols that the contract counts, and white space that parts words.
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"
#: A line is navigation if it has at least LEAST_LINKS separators of menus or paths, one for every LINK_WORDS words.
LINK, LEAST_LINKS, LINK_WORDS = re.compile(r"[|»›·•→]"), 2, 4
#: A line fails for its punctuation if of its words a third carries a symbol or ends in two or more marks of exclamation.
#: The marks of both rules: lines of a text that has none of them pass.
MARKS = [*"|»›·•→#*$%&<>", "!!", "!?", "?!", "??"]
NOISY, NOISY_SHARE = re.compile(r"[^\x20\x09-\x0D]*(?:[#*$%&<>]|[!?]{2})[^\x20\x09-\x0D]*"), 3
#: A line of so many words that ends in none of these marks, brackets and quotes behind them aside, is no sentence.
LONG_LINE, ENDS, CLOSERS = 20, frozenset(".!?…:;。！？；।؟۔"), "\"'”’»)] \t\n\v\f\r"
#: Boilerplate: stock phrases of licences, cookie notices and site furniture, in lower case.
STOCK = [
    "all rights reserved", "licensed under", "licenced under", "released under the", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "uses cookies", "accept cookies", "subscribe to our", "sign up for our", "follow us on", "share this", "powered by",
    "click here", "read more", "skip to content", "enable javascript", "copyright ©", "copyright (c)", "© 19", "© 20",
    "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados",
]
#: The rules in the order in which a failing line is charged to one.
RULES = ("boilerplate", "navigation", "punctuation", "repeated")


def failed(line: str, words: int, earlier: bool, stock: list[str], noise: bool) -> int | None:
    """The first rule that a line of so many words fails, by number; a line without a word fails none.

    stock, noise: which phrases the text has at all, and whether any of its marks make a word noisy.
    """
    if not words:
        return None
    if stock and any(x in line.lower() for x in stock):
        return 0
    links = len(LINK.findall(line)) if noise else 0
    if links >= LEAST_LINKS and links * LINK_WORDS >= words:
        return 1
    if noise and len(NOISY.findall(line)) * NOISY_SHARE >= words or words >= LONG_LINE and line.rstrip(CLOSERS)[-1:] not in ENDS:
        return 2
    return 3 if earlier else None


def repeated_words(texts: list[list[bytes]], window: int = 5) -> np.ndarray:
    """For each text (its words) how many words are in windows of so many words that the text holds twice or more.

    Windows are told apart exactly: words are numbered, then windows of 2, 4, ... words by the pairs of numbers
    of two that overlap or meet.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, sizes.sum())
    doc = np.repeat(np.arange(len(texts)), sizes)
    at = np.flatnonzero(doc[: -(window - 1)] == doc[window - 1 :]) if len(ids) >= window else np.empty(0, np.int64)
    if not len(at):
        return np.zeros(len(texts), np.int64)
    rank, length = ids, 1
    while length < window:
        step = min(length, window - length)
        rank = np.unique(rank[:-step] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)[1]
        length += step
    _, same, n = np.unique(doc[at] * (int(rank.max()) + 1) + rank[at], return_inverse=True, return_counts=True)
    begins = at[n[same] > 1]
    edge = np.bincount(begins, minlength=len(ids) + window) - np.bincount(begins + window, minlength=len(ids) + window)
    inside = (np.cumsum(edge)[: len(ids)] > 0).astype(np.int64)
    return np.bincount(doc, inside, len(texts)).astype(np.int64)


def cleaned(text: str) -> tuple[int, int, int, list[int], str]:
    """word_chars, n_symbols, n_dup_lines, words lost by each rule, the lines that stay."""
    seen, lost, kept, dup = set(), [0] * len(RULES), [], 0
    low = text.lower()
    stock, noise = [x for x in STOCK if x in low], any(x in text for x in MARKS)
    for line in text.split("\n"):
        words = len(line.encode().split())  # bytes are parted at exactly the white space of the contract
        earlier = words > 0 and line in seen
        dup += earlier
        rule = failed(line, words, earlier, stock, noise)
        if rule is None:
            kept.append(line)
        else:
            lost[rule] += words
        if words:
            seen.add(line)
    return len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, lost, "\n".join(kept)


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 10, most_repeated: int = 20, most_lost: int = 50) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    lost (words by rule: boilerplate, navigation, punctuation, repeated), n_lost, cleaned, kept.

    Lines come first: each line (between line feeds) that has a word is held against the rules above, and those that fail
    one leave the text: stock phrases; menus; lines of noise, or long lines that end no sentence; lines equal to
    an earlier one. Then a document goes if its lines lost over most_lost per cent of its words, or if the base
    rules fail (under least_words words, or over most_repeated per cent of them in windows of five words that
    the text repeats; both of the whole text). A word is a run without ASCII white space.

    Every row is decided alone, in one pass without a shuffle, a megabyte of texts at a time; a long text is
    read whole. Null and empty texts have no words, are not kept and stay empty. Repeated rows, ids or null ids
    each give a row. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kind = f"id {dict(rows.dtypes)['id']}, {', '.join(f'{x} long' for x in names)}, base_failed boolean, lost map<string, bigint>, n_lost long, cleaned string, kept boolean"
    of_lost = pa.map_(pa.string(), pa.int64())

    def rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in by_bytes(batch["text"], 1 << 20):
                texts = batch["text"][at.start : at.stop].to_pylist()
                words = [t.encode().split() for t in texts]
                n, repeated = np.array([len(w) for w in words], np.int64), repeated_words(words)
                got = [cleaned(t) for t in texts]
                lost = np.array([sum(x[3]) for x in got], np.int64)
                base = (n < least_words) | (100 * repeated > most_repeated * n)
                columns = [n, *(np.array([x[i] for x in got], np.int64) for i in range(3)), repeated, base]
                by_rule = pa.array([[(r, k) for r, k in zip(RULES, x[3], strict=True) if k] for x in got], of_lost)
                yield pa.RecordBatch.from_arrays(
                    [batch["id"][at.start : at.stop], *map(pa.array, columns), by_rule, pa.array(lost), pa.array([x[4] for x in got], pa.string()), pa.array(~base & (100 * lost <= most_lost * n))],
                    names=["id", *names, "base_failed", "lost", "n_lost", "cleaned", "kept"])

    return rows.mapInArrow(rules, kind).withColumnRenamed("id", id_col)
