"""Sequence functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC codes and their complements; N and gaps stay.
CODES, COMPLEMENTS = "acgtrymkbdhvACGTRYMKBDHV", "tgcayrkmvhdbTGCAYRKMVHDB"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, CODES, COMPLEMENTS))


def homopolymer(seq: Column, base: str) -> Column:
    """Length less one of the longest run of a base, 0 without one."""
    runs = F.transform(F.regexp_extract_all(seq, F.lit(f"({base}+)")), lambda r: F.length(r))
    return F.coalesce(F.array_max(runs) - 1, F.lit(0))


def poly_at_fraction(seq: Column) -> Column:
    """Share of A or of T, whichever is larger; 0 for null or empty."""
    share = lambda b: F.length(seq) - F.length(F.replace(seq, F.lit(b)))
    return F.coalesce(F.try_divide(F.greatest(share("A"), share("T")), F.length(seq)), F.lit(0.0))


def locate_first(seq: Column, part: str) -> Column:
    """0-based start of the first occurrence, null if there is none."""
    at = F.locate(part, seq)
    return F.when(at > 0, at - 1)


def locate_last(seq: Column, part: str) -> Column:
    """0-based start of the last occurrence, null if there is none."""
    at = F.locate(part[::-1], F.reverse(seq))
    return F.when(at > 0, F.length(seq) - at + 1 - len(part))


def oriented(seq: Column, part: Column) -> Column:
    """part or its reverse complement, whichever seq contains (part first); null for neither."""
    other = reverse_complement(part)
    return F.when(F.contains(seq, part), part).when(F.contains(seq, other), other)


def cigar_matched(cigar: Column) -> Column:
    """Sum of the lengths of a CIGAR string's M operations, 0 without one."""
    lengths = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)M")), lambda v: v.cast("long"))
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, v: a + v)


def swap_strand(strand: Column) -> Column:
    return F.translate(strand, "+-", "-+")


def match_fraction(mismatches: Column, aligned: Column) -> Column:
    """1 - mismatches / aligned; null where nothing is aligned."""
    return 1 - F.try_divide(mismatches, aligned)


#: Shape, scale and gamma(shape) of the density in the pair score.
SHAPE, SCALE, GAMMA = 2.5, 3.0, 1.329340388179137


def breakend_score(dist: Column, overlap: Column, n1: Column, n2: Column) -> Column:
    """gamma density (shape 2.5, scale 3) of the overlap times its square, less the distance that the overlap
    does not explain, plus both ends' evidence."""
    density = F.pow(overlap, F.lit(SHAPE - 1)) * F.exp(-overlap / SCALE) / (GAMMA * SCALE**SHAPE)
    penalty = F.when(overlap > 0, F.abs(dist - overlap)).otherwise(dist)
    return F.when(overlap > 0, density * overlap * overlap).otherwise(0.0) - penalty + n1 + n2


def breakend_scores(dist: np.ndarray, overlap: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """breakend_score of arrays, to 6 places, for tasks that make the pairs themselves."""
    some, at = overlap > 0, np.maximum(overlap, 0).astype(float)
    density = np.power(at, SHAPE - 1) * np.exp(-at / SCALE) / (GAMMA * SCALE**SHAPE)
    return np.round(np.where(some, density * at * at, 0.0) - np.where(some, np.abs(dist - at), dist) + n1 + n2, 6)


def homopolymer_start(seq: Column, base: str) -> Column:
    """0-based start of the first longest run of a base, 0 without one."""
    longest = F.array_max(F.transform(F.regexp_extract_all(seq, F.lit(f"({base}+)")), lambda r: F.length(r)))
    return F.coalesce(F.position(F.repeat(F.lit(base), longest), seq) - 1, F.lit(0))


def only_poly_at(query: Column, least: float = 0.95) -> Column:
    """Whether A or T make up more than `least` of an aligned query, gaps counted."""
    return poly_at_fraction(F.upper(query)) > least


def columns_matched(query: Column, target: Column) -> Column:
    """Columns of an alignment in which both sides have the same letter, whatever its case; a gap matches nothing."""
    pairs = F.zip_with(F.split(F.upper(query), ""), F.split(F.upper(target), ""), lambda a, b: ((a == b) & (a != "") & (a != "-")).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)))


def share_matched(query: Column, target: Column) -> Column:
    """The columns matched as a share of the aligned letters of the query; null without any."""
    return F.try_divide(columns_matched(query, target).cast("double"), F.length(F.replace(query, F.lit("-"))))


def chopped(value: Column, left: Column, right: Column, s: Column, e: Column, contig_length: Column) -> Column:
    """Bases or qualities of a read without its soft clips: the right one goes where the alignment ends before the end of
    its contig, then as many letters as the left one has where it starts behind the contig's second base."""
    cut = F.when(e < contig_length, F.substring(value, F.lit(1), F.greatest(F.length(value) - right, F.lit(0)).cast("int"))).otherwise(value)
    return F.when(s > 1, F.substring(cut, (left + 1).cast("int"), F.length(value))).otherwise(cut)


def quality_trimmed(seq: Column, qual: Column, least: int = 35, window: int = 4, mean: float = 5) -> Column:
    """seq up to the first window whose qualities less `least` average under `mean`; the last window of qual is not
    looked at. Whole without such a window."""
    codes = F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - least)
    starts = F.when(F.length(qual) > window, F.sequence(F.lit(1), F.length(qual) - window))
    bad = lambda of, i: F.aggregate(F.slice(of, i, window), F.lit(0), lambda n, x: n + x) / window < mean
    at = bound(codes, lambda of: F.array_min(F.filter(starts, lambda i: bad(of, i))))
    return F.coalesce(F.substring(seq, F.lit(1), at - 1), seq)


def uncovered(length: Column, covered: Column) -> Column:
    """Segments (start, end, both within) of 0..length - 1 that no interval [a, b) of `covered` (array of structs s, e)
    has. As callers of this rule expect, every segment but the first starts one base later; segments of one base after
    the first vanish."""
    free = F.filter(F.sequence(F.lit(0), length - 1), lambda p: ~F.exists(covered, lambda c: (c["s"] <= p) & (p < c["e"])))
    starts = lambda of: F.filter(of, lambda p, i: F.coalesce(F.get(of, i - 1) != p - 1, F.lit(True)))
    ends = lambda of: F.filter(of, lambda p, i: F.coalesce(F.get(of, i + 1) != p + 1, F.lit(True)))
    both = bound(free, lambda of: F.arrays_zip(starts(of).alias("s"), ends(of).alias("e")))
    segments = F.transform(both, lambda x, i: F.struct(F.when(i == 0, x["s"]).otherwise(x["s"] + 1).alias("s"), x["e"].alias("e")))
    return F.when(length > 0, F.filter(segments, lambda x: x["s"] <= x["e"])).otherwise(F.filter(F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"))), lambda x: F.lit(False)))


def holding(mappings: Column, at: Column, inside: bool) -> Column:
    """Mappings (array of structs s, e) that contain a break position, or those that don't."""
    has = lambda m: (m["s"] <= at) & (at <= m["e"])
    return F.filter(mappings, has if inside else lambda m: ~has(m))


def overlap_of(s: Column, e: Column, s2: Column, e2: Column) -> Column:
    """Struct s, e of the overlap of two intervals whose ends are bases of their own; null unless longer than one base."""
    a, b = F.greatest(s, s2), F.least(e, e2)
    return F.when(b - a > 0, F.struct(a.alias("s"), b.alias("e")))


def distance_of(s: Column, e: Column, s2: Column, e2: Column) -> Column:
    """Distance of two such intervals; negative where they overlap."""
    return F.greatest(s, s2) - F.least(e, e2)


def duplicated_bases(seq: Column, start: Column, query_start: Column, overlap: Column) -> Column:
    """Bases of a read (aligned from start on, its base query_start first) within an overlap, both ends included."""
    return F.when(overlap.isNotNull(), F.substring(seq, (overlap["s"] - start + query_start + 1).cast("int"), (overlap["e"] - overlap["s"] + 1).cast("int")))


def more_a_than_t(seq: Column) -> Column:
    """Whether a sequence reads forward, to its poly-A."""
    return F.length(F.replace(seq, F.lit("A"))) < F.length(F.replace(seq, F.lit("T")))


def blocks_score(match: Column, repeats: Column, mismatch: Column, query_gaps: Column, target_gaps: Column) -> Column:
    return match + F.shiftright(repeats, 1) - mismatch - query_gaps - target_gaps


def blocks_identity(match: Column, repeats: Column, mismatch: Column, query_gaps: Column, query_span: Column, target_span: Column) -> Column:
    """Identity of a blocked alignment in percent: 100 less the share of mismatches, query gaps and the logarithm of the
    difference of spans, per thousand."""
    total = match + repeats + mismatch
    apart = F.greatest(query_span - target_span, F.lit(0))
    bad = F.when(F.least(query_span, target_span) > 0, F.try_divide(1000 * (mismatch + query_gaps + F.round(3 * F.log(1 + apart.cast("double")))), total))
    return F.when(total > 0, 100 - F.coalesce(bad, F.lit(0.0)) * 0.1).otherwise(F.lit(0.0))


def tail_at(seq: Column, letter: str, n: int, start: bool) -> Column:
    run = F.lit(letter * n)
    return F.startswith(seq, run) if start else F.endswith(seq, run)


def region_text(contig: Column, start: Column, end: Column) -> Column:
    return F.concat(contig, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def region_parts(text: Column) -> Column:
    """Struct contig, s, e of contig:start-end; null for other texts. The contig may hold colons."""
    get = lambda i: F.regexp_extract(text, r"^(.+):(\d+)-(\d+)$", i)
    return F.when(text.rlike(r"^.+:\d+-\d+$"), F.struct(get(1).alias("contig"), get(2).cast("long").alias("s"), get(3).cast("long").alias("e")))


def spliced(seq: Column, starts: Column, ends: Column, strand: Column) -> Column:
    """Exons [start, end) of a sequence, one after the other, reverse-complemented on the - strand."""
    exons = F.zip_with(starts, ends, lambda s, e: F.substring(seq, (s + 1).cast("int"), (e - s).cast("int")))
    whole = F.array_join(exons, "")
    return F.when(strand == "-", reverse_complement(whole)).otherwise(whole)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, for texts without the character NUL. A null has none that differs: all of the other."""
    both = F.regexp_extract(F.concat(a, F.lit("\0"), b), r"^([^\x00]*)[^\x00]*\x00\1", 1)
    return F.coalesce(F.length(both), F.least(F.length(a), F.length(b)))


def walked_duplication(before: Column, left: Column, right: Column, after: Column, most: int = 100) -> Column:
    """Target-site duplication around a gap: bases that two windows share on from their starts (left, right) and back
    from them (before, after, which end where the windows start), at most `most`; NA beyond that or without any."""
    end = lambda x: F.reverse(F.right(x, F.lit(most + 1)))
    start = lambda x: F.left(x, F.lit(most + 1))
    walks = F.struct(common_prefix(end(before), end(after)).alias("back"), common_prefix(start(left), start(right)).alias("on"))
    text = lambda w: F.concat(F.right(before, w["back"]), F.substring(left, F.lit(1), w["on"]))
    return bound(walks, lambda w: F.when((w["back"] + w["on"] > most) | (w["back"] + w["on"] == 0), "NA").otherwise(text(w)))


#: The steps of both positions from which a duplication is walked, in the order in which they are tried.
STARTS = [(0, 0), (1, 1), (-1, -1), (0, -1), (-1, 0), (1, 0), (0, 1)]


def longest_duplication(left: Column, right: Column, at_left: Column, at_right: Column, most: int = 100) -> Column:
    """Target-site duplication of two windows of a reference around their positions (0-based): from each of seven starts
    the bases that both share, walked to the left and to the right. A start whose bases differ, or from which either
    walk goes on for `most` bases, gives none. The longest stays, of equal ones the first; NA without any. A walk ends at the windows' ends.
    """

    def walk(l: int, r: int, order: int) -> Column:
        p, q = at_left + l, at_right + r
        behind = lambda x, at: F.reverse(F.right(F.left(x, (at + 1).cast("int")), F.lit(most)))
        ahead = lambda x, at: F.substring(x, (at + 1).cast("int"), F.lit(most))
        inside = (p >= 0) & (q >= 0) & (p < F.length(left)) & (q < F.length(right))
        both = lambda part: F.when(inside, common_prefix(part(left, p), part(right, q))).otherwise(0)
        return F.struct(p.alias("p"), both(behind).alias("back"), both(ahead).alias("on"), F.lit(-order).alias("order"))

    def judged(w: Column) -> Column:
        good = (w["back"] > 0) & (w["on"] > 0) & (w["back"] < most) & (w["on"] < most)
        return F.struct(F.when(good, w["back"] + w["on"] - 1).otherwise(0).alias("n"), w["order"].alias("order"), (w["p"] - w["back"] + 2).cast("int").alias("from"))

    walks = F.array(*[walk(x, y, i) for i, (x, y) in enumerate(STARTS)])
    return bound(F.array_max(F.transform(walks, judged)), lambda b: F.when(b["n"] > 0, F.substring(left, b["from"], b["n"])).otherwise("NA"))
