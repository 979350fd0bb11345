"""Overlap questions where many rows lie at one place: against all pairs, and without making them."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import breakends as brk
from seqloom.operators import evidence, intervals

KIND = "contig string, s long, e long"


@pytest.fixture
def made(monkeypatch):
    """Pairs that overlap joins have made."""
    counts = []

    def counting(*args, **kwargs):
        out = join(*args, **kwargs)
        counts.append(out.count())
        return out

    join = intervals.overlap_pairs
    for module in (intervals, brk, evidence):
        monkeypatch.setattr(module, "overlap_pairs", counting)
    return counts


def drawn(r, n, extra):
    rows = [(r.choice("xy"), s := r.randrange(400), s + r.randrange(0, 40), *extra(i)) for i in range(n)]
    return rows + [(None, 5, 9, *extra(n)), ("x", None, 9, *extra(n + 1)), ("x", 5, None, *extra(n + 2))]


def hits(left, right):
    """Each left row with its overlapping right rows."""
    return [(a, [b for b in right if None not in (*a[:3], *b[:3]) and a[0] == b[0] and a[1] < b[2] and b[1] < a[2]]) for a in left]


def test_first_hits_without_pairs(spark, made):
    r = random.Random(5)
    left, right = drawn(r, 300, lambda i: (i,)), drawn(r, 120, lambda i: (i % 60, f"c{i}"))
    got = intervals.first_hit(spark.createDataFrame(left, KIND + ", id long"), spark.createDataFrame(right, KIND + ", tid long, class string"), "id", ["r_s", "r_e", "tid", "class"])
    want = {a[3]: min((b[1], b[2], b[3], b[4]) for b in met) for a, met in hits(left, right) if met}
    assert {x.id: (x.r_s, x.r_e, x.tid, x["class"]) for x in got.collect()} == want and not made


def test_labels_of_one_stretch_are_met_once(spark, made):
    r = random.Random(6)
    left, right = drawn(r, 200, lambda i: (i,)), drawn(r, 150, lambda i: (f"c{i % 4}" if i % 7 else None,))
    got = intervals.annotated(spark.createDataFrame(left, KIND + ", id long"), spark.createDataFrame(right, KIND + ", label string"), "id", "label")
    want = {a[3]: ",".join(sorted({b[3] for b in met if b[3]})) if met else "NA" for a, met in hits(left, right)}
    assert {x.id: x.annotation for x in got.collect()} == want
    made.clear()
    deep = spark.createDataFrame([("x", i, i + 100, "c") for i in range(90)], KIND + ", label string")
    assert intervals.annotated(spark.createDataFrame([("x", 50, 99, 1)], KIND + ", id long"), deep, "id", "label").first().annotation == "c" and made == [1]


def test_records_are_listed_once_for_each_place(spark, made):
    left = spark.createDataFrame([("x", 5, 9, i, "a") for i in range(50)] + [("x", 5, 9, 50, "b"), ("x", 5, 9, 50, "b"), ("x", 5, 9, None, "a"), (None, 5, 9, 51, "a"), ("x", 50, 60, 52, None)], KIND + ", id long, family string")
    right = spark.createDataFrame([("x", 8, 10, 1, "a"), ("x", 1, 6, 2, "b"), ("x", 8, 10, 1, "a")], KIND + ", tid long, family string")
    got = brk.annotated_records(left, right, "id", ["family", "tid"])
    text = {x.id: x.annotation for x in got.collect()}
    assert got.count() == 55 and all(text[i] == "b,2;a,1;a,1" for i in range(50))
    assert text[50] == "b,2;b,2;a,1;a,1;a,1;a,1" and text[None] == text[51] == text[52] == "NA" and sum(made) == 9
    made.clear()
    text = {x.id: x.annotation for x in brk.annotated_by_family(left, right, "id", "family", ["tid"]).collect()}
    assert all(text[i] == "1" for i in range(50)) and text[50] == "2" and text[None] == text[51] == text[52] == "NA" and sum(made) == 6


def test_lists_of_deep_tracks_without_pairs(spark, made):
    """Rows of all lengths, empty and reversed ones, and keys of one place: no pairs are made and no text is dealt."""
    r = random.Random(7)
    long = lambda n, extra: [("x", s := r.randrange(-3000, 3000), s + r.choice([-9, 0, 1, 40, 256, 257, 1024, 5000]), *extra(i)) for i in range(n)]
    left, right = drawn(r, 200, lambda i: (i, "ab"[i % 2])), drawn(r, 150, lambda i: (i % 40, "abc"[i % 3]))
    left, right = left + long(150, lambda i: (1000 + i, "ab"[i % 2])) + [("x", 5, 9, 2000, "a"), ("x", 5, 9, 2001, "a"), ("x", 5, 9, None, "a"), ("x", 5, 9, 2002, None)], right + long(150, lambda i: (i % 40, "abc"[i % 3]))
    rows, track = spark.createDataFrame(left, KIND + ", id long, family string"), spark.createDataFrame(right, KIND + ", tid long, family string")
    got = brk.annotated_records(rows, track, "id", ["family", "tid"])
    want = {a[3]: ";".join(f"{x[4]},{x[3]}" for x in sorted(met, key=lambda x: (x[1], x[2], f"{x[4]},{x[3]}"))) or "NA" for a, met in hits(left, right)} | {None: "NA"}
    assert {x.id: x.annotation for x in got.collect()} == want and got.count() == len(left) and not sum(made)
    got = brk.annotated_by_family(rows, track, "id", "family", ["tid", "family"])
    want = {a[3]: ",".join(sorted({f"{x[3]}|{x[4]}" for x in met if x[4] == a[4]})) or "NA" for a, met in hits(left, right)} | {None: "NA"}
    assert {x.id: x.annotation for x in got.collect()} == want and got.count() == len(left) and not sum(made)


def test_reads_and_sites_of_one_place_are_compared_once(spark, made):
    reads = spark.createDataFrame([("x", 90, 400, "a", 20), ("x", 100, 150, "a", 20)] * 30 + [("x", 90, 400, None, 20)], KIND + ", sample string, mapq int")
    sites = spark.createDataFrame([("x", 100, 300, i) for i in range(20)], KIND + ", tid long")
    got = evidence.genotype_counts(reads, sites)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(i, x, *n) for i in range(20) for x, n in (("a", (30, 30)), (None, (0, 1)))], key=str) and made == [3]
    made.clear()
    marked = reads.withColumns({"flag": F.lit(0), "cigar": F.lit("20S50M")})
    got = {(x.tid, x.sample): (x.alt, x.ref) for x in brk.break_counts(marked, sites.withColumn("e", F.lit(103).cast("long"))).collect()}
    assert got == {(i, x): n for i in range(20) for x, n in (("a", (30, 0)), (None, (0, 0)))} and made == [3]


def test_sites_meet_samples_in_many_tasks(spark):
    names = spark.createDataFrame([("a",), ("b",), (None,)], "sample string")
    out = evidence.of_every_sample(spark.range(500).withColumnRenamed("id", "tid"), names)
    assert out.distinct().count() == out.count() == 1500 and "_deal" in out._jdf.queryExecution().optimizedPlan().toString()


def test_joins_of_short_rows(spark, monkeypatch):
    """Bases go into the join that makes the pairs, so that pairs are not dealt again, and bins are as narrow as the rows."""
    from seqloom.operators import callset
    from seqloom.plans import callsets, catalogue, more, records  # noqa: F401

    seen, join = [], intervals.overlap_pairs

    def noted(left, right, size=intervals.BIN, pad=0):
        seen.append((size, {*left.columns, *right.columns}))
        return join(left, right, size, pad)

    monkeypatch.setattr(intervals, "overlap_pairs", noted)
    monkeypatch.setattr(callset, "overlap_pairs", noted)
    for name in ("site_duplications", "inclusive_overlaps", "renamed_intervals"):
        catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert [n for n, _ in seen] == [evidence.SHORT] * 3 and {"seq1", "seq2"} <= seen[0][1]


def test_rules_of_the_final_filter_are_asked_once(spark):
    from seqloom.plans import callsets

    text = callsets.final_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("levenshtein(") == 2


def test_names_of_deep_tracks_are_counted(spark, made, monkeypatch):
    """Rows are written out from counts; only empty and reversed rows make pairs."""
    from collections import Counter

    from seqloom.operators import callset

    monkeypatch.setattr(callset, "overlap_pairs", intervals.overlap_pairs)
    monkeypatch.setattr(callset, "AT_ONCE", 3)
    monkeypatch.setattr(callset, "DEEP", 8)
    r = random.Random(9)
    turned = lambda rows: [(c, e, s, *x) if i % 29 == 0 else (c, s, e, *x) for i, (c, s, e, *x) in enumerate(rows)]
    left, right = turned(drawn(r, 300, lambda i: (i, "abc"[i % 3]))), turned(drawn(r, 200, lambda i: ("pq"[i % 2] if i % 5 else None,)))
    left += [("x", 100, 120, 400, "a")] * 3
    got = callset.renamed(spark.createDataFrame(left, KIND + ", id long, more string"), spark.createDataFrame(right, KIND + ", name string"), "id", "name")
    want = Counter((a[0], a[1], a[2], b[3], a[4]) for a, met in hits(left, right) for b in met)
    assert Counter(map(tuple, got.collect())) == want and sum(made) < sum(want.values()) / 4


def test_general_filter_sweeps_narrow_rows(spark, monkeypatch):
    """The rules on a call's own columns are asked before the sweeps, which carry what the verdict needs."""
    from seqloom.operators import sweeps
    from seqloom.plans import callsets

    seen = []

    def noted(left, *args, **kwargs):
        seen.append(left.columns)
        return sweeps.any_overlap(left, *args, **kwargs)

    monkeypatch.setattr(callsets, "any_overlap", noted)
    callsets.general_filter(spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and len(seen[0]) <= 8


def test_rows_beyond_a_track_are_not_swept(spark, monkeypatch):
    from seqloom.operators import sweeps

    r, swept, run = random.Random(8), [], sweeps.running
    left, right = drawn(r, 200, lambda i: (i,)) + [("z", 5, 9, 300), ("x", 9000, 9001, 301), ("x", -50, -40, 302)], [x for x in drawn(r, 20, lambda i: (i,)) if x[1] is None or 100 < x[1] < 250]
    rows, track = spark.createDataFrame(left, KIND + ", id long"), spark.createDataFrame(right, KIND + ", tid long")
    monkeypatch.setattr(sweeps, "running", lambda events, *args, **kwargs: swept.append(events.where("_kind = 0").count()) or run(events, *args, **kwargs))
    for pad in (0, 7):
        few, all_rows = ({x.id: x.hit for x in sweeps.any_overlap(rows, track, pad=pad, few_groups=k).collect()} for k in (True, False))
        assert few == all_rows and len(few) == len(left) and any(few.values())
    assert swept[0] < swept[1] and swept[2] < swept[3]
