"""Order-dependent operators against plain Python, and the quirks of boundaries."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import sequences as seqs
from seqloom.operators import clustering, evidence, intervals, outliers, sweeps
from seqloom.sources import text


def some(n, seed, span=3000, longest=80):
    r = random.Random(seed)
    return [(i, r.choice("xy"), s := r.randrange(span), s + 1 + r.randrange(longest)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, contig string, s long, e long")


@pytest.mark.parametrize("seed", [1, 2])
def test_gap_clusters_whatever_the_partitions(spark, seed):
    rows, want, head, last = some(300, seed), {}, None, None
    for i, c, s, e in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if last is None or last[0] != c or s - last[1] > 10:
            head = i
        want[i], last = head, (c, e)
    for parts in (1, 7):
        got = clustering.gap_clusters(frame(spark, rows).repartition(parts), 10).select("id", "cluster").collect()
        assert {r.id: r.cluster for r in got} == want


def test_median_clusters(spark):
    rows = [(i, c, s, (s + e) // 2) for i, c, s, e in some(300, 3)]
    want, members, median, head, contig = {}, [], 0, None, None
    for i, c, pos, mid in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if contig == c and members and abs(median - pos) <= 20:
            members.append(pos)
            median = sorted(members)[len(members) // 2]
        else:
            members, median, head, contig = [pos], mid, i, c
        want[i] = head
    got = clustering.median_clusters(spark.createDataFrame(rows, "id long, contig string, pos long, mid long"), 20, 80)
    assert {r.id: r.cluster for r in got.collect()} == want


def test_overlap_dedup(spark):
    rows, want, last = some(200, 4), [], None
    for i, c, s, e in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if last and last[1] == c and min(e, last[3]) - max(s, last[2]) > 0:
            if e - s > last[3] - last[2]:
                want[-1] = last = (i, c, s, e)
        else:
            last = (i, c, s, e)
            want.append(last)
    got = clustering.overlap_dedup(frame(spark, rows)).select("id", "contig", "s", "e").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_greedy_pairs_use_each_end_once(spark):
    r = random.Random(5)
    pairs = [(a, 100 + b, float(r.randrange(8))) for a in range(12) for b in range(12) if r.random() < 0.4]
    used, want = set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    got = clustering.greedy_pairs(spark.createDataFrame(pairs, "a long, b long, score double"))
    assert {(x.a, x.b) for x in got.collect()} == want
    assert clustering.greedy_pairs(spark.createDataFrame([], "a long, b long, score double")).count() == 0


def test_binned_join_is_the_theta_join(spark):
    a, b = some(80, 6, 20000, 9000), some(80, 7, 20000, 9000)
    want = {(i, j) for i, c, s, e in a for j, d, t, f in b if c == d and s < f and t < e}
    got = intervals.overlap_pairs(frame(spark, a), frame(spark, b).withColumnRenamed("id", "j"), 512).select("id", "j").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_track_mean_ignores_a_record_at_zero(spark):
    left = spark.createDataFrame([(1, "x", 5, 9), (2, "x", 50, 60)], "id long, contig string, s long, e long")
    track = spark.createDataFrame([("x", 0, 9, 1.0), ("x", 5, 7, 3.0)], "contig string, s long, e long, score double")
    assert {r.id: r["mean"] for r in sweeps.track_mean(left, track, "id", "score").collect()} == {1: 3.0, 2: 0.0}


def test_genotype_call_at_the_limits(spark):
    row = spark.range(1).select(*[evidence.genotype_call(F.lit(a), F.lit(b), d).alias(str(k)) for k, (a, b, d) in enumerate([(17, 3, 10), (3, 17, 10), (9, 0, 10), (10, 0, 10), (5, 5, 10), (0, 10, 10)])]).first()
    # doses 0.3 (as a double slightly above), 1.7, too shallow, 0, 1, 2
    assert list(row)[2:] == ["./.", "0/0", "0/1", "1/1"]


def test_sequence_functions(spark):
    df = spark.createDataFrame([("AAAACGTN",), ("",), (None,)], "q string")
    q = F.col("q")
    rows = df.select(seqs.reverse_complement(seqs.reverse_complement(q)).alias("rc"), seqs.homopolymer(q, "A").alias("h"), seqs.poly_at_fraction(q).alias("f"), seqs.locate_first(q, "CG").alias("l")).collect()
    assert [tuple(r) for r in rows] == [("AAAACGTN", 3, 0.5, 4), ("", 0, 0.0, None), (None, 0, 0.0, None)]


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">A:B x\nACG\nT\n>C\nGG\n")
    assert sorted(map(tuple, text.read_fasta(spark, str(tmp_path / "a.fa")).collect())) == [("A:B", "ACGT"), ("C", "GG")]
    (tmp_path / "a.bed").write_text("#c\nx 1 5 n\nx bad 3\ny\t2\t9\n")
    assert [tuple(r) for r in text.read_bed(spark, str(tmp_path / "a.bed")).orderBy("contig").collect()] == [("x", 1, 5, ["n"]), ("y", 2, 9, [])]
    (tmp_path / "a.fai").write_text("x\t100\ny\t5\nz\t100\n")
    assert [r.contig for r in text.read_fai(spark, str(tmp_path / "a.fai"), ["z"], 5).collect()] == ["x"]
    text.write_table(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "t"))
    assert [tuple(r) for r in text.read_table(spark, str(tmp_path / "t"), "a int, b string").collect()] == [(1, None)]


@pytest.mark.parametrize("parts", [1, 7])
def test_windows_and_depth_over_range_partitions(spark, parts):
    rows = some(300, 8)
    by = lambda c: sorted((s, i) for i, d, s, _ in rows if d == c)
    want = {(c, k // 40, g[0][0], g[-1][0], len(g)) for c in "xy" for k in range(0, len(by(c)), 40) if (g := by(c)[k : k + 40])}
    got = clustering.equal_count_windows(frame(spark, rows).repartition(parts), 40).select("contig", "window", "start", "end", "rows").collect()
    assert set(map(tuple, got)) == want
    deep = {c: [sum(d == c and s <= p < e for _, d, s, e in rows) > 3 for p in range(3200)] for c in "xy"}
    want = set()
    for c, d in deep.items():
        start = None
        for p, now in enumerate(d):
            if now and start is None:
                start = p
            if not now and start is not None:
                if p - start >= 5:
                    want.add((c, start, p))
                start = None
    got = evidence.depth_segments(frame(spark, rows).repartition(parts), 3, 5).select("contig", "start", "end").collect()
    assert set(map(tuple, got)) == want and len(got) == len(want)
    none = frame(spark, [])
    assert clustering.equal_count_windows(none, 3).count() == evidence.depth_segments(none, 1, 1).count() == clustering.overlap_dedup(none).count() == 0


def test_isolation_finds_what_lies_apart(spark):
    r = random.Random(9)
    rows = [(i, "a" if i % 2 else None, r.gauss(0, 1), r.gauss(5, 1), False) for i in range(600)] + [(1000, "a", 30.0, -20.0, False), (1001, None, 30.0, -20.0, True), (1002, "z", None, 1.0, False)]
    df = spark.createDataFrame(rows, "id long, kind string, x double, y double, known boolean")
    run = lambda d: {q.id: (q.score, q.pred) for q in outliers.isolation_scores(d, "kind", ["x", "y"], ["id"], F.lit(True), F.col("known")).collect()}
    got = run(df.repartition(5))
    assert len(got) == len(rows) and got == run(df.repartition(2))
    assert got[1000][1] == -1 and got[1001][1] == 1 and got[1002] == (0.5, 1)
    assert min(got[1000][0], got[1001][0]) >= max(v[0] for k, v in got.items() if k < 1000)
    assert run(df.limit(0)) == {}


def test_rank_test_by_pairs():
    r = random.Random(10)
    for _ in range(20):
        a, b = ([r.randrange(6) for _ in range(r.randrange(1, 30))] for _ in range(2))
        u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
        n, m, both = len(a), len(b), a + b
        var = n * m / 12 * (n + m + 1 - sum(both.count(v) ** 3 - both.count(v) for v in set(both)) / ((n + m) * (n + m - 1)))
        want = math.erfc(max(0, abs(u - n * m / 2) - 0.5) / math.sqrt(2 * var)) if var > 1e-9 else 1.0
        assert abs(outliers.mann_whitney(np.array(a), np.array(b)) - want) < 1e-9
    assert outliers.mann_whitney(np.array([]), np.array([1])) == outliers.mann_whitney(np.array([2, 2]), np.array([2])) == 1.0


def test_vcf_and_fastq(spark, tmp_path):
    sites = spark.createDataFrame([(1, "x", 20, "L1"), (2, "x", 5, None)], "tid long, contig string, pos long, class string")
    calls = spark.createDataFrame([(1, "s2", "0/1", 1.0)], "tid long, sample string, gt string, dose double")
    names = text.vcf_samples(spark.createDataFrame([("s2",), ("s1",), ("s1",), (None,)], "sample string"))
    text.write_vcf(text.vcf_lines(sites, calls, names, F.col("class")), names, str(tmp_path / "v"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "v").glob("part-*"))).splitlines()
    assert lines[0] == "##fileformat=VCFv4.1" and lines[1].split("\t")[-3:] == ["FORMAT", "s1", "s2"]
    assert lines[2:] == ["x\t5\t.\tREF\tALT\t100\tPASS\t.\tGT:DS\t./.:0.000\t./.:0.000", "x\t20\t.\tREF\tALT\t100\tPASS\tL1\tGT:DS\t./.:0.000\t0/1:1.000"]
    text.write_fastq(spark.createDataFrame([("SR", "r1", "ACG", None), ("DR", "r2", "T", "#")], "kind string, name string, seq string, qual string"), str(tmp_path / "q"))
    assert "".join(p.read_text() for p in (tmp_path / "q/kind=SR").glob("part-*")) == "@r1\nACG\n+\nIII\n"
