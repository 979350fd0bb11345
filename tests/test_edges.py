"""Nulls, ties, repeated rows, empty tables and clashing names at operators on alignments, breakends and calls."""

from pyspark.sql import functions as F

from seqloom.functions import sequences as seqs
from seqloom.operators import alignments as aln
from seqloom.operators import breakends as brk
from seqloom.operators import callset, evidence

ALIGNED = "id long, qname string, flag int, contig string, s long, e long, seq string, sample string, mate_contig string, mate_s long, dir string"


def test_mapped_mates(spark):
    rows = [
        (1, "q", 65, "c", 10, 20, "AC", "a", "c", 50, "x"), (2, "q", 129, "c", 45, 60, "GT", "a", "c", 10, "x"), (3, "q", 129, "c", 50, 60, "GG", "a", "c", 10, "x"),
        (4, "q", 385, "c", 40, 60, "GG", "a", "c", 10, "x"), (5, "q", 129, "c", 50, 60, "GG", "b", None, None, "x"), (6, None, 65, "c", 10, 20, "AC", "a", "c", 50, "x"), (7, "r", None, "c", 1, 9, "A", "a", "c", 1, "x"),
    ]
    df = spark.createDataFrame(rows + rows[:1], ALIGNED)
    got = {(r.id, r.mate_id) for r in aln.mapped_mates(df).collect()}
    assert got == {(1, 2), (2, 1), (3, 1), (4, 1)}  # of 2 and 3 the first by place; 4 is secondary and no mate
    assert aln.mapped_mates(df.where("false")).count() == 0


def test_break_groups_and_targets(spark):
    members = spark.createDataFrame([("c", 1, 5, "left", 9, 0.1, "a")] * 3 + [("c", 1, 5, "left", 2, 0.4, "b"), (None, None, None, None, None, None, None)], "contig string, cluster long, breakpos long, dir string, clipped int, p double, sample string")
    got = sorted(map(tuple, brk.break_groups(members).collect()), key=str)
    assert got == sorted([("c", 1, 5, "left", 4, 9, 2, 0.1, 2), (None, None, None, None, 1, None, None, None, 0)], key=str)
    assert brk.break_groups(members.where("false")).count() == 0
    clusters = spark.createDataFrame([("c", 1, 5, 9), ("c", 2, 9, 9), (None, 3, 5, 9), ("d", 4, 5, 9)], "contig string, cluster long, s long, e long")
    targets = spark.createDataFrame([("c", 8, 10), (None, 0, 99), ("d", None, 99)], "contig string, s long, e long")
    assert sorted(r.cluster for r in brk.not_in_targets(clusters, targets).collect()) == [3, 4]


def test_insertions_without_arrays(spark):
    df = spark.createDataFrame([(1, [30], 5, 5, ["a"], ["g1|x"], 0.5), (2, [30], 5, 5, ["a"], ["g2|x"], 0.5), (3, [30], 5, 5, None, None, None), (4, None, 5, 5, ["a"], ["g1"], 0.5), (5, [30], 5, 3, ["a"], ["g1"], 0.5)], "id int, mapqs array<int>, num_sr int, most_sr_of_sample int, samples array<string>, groups array<string>, mappability double")
    kept = lambda **k: [r.id for r in df.where(callset.insertion_passes(**k)).orderBy("id").collect()]
    assert kept() == [1, 2, 3] and kept(least_sr_of_sample=3) == [1, 2, 3, 5]
    assert kept(excluded_groups=["g2"]) == [1, 3] and kept(excluded=["a"]) == [3] and kept(least_mappability=0.4) == [1, 2]


def test_near_reference(spark):
    calls = spark.createDataFrame([(1, "c", 10, 20, "L1,ALU"), (2, "c", 10, 20, "SVA"), (3, "d", 10, 20, "ALU"), (4, None, 10, 20, "L1"), (5, "c", 10, 20, "NA"), (6, "c", 10, 20, None)], "id int, contig string, s long, e long, Superfamily string").withColumn("near", F.lit("clash"))
    known = spark.createDataFrame([("c", 19, 30, "ALU", 5.0), ("c", 25, 30, "SVA", 5.0), ("c", 900, 901, "L1", 5.0)], "contig string, s long, e long, family string, divergence double")
    near = lambda **k: {r.id: r.near for r in callset.near_reference(calls.drop("near"), known, "id", ["L1", "ALU", "SVA"], **k).collect()}
    assert near() == {1: True, 2: False, 3: True, 4: True, 5: False, 6: False}  # 3 and 4: their tracks lack the contig
    assert near(pad=6)[2] and not near(most_divergence=5.0)[1]


def test_samples_of_any_number(spark):
    reads = spark.range(2500).select(F.col("id").cast("string").alias("sample")).unionByName(spark.createDataFrame([(None,), ("1",)], "sample string"))
    got = evidence.of_every_sample(spark.createDataFrame([(1,), (2,)], "tid long"), reads)
    assert got.count() == 2 * 2501 and got.distinct().count() == 2 * 2501


def test_chopped_and_shares(spark):
    df = spark.createDataFrame([("ACGTAC", 1, 2, 5, 90, "A-G", "aCg"), ("ACGTAC", 1, 9, 5, 100, "---", "AAA"), ("ACGTAC", 1, 2, 1, 90, "", ""), (None, 1, 1, 5, 9, None, "A")], "v string, l int, r int, s int, e int, q string, t string")
    got = df.select(seqs.chopped(F.col("v"), F.col("l"), F.col("r"), F.col("s"), F.col("e"), F.lit(100)).alias("v"), seqs.share_matched(F.col("q"), F.col("t")).alias("m")).collect()
    assert [r.v for r in got] == ["CGT", "CGTAC", "ACGT", None] and [r.m for r in got] == [1.0, None, None, None]
