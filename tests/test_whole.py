"""Operators whose results have a row for everything that was asked, and folds that cross range partitions."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import clustering, evidence, outliers


def test_genotypes_of_every_site_and_sample(spark):
    reads = spark.createDataFrame([("x", 90, 400, "a", 20), ("x", 100, 150, "a", 20), ("y", 0, 9, "b", 3)], "contig string, s long, e long, sample string, mapq int")
    sites = spark.createDataFrame([(1, "x", 100, 300), (2, "y", 500, 800)], "tid long, contig string, s long, e long")
    got = evidence.genotype_counts_all(reads, sites)
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1, 1), (1, "b", 0, 0), (2, "a", 0, 0), (2, "b", 0, 0)]
    calls = got.select("tid", "sample", evidence.genotype_call(F.col("alt"), F.col("ref"), 1).alias("gt")).collect()
    assert {(c.tid, c.sample): c.gt for c in calls} == {(1, "a"): "0/1", (1, "b"): "./.", (2, "a"): "./.", (2, "b"): "./."}


@pytest.fixture
def many_parts(spark):
    held = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("dense", [True, False])
def test_folds_stream_one_stretch_over_many_parts(spark, many_parts, dense):
    r = random.Random(11)
    rows = [(i, r.choice("xy"), s := r.randrange(400 if dense else 9000), s + 1 + r.randrange(40)) for i in range(600)]
    rows += [(1000 + i, "z", 77, 90 + i % 3) for i in range(200)]  # one locus over several parts
    df, ordered = spark.createDataFrame(rows, "id long, contig string, s long, e long"), sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    kept, last, cluster, members, median, head, contig = [], None, {}, [], 0, None, None
    for i, c, s, e in ordered:
        if last and last[1] == c and min(e, last[3]) - max(s, last[2]) > 0:
            if e - s > last[3] - last[2]:
                kept[-1] = last = (i, c, s, e)
        else:
            last = (i, c, s, e)
            kept.append(last)
        if contig == c and members and abs(median - s) <= 20:
            members.append(s)
            median = sorted(members)[len(members) // 2]
        else:
            members, median, head, contig = [s], (s + e) // 2, i, c
        cluster[i] = head
    assert clustering.ranged(df, ["contig", "s", "id"]).select("_part").distinct().count() > 4
    dedup = clustering.overlap_dedup(df)
    assert sorted(map(tuple, dedup.select("id", "contig", "s", "e").collect())) == sorted(kept)
    split = clustering.median_clusters(df.select("id", "contig", F.col("s").alias("pos"), ((F.col("s") + F.col("e")) / 2).cast("long").alias("mid")), 20, 40)
    assert {x.id: x.cluster for x in split.collect()} == cluster
    # no task holds a stretch: rows stream, and are not gathered into a group or an array
    assert "collect_list" not in plan(dedup) and "FlatMapGroups" not in plan(split)


def test_isolation_forests_of_many_groups(spark):
    r = random.Random(2)
    rows = [(i, f"g{i % 70}" if i % 70 else None, r.gauss(0, 1), i % 70 != 5) for i in range(1400)]
    df = spark.createDataFrame(rows, "id int, g string, x double, t boolean")
    score = lambda **k: {x.id: (x.score, x.pred) for x in outliers.isolation_scores(df, "g", ["x"], ["id"], F.col("t"), F.lit(False), trees=10, **k).collect()}
    few, many = score(most_groups=100), score(most_groups=5, slot=7)
    assert len(few) == 1400 and all(many[i][0] == pytest.approx(v[0]) and many[i][1] == v[1] for i, v in few.items()) and all(few[i] == (0.5, 1) for i in range(5, 1400, 70))
