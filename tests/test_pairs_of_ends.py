"""Greedy pairs of ends that lie near each other, against plain Python and without a table of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import sequences as seqs
from seqloom.operators import clustering, intervals
from seqloom.plans import catalogue

ENDS = "contig string, dir string, id long, pos long, n int"


def greedy(pairs):
    used, out = (set(), set()), []
    for score, a, b in sorted((-s, a, b) for a, b, s in pairs):
        if a not in used[0] and b not in used[1]:
            used[0].add(a)
            used[1].add(b)
            out.append((a, b, -score))
    return sorted(out)


def worth(left, right):
    return np.asarray(left["n"] + right["n"] - np.abs(left["pos"] - right["pos"]), float)


@pytest.mark.parametrize("seed,limits", [(1, {}), (2, {"most": 60}), (3, {"most_pairs": 1200}), (4, {"most": 0})])
def test_near_ends(spark, seed, limits):
    r = random.Random(seed)
    rows = [(r.choice("xxy"), r.choice(["left", "right"]), i, r.choice([r.randrange(-900, 2500), 700 + r.randrange(9)]), r.randrange(6)) for i in range(900)]
    rows += [("x", "left", 5, p, 9) for p in (100, 600, 1800)] + [("y", "right", 8, 40, 9), ("x", "right", 8, 30, 9), ("x", "left", None, 3, 9), (None, "left", 5000, 3, 9), ("x", None, 5001, 3, 9), ("x", "right", 5002, None, 9)]
    whole = [x for x in rows if None not in x]
    pairs = [(a[2], b[2], float(a[4] + b[4] - abs(a[3] - b[3]))) for a in whole if a[1] == "left" for b in whole if b[1] == "right" and a[0] == b[0] and abs(a[3] - b[3]) <= 20]
    asked = []

    def scored(ends):
        asked.append(ends.count())
        left, right = (ends.where(F.col("dir") == d).select("contig", F.col("pos").alias(p), F.col("id").alias(c), F.col("n").alias(f"n_{c}")) for d, p, c in (("left", "s", "a"), ("right", "q", "b")))
        return left.join(right, "contig").where("abs(s - q) <= 20").select("contig", "s", "a", "b", (F.col("n_a") + F.col("n_b") - F.abs(F.col("s") - F.col("q"))).cast("double").alias("score"))

    got = clustering.greedy_near(spark.createDataFrame(rows, ENDS).repartition(5), 20, worth, scored, ["n"], **limits)
    assert sorted(map(tuple, got.collect())) == greedy(pairs)
    assert limits or sum(asked) < len(whole) / 2
    assert clustering.greedy_near(spark.createDataFrame([], ENDS), 20, worth, scored, ["n"]).count() == 0


def test_breakends_make_no_table_of_pairs(spark, tmp_path, monkeypatch):
    rows = spark.range(4000).select(
        F.col("id").alias("event_id"), F.expr("timestampadd(SECOND, int(id * 37 % 5000), TIMESTAMP_NTZ'2024-01-02 00:00:00')").alias("ts"), (F.col("id") % 7).alias("user_id"),
        F.when(F.col("id") % 3 == 0, "click").otherwise("view").alias("event_type"), F.when(F.col("id") % 50 > 0, (F.col("id") * 13 % 40).cast("double")).alias("value"), F.concat(F.lit('{"k": '), F.col("id") % 101, F.lit("}")).alias("props"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    want = sorted(map(tuple, clustering.greedy_pairs(catalogue.breakend_pair_scores(spark, str(tmp_path)), f"file://{tmp_path}/work").collect()))
    made, join = [], intervals.overlap_pairs

    def counting(*args, **kwargs):
        out = join(*args, **kwargs)
        made.append(out.count())
        return out

    monkeypatch.setattr(intervals, "overlap_pairs", counting)
    assert sorted(map(tuple, catalogue.breakend_greedy_pairs(spark, str(tmp_path)).collect())) == want
    assert len(want) > 1000 and sum(made) < 4000


def test_scores_of_arrays_are_those_of_columns(spark):
    rows = spark.range(-3, 3000).select((F.col("id") * 17 % 101 + 101).alias("d"), F.col("id").alias("o")).withColumn("d", F.col("d") % 101)
    score = F.round(seqs.breakend_score(F.col("d").cast("double"), F.greatest(F.lit(0), "o").cast("double"), F.col("o") % 10, F.lit(3)), 6)
    told = rows.select("d", "o", (F.col("o") % 10).alias("n"), score.alias("x")).toPandas()
    assert (seqs.breakend_scores(told["d"].to_numpy(), told["o"].to_numpy(), told["n"].to_numpy(), np.int32(3)) == told["x"].to_numpy()).all()
