"""Sessions of a stream, the cascade and other ordered operators against plain Python."""

import datetime as dt
import hashlib
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from seqloom.functions import sequences as seqs
from seqloom.operators import callset, clustering, quotas, sweeps
from seqloom.streaming.sessions import SessionStream, sessions

EVENTS = "id long, user long, at timestamp, value double"
MINUTE = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)


def arrive(spark, folder, rows):
    spark.createDataFrame([(i, u, None if m is None else MINUTE(m), v) for i, u, m, v in rows], EVENTS).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.05)  # files are taken in the order of their times


def told(df):
    return sorted((r.user if r.user is not None else -1, r.start, r.end, r.n, r.most) for r in df.collect())


@pytest.mark.parametrize("key", [None, "id"])
def test_sessions_late_repeated_and_merging(spark, tmp_path, key):
    folder = str(tmp_path / "in")
    arrive(spark, folder, [(1, 1, 0, 1.0), (2, 1, 5, 2.0), (3, 2, 3, 3.0), (4, None, 2, 9.0), (5, 1, None, 1.0)])
    of = dict(user="user", time="at", gap="10 minutes", delay="20 minutes", key=key, most=F.max("value"))
    stream = SessionStream(spark, folder, spark.createDataFrame([], EVENTS).schema, files_per_batch=1, folder=str(tmp_path / "state"), **of)
    stream.run()
    assert told(stream.closed()) == []  # the watermark is at -15
    arrive(spark, folder, [(2, 1, 5, 2.0), (6, 1, 60, 4.0)])  # a repeat; then the watermark is at 40
    stream.run()
    first = [(-1, MINUTE(2), MINUTE(12), 1, 9.0), (1, MINUTE(0), MINUTE(15), 2 if key else 3, 2.0), (2, MINUTE(3), MINUTE(13), 1, 3.0)]
    assert told(stream.closed()) == first
    again = SessionStream(spark, folder, stream.schema, files_per_batch=1, folder=str(tmp_path / "state"), **of)  # goes on from the state
    arrive(spark, folder, [(7, 1, 52, 5.0), (8, 2, 8, 1.0), (9, 2, 30, 1.0), (10, 2, 31, 2.0)])  # out of order; 8, and 9 whose session ends at 40, are late
    more = [] if key else [(2, MINUTE(31), MINUTE(41), 1, 2.0)]
    assert told(again.close()) == sorted([*first, (1, MINUTE(52), MINUTE(70), 2, 5.0), *more])


def test_stream_equals_batch(spark, tmp_path):
    r, folder = random.Random(4), str(tmp_path / "in")
    rows = [(i, r.randrange(5), r.randrange(3000), float(i)) for i in range(400)]
    for k in range(4):  # in any order; nothing is late as the delay covers all
        arrive(spark, folder, rows[k::4])
    of = dict(user="user", time="at", gap="10 minutes", delay="3 days", most=F.max("value"))
    stream = SessionStream(spark, folder, spark.createDataFrame([], EVENTS).schema, files_per_batch=1, **of)
    want = []
    for u in range(5):
        for i, _, m, v in sorted((x for x in rows if x[1] == u), key=lambda x: x[2]):
            if want and want[-1][0] == u and MINUTE(m) <= want[-1][2]:
                want[-1] = (u, want[-1][1], MINUTE(m + 10), want[-1][3] + 1, max(v, want[-1][4]))
            else:
                want.append((u, MINUTE(m), MINUTE(m + 10), 1, v))
    assert told(stream.close()) == sorted(want)
    assert told(sessions(spark.read.parquet(folder), **of)) == sorted(want)


CALLS = "uuid string, chrom string, be1_breakpos long, be2_breakpos long, be1_sr_count int, be2_sr_count int, dr_count int, _last int"


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 9), (3, 9)])
def test_cascade(spark, seed, parts):
    r = random.Random(seed)
    calls = [(f"u{i:03}", r.choice(["x", "y", None]), a := r.randrange(60), r.choice([a, a + r.randrange(9), r.randrange(60)]), r.randrange(4), 1, r.randrange(5), 0) for i in range(400)]
    held = {}
    for c in sorted(calls, key=lambda c: (c[2], c[0])):
        old, two = held.get((c[1], c[2])), c[2] != c[3]
        if old is None or two and old[2] == old[3] or c[4] + c[5] > old[4] + old[5] or c[6] > old[6]:
            held[c[1], c[2]] = held[c[1], c[3]] = c
    extra = [("n1", "x", None, 3, 1, 1, 1, 0), (None, "x", 3, 3, 9, 9, 9, 0)]
    got = callset.cascaded(spark.createDataFrame(calls + extra, CALLS).repartition(parts), "uuid").collect()
    assert sorted(x.uuid for x in got) == sorted({c[0] for c in held.values()})
    assert callset.cascaded(spark.createDataFrame([], CALLS), "uuid").count() == 0


def spread(n, seed, reach=2000, longest=90):
    r = random.Random(seed)
    rows = [(i, r.choice(["x", "y", None]), s := r.randrange(reach), s + r.choice([0, 1, r.randrange(1, longest)]), r.randrange(6)) for i in range(n)]
    return rows + [(n, "x", None, 5, 1), (n + 1, "x", 5, None, 1), (n + 2, "x", 0, reach, 0)]


ROWS = "id long, contig string, s long, e long, w int"


@pytest.mark.parametrize("seed,parts,pad", [(1, 1, 0), (2, 8, 0), (3, 8, 7)])
def test_any_overlap(spark, seed, parts, pad):
    a, b = spread(300, seed), spread(60, seed + 9, longest=20)[:-1] + [(99, "x", 700, 701, 3)] * 40
    hit = lambda r: any(None not in (*r[1:4], *o[1:4]) and r[1] == o[1] and r[2] - pad < o[3] and o[2] < r[3] + pad for o in b)
    left, right = spark.createDataFrame(a + a[:20], ROWS).repartition(parts), spark.createDataFrame(b, ROWS)
    got = sweeps.any_overlap(left, right, pad=pad).collect()
    assert sorted((r.id, r.hit) for r in got) == sorted((r[0], hit(r)) for r in a + a[:20])
    by_weight = sweeps.any_overlap(left, right.withColumn("w", F.col("w").cast("long")), ("contig", "w"), pad).collect()
    of = lambda r: any(r[4] == o[4] and None not in (*r[1:4], *o[1:4]) and r[1] == o[1] and r[2] - pad < o[3] and o[2] < r[3] + pad for o in b)
    assert sorted((r.id, r.hit) for r in by_weight) == sorted((r[0], of(r)) for r in a + a[:20])
    assert sweeps.without_overlap(left, right.where("false")).count() == len(a) + 20


@pytest.mark.parametrize("seed,parts,window", [(1, 1, 10), (2, 8, 50), (3, 8, 1), (4, 8, 0)])
def test_drop_weaker(spark, seed, parts, window):
    a = [r for r in spread(200, seed)]
    def weaker(r):
        return any(None not in (*r[1:4], *o[1:4]) and r[1] == o[1] and r[2] - window < o[3] and o[2] < r[3] + window and o[4] > r[4] for o in a)
    got = sweeps.drop_weaker(spark.createDataFrame(a, ROWS).repartition(parts), "id", "w", window).collect()
    assert sorted(r.id for r in got) == sorted(r[0] for r in a if not weaker(r))


def test_a_hot_place_is_spread(spark):
    """Half of all rows at one place and one weight: no part has more than a few times its share."""
    rows = spark.range(8000).selectExpr("id", "'x' as contig", "if(id % 2 = 0, 500, id) as s", "if(id % 2 = 0, 500, id) + 3 as e", "cast(id % 5 as int) as w")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        parts = sweeps.ranged(rows.withColumn("_tie", F.xxhash64("id")), ["contig", "s", "_tie"]).groupBy("_part").count().collect()
        assert max(r["count"] for r in parts) < 4 * 8000 / 16
        assert sweeps.drop_weaker(rows, "id", "w", 2).where("s = 500 and w < 4").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def greedy(pairs):
    used, out = (set(), set()), []
    for score, a, b in sorted((-s, a, b) for a, b, s in pairs if None not in (a, b, s)):
        if a not in used[0] and b not in used[1]:
            used[0].add(a)
            used[1].add(b)
            out.append((a, b, -score))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_pairs(spark, seed):
    r = random.Random(seed)
    pairs = [(a := r.randrange(80), a + r.randrange(-6, 7), r.randrange(20) / 4) for _ in range(500)] + [(None, 1, 9.0), (1, None, 9.0), (1, 1, None)]
    want = greedy(pairs)
    df = spark.createDataFrame(pairs + pairs[:30], "a long, b long, score double")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "6"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert sorted(map(tuple, clustering.greedy_pairs(df).collect())) == want  # over six parts
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, clustering.greedy_pairs(df).collect())) == want


@pytest.mark.parametrize("n", [24, 3000])
def test_greedy_rounds_do_not_grow_with_a_chain(spark, tmp_path, n):
    chain = [(i // 2, (i + 1) // 2, float(n - i)) for i in range(n)]  # every pair shares an end with the one before, which is better
    got = clustering.greedy_pairs(spark.createDataFrame(chain, "a long, b long, score double"), f"file://{tmp_path}")
    assert sorted(map(tuple, got.collect())) == greedy(chain)
    assert len(list(tmp_path.glob("scanned*"))) <= 2


def brute_mean(l, track):
    n = total = 0
    for _, c, s, e, w in track:
        if None not in (*l[1:4], c, s, e, w) and l[1] == c and s and l[2] < e and s < l[3]:
            k = sum(1 for p in range(max(s + 1, l[2]), min(e, l[3]) + 1))
            n, total = n + k, total + k * w
    return round(total / n, 9) if n else 0.0


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 8)])
def test_track_mean_and_medians(spark, seed, parts):
    a, track = spread(150, seed, 900)[:-1], [(*x[:4], x[4] / 4) for x in spread(120, seed + 5, 900)] + [(0, "x", 400, 402, 2.5)] * 100 + [(0, "x", 0, 50, 9.0), (0, "y", 4, 9, None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(parts == 1).lower())
    try:
        left, right = spark.createDataFrame(a, ROWS), spark.createDataFrame(track, "id long, contig string, s long, e long, w double").repartition(parts)
        got = {r.id: round(r["mean"], 9) for r in sweeps.track_mean(left, right, "id", "w").collect()}
        assert got == {l[0]: brute_mean(l, track) for l in a}
        values = {}
        for t in track:
            if t[4] is not None:
                values.setdefault(t[1], []).append(t[4])
        assert {r.contig: r.m for r in sweeps.medians(right, ["contig"], "w", "m").collect()} == {k: statistics.median(v) for k, v in values.items()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("few", [1000, 3])
def test_first_by_hash(spark, few):
    r = random.Random(6)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), r.choice([True, False, None])) for i in range(3000)] + [(1, "a", True)] * 5
    groups, quota = {}, []
    for i, g, k in rows:
        groups.setdefault((g, k), []).append(i)
    quota = [(g, k, n) for (g, k), n in zip(groups, [5, 0, 700, 10_000, 1, 30, 2, 9], strict=False)]
    h = lambda i: (int(hashlib.md5(f"1:{i}".encode()).hexdigest()[:15], 16), i)
    want = sorted(((g, k, i) for g, k, n in quota for i in sorted(groups[g, k], key=h)[:n]), key=str)
    df = spark.createDataFrame(rows, "id long, g string, k boolean")
    got = quotas.first_by_hash(df, spark.createDataFrame(quota, "g string, k boolean, quota long"), ["g", "k"], "id", few=few)
    assert sorted(((x.g, x.k, x.id) for x in got.collect()), key=str) == want


def test_proportional_subsample(spark):
    rows = [(i, "a", i % 3 == 0) for i in range(100)] + [(i, "b", True) for i in range(100, 110)]
    got = quotas.proportional_subsample(spark.createDataFrame(rows, "id long, g string, k boolean"), "g", "k", 50, "id").groupBy("g", "k").count().collect()
    assert {(x.g, x.k): x["count"] for x in got} == {("a", True): int(34 / 100 * 50), ("a", False): int(66 / 100 * 50), ("b", True): 10}


def walked(l, r, i, j, most=100):
    best = ""
    for x, y in seqs.STARTS:
        p, q, back, on = i + x, j + y, 0, 0
        if not (0 <= p < len(l) and 0 <= q < len(r)):
            continue
        while p - back >= 0 and q - back >= 0 and l[p - back] == r[q - back]:
            back += 1
        while p + on < len(l) and q + on < len(r) and l[p + on] == r[q + on]:
            on += 1
        text = l[p - back + 1 : p + on] if back and on and back < most and on < most else ""
        best = text if len(text) > len(best) else best
    return best or "NA"


def test_longest_duplication(spark):
    r = random.Random(8)
    seq = lambda n: "".join(r.choice("AC") for _ in range(n))
    rows = [(k, seq(r.randrange(1, 20)), seq(r.randrange(1, 20)), r.randrange(0, 12), r.randrange(0, 12)) for k in range(300)] + [(300, "A" * 250, "A" * 250, 120, 120), (301, "A" * 150 + "C", "A" * 150 + "C", 99, 99)]
    df = spark.createDataFrame(rows, "id long, l string, r string, i int, j int")
    got = {x.id: x.t for x in df.select("id", seqs.longest_duplication(F.col("l"), F.col("r"), F.col("i"), F.col("j")).alias("t")).collect()}
    assert got == {k: walked(a, b, i, j) for k, a, b, i, j in rows}
