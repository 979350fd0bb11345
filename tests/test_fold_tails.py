"""Folds read the rows of a part's last group to know its state; the cascade with near, far and backward ends."""

import random

import pyarrow as pa
import pytest

from seqloom.operators import callset, clustering

CALLS = "uuid string, chrom string, be1_breakpos long, be2_breakpos long, be1_sr_count int, be2_sr_count int, dr_count int"


def test_state_is_known_from_the_last_group(spark):
    rows = [(f"c{i % 40:02}" if i % 40 else None, i) for i in range(4000)]
    seen = spark.sparkContext.accumulator(0)

    def step(state, row):
        seen.add(1)
        contig, i = row
        n = state[1] + 1 if state and state[0] == contig else 1
        return [contig, n], (contig, i, n)

    schema = pa.schema([("contig", pa.string()), ("i", pa.int64()), ("n", pa.int64())])
    parts = clustering.ranged(spark.createDataFrame(rows, "contig string, i long"), ["contig", "i"])
    got = clustering.folded(parts, ["contig", "i"], step, schema).collect()
    assert sorted((x.contig or "", x.i, x.n) for x in got) == sorted((c or "", i, i // 40 + 1) for c, i in rows)
    assert seen.value < 2 * len(rows)


@pytest.mark.parametrize("seed,near,back", [(1, 1000, 0), (2, 4, 0), (3, 4, 60), (4, 0, 60)])
def test_cascade_of_near_and_far_ends(spark, seed, near, back):
    r = random.Random(seed)
    calls = [(f"u{i:04}", r.choice(["x", "y", None]), a := r.randrange(300), a + r.choice([0, 0, 2, r.randrange(-back, 30)]), r.randrange(6), 1, r.randrange(7)) for i in range(900)]
    held = {}
    for c in sorted(calls, key=lambda c: (c[2], c[0])):
        old, two = held.get((c[1], c[2])), c[2] != c[3]
        if old is None or two and old[2] == old[3] or c[4] > old[4] or c[6] > old[6]:
            held[c[1], c[2]] = held[c[1], c[3]] = c
    got = callset.cascaded(spark.createDataFrame(calls, CALLS).repartition(7), "uuid", near).collect()
    assert sorted(x.uuid for x in got) == sorted({c[0] for c in held.values()})
