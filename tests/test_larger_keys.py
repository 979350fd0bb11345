"""Queries against their SQL on small tables with what larger ones have: places that many rows share, means at a limit, long runs."""

import datetime
import functools
import hashlib
import itertools

import duckdb
import pytest

from pyspark.sql import functions as F

from seqloom.functions import sequences as seqs
from seqloom.plans import calls, callsets, catalogue, files, more, ordered, records  # noqa: F401  the others add their queries to the catalogue
from tests.test_catalogue import same

START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def tables(spark, tmp_path):
    """Writes orders (orderkey, custkey, priority) and events (id, second, user, type, value, k), and compares a query with its SQL there."""

    def compare(name, orders=(), events=(), sql=True):
        con = duckdb.connect()
        con.sql("create table orders (o_orderkey bigint, o_custkey bigint, o_orderstatus varchar, o_totalprice double, o_orderdate timestamp, o_orderpriority varchar)")
        con.sql("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
        for k, c, p in orders:
            con.execute("insert into orders values (?, ?, 'F', 1.0, ?, ?)", [k, c, START, p])
        for i, s, u, t, v, k in events:
            con.execute("insert into events values (?, ?, ?, ?, ?, ?)", [i, s if s is None else START + datetime.timedelta(seconds=s), u, t, v, f'{{"k": {k}}}'])
        for t in ("orders", "events"):
            con.sql(f"copy {t} to '{tmp_path}/{t}.parquet'")
        got = catalogue.QUERIES[name](spark, str(tmp_path)).toPandas()
        if sql:
            same(got, con.sql(catalogue.SQL[name]).df())
        return got

    return compare


def test_variants_of_targets_at_one_place(tables):
    rows = [(6, 3, "5-LOW"), (6 + 2592000, 3, "5-LOW"), (6 + 2 * 2592000, 3, "2-HIGH"), (7, 3, "5-LOW")]
    assert len(tables("variants_read", orders=rows)) == 4


def test_mean_at_the_limit_in_any_order(tables):
    """A group for each order of 0.39, 0.40 and 0.41, whose mean is 0.4: sums of doubles lie on either side of it."""
    orders = list(itertools.permutations([39, 40, 41]))
    ids = [i for i in range(6, 2000, 13) if hashlib.md5(str(i).encode()).hexdigest().count("f") <= 3]  # few N
    rows = [(ids[3 * g + k], 1000 * g + 500, 11 * (k + 1), "click", 30.0, q) for g, order in enumerate(orders) for k, q in enumerate(order)]
    assert sorted(tables("accepted_breakends", events=rows, sql=False)["cluster"]) == list(range(6))


def test_mean_at_the_limit_as_doubles_add_up(tables):
    """Groups of two and three whose mean is 0.4, of which some add up to less in every order, as SQL has it."""
    groups = [(a, 80 - a) for a in range(41)] + [(a, b, 120 - a - b) for a in range(0, 41, 3) for b in range(a, 60, 7)]
    sums = [{functools.reduce(float.__add__, [q / 100.0 for q in order]) / len(g) >= 0.4 for order in itertools.permutations(g)} for g in groups]
    sure = [g for g, verdicts in zip(groups, sums) if len(verdicts) == 1]
    ids = [i for i in range(6, 10000, 13) if hashlib.md5(str(i).encode()).hexdigest().count("f") <= 3]
    rows = [(ids[3 * g + k], 1000 * g + 500, 11 * (k + 1), "click", 30.0, q) for g, group in enumerate(sure) for k, q in enumerate(group)]
    assert len(tables("accepted_breakends", events=rows)) == sums.count({True})


def test_walks_compare_each_prefix_once(spark):
    """Two prefixes from each of seven starts, and no letter by itself in a lambda."""
    df = spark.createDataFrame([("ACGTACGT", "ACGTACGA")], "l string, r string")
    text = lambda c: df.select(c.alias("t"))._jdf.queryExecution().executedPlan().toString()
    longest = text(seqs.longest_duplication(F.col("l"), F.col("r"), F.lit(3), F.lit(3)))
    assert longest.count("regexp_extract(") == 14 and "filter(" not in longest
    assert text(seqs.walked_duplication(F.col("l"), F.col("l"), F.col("r"), F.col("r"))).count("regexp_extract(") == 2


def test_qualities_are_read_once(spark):
    df = spark.createDataFrame([("ACGTACGT", "III#####"), ("AC", None), (None, "IIIIIIII")], "s string, q string")
    got = df.select(seqs.quality_trimmed(F.col("s"), F.col("q")).alias("t"))
    assert [r.t for r in got.collect()] == ["ACG", "AC", None]
    assert got._jdf.queryExecution().executedPlan().toString().count("split(") == 1


def test_free_positions_are_found_once(spark):
    df = spark.createDataFrame([(12, [(2, 4), (4, 5), (6, 9)])], "n int, m array<struct<s:int,e:int>>")
    got = df.select(seqs.uncovered(F.col("n"), F.col("m")).alias("x"))
    assert [tuple(x) for x in got.first().x] == [(0, 1), (10, 11)]
    assert got._jdf.queryExecution().executedPlan().toString().count("exists(") == 1
