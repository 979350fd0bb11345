"""Ordered clustering: gap clusters over range partitions, evolving-median clusters, overlap de-duplication,
greedy pairing, and windows of equal counts.

Null is a contig of its own, the first. Rows with a null start, end or position take part in nothing and are left out of
results, except that gap_clusters gives them a cluster by their place (nulls first). Other columns pass through or
are ignored; names that begin with an underscore are taken by these operators.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.scratch import saved, shared_folder


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df dealt by range of `order`, with the number of its part. Written out, so that parts stay as they are."""
    folder = shared_folder(df.sparkSession)
    return saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), folder, "ranged")


def with_previous(parts: DataFrame, order: list[str]) -> DataFrame:
    """Adds _prev, the struct of the row before in the order over all parts: a lag in each part, whose first row
    takes the last row of the nearest part below (one row a part is gathered for that)."""
    row = F.struct(*order)
    lasts = parts.groupBy("_part").agg(F.max(row).alias("_last"))
    below = lasts.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_below"))
    in_part = Window.partitionBy("_part").orderBy(*order)
    return parts.join(below, "_part").withColumn("_prev", F.coalesce(F.lag(row).over(in_part), "_below")).drop("_below")


def gap_clusters(df: DataFrame, spacing: int, key: str = "id") -> DataFrame:
    """Adds cluster, the key of its first row: rows by contig, start, key; a new cluster begins where the contig
    changes or the start lies more than spacing beyond the end of the row before (not of all rows before)."""
    order = ["contig", "s", key, "e"]
    rows = with_previous(ranged(df, order), order)
    new = F.col("_prev").isNull() | ~F.col("_prev.contig").eqNullSafe(F.col("contig")) | F.coalesce(F.col("s") - F.col("_prev.e") > spacing, F.lit(True))
    rows = rows.withColumn("_head", F.when(new, F.struct(*order)))
    heads = rows.groupBy("_part").agg(F.max("_head").alias("_h"))
    open_head = heads.select("_part", F.max("_h").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_open"))
    here = F.max("_head").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(open_head, "_part").withColumn("cluster", F.coalesce(here, "_open")[key]).drop("_part", "_prev", "_head", "_open")


def cluster_summary(clustered: DataFrame, least: int, key: str = "id") -> DataFrame:
    """One row per cluster of at least `least` rows: extent (the end is that of the last row), strand inferred
    from first and last row against their mates, members, samples."""
    row = F.struct("s", key, "e", "strand", "mate_strand")
    out = clustered.groupBy("contig", "cluster").agg(F.min(row).alias("f"), F.max(row).alias("l"), F.count(F.lit(1)).alias("n"), F.count_distinct("sample").alias("samples"))
    same = lambda x: F.col(f"{x}.strand") == F.col(f"{x}.mate_strand")
    strand = F.when(same("f") & same("l"), "-").when(~same("f") & ~same("l"), "+").otherwise("NA")
    return out.where(F.col("n") >= least).select("contig", "cluster", F.col("f.s").alias("start"), F.col("l.e").alias("end"), strand.alias("strand"), "n", "samples")


def listed(column: pa.Array) -> list:
    """The Python values of a column; whole numbers and texts without a detour."""
    plain = pa.types.is_string(column.type) or pa.types.is_integer(column.type) and not column.null_count
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


def folded(parts: DataFrame, columns: list[str], step: Callable, schema: pa.Schema, close: Callable | None = None) -> DataFrame:
    """Ordered fold over the rows (columns, in their order) of all range partitions: a part streams through one
    task, which holds a state of constant size and no group of rows.

    step(state, row) gives the next state and what to return, a row, a list of rows or None, close(state) the last rows
    of all; a state is None at first and goes through JSON. The first of the columns is a group: its first row gives the same next state
    whatever other group's state it meets. Each part's last state enters the next part. So that state is known from the rows of
    the part's last group, which run from no state first, then those of parts that have one group alone and whose entering state has
    changed, until none has; one state a part is gathered for that. Then all rows run once.
    """
    group = F.struct(columns[0])
    spans = parts.groupBy("_part").agg(F.max(group).alias("_group"), F.min(group).eqNullSafe(F.max(group)).alias("_one"))
    gathered = spans.collect()
    tails = parts.join(F.broadcast(parts.sparkSession.createDataFrame(gathered, spans.schema)), "_part").where(F.col(columns[0]).eqNullSafe(F.col(f"_group.{columns[0]}"))).drop("_group", "_one")
    alone = {r["_part"] for r in gathered if r["_one"]}

    def over(df: DataFrame, entering: dict, last: int | None, out: pa.Schema, kind: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, state, rows, ends = None, None, [], []
            batch_of = lambda got: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got, strict=True), out.types, strict=True)], schema=out)
            for batch in batches:
                for p, *row in zip(*map(listed, batch.columns), strict=True):
                    if p != part:
                        if part is not None:
                            ends.append((part, json.dumps(state)))
                        part, state = p, json.loads(entering.get(p, "null"))
                    state, made = step(state, row)
                    if made is not None:
                        rows += made if isinstance(made, list) else [made]
                if last is not None and rows:
                    yield batch_of(rows)
                rows = []
            if part is not None:
                ends.append((part, json.dumps(state)))
            if last is None and ends:
                yield batch_of(ends)
            if last is not None and part == last and close:
                made = close(state)
                if made:
                    yield batch_of(made if isinstance(made, list) else [made])

        return df.repartition("_part").sortWithinPartitions("_part", *columns).select("_part", *columns).mapInArrow(run, kind)

    ends_schema, ends, entering, changed = pa.schema([("part", pa.int32()), ("state", pa.string())]), {}, {}, None
    while changed is None or changed:
        again = tails if changed is None else tails.where(F.col("_part").isin(changed))
        ends |= {r.part: r.state for r in over(again, entering, None, ends_schema, "part int, state string").collect()}
        order = sorted(ends)
        now = {p: ends[before] for before, p in zip(order, order[1:], strict=False)}
        changed = [p for p in now if p in alone and now[p] != entering.get(p)]
        entering = now
    kind = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in schema)
    return over(parts, entering, max(ends, default=-1), schema, kind)


def median_clusters(df: DataFrame, distance: int, longest: int, key: str = "id") -> DataFrame:
    """contig, key, cluster by an evolving median of break positions (contig, pos, mid).

    In order of position, a row joins the open cluster unless it lies more than distance from its median: the
    first member's mid, later the upper median of the members' positions. The open cluster is known by how many
    members lie at each position from the median on, at most distance + 1 positions however many rows; the
    longest row does not matter.
    """

    def step(state, row):
        contig, pos, k, mid = row
        if state is None or state[0] != contig or abs(state[2] - pos) > distance:
            return [contig, k, mid, 1, 0, [[pos, 1]]], (contig, k, k)
        _, head, _, n, before, at = state
        if at[-1][0] == pos:
            at[-1][1] += 1
        else:
            at.append([pos, 1])
        n += 1
        while before + at[0][1] <= n // 2:
            before += at.pop(0)[1]
        return [contig, head, at[0][0], n, before, at], (contig, k, head)

    columns = ["contig", "pos", key, "mid"]
    df = df.where("pos is not null and mid is not null")
    schema = pa.schema([("contig", pa.string()), (key, pa.int64()), ("cluster", pa.int64())])
    return folded(ranged(df.select(columns), columns), columns, step, schema)


def overlap_dedup(df: DataFrame, key: str = "id") -> DataFrame:
    """Ordered fold per contig: of a row and the one kept last, if they overlap, the longer stays (ties: the one
    kept); else both. Rows stream over range partitions; only the one kept last is held."""

    def result(kept):
        contig, s, k, e = kept
        return contig, s, e, k

    def step(kept, row):
        if kept is None:
            return row, None
        if kept[0] == row[0] and min(kept[3], row[3]) - max(kept[1], row[1]) > 0:
            return (row if row[3] - row[1] > kept[3] - kept[1] else kept), None
        return row, result(kept)

    columns = ["contig", "s", key, "e"]
    df = df.where("s is not null and e is not null")
    schema = pa.schema([("contig", pa.string()), ("s", pa.int64()), ("e", pa.int64()), (key, pa.int64())])
    return folded(ranged(df.select(columns), columns), columns, step, schema, result)


def greedy_pairs(pairs: DataFrame, folder: str | None = None, place: list[str] | None = None) -> DataFrame:
    """One-to-one pairs (a, b, score) by falling score (ties: least a, then b), each a and each b used once; pairs with
    a null among them take no part, of repeated pairs one is taken.

    Pairs are dealt by range of `place` (columns by which pairs with common ends are near each other; by default a),
    and each part is scanned once by falling score. A pair is decided where it stands if its ends have no pairs in other
    parts, or if it is the best that those ends have anywhere; else it waits, and with it all later pairs of its
    ends in its part. What waits is dealt anew, less the pairs whose ends have been taken elsewhere. A chain of any
    length within a part takes one round; rounds grow with the number of parts that a chain runs through at most.
    """
    folder, place = folder or shared_folder(pairs.sparkSession), place or ["a"]
    left = pairs.select("a", "b", "score", F.struct(*place).alias("_place")).where("a is not null and b is not null and score is not null")
    number = dict(left.dtypes)["score"]
    kind = f"a {dict(left.dtypes)['a']}, b {dict(left.dtypes)['b']}, score {number}, _place {left.schema['_place'].dataType.simpleString()}, taken boolean"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, used, waiting = None, (set(), set()), (set(), set())
        for batch in batches:
            keep, taken = [], []
            for i, (p, a, b, sure_a, sure_b) in enumerate(zip(*(batch[c].to_pylist() for c in ("_part", "a", "b", "_sure_a", "_sure_b")), strict=True)):
                if p != part:
                    part, used, waiting = p, (set(), set()), (set(), set())
                if a in used[0] or b in used[1]:
                    continue
                decided = a not in waiting[0] and b not in waiting[1] and sure_a and sure_b
                for ends in (used if decided else waiting,):
                    ends[0].add(a)
                    ends[1].add(b)
                keep.append(i)
                taken.append(decided)
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept[c] for c in ("a", "b", "score", "_place")] + [pa.array(taken, pa.bool_())], names=["a", "b", "score", "_place", "taken"])

    done, k = [], 0
    while True:
        parts = saved(left.repartitionByRange("_place", "a", "b").withColumn("_part", F.spark_partition_id()), folder, f"dealt{k}")
        rank = F.struct(F.col("score"), -F.col("a"), -F.col("b"))
        known = parts
        for end in ("a", "b"):
            of = parts.groupBy(F.col(end).alias("_end")).agg((F.min("_part") == F.max("_part")).alias("_whole"), F.max(rank).alias("_best"))
            known = known.join(of, known[end] == of["_end"]).withColumn(f"_sure_{end}", F.col("_whole") | (rank == F.col("_best"))).drop("_end", "_whole", "_best")
        scanned = known.repartition("_part").sortWithinPartitions("_part", F.desc("score"), "a", "b").select("_part", "a", "b", "score", "_place", "_sure_a", "_sure_b").mapInArrow(scan, kind)
        scanned = saved(scanned, folder, f"scanned{k}")
        taken, k = scanned.where("taken"), k + 1
        done.append(taken.select("a", "b", "score"))
        left = scanned.where("not taken").drop("taken")
        if left.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)
        for end in ("a", "b"):
            left = left.join(taken.select(end), end, "left_anti")
        left = left.select("a", "b", "score", "_place")


def greedy_near(ends: DataFrame, reach: int, score: Callable, pairs: Callable[[DataFrame], DataFrame], features: list[str], most: int = 100_000, most_pairs: int = 8_000_000) -> DataFrame:
    """What greedy_pairs takes of all pairs of a left and a right end (contig, dir, id, pos, features) of one contig that lie at most
    reach apart, without a row for each pair: a, b, score (double). score(left, right) takes pos and the features of both sides as dicts of
    arrays with an element a pair and gives their scores, NaN for none; pairs(ends) gives the same scored pairs (contig, s, a,
    b, score) as a table. Ends with a null among contig, dir, id and pos take no part.

    Ends are dealt into cells of positions, each with a halo of its neighbours, and a cell's pairs are made and scanned in its task
    alone. A pair is decided there unless a better one may have taken its ends: those at the rim, which have partners out of sight,
    ends whose id repeats, and ends that a better pair joins to such a one. What a cell cannot decide about its own
    ends waits, as does a cell of over `most` ends or `most_pairs` pairs; greedy_pairs takes the rest from what waits.
    """
    size, halo = 20 * reach + 20, 5 * reach + 5
    spark = ends.sparkSession
    rows = ends.where("contig is not null and id is not null and pos is not null and dir in ('left', 'right')").select("contig", "dir", "id", F.col("pos").cast("long").alias("pos"), *features)
    cell = lambda at: F.floor(at / size)
    crowded = rows.groupBy("contig", cell(F.col("pos")).alias("_cell")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    closed = {(r.contig, r["_cell"]) for r in crowded.collect()}  # at most the rows over `most`
    twice = rows.groupBy("dir", "id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("dir", "id", F.lit(True).alias("_twice"))
    flagged = rows.withColumn("_twice", F.lit(False)) if twice.isEmpty() else rows.join(twice, ["dir", "id"], "left").withColumn("_twice", F.col("_twice").isNotNull())
    own = cell(F.col("pos"))
    if closed:
        held = F.broadcast(crowded.select("contig", F.col("_cell").alias("_own"), F.lit(True).alias("_closed")))
        flagged = flagged.withColumn("_own", own).join(held, ["contig", "_own"], "left").drop("_own")
        shut, flagged = flagged.where("_closed").select(*rows.columns), flagged.where("_closed is null").drop("_closed")
    dealt = flagged.withColumn("_cell", F.explode(F.sequence(cell(F.col("pos") - halo), cell(F.col("pos") + halo))))
    of, columns = dict(rows.dtypes), rows.columns
    kind = ", ".join([f"{c} {of[c]}" for c in columns] + [f"b {of['id']}", "score double", "shared boolean"])

    def scan(key: tuple, table: pa.Table) -> pa.Table:
        contig, at = (k.as_py() for k in key)
        low, high = at * size, (at + 1) * size
        seen = low - (0 if (contig, at - 1) in closed else halo), high + (0 if (contig, at + 1) in closed else halo)
        table = table.sort_by("pos")
        sides = [table.filter(pc.equal(table["dir"], d)) for d in ("left", "right")]
        ids, pos = ([s[c].to_numpy() for s in sides] for c in ("id", "pos"))
        mine = [(p >= low) & (p < high) for p in pos]
        wait = [(p - reach < seen[0]) | (p + reach >= seen[1]) | s["_twice"].to_numpy() for p, s in zip(pos, sides, strict=True)]
        used = [np.zeros(len(p), bool) for p in pos]
        first, last = np.searchsorted(pos[1], pos[0] - reach), np.searchsorted(pos[1], pos[0] + reach, "right")
        counts, taken = last - first, []
        if counts.sum() > most_pairs:
            wait = [np.ones(len(p), bool) for p in pos]
        else:
            i = np.repeat(np.arange(len(counts)), counts)
            j = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts - first, counts)
            values = [{c: s[c].to_numpy()[k] for c in ("pos", *features)} for s, k in zip(sides, (i, j), strict=True)]
            worth = np.asarray(score(*values), float)
            del values
            left = ~np.isnan(worth) & ~(wait[0][i] & wait[1][j])
            i, j, worth = i[left], j[left], worth[left]
            while len(i):  # the best pairs first, then what they leave
                n = min(len(i), 4 * sum(map(len, pos)) + 1000)
                best = worth >= np.partition(worth, len(worth) - n)[len(worth) - n]
                x, y, v = i[best], j[best], worth[best]
                order = np.lexsort((ids[1][y], ids[0][x], -v))
                for a, b, w in zip(x[order].tolist(), y[order].tolist(), v[order].tolist(), strict=True):
                    if used[0][a] or used[1][b]:
                        continue
                    if wait[0][a] or wait[1][b]:
                        wait[0][a] = wait[1][b] = True
                    else:
                        used[0][a] = used[1][b] = True
                        if mine[0][a] or mine[1][b]:
                            taken.append((a, b, w))
                left = ~best & ~(used[0][i] | used[1][j] | (wait[0][i] & wait[1][j]))
                i, j, worth = i[left], j[left], worth[left]
        a, b = (np.array([t[k] for t in taken], np.int64) for k in (0, 1))
        made = sides[0].take(a).select(columns)
        made = made.append_column("b", sides[1]["id"].take(b)).append_column("score", pa.array([t[2] for t in taken], pa.float64())).append_column("shared", pa.array(~(mine[0][a] & mine[1][b]), pa.bool_()))
        rest = pa.concat_tables([s.filter(pa.array(m & w & ~u)).select(columns) for s, m, w, u in zip(sides, mine, wait, used, strict=True)])
        return pa.concat_tables([made, rest.append_column("b", pa.nulls(len(rest), made["b"].type)).append_column("score", pa.nulls(len(rest), pa.float64())).append_column("shared", pa.nulls(len(rest), pa.bool_()))])

    folder = shared_folder(spark)
    told = saved(dealt.groupBy("contig", "_cell").applyInArrow(scan, kind), folder, "near")
    pair = [F.col("id").alias("a"), "b", "score"]
    shared = told.where("shared").select(*pair).distinct()  # both cells may have told it
    done = told.where("not shared").select(*pair).unionByName(shared)
    rest = told.where("b is null").select(*rows.columns)
    for side, end in (("left", "a"), ("right", "b")):
        rest = rest.join(shared.select(F.lit(side).alias("dir"), F.col(end).alias("id")), ["dir", "id"], "left_anti").select(*rows.columns)
    if closed:
        rest = rest.unionByName(shut.join(shared.select(F.lit("left").alias("dir"), F.col("a").alias("id")).unionByName(shared.select(F.lit("right").alias("dir"), F.col("b").alias("id"))), ["dir", "id"], "left_anti").select(*rows.columns))
    rest = saved(rest, folder, "rest")
    if rest.isEmpty():
        return done
    return done.unionByName(greedy_pairs(pairs(rest), place=["contig", "s"]).select("a", "b", F.col("score").cast("double").alias("score")))


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their number (from 0) on their contig in the order, over range partitions: see ranged. One count a
    contig and part is gathered."""
    parts = ranged(rows, ["contig", *order])
    sizes = parts.groupBy("contig", "_part").agg(F.count(F.lit(1)).alias("_n"))
    below = F.sum("_n").over(Window.partitionBy("contig").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("contig").alias("_contig"), F.col("_part").alias("_p"), F.coalesce(below, F.lit(0)).alias("_below"))
    met = parts.join(sizes, parts["contig"].eqNullSafe(sizes["_contig"]) & (parts["_part"] == sizes["_p"]))
    at = F.col("_below") + F.row_number().over(Window.partitionBy("contig", "_part").orderBy(*order)) - 1
    return met.withColumn(name, at).drop("_contig", "_p", "_below", "_part")


def equal_count_windows(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """contig, window, start, end, rows: windows of n rows each by start and key, anew on each contig. Every row is in one
    window; even_windows is the variant in which windows share a row."""
    rows = placed(df.where("s is not null").select("contig", "s", key), ["s", key], "_at")
    return rows.withColumn("window", F.floor(F.col("_at") / n)).groupBy("contig", "window").agg(F.min("s").alias("start"), F.max("s").alias("end"), F.count(F.lit(1)).alias("rows"))


def label_clusters(clustered: DataFrame, label: str, least: int) -> DataFrame:
    """contig, cluster, label, n, start, end: clusters divided by a label of their rows, those of at least `least` rows."""
    out = clustered.groupBy("contig", "cluster", label).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("start"), F.max("e").alias("end"))
    return out.where(F.col("n") >= least)


def even_windows(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """contig, window, start, end, rows: windows of n rows by start and key, anew on each contig. The row that fills a
    window opens the next one: that starts at its start and does not count it, and the full window ends where the row
    before it ends. A contig's first window starts at its first row, its last one ends with its last row. n over 1.
    """
    rows = placed(df.where("s is not null").select("contig", "s", key, "e"), ["s", key], "_at")
    window, fills = F.floor(F.col("_at") / n), (F.col("_at") + 1) % n == 0
    own = F.struct(window.alias("window"), F.lit(1).alias("own"), F.lit(None).cast("bigint").alias("opens"))
    following = F.struct((window + 1).alias("window"), F.lit(0).alias("own"), F.col("s").alias("opens"))
    each = rows.select("contig", "s", "e", "_at", fills.alias("_fills"), F.explode(F.when(fills, F.array(own, following)).otherwise(F.array(own))).alias("w")).select("contig", "s", "e", "_at", "_fills", "w.*")
    counted = F.col("own") == 1
    out = each.groupBy("contig", "window").agg(
        F.coalesce(F.max("opens"), F.min("s")).alias("start"), F.max_by("e", F.when(counted & ~F.col("_fills"), F.col("_at"))).alias("end"), F.sum("own").alias("rows"))
    return out.where("rows > 0")
