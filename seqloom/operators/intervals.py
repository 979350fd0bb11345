"""Interval joins as binned equi-joins, and what is built on them. Intervals are half-open unless said otherwise.

Rows with a null contig, start or end overlap nothing. r_s, r_e and names that begin with an underscore are taken by these
operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.sweeps import running

BIN = 4096
#: Fixed value: bins for joins of intervals of some hundred bases.
SHORT = 512


def overlaps_half_open(s: Column, e: Column, s2: Column, e2: Column) -> Column:
    return (s < e2) & (s2 < e)


def overlaps_inclusive(s: Column, e: Column, s2: Column, e2: Column) -> Column:
    """Strictly positive min(ends) - max(starts), ends being bases of their own."""
    return F.least(e, e2) - F.greatest(s, s2) > 0


def binned(df: DataFrame, s: str, e: str, size: int) -> DataFrame:
    """A row per bin that [s, e) touches; an empty interval has the bin of its start."""
    last = F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / size)
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(s) / size), last)))


def overlap_pairs(left: DataFrame, right: DataFrame, size: int = BIN, pad: int = 0) -> DataFrame:
    """Inner join of left and right (contig, s, e; other columns must differ) where [s - pad, e + pad) overlaps.

    right's columns come back as r_s and r_e. Both sides are dealt by contig and bin, so that a long contig is
    spread; a pair that shares several bins is kept in the one of the later start.
    """
    a = left.withColumns({"_s": F.col("s") - pad, "_e": F.col("e") + pad})
    b = right.withColumnRenamed("s", "r_s").withColumnRenamed("e", "r_e")
    met = binned(a, "_s", "_e", size).join(binned(b, "r_s", "r_e", size), ["contig", "_bin"])
    once = F.col("_bin") == F.greatest(F.floor(F.col("_s") / size), F.floor(F.col("r_s") / size))
    return met.where(once & overlaps_half_open(F.col("_s"), F.col("_e"), F.col("r_s"), F.col("r_e"))).drop("_bin", "_s", "_e")


def first_hit(left: DataFrame, right: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each left row's first overlapping right row in the stated order, which begins with r_s; rows without one vanish.

    No pairs are made. The first right row of the order that ends behind a left row's start is its hit, if it starts
    before its end. That row reaches farther than all before it, so such rows alone are kept, and each left row takes
    the one that ends next behind its start: a sweep each.
    """
    if order[0] != "r_s":
        raise ValueError("the order of hits begins with r_s")
    whole = "contig is not null and s is not null and e is not null"
    held = running(right.where(whole).withColumnsRenamed({"s": "r_s", "e": "r_e"}), ["contig"], order, {"_far": "r_e"}).where("_far is null or r_e > _far").drop("_far")
    event = lambda at, kind: [(-F.col(at)).cast("long").alias("_at"), F.lit(kind).alias("_kind")]
    held = held.select("contig", *event("r_e", 1), F.lit(0).cast("long").alias("_tie"), F.struct(*[c for c in held.columns if c != "contig"]).alias("_hit")).withColumn("_end", F.struct("_at", "_hit"))
    asked = left.where(whole).select("contig", *event("s", 0), F.struct(*left.columns).alias("_row")).withColumn("_tie", F.xxhash64("_row"))
    swept = running(asked.unionByName(held.drop("_hit"), allowMissingColumns=True), ["contig"], ["_at", "_kind", "_tie"], {"_next": "_end"}).where("_kind = 0")
    met = swept.where("_next._hit.r_s < _row.e").select("_row.*", "_next._hit.*")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return met.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def merged(df: DataFrame, group: list[str]) -> DataFrame:
    """group, s, e: what the rows of each group cover together, a row for each stretch of overlapping ones; rows that end
    where they start or before stay as they are."""
    rows = df.where("s is not null and e is not null").select(*group, F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))
    starts = running(rows.where("s < e").groupBy(*group, "s").agg(F.max("e").alias("e")), group, ["s"], {"_far": "e"})
    opens = starts.withColumn("_new", F.coalesce(F.col("s") >= F.col("_far"), F.lit(True)).cast("int"))
    of = running(opens, group, ["s"], {"_before": "_new"}, "sum").withColumn("_stretch", F.col("_before") + F.col("_new"))
    out = of.groupBy(*group, "_stretch").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_stretch")
    return out.unionByName(rows.where("s >= e").distinct())


def annotated(left: DataFrame, right: DataFrame, key: str, label: str) -> DataFrame:
    """key, annotation: distinct labels of overlapping rows in order, joined by commas; NA for none. Rows of one label
    that overlap are one, so that a left row meets a label once for each gap, not once for each row."""
    met = overlap_pairs(left.select(key, "contig", "s", "e"), merged(right.where("contig is not null"), ["contig", label]).withColumnRenamed(label, "_label"))
    lists = met.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("_label")), ",").alias("_a"))
    return left.select(key).join(lists, key, "left").select(key, F.coalesce("_a", F.lit("NA")).alias("annotation"))


#: Bases of the smallest blocks, and pairs for each row up to which lists are made from pairs.
BLOCK, FEW = 256, 8


def many_pairs(left: DataFrame, track: DataFrame, group: list[str], most: int | None = None) -> bool:
    """Whether left (group, s) and track (group, s, e) rows that share a bin are more than `most` (FEW) pairs for each row."""
    asked = left.groupBy(*group, F.floor(F.col("s") / SHORT).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    held = binned(track.select(*group, "s", "e"), "s", "e", SHORT).groupBy(*group, "_bin").agg(F.count(F.lit(1)).alias("_m"))
    n, m = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("_n", "_m"))
    pairs, rows = asked.join(held, [*group, "_bin"], "full").agg(F.sum(n * m), F.sum(n + m)).first()
    return (pairs or 0) > (FEW if most is None else most) * (rows or 0)


def with_hits(places: DataFrame, track: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """places (group, s, e, ...) with _hits, the overlapping track rows (group, s, e, order; as r_s, r_e) in the stated order; null or
    empty for none.

    No pairs are made, and what was found is never dealt. Places of like length (four times the last level's at most) have blocks as
    wide as the longest of them may be; a place asks the block of its start alone, to which every track row goes that may
    overlap such a place. A block is sorted once. A track row has about n / BLOCK blocks for its length n, fewer where the mean is long.
    """
    mean = track.agg(F.avg(F.greatest(F.col("e") - F.col("s"), F.lit(1)))).first()[0] or 1
    base = next(BLOCK * 4**k for k in range(28) if 2 * BLOCK * 4**k >= mean or k == 27)
    sizes = [base * 4**k for k in range(27) if base * 4**k < 2**62]
    length = F.col("e") - F.col("s")
    places = places.withColumn("_size", F.coalesce(*[F.when(length <= n, F.lit(n).cast("long")) for n in sizes]))
    places = places.withColumn("_bin", F.floor(F.col("s") / F.col("_size")))
    used = [r[0] for r in places.select("_size").where("_size is not null").distinct().collect()]
    rows = track.withColumnsRenamed({"s": "r_s", "e": "r_e"}).where("r_s is not null and r_e is not null")
    rows = rows.withColumn("_size", F.explode(F.array(*[F.lit(n).cast("long") for n in used]).cast("array<bigint>")))
    least, last = F.col("r_s") - F.col("_size") + 1, F.col("r_e") - 1  # starts of places that may overlap
    bins = F.sequence(F.floor(least / F.col("_size")), F.floor(last / F.col("_size")))
    rows = rows.where(least <= last).withColumn("_bin", F.explode(bins))
    at = [*group, "_size", "_bin"]
    items = F.struct(*order, *[c for c in ("r_s", "r_e") if c not in order])
    blocks = rows.repartition(*at).groupBy(*at).agg(F.sort_array(F.collect_list(items)).alias("_block"))
    met = places.join(blocks, at, "left")
    hits = F.filter("_block", lambda x: (x["r_s"] < F.col("e")) & (x["r_e"] > F.col("s")))
    return met.withColumn("_hits", hits).drop("_block", "_size", "_bin")


def listed_once(left: DataFrame, key: str, at: list[str], lists: Callable[[DataFrame, list[str]], DataFrame], alone: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """key, annotation of left, NA for none. lists(rows, by) gives `by` and _a, the text of all overlaps of the rows with equal
    `by`. It is asked once for each distinct value of `at` (contig, s, e, ...), however many rows have it; rows
    whose key repeats are asked together by key. Where given, alone(rows) adds _a to rows of distinct `at` in its stead, and no
    text is dealt: the keys of a place go with it."""
    repeated = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
    one, many = left.select(key, *at).join(repeated, key, "left_anti"), left.select(key, *at).join(repeated, key, "left_semi")
    if alone:
        found = alone(one.groupBy(*at).agg(F.collect_list(F.struct(F.col(key).alias("_key"))).alias("_keys")))
        single = found.select(F.explode("_keys").alias("_of"), "_a").select(F.col("_of._key").alias(key), F.when(F.col("_of._key").isNotNull(), F.col("_a")).alias("_a"))
        pooled = many.select(key).join(lists(many, [key]), key, "left").select(key, "_a")
        return single.unionByName(pooled).select(key, F.coalesce("_a", F.lit("NA")).alias("annotation"))
    found = lists(one.select(*at).distinct(), at).withColumnsRenamed({c: f"_at_{c}" for c in at})
    single = one.join(found, [one[c] == found[f"_at_{c}"] for c in at], "left").select(key, F.when(F.col(key).isNotNull(), F.col("_a")).alias("_a"))
    pooled = many.select(key).join(lists(many, [key]), key, "left").select(key, "_a")
    return single.unionByName(pooled).select(key, F.coalesce("_a", F.lit("NA")).alias("annotation"))
