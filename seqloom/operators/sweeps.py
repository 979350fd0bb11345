"""Questions about overlaps that are answered by one sweep in order, without making pairs: work is linear in the rows.

A sweep deals events by range of their group and place; a running maximum or sum goes over each part, and what reaches into a
part from those below is one row a part. So a hot place, a contig or a family is as spread as its rows are.
Rows with a null group, start or end overlap nothing. Names that begin with an underscore are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.clustering import ranged


def running(events: DataFrame, group: list[str], order: list[str], values: dict[str, str], how: str = "max") -> DataFrame:
    """events with, for each new name, the maximum (how: max) or sum of a column over all rows before it in the order of its
    group; without one null, or 0 for sums."""
    of = F.max if how == "max" else F.sum
    parts = ranged(events, [*group, *order]).withColumn("_key", F.struct(*group))
    before = Window.partitionBy("_part", "_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = parts.groupBy("_part").agg(F.min("_key").alias("_first"), F.max("_key").alias("_last"))  # groups that may reach across
    across = parts.join(F.broadcast(ends), "_part").where("_key = _first or _key = _last").groupBy("_part", "_key").agg(*[of(c).alias(f"_of_{n}") for n, c in values.items()])
    below = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    entering = across.select("_part", "_key", *[of(f"_of_{n}").over(below).alias(f"_below_{n}") for n in values])
    met = parts.withColumns({f"_here_{n}": of(c).over(before) for n, c in values.items()})
    met = met.join(F.broadcast(entering), ["_part", "_key"], "left")  # at most two rows a part
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = {n: F.greatest(f"_here_{n}", f"_below_{n}") if how == "max" else none(f"_here_{n}") + none(f"_below_{n}") for n in values}
    return met.withColumns(both).drop("_part", "_key", *[f"{x}_{n}" for n in values for x in ("_here", "_below")])


def any_overlap(left: DataFrame, right: DataFrame, group: tuple[str, ...] = ("contig",), pad: int = 0, name: str = "hit", few_groups: bool = False) -> DataFrame:
    """left with a boolean: whether [s - pad, e + pad) overlaps some row [s, e) of right in the same group.

    Of the right rows that start before the left one's end, the one that reaches farthest decides. At equal
    places the question comes first, as such a row does not start before it. Where the groups are said to be few,
    left rows beyond the first start and last end of their group's right rows are not swept.
    """
    whole = F.lit(True)
    for c in (*group, "s", "e"):
        whole = whole & F.col(c).isNotNull()
    kinds = dict(left.dtypes)
    near, rows = whole, left
    if few_groups:
        extents = right.where(whole).groupBy(*[F.col(g).cast(kinds[g]).alias(g) for g in group]).agg(F.min("s").alias("_from"), F.max("e").alias("_to"))
        rows = left.join(F.broadcast(extents), list(group), "left").select(*left.columns, "_from", "_to")
        near = whole & (F.col("s") - pad < F.col("_to")) & (F.col("_from") < F.col("e") + pad)
    asked = rows.where(near).select(*group, (F.col("e") + pad).cast("long").alias("_at"), F.lit(0).alias("_kind"), F.struct(*left.columns).alias("_row"))
    asked = asked.withColumn("_tie", F.xxhash64("_row"))  # rows at one place go to several parts
    held = right.where(whole).groupBy(*[F.col(g).cast(kinds[g]).alias(g) for g in group], F.col("s").cast("long").alias("_at")).agg(F.max(F.col("e").cast("long")).alias("_reach"))
    events = asked.unionByName(held.withColumns({"_kind": F.lit(1), "_tie": F.lit(0).cast("long")}), allowMissingColumns=True)
    swept = running(events, list(group), ["_at", "_kind", "_tie"], {"_far": "_reach"}).where("_kind = 0")
    found = swept.select("_row.*", F.coalesce(F.col("_far") > F.col("_row.s") - pad, F.lit(False)).alias(name))
    return found.unionByName(rows.where(~F.coalesce(near, F.lit(False))).select(left.columns).withColumn(name, F.lit(False)))


def beaten(df: DataFrame, key: str, weight: str, window: int) -> DataFrame:
    """key of the rows of which some other overlaps [s - window, e + window) and weighs strictly more.

    Space is cut into bins as wide as the window. Of the bins that a row's extent covers whole, the greatest weight
    counts. In the bin where the extent begins, rows count that end behind its beginning, in the last one those
    that start before its end: a sweep each. A row of length n has about n / window bins.
    """
    size = max(1, window)
    bin_of = lambda c: F.floor(c / size)
    last = lambda s, e: bin_of(F.greatest(e, s + 1) - 1)
    lo, hi, own = F.col("s") - window, F.col("e") + window, F.col(weight).alias("_own")
    rows = df.where(F.col("contig").isNotNull() & F.col("s").isNotNull() & F.col("e").isNotNull() & F.col(weight).isNotNull()).select("contig", "s", "e", key, weight)
    event = lambda k, side, at: F.struct(k.alias("_bin"), F.lit(side).alias("_side"), at.cast("long").alias("_at"))
    bins = rows.select("contig", "s", "e", weight, F.explode(F.sequence(bin_of(F.col("s")), last(F.col("s"), F.col("e")))).alias("_bin"))
    held = bins.select("contig", weight, F.explode(F.array(event(F.col("_bin"), 0, -F.col("e")), event(F.col("_bin"), 1, F.col("s")))).alias("_x"))
    held = held.groupBy("contig", "_x").agg(F.max(weight).alias("_w")).select("contig", "_x.*", "_w", F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_tie"))
    asked = rows.select("contig", F.col(key).alias("_key_of"), own, F.explode(F.array(event(bin_of(lo), 0, -lo), event(last(lo, hi), 1, hi))).alias("_x"))
    asked = asked.select("contig", "_x.*", "_own", "_key_of", F.lit(0).alias("_kind"), F.xxhash64("_key_of").alias("_tie"))
    edges = running(asked.unionByName(held, allowMissingColumns=True), ["contig", "_bin", "_side"], ["_at", "_kind", "_tie"], {"_top": "_w"}).where("_kind = 0")
    tops = bins.groupBy("contig", "_bin").agg(F.max(weight).alias("_top"))
    inner = rows.where(last(lo, hi) - bin_of(lo) > 1).select("contig", F.col(key).alias("_key_of"), own, F.explode(F.sequence(bin_of(lo) + 1, last(lo, hi) - 1)).alias("_bin"))
    stronger = edges.select("_key_of", "_own", "_top").unionByName(inner.join(tops, ["contig", "_bin"]).select("_key_of", "_own", "_top"))
    return stronger.where("_top > _own").select(F.col("_key_of").alias(key)).distinct()


def drop_weaker(df: DataFrame, key: str, weight: str, window: int) -> DataFrame:
    """Rows of which no other within the window of their extent weighs strictly more; ties keep both."""
    return df.join(beaten(df, key, weight, window), key, "left_anti")


def without_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows that overlap no right row (a mask)."""
    return any_overlap(left, right, name="_hit").where("not _hit").drop("_hit")


def track_mean(left: DataFrame, track: DataFrame, key: str, score: str) -> DataFrame:
    """key, mean: per-base mean of the track's score over each left interval, 0.0 where nothing covers it.

    A record (s, e] covers the bases s + 1 to e, one that starts at 0 none; an interval has the bases s to e, and a record
    that ends at its s does not count. Running sums of the records' starts and ends give what is covered up to
    a place, so an interval is the difference of its two ends, however many records lie in it. Scores that are no
    integers are summed as decimals of nine places.
    """
    whole = dict(track.dtypes)[score] in ("tinyint", "smallint", "int")
    exact, w = ("decimal(38,0)", F.col(score).cast("bigint")) if whole else ("decimal(38,9)", F.col(score).cast("decimal(18,9)"))
    rows = track.where("contig is not null and s <> 0 and s < e").where(w.isNotNull()).select("contig", "s", "e", w.alias("_score"))
    edge = lambda at, kind, sign: F.struct(F.col(at).cast("long").alias("_at"), F.lit(kind).alias("_kind"), F.lit(sign).alias("_sign"))
    rows = rows.select("contig", "_score", F.explode(F.array(edge("s", 2, 1), edge("e", 0, -1))).alias("_x")).select("contig", "_x.*", "_score")
    # at equal places ends come before a question, and starts behind it
    sums = rows.groupBy("contig", "_at", "_kind").agg(F.sum(F.col("_score") * F.col("_sign")).cast("bigint" if whole else exact).alias("_w"), F.sum("_sign").alias("_n"))
    events = sums.withColumns({"_wx": (-F.col("_w") * F.col("_at")).cast(exact), "_nx": (-F.col("_n") * F.col("_at")).cast("decimal(38,0)"), "_tie": F.lit(0).cast("long")})
    ask = lambda at, sign: F.struct(F.col(at).cast("long").alias("_at"), F.lit(sign).alias("_sign"))
    asked = left.where("contig is not null and s is not null and e is not null").select("contig", F.col(key).alias("_of"), F.explode(F.array(ask("s", -1), ask("e", 1))).alias("_x"))
    asked = asked.select("contig", "_x.*", "_of", F.lit(1).alias("_kind"), F.xxhash64("_of").alias("_tie"))
    swept = running(asked.unionByName(events, allowMissingColumns=True), ["contig"], ["_at", "_kind", "_tie"], {"_sw": "_w", "_sn": "_n", "_swx": "_wx", "_snx": "_nx"}, "sum").where("_kind = 1")
    upto = lambda slope, rest: F.col("_sign") * (F.col(slope) * F.col("_at") + F.col(rest)) + F.when(F.col("_sign") < 0, F.col(slope)).otherwise(0)
    means = swept.groupBy("_of").agg(F.try_divide(F.sum(upto("_sw", "_swx")).cast("double"), F.sum(upto("_sn", "_snx")).cast("double")).alias("_mean"))
    return left.select(key).join(means, left[key] == means["_of"], "left").select(key, F.coalesce("_mean", F.lit(0.0)).alias("mean"))


def medians(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """group and the exact median of value (the mean of the middle two), which nulls leave out; groups without one are left
    out. Counts of equal values are summed over range partitions, and the values that hold the middle places stay."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    met = running(counts, group, [value], {"_upto": "_n"}, "sum")
    totals = counts.groupBy(*[F.col(c).alias(f"_g_{c}") for c in group]).agg(F.sum("_n").alias("_all"))
    met = met.join(totals, [met[c].eqNullSafe(totals[f"_g_{c}"]) for c in group])
    inside = lambda k: (F.col("_upto") < k) & (k <= F.col("_upto") + F.col("_n"))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    middle = met.where(inside(low) | inside(high)).groupBy(*group).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    return middle.select(*group, ((F.col("_low") + F.col("_high")) / 2.0).alias(name))
