"""Joins over time and order that keep to one shuffle: as-of, band, in-flight, prefix, epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_backward(rows: DataFrame, by: list[str], order: list[str], value: Column, strict: bool = True) -> Column:
    """The latest non-null value before each row (or up to it): a window, where an as-of join would sort both sides."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    return F.last(value, ignorenulls=True).over(w)


def asof_earlier(rows: DataFrame, by: list[str], time: str, value: Column) -> Column:
    """The largest value among rows of the group with a strictly earlier time: rows of one instant don't see each other."""
    return F.max(value).over(Window.partitionBy(*by).orderBy(time).rangeBetween(Window.unboundedPreceding, -1))


def epoch(event: Column, by: list[str], order: list[str]) -> Column:
    """How many such events precede a row: rows with one number have none between them, so "nothing in between" is an equality."""
    return F.count_if(event).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def repeated_calls(rows: DataFrame, by: list[str], order: str, key: str, output: str, mutation: Column, counts: Column) -> DataFrame:
    """(by, key, first_seq, second_seq, same): consecutive rows of a key for which counts holds, with no mutation in between, and whether their outputs are equal.

    The number of mutations before a row makes "none in between" an equality with the row before of the key.
    """
    numbered = rows.withColumn("epoch_", F.count_if(mutation).over(Window.partitionBy(*by).orderBy(order)))
    own = numbered.where(counts & F.col(key).isNotNull())
    before = F.lag(F.struct(F.col(order).alias("seq"), F.col(output).alias("output"), F.col("epoch_").alias("epoch"))).over(Window.partitionBy(*by, key).orderBy(order))
    met = own.withColumn("before_", before).where(F.col("before_.epoch") == F.col("epoch_"))
    return met.select(*by, key, F.col("before_.seq").alias("first_seq"), F.col(order).alias("second_seq"), (F.col(output) == F.col("before_.output")).alias("same"))


def band_join(left: DataFrame, right: DataFrame, on: list[str], value: str, width: float) -> DataFrame:
    """left ⋈ right on equal keys and |left.value - right.value| <= width; right's other columns get the prefix r_.

    The right side's rows stand in their own band only and the left's visit three: an
    equality on (keys, band) for the shuffle and a check for the rest.
    """
    r = right.select(*[F.col(c).alias(c if c in on else f"r_{c}") for c in right.columns]).withColumn("_band", F.floor(F.col(f"r_{value}") / width))
    spread = left.withColumn("_band", F.explode(F.array(*[F.floor(F.col(value) / width) + d for d in (-1, 0, 1)])))
    return spread.join(r, [*on, "_band"]).where(F.abs(F.col(value) - F.col(f"r_{value}")) <= width).drop("_band")


def relative_band_join(left: DataFrame, right: DataFrame, on: list[str], value: str, share: int = 20) -> DataFrame:
    """Partners with |right.value - left.value| <= left.value div share: bands on a log scale, so that a row visits few."""
    import math

    step = math.log1p(1.0 / share)
    band = lambda c: F.floor(F.log(F.greatest(c, F.lit(1))) / step)
    r = right.select(*[F.col(c).alias(c if c in on else f"r_{c}") for c in right.columns]).withColumn("_band", band(F.col(f"r_{value}")))
    spread = left.withColumn("_band", F.explode(F.sequence(band(F.col(value) - F.call_function("div", F.col(value), F.lit(share))), band(F.col(value) + F.call_function("div", F.col(value), F.lit(share))))))
    return spread.join(r, [*on, "_band"]).where(F.abs(F.col(f"r_{value}") - F.col(value)) <= F.call_function("div", F.col(value), F.lit(share))).drop("_band")


def donors(left: DataFrame, right: DataFrame, on: list[str], session: str, key: str, value: str, seed: int = 1, share: int = 20) -> DataFrame:
    """For each left row the nearest partner of another session with |difference| <= value div share; ties by seeded hash.

    right's session, key and value come as r_ columns. The nearest partner is the last one before or the first one behind in the
    order of values, so no pairs are listed: right rows first learn the last row of another session on either
    side, then left rows look up their neighbour, and that row's where the neighbour's session is their own.
    """
    tie = F.xxhash64(session, key, F.lit(seed))
    named = F.struct(F.col(session).alias("s"), F.col(key).alias("k"), F.col(value).alias("v"), tie.alias("h"))
    r = right.select(*on, F.col(session).alias("s_"), F.col(value).alias("v_"), tie.alias("h_"), F.col(key).alias("k_"), named.alias("own_"), F.lit(1).alias("side_"))
    r = r.where("v_ is not null")
    rising = [F.col("v_"), F.col("h_"), F.col("s_"), F.col("k_")]
    falling = [c.desc() for c in rising]
    for name, order in (("low_", rising), ("high_", falling)):
        w = Window.partitionBy(*on).orderBy(*order)
        turn = F.lag("s_").over(w) != F.col("s_")
        r = r.withColumn(name, F.last(F.when(turn, F.lag("own_").over(w)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    l = left.withColumns({"s_": F.col(session), "v_": F.col(value), "h_": tie, "k_": F.col(key), "side_": F.lit(0)})
    both = l.unionByName(r, allowMissingColumns=True)
    found = []
    for name, order in (("low_", [F.col("v_"), F.desc("side_")]), ("high_", [F.desc("v_"), F.desc("side_")])):
        upto = Window.partitionBy(*on).orderBy(*order, "h_", "s_", "k_").rowsBetween(Window.unboundedPreceding, 0)
        near = F.last(F.when(F.col("side_") == 1, F.struct(F.col("own_").alias("a"), F.col(name).alias("b"))), ignorenulls=True).over(upto)
        both = both.withColumn(f"near{name}", near)
        found.append(F.when(F.col(f"near{name}.a.s") != F.col("s_"), F.col(f"near{name}.a")).otherwise(F.col(f"near{name}.b")))
    gap = lambda c: F.abs(c["v"] - F.col("v_"))
    ranked = F.array_sort(F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(gap(c).alias("gap"), c["h"].alias("h"), c.alias("c"))) for c in found])))
    best = both.where("side_ = 0").withColumn("best_", F.get(ranked, F.lit(0))).where(F.col("best_.gap") <= F.call_function("div", F.col("v_"), F.lit(share)))
    return best.select(*left.columns, F.col("best_.c.s").alias(f"r_{session}"), F.col("best_.c.k").alias(f"r_{key}"), F.col("best_.c.v").alias(f"r_{value}"))


def in_flight(intervals: DataFrame, by: str, start: str, end: str, key: list[str]) -> DataFrame:
    """How many intervals of the group hold each interval's midpoint, itself included: a sweep over starts, ends and midpoints."""
    mid = (F.col(start) + F.col(end)) / 2
    points = F.array(F.struct(F.col(start).cast("double").alias("t"), F.lit(0).alias("o"), F.lit(1).alias("d")), F.struct(mid.alias("t"), F.lit(1).alias("o"), F.lit(0).alias("d")), F.struct(F.col(end).cast("double").alias("t"), F.lit(2).alias("o"), F.lit(-1).alias("d")))
    swept = intervals.select(by, *key, F.explode(points).alias("p")).select(by, *key, "p.t", "p.o", "p.d")
    open_now = F.sum("d").over(Window.partitionBy(by).orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0))
    return swept.withColumn("n", open_now).where("o = 1").select(by, *key, "n")


def interval_union(intervals: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """(by, length, pieces) of the union of each group's intervals: a piece begins where no earlier interval reaches."""
    before = Window.partitionBy(by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(end).over(before), F.col(start))
    gain = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), reach))
    first = F.max(end).over(before).isNull() | (F.col(start) > F.max(end).over(before))
    return intervals.withColumns({"_gain": gain, "_first": first}).groupBy(by).agg(F.sum("_gain").alias("length"), F.count_if("_first").alias("pieces"))


def bursts(events: DataFrame, by: str, time: str, gap: int, tie: str) -> DataFrame:
    """Events with burst numbers: a burst ends where the next event is more than gap away."""
    w = Window.partitionBy(by).orderBy(time, tie)
    new = F.coalesce(F.col(time) - F.lag(time).over(w) > gap, F.lit(True))
    return events.withColumn("_new", new).withColumn("burst", F.count_if("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def hits_in_window(points: DataFrame, reports: DataFrame, by: str, time: str, low: int, high: int) -> DataFrame:
    """points with hit: is there a report of the group in [t + low, t + high)? Counted over the union of both, in one window."""
    both = points.withColumn("_r", F.lit(0)).unionByName(reports.withColumn("_r", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(time).rangeBetween(low, high - 1)
    return both.withColumn("hit", F.sum("_r").over(w) > 0).where("_r = 0").drop("_r")


def shared_keys(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """(key, owners, first) of keys that more than one owner has; first is the smallest owner."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(owner).alias("owners"), F.min(owner).alias("first")).where("owners > 1")


def prefix_join(short: DataFrame, full: DataFrame, short_col: str, full_col: str, width: int = 7) -> DataFrame:
    """Pairs where the short value is a prefix of the full one; an equality on the first width characters does the shuffle."""
    s = short.where(F.length(short_col) >= width).withColumn("_p", F.substring(short_col, 1, width))
    return s.join(full.withColumn("_p", F.substring(full_col, 1, width)), "_p").where(F.col(full_col).startswith(F.col(short_col))).drop("_p")


def prefer(rows: DataFrame, by: list[str], *ranks: Column) -> DataFrame:
    """The best row of each group by the given order."""
    w = Window.partitionBy(*by).orderBy(*ranks)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def once_both_sides(calls: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """Keys that one call and one result have."""
    one = lambda df: df.groupBy(*key).agg(F.count("*").alias("n")).where("n = 1").drop("n")
    return one(calls).join(one(results), key, "left_semi")
