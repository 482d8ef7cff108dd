"""Functions of ordered rows: previous values, carried values, runs, tuples, transitions, positions, windows between marks.

Every function deals rows by their group once and leaves the rest to window functions; a
group is a session or a thread, whose order is the meaning of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _over(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def lagged(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the difference to the row before; null on a group's first row."""
    return rows.withColumn(name, F.col(value) - F.lag(value).over(_over(by, order)))


def carried(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the latest non-null value up to the row."""
    upto = _over(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(upto))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str, size: str) -> DataFrame:
    """Adds each row's number in its group, from 0, and the group's size."""
    return rows.withColumns({
        name: (F.row_number().over(_over(by, order)) - 1).cast("long"),
        size: F.count("*").over(Window.partitionBy(*by)),
    })


def running_max(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    upto = _over(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.max(value).over(upto))


def tuples(rows: DataFrame, by: list[str], order: list[str], item: str, k: int, name: str = "items") -> DataFrame:
    """Adds the row's item and those of the next k - 1 rows as an array; rows with fewer behind them go."""
    ahead = _over(by, order).rowsBetween(0, k - 1)
    listed = rows.withColumn(name, F.collect_list(F.struct(F.col(item).alias("item"))).over(ahead))
    return listed.where(F.size(name) == k).withColumn(name, F.transform(name, lambda x: x["item"]))


def transitions(rows: DataFrame, by: list[str], order: list[str], item: str) -> DataFrame:
    """(prev, item, n): how often an item follows another; prev is null for first rows."""
    prev = F.lag(item).over(_over(by, order))
    return rows.select(prev.alias("prev"), F.col(item)).groupBy("prev", item).agg(F.count("*").alias("n"))


def longest_runs(rows: DataFrame, by: list[str], order: list[str], item: str) -> DataFrame:
    """(item, longest): the longest unbroken run of each item in any group.

    A run begins where the item differs from the one before; a running count of beginnings names it.
    """
    w = _over(by, order)
    begins = ~F.col(item).eqNullSafe(F.lag(item).over(w)) | (F.row_number().over(w) == 1)
    runs = rows.withColumn("begins", begins)
    runs = runs.withColumn("run", F.count_if("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "run", item).agg(F.count("*").alias("n")).groupBy(item).agg(F.max("n").alias("longest"))


def precedence(rows: DataFrame, by: list[str], order: str, item: str) -> DataFrame:
    """(first_item, then_item, groups, first_before, always_before) over ordered pairs of items that share a group.

    first_before: groups in which one item's first row precedes the other's; always_before: in which all of its rows do.
    An array of a group's distinct items with their first and last rows is paired with itself.
    """
    ends = rows.where(F.col(item).isNotNull()).groupBy(*by, item).agg(F.min(order).alias("a"), F.max(order).alias("b"))
    held = ends.groupBy(*by).agg(F.collect_list(F.struct(F.col(item).alias("item"), "a", "b")).alias("xs"))
    pairs = held.select(F.explode("xs").alias("x"), "xs").select("x", F.explode("xs").alias("y"))
    pairs = pairs.where("x.item <> y.item")
    return pairs.groupBy(F.col("x.item").alias("first_item"), F.col("y.item").alias("then_item")).agg(
        F.count("*").alias("groups"),
        F.count_if(F.col("x.a") < F.col("y.a")).alias("first_before"),
        F.count_if(F.col("x.b") < F.col("y.a")).alias("always_before"),
    )


def part_of_group(rows: DataFrame, by: list[str], order: list[str], parts: int, name: str) -> DataFrame:
    """Adds floor(place * parts / size), place from 0: the tenth of its session that a row lies in, for parts = 10."""
    placed = numbered(rows, by, order, "place_", "size_")
    part = F.floor(F.col("place_") * parts / F.col("size_")).cast("long")
    return placed.withColumn(name, part).drop("place_", "size_")


def halves(rows: DataFrame, by: list[str], order: list[str], name: str = "early") -> DataFrame:
    """Adds whether a row lies in its group's first half; the middle row of an odd group doesn't."""
    placed = numbered(rows, by, order, "place_", "size_")
    return placed.withColumn(name, 2 * (F.col("place_") + 1) <= F.col("size_")).drop("place_", "size_")


def contiguity(rows: DataFrame, by: list[str], order: str, first: int | None = None) -> DataFrame:
    """(by, rows, gaps, repeats, first, broken): steps of the order that aren't 1. broken: any such step, or a first number that isn't the one given."""
    step = F.col(order) - F.lag(order).over(_over(by, [order]))
    g = rows.withColumn("step", step).groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("step") > 1).alias("gaps"),
        F.count_if(F.col("step") == 0).alias("repeats"),
        F.min(order).alias("first"),
    )
    off = (F.col("gaps") > 0) | (F.col("repeats") > 0)
    return g.withColumn("broken", off if first is None else off | (F.col("first") != first))


def between_marks(rows: DataFrame, by: list[str], order: list[str], mark: Column, name: str = "w") -> DataFrame:
    """Adds the number of marks up to each row: rows of one number lie between the same marks, the mark itself being the first of them."""
    upto = _over(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.count_if(mark).over(upto))


def neighbours(rows: DataFrame, thread: list[str], order: list[str], value: str, kept: Column) -> DataFrame:
    """Adds before and after: value of the nearest rows of the thread on both sides for which kept holds."""
    w = _over(thread, order)
    near = F.when(kept, F.col(value))
    return rows.withColumns({
        "before": F.last(near, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "after": F.first(near, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    })


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """left's rows with n, how many times more than in right each is there; nulls are equal. Copies are counted before they are shuffled."""
    cols = left.columns
    count = lambda df: df.groupBy(*cols).agg(F.count("*").alias("n"))
    x, y = count(left).alias("x"), count(right).alias("y")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in cols]
    more = F.col("x.n") - F.coalesce(F.col("y.n"), F.lit(0))
    return x.join(y, same, "left").select(*[F.col(f"x.{c}") for c in cols], more.alias("n")).where("n > 0")


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(both, left_only, right_only): distinct rows of two tables of equal columns, from one aggregation of their union."""
    cols = left.columns
    union = left.withColumn("side_", F.lit(1)).unionByName(right.withColumn("side_", F.lit(2)))
    sides = union.groupBy(*cols).agg(F.min("side_").alias("a"), F.max("side_").alias("b"))
    return sides.agg(
        F.count_if(F.col("a") < F.col("b")).alias("both"),
        F.count_if(F.col("b") == 1).alias("left_only"),
        F.count_if(F.col("a") == 2).alias("right_only"),
    )
