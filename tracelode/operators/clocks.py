"""What clocks and usage say of a log: id brackets, reaction gaps, residual latencies, concurrency, retries, cold starts, two clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

US = 1_000_000
DAY_US = 86_400 * US


def bracket_bounds(events: DataFrame, thread: list[str], order: str, time: str, embedded: str, response: Column, input_: Column) -> DataFrame:
    """Response rows with lo and hi, which the id's own time must lie between if its clock runs `offset` behind the log's.

    lo: the thread's last input strictly before the response, less the id's time (null without one); hi: the response's
    stamp less the id's time. Ids over a day off their stamp don't count.
    """
    past = Window.partitionBy(*thread).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last(F.when(input_, F.col(time)), ignorenulls=True).over(past)
    found = events.withColumn("prev_", prev).where(response & F.col(embedded).isNotNull())
    found = found.withColumns({"lo": F.col("prev_") - F.col(embedded), "hi": F.col(time) - F.col(embedded)})
    return found.where(F.abs("hi") <= DAY_US).drop("prev_")


def brackets(bounds: DataFrame, thread: list[str], order: str, tolerance: int = 2 * US) -> DataFrame:
    """(thread, n, lo, hi, gap, inconsistent, at_lo, at_hi) of threads with two responses or more: the greatest lo, the least hi and where they bind, ties to the first."""
    lowest = F.struct(-F.col("lo"), F.col(order))
    g = bounds.groupBy(*thread).agg(
        F.count("*").alias("n"), F.max("lo").alias("most_lo"), F.min("hi").alias("least_hi"),
        F.min_by(order, F.when(F.col("lo").isNotNull(), lowest)).alias("at_lo"),
        F.min_by(order, F.struct("hi", order)).alias("at_hi"),
    ).where("n >= 2")
    gap = F.col("most_lo") - F.col("least_hi")
    off = F.coalesce(gap > tolerance, F.lit(False))
    return g.select(*thread, "n", F.col("most_lo").alias("lo"), F.col("least_hi").alias("hi"), gap.alias("gap"), off.alias("inconsistent"), "at_lo", "at_hi")


def one_step(bounds: DataFrame, thread: list[str], order: str, tolerance: int = 2 * US) -> DataFrame:
    """(thread, consistent): whether one split point, both sides non-empty, makes both sides consistent, as a step of the clock would.

    The extremes of all prefixes and suffixes are windows, so every split is judged in one pass.
    """
    w = Window.partitionBy(*thread).orderBy(order)
    upto, rest = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    fits = lambda part: F.coalesce(F.max("lo").over(part) - F.min("hi").over(part) <= tolerance, F.lit(True))
    split = bounds.withColumns({"ok_": fits(upto) & fits(rest), "behind_": F.count("hi").over(rest)})
    return split.where("behind_ > 0").groupBy(*thread).agg(F.bool_or("ok_").alias("consistent"))


def reaction_gaps(events: DataFrame, thread: list[str], order: str, time: str, most: int = 600 * US) -> DataFrame:
    """(thread, order, gap) of assistant and call rows: the time since the last result behind the previous such row, 0 < gap <= most.

    A user or system row in between blocks the gap. Rows are grouped by how many assistant and call rows
    precede them, so each group ends with the one that reacts.
    """
    reacts = F.col("kind").isin("assistant", "call")
    before = Window.partitionBy(*thread).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    g = events.withColumn("turn_", F.coalesce(F.count_if(reacts).over(before), F.lit(0))).groupBy(*thread, "turn_").agg(
        F.max_by(time, F.when((F.col("kind") == "result") & F.col(time).isNotNull(), F.col(order))).alias("shown"),
        F.bool_or(F.col("kind").isin("user", "system")).alias("blocked"),
        F.max(F.when(reacts, F.col(time))).alias("at"), F.max(F.when(reacts, F.col(order))).alias(order),
    )
    gaps = g.where(~F.col("blocked")).withColumn("gap", F.col("at") - F.col("shown"))
    return gaps.where((F.col("gap") > 0) & (F.col("gap") <= most)).select(*thread, order, "gap")


def residuals(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """rows with residual: value minus the median of the group's other rows; rows without others go.

    Removing a row moves a median by one place at most, so the three middle values of the sorted group give all the medians:
    two window passes, no self-join.
    """
    w = Window.partitionBy(*group)
    placed = rows.where(F.col(value).isNotNull()).withColumns({
        "place_": F.row_number().over(w.orderBy(value, order)) - 1,
        "size_": F.count("*").over(w),
    }).where("size_ >= 2")
    half = F.floor(F.col("size_") / 2)
    at = lambda shift: F.max(F.when(F.col("place_") == half + shift, F.col(value))).over(w)
    placed = placed.withColumns({"low_": at(-1), "mid_": at(0), "high_": at(1)})
    # of 2h rows one is left out: the middle of the others is place h - 1 or h; of 2h + 1 rows: the mean of two places
    even = F.when(F.col("place_") <= half - 1, F.col("mid_")).otherwise(F.col("low_"))
    odd = (even + F.when(F.col("place_") <= half, F.col("high_")).otherwise(F.col("mid_"))) / 2
    median = F.when(F.col("size_") % 2 == 0, even).otherwise(odd)
    return placed.withColumn("residual", F.col(value) - median).drop("place_", "size_", "low_", "mid_", "high_")


def concurrency(rows: DataFrame, key: str, at_once: str, value: str, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """Per key with at least so many rows alone (at_once = 1) and not alone, the difference of the medians; and its mean weighted by the keys' rows."""
    alone = F.col(at_once) < 2
    per = rows.groupBy(key).agg(
        F.count_if(~alone).alias("n_together"), F.count_if(alone).alias("n_alone"),
        F.percentile(F.when(~alone, F.col(value)), F.lit(0.5)).alias("together"),
        F.percentile(F.when(alone, F.col(value)), F.lit(0.5)).alias("alone"),
    ).where((F.col("n_together") >= least) & (F.col("n_alone") >= least))
    per = per.select(key, "n_together", "n_alone", (F.col("together") - F.col("alone")).alias("delta"))
    rows_of = F.col("n_together") + F.col("n_alone")
    return per, per.agg(F.try_divide(F.sum(rows_of * F.col("delta")), F.sum(rows_of)).alias("delta"), F.count("*").alias("keys"))


def cold_starts(rows: DataFrame, group: str, order: str, key: str, value: str, least: int = 6) -> DataFrame:
    """(group, key, n, cold): of the group's commonest key (ties to the one met first) with least rows or more, the first value minus the median of the rest."""
    counts = rows.groupBy(group, key).agg(F.count("*").alias("n"), F.min(order).alias("met"))
    usual = counts.groupBy(group).agg(F.max_by(F.struct(key, "n", "met"), F.struct("n", -F.col("met"))).alias("u"))
    usual = usual.select(group, f"u.{key}", "u.n", "u.met").where(F.col("n") >= least)
    own = rows.join(usual, [group, key])
    first = F.max(F.when(F.col(order) == F.col("met"), F.col(value)))
    rest = F.percentile(F.when(F.col(order) != F.col("met"), F.col(value)), F.lit(0.5))
    return own.groupBy(group, key, "n").agg((first - rest).alias("cold"))


def inequality(rows: DataFrame, by: list[str], session: str, slack: Column, tolerance: float, gross: float) -> DataFrame:
    """How often slack >= 0 fails: beyond the tolerance, at all, grossly, in how many sessions; with the slack's quartiles. Null slacks don't count."""
    s = rows.withColumn("slack_", slack).where("slack_ is not null")
    bad = F.col("slack_") < -tolerance
    q = lambda p, name: F.percentile("slack_", F.lit(p)).alias(name)
    return s.groupBy(*by).agg(
        F.count("*").alias("n"), F.countDistinct(session).alias("sessions"),
        F.count_if(bad).alias("violations"), F.count_if(F.col("slack_") < 0).alias("below_zero"),
        F.count_if(F.col("slack_") < -gross).alias("gross"), F.countDistinct(F.when(bad, F.col(session))).alias("violators"),
        F.min("slack_").alias("least"), q(0.25, "p25"), q(0.5, "p50"), q(0.75, "p75"),
    )


def jaccard(x: Column, y: Column) -> Column:
    """Of two arrays as sets; 1 where both are empty."""
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def retries(calls: DataFrame, thread: list[str], order: str, key: str, args: str, tokens: str, alike: float = 0.5) -> DataFrame:
    """calls with retry, exact and followed: the thread's next call has the same key and identical arguments or as many shared tokens; calls without a next one go."""
    w = Window.partitionBy(*thread).orderBy(order)
    ahead = F.lead(F.struct(F.col(key).alias("k"), F.col(args).alias("a"), F.col(tokens).alias("t"))).over(w)
    found = calls.withColumn("next_", ahead).where("next_ is not null")
    same = F.coalesce(F.col("next_.k") == F.col(key), F.lit(False))
    exact = same & F.coalesce(F.col("next_.a") == F.col(args), F.lit(False))
    retry = exact | (same & (jaccard(F.col(tokens), F.col("next_.t")) >= alike))
    return found.withColumns({"exact": exact, "retry": retry}).drop("next_")


def retry_effect(found: DataFrame, key: str, failed: str, retry: str = "retry") -> DataFrame:
    """(failures, after_failure, after_success, effect): retry rates after failed and other calls, and their difference inside keys, weighted by the keys' failures."""
    g = found.groupBy(key).agg(
        F.count_if(F.col(failed)).alias("f"), F.count_if(F.col(failed) & F.col(retry)).alias("fr"),
        F.count_if(~F.col(failed)).alias("o"), F.count_if(~F.col(failed) & F.col(retry)).alias("ork"),
    )
    both = (F.col("f") > 0) & (F.col("o") > 0)
    inside = F.when(both, F.col("f") * (F.col("fr") / F.col("f") - F.col("ork") / F.col("o")))
    return g.agg(
        F.sum("f").alias("failures"),
        F.try_divide(F.sum("fr").cast("double"), F.sum("f")).alias("after_failure"),
        F.try_divide(F.sum("ork").cast("double"), F.sum("o")).alias("after_success"),
        F.try_divide(F.sum(inside), F.sum(F.when(both, F.col("f")))).alias("effect"),
    )


def inline_flags(responses: DataFrame, results: DataFrame, on: list[str], tau: float, least: int = 800, share: float = 0.5) -> DataFrame:
    """responses(on, usage_out, chars_out) with result_chars of results(on, chars) and flagged: the output tokens that its own characters don't explain would hold the result.

    Results of fewer than least characters, and responses without usage, decide nothing and go.
    """
    met = responses.where("usage_out is not null").join(results.withColumnRenamed("chars", "result_chars"), on)
    met = met.where(F.col("result_chars") >= least)
    left = F.col("usage_out") - tau * F.col("chars_out")
    return met.withColumn("flagged", left >= share * tau * F.col("result_chars"))


def image_windows(calls: DataFrame, by: str, order: str, image_tokens: str, screen: Column, unit: float | None = None) -> DataFrame:
    """(by, order, d_image, n_screens, violation) of usage-bearing calls with one before: image tokens rise if and only if a screen was shown in between, by whole units."""
    w = Window.partitionBy(by).orderBy(order)
    bearing = F.col(image_tokens).isNotNull()
    numbered = calls.withColumns({
        "shown_": F.coalesce(F.count_if(screen).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "bearing_": bearing,
    }).where("bearing_")
    before = F.lag(F.struct(F.col(image_tokens).alias("i"), F.col("shown_").alias("s"))).over(w)
    met = numbered.withColumn("before_", before).where("before_ is not null")
    met = met.select(by, order, (F.col(image_tokens) - F.col("before_.i")).alias("d_image"), (F.col("shown_") - F.col("before_.s")).alias("n_screens"))
    d = F.col("d_image")
    off = ((F.col("n_screens") >= 1) & (d <= 0)) | ((F.col("n_screens") == 0) & (d != 0))
    if unit:
        off = off | ((d > 0) & (F.abs(d / unit - F.round(d / unit)) > 1e-9))
    return met.withColumn("violation", off)


def within(rows: DataFrame, time: Column, low: Column, high: Column, slack: int, name: str = "inside") -> DataFrame:
    """Adds whether low - slack <= time <= high + slack; null where one of them is."""
    return rows.withColumn(name, (time >= low - slack) & (time <= high + slack))


def recount(rows: DataFrame, by: list[str], message: str, value: str, recorded: DataFrame | None = None) -> DataFrame:
    """(by, recounted, messages): each message's largest value once; with recorded(by, recorded), that and whether they agree."""
    per = rows.groupBy(*by, message).agg(F.max(value).alias("v"))
    total = per.groupBy(*by).agg(F.sum("v").alias("recounted"), F.count("*").alias("messages"))
    if recorded is None:
        return total
    return total.join(recorded, by, "left").withColumn("agrees", F.col("recounted") == F.col("recorded"))
