"""Intervals by a clustered bootstrap: ratios, differences, quantiles, rank statistics.

Every cluster gets a Poisson(1) weight in each draw from a digest of (seed, cluster, draw). So a draw doesn't
depend on how rows are dealt, any engine with MD5 makes the same draws, and what is shuffled are sums per draw.
A digest's first 32 bits are compared with the cumulated Poisson probabilities.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEED, DRAWS = 20261003, 1000
#: Cumulated Poisson(1) probabilities, times 2 ** 32, of 0 to 8.
STEPS = tuple(math.floor(sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) * 2**32) for n in range(9))
#: Sums of draws that a task holds at a time.
HELD = 2**22
#: An interval is given where at least this share of the draws has a value.
VALID = 0.9


def weight(cluster: Column, draw: Column, seed: int = SEED) -> Column:
    """How often a draw takes the cluster."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), cluster.cast("string"), draw.cast("string")))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    # the digest stands once, as the start of a fold, where a sum of comparisons would take it nine times
    start = F.struct(u.alias("u"), F.lit(0).alias("n"))
    fold = F.aggregate(F.array(*map(F.lit, STEPS)), start, lambda acc, s: F.struct(acc["u"].alias("u"), (acc["n"] + (acc["u"] >= s).cast("int")).alias("n")))
    return fold["n"]


def drawn(per: DataFrame, cluster: str, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """per's rows once for each draw, with draw and times, how often the draw takes their cluster: 0 or more.

    The few rows are dealt to all tasks first, as each becomes as many as there are draws.
    """
    tasks = int(per.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = per.repartition(tasks, cluster).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    return each.withColumn("times", weight(F.col(cluster), F.col("draw"), seed))


def limits(per_draw: DataFrame, draws: int, value: str = "r") -> DataFrame:
    """(lo, hi, valid_draws): the middle 95 % of the draws' values, nulls where too few draws have one."""
    got = per_draw.where(F.col(value).isNotNull()).agg(
        F.count("*").alias("valid_draws"),
        F.percentile(value, F.lit(0.025)).alias("lo"),
        F.percentile(value, F.lit(0.975)).alias("hi"),
    )
    enough = F.col("valid_draws") >= math.ceil(VALID * draws)
    return got.select(F.when(enough, F.col("lo")).alias("lo"), F.when(enough, F.col("hi")).alias("hi"), "valid_draws")


def _with(value: DataFrame, interval: DataFrame) -> DataFrame:
    """Two one-row tables side by side."""
    one = F.lit(0).alias("one_")
    return value.select("*", one).join(interval.select("*", one), "one_").drop("one_")


def _ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num, den)


def weighted_rate(rows: DataFrame, cluster: str, num: Column, den: Column, share: Column | None = None, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(rate, lo, hi, valid_draws): a ratio of sums, each cluster counting by the maximum of share in it (1 without)."""
    w = F.lit(1.0) if share is None else share.cast("double")
    per = rows.groupBy(cluster).agg(F.sum(num).cast("double").alias("num"), F.sum(den).cast("double").alias("den"), F.max(w).alias("w")).where("den > 0")
    per = per.select(cluster, (F.col("w") * F.col("num")).alias("num"), (F.col("w") * F.col("den")).alias("den"))
    each = drawn(per, cluster, draws, seed).groupBy("draw").agg(_ratio(F.sum(F.col("times") * F.col("num")), F.sum(F.col("times") * F.col("den"))).alias("r"))
    return _with(per.agg(_ratio(F.sum("num"), F.sum("den")).alias("rate")), limits(each, draws))


def difference(rows: DataFrame, cluster: str, a: tuple[Column, Column], b: tuple[Column, Column], draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(a, b, difference, lo, hi, valid_draws) of two ratios of sums over the same clusters, drawn together."""
    sums = [F.sum(c).cast("double").alias(n) for n, c in zip(("an", "ad", "bn", "bd"), (*a, *b))]
    per = rows.groupBy(cluster).agg(*sums)
    t = lambda c: F.sum(F.col("times") * F.col(c))
    each = drawn(per, cluster, draws, seed).groupBy("draw").agg((_ratio(t("an"), t("ad")) - _ratio(t("bn"), t("bd"))).alias("r"))
    whole = per.agg(_ratio(F.sum("an"), F.sum("ad")).alias("a"), _ratio(F.sum("bn"), F.sum("bd")).alias("b"))
    return _with(whole.withColumn("difference", F.col("a") - F.col("b")), limits(each, draws))


def paired_difference(rows: DataFrame, cluster: str, x: str, y: str, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(mean, lo, hi, valid_draws) of x - y over rows that have both, by clusters."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = weighted_rate(both, cluster, F.col(x) - F.col(y), F.lit(1.0), None, draws, seed)
    return out.withColumnRenamed("rate", "mean")


def quantile(rows: DataFrame, cluster: str, value: str, q: float, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(q, value, lo, hi, valid_draws): a quantile of the pooled values, by linear interpolation; equal values of a cluster are counted before they are drawn."""
    per = rows.where(F.col(value).isNotNull()).groupBy(cluster, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    each = drawn(per, cluster, draws, seed).groupBy("draw").agg(F.percentile("v", F.lit(q), F.col("n") * F.col("times")).alias("r"))
    whole = per.agg(F.lit(q).alias("q"), F.percentile("v", F.lit(q), F.col("n")).alias("value"))
    return _with(whole, limits(each, draws))


def _area(per: DataFrame, by: list[str]) -> DataFrame:
    """per(by, v, p, n): positives and negatives of each value; adds up to the Mann-Whitney area of each group."""
    below = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = per.withColumn("below", F.coalesce(F.sum("n").over(below), F.lit(0)))
    return ranked.groupBy(*by).agg(_ratio(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).cast("double"), F.sum("p") * F.sum("n")).alias("r"))


def area(rows: DataFrame, cluster: str, score: str, positive: Column, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(auc, lo, hi, valid_draws): the Mann-Whitney area of a score, ties counting half."""
    sums = lambda t: (F.sum(t * F.col("p")).alias("p"), F.sum(t * F.col("n")).alias("n"))
    per = rows.where(F.col(score).isNotNull()).groupBy(cluster, F.col(score).cast("double").alias("v"))
    per = per.agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    each = _area(drawn(per, cluster, draws, seed).groupBy("draw", "v").agg(*sums(F.col("times"))), ["draw"])
    whole = _area(per.groupBy(F.lit(0).alias("draw"), "v").agg(*sums(F.lit(1))), ["draw"])
    return _with(whole.select(F.col("r").alias("auc")), limits(each, draws))


def weights(cluster: str | None, draws: int, seed: int = SEED) -> np.ndarray:
    """weight() of one cluster, named as Spark casts it to a string, in the draws from 1 on."""
    head = ":".join([str(seed), *([] if cluster is None else [cluster]), ""]).encode()
    held = b"".join(hashlib.md5(head + b"%d" % d, usedforsecurity=False).digest() for d in range(1, draws + 1))
    return np.searchsorted(np.array(STEPS), np.frombuffer(held, ">u4")[::4].astype(np.int64), side="right")


def _cell_sums(draws: int, seed: int):
    """Reads (cluster, x, y, n) sorted by cluster; yields (x, y, sums), where sums has n times the cluster's weight in every draw, added up over rows of one (x, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[float, float], np.ndarray] = {}
        schema = pa.schema([("x", pa.float64()), ("y", pa.float64()), ("sums", pa.list_(pa.int64()))])

        def out() -> pa.RecordBatch:
            ends = np.arange(0, (len(held) + 1) * draws, draws, dtype=np.int32)
            sums = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(list(held.values()))))
            return pa.record_batch([pa.array([x for x, _ in held], pa.float64()), pa.array([y for _, y in held], pa.float64()), sums], schema=schema)

        last, times = (), None
        for b in batches:
            for cluster, x, y, n in zip(*[c.to_pylist() for c in b.columns]):
                if cluster != last:
                    last, times = cluster, weights(cluster, draws, seed)
                if (x, y) in held:
                    held[x, y] += n * times
                else:
                    held[x, y] = n * times
                if len(held) * draws >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return run


def _rho(cells: DataFrame) -> DataFrame:
    """Weighted rank correlation of cells(draw, x, y, t), one row a cell: ranks of equal values are the middle of their places.

    A draw's cells are shuffled once: the places are running sums over windows of the draw.
    """
    for c in ("x", "y"):
        upto = F.sum("t").over(Window.partitionBy("draw").orderBy(c).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        # the last place of the value, less half of its other places
        cells = cells.withColumn(f"r{c}", upto - (F.sum("t").over(Window.partitionBy("draw", c)) - 1) / 2.0)
    t = F.col("t").cast("double")
    s = lambda e: F.sum(t * e)
    g = cells.groupBy("draw").agg(F.sum(t).alias("w"), s(F.col("rx")).alias("sx"), s(F.col("ry")).alias("sy"), s(F.col("rx") * F.col("ry")).alias("sxy"), s(F.col("rx") * F.col("rx")).alias("sxx"), s(F.col("ry") * F.col("ry")).alias("syy"))
    cov = lambda a, b, ab: F.col(ab) - F.col(a) * F.col(b) / F.col("w")
    return g.select("draw", _ratio(cov("sx", "sy", "sxy"), F.sqrt(cov("sx", "sx", "sxx") * cov("sy", "sy", "syy"))).alias("r"))


def spearman(rows: DataFrame, cluster: str, x: str, y: str, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(rho, lo, hi, valid_draws): rank correlation of the pooled rows, ranks being taken anew in each draw.

    A cluster's weights are taken once, and its rows are added to the sums of their (x, y) over all draws
    before anything is shuffled, so what is shuffled has a row for each distinct pair of values of a task.
    """
    own = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    per = own.groupBy(cluster, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("n"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = per.select(F.col(cluster).cast("string").alias("cluster"), "x", "y", "n")
    sums = named.repartition(tasks, "cluster").sortWithinPartitions("cluster").mapInArrow(_cell_sums(draws, seed), "x double, y double, sums array<long>")
    each = sums.select("x", "y", F.posexplode("sums").alias("at", "t")).groupBy((F.col("at") + 1).alias("draw"), "x", "y").agg(F.sum("t").alias("t"))
    whole = per.groupBy(F.lit(0).alias("draw"), "x", "y").agg(F.sum("n").alias("t"))
    return _with(_rho(whole).select(F.col("r").alias("rho")), limits(_rho(each), draws))
