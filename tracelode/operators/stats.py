"""Statistics per key with uncertainty: proportions, clustered bootstrap, quantiles, ranks, entropy, change points."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import running
from . import bootstrap

SEED, DRAWS = bootstrap.SEED, bootstrap.DRAWS


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """Proportion with its Wilson interval; nulls for n = 0."""
    p = F.try_divide(k.cast("double"), n)
    d = 1 + z * z / n
    centre = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    some = n > 0
    return p, F.when(some, F.greatest(F.lit(0.0), centre / d - half / d)), F.when(some, F.least(F.lit(1.0), centre / d + half / d))


def cluster_sums(rows: DataFrame, cluster: str, num: Column, den: Column) -> DataFrame:
    """The sufficient statistics of a clustered ratio: one row a cluster."""
    return rows.groupBy(cluster).agg(F.sum(num).cast("double").alias("num"), F.sum(den).cast("double").alias("den")).where("den > 0")


def cluster_rate(rows: DataFrame, cluster: str, num: Column, den: Column, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(rate, lo, hi, n_clusters, num, den): a ratio of sums with a clustered bootstrap interval.

    Draws as in bootstrap: sums per task merge in a shuffle of draws, never of rows, so the
    result doesn't depend on partitions and no task holds the clusters.
    """
    per = cluster_sums(rows, cluster, num, den)
    times = lambda c: F.sum(F.col("times") * F.col(c))
    each = bootstrap.drawn(per, cluster, draws, seed).groupBy("draw").agg(F.try_divide(times("num"), times("den")).alias("r"))
    whole = per.agg(
        F.try_divide(F.sum("num"), F.sum("den")).alias("rate"), F.count("*").alias("n_clusters"),
        F.coalesce(F.sum("num"), F.lit(0.0)).alias("num"), F.coalesce(F.sum("den"), F.lit(0.0)).alias("den"),
    )
    limits = bootstrap.limits(each, draws).withColumn("k", F.lit(0))
    return whole.withColumn("k", F.lit(0)).join(limits, "k").select("rate", "lo", "hi", "n_clusters", "num", "den")


def describe(rows: DataFrame, by: list[str], value: str, qs=(0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)) -> DataFrame:
    """n, named quantiles by linear interpolation, and mean of each group; nulls and NaN don't count."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    name = lambda q: {0.0: "min", 1.0: "max"}.get(q, f"p{q * 100:g}".replace(".", "_"))
    return rows.groupBy(*by).agg(F.count(v).alias("n"), *[F.percentile(v, F.lit(q)).alias(name(q)) for q in qs], F.avg(v).alias("mean"))


def log_histogram(rows: DataFrame, value: str, per_decade: int = 4, by: list[str] | None = None) -> DataFrame:
    """Counts in log-spaced bins (bin, lo, hi); values up to zero are one bin with nulls."""
    v = F.col(value).cast("double")
    b = F.when(v > 0, F.floor(F.log10(v) * per_decade))
    edge = lambda c: F.pow(F.lit(10.0), c / per_decade)
    return rows.where(v.isNotNull()).groupBy(*(by or []), b.alias("bin")).agg(F.count("*").alias("n")).withColumns({"lo": edge(F.col("bin")), "hi": edge(F.col("bin") + 1)})


def ranked(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """rows with the average rank of value within by: counts per distinct value are summed first, so only those are ordered together."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    if by:
        w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("_n").over(w), F.lit(0))
    else:  # one group of any size: in two levels
        counts = running(counts, [F.col(value)], ["_n"], "_no")
        before = F.col("_n_before")
        return rows.join(counts.select(value, (before + (F.col("_n") + 1) / 2.0).alias(name)), [value])
    return rows.join(counts.withColumn(name, before + (F.col("_n") + 1) / 2.0).drop("_n"), [*by, value])


def auc(rows: DataFrame, by: list[str], score: str, label: Column) -> DataFrame:
    """Mann-Whitney area per group; null without both labels."""
    r = ranked(rows, by, score, "_rank").withColumn("_y", label.cast("double"))
    p, n = F.sum("_y"), F.sum(1 - F.col("_y"))
    return r.groupBy(*by).agg(F.try_divide(F.sum(F.col("_y") * F.col("_rank")) - p * (p + 1) / 2, p * n).alias("auc"), p.cast("long").alias("positives"), n.cast("long").alias("negatives"))


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    r = ranked(ranked(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), by, x, "_rx"), by, y, "_ry")
    return r.groupBy(*by).agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))


def entropy(counts: DataFrame, by: list[str], n: str) -> DataFrame:
    """(bits, classes, total) of each group's counts."""
    total = F.sum(n)
    return counts.groupBy(*by).agg((F.log2(total) - F.sum(F.col(n) * F.log2(n)) / total).alias("bits"), F.count("*").alias("classes"), total.alias("total"))


def divergence(left: DataFrame, right: DataFrame, key: str, n: str) -> DataFrame:
    """One row: Jensen-Shannon distance (bits, root) and total variation of two count tables over key."""
    p, q = (df.select(key, F.col(n).cast("double").alias(name)) for df, name in ((left, "p"), (right, "q")))
    total = {name: df.agg(F.sum(name)).first()[0] for name, df in (("p", p), ("q", q))}
    both = p.join(q, key, "full")
    both = both.withColumns({c: F.try_divide(F.coalesce(c, F.lit(0.0)), F.lit(total[c]).cast("double")) for c in ("p", "q")})
    m = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / m)).otherwise(0.0)
    return both.agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(part("p") + part("q")) / 2)).alias("js"), (F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tv"))


def robust_z(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds z: distance from the group's median by 1.4826 MAD, or by 1.2533 mean deviation where that is zero."""
    mid = rows.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("_m"))
    off = rows.join(mid, by).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    spread = off.groupBy(*by).agg(F.percentile("_d", F.lit(0.5)).alias("_mad"), F.avg("_d").alias("_aad"))
    scale = F.when(F.col("_mad") > 0, 1.4826 * F.col("_mad")).when(F.col("_aad") > 0, 1.253314 * F.col("_aad"))
    return off.join(spread, by).withColumn("z", F.try_divide(F.col(value) - F.col("_m"), scale)).drop("_m", "_d", "_mad", "_aad")


# --- special functions, for want of a numerical library --------------------------------------


def _gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h, i = d, 0
    while i < 10_000:
        i += 1
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_tail(stat: float, df: int) -> float:
    return _gamma_q(df / 2, stat / 2)


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    tiny, c, d = 1e-300, 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h / a


def clopper_pearson_upper(k: int, n: int, level: float = 0.95) -> float:
    """Upper limit of a proportion by bisection on the beta distribution."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(mid, k + 1, n - k) < level else (lo, mid)
    return (lo + hi) / 2


def chi2_uniform(counts: DataFrame, by: list[str], n: str) -> DataFrame:
    """(stat, df, p, total) of each group's counts against equal shares."""

    @F.pandas_udf("double")
    def tail(stat: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([chi2_tail(s, int(d)) if d and d > 0 else None for s, d in zip(stat, df)], dtype="float64")

    total, k = F.sum(n), F.count("*")
    g = counts.groupBy(*by).agg((F.sum(F.col(n) * F.col(n)) * k / total - total).cast("double").alias("stat"), (k - 1).alias("df"), total.alias("total"))
    return g.withColumn("p", tail("stat", "df"))


def _prefix_quantiles(v: np.ndarray, cuts: list[int], q: float) -> list[float]:
    """The linearly interpolated quantile of each prefix v[:c], c ascending, from one growing sorted list."""
    held: list[float] = []
    out, wanted = [], iter(cuts)
    c = next(wanted, None)
    for n, x in enumerate(v.tolist(), 1):
        bisect.insort(held, x)
        if n == c:
            at, part = divmod((n - 1) * q, 1)
            low = held[int(at)]
            out.append(low + (held[min(int(at) + 1, n - 1)] - low) * part)
            c = next(wanted, None)
    return out


def _best_split(v: np.ndarray, cuts: list[int], q: float) -> tuple[int, float]:
    left = _prefix_quantiles(v, cuts, q)
    right = _prefix_quantiles(v[::-1], [len(v) - c for c in reversed(cuts)], q)[::-1]
    gains = np.abs(np.subtract(left, right))
    k = int(np.argmax(gains))
    return cuts[k], float(gains[k])


def change_point(rows: DataFrame, by: str, order: str, value: str, q: float = 0.1, permutations: int = 199, seed: int = SEED, least: int = 20) -> DataFrame:
    """(by, at, gain, p): the split of a group's ordered values that moves their quantile most, with a permutation p-value.

    Both sides keep at least `least` values; about 100 splits at even steps are tried. Shorter groups have nulls.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[value].dropna().to_numpy(float)
        if len(v) < 2 * least:
            return pd.DataFrame({by: [pdf[by].iloc[0]], "at": [None], "gain": [None], "p": [None]})
        cuts = list(range(least, len(v) - least + 1, max(1, len(v) // 100)))
        at, gain = _best_split(v, cuts, q)
        rng = np.random.default_rng(seed)
        beaten = sum(_best_split(rng.permutation(v), cuts, q)[1] >= gain - 1e-15 for _ in range(permutations))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "at": [at], "gain": [gain], "p": [(beaten + 1) / (permutations + 1)]})

    return rows.select(by, order, value).groupBy(by).applyInPandas(one, f"{by} {dict(rows.dtypes)[by]}, at long, gain double, p double")


def split_gain(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """(by, at, gain): the single split with the largest drop of squared error, from prefix sums in one window."""
    w = Window.partitionBy(*by).orderBy(*order)
    whole = Window.partitionBy(*by)
    v = F.col(value).cast("double")
    r = rows.withColumns({"i": F.row_number().over(w), "s": F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.count("*").over(whole), "t": F.sum(v).over(whole)})
    gain = F.col("s") * F.col("s") / F.col("i") + (F.col("t") - F.col("s")) * (F.col("t") - F.col("s")) / (F.col("n") - F.col("i")) - F.col("t") * F.col("t") / F.col("n")
    return r.where("i < n").withColumn("gain", gain).groupBy(*by).agg(F.max_by("i", F.struct("gain", (-F.col("i")).alias("x"))).cast("long").alias("at"), F.max("gain").alias("gain"))


def huber(rows: DataFrame, xs: list[str], y: str, delta: float = 1.345, rounds: int = 20) -> np.ndarray:
    """Coefficients (intercept last) of a robust regression: reweighted normal equations around a median scale, two aggregations a round."""
    names = [*xs, "_one"]
    df = rows.select(*[F.col(c).cast("double").alias(c) for c in [*xs, y]], F.lit(1.0).alias("_one")).na.drop()
    beta = np.zeros(len(names))
    for _ in range(rounds):
        fit = sum((F.col(c) * float(b) for c, b in zip(names, beta)), F.lit(0.0))
        r = F.abs(F.col(y) - fit)
        scale = 1.4826 * float(df.agg(F.percentile(r, F.lit(0.5))).first()[0] or 1e-9)
        w = F.when(r <= delta * scale, 1.0).otherwise(delta * scale / r)
        sums = df.withColumn("_w", w).agg(*[F.sum(F.col("_w") * F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]], *[F.sum(F.col("_w") * F.col(a) * F.col(y)) for a in names]).first()
        m, at = np.zeros((len(names), len(names))), 0
        for i in range(len(names)):
            for k in range(i, len(names)):
                m[i, k] = m[k, i] = sums[at]
                at += 1
        new = np.linalg.lstsq(m, np.array(sums[at:], float), rcond=None)[0]
        moved, beta = float(np.abs(new - beta).max()), new
        if moved < 1e-9:
            break
    return beta


def clopper_pearson(counts: DataFrame, k: str, n: str, level: float = 0.95) -> DataFrame:
    """Adds upper: the exact upper limit of k / n."""

    @F.pandas_udf("double")
    def limit(ks: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([clopper_pearson_upper(int(a), int(b), level) for a, b in zip(ks, ns)], dtype="float64")

    return counts.withColumn("upper", limit(k, n))


def cell_labels(cells: DataFrame, least: int = 20) -> DataFrame:
    """cells(n, k, n_honest, k_honest) with label: INSUFFICIENT_N; DETECTS or PARTIAL where the recall's lower limit is above the false positives' upper one; else BLIND."""
    p, low, _ = wilson(F.col("k"), F.col("n"))
    _, _, high = wilson(F.col("k_honest"), F.col("n_honest"))
    above = F.coalesce(low > high, F.lit(False))
    return cells.withColumn("label", F.when(F.col("n") < least, "INSUFFICIENT_N").when(above & (p >= 0.5), "DETECTS").when(above, "PARTIAL").otherwise("BLIND"))


def hill(rows: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """(by, alpha): the tail index from the k largest values over the next one; null for groups with fewer."""
    w = Window.partitionBy(*by).orderBy(F.desc(value))
    top = rows.where(F.col(value) > 0).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1)
    g = top.groupBy(*by).agg(F.sum(F.when(F.col("_r") <= k, F.ln(value))).alias("s"), F.max(F.when(F.col("_r") == k + 1, F.ln(value))).alias("base"))
    return g.select(*by, F.try_divide(F.lit(float(k)), F.col("s") - k * F.col("base")).alias("alpha"))


def partial_correlation(rows: DataFrame, by: list[str], x: str, y: str, z: str) -> DataFrame:
    g = rows.groupBy(*by).agg(F.corr(x, y).alias("xy"), F.corr(x, z).alias("xz"), F.corr(y, z).alias("yz"))
    return g.select(*by, F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))).alias("r"))


#: Steps that values may be multiples of, from the largest down.
STEPS = (1000.0, 500.0, 100.0, 50.0, 10.0, 5.0, 1.0, 0.5, 0.1, 0.05, 0.01)


def step_size(rows: DataFrame, by: list[str], value: str, share: float = 0.99) -> DataFrame:
    """(by, step): the largest of STEPS that at least this share of the non-zero values are multiples of; 0 without one."""
    a = F.abs(F.col(value).cast("double"))
    on = lambda s: F.abs(a / s - F.round(a / s)) <= 1e-6 + 1e-12 * (a / s)
    g = rows.where(a > 0).groupBy(*by).agg(*[F.avg(on(s).cast("double")).alias(f"s{i}") for i, s in enumerate(STEPS)])
    return g.select(*by, F.coalesce(*[F.when(F.col(f"s{i}") >= share, F.lit(s)) for i, s in enumerate(STEPS)], F.lit(0.0)).alias("step"))


def segments(rows: DataFrame, by: str, order: str, value: str, model: str = "gauss", least: int = 5) -> DataFrame:
    """(by, cuts): binary segmentation of each group's ordered values, with a penalty of 2 ln n a cut.

    model: gauss (mean and variance change) or bern (rate of 0 and 1).
    """

    def cost(s: np.ndarray, q: np.ndarray, a: int, b: np.ndarray | int):
        n = b - a
        mean = (s[b] - s[a]) / n
        if model == "bern":
            p = np.clip(mean, 1e-9, 1 - 1e-9)
            return -2 * n * (p * np.log(p) + (1 - p) * np.log(1 - p))
        return n * np.log(np.maximum((q[b] - q[a]) / n - mean * mean, 1e-9))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[value].dropna().to_numpy(float)
        s, q = np.r_[0.0, np.cumsum(v)], np.r_[0.0, np.cumsum(v * v)]
        penalty, cuts, todo = 2 * np.log(max(2, len(v))), [], [(0, len(v))]
        while todo:
            a, b = todo.pop()
            at = np.arange(a + least, b - least + 1)
            if not len(at):
                continue
            right = np.array([cost(s, q, c, b) for c in at])
            gain = cost(s, q, a, b) - cost(s, q, a, at) - right
            k = int(np.argmax(gain))
            if gain[k] > penalty:
                cuts.append(int(at[k]))
                todo += [(a, int(at[k])), (int(at[k]), b)]
        return pd.DataFrame({by: [pdf[by].iloc[0]], "cuts": [sorted(cuts)]})

    return rows.select(by, order, value).groupBy(by).applyInPandas(one, f"{by} {dict(rows.dtypes)[by]}, cuts array<long>")


def modes(rows: DataFrame, by: list[str], value: str, width: float, share: float = 0.05) -> DataFrame:
    """(by, modes): peaks of each group's histogram in bins of the width, smoothed over three bins: bins above the one before, not below the one behind, with at least share of the highest.

    Bins without rows are there as zeros, from the first to the last.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))
    ends = counts.groupBy(*by).agg(F.min("bin").alias("a"), F.max("bin").alias("b"))
    grid = ends.select(*by, F.explode(F.sequence(F.col("a") - 1, F.col("b") + 1)).alias("bin"))
    w = Window.partitionBy(*by).orderBy("bin")
    z = grid.join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    smooth = (F.coalesce(F.lag("n").over(w), F.lit(0)) + F.col("n") + F.coalesce(F.lead("n").over(w), F.lit(0))) / 3
    z = z.withColumn("s", smooth)
    top = F.max("s").over(Window.partitionBy(*by))
    peak = (F.col("s") > F.coalesce(F.lag("s").over(w), F.lit(0.0))) & (F.col("s") >= F.coalesce(F.lead("s").over(w), F.lit(0.0))) & (F.col("s") >= share * top)
    return z.withColumn("p", peak).groupBy(*by).agg(F.count_if("p").alias("modes"))


def spikes(rows: DataFrame, by: list[str], value: str, least: int = 10, times: float = 5.0) -> DataFrame:
    """(by, value, n, usual) of values that are there at least `least` times and `times` as often as the group's values are on average."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    usual = n.groupBy(*by).agg((F.sum("n") / F.count("*")).alias("usual"))
    return n.join(usual, by).where((F.col("n") >= least) & (F.col("n") >= times * F.col("usual"))).select(*by, value, "n", "usual")


def least_rows(effect: float, classes: int, level: float = 3.84, power: float = 0.84) -> int:
    """Rows that a chi-square test over so many classes needs to see an effect size w: (z of the level + z of the power) squared over w squared, widened by the degrees of freedom."""
    df = max(1, classes - 1)
    return math.ceil((math.sqrt(level) + power) ** 2 * math.sqrt(df) / effect**2)


def within_correlation(rows: DataFrame, by: list[str], x: str, y: str, least: int = 5) -> DataFrame:
    """(groups, rho): rank correlations inside each group of at least so many rows, averaged by their rows."""
    per = spearman(rows, by, x, y).where((F.col("n") >= least) & F.col("rho").isNotNull() & ~F.isnan("rho"))
    return per.agg(F.count("*").alias("groups"), F.try_divide(F.sum(F.col("rho") * F.col("n")), F.sum("n")).alias("rho"))
