"""Counts and shares over keys: zero-error tails, dominance, post-stratification, margins, commonest values, session shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zero_tail(rows: DataFrame, session: str, event: Column) -> DataFrame:
    """(sessions, zero, expected): share of sessions without an event against the mean of (1 - p) ** n at the pooled rate p."""
    per = rows.groupBy(session).agg(F.count("*").alias("n"), F.count_if(event).alias("e"))
    # per (n, e) first: the second pass then runs over as many rows as there are distinct pairs
    shapes = per.groupBy("n", "e").agg(F.count("*").alias("m"))
    pooled = shapes.agg((F.sum(F.col("e") * F.col("m")).cast("double") / F.sum(F.col("n") * F.col("m"))).alias("p"))
    p = pooled.first().p
    expected = F.sum(F.col("m") * F.pow(F.lit(1 - p if p is not None else None).cast("double"), F.col("n"))) / F.sum("m")
    return shapes.agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("sessions"),
        F.coalesce(F.sum(F.when(F.col("e") == 0, F.col("m"))), F.lit(0)).alias("zero"),
        expected.alias("expected"),
    )


def dominance(rows: DataFrame, by: list[str], cluster: str) -> DataFrame:
    """(by, top_share, clusters): the largest cluster's share of each group's rows."""
    n = rows.groupBy(*by, cluster).agg(F.count("*").alias("n"))
    share = F.max("n") / F.sum("n").cast("double")
    return n.groupBy(*by).agg(share.alias("top_share"), F.count("*").alias("clusters"))


def post_weights(population: DataFrame, drawn: DataFrame, by: list[str]) -> DataFrame:
    """(by, weight): each cell's share of the population over its share of the sample; cells without sampled rows go."""
    count = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name))
    n, m = population.count(), drawn.count()
    both = count(population, "n").join(count(drawn, "m"), by)
    return both.select(*by, ((F.col("n") / F.lit(float(n))) / (F.col("m") / F.lit(float(m)))).alias("weight"))


def margins(rows: DataFrame, x: str, y: str, event: Column, name: str = "all") -> DataFrame:
    """(x, y, n, events) over both keys, each key alone and all rows, in one pass; name stands for a key that is summed over."""
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = known.cube(x, y).agg(F.count("*").alias("n"), F.count_if(event).alias("events"))
    return g.select(F.coalesce(x, F.lit(name)).alias(x), F.coalesce(y, F.lit(name)).alias(y), "n", "events")


def commonest(rows: DataFrame, value: str, k: int) -> DataFrame:
    """(value, n) of the k commonest values, ties to the smaller; a null counts as a value and is the largest."""
    n = rows.groupBy(value).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), F.asc_nulls_last(value)).limit(k)


def shape(rows: DataFrame, by: list[str], session: str, order: str) -> DataFrame:
    """(by, n, sessions, first_seq, last_seq)."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.countDistinct(session).alias("sessions"),
        F.min(order).alias("first_seq"), F.max(order).alias("last_seq"),
    )


def honest_soundness(rows: DataFrame, check: str = "check") -> DataFrame:
    """(check, calls, false, supported, unconstrained, false_rate): what each check says of honest calls, on which every contradiction is false."""
    v = lambda name: F.count_if(F.col("verdict") == name)
    g = rows.groupBy(check).agg(
        F.count("*").alias("calls"), v("contradicted").alias("false"),
        v("supported").alias("supported"), v("unconstrained").alias("unconstrained"),
    )
    return g.withColumn("false_rate", F.col("false") / F.col("calls"))


def union_with(verdict: Column, baseline: Column) -> Column:
    """Contradicted if either says so, else supported if either does, else unconstrained; a missing verdict says nothing."""
    either = lambda name: F.coalesce(verdict == name, F.lit(False)) | F.coalesce(baseline == name, F.lit(False))
    return F.when(either("contradicted"), "contradicted").when(either("supported"), "supported").otherwise("unconstrained")


def calibrated(rows: DataFrame, table: DataFrame, unit: str = "unit", stratum: str = "stratum", proxies: dict[str, str] | None = None) -> DataFrame:
    """rows with value and borrowed from table(unit, stratum, quantity, value, proxy_ok): a quantity of the unit's stratum, else of the unit, else of its proxy unit.

    A unit's entry for the row's stratum stands in for the unit's own (stratum null) as a whole; the proxy lends
    only the quantities it allows. rows carry the quantity that they ask for.
    """
    t = table.select(F.col(unit).alias("u"), F.col(stratum).alias("s"), F.col("quantity").alias("q"), "value", "proxy_ok")
    strata = t.where("s is not null").select("u", "s").distinct().withColumn("own", F.lit(True)).alias("o")
    r = rows.alias("r").join(strata, (F.col(f"r.{unit}") == F.col("o.u")) & (F.col(f"r.{stratum}") == F.col("o.s")), "left")
    key = F.when(F.col("o.own"), F.col(f"r.{stratum}"))
    r = r.select("r.*", key.alias("key_")).alias("r")
    own = (F.col(f"r.{unit}") == F.col("t.u")) & F.col("r.key_").eqNullSafe(F.col("t.s")) & (F.col("r.quantity") == F.col("t.q"))
    got = r.join(t.alias("t"), own, "left").select("r.*", F.col("t.value").alias("own_")).alias("r")
    pairs = F.create_map(*[F.lit(x) for kv in (proxies or {"": ""}).items() for x in kv])
    lent = (F.element_at(pairs, F.col(f"r.{unit}")) == F.col("p.u")) & F.col("p.s").isNull() & F.col("p.proxy_ok") & (F.col("r.quantity") == F.col("p.q"))
    out = got.join(t.alias("p"), lent, "left")
    borrowed = F.col("r.own_").isNull() & F.col("p.value").isNotNull()
    return out.select("r.*", F.coalesce("r.own_", "p.value").alias("value"), borrowed.alias("borrowed")).drop("own_", "key_")


#: Labels of an effect from weakest to strongest.
LEVELS = ("DEAD", "WEAK", "ALIVE")


def transfer(sessions: Column, p: Column, hi: Column, single_detects: Column, any_hit: Column, least: int = 20) -> Column:
    """ALIVE where honest sessions are flagged at no more than 5 % (10 % at the upper bound) and a single-call edit is detected, WEAK at up to 20 % with any detection, else DEAD."""
    alive = (p <= 0.05) & (hi <= 0.10) & single_detects
    return F.when(sessions < least, "INSUFFICIENT_N").when(alive, "ALIVE").when((p <= 0.20) & any_hit, "WEAK").otherwise("DEAD")


def survival(first: Column, again: Column, effects: Column) -> tuple[Column, Column]:
    """(status, label) of a finding with its first label, that of the second sample (null: not run) and the array of its checks' effects (pass, downgrade, kill, cap_weak), taken in order."""
    levels = F.array(*map(F.lit, LEVELS))
    level = lambda c: F.coalesce(F.array_position(levels, c), F.lit(0)).cast("int")
    a, b = level(first), level(again)
    start = F.when(b > 0, b).otherwise(F.when(again.isNull() | (b == 0), a))

    def after(now: Column, effect: Column) -> Column:
        down = F.greatest(F.lit(1), now - 1)
        return F.when(effect == "kill", F.lit(1)).when(effect == "downgrade", down).when((effect == "cap_weak") & (now > 2), F.lit(2)).otherwise(now)

    end = F.when(start > 0, F.aggregate(F.coalesce(effects, F.array().cast("array<string>")), start, after))
    lowered = ((b > 0) & (a > 0) & (b < a)) | F.exists(F.coalesce(effects, F.array().cast("array<string>")), lambda e: e == "downgrade") | (end < start)
    suffix = F.when(again.isNull(), " (B only, unreplicated)").when(b == 0, " (NOT_REPLICABLE_AT_N)").otherwise("")
    status = F.when(F.coalesce(start, F.lit(0)) == 0, "NOT_RUN").when(end == 1, "KILLED").when(lowered, "DOWNGRADED").otherwise("SURVIVES")
    return F.concat(status, suffix), F.when(F.coalesce(start, F.lit(0)) > 0, F.element_at(levels, F.greatest(end, F.lit(1))))


def confinement(labels: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """(by, confinement): CONFINED where one stratum alone of two or more with a label lies above DEAD, UNTESTABLE with fewer than two, else OK."""
    known = F.col(label).isin(*LEVELS)
    g = labels.groupBy(*by).agg(F.count_if(known).alias("n"), F.count_if(known & (F.col(label) != "DEAD")).alias("up"))
    return g.select(*by, F.when(F.col("n") < 2, "UNTESTABLE").when(F.col("up") == 1, "CONFINED").otherwise("OK").alias("confinement"))
