"""The bootstrap of rank correlations takes a cluster's weights once and shuffles sums, and says the same as a plain one."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tracelode.operators import bootstrap

DRAWS = 40


def test_weights_are_those_of_the_column(spark):
    names = ["7", "-3", "é", "", None]
    rows = spark.createDataFrame([(c,) for c in names], "c string").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(300))))
    want = {(r.c, r.draw): r.w for r in rows.select("c", "draw", bootstrap.weight(F.col("c"), F.col("draw")).alias("w")).collect()}
    assert {(c, d + 1): int(w) for c in names for d, w in enumerate(bootstrap.weights(c, 300))} == want


def _ranks(v):
    return np.array([np.sum(v < a) + (np.sum(v == a) + 1) / 2 for a in v])


@pytest.mark.parametrize("held", [1, 2**22])
def test_spearman_is_that_of_repeated_rows(spark, monkeypatch, held):
    """Ties, repeated rows, a null cluster and nulls; sums that are given out early are added up."""
    rng = random.Random(4)
    rows = [(rng.choice([*range(9), None]), *rng.choice([(float(rng.randrange(6)), rng.random() * 3 // 1), (rng.random(), -0.0), (0.0, 0.5)])) for _ in range(150)]
    rows += rows[:20] + [(1, None, 2.0), (2, 2.0, None)]
    monkeypatch.setattr(bootstrap, "HELD", held)
    got = bootstrap.spearman(spark.createDataFrame(rows, "c long, x double, y double"), "c", "x", "y", DRAWS).first()
    full = [r for r in rows if r[1] is not None and r[2] is not None]

    def rho(times):
        x, y = (np.repeat([r[k] for r in full], times) for k in (1, 2))
        return np.corrcoef(_ranks(x), _ranks(y))[0, 1]

    per = {c: bootstrap.weights(None if c is None else str(c), DRAWS) for c in {r[0] for r in full}}
    each = [rho([int(per[r[0]][d]) for r in full]) for d in range(DRAWS)]
    assert got.rho == pytest.approx(rho([1] * len(full))) and got.valid_draws == DRAWS
    assert [got.lo, got.hi] == pytest.approx([np.quantile(each, 0.025), np.quantile(each, 0.975)])


def test_no_plan_joins_drawn_rows(spark):
    """Rows times draws are neither shuffled nor joined: one join only puts the two results side by side."""
    df = spark.createDataFrame([(k % 5, float(k % 7), float(k % 3)) for k in range(60)], "c long, x double, y double")
    plan = bootstrap.spearman(df, "c", "x", "y", DRAWS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "sequence(" not in plan
