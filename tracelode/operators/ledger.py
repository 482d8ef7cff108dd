"""Token conservation: windows between usage-bearing turns, a linear account of what should have entered the prompt, and its verdicts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import FEATURES, split_think, text_counts
from ..tables import written


def windows(turns: DataFrame) -> DataFrame:
    """One row per pair of consecutive anchors of turns(key, pos, + turn columns).

    An anchor is an assistant turn with both usages. A call right after an anchor is part
    of its output; other calls count as unbilled. Sums of text counts come in three
    groups: r results, c unbilled calls, k the anchor's reasoning. A running count of
    anchors numbers the windows, so the whole is one window and one aggregation.
    """
    log = Window.partitionBy("key").orderBy("pos")
    anchor = (F.col("role") == "assistant") & F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    t = turns.withColumn("anchor", F.coalesce(anchor, F.lit(False))).withColumns({"w": F.count_if("anchor").over(log.rowsBetween(Window.unboundedPreceding, 0)), "own_call": (F.col("role") == "tool_use") & F.coalesce(F.lag("anchor").over(log), F.lit(False))}).where("w > 0")
    think, _ = split_think(F.coalesce("content", F.lit("")))
    call_text = F.concat(F.coalesce("tool_name", F.lit("")), F.lit(" "), F.coalesce("tool_input_json", "content", F.lit("")))
    text = F.when(F.col("anchor"), think).when(F.col("role") == "tool_use", call_text).when(F.col("role") == "tool_result", F.coalesce("content", F.lit(""))).otherwise("")
    t = t.withColumn("n", text_counts(text))
    result, unbilled, other = F.col("role") == "tool_result", (F.col("role") == "tool_use") & ~F.col("own_call"), ~F.col("anchor") & ~F.coalesce(F.col("role").isin("tool_use", "tool_result"), F.lit(False))
    sums = [F.coalesce(F.sum(F.when(on, F.col(f"n.{f}"))), F.lit(0.0)).alias(f"{g}_{f}") for g, on in (("r", result), ("c", unbilled), ("k", F.col("anchor"))) for f in FEATURES]
    calls = F.array_sort(F.collect_set(F.when(F.col("role").isin("tool_use", "tool_result"), F.col("tool_call_id"))))
    per = t.groupBy("key", "w").agg(F.min(F.when(F.col("anchor"), F.col("pos"))).alias("pos"), F.max(F.when(F.col("anchor"), F.col("input_tokens"))).cast("double").alias("in_i"), F.max(F.when(F.col("anchor"), F.col("output_tokens"))).cast("double").alias("out_i"), F.count_if(result).cast("double").alias("n_results"), F.count_if(unbilled).cast("double").alias("n_calls_nousage"), F.count_if(other).alias("n_user"), calls.alias("call_ids"), *sums)
    growth = F.lead("in_i").over(Window.partitionBy("key").orderBy("w")) - F.col("in_i")
    return per.withColumn("growth", growth).where("growth is not null").withColumn("intercept", F.lit(1.0))


NAMES = ("intercept", "out_i", "n_results", "n_calls_nousage", *(f"{g}_{f}" for g in "rck" for f in FEATURES))


def predicted(coef: dict[str, float]) -> Column:
    return sum((F.col(n) * float(coef[n]) for n in NAMES if n in coef), F.lit(0.0))


def scale(coef: dict[str, float]) -> Column:
    """Estimated tokens of a window: absolute values of the three groups' sums."""
    return sum((F.abs(sum((F.col(f"{g}_{f}") * float(coef.get(f"{g}_{f}", 0.0)) for f in FEATURES), F.lit(0.0))) for g in "rck"), F.lit(0.0))


def verdicts(turns: DataFrame, coef: dict[str, float], abs_tokens: float, rel: float, long_chars_max: float = float("inf")) -> DataFrame:
    """(key, call_id, verdict, reason, confidence, localized): contradicted where the prompt's growth and the logged content differ by more than the tolerance.

    Of a call's windows a contradiction wins, then the latest.
    """
    w = windows(turns).withColumns({"residual": predicted(coef) - F.col("growth"), "tolerance": abs_tokens + rel * scale(coef)})
    off = F.abs("residual") > F.col("tolerance")
    excess = F.abs("residual") / F.greatest("tolerance", F.lit(1.0)) - 1
    reason = F.when(F.col("n_user") > 0, "abstain:history_rerendered_at_user_turn").when(F.col("r_long_chars") > long_chars_max, "abstain:tokenization_uncertain_content").when(off & (F.col("residual") > 0), "violation:token_growth_logged_text_larger").when(off, "violation:token_growth_logged_text_smaller").otherwise("abstain:below_threshold")
    confidence = F.round(F.least(F.lit(0.999), 0.5 + 0.5 * (1 - F.exp(-3 * excess))), 3)
    j = w.withColumn("reason", reason).withColumns({"bad": F.col("reason").startswith("violation"), "call_id": F.explode("call_ids")})
    pick = F.max(F.struct("bad", "w", "reason", confidence.alias("c"), ((F.col("n_results") == 1) & (F.size("call_ids") == 1)).alias("loc"))).alias("v")
    best = j.groupBy("key", "call_id").agg(pick)
    named = turns.where("role in ('tool_use', 'tool_result') and tool_call_id is not null").select("key", F.col("tool_call_id").alias("call_id")).distinct()
    out = named.join(best, ["key", "call_id"], "left")
    bad = F.coalesce("v.bad", F.lit(False))
    return out.select("key", "call_id", F.when(bad, "contradicted").otherwise("unconstrained").alias("verdict"), F.coalesce("v.reason", F.lit("missing:no_usage_window")).alias("reason"), F.when(bad, F.col("v.c")).alias("confidence"), F.when(bad, F.col("v.loc")).otherwise(False).alias("localized"))


def fit(w: DataFrame, names: tuple[str, ...] = NAMES, y: str = "growth", keep: float = 0.995, rounds: int = 3) -> dict[str, float]:
    """Trimmed least squares by normal equations: rows never leave the cluster, each round drops the largest residuals.

    The windows are written once, as every round reads them.
    """
    w = written(w.select(*names, y), "windows")
    beta, rows = None, w
    for _ in range(rounds):
        if beta is not None:
            off = w.withColumn("_r", F.abs(F.col(y) - sum((F.col(n) * b for n, b in beta.items()), F.lit(0.0))))
            limit = off.agg(F.percentile("_r", F.lit(keep))).first()[0]
            rows = off.where(F.col("_r") <= F.lit(limit))
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
        got = rows.agg(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs], *[F.sum(F.col(a) * F.col(y)) for a in names]).first()
        m = np.zeros((len(names), len(names)))
        for (a, b), v in zip(pairs, got):
            i, k = names.index(a), names.index(b)
            m[i, k] = m[k, i] = v or 0.0
        solved = np.linalg.lstsq(m + 1e-9 * np.eye(len(names)), np.array([v or 0.0 for v in got[len(pairs) :]], float), rcond=None)[0]
        beta = dict(zip(names, map(float, solved)))
    return beta


def threshold(w: DataFrame, coef: dict[str, float], rel: float, margin: float = 1.10, extra: float = 5.0) -> float:
    """The absolute tolerance under which no window of honest logs is contradicted."""
    top = w.agg(F.max(F.abs(predicted(coef) - F.col("growth")) - rel * scale(coef))).first()[0]
    return max(0.0, top or 0.0) * margin + extra
