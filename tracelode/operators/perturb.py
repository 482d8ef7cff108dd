"""Seeded perturbations of turn logs, and how often the checks see them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Perturbations by name: what they do to the target call's turns.
ATTACKS = ("drop_call", "drop_result", "drop_pair", "swap_ids", "stamp_before_call", "shift_later", "digit_flip", "line_drop", "substitute", "reparent", "renumber", "relabel_tool", "duplicate_result")


def eligible(turns: DataFrame) -> DataFrame:
    """(key, call_id, use_pos, result_pos): calls with one use and one later result."""
    own = turns.where("role in ('tool_use', 'tool_result') and tool_call_id is not null").groupBy("key", F.col("tool_call_id").alias("call_id"))
    use, result = F.col("role") == "tool_use", F.col("role") == "tool_result"
    g = own.agg(F.count_if(use).alias("u"), F.count_if(result).alias("r"), F.min(F.when(use, F.col("pos"))).alias("use_pos"), F.min(F.when(result, F.col("pos"))).alias("result_pos"))
    return g.where("u = 1 and r = 1 and use_pos < result_pos").drop("u", "r")


def plan(turns: DataFrame, attacks: tuple[str, ...] = ATTACKS, sessions: int = 100, seeds: tuple[int, ...] = (1,)) -> DataFrame:
    """(plan_id, attack, seed, key, call_id, use_pos, result_pos, partner): for each attack and seed one target in each of so many sessions, all by seeded hashes."""
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("attack"), F.lit(s).alias("seed")) for a in attacks for s in seeds])).alias("c")
    e = eligible(turns).select("*", cells).select("key", "call_id", "use_pos", "result_pos", "c.attack", "c.seed")
    draw = F.xxhash64("key", "call_id", "attack", "seed")
    target = Window.partitionBy("key", "attack", "seed").orderBy(draw, "call_id")
    one = e.withColumns({"n": F.row_number().over(target), "partner": F.lead("call_id").over(target)}).where("n = 1")
    chosen = Window.partitionBy("attack", "seed").orderBy(F.xxhash64("key", "attack", "seed"), "key")
    return one.withColumn("n", F.row_number().over(chosen)).where(F.col("n") <= sessions).select(F.concat_ws("/", "attack", "seed", "key", "call_id").alias("plan_id"), "attack", "seed", "key", "call_id", "use_pos", "result_pos", "partner")


def apply(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """A copy of its session for each plan, with the target's turns changed: key becomes the plan's id.

    An ordinary join with conditional columns: copies are rows and no session meets in one task.
    """
    j = turns.join(plans.select("plan_id", "attack", "key", "call_id", "use_pos", "result_pos", "partner"), "key")
    at_use, at_result = F.col("pos") == F.col("use_pos"), F.col("pos") == F.col("result_pos")
    is_ = lambda a: F.col("attack") == a
    j = j.where(~((is_("drop_call") & at_use) | (is_("drop_result") & at_result) | (is_("drop_pair") & (at_use | at_result))))
    text = F.col("content")
    flipped = F.regexp_replace(text, r"^([^0-9]*)[0-8]", "$19")
    changed = {
        "tool_call_id": F.when(is_("swap_ids") & at_result & F.col("partner").isNotNull(), F.col("partner")).otherwise(F.col("tool_call_id")),
        "timestamp": F.when(is_("stamp_before_call") & at_result, _moved(-3_600_000)).when(is_("shift_later") & at_use, _moved(3_600_000)).otherwise(F.col("timestamp")),
        "content": F.when(is_("digit_flip") & at_result, flipped).when(is_("line_drop") & at_result, F.regexp_replace(text, r"\n[^\n]*\s*$", "")).when(is_("substitute") & at_result, F.lit("ok")).otherwise(text),
        "parent_uuid": F.when(is_("reparent") & at_result, F.lit("u-other")).otherwise(F.col("parent_uuid")),
        "turn_number": F.when(is_("renumber") & at_result, F.col("turn_number") + 1).otherwise(F.col("turn_number")),
        "tool_name": F.when(is_("relabel_tool") & at_result, F.lit("other_tool")).otherwise(F.col("tool_name")),
    }
    for c in changed:
        if c not in turns.columns:
            changed[c] = F.lit(None)
    copies = F.when(is_("duplicate_result") & at_result, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = j.withColumns({c: v for c, v in changed.items() if c in turns.columns}).withColumn("_copy", F.explode(copies))
    # places are doubled so that a repeated turn stands right after its original
    return out.withColumn("pos", F.col("pos") * 2 + F.col("_copy")).withColumn("key", F.col("plan_id")).select(*turns.columns)


def _moved(ms: int) -> Column:
    t = F.col("timestamp")
    number = t.rlike(r"^-?\d+$")
    iso = F.date_format(F.try_to_timestamp(t) + F.expr(f"interval '{ms // 1000}' second"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.when(number, (t.try_cast("bigint") + ms).cast("string")).otherwise(F.coalesce(iso, t))


def detection(plans: DataFrame, found: DataFrame) -> DataFrame:
    """(attack, copies, caught, localized, rate): found(key, calls) are the violations in the copies; localized if the target is among the blamed."""
    hit = plans.join(found.withColumnRenamed("key", "plan_id"), "plan_id", "left")
    g = hit.groupBy("plan_id", "attack").agg(F.coalesce(F.bool_or(F.col("calls").isNotNull()), F.lit(False)).alias("seen"), F.coalesce(F.bool_or(F.array_contains("calls", F.col("call_id"))), F.lit(False)).alias("own"))
    return g.groupBy("attack").agg(F.count("*").alias("copies"), F.count_if("seen").alias("caught"), F.count_if("own").alias("localized")).withColumn("rate", F.round(F.try_divide(F.col("caught").cast("double"), F.col("copies")), 4))


def deletion_neighbours(turns: DataFrame) -> DataFrame:
    """(key, call_id, before, after): the nearest calls on both sides in the log."""
    w = Window.partitionBy("key").orderBy("pos")
    own = turns.where("role = 'tool_use'")
    return own.select("key", F.col("tool_call_id").alias("call_id"), F.lag("tool_call_id").over(w).alias("before"), F.lead("tool_call_id").over(w).alias("after"))
