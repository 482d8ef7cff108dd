"""Structural checks of a turn log as window queries: pairing, identity, record chain, numbering, clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Most specific first: the order in which a call's deciding reason is chosen. Fixed values.
RULES = ("orphan_result", "result_before_call", "duplicate_call_id", "missing_result", "result_not_adjacent", "tool_name_mismatch", "session_id_mismatch", "turn_id_mismatch", "uuid_duplicate", "parent_chain_break", "turn_number_gap", "timestamp_regression")
CONFIDENCE = 0.99999
SESSION = "__session__"
#: The harness whose logs the rules hold for.
PROFILE = "swarm"


def seconds(stamp: Column) -> Column:
    """Epoch seconds of an ISO stamp (no zone: UTC) or of a number of milliseconds; null if it is neither."""
    zoned = F.regexp_replace(stamp, r"Z$", "+00:00")
    zoned = F.when(zoned.rlike(r"[+-]\d\d:\d\d$"), zoned).otherwise(F.concat(zoned, F.lit("+00:00")))
    trimmed = F.regexp_replace(F.regexp_replace(zoned, "^(\\d{4}-\\d\\d-\\d\\d) ", "$1T"), r"(\.\d{6})\d+", "$1")
    return F.when(stamp.rlike(r"^-?\d+(\.\d+)?$"), stamp.try_cast("double") / 1000).otherwise(F.unix_micros(F.try_to_timestamp(trimmed)) / 1e6)


def positioned(turns: DataFrame) -> DataFrame:
    """Adds what the rules look at around a turn; key is the log that a turn stands in, pos its place there."""
    log = Window.partitionBy("key").orderBy("pos")
    same = Window.partitionBy("key", "tool_call_id")
    before, after = same.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1), same.orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("key")
    use, result = F.col("role") == "tool_use", F.col("role") == "tool_result"
    named = F.col("tool_call_id").isNotNull()
    t = turns.withColumns({"use": F.coalesce(use & named, F.lit(False)), "result": F.coalesce(result & named, F.lit(False)), "tool_turn": F.coalesce(use | result, F.lit(False)), "at": seconds(F.col("timestamp"))})
    t = t.withColumns({
        "row": F.row_number().over(log), "rows": F.count("*").over(whole),
        "uses": F.count_if("use").over(same), "results": F.count_if("result").over(same),
        "uses_before": F.count_if("use").over(before), "next_result": F.min(F.when(F.col("result"), F.col("pos"))).over(after),
        "use_names": F.collect_set(F.when(F.col("use"), F.coalesce("tool_name", F.lit("\0")))).over(same), "result_names": F.collect_set(F.when(F.col("result"), F.coalesce("tool_name", F.lit("\0")))).over(same),
        "first_result": F.min(F.when(F.col("result"), F.col("pos"))).over(same), "first_pos": F.min("pos").over(same),
        "session_0": F.first("session_id").over(log), "uuid_nth": F.row_number().over(Window.partitionBy("key", "uuid").orderBy("pos")),
        "uuids_whole": F.bool_and(F.col("uuid").isNotNull()).over(whole), "numbers_whole": F.bool_and(F.col("turn_number").isNotNull()).over(whole),
        "profiled": F.bool_and(F.coalesce(F.col("source") == PROFILE, F.lit(False))).over(whole),
        "prev_uuid": F.lag("uuid").over(log), "prev_number": F.lag("turn_number").over(log),
        "prev_role": F.lag("role").over(log), "prev_call": F.lag("tool_call_id").over(log), "next_pos": F.lead("pos").over(log),
        "prev_at": F.lag("at").over(log), "prev2_at": F.lag("at", 2).over(log), "next_at": F.lead("at").over(log)})
    return t


def find(turns: DataFrame) -> DataFrame:
    """Violations of turns(key, pos, + turn columns): (key, pos, rule, calls).

    pos is the file order and is never re-sorted by time. calls is empty where no single
    call is to blame. All rules come from one partitioning by key and a second by key and
    call id; nothing is joined.
    """
    t = positioned(turns)
    own = F.array_compact(F.array(F.when(F.col("tool_turn"), F.col("tool_call_id"))))
    mine = F.array("tool_call_id")
    edge = F.array_sort(F.array_distinct(F.array_compact(F.array(F.when(F.col("role") == "tool_result", F.col("tool_call_id")), F.when(F.col("prev_role") == "tool_use", F.col("prev_call"))))))
    first = F.col("row") == 1
    named = lambda names: ~F.array_contains(names, "\0") & (F.size(names) > 0)
    parent_off = ~F.col("parent_uuid").eqNullSafe(F.col("prev_uuid"))
    back = F.col("next_at").isNull() | (F.col("next_at") >= F.col("prev_at"))
    forward = F.col("prev2_at").isNull() | (F.col("at") >= F.col("prev2_at"))
    this_tool, prev_tool = F.col("tool_turn"), F.coalesce(F.col("prev_role").isin("tool_use", "tool_result"), F.lit(False))
    own_pair = (F.col("role") == "tool_result") & (F.col("prev_role") == "tool_use") & F.col("tool_call_id").eqNullSafe(F.col("prev_call"))
    outliers = F.array_sort(F.array_distinct(F.array_compact(F.array(F.when(this_tool & (back | ~forward), F.col("tool_call_id")), F.when(prev_tool & (forward | ~back), F.col("prev_call"))))))
    fired = {
        "duplicate_call_id": ((F.col("use") | F.col("result")) & (F.col("pos") == F.col("first_pos")) & ((F.col("uses") > 1) | (F.col("results") > 1)), mine),
        "orphan_result": (F.col("result") & (F.col("uses") == 0), mine),
        "result_before_call": (F.col("result") & (F.col("uses") > 0) & (F.col("uses_before") == 0), mine),
        "missing_result": (F.col("use") & F.col("next_result").isNull() & (F.col("row") < F.col("rows")), mine),
        "result_not_adjacent": (F.col("use") & (F.col("next_result") != F.col("next_pos")), mine),
        "tool_name_mismatch": (F.col("result") & (F.col("pos") == F.col("first_result")) & named(F.col("use_names")) & named(F.col("result_names")) & (F.array_sort("use_names") != F.array_sort("result_names")), mine),
        "session_id_mismatch": (F.col("session_id") != F.col("session_0"), own),
        "turn_id_mismatch": (F.col("turn_id") != F.concat("session_id", F.lit(":"), "turn_number"), own),
        "uuid_duplicate": (F.col("uuid").isNotNull() & (F.col("uuid_nth") > 1), own),
        "parent_chain_break": (F.col("uuids_whole") & F.when(first, F.col("parent_uuid").isNotNull()).otherwise(parent_off), F.when(first, own).otherwise(edge)),
        "turn_number_gap": (F.col("numbers_whole") & F.when(first, F.col("turn_number") != 1).otherwise(F.col("turn_number") - F.col("prev_number") != 1), F.when(first, own).otherwise(edge)),
        "timestamp_regression": (F.col("at") < F.col("prev_at"), F.when(own_pair, mine).otherwise(outliers)),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.array_compact(calls).alias("calls"))) for rule, (on, calls) in fired.items()]), lambda x: x.isNotNull())
    return t.withColumn("found", F.explode(found)).select("key", "pos", "found.rule", "found.calls")


def verdicts(turns: DataFrame) -> DataFrame:
    """One row per call id of a log, and one for the log itself if a violation blames no call: (key, call_id, verdict, reason, rules).

    Logs of another harness abstain. An intact call in a broken log abstains; a call that
    ends the log unanswered is missing its result.
    """
    rank = F.create_map(*[x for k, r in enumerate(RULES) for x in (F.lit(r), F.lit(k))])
    blamed = find(turns).withColumn("call_id", F.explode(F.when(F.size("calls") > 0, F.col("calls")).otherwise(F.array(F.lit(SESSION)))))
    ranked = blamed.groupBy("key", "call_id").agg(F.transform(F.array_sort(F.collect_set(F.struct(rank[F.col("rule")], "rule"))), lambda x: x["rule"]).alias("rules"))
    named = turns.where("role in ('tool_use', 'tool_result') and tool_call_id is not null")
    last = turns.groupBy("key").agg(F.max("pos").alias("last"), F.bool_and(F.coalesce(F.col("source") == PROFILE, F.lit(False))).alias("profiled"))
    calls = named.groupBy("key", F.col("tool_call_id").alias("call_id")).agg(F.count_if(F.col("role") == "tool_result").alias("results"), F.max(F.when(F.col("role") == "tool_use", F.col("pos"))).alias("last_use"))
    broken = ranked.select("key").distinct().withColumn("broken", F.lit(True))
    judged = calls.join(ranked, ["key", "call_id"], "full").join(last, "key").join(broken, "key", "left")
    cut = (F.col("results") == 0) & (F.col("last_use") == F.col("last"))
    reason = F.when(~F.col("profiled"), "abstain:unvalidated_harness").when(F.col("rules").isNotNull(), F.concat(F.lit("violation:"), F.col("rules")[0])).when(cut, "missing:result_truncated_at_end").when(F.coalesce("broken", F.lit(False)), "abstain:session_structure_broken").otherwise("ok:structure_intact")
    out = judged.withColumn("reason", reason).where(F.col("profiled") | (F.col("call_id") != SESSION))
    verdict = F.when(F.col("reason").startswith("violation"), "contradicted").when(F.col("reason").startswith("ok"), "supported").otherwise("unconstrained")
    return out.select("key", "call_id", verdict.alias("verdict"), "reason", F.when(F.col("profiled"), F.coalesce("rules", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("rules"), F.when(verdict == "contradicted", F.lit(CONFIDENCE)).alias("confidence"))
