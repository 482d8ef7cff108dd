"""Session views over events: call/result pairs, call keys, provider responses, clocks, streams, capabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pair_calls(events: DataFrame, session: str = "session_id", by: str = "call_id", seq: str = "seq") -> DataFrame:
    """(session, call_id, call_seq, result_seq, n_results): each call with the first result of its id before the id's next call.

    No join: a running count of calls per id numbers the windows, and each window is one group.
    """
    w = Window.partitionBy(session, by).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    own = events.where(F.col("kind").isin("call", "result") & F.col(by).isNotNull()).select(session, by, seq, "kind")
    grouped = own.withColumn("_g", F.count_if(F.col("kind") == "call").over(w)).where("_g > 0")
    return grouped.groupBy(session, by, "_g").agg(F.min(F.when(F.col("kind") == "call", F.col(seq))).alias("call_seq"), F.min(F.when(F.col("kind") == "result", F.col(seq))).alias("result_seq"), F.count_if(F.col("kind") == "result").alias("n_results")).drop("_g")


def orphans(events: DataFrame, session: str = "session_id", by: str = "call_id", seq: str = "seq") -> DataFrame:
    """Results that no earlier call of their id precedes, or that have no id."""
    w = Window.partitionBy(session, by).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    calls = F.count_if(F.col("kind") == "call").over(w)
    return events.withColumn("_c", calls).where((F.col("kind") == "result") & (F.col(by).isNull() | (F.col("_c") == 0))).select(session, by, seq)


def call_keys(events: DataFrame, session: str = "session_id", by: str = "call_id", seq: str = "seq") -> DataFrame:
    """(session, call_id, seq, call_key): the id where one call of the session has it, else id@seq on each."""
    n = F.count("*").over(Window.partitionBy(session, by))
    return events.where("kind = 'call'").withColumn("_n", n).select(session, by, seq, F.when(F.col("_n") == 1, F.col(by).cast("string")).otherwise(F.concat_ws("@", F.col(by).cast("string"), F.col(seq).cast("string"))).alias("call_key"))


def first_pairs(events: DataFrame, session: str = "session_id", by: str = "call_id", time: str = "ts_us") -> DataFrame:
    """First call by first result of each (session, id), with the seconds between: the simpler pairing of perturbation plans."""
    firsts = events.where(F.col("kind").isin("call", "result") & F.col(by).isNotNull()).groupBy(session, by)
    one = lambda kind, col: F.min_by(F.when(F.col("kind") == kind, F.col(col)), F.when(F.col("kind") == kind, F.col("seq")))
    got = firsts.agg(F.min(F.when(F.col("kind") == "call", F.col("seq"))).alias("call_seq"), F.min(F.when(F.col("kind") == "result", F.col("seq"))).alias("result_seq"), one("call", time).alias("_c"), one("result", time).alias("_r"))
    return got.where("call_seq is not null and result_seq is not null").withColumn("delta_s", (F.col("_r") - F.col("_c")) / 1e6).drop("_c", "_r")


def stream(is_subagent: Column, agent: Column) -> Column:
    """`main`, the subagent's id, or `?` for a subagent without one."""
    return F.when(F.coalesce(is_subagent, F.lit(False)), F.when(F.length(agent) > 0, agent).otherwise("?")).otherwise("main")


def responses(events: DataFrame) -> DataFrame:
    """One row per provider response: request id, else message id. Of a message's rows the largest usage_out and the first other usages count, once; messages add up."""
    key = F.coalesce(F.nullif(F.col("request_id"), F.lit("")), F.nullif(F.col("api_msg_id"), F.lit("")))
    own = events.withColumn("resp_key", key).where("resp_key is not null")
    used = F.col("usage_in").isNotNull()
    first = lambda c: F.min_by(F.when(used, F.col(c)), F.when(used & F.col(c).isNotNull(), F.col("seq"))).alias(c)
    per = own.groupBy("session_id", "resp_key", "api_msg_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n_rows"), first("usage_in"), first("usage_cache_read"), first("usage_cache_create"), F.max(F.when(used, F.col("usage_out"))).alias("usage_out"), F.array_sort(F.collect_list(F.when(F.col("kind") == "call", F.struct("seq", "call_id")))).alias("calls"))
    total = [F.sum(c).alias(c) for c in ("usage_in", "usage_out", "usage_cache_read", "usage_cache_create")]
    return per.groupBy("session_id", "resp_key").agg(F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.sum("n_rows").alias("n_rows"), *total, F.array_sort(F.flatten(F.collect_list("calls"))).alias("calls"))


def clock_resolution(events: DataFrame) -> DataFrame:
    """(session_id, resolution_ms): 1000 if a call or result stamp has no fraction, else by the fewest digits."""
    digits = F.length(F.regexp_extract("ts", r"\.(\d+)", 1))
    own = events.where(F.col("kind").isin("call", "result") & F.col("ts").isNotNull()).groupBy("session_id").agg(F.min(digits).alias("d"))
    return own.select("session_id", F.when(F.col("d") == 0, 1000.0).otherwise(F.pow(F.lit(10.0), 3 - F.col("d"))).alias("resolution_ms"))


def capabilities(events: DataFrame) -> DataFrame:
    """(session_id, capabilities): sorted names of what at least one event of the session shows."""
    kind = F.col("kind")
    cr, result, call = kind.isin("call", "result"), kind == "result", kind == "call"
    has = lambda c: F.col(c).isNotNull()
    ids = Window.partitionBy("session_id", "call_id")
    e = events.withColumns({"_called": F.coalesce(F.bool_or(call).over(ids), F.lit(False))})
    from ..functions.text import error_marker

    flags = {
        "api_msg_id": has("api_msg_id"), "causal.uuid": has("uuid") & has("parent_uuid"), "error.exit_code": has("exit_code"),
        "error.marker": result & error_marker(F.col("text")).isNotNull(), "error.native": result & has("native_error"),
        "join.call_id": result & has("call_id") & F.col("_called"), "request_id": kind.isin("assistant", "call", "meta") & has("request_id"),
        "result.text": result & has("text"), "shell.command": has("command"), "subagent": F.coalesce("is_subagent", F.lit(False)),
        "ts.any": has("ts"), "ts.event": cr & (F.col("ts_kind") == "event"), "ts.ms": cr & (F.length(F.regexp_extract("ts", r"\.(\d+)", 1)) >= 3),
        "usage.cache": has("usage_cache_read"), "usage.io": has("usage_in") & has("usage_out"), "usage.out": has("usage_out"),
    }
    g = e.groupBy("session_id").agg(*[F.coalesce(F.bool_or(v), F.lit(False)).alias(k) for k, v in flags.items()], F.count_if(call).alias("_n"), F.countDistinct(F.when(call, F.col("call_id"))).alias("_d"))
    names = F.array(*[F.when(F.col(f"`{k}`"), k) for k in flags], F.when((F.col("_n") > 0) & (F.col("_n") == F.col("_d")), "join.unique"))
    return g.select("session_id", F.array_sort(F.array_compact(names)).alias("capabilities"))
