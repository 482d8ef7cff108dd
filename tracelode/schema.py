"""Schemas of turns, events and verdicts, their closed vocabularies, and validation of an event table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TURN = _struct(turn_id=_S, session_id=_S, turn_number=_L, role=_S, turn_type=_S, content=_S, timestamp=_S, model=_S, tool_name=_S, tool_call_id=_S, file_path=_S, command=_S, tool_input_json=_S, input_tokens=_L, output_tokens=_L, cache_read_input_tokens=_L, cache_creation_input_tokens=_L, uuid=_S, parent_uuid=_S, source=_S)

EVENT = _struct(corpus=_S, session_id=_S, stratum=_S, seq=_L, kind=_S, ts=_S, ts_kind=_S, tool=_S, tool_raw=_S, call_id=_S, args=_S, command=_S, text=_S, stderr=_S, native_error=_B, exit_code=_L, usage_in=_L, usage_out=_L, usage_cache_read=_L, usage_cache_create=_L, api_msg_id=_S, request_id=_S, model=_S, is_subagent=_B, parent_call_id=_S, agent_id=_S, uuid=_S, parent_uuid=_S, extra=_S)

CALL_VERDICT = _struct(session_id=_S, call_key=_S, check=_S, check_version=_S, verdict=_S, strength=_S, confidence=T.DoubleType(), reason=_S, localized=_B, evidence=T.ArrayType(_struct(seq=_L, field=_S, role=_S, value=_S)))

KINDS = ("user", "system", "assistant", "call", "result", "meta")
TS_KINDS = ("event", "row_insert", "shared_turn", "none")
VERDICTS = ("contradicted", "supported", "unconstrained")
#: What the prefix of a reason says about the verdict.
REASON_PREFIX = {"ok": "supported", "violation": "contradicted", "missing": "unconstrained", "abstain": "unconstrained", "error": "unconstrained"}
#: From weakest to strongest.
STRENGTHS = ("none", "weak", "statistical", "strong", "identity")


def schema_sha(schema: T.StructType = EVENT) -> str:
    return hashlib.sha256(schema.json().encode()).hexdigest()


def conform(events: DataFrame) -> DataFrame:
    """The event columns in order and type; a missing column is an error."""
    absent = [f.name for f in EVENT if f.name not in events.columns]
    if absent:
        raise ValueError(f"event columns are missing: {absent}")
    return events.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT])


def violations(events: DataFrame) -> DataFrame:
    """One row of counts: values outside the vocabularies, calls without id, sessions whose seq is not 0..n-1."""
    rows = events.agg(F.count_if(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))).alias("bad_kind"), F.count_if(~F.coalesce(F.col("ts_kind").isin(*TS_KINDS), F.lit(False))).alias("bad_ts_kind"), F.count_if((F.col("kind") == "call") & F.col("call_id").isNull()).alias("calls_without_id"))
    per = events.groupBy("session_id").agg(F.min("seq").alias("a"), F.max("seq").alias("b"), F.count("*").alias("n"), F.countDistinct("seq").alias("d"))
    broken = per.agg(F.count_if((F.col("a") != 0) | (F.col("b") + 1 != F.col("n")) | (F.col("d") != F.col("n"))).alias("broken_sessions"))
    return rows.withColumn("k", F.lit(0)).join(broken.withColumn("k", F.lit(0)), "k").drop("k")
