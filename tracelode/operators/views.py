"""Sessions as a check sees them: one output replaced by a claim, inputs with a fallback, answers joined after verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def spliced(turns: DataFrame, specs: DataFrame, key: str, order: str, call: str, result: Column, content: str) -> DataFrame:
    """turns once for each view of specs(view_id, key, call, claimed), the call's first result holding the claimed text.

    A view whose call has no result is the session as it is; spliced says which rows were replaced.
    """
    s = specs.select("view_id", key, F.col(call).alias("target_"), F.col("claimed").alias("claimed_"))
    copies = turns.join(s, key)
    hit = F.coalesce(result & (F.col(call) == F.col("target_")), F.lit(False))
    upto = Window.partitionBy("view_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    copies = copies.withColumn("hit_", hit).withColumn("spliced", F.col("hit_") & (F.count_if("hit_").over(upto) == 1))
    text = F.when(F.col("spliced"), F.col("claimed_")).otherwise(F.col(content))
    return copies.withColumn(content, text).drop("target_", "claimed_", "hit_")


def with_fallback(rows: DataFrame, first: DataFrame, second: DataFrame, on: list[str], value: str) -> DataFrame:
    """rows with value and provenance: that of first, else of second, else null; both have at most one row a key."""
    a = first.select(*on, F.col(value).alias("a_"), F.lit("first").alias("pa_"))
    b = second.select(*on, F.col(value).alias("b_"), F.lit("second").alias("pb_"))
    both = rows.join(a, on, "left").join(b, on, "left")
    where = F.when(F.col("a_").isNotNull(), F.col("pa_")).when(F.col("b_").isNotNull(), F.col("pb_")).otherwise("none")
    return both.select(*rows.columns, F.coalesce("a_", "b_").alias(value), where.alias("provenance"))


def answered(verdicts: DataFrame, answers: DataFrame, on: str, label: str) -> DataFrame:
    """verdicts with the label that the answers give, joined last so that no check can see it; `unlabelled` without one."""
    return verdicts.join(answers.select(on, F.col(label)), on, "left").withColumn(label, F.coalesce(label, F.lit("unlabelled")))


def parent_links(events: DataFrame, session: str, order: str, stream: str, parent: str, call: str, is_call: Column) -> DataFrame:
    """(session, stream, parent, call_seq, call_stream, depth) of each subagent's stream: the call that its first row names, and how many calls lie above it (at most two).

    A call that isn't there leaves nulls and depth 0; of several calls of one id the first counts.
    """
    subs = events.where(F.col(stream) != "main").groupBy(session, stream).agg(F.min_by(parent, order).alias("parent"))
    calls = events.where(is_call & F.col(call).isNotNull()).groupBy(session, F.col(call).alias("parent"))
    calls = calls.agg(F.min_by(F.struct(F.col(order).alias("seq"), F.col(stream).alias("stream")), order).alias("c"))
    linked = subs.join(calls, [session, "parent"], "left").select(session, stream, "parent", F.col("c.seq").alias("call_seq"), F.col("c.stream").alias("call_stream"))
    above = linked.select(session, F.col(stream).alias("call_stream"), F.col("call_seq").alias("above_"))
    two = F.when(F.col("above_").isNotNull(), 2).when(F.col("call_seq").isNotNull(), 1).otherwise(0)
    return linked.join(above, [session, "call_stream"], "left").select(session, stream, "parent", "call_seq", "call_stream", two.alias("depth"))
