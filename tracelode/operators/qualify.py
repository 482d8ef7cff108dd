"""Which call/result pairs wait for no human: conjuncts over the pair, its message, hooks and the approval policy in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.errors import REFUSED

#: Classes of tools whose calls run without anyone's leave, and statuses of calls that did not run to their end: fixed values.
CLASSES, UNFINISHED = ("shell", "auto_read"), ("declined", "cancelled", "running")
#: The conjuncts in the order in which a pair's first failure is named.
CONJUNCTS = ("latency", "class", "stdin", "last_of_message", "refusal", "status", "hook", "policy", "background")


def last_of_message(calls: DataFrame) -> DataFrame:
    """calls(session_id, call_id, seq, api_msg_id) with last: no later call of the same message; a call without message is its own."""
    message = F.coalesce("api_msg_id", F.concat(F.lit("__solo__"), F.col("call_id")))
    w = Window.partitionBy("session_id", message)
    return calls.withColumn("last", F.col("seq") == F.max("seq").over(w))


def policy_in_force(pairs: DataFrame, policies: DataFrame) -> DataFrame:
    """pairs(session_id, seq) with policy: that of the latest of policies(session_id, seq, policy) strictly before it."""
    both = pairs.withColumn("p_", F.lit(None).cast("string")).unionByName(policies.select("session_id", "seq", F.col("policy").alias("p_")), allowMissingColumns=True)
    past = Window.partitionBy("session_id").orderBy("seq", F.col("p_").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    named = both.withColumns({"policy": F.last("p_", ignorenulls=True).over(past), "mark_": F.col("p_").isNotNull()})
    return named.where(~F.col("mark_")).drop("p_", "mark_")


def qualified(pairs: DataFrame, hooks: DataFrame | None = None, policies: DataFrame | None = None, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """pairs(session_id, call_id, seq, latency, cls, tool, last, marker, status, background) with failed, the first conjunct that fails, or null for a qualified pair.

    hooks(session_id, call_id) are calls that a hook has touched; policies as in policy_in_force, of which only `never` asks nobody.
    Without either table its conjunct holds. A null status or marker says nothing against a pair, a null latency does.
    """
    p = pairs.withColumn("hooked_", F.lit(False))
    if hooks is not None:
        touched = hooks.select("session_id", "call_id").distinct().withColumn("h_", F.lit(True))
        p = pairs.join(touched, ["session_id", "call_id"], "left").withColumn("hooked_", F.coalesce("h_", F.lit(False))).drop("h_")
    p = p.withColumn("policy", F.lit("never")) if policies is None else policy_in_force(p, policies)
    said = lambda c, *values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    latency = yes((F.col("latency") > 0) & (F.col("latency") < float("inf")) & ~F.isnan(F.col("latency").cast("double")))
    holds: dict[str, Column] = {
        "latency": latency, "class": said("cls", *classes), "stdin": ~said("tool", "write_stdin"), "last_of_message": F.coalesce("last", F.lit(True)),
        "refusal": ~said("marker", *REFUSED), "status": ~said("status", *UNFINISHED), "hook": ~F.col("hooked_"), "policy": said("policy", "never"),
        "background": ~F.coalesce("background", F.lit(False)),
    }
    failed = F.coalesce(*[F.when(~holds[c], c) for c in CONJUNCTS], F.lit(None).cast("string"))
    return p.withColumn("failed", failed).drop("hooked_")
