"""Claims about a session's own work, held against its calls: modes, digests, counts, scopes, passes, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import digest_defect, digest_supported

#: Families by the source that a claim comes from; others abstain.
FAMILIES = ("marathon", "file", "check", "pass", "chore")
LEAST_ANSWERS, SHARE = 10, 0.8


def _verdict(bad, good, rule: str):
    return F.when(bad, F.lit(f"violation:{rule}")).when(good, F.lit(f"ok:{rule}"))


def mode_never_performed(claims: DataFrame, calls: DataFrame) -> DataFrame:
    """claims(claim_id, session_id, pos, mode) with calls(session_id, pos, mode): a mode that no earlier call has is false."""
    first = calls.groupBy("session_id", "mode").agg(F.min("pos").alias("first"))
    j = claims.join(first, ["session_id", "mode"], "left")
    never = F.col("first").isNull() | (F.col("first") >= F.col("pos"))
    return j.select("claim_id", _verdict(never, ~never, "mode").alias("reason"))


def _merged(claims: DataFrame, *others: DataFrame) -> DataFrame:
    """Claims (what_ = 0) and other rows (1, 2, ...) of a session in one table, so that what lies before and behind a claim is a window."""
    both = claims.withColumn("what_", F.lit(0))
    for k, o in enumerate(others, 1):
        both = both.unionByName(o.withColumn("what_", F.lit(k)), allowMissingColumns=True)
    return both


#: Digits by which claimed and shown digests are matched; shorter ones can't be told apart.
PREFIX = 7


def digest_claims(claims: DataFrame, shown: DataFrame) -> DataFrame:
    """claims(claim_id, session_id, pos, digest) with shown(session_id, pos, digest): its form, then whether an earlier output of the session shows it, either being a prefix of the other.

    Both are matched by session and first PREFIX digits, where the shown ones keep their first place only; whether the session showed
    any digest before is a minimum per session. No claim meets all digests of its session.
    """
    first = shown.groupBy("session_id", F.col("digest").alias("known")).agg(F.min("pos").alias("at"))
    any_before = shown.groupBy("session_id").agg(F.min("pos").alias("least"))
    p = lambda c: F.substring(c, 1, PREFIX)
    met = claims.withColumn("p_", p("digest")).join(first.withColumn("p_", p("known")), ["session_id", "p_"])
    alike = F.col("known").startswith(F.col("digest")) | F.col("digest").startswith(F.col("known"))
    owned = met.where((F.col("at") < F.col("pos")) & alike & (F.length("digest") >= PREFIX)).select("claim_id").distinct().withColumn("own_", F.lit(True))
    j = claims.join(any_before, "session_id", "left").join(owned, "claim_id", "left")
    defect = digest_defect(F.col("digest"))
    other = F.when(F.col("own_"), "ok:digest").when(F.col("least") < F.col("pos"), "violation:digest_not_own").otherwise("missing:no_digest_shown")
    return j.select("claim_id", F.coalesce(F.concat(F.lit("violation:"), defect), other).alias("reason"))


def line_counts(claims: DataFrame, views: DataFrame, changes: DataFrame) -> DataFrame:
    """claims(claim_id, session_id, pos, path, lines) with views(session_id, pos, path, lines) and changes(session_id, pos, path).

    Views after the last change before the claim count; they decide if they all agree. A running count of changes
    numbers the states of a file, inside which a running minimum and maximum say whether the views agree.
    """
    both = _merged(claims, views.withColumnRenamed("lines", "seen"), changes)
    file = Window.partitionBy("session_id", "path").orderBy("pos", "what_")
    # at one place a claim comes first: it sees neither the view nor the change there
    both = both.withColumn("state_", F.count_if(F.col("what_") == 2).over(file.rowsBetween(Window.unboundedPreceding, 0)))
    state = Window.partitionBy("session_id", "path", "state_").orderBy("pos", "what_").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"low_": F.min("seen").over(state), "high_": F.max("seen").over(state)}).where("what_ = 0")
    low, high = F.col("low_"), F.col("high_")
    reason = F.when(low.isNull(), "missing:no_view").when(low != high, "abstain:views_differ").when(low == F.col("lines"), "ok:lines").otherwise("violation:lines")
    return both.select("claim_id", reason.alias("reason"))


def check_scope(claims: DataFrame, runs: DataFrame) -> DataFrame:
    """claims(claim_id, session_id, pos, scope) with runs(session_id, pos, scope, passed): a check said to pass must have run in that scope and passed last."""
    both = _merged(claims, runs)
    past = Window.orderBy("pos", "what_").rowsBetween(Window.unboundedPreceding, -1)
    ran = F.when(F.col("what_") == 1, F.col("passed"))
    scope = past.partitionBy("session_id", "scope")
    both = both.withColumns({"last_": F.last(ran, ignorenulls=True).over(scope), "own_": F.count(ran).over(scope), "all_": F.count(ran).over(past.partitionBy("session_id"))})
    reason = F.when(F.col("last_"), "ok:check").when(~F.col("last_"), "violation:check_failed").when(F.col("all_") > F.col("own_"), "violation:check_substituted").otherwise("missing:no_check")
    return both.where("what_ = 0").select("claim_id", reason.alias("reason"))


def durable_pass(claims: DataFrame, runs: DataFrame, changes: DataFrame) -> DataFrame:
    """claims(claim_id, session_id, pos) with runs(session_id, pos, passed) and changes(session_id, pos): a claimed pass is false if the last run before it failed, or the first after it fails with no change between."""
    both = _merged(claims, runs, changes)
    w = Window.partitionBy("session_id").orderBy("pos", "what_")
    run = F.when(F.col("what_") == 1, F.struct("pos", "passed"))
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    both = both.withColumns({
        "before_": F.last(run, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "next_": F.first(run, ignorenulls=True).over(ahead),
        "changed_": F.min(F.when((F.col("what_") == 2), F.col("pos"))).over(ahead),
    }).where("what_ = 0")
    moved = F.coalesce((F.col("changed_") > F.col("pos")) & (F.col("changed_") < F.col("next_.pos")), F.lit(False))
    reason = F.when(~F.col("before_.passed"), "violation:pass_before_failed").when(~F.col("next_.passed") & ~moved, "violation:pass_not_durable")
    reason = reason.when(F.col("before_.passed"), "ok:pass").otherwise("missing:no_run")
    return both.select("claim_id", reason.alias("reason"))


def answers(claims: DataFrame, least: int = LEAST_ANSWERS, share: float = SHARE) -> DataFrame:
    """claims(claim_id, task_id, answer, grounded): an answer that the session's own output doesn't show is held against the others' consensus, itself left out.

    Counts per task and answer are summed before anything is joined back, so a task with most of the rows is no hot group.
    """
    n = claims.groupBy("task_id", "answer").agg(F.count("*").alias("n"))
    w = Window.partitionBy("task_id").orderBy(F.desc("n"), "answer")
    ranked = n.withColumns({"rank": F.row_number().over(w), "total": F.sum("n").over(Window.partitionBy("task_id"))})
    top = ranked.where("rank <= 2").groupBy("task_id").agg(F.max(F.when(F.col("rank") == 1, F.col("answer"))).alias("top"), F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("top_n"), F.max("total").alias("total"))
    j = claims.join(top, "task_id")
    own = (F.col("answer") == F.col("top")).cast("int")
    others, agree = F.col("total") - 1, F.col("top_n") - own
    settled = (others >= least) & (agree >= share * others)
    return j.select("claim_id", F.when(F.col("grounded"), "ok:answer").when(settled & (own == 1), "ok:consensus").when(settled, "violation:consensus").otherwise("abstain:no_consensus").alias("reason"))


def routed(claims: DataFrame, reasons: DataFrame) -> DataFrame:
    """Every claim with its reason and verdict; sources without a family, and claims without a reason, abstain."""
    j = claims.join(reasons, "claim_id", "left")
    reason = F.when(~F.col("source").isin(*FAMILIES) | F.col("source").isNull(), "abstain:unknown_source").otherwise(F.coalesce("reason", F.lit("abstain:not_decided")))
    out = j.withColumn("reason", reason)
    return out.withColumn("verdict", F.when(F.col("reason").startswith("ok"), "supported").when(F.col("reason").startswith("violation"), "contradicted").otherwise("unconstrained"))
