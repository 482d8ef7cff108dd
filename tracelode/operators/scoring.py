"""Composition of verdicts, label joins, stratified scores, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import STRENGTHS
from ..tables import running

CONTRADICTED, SUPPORTED, UNCONSTRAINED = "contradicted", "supported", "unconstrained"


def compose(calls: DataFrame, checks: DataFrame, key: list[str]) -> DataFrame:
    """One verdict per call: contradicted over supported over unconstrained.

    checks(key, check, kind, verdict, strength, confidence, localized, reason, evidence);
    reference checks don't decide. Among contradictions the strongest, localized, most
    confident and last by name decides; the blamed place is the one most cited as subject
    or conflict, the later on ties. Without a decision the commonest reason stands.
    """
    rank = F.array_position(F.array(*map(F.lit, STRENGTHS)), F.col("strength"))
    sure = F.coalesce("confidence", F.lit(-1.0))
    deciding = checks.where("kind <> 'reference'")
    by = lambda v: F.col("verdict") == v
    decided = F.struct(rank.alias("r"), F.when(by(CONTRADICTED), F.col("localized")).otherwise(F.lit(True)).alias("l"), sure.alias("c"), "check", "reason", "strength", "confidence")
    g = deciding.groupBy(*key).agg(
        F.max(F.when(by(CONTRADICTED), decided)).alias("bad"), F.max(F.when(by(SUPPORTED), decided)).alias("good"),
        F.coalesce(F.bool_or(F.when(by(CONTRADICTED), F.col("localized"))), F.lit(True)).alias("localized"))
    reasons = deciding.groupBy(*key, "reason").agg(F.count("*").alias("n")).groupBy(*key).agg(F.min_by("reason", F.struct((-F.col("n")).alias("n"), "reason")).alias("usual"))
    cited = deciding.where(by(CONTRADICTED)).withColumn("e", F.explode("evidence"))
    core = cited.groupBy(*key).agg(F.array_sort(F.collect_set("e.seq")).alias("core"))
    blamed = cited.where("e.role in ('subject', 'conflict')").groupBy(*key, "e.seq").agg(F.count("*").alias("n")).groupBy(*key).agg(F.max_by("seq", F.struct("n", "seq")).alias("blame_seq"))
    any_check = checks.select(*key).distinct().withColumn("ran", F.lit(True))
    out = calls
    for part in (g, reasons, core, blamed, any_check):
        out = out.join(part, key, "left")
    verdict = F.when(F.col("bad").isNotNull(), CONTRADICTED).when(F.col("good").isNotNull(), SUPPORTED).otherwise(UNCONSTRAINED)
    chosen = F.coalesce("bad", "good")
    reason = F.coalesce(chosen["reason"], "usual", F.when(F.col("ran"), "abstain:reference_only").otherwise("abstain:no_enabled_checks"))
    return out.select(*calls.columns, verdict.alias("verdict"), F.coalesce(chosen["strength"], F.lit("none")).alias("strength"), chosen["confidence"].alias("confidence"), chosen["check"].alias("rule"), reason.alias("reason"), F.when(F.col("bad").isNotNull(), F.col("core")).alias("core"), "blame_seq", F.coalesce("localized", F.lit(True)).alias("localized"), (F.col("bad").isNotNull() & F.col("good").isNotNull()).alias("disagreement"))


def combine(checks: DataFrame, key: list[str], content: tuple[str, ...]) -> DataFrame:
    """Any contradiction; else support by a check of content; else unconstrained."""
    g = checks.groupBy(*key).agg(F.bool_or(F.col("verdict") == CONTRADICTED).alias("bad"), F.bool_or((F.col("verdict") == SUPPORTED) & F.col("check").isin(*content)).alias("good"))
    return g.select(*key, F.when(F.col("bad"), CONTRADICTED).when(F.col("good"), SUPPORTED).otherwise(UNCONSTRAINED).alias("verdict"))


def gap_filled(calls: DataFrame, checks: DataFrame, names: list[str], key: list[str]) -> DataFrame:
    """A row for every call and check: what the check said, else `abstain:not_decided`."""
    grid = calls.select(*key, F.explode(F.array(*map(F.lit, names))).alias("check"))
    return grid.join(checks, [*key, "check"], "left").withColumns({"verdict": F.coalesce("verdict", F.lit(UNCONSTRAINED)), "reason": F.coalesce("reason", F.lit("abstain:not_decided"))})


def summarize(verdicts: DataFrame) -> DataFrame:
    v = lambda name: F.col("verdict") == name
    return verdicts.agg(F.count_if(v(SUPPORTED)).alias("supported"), F.count_if(v(CONTRADICTED) & F.col("localized")).alias("contradicted_localized"), F.count_if(v(CONTRADICTED) & ~F.col("localized")).alias("contradicted_unit"), F.count_if(v(UNCONSTRAINED)).alias("unconstrained"))


def confusion(rows: DataFrame, strata: list[str], method: str = "method", label: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Counts and rates per method and stratum value; rows(method, verdict, strata..., spoofed boolean).

    Grouping sets count all strata in one pass; unconstrained rows are in the recall's denominator and not in that of the decided.
    """
    y = F.coalesce(label if label is not None else F.col("spoofed"), F.lit(False))
    spread = rows.withColumn("_y", y).withColumn("_s", F.explode(F.array(F.struct(F.lit("all").alias("stratum"), F.lit("all").alias("value")), *[F.struct(F.lit(s).alias("stratum"), F.coalesce(F.col(s).cast("string"), F.lit("None")).alias("value")) for s in strata])))
    c = lambda pos, v: F.count_if((F.col("_y") == pos) & (F.col("verdict") == v))
    g = spread.groupBy(method, *(by or []), F.col("_s.stratum").alias("stratum"), F.col("_s.value").alias("value")).agg(F.count_if("_y").alias("n_spoofed"), c(True, CONTRADICTED).alias("caught"), c(True, SUPPORTED).alias("supported_on_spoofed"), c(True, UNCONSTRAINED).alias("unconstrained_on_spoofed"), F.count_if(~F.col("_y")).alias("n_honest"), c(False, CONTRADICTED).alias("honest_fp"), c(False, SUPPORTED).alias("honest_supported"), c(False, UNCONSTRAINED).alias("honest_unconstrained"))
    share = lambda a, b: F.round(F.try_divide(a.cast("double"), b), 4)
    return g.withColumns({"recall": share(F.col("caught"), F.col("n_spoofed")), "recall_of_decided": share(F.col("caught"), F.col("caught") + F.col("supported_on_spoofed")), "precision": share(F.col("caught"), F.col("caught") + F.col("honest_fp"))})


def contributions(rows: DataFrame, key: str, methods: list[str], baseline: str) -> DataFrame:
    """(method, newly_caught, only_here) over spoofed rows: what each method catches that the baseline misses, and that no other method catches."""
    caught = rows.where("spoofed and verdict = 'contradicted'").groupBy(key).agg(F.collect_set("method").alias("by"))
    ours = F.filter("by", lambda m: m.isin(*methods))
    each = caught.withColumn("ours", ours).withColumn("method", F.explode("ours"))
    return each.groupBy("method").agg(F.count_if(~F.array_contains("by", baseline)).alias("newly_caught"), F.count_if(F.size("ours") == 1).alias("only_here"))


def join_labels(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """labels(label_id, session_id, call_id, seq, label, ir_sha) with verdicts(session_id, call_id, seq, ir_sha, verdict).

    By call id where a label has one: ok, ambiguous if several calls have it, no_match; else
    by seq if the session's hash agrees, or seq_mismatch. Labels of unknown sessions are
    orphans. Calls without a label follow as `unknown`.
    """
    sessions = verdicts.groupBy("session_id").agg(F.first("ir_sha").alias("_sha"))
    by_call = verdicts.groupBy("session_id", "call_id").agg(F.count("*").alias("_n"), F.min(F.struct("seq", "verdict")).alias("_a"))
    by_seq = verdicts.select("session_id", "seq", F.struct("seq", "verdict").alias("_b"))
    j = labels.join(sessions, "session_id", "left").join(by_call, ["session_id", "call_id"], "left").join(by_seq, ["session_id", "seq"], "left")
    own, same = F.col("call_id").isNotNull(), F.coalesce(F.col("ir_sha") == F.col("_sha"), F.lit(False))
    status = F.when(F.col("_sha").isNull() & F.col("_n").isNull() & F.col("_b").isNull(), "orphan_label").when(own & (F.col("_n") == 1), "ok").when(own & (F.col("_n") > 1), "ambiguous").when(own, "no_match").when(~same, "seq_mismatch").when(F.col("_b").isNotNull(), "ok").otherwise("no_match")
    hit = F.when(status == "ok", F.when(own, F.col("_a")).otherwise(F.col("_b")))
    joined = j.select("label_id", "session_id", "call_id", "label", status.alias("join_status"), hit["seq"].alias("v_seq"), hit["verdict"].alias("v_verdict"))
    used = joined.where("join_status = 'ok'").select("session_id", F.col("v_seq").alias("seq")).distinct()
    rest = verdicts.join(used, ["session_id", "seq"], "left_anti").select(F.lit(None).cast(dict(labels.dtypes)["label_id"]).alias("label_id"), "session_id", "call_id", F.lit("unknown").alias("label"), F.lit("unknown").alias("join_status"), F.col("seq").alias("v_seq"), F.col("verdict").alias("v_verdict"))
    return joined.unionByName(rest)


def allocate(sizes: DataFrame, total: int, floor: int = 5, key: str = "cell", n: str = "n") -> DataFrame:
    """(cell, n, alloc): proportional shares of total above a floor, the remainder by largest fraction."""
    one = Window.partitionBy(F.lit(0))
    s = sizes.where(F.col(n) > 0).withColumn("_base", F.least(F.col(n), F.lit(floor)))
    s = s.withColumns({"_left": F.greatest(F.lit(0), total - F.sum("_base").over(one)), "_room": F.col(n) - F.col("_base")})
    s = s.withColumn("_raw", F.coalesce(F.try_divide(F.col("_left") * F.col("_room"), F.sum("_room").over(one)), F.lit(0.0)))
    s = s.withColumn("_got", F.col("_base") + F.least(F.col("_room"), F.floor("_raw"))).withColumn("_rem", total - F.sum("_got").over(one))
    turn = F.row_number().over(one.orderBy(F.desc(F.col("_raw") - F.floor("_raw")), key))
    able = F.count_if(F.col("_got") < F.col(n)).over(one.orderBy(F.desc(F.col("_raw") - F.floor("_raw")), key).rowsBetween(Window.unboundedPreceding, 0))
    more = (F.col("_left") > 0) & (F.col("_got") < F.col(n)) & (able <= F.col("_rem"))
    return s.withColumn("_turn", turn).select(key, n, (F.col("_got") + more.cast("long")).cast("long").alias("alloc"))


def terciles(rows: DataFrame, value: str, tie: str, by: list[str] | None = None) -> DataFrame:
    """Adds tercile short, mid or long by row number over count, ties in the order of tie; without groups the numbers are made in two levels."""
    if by:
        w = Window.partitionBy(*by)
        numbered = rows.withColumn("_q", F.row_number().over(w.orderBy(value, tie)) / F.count("*").over(w))
    else:
        numbered = running(rows, [F.col(value), F.col(tie)], name="_no")
        n = numbered.count()
        numbered = numbered.withColumn("_q", (F.col("_no") + 1) / F.lit(max(1, n))).drop("_no")
    return numbered.withColumn("tercile", F.when(F.col("_q") <= 1 / 3, "short").when(F.col("_q") <= 2 / 3, "mid").otherwise("long")).drop("_q")


def draw(rows: DataFrame, cells: DataFrame, key: str, cell: str = "cell", seed: int = 20261003) -> DataFrame:
    """The allocated number of rows of each cell, those with the smallest seeded hashes."""
    w = Window.partitionBy(cell).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return rows.join(cells.select(cell, "alloc"), cell).withColumn("_n", F.row_number().over(w)).where("_n <= alloc").drop("_n", "alloc")


def ordered_sha(rows: DataFrame, by: str, order: str, cols: list[str]) -> DataFrame:
    """(by, sha): sha256 over a group's rows in order, fields joined by the unit separator and rows by the record separator."""
    line = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cols])
    return rows.groupBy(by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("l")))), lambda x: x["l"]), "\x1e"), 256).alias("sha"))
