"""The ordered folds, the ledger, and perturbations over adapted logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import claims, grammar, ledger, perturb, replay, scoring, structural
from .registry import Registry

R = Registry()


def file_turns(wlog: DataFrame) -> DataFrame:
    """Call and result turns of a log of writes and reads."""
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    args = F.concat(F.lit('{"file_path": '), q(F.col("path")), F.when(F.col("writes"), F.concat(F.lit(', "content": '), q(F.col("text")))).otherwise(""), F.lit("}"))
    ack = F.when(F.col("nth") == 1, F.concat(F.lit("File created successfully at: "), F.col("path"))).otherwise(F.concat(F.lit("The file "), F.col("path"), F.lit(" has been updated.")))
    output = F.when(F.col("writes"), ack).otherwise(F.concat(F.lit("     1\t"), F.col("shown")))
    tool = F.when(F.col("writes"), "Write").otherwise("Read")
    turn = lambda role, i, content, given: F.struct(F.lit(role).alias("role"), (F.col("seq") * 2 + i).alias("pos"), content.alias("content"), given.alias("tool_input_json"))
    none = F.lit(None).cast("string")
    t = wlog.withColumn("t", F.explode(F.array(turn("tool_use", 0, none, args), turn("tool_result", 1, output, none))))
    return t.select(F.col("session_id").cast("string").alias("key"), "t.pos", "t.role", F.col("event_id").cast("string").alias("tool_call_id"), tool.alias("tool_name"), "t.tool_input_json", "t.content", none.alias("command"))


@R.query("replay_reads", "select cast(session_id as string) as key, cast(event_id as string) as call_id, case when event_id % 13 = 0 then 'violation:read_content' else 'ok:read_content' end as reason from {wlog} where not writes and after_write", ("wlog",))
def replay_reads(wlog):
    fresh = wlog.where("not writes and after_write").select(F.col("session_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("call_id"))
    return replay.verdicts(file_turns(wlog)).join(fresh, ["key", "call_id"], "left_semi").select("key", "call_id", "reason")


@R.query("replay_summary", None, ("wlog",))
def replay_summary(wlog):
    return replay.verdicts(file_turns(wlog)).groupBy("reason").agg(F.count("*").alias("n"))


def _usage_turns(ulog: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return ulog.select("key", "pos", "role", "content", "input_tokens", "output_tokens", none.alias("tool_name"), none.alias("tool_input_json"), none.alias("tool_call_id"))


@R.query("ledger_windows", "with a as (select *, sum(case when role = 'assistant' then 1 else 0 end) over (partition by key order by pos) as w from {ulog}), g as (select key, w, max(case when role = 'assistant' then input_tokens end) as ti, max(case when role = 'assistant' then output_tokens end) as tout, count(case when role <> 'assistant' then 1 end) as n_user, min(case when role = 'assistant' then pos end) as pos from a where w > 0 and key in (select key from {ulog} group by 1 having count(case when role = 'assistant' and input_tokens is null then 1 end) = 0) group by 1, 2), l as (select *, lead(ti) over (partition by key order by w) - ti as growth from g) select key, pos, cast(growth as double) as growth, cast(tout as double) as out_i, n_user from l where growth is not null", ("ulog",))
def ledger_windows(ulog):
    whole = ulog.groupBy("key").agg(F.count_if((F.col("role") == "assistant") & F.col("input_tokens").isNull()).alias("n")).where("n = 0").select("key")
    return ledger.windows(_usage_turns(ulog).join(whole, "key", "left_semi")).select("key", "pos", "growth", "out_i", "n_user")


@R.query("ledger_fit", None, ("ulog",))
def ledger_fit(ulog):
    w = ledger.windows(_usage_turns(ulog))
    coef = ledger.fit(w, ("intercept", "out_i", "n_results"))
    limit = ledger.threshold(w, coef, 0.0)
    return w.select("key", "pos", F.round(ledger.predicted(coef) - F.col("growth"), 3).alias("residual"), F.lit(round(limit, 3)).alias("tolerance"))


_CLEAN = ("key", "pos", "session_id", "turn_number", "turn_id", "role", "tool_call_id", "tool_name", "timestamp", "uuid", "parent_uuid", "source", "content")


def clean_log(wlog: DataFrame) -> DataFrame:
    """A log without faults, for perturbation."""
    t = file_turns(wlog)
    from pyspark.sql.window import Window

    w = Window.partitionBy("key").orderBy("pos")
    n = F.row_number().over(w)
    t = t.withColumns({"turn_number": n.cast("long"), "session_id": F.col("key"), "source": F.lit(structural.PROFILE)})
    t = t.withColumns({"turn_id": F.concat_ws(":", "key", "turn_number"), "uuid": F.concat_ws("-", "key", "turn_number"), "timestamp": (F.lit(1_700_000_000_000) + F.col("turn_number") * 1000).cast("string"), "pos": F.col("turn_number")})
    return t.withColumn("parent_uuid", F.lag("uuid").over(Window.partitionBy("key").orderBy("pos"))).select(*_CLEAN)


_BROKEN = """
with f as (select cast(session_id as string) as key, row_number() over (partition by session_id order by seq) as call from {wlog}),
t as (select key, 2 * max(call) as n from f group by 1)"""


@R.query("faults_found", _BROKEN + """
select 'turn_number_gap' as rule, 2 * count(*) as violations from t where n >= 40 union all select 'turn_id_mismatch', count(*) from t where n >= 40
union all select 'parent_chain_break', 2 * count(*) from t where n >= 40 union all select 'timestamp_regression', count(*) from t where n >= 40""", ("wlog",))
def faults_found(wlog):
    """The clean log with one turn in the middle of each longer session renumbered, cut from its chain and stamped late."""
    log = clean_log(wlog)
    long = log.groupBy("key").agg(F.max("pos").alias("n")).where("n >= 40").select("key")
    at = (F.col("pos") == 20) & F.col("long_")
    marked = log.join(long.withColumn("long_", F.lit(True)), "key", "left").withColumn("long_", F.coalesce("long_", F.lit(False)))
    off = marked.withColumns({
        "turn_number": F.when(at, F.col("turn_number") + 5).otherwise(F.col("turn_number")),
        "uuid": F.when(at, F.concat("uuid", F.lit("x"))).otherwise(F.col("uuid")),
        "parent_uuid": F.when(at, F.lit("u-other")).otherwise(F.col("parent_uuid")),
        "timestamp": F.when(at, (F.col("timestamp").cast("bigint") + 1500).cast("string")).otherwise(F.col("timestamp")),
    }).drop("long_")
    return structural.find(off).groupBy("rule").agg(F.count("*").alias("violations"))


@R.query("perturb_plan", "select attack, least(100, (select count(distinct session_id) from {wlog})) as targets from (values ('drop_call'), ('digit_flip'), ('reparent')) as t(attack)", ("wlog",))
def perturb_plan(wlog):
    plans = perturb.plan(clean_log(wlog), ("drop_call", "digit_flip", "reparent"))
    return plans.groupBy("attack").agg(F.count("*").alias("targets"))


@R.query("perturb_detection", None, ("wlog",))
def perturb_detection(wlog):
    log = clean_log(wlog)
    plans = perturb.plan(log)
    return perturb.detection(plans, structural.find(perturb.apply(log, plans)).select("key", "calls"))


@R.query("summarize", "select count(case when after_write and event_id % 13 <> 0 then 1 end) as supported, count(case when after_write and event_id % 13 = 0 then 1 end) as contradicted_localized, cast(0 as bigint) as contradicted_unit, cast(0 as bigint) as unconstrained from {wlog} where not writes and after_write", ("wlog",))
def summarize(wlog):
    fresh = wlog.where("not writes and after_write").select(F.col("session_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("call_id"))
    return scoring.summarize(replay.verdicts(file_turns(wlog)).join(fresh, ["key", "call_id"], "left_semi"))


@R.query("claims_answers", "with c as (select event_id as claim_id, tool, cast(case when k % 10 < 9 and tool = 'read' then 0 else k % 5 end as string) as answer, event_id % 4 = 0 as grounded from {elog} where kind = 'result'), n as (select tool, answer, count(*) as n from c group by 1, 2), r as (select *, row_number() over (partition by tool order by n desc, answer) as rn, sum(n) over (partition by tool) as total from n) select claim_id, case when grounded then 'ok:answer' when total - 1 >= 10 and n - (case when c.answer = r.answer then 1 else 0 end) >= 0.8 * (total - 1) then case when c.answer = r.answer then 'ok:consensus' else 'violation:consensus' end else 'abstain:no_consensus' end as reason from c join r on c.tool = r.tool and r.rn = 1")
def claims_answers(elog):
    answer = F.when((F.col("k") % 10 < 9) & (F.col("tool") == "read"), 0).otherwise(F.col("k") % 5).cast("string")
    return claims.answers(elog.where("kind = 'result'").select(F.col("event_id").alias("claim_id"), F.col("tool").alias("task_id"), answer.alias("answer"), (F.col("event_id") % 4 == 0).alias("grounded")))


@R.query("claims_mode", "with f as (select session_id, tool, min(seq) as first from {elog} where kind = 'call' group by 1, 2), c as (select event_id as claim_id, session_id, seq, case event_id % 3 when 0 then 'shell' when 1 then 'read' else 'edit' end as tool from {elog} where kind = 'assistant') select claim_id, case when first is null or first >= seq then 'violation:mode' else 'ok:mode' end as reason from c left join f on c.session_id = f.session_id and c.tool = f.tool")
def claims_mode(elog):
    mode = F.element_at(F.array(F.lit("shell"), F.lit("read"), F.lit("edit")), (F.col("event_id") % 3 + 1).cast("int"))
    said = elog.where("kind = 'assistant'").select(F.col("event_id").alias("claim_id"), "session_id", F.col("seq").alias("pos"), mode.alias("mode"))
    return claims.mode_never_performed(said, elog.where("kind = 'call'").select("session_id", F.col("seq").alias("pos"), F.col("tool").alias("mode")))


@R.query("claims_durable_pass", """
with e as (select * from {elog}), c as (select * from e where kind = 'assistant'),
j as (select c.event_id as claim_id, (select arg_max(not is_error, seq) from e where e.session_id = c.session_id and kind = 'result' and e.seq < c.seq) as before,
             (select arg_min(not is_error, seq) from e where e.session_id = c.session_id and kind = 'result' and e.seq > c.seq) as after,
             (select min(seq) from e where e.session_id = c.session_id and kind = 'result' and e.seq > c.seq) as next_at,
             (select min(seq) from e where e.session_id = c.session_id and kind = 'user' and e.seq > c.seq) as changed from c)
select claim_id, case when before = false then 'violation:pass_before_failed' when after = false and coalesce(changed < next_at, false) = false then 'violation:pass_not_durable'
                      when before then 'ok:pass' else 'missing:no_run' end as reason from j""")
def claims_durable_pass(elog):
    said = elog.where("kind = 'assistant'").select(F.col("event_id").alias("claim_id"), "session_id", F.col("seq").alias("pos"))
    runs = elog.where("kind = 'result'").select("session_id", F.col("seq").alias("pos"), (~F.col("is_error")).alias("passed"))
    return claims.durable_pass(said, runs, elog.where("kind = 'user'").select("session_id", F.col("seq").alias("pos")))


_FILES = "with e as (select * from {elog}), c as (select event_id as claim_id, session_id, seq as pos, k % 3 as path, k % 4 as n from e where kind = 'assistant'), v as (select session_id, seq as pos, k % 3 as path, k % 4 as n from e where kind = 'result' and not is_error)"


@R.query("claims_lines", _FILES + """,
x as (select session_id, seq as pos, k % 3 as path from e where kind = 'call'),
j as (select c.*, coalesce((select max(pos) from x where x.session_id = c.session_id and x.path = c.path and x.pos < c.pos), -1) as cut from c where path is not null),
g as (select claim_id, j.n, min(v.n) as lo, max(v.n) as hi from j left join v on v.session_id = j.session_id and v.path = j.path and v.pos > cut and v.pos < j.pos group by 1, 2)
select claim_id, case when lo is null then 'missing:no_view' when lo <> hi then 'abstain:views_differ' when lo = n then 'ok:lines' else 'violation:lines' end as reason from g""")
def claims_lines(elog):
    path, lines = (F.col("k") % 3).alias("path"), (F.col("k") % 4).alias("lines")
    rows = lambda cond, *cols: elog.where(cond).where("k is not null").select("session_id", F.col("seq").alias("pos"), path, *cols)
    said = rows("kind = 'assistant'", F.col("event_id").alias("claim_id"), lines)
    return claims.line_counts(said, rows("kind = 'result' and not is_error", lines), rows("kind = 'call'"))


@R.query("claims_scope", _FILES + """,
r as (select session_id, seq as pos, k % 3 as path, not is_error as passed from e where kind = 'result'),
g as (select c.claim_id, arg_max(r.passed, r.pos) filter (where r.path = c.path) as last, count(case when r.path <> c.path then 1 end) as other
      from c left join r on r.session_id = c.session_id and r.pos < c.pos where c.path is not null group by 1)
select claim_id, case when last then 'ok:check' when last = false then 'violation:check_failed' when other > 0 then 'violation:check_substituted' else 'missing:no_check' end as reason from g""")
def claims_scope(elog):
    rows = lambda cond, *cols: elog.where(cond).where("k is not null").select("session_id", F.col("seq").alias("pos"), (F.col("k") % 3).alias("scope"), *cols)
    return claims.check_scope(rows("kind = 'assistant'", F.col("event_id").alias("claim_id")), rows("kind = 'result'", (~F.col("is_error")).alias("passed")))


@R.query("claims_digests", """
with e as (select *, md5(cast(k % 40 as string)) as h from {elog} where k is not null), s as (select session_id, seq as pos, substr(h, 1, 20) as d from e where kind = 'result'),
c as (select event_id as claim_id, session_id, seq as pos, substr(h, 1, cast(case event_id % 3 when 0 then 32 when 1 then 12 else 25 end as int)) as d from e where kind = 'assistant'),
g as (select claim_id, c.d, coalesce(bool_or(starts_with(s.d, c.d) or starts_with(c.d, s.d)), false) as own, count(s.d) as n from c left join s on s.session_id = c.session_id and s.pos < c.pos group by 1, 2)
select claim_id, case when length(d) = 25 then 'violation:hex_length_25' when own then 'ok:digest' when n > 0 then 'violation:digest_not_own' else 'missing:no_digest_shown' end as reason from g""")
def claims_digests(elog):
    h, e = F.md5((F.col("k") % 40).cast("string")), F.col("event_id")
    rows = lambda cond, *cols: elog.where(cond).where("k is not null").select("session_id", F.col("seq").alias("pos"), *cols)
    cut = F.substr(h, F.lit(1), F.when(e % 3 == 0, 32).when(e % 3 == 1, 12).otherwise(25))
    return claims.digest_claims(rows("kind = 'assistant'", e.alias("claim_id"), cut.alias("digest")), rows("kind = 'result'", F.substring(h, 1, 20).alias("digest")))


def _three(op: str) -> str:
    return f"(?m)^(?:Exit code \\b|\\w+: cannot access|\\w+: No such file|ls: |git: |usage: |Traceback|\\s*File \"|warning:|fatal:){op}"


@R.query("grammar_head", "select doc_id, len(string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10))) > 3 as broken from {documents} where text is not null and trim(text) <> '' and not regexp_matches(text, '" + _three("") + "')", ("documents",))
def grammar_head(documents):
    own = documents.where("text is not null and trim(text) <> ''").where(~F.col("text").rlike(grammar.DIAGNOSTIC))
    broken, _ = grammar.violations(F.lit("head -3 notes.txt"), F.col("text"))
    return own.select("doc_id", F.array_contains(broken, "line_cap").alias("broken"))


#: Commands with outputs, their broken rules and how many applied.
_OUTPUTS = [
    ("ls -la", "total 4\ndrwxr-xr-x 1 a b 4096 Oct  4 02:44 x\n-rw-r--r-- 1 a b 1 Oct  4 02:44 y\n-rw-r--r-- 1 a b 1 Oct  4 02:44 z", "ls_all_missing_dotdirs", 1),
    ("ls -l", "total 4\n-rw-r--r-- 1 a b 1 Oct  4 02:44 y\n+ forged", "ls_long_format", 1),
    ("ls -lt", "-rw-r--r-- 1 a b 1 Oct  4 02:44 y\n-rw-r--r-- 1 a b 1 Oct  4 03:44 z\n-rw-r--r-- 1 a b 1 Oct  4 01:44 w", "ls_time_order", 2),
    ("head -2 f", "a\nb\nc", "line_cap", 1), ("head -2 f g", "==> f <==\na\nb\n==> g <==\nc", "", 0), ("head -n 2 f", "a\nb\nc", "", 0),
    ("cat -n f", "     1\ta\n     3\tb\n     4\tc", "line_numbering", 1), ("Read f", "     1\ta\nb\n     3\tc", "line_numbering_partial", 1), ("nl f", "1\ta\n2\n3\tc", "", 1),
    ("grep foo f", "a foo\nbar", "grep_match", 1), ("grep -i FOO f", "a foo", "", 1), ("grep -c foo f", "3", "", 0), ("grep fo.o f", "x", "", 0),
    ("find . -name '*.py'", "./a.py\n./b.txt", "find_name", 1), ("find . -name '[!a]*'", "./b\n./c", "", 1), ("find . -name '[!a]*'", "./a", "find_name", 1),
    ("git log --oneline", "abc1234 x\nnot a row", "git_oneline_format", 1), ("git log --oneline", "* abc1234 x\n| abc1235 y", "", 1),
    ("pytest -q", "....... [100%]\n2 passed in 1.0s", "pytest_count", 1), ("pytest -q", "....... [100%]\n2 passed somewhere", "", 0),
    ("python x.py", "Exit code 0\nTraceback (most recent call last):\nValueError: x", "exit_status", 1), ("ls | head -1", "a\nb", "", 0),
    ("cd w && head -1 f", "a\nb", "line_cap", 1), ("cat -n f", "usage: cat", "", 0), ("head -1 f", "a\n...[clipped 9 chars]", "", 0),
]


@R.query("grammar_rules", "select * from (values " + ", ".join(f"({k}, '{want}', {n})" for k, (_, _, want, n) in enumerate(_OUTPUTS)) + ") as t(id, broken, applied) where (select count(*) from {documents}) >= 0", ("documents",))
def grammar_rules(documents):
    df = documents.sparkSession.createDataFrame([(k, c, o) for k, (c, o, _, _) in enumerate(_OUTPUTS)], "id int, command string, output string")
    broken, applied = grammar.violations(F.col("command"), F.col("output"))
    return df.select("id", F.array_join(broken, ",").alias("broken"), applied.alias("applied"))
