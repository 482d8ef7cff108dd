"""Ordered functions, shares, clocks, retries, knowledge, views and bootstrap intervals over the adapter views.

Each query calls an operator; its SQL says the same in DuckDB's own words.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import errors
from ..operators import bootstrap, clocks, joins, knowledge, ordered, pairing, qualify, shares, views
from .registry import Registry

R = Registry()

SEQ, SESSION, THREAD = ["seq"], ["session_id"], ["session_id", "stream"]


# --- ordered functions -----------------------------------------------------------------------


@R.query("lag_gap", "select session_id, seq, ts_us - lag(ts_us) over (partition by session_id order by seq) as gap_us from {elog}")
def lag_gap(elog):
    return ordered.lagged(elog, SESSION, SEQ, "ts_us", "gap_us").select("session_id", "seq", "gap_us")


@R.query("carry_forward", """
select session_id, seq, max(call_id) over (partition by session_id, grp) as last_call
from (select session_id, seq, case when kind = 'call' then call_id end as call_id,
             count(case when kind = 'call' then call_id end) over (partition by session_id order by seq) as grp from {elog}) t""")
def carry_forward(elog):
    call = F.when(F.col("kind") == "call", F.col("call_id"))
    return ordered.carried(elog, SESSION, SEQ, call, "last_call").select("session_id", "seq", "last_call")


@R.query("running_max", """
select session_id, seq, cast(row_number() over (partition by session_id, kind order by seq) - 1 as bigint) as nth_of_kind,
       max(emb_us) over (partition by session_id order by seq) as max_so_far, count(*) over (partition by session_id, kind) as of_kind
from {elog}""")
def running_max(elog):
    n = ordered.numbered(elog, ["session_id", "kind"], SEQ, "nth_of_kind", "of_kind")
    return ordered.running_max(n, SESSION, SEQ, "emb_us", "max_so_far").select("session_id", "seq", "nth_of_kind", "max_so_far", "of_kind")


@R.query("adjacent_triples", """
select a || '>' || b || '>' || c as triple, count(*) as n
from (select kind as a, lead(kind) over w as b, lead(kind, 2) over w as c from {elog} window w as (partition by session_id, stream order by seq)) t
where c is not null group by 1""")
def adjacent_triples(elog):
    t = ordered.tuples(elog, THREAD, SEQ, "kind", 3)
    return t.groupBy(F.array_join("items", ">").alias("triple")).agg(F.count("*").alias("n"))


_BIGRAMS = "select prev, {1}, count(*) as n from (select {1}, lag({1}) over (partition by session_id order by {2}) as prev from {{{0}}}) t group by 1, 2"


@R.query("kind_bigrams", _BIGRAMS.format("elog", "kind", "seq"))
def kind_bigrams(elog):
    return ordered.transitions(elog, SESSION, SEQ, "kind")


@R.query("role_bigrams", _BIGRAMS.format("clog", "role", "pos"), ("clog",))
def role_bigrams(clog):
    return ordered.transitions(clog, SESSION, ["pos"], "role")


@R.query("longest_run", """
select kind, max(n) as longest
from (select session_id, kind, grp, count(*) as n
      from (select session_id, kind, row_number() over (partition by session_id order by seq) - row_number() over (partition by session_id, kind order by seq) as grp from {elog}) t
      group by 1, 2, 3) u
group by 1""")
def longest_run(elog):
    return ordered.longest_runs(elog, SESSION, SEQ, "kind")


@R.query("precedence_rules", """
with f as (select session_id, tool, min(seq) as a, max(seq) as b from {elog} where tool is not null group by 1, 2)
select x.tool as first_item, y.tool as then_item, count(*) as groups, count(case when x.a < y.a then 1 end) as first_before, count(case when x.b < y.a then 1 end) as always_before
from f x join f y on x.session_id = y.session_id and x.tool <> y.tool group by 1, 2""")
def precedence_rules(elog):
    return ordered.precedence(elog, SESSION, "seq", "tool")


@R.query("position_deciles", """
select decile, count(*) as n, count(case when is_error then 1 end) as errors
from (select is_error, cast(floor((row_number() over (partition by session_id order by seq) - 1) * 10 / count(*) over (partition by session_id)) as bigint) as decile
      from {elog} where kind = 'result') t
group by 1""")
def position_deciles(elog):
    placed = ordered.part_of_group(elog.where("kind = 'result'"), SESSION, SEQ, 10, "decile")
    return placed.groupBy("decile").agg(F.count("*").alias("n"), F.count_if("is_error").alias("errors"))


@R.query("early_late", """
select tool, count(case when 2 * i <= n then 1 end) as early, count(case when 2 * i > n then 1 end) as late,
       count(case when 2 * i <= n and is_error then 1 end) as early_errors, count(case when 2 * i > n and is_error then 1 end) as late_errors
from (select tool, is_error, row_number() over (partition by session_id order by seq) as i, count(*) over (partition by session_id) as n from {elog} where kind = 'result') t
group by 1""")
def early_late(elog):
    h = ordered.halves(elog.where("kind = 'result'"), SESSION, SEQ)
    e = F.col("early")
    return h.groupBy("tool").agg(
        F.count_if(e).alias("early"), F.count_if(~e).alias("late"),
        F.count_if(e & F.col("is_error")).alias("early_errors"), F.count_if(~e & F.col("is_error")).alias("late_errors"),
    )


@R.query("seq_contiguous", """
select count(case when a <> 0 or b + 1 <> n or d <> n then 1 end) as broken, count(*) as sessions
from (select session_id, min(seq) as a, max(seq) as b, count(*) as n, count(distinct seq) as d from {elog} group by session_id) t""")
def seq_contiguous(elog):
    return ordered.contiguity(elog, SESSION, "seq", first=0).agg(F.count_if("broken").alias("broken"), F.count("*").alias("sessions"))


@R.query("turn_contiguity", """
select session_id, count(*) as rows, count(case when turn - prev > 1 then 1 end) as gaps, count(case when turn = prev then 1 end) as repeats, min(turn) as first
from (select session_id, turn, lag(turn) over (partition by session_id order by turn) as prev from {clog}) t group by 1""", ("clog",))
def turn_contiguity(clog):
    return ordered.contiguity(clog, SESSION, "turn").drop("broken")


@R.query("context_windows", """
with a as (select session_id, pos, role, length(text) as chars, sum(case when role = 'assistant' then 1 else 0 end) over (partition by session_id order by pos) as w from {clog})
select session_id, cast(w as bigint) as w, cast(sum(case when role <> 'assistant' then chars else 0 end) as bigint) as fed_chars,
       cast(max(case when role = 'assistant' then chars end) as bigint) as said_chars, count(*) as turns
from a group by 1, 2""", ("clog",))
def context_windows(clog):
    said, n = F.col("role") == "assistant", F.length("text").cast("long")
    w = ordered.between_marks(clog, SESSION, ["pos"], said)
    fed = F.sum(F.when(~said, n).otherwise(0))
    return w.groupBy("session_id", "w").agg(fed.alias("fed_chars"), F.max(F.when(said, n)).alias("said_chars"), F.count("*").alias("turns"))


@R.query("deletion_neighbours", """
with c as (select *, event_id % 17 <> 0 as kept from {elog} where kind = 'call')
select session_id, seq, (select max(p.seq) from c p where p.session_id = c.session_id and p.stream = c.stream and p.kept and p.seq < c.seq) as before,
       (select min(p.seq) from c p where p.session_id = c.session_id and p.stream = c.stream and p.kept and p.seq > c.seq) as after
from c where not kept""")
def deletion_neighbours(elog):
    kept = F.col("event_id") % 17 != 0
    near = ordered.neighbours(elog.where("kind = 'call'"), THREAD, SEQ, "seq", kept)
    return near.where(~kept).select("session_id", "seq", "before", "after")


@R.query("multiset_difference", """
select kind, tool, count(*) as n
from (select kind, tool from {elog} where event_id % 2 = 0 except all select kind, tool from {elog} where event_id % 2 = 1) t group by 1, 2""")
def multiset_difference(elog):
    part = lambda k: elog.where(F.col("event_id") % 2 == k).select("kind", "tool")
    return ordered.multiset_difference(part(0), part(1))


@R.query("set_operations", """
with a as (select distinct k, tool from {elog} where event_id % 2 = 0), b as (select distinct k, tool from {elog} where event_id % 2 = 1)
select (select count(*) from (select * from a intersect select * from b)) as both, (select count(*) from (select * from a except select * from b)) as left_only,
       (select count(*) from (select * from b except select * from a)) as right_only""")
def set_operations(elog):
    part = lambda k: elog.where(F.col("event_id") % 2 == k).select("k", "tool")
    return ordered.overlap(part(0), part(1))


# --- shares ----------------------------------------------------------------------------------


@R.query("session_shape", "select kind, count(*) as n, count(distinct session_id) as sessions, min(seq) as first_seq, max(seq) as last_seq from {elog} group by kind")
def session_shape(elog):
    return shares.shape(elog, ["kind"], "session_id", "seq")


@R.query("zero_error_tail", """
with s as (select session_id, count(*) as n, count(case when is_error then 1 end) as e from {elog} where kind = 'result' group by 1),
p as (select cast(sum(e) as double) / sum(n) as p from s)
select count(*) as sessions, count(case when e = 0 then 1 end) as zero, round(avg(power(1 - p, n)), 9) as expected from s, p""")
def zero_error_tail(elog):
    return shares.zero_tail(elog.where("kind = 'result'"), "session_id", F.col("is_error")).withColumn("expected", F.round("expected", 9))


@R.query("dominance", """
select tool, round(max(n) / cast(sum(n) as double), 9) as top_share, count(*) as clusters
from (select tool, session_id, count(*) as n from {elog} where tool is not null group by 1, 2) t group by 1""")
def dominance(elog):
    return shares.dominance(elog.where("tool is not null"), ["tool"], "session_id").withColumn("top_share", F.round("top_share", 9))


@R.query("post_stratification", """
with a as (select tool, count(*) as n from {elog} where tool is not null group by 1),
b as (select tool, count(*) as m from {elog} where tool is not null and event_id % 3 = 0 group by 1)
select a.tool, round((n / cast((select sum(n) from a) as double)) / (m / cast((select sum(m) from b) as double)), 9) as weight from a join b on a.tool = b.tool""")
def post_stratification(elog):
    known = elog.where("tool is not null")
    return shares.post_weights(known, known.where("event_id % 3 = 0"), ["tool"]).withColumn("weight", F.round("weight", 9))


@R.query("grouping_sets", """
select coalesce(tool, 'all') as tool, coalesce(stream, 'all') as stream, count(*) as n, count(case when is_error then 1 end) as events
from {elog} where tool is not null group by grouping sets ((tool, stream), (tool), (stream), ())""")
def grouping_sets(elog):
    return shares.margins(elog, "tool", "stream", F.col("is_error"))


@R.query("value_counts", "select k, count(*) as n from {elog} group by k order by n desc, k nulls last limit 20")
def value_counts(elog):
    return shares.commonest(elog, "k", 20)


_SAID = "with r as (select call_key, check_name, verdict, seq_ % 5 = 0 as honest from (select *, cited_seq as seq_ from {checks}) t)"


@R.query("honest_soundness", _SAID + """
select check_name, count(*) as calls, count(case when verdict = 'contradicted' then 1 end) as false, count(case when verdict = 'supported' then 1 end) as supported,
       count(case when verdict = 'unconstrained' then 1 end) as unconstrained, round(count(case when verdict = 'contradicted' then 1 end) / cast(count(*) as double), 9) as false_rate
from r where honest group by 1""", ("checks",))
def honest_soundness(checks):
    return shares.honest_soundness(checks.where("cited_seq % 5 = 0"), "check_name").withColumn("false_rate", F.round("false_rate", 9))


@R.query("union_with_baseline", """
with p as (select call_key, max(case when check_name = 'alpha' then verdict end) as ours, max(case when check_name = 'beta' then verdict end) as base from {checks} group by 1)
select call_key, case when 'contradicted' in (ours, base) then 'contradicted' when 'supported' in (ours, base) then 'supported' else 'unconstrained' end as verdict from p""", ("checks",))
def union_with_baseline(checks):
    of = lambda name: F.max(F.when(F.col("check_name") == name, F.col("verdict")))
    both = checks.groupBy("call_key").agg(of("alpha").alias("ours"), of("beta").alias("base"))
    return both.select("call_key", shares.union_with(F.col("ours"), F.col("base")).alias("verdict"))


_TABLE = [("main", None, "tau", 4.0, False), ("main", "read", "tau", 3.0, False), ("agent-0", None, "rel", 0.1, False), ("main", None, "rel", 0.2, True), ("main", None, "abs", 9.0, False)]


@R.query("calibration", """
with t(u, s, q, v, ok) as (values ('main', null, 'tau', 4.0::double, false), ('main', 'read', 'tau', 3.0, false), ('agent-0', null, 'rel', 0.1, false), ('main', null, 'rel', 0.2, true), ('main', null, 'abs', 9.0, false)),
r as (select session_id, seq, stream, tool, q.q as quantity from {elog} cross join (values ('tau'), ('rel'), ('abs')) as q(q) where kind = 'call'),
o as (select r.*, (select any_value(s) from t where t.u = r.stream and t.s = r.tool) as key from r),
j as (select o.*, t.v as own from o left join t on t.u = o.stream and t.s is not distinct from o.key and t.q = o.quantity)
select session_id, seq, quantity, coalesce(own, p.v) as value, own is null and p.v is not null as borrowed
from j left join t p on j.stream like 'agent%' and p.u = 'main' and p.s is null and p.ok and p.q = j.quantity""")
def calibration(elog):
    table = elog.sparkSession.createDataFrame(_TABLE, "stream string, tool string, quantity string, value double, proxy_ok boolean")
    asked = elog.where("kind = 'call'").select("session_id", "seq", "stream", "tool", F.explode(F.array(*map(F.lit, ("tau", "rel", "abs")))).alias("quantity"))
    proxies = {f"agent-{k}": "main" for k in range(3)}
    return shares.calibrated(asked, table, "stream", "tool", proxies).select("session_id", "seq", "quantity", "value", "borrowed")


# --- clocks ----------------------------------------------------------------------------------

_BOUNDS = """
with r as (select *, max(case when kind in ('result', 'user') then seq end) over (partition by session_id, stream order by seq rows between unbounded preceding and 1 preceding) as p from {elog}),
b as (select r.session_id, r.stream, r.seq, i.ts_us - r.emb_us as lo, r.ts_us - r.emb_us as hi
      from r left join {elog} i on i.session_id = r.session_id and i.seq = r.p where r.kind in ('assistant', 'call') and abs(r.ts_us - r.emb_us) <= 86400000000)"""


def _bounds(elog):
    responds, feeds = F.col("kind").isin("assistant", "call"), F.col("kind").isin("result", "user")
    return clocks.bracket_bounds(elog, THREAD, "seq", "ts_us", "emb_us", responds, feeds)


@R.query("id_bracket", _BOUNDS + """,
g as (select session_id, stream, count(*) as n, max(lo) as lo, min(hi) as hi from b group by 1, 2 having count(*) >= 2)
select session_id, stream, n, lo, hi, lo - hi as gap, coalesce(lo - hi > 2000000, false) as inconsistent,
       (select min(seq) from b where b.session_id = g.session_id and b.stream = g.stream and b.lo = g.lo) as at_lo,
       (select min(seq) from b where b.session_id = g.session_id and b.stream = g.stream and b.hi = g.hi) as at_hi
from g""")
def id_bracket(elog):
    return clocks.brackets(_bounds(elog), THREAD, "seq")


@R.query("piecewise_bracket", _BOUNDS + """,
s as (select x.session_id, x.stream, x.seq, max(case when y.seq <= x.seq then y.lo end) - min(case when y.seq <= x.seq then y.hi end) as left_gap,
             max(case when y.seq > x.seq then y.lo end) - min(case when y.seq > x.seq then y.hi end) as right_gap, count(case when y.seq > x.seq then 1 end) as behind
      from b x join b y on x.session_id = y.session_id and x.stream = y.stream group by 1, 2, 3)
select session_id, stream, bool_or(coalesce(left_gap <= 2000000, true) and coalesce(right_gap <= 2000000, true)) as consistent from s where behind > 0 group by 1, 2""")
def piecewise_bracket(elog):
    return clocks.one_step(_bounds(elog), THREAD, "seq")


@R.query("reaction_gaps", """
with e as (select * from {elog}),
a as (select session_id, stream, seq, ts_us, coalesce(lag(seq) over (partition by session_id, stream order by seq), -1) as prev from e where kind in ('assistant', 'call')),
m as (select a.session_id, a.stream, a.seq, a.ts_us, arg_max(e.ts_us, e.seq) filter (where e.kind = 'result') as shown, bool_or(e.kind in ('user', 'system')) as blocked
      from a join e on e.session_id = a.session_id and e.stream = a.stream and e.seq > a.prev and e.seq < a.seq group by 1, 2, 3, 4)
select session_id, stream, seq, ts_us - shown as gap from m where not blocked and ts_us - shown > 0 and ts_us - shown <= 864000000000""")
def reaction_gaps(elog):
    return clocks.reaction_gaps(elog, THREAD, "seq", "ts_us", most=10 * clocks.DAY_US)


@R.query("loo_residual", """
with i as (select event_id, session_id, k % 20 as key, is_error, log10(value + 1) as d from {elog} where kind = 'result')
select x.event_id, round(x.d - median(y.d), 6) as residual
from i x join i y on x.key = y.key and x.is_error = y.is_error and x.event_id <> y.event_id group by x.event_id, x.d""")
def loo_residual(elog):
    i = elog.where("kind = 'result'").select("event_id", (F.col("k") % 20).alias("key"), "is_error", F.log10(F.col("value") + 1).alias("d"))
    i = i.where("key is not null and is_error is not null")
    return clocks.residuals(i, ["key", "is_error"], "event_id", "d").select("event_id", F.round("residual", 6).alias("residual"))


_ONCE = """
with i as (select session_id, event_id, tool, ts_us as a, ts_us + cast(floor(value * 600000000) as bigint) as b, log10(value + 1) as d from {elog} where kind = 'call'),
n as (select x.event_id, x.tool, x.d, count(*) as n from i x join i y on x.session_id = y.session_id and y.a <= (x.a + x.b) / 2 and y.b >= (x.a + x.b) / 2 group by 1, 2, 3),
p as (select tool, count(case when n >= 2 then 1 end) as n_together, count(case when n < 2 then 1 end) as n_alone, median(case when n >= 2 then d end) - median(case when n < 2 then d end) as delta from n group by 1)"""


@R.query("concurrency_delta", _ONCE + """
select tool, n_together, n_alone, round(delta, 6) as delta from p where n_together >= 20 and n_alone >= 20
union all select 'all', sum(n_together), sum(n_alone), round(sum((n_together + n_alone) * delta) / sum(n_together + n_alone), 6) from p where n_together >= 20 and n_alone >= 20""")
def concurrency_delta(elog):
    calls = elog.where("kind = 'call'").select("session_id", "event_id", "tool", F.col("ts_us").alias("a"), (F.col("ts_us") + F.floor(F.col("value") * 600000000)).alias("b"), F.log10(F.col("value") + 1).alias("d"))
    n = joins.in_flight(calls, "session_id", "a", "b", ["event_id"]).select("event_id", "n")
    per, whole = clocks.concurrency(calls.join(n, "event_id"), "tool", "n", "d")
    both = per.unionByName(per.agg(F.lit("all").alias("tool"), F.sum("n_together").alias("n_together"), F.sum("n_alone").alias("n_alone")).withColumn("one", F.lit(1)).join(whole.withColumn("one", F.lit(1)), "one").select("tool", "n_together", "n_alone", "delta"))
    return both.withColumn("delta", F.round("delta", 6))


@R.query("cold_start", """
with r as (select session_id, seq, tool, log10(value + 1) as d from {elog} where kind = 'result'),
c as (select session_id, tool, count(*) as n, min(seq) as met from r group by 1, 2),
u as (select *, row_number() over (partition by session_id order by n desc, met) as rn from c)
select r.session_id, r.tool, n, round(max(case when seq = met then d end) - median(case when seq <> met then d end), 6) as cold
from r join u on r.session_id = u.session_id and r.tool = u.tool and rn = 1 where n >= 6 group by 1, 2, 3""")
def cold_start(elog):
    r = elog.where("kind = 'result'").select("session_id", "seq", "tool", F.log10(F.col("value") + 1).alias("d"))
    return clocks.cold_starts(r, "session_id", "seq", "tool", "d").withColumn("cold", F.round("cold", 6))


@R.query("two_clocks", """
with s as (select stream, session_id, cast(ts_us - emb_us as double) as s from {elog})
select stream, count(*) as n, count(distinct session_id) as sessions, count(case when s < -1000000 then 1 end) as violations, count(case when s < 0 then 1 end) as below_zero,
       count(case when s < -2000000 then 1 end) as gross, count(distinct case when s < -1000000 then session_id end) as violators, min(s) as least,
       quantile_cont(s, 0.25) as p25, quantile_cont(s, 0.5) as p50, quantile_cont(s, 0.75) as p75
from s group by 1""")
def two_clocks(elog):
    slack = (F.col("ts_us") - F.col("emb_us")).cast("double")
    return clocks.inequality(elog, ["stream"], "session_id", slack, 1_000_000, 2_000_000)


_CALLS = """
with c as (select session_id, stream, seq, tool, is_error, cast(k % 4 as string) as args, [cast(k % 4 as string), cast(k % 7 as string), tool] as toks,
                  lead(tool) over w as t2, lead(cast(k % 4 as string)) over w as a2, lead([cast(k % 4 as string), cast(k % 7 as string), tool]) over w as k2, lead(seq) over w as s2
           from {elog} where kind in ('call', 'result') and tool is not null window w as (partition by session_id, stream order by seq)),
r as (select *, t2 = tool and a2 = args as exact, len(list_intersect(toks, k2)) / cast(len(list_distinct(list_concat(toks, k2))) as double) as jac from c where s2 is not null),
q as (select *, coalesce(exact, false) or (t2 = tool and jac >= 0.5) as retry from r)"""


def _retries(elog):
    word = lambda m: (F.col("k") % m).cast("string")
    calls = elog.where("kind in ('call', 'result') and tool is not null").withColumns({"args": word(4), "toks": F.array(word(4), word(7), F.col("tool"))})
    return clocks.retries(calls, THREAD, "seq", "tool", "args", "toks")


@R.query("retries", _CALLS + " select tool, is_error, count(*) as n, count(case when retry then 1 end) as retried, count(case when exact then 1 end) as exact from q group by 1, 2")
def retries(elog):
    return _retries(elog).groupBy("tool", "is_error").agg(F.count("*").alias("n"), F.count_if("retry").alias("retried"), F.count_if("exact").alias("exact"))


@R.query("retry_effect", _CALLS + """,
g as (select tool, count(case when is_error then 1 end) as f, count(case when is_error and retry then 1 end) as fr, count(case when not is_error then 1 end) as o, count(case when not is_error and retry then 1 end) as ork from q group by 1)
select sum(f) as failures, round(sum(fr) / cast(sum(f) as double), 6) as after_failure, round(sum(ork) / cast(sum(o) as double), 6) as after_success,
       round(sum(case when f > 0 and o > 0 then f * (fr / cast(f as double) - ork / cast(o as double)) end) / sum(case when f > 0 and o > 0 then f end), 6) as effect
from g""")
def retry_effect(elog):
    e = clocks.retry_effect(_retries(elog), "tool", "is_error")
    return e.select("failures", *[F.round(c, 6).alias(c) for c in ("after_failure", "after_success", "effect")])


@R.query("inline_accounting", """
with r as (select session_id, api_msg_id, max(usage_out) as usage_out, max(call_id) as call_id, 40 * count(*) as chars_out from {rlog} group by 1, 2),
s as (select session_id, call_id, max(coalesce(usage_in, 0)) as chars from {rlog} where kind = 'result' group by 1, 2)
select r.session_id, api_msg_id, chars as result_chars, usage_out - 0.3 * chars_out >= 0.5 * 0.3 * chars as flagged
from r join s on r.session_id = s.session_id and r.call_id = s.call_id where usage_out is not null and chars >= 300""", ("rlog",))
def inline_accounting(rlog):
    per = rlog.groupBy("session_id", "api_msg_id").agg(F.max("usage_out").alias("usage_out"), F.max("call_id").alias("call_id"), (40 * F.count("*")).alias("chars_out"))
    results = rlog.where("kind = 'result'").groupBy("session_id", "call_id").agg(F.max(F.coalesce("usage_in", F.lit(0))).alias("chars"))
    return clocks.inline_flags(per, results, ["session_id", "call_id"], 0.3, least=300).select("session_id", "api_msg_id", "result_chars", "flagged")


@R.query("image_windows", """
with c as (select session_id, seq, usage_in, kind = 'result' as screen from {rlog}),
b as (select *, lag(seq) over (partition by session_id order by seq) as prev, usage_in - lag(usage_in) over (partition by session_id order by seq) as d from c where usage_in is not null),
n as (select b.session_id, b.seq, b.d, count(c.seq) as screens from b left join c on c.session_id = b.session_id and c.screen and c.seq >= b.prev and c.seq < b.seq where b.prev is not null group by 1, 2, 3)
select session_id, seq, d as d_image, screens as n_screens, (screens >= 1 and d <= 0) or (screens = 0 and d <> 0) or (d > 0 and abs(d / 5.0 - round(d / 5.0)) > 1e-9) as violation from n""", ("rlog",))
def image_windows(rlog):
    return clocks.image_windows(rlog, "session_id", "seq", "usage_in", F.col("kind") == "result", 5.0)


@R.query("latency_window", """
select session_id, count(*) as pairs, count(case when result_us between call_us - 2000000 and call_us + 2592000000000 + 2000000 then 1 end) as inside
from {ollog} group by session_id""", ("ollog",))
def latency_window(ollog):
    low = F.col("call_us")
    w = clocks.within(ollog, F.col("result_us"), low, low + 2592000000000, 2_000_000)
    return w.groupBy("session_id").agg(F.count("*").alias("pairs"), F.count_if("inside").alias("inside"))


@R.query("ledger_tally", """
with m as (select session_id, api_msg_id, max(usage_out) as v from {rlog} group by 1, 2), t as (select session_id, cast(sum(v) as bigint) as recounted, count(*) as messages from m group by 1),
p as (select session_id, cast(sum(usage_out) as bigint) as recorded from {rlog} group by 1)
select t.session_id, recounted, messages, recorded, recounted = recorded as agrees from t left join p on t.session_id = p.session_id""", ("rlog",))
def ledger_tally(rlog):
    recorded = rlog.groupBy("session_id").agg(F.sum("usage_out").alias("recorded"))
    return clocks.recount(rlog, SESSION, "api_msg_id", "usage_out", recorded)


# --- joins, capabilities, views --------------------------------------------------------------


@R.query("result_tool_of_call", """
select session_id, seq, kind, max(case when kind = 'call' then seq end) over (partition by session_id, call_id order by seq rows between unbounded preceding and 1 preceding) as call_seq
from {elog} where kind in ('call', 'result')""")
def result_tool_of_call(elog):
    own = elog.where("kind in ('call', 'result')")
    last = joins.asof_backward(own, ["session_id", "call_id"], SEQ, F.when(F.col("kind") == "call", F.col("seq")))
    return own.select("session_id", "seq", "kind", last.alias("call_seq"))


@R.query("subagent_links", """
with e as (select * from {elog}), s as (select session_id, stream, call_id as parent from (select *, row_number() over (partition by session_id, stream order by seq) as rn from e where stream <> 'main') t where rn = 1),
c as (select session_id, call_id, seq, stream, row_number() over (partition by session_id, call_id order by seq) as rn from e where kind = 'call' and call_id is not null),
l as (select s.session_id, s.stream, s.parent, c.seq as call_seq, c.stream as call_stream from s left join c on c.session_id = s.session_id and c.call_id = s.parent and c.rn = 1)
select l.*, case when u.call_seq is not null then 2 when l.call_seq is not null then 1 else 0 end as depth from l left join l u on u.session_id = l.session_id and u.stream = l.call_stream""")
def subagent_links(elog):
    return views.parent_links(elog, "session_id", "seq", "stream", "call_id", "call_id", F.col("kind") == "call")


_CAPS = (
    ("error.native", "bool_or(kind = 'result' and event_id % 4 <> 0)"), ("join.call_id", "bool_or(kind = 'result' and called)"),
    ("request_id", "bool_or(kind in ('assistant', 'call') and event_id % 2 = 0)"), ("result.text", "bool_or(kind = 'result')"),
    ("shell.command", "bool_or(tool = 'shell')"), ("subagent", "bool_or(stream <> 'main')"), ("ts.any", "true"), ("ts.event", "bool_or(kind in ('call', 'result'))"),
    ("usage.io", "bool_or(event_id % 7 = 0)"), ("usage.out", "bool_or(event_id % 7 = 0)"),
    ("join.unique", "count(case when kind = 'call' then 1 end) > 0 and count(case when kind = 'call' then 1 end) = count(distinct case when kind = 'call' then call_id end)"),
)
_CASES = ", ".join(f"case when {c} then '{n}' end" for n, c in _CAPS)


@R.query("capability_gate", f"""
with e as (select *, coalesce(bool_or(kind = 'call') over (partition by session_id, call_id), false) and call_id is not null as called from {{elog}})
select session_id, list_aggregate(list_sort(list_filter([{_CASES}], lambda x: x is not null)), 'string_agg', ',') as capabilities from e group by 1""")
def capability_gate(elog):
    none = lambda kind: F.lit(None).cast(kind)
    e, kind = F.col("event_id"), F.col("kind")
    events = elog.select("session_id", "seq", "kind", "call_id", F.lit("1970-01-01T00:00:00Z").alias("ts"), F.lit("event").alias("ts_kind"),
        none("string").alias("api_msg_id"), none("string").alias("uuid"), none("string").alias("parent_uuid"), none("int").alias("exit_code"), F.lit("x").alias("text"),
        F.when(e % 4 != 0, F.col("is_error")).alias("native_error"), F.when(e % 2 == 0, "req").alias("request_id"), F.when(F.col("tool") == "shell", "ls").alias("command"),
        (F.col("stream") != "main").alias("is_subagent"), none("int").alias("usage_cache_read"), F.when(e % 7 == 0, 1).alias("usage_in"), F.when(e % 7 == 0, 1).alias("usage_out"))
    return pairing.capabilities(events).select("session_id", F.array_join("capabilities", ",").alias("capabilities"))


@R.query("spliced_view", """
with s as (select session_id, min(pos) as target from {clog} where role = 'assistant' group by 1)
select session_id, pos, role, case when pos = target then '[claimed]' else text end as text, pos = target as spliced from {clog} join s using (session_id)""", ("clog",))
def spliced_view(clog):
    turns = clog.withColumn("call", F.when(F.col("role") == "assistant", F.lit("c")))
    specs = clog.where("role = 'assistant'").select("session_id").distinct()
    specs = specs.select("session_id", F.concat(F.lit("v"), F.col("session_id")).alias("view_id"), F.lit("c").alias("call"), F.lit("[claimed]").alias("claimed"))
    return views.spliced(turns, specs, "session_id", "pos", "call", F.col("role") == "assistant", "text").select("session_id", "pos", "role", "text", "spliced")


@R.query("input_fallback", """
with r as (select doc_id from {docs}), a as (select doc_id, text from {docs} where doc_id % 3 = 0), b as (select doc_id, text from {docs} where doc_id % 2 = 0)
select r.doc_id, sha256(coalesce(a.text, b.text)) as sha, case when a.doc_id is not null then 'first' when b.doc_id is not null then 'second' else 'none' end as provenance
from r left join a on a.doc_id = r.doc_id left join b on b.doc_id = r.doc_id""", ("docs",))
def input_fallback(docs):
    part = lambda m: docs.where(F.col("doc_id") % m == 0).select("doc_id", "text")
    got = views.with_fallback(docs.select("doc_id"), part(3), part(2), ["doc_id"], "text")
    return got.select("doc_id", F.sha2("text", 256).alias("sha"), "provenance")


@R.query("answers_last", """
select call_key, verdict, coalesce(case when cited_seq % 3 = 0 then 'spoofed' when cited_seq % 3 = 1 then 'not_spoofed' end, 'unlabelled') as label from {checks} where check_name = 'alpha'""", ("checks",))
def answers_last(checks):
    v = checks.where("check_name = 'alpha'")
    labels = v.where("cited_seq % 3 < 2").select("call_key", F.when(F.col("cited_seq") % 3 == 0, "spoofed").otherwise("not_spoofed").alias("label"))
    return views.answered(v.select("call_key", "verdict"), labels, "call_key", "label")


@R.query("no_human_wait", """
with c as (select session_id, seq, call_id, tool, k, value, event_id, max(seq) over (partition by session_id, cast(floor(seq / 4) as bigint)) = seq as last from {elog} where kind = 'call' and call_id is not null),
h as (select distinct session_id, call_id from {elog} where kind = 'user' and call_id is not null and event_id % 3 = 0),
p as (select session_id, seq, case when event_id % 4 = 0 then 'ask' else 'never' end as policy from {elog} where kind = 'assistant'),
j as (select c.*, h.call_id is not null as hooked, (select arg_max(policy, p.seq) from p where p.session_id = c.session_id and p.seq < c.seq) as policy
      from c left join h on h.session_id = c.session_id and h.call_id = c.call_id)
select session_id, seq, case when not coalesce(value - 5 > 0, false) then 'latency' when not coalesce(tool in ('shell', 'read'), false) then 'class' when not last then 'last_of_message'
       when coalesce(k % 7 = 0, false) then 'refusal' when coalesce(k % 5 = 0, false) then 'status' when hooked then 'hook' when coalesce(policy, 'x') <> 'never' then 'policy' when event_id % 11 = 0 then 'background' end as failed from j""")
def no_human_wait(elog):
    e, kind = F.col("event_id"), F.col("kind")
    calls = elog.where("kind = 'call' and call_id is not null").withColumn("api_msg_id", F.floor(F.col("seq") / 4).cast("string"))
    pairs = qualify.last_of_message(calls).select(
        "session_id", "call_id", "seq", (F.col("value") - 5).alias("latency"), F.when(F.col("tool") == "read", "auto_read").otherwise(F.col("tool")).alias("cls"), "tool", "last",
        F.when(F.col("k") % 7 == 0, "cc_permission_denied").alias("marker"), F.when(F.col("k") % 5 == 0, "declined").alias("status"), (e % 11 == 0).alias("background"),
    )
    hooks = elog.where((kind == "user") & F.col("call_id").isNotNull() & (e % 3 == 0))
    policies = elog.where(kind == "assistant").select("session_id", "seq", F.when(e % 4 == 0, "ask").otherwise("never").alias("policy"))
    return qualify.qualified(pairs, hooks, policies).select("session_id", "seq", "failed")


# --- knowledge -------------------------------------------------------------------------------

_TOKENS = r"""
with t as (select session_id, pos, role, unnest(list_distinct(regexp_extract_all(text, '[a-z]{7,}'))) as token from {clog})"""


@R.query("knowledge_precedence", _TOKENS + """,
u as (select session_id, token, min(pos) as used from t where role = 'assistant' group by 1, 2), s as (select session_id, token, min(pos) as shown from t where role <> 'assistant' group by 1, 2)
select u.session_id, u.token, shown, used, shown is null or shown > used as before from u left join s on u.session_id = s.session_id and u.token = s.token""", ("clog",))
def knowledge_precedence(clog):
    t = knowledge.tokens(clog, SESSION, "pos", F.col("text"), r"[a-z]{7,}", ("role",))
    return knowledge.first_use(t.where("role <> 'assistant'"), t.where("role = 'assistant'"), SESSION, "pos")


@R.query("narration_support", _TOKENS + """
select c.session_id, c.pos, c.token, exists (select 1 from t where t.session_id = c.session_id and t.token = c.token and t.pos < c.pos and t.role = 'user') as in_user,
       exists (select 1 from t where t.session_id = c.session_id and t.token = c.token and t.pos < c.pos and t.role = 'system') as in_system,
       exists (select 1 from t where t.session_id = c.session_id and t.token = c.token and t.pos < c.pos and t.role = 'assistant') as in_assistant
from t c where role = 'assistant'""", ("clog",))
def narration_support(clog):
    t = knowledge.tokens(clog, SESSION, "pos", F.col("text"), r"[a-z]{7,}", ("role",))
    return knowledge.support(t, SESSION, "pos", "role", "assistant", ("user", "system", "assistant"))


@R.query("error_classes", r"""
with f as (select doc_id, ['marked', 'headed', 'native', 'two_level', 'stderr', 'exit_code', 'other'][1 + doc_id % 7] as family,
                  case doc_id % 5 when 0 then 'Exit code 2' when 1 then 'Process exited with code 1' when 2 then 'Exit Code: 3' when 3 then 'User rejected' else 'fine' end as text,
                  case doc_id % 4 when 0 then 'returncode 7' when 1 then 'timed out: x' else '' end as stderr,
                  case doc_id % 3 when 0 then true when 1 then false end as native, case when doc_id % 2 = 0 then doc_id % 6 end as code from {docs}),
m as (select *, coalesce(native, false) as failed, case when text = 'Exit code 2' then 'cc_exit_code' when text = 'User rejected' then 'cc_interrupt_reject' when text = 'Exit Code: 3' then 'gemini_exit_code_nonzero' end as mark from f)
select doc_id,
       case family when 'marked' then failed and coalesce(mark <> 'cc_interrupt_reject', true) when 'headed' then failed or (native is null and starts_with(text, 'Process')) when 'native' then failed
            when 'two_level' then failed or text = 'Exit Code: 3' when 'stderr' then stderr <> '' when 'exit_code' then code is not null and code <> 0 end as primary_error,
       case family when 'marked' then case when failed then coalesce(mark, 'unmarked') else 'ok' end
            when 'headed' then case when failed then 'native' when native is null and starts_with(text, 'Process') then 'exit_header' else 'ok' end
            when 'native' then case when failed then 'native' else 'ok' end
            when 'two_level' then case when failed and text = 'Exit Code: 3' then 'tool_failure+command_failure' when failed then 'tool_failure' when text = 'Exit Code: 3' then 'command_failure' else 'ok' end
            when 'stderr' then case when stderr <> '' then 'proxy' else 'ok' end
            when 'exit_code' then case when code is null then 'no_exit_code' when code <> 0 then 'exit_nonzero' else 'ok' end else 'no_definition' end as class
from m""", ("docs",))
def error_classes(docs):
    d = F.col("doc_id")
    pick = lambda m, *values: F.element_at(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), (d % m + 1).cast("int"))
    family = pick(7, *errors.FAMILIES, "other")
    text = pick(5, "Exit code 2", "Process exited with code 1", "Exit Code: 3", "User rejected", "fine")
    stderr, native = pick(4, "returncode 7", "timed out: x", "", ""), pick(3, F.lit(True), F.lit(False), F.lit(None).cast("boolean"))
    e = errors.error_class(family, text, stderr, native, F.when(d % 2 == 0, d % 6))
    return docs.select("doc_id", e.alias("e")).select("doc_id", F.col("e.primary").alias("primary_error"), "e.class")


# --- bootstrap -------------------------------------------------------------------------------

_TIMES = "(" + " + ".join(f"case when u >= {s} then 1 else 0 end" for s in bootstrap.STEPS) + ")"
#: Draws of the clusters in table per, whose cluster column is c; and limits over table d(r).
_DRAWN = f"""
w as (select *, {_TIMES} as times from (select per.*, draw, cast('0x' || substr(md5('{bootstrap.SEED}:' || cast(c as string) || ':' || cast(draw as string)), 1, 8) as bigint) as u
      from per cross join (select unnest(range(1, {bootstrap.DRAWS + 1})) as draw) s) x)"""
_LIMITS = "round(quantile_cont(r, 0.025), 6) as lo, round(quantile_cont(r, 0.975), 6) as hi, count(r) as valid_draws"
_RESULTS = "select session_id as c, is_error, value, k from {elog} where kind = 'result'"


def _rounded(df, *names):
    return df.select(*[F.round(n, 6).alias(n) if n in (*names, "lo", "hi") else F.col(n) for n in df.columns])


@R.query("boot_weighted_rate", f"""
with per as (select c, count(case when is_error then 1 end) * (1.0 + c % 3) as num, count(*) * (1.0 + c % 3) as den from ({_RESULTS}) r group by 1), {_DRAWN},
d as (select sum(times * num) / sum(times * den) as r from w group by draw)
select (select round(sum(num) / sum(den), 6) from per) as rate, {_LIMITS} from d""")
def boot_weighted_rate(elog):
    rows = elog.where("kind = 'result'")
    return _rounded(bootstrap.weighted_rate(rows, "session_id", F.col("is_error").cast("int"), F.lit(1), 1.0 + F.col("session_id") % 3), "rate")


@R.query("boot_difference", f"""
with per as (select c, count(case when is_error and k % 2 = 0 then 1 end) as an, count(case when k % 2 = 0 then 1 end) as ad, count(case when is_error and k % 2 = 1 then 1 end) as bn, count(case when k % 2 = 1 then 1 end) as bd
             from ({_RESULTS}) r group by 1), {_DRAWN},
d as (select sum(times * an) / nullif(cast(sum(times * ad) as double), 0) - sum(times * bn) / nullif(cast(sum(times * bd) as double), 0) as r from w group by draw),
v as (select sum(an) / cast(sum(ad) as double) as a, sum(bn) / cast(sum(bd) as double) as b from per)
select (select round(a, 6) from v) as a, (select round(b, 6) from v) as b, (select round(a - b, 6) from v) as difference, {_LIMITS} from d""")
def boot_difference(elog):
    rows, even, bad = elog.where("kind = 'result'"), F.col("k") % 2 == 0, F.col("is_error")
    one = lambda c: F.when(c, 1).otherwise(0)
    odd = F.col("k") % 2 == 1
    got = bootstrap.difference(rows, "session_id", (one(bad & even), one(even)), (one(bad & odd), one(odd)))
    return _rounded(got, "a", "b", "difference")


@R.query("boot_paired", f"""
with per as (select c, sum(value - k / 10.0) as num, count(*) as den from ({_RESULTS}) r where value is not null and k is not null group by 1), {_DRAWN},
d as (select sum(times * num) / sum(times * den) as r from w group by draw)
select (select round(sum(num) / sum(den), 6) from per) as mean, {_LIMITS} from d""")
def boot_paired(elog):
    rows = elog.where("kind = 'result'").withColumn("y", F.col("k") / 10.0)
    return _rounded(bootstrap.paired_difference(rows, "session_id", "value", "y"), "mean")


@R.query("boot_quantile", f"""
with per as (select c, floor(value) as v, count(*) as n from ({_RESULTS}) r group by 1, 2), {_DRAWN},
d as (select draw, quantile_cont(v, 0.75) as r from (select draw, v, unnest(range(n * times)) as i from w where times > 0) x group by 1)
select 0.75::double as q, (select quantile_cont(floor(value), 0.75) from ({_RESULTS}) r) as value, {_LIMITS} from d""")
def boot_quantile(elog):
    rows = elog.where("kind = 'result'").withColumn("v", F.floor("value"))
    return _rounded(bootstrap.quantile(rows, "session_id", "v", 0.75))


@R.query("boot_auc", f"""
with per as (select c, floor(value) as v, count(case when is_error then 1 end) as p, count(case when not is_error then 1 end) as n from ({_RESULTS}) r group by 1, 2), {_DRAWN},
s as (select draw, v, sum(times * p) as p, sum(times * n) as n from w group by 1, 2 union all select 0, v, sum(p), sum(n) from per group by 2),
b as (select *, coalesce(sum(n) over (partition by draw order by v rows between unbounded preceding and 1 preceding), 0) as below from s),
d as (select draw, sum(p * (below + n / 2.0)) / nullif(cast(sum(p) as double) * sum(n), 0) as r from b group by 1)
select (select round(r, 6) from d where draw = 0) as auc, {_LIMITS} from d where draw > 0""")
def boot_auc(elog):
    rows = elog.where("kind = 'result'").withColumn("v", F.floor("value"))
    return _rounded(bootstrap.area(rows, "session_id", "v", F.col("is_error")), "auc")


@R.query("boot_spearman", f"""
with per as (select c, floor(value / 10) as x, k % 10 as y, count(*) as n from ({_RESULTS}) r where value is not null and k is not null group by 1, 2, 3), {_DRAWN},
t as (select draw, x, y, n * times as t from w where times > 0 union all select 0, x, y, n from per),
rx as (select draw, x, coalesce(sum(m) over (partition by draw order by x rows between unbounded preceding and 1 preceding), 0) + (m + 1) / 2.0 as r from (select draw, x, sum(t) as m from t group by 1, 2) a),
ry as (select draw, y, coalesce(sum(m) over (partition by draw order by y rows between unbounded preceding and 1 preceding), 0) + (m + 1) / 2.0 as r from (select draw, y, sum(t) as m from t group by 1, 2) a),
j as (select t.draw, cast(t.t as double) as t, rx.r as a, ry.r as b from t join rx on rx.draw = t.draw and rx.x = t.x join ry on ry.draw = t.draw and ry.y = t.y),
d as (select draw, (sum(t * a * b) - sum(t * a) * sum(t * b) / sum(t)) / sqrt((sum(t * a * a) - power(sum(t * a), 2) / sum(t)) * (sum(t * b * b) - power(sum(t * b), 2) / sum(t))) as r from j group by 1)
select (select round(r, 6) from d where draw = 0) as rho, {_LIMITS} from d where draw > 0""")
def boot_spearman(elog):
    rows = elog.where("kind = 'result'").select("session_id", F.floor(F.col("value") / 10).alias("x"), (F.col("k") % 10).alias("y"))
    return _rounded(bootstrap.spearman(rows, "session_id", "x", "y"), "rho")


@R.query("cluster_rate", f"""
with per as (select c, cast(count(case when is_error then 1 end) as double) as num, cast(count(*) as double) as den from ({_RESULTS}) r group by 1), {_DRAWN},
d as (select sum(times * num) / sum(times * den) as r from w group by draw)
select (select round(sum(num) / sum(den), 6) from per) as rate, round(quantile_cont(r, 0.025), 6) as lo, round(quantile_cont(r, 0.975), 6) as hi,
       (select count(*) from per) as n_clusters, (select sum(num) from per) as num, (select sum(den) from per) as den from d""")
def cluster_rate(elog):
    from ..operators import stats

    return _rounded(stats.cluster_rate(elog.where("kind = 'result'"), "session_id", F.col("is_error").cast("int"), F.lit(1)), "rate")


# --- labels ----------------------------------------------------------------------------------

_FOUND = [("ALIVE", "ALIVE", []), ("ALIVE", "WEAK", []), ("WEAK", "DEAD", ["pass"]), ("ALIVE", None, ["downgrade"]), ("DEAD", "ALIVE", ["cap_weak"]), ("WEAK", "INSUFFICIENT_N", ["kill"]), (None, None, None), ("WEAK", "WEAK", ["downgrade"])]


@R.query("survival", """
select * from (values (0, 'SURVIVES', 'ALIVE'), (1, 'DOWNGRADED', 'WEAK'), (2, 'KILLED', 'DEAD'), (3, 'DOWNGRADED (B only, unreplicated)', 'WEAK'), (4, 'DOWNGRADED', 'WEAK'),
                      (5, 'KILLED (NOT_REPLICABLE_AT_N)', 'DEAD'), (6, 'NOT_RUN (B only, unreplicated)', null), (7, 'KILLED', 'DEAD')) as t(id, status, label)
where (select count(*) from {elog}) >= 0""")
def survival(elog):
    found = elog.sparkSession.createDataFrame([(k, *x) for k, x in enumerate(_FOUND)], "id int, first string, again string, effects array<string>")
    status, label = shares.survival(F.col("first"), F.col("again"), F.col("effects"))
    return found.select("id", status.alias("status"), label.alias("label"))


@R.query("confinement", """
with c as (select tool, stream, count(*) as n, count(case when is_error then 1 end) as e from {elog} where tool is not null group by 1, 2),
l as (select tool, case when n < 30 then null when e >= 0.5 * n then 'ALIVE' when e >= 0.3 * n then 'WEAK' else 'DEAD' end as label from c)
select tool, case when count(label) < 2 then 'UNTESTABLE' when count(case when label <> 'DEAD' then 1 end) = 1 then 'CONFINED' else 'OK' end as confinement from l group by 1""")
def confinement(elog):
    c = elog.where("tool is not null").groupBy("tool", "stream").agg(F.count("*").alias("n"), F.count_if("is_error").alias("e"))
    label = F.when(F.col("n") < 30, None).when(F.col("e") >= 0.5 * F.col("n"), "ALIVE").when(F.col("e") >= 0.3 * F.col("n"), "WEAK").otherwise("DEAD")
    return shares.confinement(c.withColumn("label", label), ["tool"])


@R.query("transfer", """
with c as (select session_id % 12 as unit, count(distinct session_id) as s, count(case when is_error then 1 end) / cast(count(*) as double) as p, count(*) as n from {elog} where kind = 'result' group by 1),
w as (select *, (p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n) as hi from c)
select unit, case when s < 3 then 'INSUFFICIENT_N' when p / 10 <= 0.05 and hi / 10 <= 0.10 and unit % 2 = 0 then 'ALIVE' when p / 10 <= 0.20 and unit % 3 = 0 then 'WEAK' else 'DEAD' end as label from w""")
def transfer(elog):
    from ..operators import stats

    c = elog.where("kind = 'result'").groupBy((F.col("session_id") % 12).alias("unit"))
    c = c.agg(F.countDistinct("session_id").alias("s"), F.count_if("is_error").alias("k"), F.count("*").alias("n"))
    p, _, hi = stats.wilson(F.col("k"), F.col("n"))
    u = F.col("unit")
    return c.select("unit", shares.transfer(F.col("s"), p / 10, hi / 10, u % 2 == 0, u % 3 == 0, 3).alias("label"))
