"""Structural checks, session views and joins over order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, pairing, structural
from .registry import Registry

R = Registry()

_T0 = """
with s as (
  select *, row_number() over (partition by key order by pos) as rn, count(*) over (partition by key) as n,
         count(case when role = 'tool_use' then 1 end) over (partition by key, tool_call_id) as uses,
         count(case when role = 'tool_result' then 1 end) over (partition by key, tool_call_id) as results,
         count(case when role = 'tool_use' then 1 end) over (partition by key, tool_call_id order by pos rows between unbounded preceding and 1 preceding) as uses_before,
         min(case when role = 'tool_result' then pos end) over (partition by key, tool_call_id order by pos rows between 1 following and unbounded following) as next_result,
         min(case when role = 'tool_result' then pos end) over (partition by key, tool_call_id) as first_result,
         min(pos) over (partition by key, tool_call_id) as first_pos,
         min(case when role = 'tool_use' then tool_name end) over (partition by key, tool_call_id) as u0,
         max(case when role = 'tool_use' then tool_name end) over (partition by key, tool_call_id) as u1,
         min(case when role = 'tool_result' then tool_name end) over (partition by key, tool_call_id) as r0,
         max(case when role = 'tool_result' then tool_name end) over (partition by key, tool_call_id) as r1,
         first_value(session_id) over (partition by key order by pos) as s0,
         lag(uuid) over (partition by key order by pos) as pu, lag(turn_number) over (partition by key order by pos) as pn,
         lag(cast(timestamp as bigint)) over (partition by key order by pos) as pt
  from {tlog}),
v as (
  select 'duplicate_call_id' as rule, key from s where tool_call_id is not null and pos = first_pos and (uses > 1 or results > 1)
  union all select 'orphan_result', key from s where role = 'tool_result' and uses = 0
  union all select 'result_before_call', key from s where role = 'tool_result' and uses > 0 and uses_before = 0
  union all select 'missing_result', key from s where role = 'tool_use' and next_result is null and rn < n
  union all select 'result_not_adjacent', key from s where role = 'tool_use' and next_result <> pos + 1
  union all select 'tool_name_mismatch', key from s where role = 'tool_result' and pos = first_result and uses > 0 and (u0 <> r0 or u1 <> r1 or (r0 <> r1 and u0 = u1))
  union all select 'session_id_mismatch', key from s where session_id <> s0
  union all select 'turn_id_mismatch', key from s where turn_id <> session_id || ':' || cast(turn_number as string)
  union all select 'parent_chain_break', key from s where case when rn = 1 then parent_uuid is not null else parent_uuid is distinct from pu end
  union all select 'turn_number_gap', key from s where case when rn = 1 then turn_number <> 1 else turn_number - pn <> 1 end
  union all select 'timestamp_regression', key from s where cast(timestamp as bigint) < pt)
select rule, count(*) as violations, count(distinct key) as sessions from v group by rule
"""


@R.query("t0_rules", _T0, ("tlog",))
def t0_rules(tlog):
    return structural.find(tlog).groupBy("rule").agg(F.count("*").alias("violations"), F.countDistinct("key").alias("sessions"))


_RANKED = "[" + ", ".join(f"'{r}'" for r in structural.RULES) + "]"
_T0_VERDICTS = _T0[: _T0.index("v as (")].replace("lag(uuid) over", "lag(role) over w as p_role, lag(tool_call_id) over w as p_call, lag(cast(timestamp as bigint), 2) over w as ppt, lead(cast(timestamp as bigint)) over w as nt, lag(uuid) over", 1).replace("from {tlog})", "from {tlog} window w as (partition by key order by pos))") + f"""
e as (select *, cast(timestamp as bigint) as tm, role in ('tool_use', 'tool_result') as tool, coalesce(p_role in ('tool_use', 'tool_result'), false) as p_tool,
             case when role in ('tool_use', 'tool_result') and tool_call_id is not null then [tool_call_id] else [] end as own,
             list_distinct(list_filter([case when role = 'tool_result' then tool_call_id end, case when p_role = 'tool_use' then p_call end], lambda x: x is not null)) as edge from s),
f as (select *, nt is null or nt >= pt as back, ppt is null or tm >= ppt as forward from e),
v as (
  select key, 'duplicate_call_id' as rule, [tool_call_id] as calls from f where tool and tool_call_id is not null and pos = first_pos and (uses > 1 or results > 1)
  union all select key, 'orphan_result', own from f where role = 'tool_result' and tool_call_id is not null and uses = 0
  union all select key, 'result_before_call', own from f where role = 'tool_result' and tool_call_id is not null and uses > 0 and uses_before = 0
  union all select key, 'missing_result', own from f where role = 'tool_use' and tool_call_id is not null and next_result is null and rn < n
  union all select key, 'result_not_adjacent', own from f where role = 'tool_use' and tool_call_id is not null and next_result <> pos + 1
  union all select key, 'tool_name_mismatch', own from f where role = 'tool_result' and tool_call_id is not null and pos = first_result and uses > 0 and (u0 <> r0 or u1 <> r1 or (r0 <> r1 and u0 = u1))
  union all select key, 'session_id_mismatch', own from f where session_id <> s0
  union all select key, 'turn_id_mismatch', own from f where turn_id <> session_id || ':' || cast(turn_number as string)
  union all select key, 'parent_chain_break', case when rn = 1 then own else edge end from f where case when rn = 1 then parent_uuid is not null else parent_uuid is distinct from pu end
  union all select key, 'turn_number_gap', case when rn = 1 then own else edge end from f where case when rn = 1 then turn_number <> 1 else turn_number - pn <> 1 end
  union all select key, 'timestamp_regression', case when role = 'tool_result' and p_role = 'tool_use' and tool_call_id is not distinct from p_call then own
      else list_filter([case when tool and (back or not forward) then tool_call_id end, case when p_tool and (forward or not back) then p_call end], lambda x: x is not null) end from f where tm < pt),
b as (select distinct key, unnest(case when len(calls) > 0 then calls else ['__session__'] end) as call_id, rule, list_position({_RANKED}, rule) as r from v),
g as (select key, call_id, string_agg(rule, ',' order by r) as rules, arg_min(rule, r) as first from b group by 1, 2),
c as (select key, tool_call_id as call_id, count(case when role = 'tool_result' then 1 end) as results, max(case when role = 'tool_use' then pos end) as last_use from e where tool and tool_call_id is not null group by 1, 2),
k as (select key, max(pos) as last from e group by 1), d as (select distinct key from g),
j as (select coalesce(c.key, g.key) as key, coalesce(c.call_id, g.call_id) as call_id, results, last_use, rules, first from c full join g on c.key = g.key and c.call_id = g.call_id),
o as (select j.key, call_id, coalesce(rules, '') as rules, case when first is not null then 'violation:' || first when results = 0 and last_use = last then 'missing:result_truncated_at_end'
             when d.key is not null then 'abstain:session_structure_broken' else 'ok:structure_intact' end as reason from j join k on k.key = j.key left join d on d.key = j.key)
select key, call_id, case when starts_with(reason, 'violation') then 'contradicted' when starts_with(reason, 'ok') then 'supported' else 'unconstrained' end as verdict, reason, rules from o"""


@R.query("t0_verdicts", _T0_VERDICTS, ("tlog",))
def t0_verdicts(tlog):
    return structural.verdicts(tlog).select("key", "call_id", "verdict", "reason", F.array_join("rules", ",").alias("rules"))


_G = "with g as (select *, sum(case when kind = 'call' then 1 else 0 end) over (partition by session_id, call_id order by seq) as grp from {elog} where kind in ('call', 'result')) "

@R.query("pair_calls", _G + "select session_id, call_id, min(case when kind = 'call' then seq end) as call_seq, min(case when kind = 'result' then seq end) as result_seq, cast(count(case when kind = 'result' then 1 end) as bigint) as n_results from g where grp > 0 group by session_id, call_id, grp")
def pair_calls(elog):
    return pairing.pair_calls(elog)


@R.query("orphan_results", _G + "select session_id, call_id, seq from g where kind = 'result' and grp = 0")
def orphan_results(elog):
    return pairing.orphans(elog)


@R.query("call_keys", "select session_id, call_id, seq, case when count(*) over (partition by session_id, call_id) = 1 then cast(call_id as string) else cast(call_id as string) || '@' || cast(seq as string) end as call_key from {elog} where kind = 'call'")
def call_keys(elog):
    return pairing.call_keys(elog)


@R.query("first_pairs", "with c as (select session_id, call_id, min(seq) as call_seq, min_by(ts_us, seq) as a from {elog} where kind = 'call' group by 1, 2), r as (select session_id, call_id, min(seq) as result_seq, min_by(ts_us, seq) as b from {elog} where kind = 'result' group by 1, 2) select c.session_id, c.call_id, call_seq, result_seq, (b - a) / 1e6 as delta_s from c join r on c.session_id = r.session_id and c.call_id = r.call_id")
def first_pairs(elog):
    return pairing.first_pairs(elog)


@R.query("responses", """
with m as (select session_id, request_id as resp_key, api_msg_id, min(seq) as a, max(seq) as b, count(*) as n,
             min_by(usage_in, seq) filter (where usage_in is not null) as ui, max(usage_out) filter (where usage_in is not null) as uo,
             min_by(usage_cache_read, seq) filter (where usage_in is not null and usage_cache_read is not null) as cr,
             min_by(usage_cache_create, seq) filter (where usage_in is not null and usage_cache_create is not null) as cc
           from {rlog} group by 1, 2, 3)
select session_id, resp_key, min(a) as first_seq, max(b) as last_seq, cast(sum(n) as bigint) as n_rows, cast(sum(ui) as bigint) as usage_in, cast(sum(uo) as bigint) as usage_out, cast(sum(cr) as bigint) as usage_cache_read, cast(sum(cc) as bigint) as usage_cache_create
from m group by 1, 2""", ("rlog",))
def responses(rlog):
    return pairing.responses(rlog).drop("calls")


@R.query("asof_result", "select session_id, seq, max(case when kind = 'result' then seq end) over (partition by session_id order by seq rows between unbounded preceding and 1 preceding) as prev_result from {elog} where kind in ('call', 'result', 'assistant')")
def asof_result(elog):
    own = elog.where("kind in ('call', 'result', 'assistant')")
    return own.select("session_id", "seq", joins.asof_backward(own, ["session_id"], ["seq"], F.when(F.col("kind") == "result", F.col("seq"))).alias("prev_result"))


@R.query("asof_input", "select a.session_id, a.seq, b.ts_us as input_us from (select * from {elog} where kind = 'assistant') a asof left join (select * from {elog} where kind = 'result') b on a.session_id = b.session_id and a.stream = b.stream and a.ts_us > b.ts_us")
def asof_input(elog):
    shown = F.when(F.col("kind") == "result", F.col("ts_us"))
    return elog.withColumn("input_us", joins.asof_earlier(elog, ["session_id", "stream"], "ts_us", shown)).where("kind = 'assistant'").select("session_id", "seq", "input_us")


@R.query("determinism_pairs", """
with e as (select session_id, seq, k % 4 as key, value > 30 as output, kind, sum(case when kind = 'user' then 1 else 0 end) over (partition by session_id order by seq) as epoch from {elog}),
p as (select session_id, key, seq, output, lag(seq) over w as prev_seq, lag(output) over w as prev_output, lag(epoch) over w as prev_epoch, epoch from e where kind = 'result' and key is not null window w as (partition by session_id, key order by seq))
select session_id, key, prev_seq as first_seq, seq as second_seq, output = prev_output as same from p where prev_epoch = epoch""")
def determinism_pairs(elog):
    rows = elog.select("session_id", "seq", "kind", (F.col("k") % 4).alias("key"), (F.col("value") > 30).alias("output"))
    return joins.repeated_calls(rows, ["session_id"], "seq", "key", "output", F.col("kind") == "user", F.col("kind") == "result")


_SPANS = "select session_id, call_id, ts_us as a, ts_us + cast(floor(value * 60000000) as bigint) as b, event_id from {elog} where kind = 'call'"

@R.query("in_flight", f"with i as ({_SPANS}) select x.session_id, x.event_id, count(*) as n from i x join i y on x.session_id = y.session_id and y.a <= (x.a + x.b) / 2 and y.b >= (x.a + x.b) / 2 group by 1, 2")
def in_flight(elog):
    spans = elog.where("kind = 'call'").select("session_id", "event_id", F.col("ts_us").alias("a"), (F.col("ts_us") + F.floor(F.col("value") * 60000000)).alias("b"))
    return joins.in_flight(spans, "session_id", "a", "b", ["event_id"])


@R.query("interval_union", f"with i as ({_SPANS}), p as (select *, max(b) over (partition by session_id order by a, b rows between unbounded preceding and 1 preceding) as reach from i) select session_id, cast(sum(greatest(0, b - greatest(a, coalesce(reach, a)))) as bigint) as length, count(case when reach is null or a > reach then 1 end) as pieces from p group by session_id")
def interval_union(elog):
    spans = elog.where("kind = 'call'").select("session_id", F.col("ts_us").alias("a"), (F.col("ts_us") + F.floor(F.col("value") * 60000000)).alias("b"))
    return joins.interval_union(spans, "session_id", "a", "b")


@R.query("bursts", "with g as (select *, case when ts_us - lag(ts_us) over (partition by session_id order by ts_us, event_id) <= 14400000000 then 0 else 1 end as new from {elog}), b as (select *, sum(new) over (partition by session_id order by ts_us, event_id) as burst from g) select session_id, cast(burst as bigint) as burst, count(*) as n, max(ts_us) - min(ts_us) as span_us from b group by 1, 2")
def bursts(elog):
    b = joins.bursts(elog, "session_id", "ts_us", 14400000000, "event_id")
    return b.groupBy("session_id", "burst").agg(F.count("*").alias("n"), (F.max("ts_us") - F.min("ts_us")).alias("span_us"))


@R.query("hits_in_window", "select c.session_id, c.seq, count(r.seq) > 0 as hit from (select * from {elog} where kind = 'call') c left join (select * from {elog} where kind = 'result') r on c.session_id = r.session_id and r.ts_us >= c.ts_us - 3600000000 and r.ts_us < c.ts_us + 7200000000 group by 1, 2")
def hits_in_window(elog):
    cols = ["session_id", "seq", "ts_us"]
    return joins.hits_in_window(elog.where("kind = 'call'").select(*cols), elog.where("kind = 'result'").select(*cols), "session_id", "ts_us", -3600000000, 7200000000).drop("ts_us")


@R.query("copied_ids", "select k, count(distinct session_id) as owners, min(session_id) as first from {elog} where k is not null group by k having count(distinct session_id) > 1")
def copied_ids(elog):
    return joins.shared_keys(elog, "k", "session_id")


@R.query("clean_pairs", "select c.session_id, c.call_id from (select session_id, call_id from {elog} where kind = 'call' group by 1, 2 having count(*) = 1) c join (select session_id, call_id from {elog} where kind = 'result' group by 1, 2 having count(*) = 1) r on c.session_id = r.session_id and c.call_id = r.call_id")
def clean_pairs(elog):
    key = ["session_id", "call_id"]
    return joins.once_both_sides(elog.where("kind = 'call'").select(*key), elog.where("kind = 'result'").select(*key), key)


_DONOR = "select o_custkey, o_orderkey, o_orderdate, cast(floor(o_totalprice) as bigint) as size from {orders}"

@R.query("donor_match", f"with o as ({_DONOR}), p as (select a.o_custkey, a.o_orderkey, abs(b.size - a.size) as gap from o a join o b on a.o_orderdate = b.o_orderdate and a.o_custkey <> b.o_custkey and abs(b.size - a.size) <= a.size // 20) select o_custkey, o_orderkey, min(gap) as gap from p group by 1, 2", ("orders",))
def donor_match(orders):
    o = orders.select("o_custkey", "o_orderkey", "o_orderdate", F.floor("o_totalprice").alias("size"))
    return joins.donors(o, o, ["o_orderdate"], "o_custkey", "o_orderkey", "size").select("o_custkey", "o_orderkey", F.abs(F.col("r_size") - F.col("size")).alias("gap"))


@R.query("band_pairs", "select a.session_id, count(*) as pairs from (select * from {elog} where kind = 'call') a join (select * from {elog} where kind = 'result') b on a.session_id = b.session_id and abs(a.ts_us - b.ts_us) <= 1800000000 group by 1")
def band_pairs(elog):
    cols = ["session_id", "ts_us"]
    got = joins.band_join(elog.where("kind = 'call'").select(*cols), elog.where("kind = 'result'").select(*cols), ["session_id"], "ts_us", 1800000000)
    return got.groupBy("session_id").agg(F.count("*").alias("pairs"))


@R.query("prefix_resolution", f"with f as (select distinct sha256(text) as sha from {{docs}}), s as (select doc_id, substr(sha256(text), 1, cast(8 + doc_id % 5 as int)) as short from {{docs}}) select s.doc_id, count(*) as matches from s join f on starts_with(f.sha, s.short) group by 1", ("docs",))
def prefix_resolution(docs):
    full = docs.select(F.sha2("text", 256).alias("sha")).distinct()
    short = docs.select("doc_id", F.substr(F.sha2("text", 256), F.lit(1), (8 + F.col("doc_id") % 5).cast("int")).alias("short"))
    return joins.prefix_join(short, full, "short", "sha").groupBy("doc_id").agg(F.count("*").alias("matches"))


