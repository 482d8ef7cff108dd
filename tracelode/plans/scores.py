"""Composition, labels, stratified scores, and the batteries over clocks, gaps, retries and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring
from .registry import Registry

R = Registry()

_RANK = "case strength when 'identity' then 5 when 'strong' then 4 when 'statistical' then 3 when 'weak' then 2 else 1 end"
_COMPOSE = f"""
with d as (select *, {_RANK} as r from {{checks}} where kind <> 'reference'),
b as (select call_key, check_name, strength, reason, confidence, row_number() over (partition by call_key order by r desc, localized desc, confidence desc, check_name desc) as rn from d where verdict = 'contradicted'),
g as (select call_key, check_name, strength, reason, confidence, row_number() over (partition by call_key order by r desc, confidence desc, check_name desc) as rn from d where verdict = 'supported'),
u as (select call_key, reason, row_number() over (partition by call_key order by n desc, reason) as rn from (select call_key, reason, count(*) as n from d group by 1, 2) t),
k as (select distinct call_key from {{checks}})
select k.call_key, case when b.call_key is not null then 'contradicted' when g.call_key is not null then 'supported' else 'unconstrained' end as verdict,
       coalesce(b.strength, g.strength, 'none') as strength, coalesce(b.check_name, g.check_name) as rule, coalesce(b.reason, g.reason, u.reason) as reason,
       b.call_key is not null and g.call_key is not null as disagreement
from k left join b on k.call_key = b.call_key and b.rn = 1 left join g on k.call_key = g.call_key and g.rn = 1 left join u on k.call_key = u.call_key and u.rn = 1"""


def _checks(checks):
    evidence = F.array(F.struct(F.col("cited_seq").alias("seq"), F.lit("text").alias("field"), F.lit("subject").alias("role"), F.lit(None).cast("string").alias("value")))
    return checks.withColumnRenamed("check_name", "check").withColumn("evidence", evidence)


@R.query("compose", _COMPOSE, ("checks",))
def compose(checks):
    c = _checks(checks)
    return scoring.compose(c.select("call_key").distinct(), c, ["call_key"]).select("call_key", "verdict", "strength", "rule", "reason", "disagreement")


@R.query("compose_blame", "select call_key, max(cited_seq) as blame_seq, bool_or(localized) as localized from {checks} where kind <> 'reference' and verdict = 'contradicted' group by 1", ("checks",))
def compose_blame(checks):
    c = _checks(checks)
    return scoring.compose(c.select("call_key").distinct(), c, ["call_key"]).where("verdict = 'contradicted'").select("call_key", "blame_seq", "localized")


@R.query("combine", "select call_key, case when bool_or(verdict = 'contradicted') then 'contradicted' when bool_or(verdict = 'supported' and check_name in ('alpha', 'gamma')) then 'supported' else 'unconstrained' end as verdict from {checks} group by 1", ("checks",))
def combine(checks):
    return scoring.combine(checks.withColumnRenamed("check_name", "check"), ["call_key"], ("alpha", "gamma"))


@R.query("gap_fill", "with n as (select distinct check_name from {checks}), k as (select distinct call_key from {checks}), c as (select * from {checks} where verdict <> 'unconstrained') select k.call_key, n.check_name, coalesce(c.verdict, 'unconstrained') as verdict, coalesce(c.reason, 'abstain:not_decided') as reason from k cross join n left join c on k.call_key = c.call_key and n.check_name = c.check_name", ("checks",))
def gap_fill(checks):
    c = checks.withColumnRenamed("check_name", "check")
    got = scoring.gap_filled(c.select("call_key").distinct(), c.where("verdict <> 'unconstrained'"), ["alpha", "beta", "gamma", "ref"], ["call_key"])
    return got.select("call_key", F.col("check").alias("check_name"), "verdict", "reason")


_SCORED = "select doc_id, lang, source, m.method, toxic = 1 as spoofed, case when (doc_id * m.a) % 7 = 0 or (toxic = 1 and doc_id % m.b = 0) then 'contradicted' when (doc_id * m.a) % 2 = 0 then 'supported' else 'unconstrained' end as verdict from {docs} cross join (values ('base', 3, 2), ('one', 5, 3), ('two', 11, 4)) as m(method, a, b) where toxic is not null"
_STRATA = f"with r as ({_SCORED}), s as (select *, 'all' as stratum, 'all' as v from r union all select *, 'lang', lang from r union all select *, 'source', source from r)"


def _scored(docs):
    methods = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in (("base", 3, 2), ("one", 5, 3), ("two", 11, 4))])).alias("m")
    r = docs.where("toxic is not null").select("doc_id", "lang", "source", (F.col("toxic") == 1).alias("spoofed"), methods)
    bad = ((F.col("doc_id") * F.col("m.a")) % 7 == 0) | (F.col("spoofed") & (F.col("doc_id") % F.col("m.b") == 0))
    return r.select("doc_id", "lang", "source", "m.method", "spoofed", F.when(bad, "contradicted").when((F.col("doc_id") * F.col("m.a")) % 2 == 0, "supported").otherwise("unconstrained").alias("verdict"))


@R.query("confusion", _STRATA + " select method, stratum, v as value, count(case when spoofed then 1 end) as n_spoofed, count(case when spoofed and verdict = 'contradicted' then 1 end) as caught, count(case when not spoofed and verdict = 'contradicted' then 1 end) as honest_fp, round(count(case when spoofed and verdict = 'contradicted' then 1 end) / cast(nullif(count(case when spoofed then 1 end), 0) as double), 4) as recall, round(count(case when spoofed and verdict = 'contradicted' then 1 end) / cast(nullif(count(case when spoofed and verdict <> 'unconstrained' then 1 end), 0) as double), 4) as recall_of_decided, round(count(case when spoofed and verdict = 'contradicted' then 1 end) / cast(nullif(count(case when verdict = 'contradicted' then 1 end), 0) as double), 4) as \"precision\" from s group by 1, 2, 3", ("docs",))
def confusion(docs):
    return scoring.confusion(_scored(docs), ["lang", "source"]).select("method", "stratum", "value", "n_spoofed", "caught", "honest_fp", "recall", "recall_of_decided", "precision")


@R.query("contributions", f"with r as ({_SCORED}), c as (select doc_id, max(case when method = 'base' and verdict = 'contradicted' then 1 else 0 end) as b, sum(case when method <> 'base' and verdict = 'contradicted' then 1 else 0 end) as ours from r where spoofed group by 1) select r.method, count(case when b = 0 then 1 end) as newly_caught, count(case when ours = 1 then 1 end) as only_here from r join c on r.doc_id = c.doc_id where r.spoofed and r.verdict = 'contradicted' and r.method <> 'base' group by 1", ("docs",))
def contributions(docs):
    return scoring.contributions(_scored(docs), "doc_id", ["one", "two"], "base")


_VERDICTS = "select session_id, call_id, seq, 'sha' || cast(session_id % 7 as string) as ir_sha, case when event_id % 3 = 0 then 'contradicted' else 'supported' end as verdict, event_id from {elog} where kind = 'call'"
_LABELS = "select event_id as label_id, session_id + case when event_id % 19 = 0 then 100000 else 0 end as session_id, case when event_id % 2 = 0 then call_id + case when event_id % 10 = 0 then 50 else 0 end end as call_id, seq, 'pos' as label, 'sha' || cast((session_id + case when event_id % 5 = 0 then 1 else 0 end) % 7 as string) as ir_sha from {elog} where kind = 'call' and event_id % 4 < 2"


@R.query("label_join", f"with v as ({_VERDICTS}), l as ({_LABELS}), s as (select distinct session_id, ir_sha from v), c as (select session_id, call_id, count(*) as n, min(seq) as seq from v group by 1, 2), j as (select l.*, s.ir_sha as v_sha, c.n, c.seq as c_seq, q.seq as q_seq from l left join s on l.session_id = s.session_id left join c on l.session_id = c.session_id and l.call_id = c.call_id left join v q on l.session_id = q.session_id and l.seq = q.seq), t as (select *, case when v_sha is null then 'orphan_label' when call_id is not null and n = 1 then 'ok' when call_id is not null and n > 1 then 'ambiguous' when call_id is not null then 'no_match' when ir_sha <> v_sha then 'seq_mismatch' when q_seq is not null then 'ok' else 'no_match' end as join_status from j), u as (select join_status, count(*) as n from t group by 1), k as (select distinct session_id, case when call_id is not null then c_seq else q_seq end as seq from t where join_status = 'ok') select join_status, n from u union all select 'unknown', count(*) from v where not exists (select 1 from k where k.session_id = v.session_id and k.seq = v.seq)")
def label_join(elog):
    calls = elog.where("kind = 'call'")
    v = calls.select("session_id", "call_id", "seq", F.concat(F.lit("sha"), F.col("session_id") % 7).alias("ir_sha"), F.when(F.col("event_id") % 3 == 0, "contradicted").otherwise("supported").alias("verdict"))
    e = F.col("event_id")
    labels = calls.where("event_id % 4 < 2").select(e.alias("label_id"), (F.col("session_id") + F.when(e % 19 == 0, 100000).otherwise(0)).alias("session_id"), F.when(e % 2 == 0, F.col("call_id") + F.when(e % 10 == 0, 50).otherwise(0)).alias("call_id"), "seq", F.lit("pos").alias("label"), F.concat(F.lit("sha"), (F.col("session_id") + F.when(e % 5 == 0, 1).otherwise(0)) % 7).alias("ir_sha"))
    return scoring.join_labels(v, labels).groupBy("join_status").agg(F.count("*").alias("n"))
