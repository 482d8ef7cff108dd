"""Views over star-schema and stream tables that play the part of session logs.

Each view is one select in the common subset of Spark SQL and DuckDB; the few spellings
that differ are filled in per engine, so a query and its oracle see the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The key in an event's properties, per engine.
_KEY = {"spark": "cast(get_json_object(props, '$.k') as bigint)", "duckdb": "cast(json_extract_string(props, '$.k') as bigint)"}

#: Sessions are users, events their turns: clicks call, purchases and errors answer.
ELOG = """
select user_id as session_id,
       cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as seq,
       case event_type when 'click' then 'call' when 'purchase' then 'result' when 'error' then 'result'
                       when 'view' then 'assistant' else 'user' end as kind,
       {k} % 10 as call_id,
       case when event_type in ('click', 'purchase', 'error') then
            case ({k} % 10) % 3 when 0 then 'shell' when 1 then 'read' else 'edit' end end as tool,
       event_type = 'error' as is_error,
       case when event_id % 5 = 0 then concat('agent-', cast(event_id % 3 as string)) else 'main' end as stream,
       {us_ts} as ts_us,
       {us_ts} + (event_id * 7919) % 5000000 - 2500000 as emb_us,
       {k} as k, event_id, value
from {events}
"""

#: Orders call, line items answer on the order key.
OLLOG = """
select o_orderkey as call_id, o_custkey as session_id, o_orderpriority as tool, o_totalprice as price,
       {us_o} as call_us, l_linenumber, {us_l} as result_us, l_quantity as quantity, l_extendedprice as extended,
       l_returnflag = 'R' as is_error, l_partkey, l_suppkey
from {orders} join {lineitem} on o_orderkey = l_orderkey
"""

#: Conversations as turn logs.
CLOG = """
select conv_id as session_id, turn, role, text,
       cast(row_number() over (partition by conv_id order by turn, role, text) as bigint) as pos
from {conversations}
"""

#: Documents with their labels.
DOCS = """
select d.doc_id, coalesce(d.text, '') as text, d.lang, d.source, l.quality, l.toxic
from {documents} d left join {labels} l on d.doc_id = l.doc_id
"""

#: The events as a turn log of the checked harness, with a few faults of each kind.
TLOG = """
select cast(session_id as string) as key, seq as pos,
       case when event_id % 101 = 0 then 'other' else cast(session_id as string) end as session_id,
       seq + 1 + case when event_id % 97 = 0 then 1 else 0 end as turn_number,
       cast(session_id as string) || ':' || cast(seq + 1 + case when event_id % 103 = 0 then 7 else 0 end as string) as turn_id,
       case kind when 'call' then 'tool_use' when 'result' then 'tool_result' when 'assistant' then 'assistant' else 'user' end as role,
       case when kind in ('call', 'result') then cast(call_id as string) end as tool_call_id,
       case when event_id % 71 = 0 and kind = 'result' then 'other_tool' else tool end as tool_name,
       cast(cast(floor((ts_us - case when event_id % 83 = 0 then 3600000000 else 0 end) / 1000) as bigint) as string) as timestamp,
       'u' || cast(event_id as string) as uuid,
       case when event_id % 89 = 0 then 'u-1' else 'u' || cast(lag(event_id) over (partition by session_id order by seq) as string) end as parent_uuid,
       'swarm' as source
from {elog}
"""

#: The events with the provider columns of the event table: three events share a response, two a message.
RLOG = """
select cast(session_id as string) as session_id, seq, kind, cast(call_id as string) as call_id,
       'req' || cast(session_id as string) || '-' || cast(cast(floor(seq / 3) as bigint) as string) as request_id,
       'msg' || cast(session_id as string) || '-' || cast(cast(floor(seq / 2) as bigint) as string) as api_msg_id,
       case when event_id % 7 <> 0 then cast(floor(value * 10) as bigint) end as usage_in,
       case when event_id % 5 <> 0 then cast(floor(value * 3) as bigint) end as usage_out,
       cast(event_id % 11 as bigint) as usage_cache_read,
       case when event_id % 3 = 0 then cast(event_id % 13 as bigint) end as usage_cache_create
from {elog}
"""

#: Four checks of every call, by arithmetic on its event.
CHECKS = """
select cast(session_id as string) || ':' || cast(seq as string) as call_key, c.check_name as check_name, c.kind,
       case when (event_id * c.m + c.a) % 11 = 0 then 'contradicted' when (event_id * c.m + c.a) % 3 = 0 then 'supported' else 'unconstrained' end as verdict,
       c.strength, cast((event_id * c.m) % 100 as double) / 100 as confidence, (event_id + c.a) % 2 = 0 as localized,
       case when (event_id * c.m + c.a) % 11 = 0 then 'violation:' || c.check_name when (event_id * c.m + c.a) % 3 = 0 then 'ok:' || c.check_name
            else case when (event_id + c.a) % 4 = 0 then 'abstain:a' else 'abstain:b' end end as reason,
       seq as cited_seq
from {elog} e cross join (values ('alpha', 'identity', 'identity', 7, 1), ('beta', 'statistical', 'statistical', 5, 2), ('gamma', 'identity', 'strong', 3, 4), ('ref', 'reference', 'weak', 2, 0)) as c(check_name, kind, strength, m, a)
where e.kind = 'call'
"""

#: The events as writes and reads of five files; every thirteenth event's read shows another text.
WLOG = """
with f as (select session_id, seq, event_id, k, kind in ('call', 'user') as writes, '/workspace/f' || cast(k % 5 as string) || '.txt' as path from {elog} where k is not null),
g as (select *, max(case when writes then seq * 1000 + k end) over (partition by session_id, path order by seq rows between unbounded preceding and 1 preceding) as last_write,
             lag(writes) over (partition by session_id, path order by seq) as after_write, row_number() over (partition by session_id, path order by seq) as nth from f)
select session_id, seq, event_id, writes, path, after_write, 'v' || cast(k as string) as text, nth,
       'v' || cast(coalesce(last_write % 1000, 0) + case when event_id % 13 = 0 then 1000 else 0 end as string) as shown
from g
"""

#: Conversations with the usages of their turns.
ULOG = """
select cast(session_id as string) as key, pos, role, case when role = 'user' then 'user' else role end as turn_type, text as content,
       case when role = 'assistant' then cast(sum(length(text)) over (partition by session_id order by pos rows between unbounded preceding and 1 preceding) as bigint) end as input_tokens,
       case when role = 'assistant' then cast(length(text) as bigint) end as output_tokens
from {clog}
"""

VIEWS = {"wlog": WLOG, "ulog": ULOG, "checks": CHECKS, "tlog": TLOG, "rlog": RLOG, "elog": ELOG, "ollog": OLLOG, "clog": CLOG, "docs": DOCS}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _spelled(sql: str, engine: str) -> str:
    us = (lambda c: f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})") if engine == "spark" else (lambda c: f"epoch_us({c})")
    return sql.replace("{k}", _KEY[engine]).replace("{us_ts}", us("ts")).replace("{us_o}", us("o_orderdate")).replace("{us_l}", us("l_shipdate"))


def _named(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a view over tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return run(spark, sf_dir, VIEWS[name])


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Spark SQL over views and tables named in braces."""
    sql = _spelled(sql, "spark")
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in _named(sql)})


def duck(sql: str) -> str:
    """The same text for DuckDB, with the views as common table expressions."""
    sql = _spelled(sql, "duckdb")
    used = [n for n in _named(sql) if n in VIEWS]
    for n in _named(sql):
        sql = sql.replace("{" + n + "}", n)
    heads = [f"{n} as ({duck(VIEWS[n])})" for n in used]
    if not heads:
        return sql
    body = sql.strip()
    return f"with {', '.join(heads)}, {body[5:]}" if body.lower().startswith("with ") else f"with {', '.join(heads)} {body}"
