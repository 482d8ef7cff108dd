"""Statistics per key, ordered functions, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring, stats
from .registry import Registry

R = Registry()

_ERRORS = "select tool, count(*) as n, count(case when is_error then 1 end) as k from {elog} where kind = 'result' group by tool"


@R.query("wilson_by_tool", f"with t as ({_ERRORS}), p as (select tool, n, k, cast(k as double) / n as p, 1 + 1.96 * 1.96 / n as d from t) select tool, n, k, round(p, 9) as p, round(greatest(0.0, (p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / d), 9) as lo, round(least(1.0, (p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / d), 9) as hi from p")
def wilson_by_tool(elog):
    t = elog.where("kind = 'result'").groupBy("tool").agg(F.count("*").alias("n"), F.count_if("is_error").alias("k"))
    p, lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return t.select("tool", "n", "k", F.round(p, 9).alias("p"), F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


_Q = "select tool, count(x) as n, min(x) as min, {p01} as p1, {p05} as p5, {p25} as p25, {p50} as p50, {p75} as p75, {p95} as p95, {p99} as p99, max(x) as max, round(avg(x), 6) as mean from (select tool, (result_us - call_us) / 86400000000.0 as x from {ollog}) t group by tool"
for _k, _v in (("01", 0.01), ("05", 0.05), ("25", 0.25), ("50", 0.5), ("75", 0.75), ("95", 0.95), ("99", 0.99)):
    _Q = _Q.replace("{p" + _k + "}", f"quantile_cont(x, {_v})")


@R.query("describe_latency", _Q, ("ollog",))
def describe_latency(ollog):
    return stats.describe(ollog.withColumn("x", (F.col("result_us") - F.col("call_us")) / 86400000000.0), ["tool"], "x").withColumn("mean", F.round("mean", 6))


@R.query("log_histogram", "select case when x > 0 then cast(floor(log10(x) * 4) as bigint) end as bin, count(*) as n from (select result_us - call_us as x from {ollog}) t group by 1", ("ollog",))
def log_histogram(ollog):
    return stats.log_histogram(ollog.withColumn("x", F.col("result_us") - F.col("call_us")), "x").select("bin", "n")


_RANK = "rank() over (partition by tool order by {v}) + (count(*) over (partition by tool, {v}) - 1) / 2.0"


@R.query("auc_error", f"with r as (select tool, is_error, {_RANK.replace('{v}', 'value')} as rk from {{elog}} where kind = 'result') select tool, round((sum(case when is_error then rk else 0 end) - count(case when is_error then 1 end) * (count(case when is_error then 1 end) + 1) / 2.0) / (count(case when is_error then 1 end) * count(case when not is_error then 1 end)), 9) as auc, count(case when is_error then 1 end) as positives, count(case when not is_error then 1 end) as negatives from r group by tool")
def auc_error(elog):
    got = stats.auc(elog.where("kind = 'result'"), ["tool"], "value", F.col("is_error"))
    return got.withColumn("auc", F.round("auc", 9))


@R.query("spearman_latency", "with o as (select tool, quantity, result_us - call_us as lat from {ollog}), r as (select tool, " + _RANK.replace("{v}", "quantity") + " as a, " + _RANK.replace("{v}", "lat") + " as b from o) select tool, round(corr(a, b), 6) as rho, count(*) as n from r group by tool", ("ollog",))
def spearman_latency(ollog):
    return stats.spearman(ollog.withColumn("lat", F.col("result_us") - F.col("call_us")), ["tool"], "quantity", "lat").withColumn("rho", F.round("rho", 6))


@R.query("entropy_by_tool", "with c as (select tool, k, count(*) as n from {elog} where tool is not null group by 1, 2), t as (select tool, sum(n) as total from c group by 1) select c.tool, round(-sum(n / total * log2(n / total)), 6) as bits, count(*) as classes, cast(max(total) as bigint) as total from c join t on c.tool = t.tool group by 1")
def entropy_by_tool(elog):
    c = elog.where("tool is not null").groupBy("tool", "k").agg(F.count("*").alias("n"))
    return stats.entropy(c, ["tool"], "n").withColumn("bits", F.round("bits", 6))


@R.query("divergence_of_halves", "with h as (select k, count(case when event_id % 2 = 0 then 1 end) as a, count(case when event_id % 2 = 1 then 1 end) as b from {elog} group by k), s as (select a / sum(a) over () as p, b / sum(b) over () as q from h) select round(sqrt(sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2), 6) as js, round(sum(abs(p - q)) / 2, 6) as tv from s")
def divergence_of_halves(elog):
    half = lambda m: elog.where(f"event_id % 2 = {m}").groupBy("k").agg(F.count("*").alias("n"))
    got = stats.divergence(half(0), half(1), "k", "n")
    return got.select(F.round("js", 6).alias("js"), F.round("tv", 6).alias("tv"))


@R.query("chi2_digits", "with c as (select tool, k % 10 as d, count(*) as n from {elog} where tool is not null group by 1, 2) select tool, round(cast(sum(n * n) as double) * count(*) / sum(n) - sum(n), 6) as stat, count(*) - 1 as df, cast(sum(n) as bigint) as total from c group by tool")
def chi2_digits(elog):
    c = elog.where("tool is not null").groupBy("tool", (F.col("k") % 10).alias("d")).agg(F.count("*").alias("n"))
    return stats.chi2_uniform(c, ["tool"], "n").select("tool", F.round("stat", 6).alias("stat"), "df", "total")


@R.query("robust_outliers", "with m as (select tool, quantile_cont(value, 0.5) as m from {elog} where tool is not null group by 1), d as (select e.tool, event_id, value, m, abs(value - m) as d from {elog} e join m on e.tool = m.tool), s as (select tool, quantile_cont(d, 0.5) as mad from d group by 1) select event_id, d.tool, round((value - m) / (1.4826 * mad), 6) as z from d join s on d.tool = s.tool where abs((value - m) / (1.4826 * mad)) > 3.5")
def robust_outliers(elog):
    z = stats.robust_z(elog.where("tool is not null").select("event_id", "tool", "value"), ["tool"], "value")
    return z.where("abs(z) > 3.5").select("event_id", "tool", F.round("z", 6).alias("z"))


@R.query("split_gain", "with r as (select session_id, row_number() over w as i, sum(value) over (partition by session_id order by seq rows between unbounded preceding and current row) as s, count(*) over (partition by session_id) as n, sum(value) over (partition by session_id) as t from {elog} window w as (partition by session_id order by seq)), g as (select session_id, i, s * s / i + (t - s) * (t - s) / (n - i) - t * t / n as gain from r where i < n) select session_id, round(max(gain), 4) as gain from g group by 1")
def split_gain(elog):
    return stats.split_gain(elog, ["session_id"], ["seq"], "value").select("session_id", F.round("gain", 4).alias("gain"))


@R.query("cluster_sums", "select session_id, cast(count(case when is_error then 1 end) as double) as num, cast(count(*) as double) as den from {elog} where kind = 'result' group by 1")
def cluster_sums(elog):
    return stats.cluster_sums(elog.where("kind = 'result'"), "session_id", F.col("is_error").cast("int"), F.lit(1))


@R.query("change_points")
def change_points(elog):
    few = elog.where("kind = 'result'").select("session_id", "seq", "value")
    return stats.change_point(few, "session_id", "seq", "value")


_CELLS = "with q as (select session_id, count(*) as len, max(case when tool is null then 'none' else tool end) as stratum from {elog} group by 1), r as (select *, row_number() over (order by len, session_id) / cast(count(*) over () as double) as q from q), t as (select *, case when q <= 1.0 / 3 then 'short' when q <= 2.0 / 3 then 'mid' else 'long' end as tercile from r)"


@R.query("length_terciles", _CELLS + " select tercile, stratum, count(*) as n, min(len) as lo, max(len) as hi from t group by 1, 2")
def length_terciles(elog):
    q = elog.groupBy("session_id").agg(F.count("*").alias("len"), F.max(F.coalesce("tool", F.lit("none"))).alias("stratum"))
    return scoring.terciles(q, "len", "session_id").groupBy("tercile", "stratum").agg(F.count("*").alias("n"), F.min("len").alias("lo"), F.max("len").alias("hi"))


_ALLOC = """
with s as (select o_orderpriority || '|' || o_orderstatus as cell, count(*) as n from {orders} group by 1),
b as (select cell, n, least(n, 5) as base from s), l as (select *, greatest(0, 400 - sum(base) over ()) as lft, n - base as room from b),
w as (select *, lft * room / cast(sum(room) over () as double) as raw from l),
g as (select *, base + least(room, cast(floor(raw) as bigint)) as got from w),
m as (select *, 400 - sum(got) over () as rem, sum(case when got < n then 1 else 0 end) over (order by raw - floor(raw) desc, cell rows between unbounded preceding and current row) as able from g)
select cell, n, cast(got + case when lft > 0 and got < n and able <= rem then 1 else 0 end as bigint) as alloc from m"""


@R.query("allocation", _ALLOC, ("orders",))
def allocation(orders):
    sizes = orders.groupBy(F.concat_ws("|", "o_orderpriority", "o_orderstatus").alias("cell")).agg(F.count("*").alias("n"))
    return scoring.allocate(sizes, 400)


@R.query("stratified_draw", _ALLOC.replace("select cell, n, cast(", "select cell, cast(", 1).replace("\nwith s as", "with a as (with s as", 1) + """),
r as (select o_orderkey, o_orderpriority || '|' || o_orderstatus as cell, row_number() over (partition by o_orderpriority || '|' || o_orderstatus order by md5('20261003:' || cast(o_orderkey as string)), o_orderkey) as i from {orders})
select o_orderkey, r.cell from r join a on a.cell = r.cell where i <= alloc""", ("orders",))
def stratified_draw(orders):
    rows = orders.select("o_orderkey", F.concat_ws("|", "o_orderpriority", "o_orderstatus").alias("cell"))
    return scoring.draw(rows, scoring.allocate(rows.groupBy("cell").agg(F.count("*").alias("n")), 400), "o_orderkey")


@R.query("ordered_sha", "select session_id, sha256(string_agg(coalesce(cast(seq as string), chr(0)) || chr(31) || coalesce(kind, chr(0)) || chr(31) || coalesce(cast(call_id as string), chr(0)), chr(30) order by seq)) as sha from {elog} group by 1")
def ordered_sha(elog):
    return scoring.ordered_sha(elog, "session_id", "seq", ["seq", "kind", "call_id"])


@R.query("hill_tail", "with r as (select tool, ln(value) as x, row_number() over (partition by tool order by value desc) as rn from {elog} where tool is not null and value > 0) select tool, round(50.0 / (sum(case when rn <= 50 then x end) - 50 * max(case when rn = 51 then x end)), 6) as alpha from r where rn <= 51 group by 1")
def hill_tail(elog):
    return stats.hill(elog.where("tool is not null"), ["tool"], "value", 50).select("tool", F.round("alpha", 6).alias("alpha"))


@R.query("partial_correlation", "with c as (select tool, corr(quantity, extended) as xy, corr(quantity, price) as xz, corr(extended, price) as yz from {ollog} group by 1) select tool, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) as r from c", ("ollog",))
def partial_correlation(ollog):
    return stats.partial_correlation(ollog, ["tool"], "quantity", "extended", "price").select("tool", F.round("r", 6).alias("r"))


@R.query("step_size", "select tool, cast(case when avg(case when quantity % 10 = 0 then 1.0 else 0 end) >= 0.99 then 10 when avg(case when quantity % 5 = 0 then 1.0 else 0 end) >= 0.99 then 5 else 1 end as double) as step from {ollog} where quantity > 0 group by 1", ("ollog",))
def step_size(ollog):
    return stats.step_size(ollog, ["tool"], "quantity")


@R.query("cell_labels", "with c as (select tool, count(case when stream <> 'main' then 1 end) as n, count(case when stream <> 'main' and is_error then 1 end) as k, count(case when stream = 'main' then 1 end) as n_honest, count(case when stream = 'main' and k % 97 = 0 then 1 end) as k_honest from {elog} where kind = 'result' group by 1), p as (select *, (k / cast(n as double) + 1.96 * 1.96 / (2.0 * n) - 1.96 * sqrt(k / cast(n as double) * (1 - k / cast(n as double)) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n) as lo, (k_honest / cast(n_honest as double) + 1.96 * 1.96 / (2.0 * n_honest) + 1.96 * sqrt(k_honest / cast(n_honest as double) * (1 - k_honest / cast(n_honest as double)) / n_honest + 1.96 * 1.96 / (4.0 * n_honest * n_honest))) / (1 + 1.96 * 1.96 / n_honest) as hi from c) select tool, case when n < 20 then 'INSUFFICIENT_N' when lo > hi and k >= 0.5 * n then 'DETECTS' when lo > hi then 'PARTIAL' else 'BLIND' end as label from p")
def cell_labels(elog):
    sub = F.col("stream") != "main"
    c = elog.where("kind = 'result'").groupBy("tool").agg(F.count_if(sub).alias("n"), F.count_if(sub & F.col("is_error")).alias("k_"), F.count_if(~sub).alias("n_honest"), F.count_if(~sub & (F.col("k") % 97 == 0)).alias("k_honest"))
    return stats.cell_labels(c.withColumnRenamed("k_", "k")).select("tool", "label")


@R.query("clopper_pearson", None)
def clopper_pearson(elog):
    return stats.clopper_pearson(elog.where("kind = 'result'").groupBy("tool").agg(F.count_if("is_error").alias("k"), F.count("*").alias("n")), "k", "n")


@R.query("segments", None)
def segments(elog):
    return stats.segments(elog, "session_id", "seq", "value").select("session_id", F.size("cuts").alias("cuts"))


@R.query("histogram_modes", """
with c as (select tool, cast(floor(value / 10) as bigint) as b, count(*) as n from {elog} where tool is not null and value is not null group by 1, 2),
g as (select tool, unnest(range(min(b) - 1, max(b) + 2)) as b from c group by tool),
z as (select g.tool, g.b, coalesce(n, 0) as n from g left join c on c.tool = g.tool and c.b = g.b),
s as (select *, (coalesce(lag(n) over w, 0) + n + coalesce(lead(n) over w, 0)) / 3.0 as s from z window w as (partition by tool order by b)),
p as (select *, coalesce(lag(s) over w, 0) as a, coalesce(lead(s) over w, 0) as d, max(s) over (partition by tool) as top from s window w as (partition by tool order by b))
select tool, count(case when s > a and s >= d and s >= 0.05 * top then 1 end) as modes from p group by 1""")
def histogram_modes(elog):
    return stats.modes(elog.where("tool is not null"), ["tool"], "value", 10.0)


@R.query("value_spikes", """
with e as (select tool, cast(floor(value / 20) as bigint) as k from {elog} where tool is not null and value is not null), n as (select tool, k, count(*) as n from e group by 1, 2), u as (select tool, sum(n) / cast(count(*) as double) as usual from n group by 1)
select n.tool, k, n, round(usual, 6) as usual from n join u on u.tool = n.tool where n >= 3 and n >= 1.2 * usual""")
def value_spikes(elog):
    rows = elog.where("tool is not null").select("tool", F.floor(F.col("value") / 20).alias("k"))
    return stats.spikes(rows, ["tool"], "k", 3, 1.2).withColumn("usual", F.round("usual", 6))


@R.query("within_session_correlation", """
with r as (select session_id, rank() over (partition by session_id order by value) + (count(*) over (partition by session_id, value) - 1) / 2.0 as a, rank() over (partition by session_id order by k) + (count(*) over (partition by session_id, k) - 1) / 2.0 as b
           from {elog} where value is not null and k is not null),
c as (select session_id, corr(a, b) as rho, count(*) as n from r group by 1 having count(*) >= 5)
select count(rho) as groups, round(sum(rho * n) / sum(case when rho is not null then n end), 6) as rho from c where not isnan(rho)""")
def within_session_correlation(elog):
    return stats.within_correlation(elog.where("value is not null and k is not null"), ["session_id"], "value", "k").withColumn("rho", F.round("rho", 6))
