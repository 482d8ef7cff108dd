"""The queries that apply each operator to its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, media, mixing, packing, quality, simhash, tokens, topk, toxicity, urls
from .common import crc_fold, table, written


def _scored(docs: DataFrame, score, folds: int, kept_out: int, threshold: float) -> DataFrame:
    held = (crc_fold(F.col("doc_id"), folds) == kept_out).alias("held_out")
    return docs.select("doc_id", held, score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_tables(docs, table(spark, sf_dir, "labels"))
    return _scored(docs, toxicity.score(model, F.col("text"), spark), 4, 2, toxicity.THRESHOLD)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.conversation_calls(table(spark, sf_dir, "conversations"))
    got = chat.link(calls, results)
    return got.select(F.col("conv").alias("conv_id"), "call_id", "position", "status", "valid", F.array_join("errors", ",").alias("errors"), "json")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_tables(docs, table(spark, sf_dir, "labels"))
    return _scored(docs, quality.score(model, F.col("text"), spark), 5, 0, quality.THRESHOLD)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").alias("id"), topk.floored(F.col("embedding")).alias("vec"))
    vectors = written(vectors, "vectors")
    return topk.top_k(vectors.where("id % 20 = 0"), vectors)


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    text = F.col("text")
    counted = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), tokens.token_count(spark, text, public_tokenizers.path("word_bpe_49k.json")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 0).alias("bad"))
    return urls.judge(table(spark, sf_dir, "pages"), outcomes).withColumnRenamed("id", "page_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex64(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_media": op2_media,
        "op3_mixing": op3_mixing,
        "op4_chat": op4_chat,
        "op5_quality": op5_quality,
        "op6_topk": op6_topk,
        "op7_tokens": op7_tokens,
        "op8_urls": op8_urls,
        "op9_packing": op9_packing,
        "op10_simhash": op10_simhash,
    }


_OP4 = """
with t as (select conv_id, turn, role, coalesce(text, '') as text, text as raw from conversations),
u as (select *, 'call-' || conv_id || '-' || turn as call_id from t where role = 'user'),
r as (select conv_id, turn - 1 as turn, raw from t where role = 'assistant'),
j as (select u.*, r.raw as answer, r.turn is not null as answered from u left join r on u.conv_id = r.conv_id and u.turn = r.turn)
select conv_id, call_id, cast(row_number() over (partition by conv_id order by turn, call_id) as int) as position,
       case when answered then 'linked' else 'missing' end as status, text <> '' and turn >= 0 as valid,
       concat_ws(',', case when text = '' then 'query:min_length' end, case when turn < 0 then 'turn:min' end) as errors,
       '{"arguments":{"query":' || cast(to_json(text) as varchar) || ',"turn":' || turn || ',"words":' || len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) || '},"id":"' || call_id || '","name":"ask","result":' || coalesce(cast(to_json(answer) as varchar), 'null') || '}' as json
from j"""

_OP6 = """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as e from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id, cast(coalesce(list_dot_product(q.e, c.e), 0) as bigint) as score
      from v q join v c on q.r <> c.r and len(q.e) = len(c.e) where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by r order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 20"""


def _strength(groups: str, mean: str) -> str:
    low, high = urls.STRENGTH
    moments = f"select count(*) as k, sum(n) as t, sum(n * n) as q, sum(n * power(bad / n - {mean}, 2) / ({mean} * (1 - {mean}))) as s from {groups} where n > 0"
    rho = f"select t, case when t - q / t - (k - 1) > 0 then (s - (k - 1)) / (t - q / t - (k - 1)) else 0 end as rho from ({moments}) x"
    return f"(select case when t is null or rho <= 0 then {high} else least(greatest(1 / rho - 1, {low}), {high}) end from ({rho}) y)"


#: Simpson's double steps on each side of even odds.
_SIMPSON = 2000


def _op8() -> str:
    ranked = sorted(urls.RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    fits = [f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for _, h, p in ranked]
    rule = "case " + " ".join(f"when {f} then '{h + p}'" for f, (_, h, p) in zip(fits, ranked)) + " end"
    verdict = "case " + " ".join(f"when {f} then '{v}'" for f, (v, _, _) in zip(fits, ranked)) + " end"
    two = "array_to_string(list_slice(l, greatest(1, len(l) - 1), len(l)), '.')"
    three = "array_to_string(list_slice(l, greatest(1, len(l) - 2), len(l)), '.')"
    long = f"{two} in ({', '.join(repr(x) for x in urls.SUFFIXES)})"
    return f"""
with a as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
b as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from a),
p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from b),
k as (select doc_id, max(case when quality = 0 then 1 else 0 end) as bad from labels where quality is not null group by 1),
h0 as (select host, count(bad) as n, coalesce(sum(bad), 0) as bad from p left join k on page_id = doc_id group by 1),
h1 as (select *, string_split(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '.') as l from h0),
h as (select host, n, bad, case when {long} then {three} else {two} end as domain, case when {long} then {two} else l[len(l)] end as suffix from h1),
o as (select (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2.0) as rate from h),
s as (select suffix, sum(n) as n, sum(bad) as bad from h group by 1),
sm as (select {_strength("s", "(select rate from o)")} as m),
s2 as (select suffix, ((select rate from o) * m + bad) / (m + n) as above from s, sm),
d as (select h.suffix, domain, sum(n) as n, sum(bad) as bad, max(above) as above from h join s2 on h.suffix = s2.suffix group by 1, 2),
dm as (select {_strength("d", "above")} as m),
d2 as (select domain, (above * m + bad) / (m + n) as prior from d, dm),
g as (select host, n, bad, prior from h join d2 on h.domain = d2.domain),
gm as (select {_strength("g", "prior")} as m),
e as (select host, prior * m + bad as a, (1 - prior) * m + n - bad as b from g, gm),
-- the posterior's tail by Simpson's rule over the log odds, which gives smooth integrands for any a and b
w as (select *, -40 / a as lo, 40 / b as hi, 0.0 as x, greatest(1e-9, ln(a / b)) as mode_r, least(-1e-9, ln(a / b)) as mode_l from e),
i as (select host, u.side, case u.side when 0 then lo + least(0, ln(a / b)) else 0.0 end as x0, case u.side when 0 then 0.0 else hi + greatest(0, ln(a / b)) end as x1, a, b from w cross join (values (0), (1)) as u(side)),
q as (select host, side, x0 + (x1 - x0) * k / {2 * _SIMPSON} as x, case when k in (0, {2 * _SIMPSON}) then 1 when k % 2 = 1 then 4 else 2 end * (x1 - x0) as c, a, b, a * ln(a / (a + b)) + b * ln(b / (a + b)) as top
      from i cross join (select unnest(range(0, {2 * _SIMPSON} + 1)) as k) n),
z as (select host, sum(case when side = 0 then c * exp(a * x - (a + b) * ln(1 + exp(x)) - top) else 0 end) as below, sum(c * exp(a * x - (a + b) * ln(1 + exp(least(x, 700))) - top)) as whole from q group by 1),
f as (select host, below / whole <= {1 - urls.SURE} as blocked from z)
select page_id, p.host, path, {rule.replace("host", "p.host")} as rule, coalesce({verdict.replace("host", "p.host")}, case when blocked then 'block' else 'allow' end) as verdict
from p left join f on p.host = f.host"""


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": _OP4, "op6_topk": _OP6, "op8_urls": _op8()}
