"""Text kernels over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text
from .registry import Registry

R = Registry()

_MASKED = "coalesce(text, '')"
for _p in text.VOLATILE:
    _MASKED = "regexp_replace({}, '{}', '<V>', 'g')".format(_MASKED, _p.replace("'", "''"))


@R.query("mask_volatile", f"select doc_id, sha256({_MASKED}) as sha from {{documents}}", ("documents",))
def mask_volatile(documents):
    return documents.select("doc_id", F.sha2(text.mask_volatile(F.col("text")), 256).alias("sha"))


@R.query("text_counts", None, ("documents",))
def text_counts(documents):
    return documents.select("doc_id", text.text_counts(F.col("text")).alias("c")).select("doc_id", "c.*")


@R.query("text_shape", "select doc_id, length(text) as chars, strlen(text) as bytes, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) as nonascii, length(text) - length(replace(text, chr(10), '')) as newlines, length(regexp_replace(text, '[^0-9]', '', 'g')) as digits from {docs}", ("docs",))
def text_shape(docs):
    t = F.col("text")
    return docs.select("doc_id", F.length(t).alias("chars"), F.octet_length(t).alias("bytes"), F.length(F.regexp_replace(t, r"[\x00-\x7F]", "")).alias("nonascii"), (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).alias("newlines"), F.length(F.regexp_replace(t, "[^0-9]", "")).alias("digits"))


@R.query("hashes", "select doc_id, sha256(text) as sha256, md5(text) as md5, sha1(text) as sha1 from {docs}", ("docs",))
def hashes(docs):
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), F.sha1("text").alias("sha1"))


@R.query("session_split", "select doc_id, case when strpos('02468ace', substr(sha256(cast(doc_id as string)), 64, 1)) > 0 then 'dev' else 'test' end as split from {docs}", ("docs",))
def session_split(docs):
    return docs.select("doc_id", text.split_of(F.col("doc_id")).alias("split"))


@R.query("line_cap", "select doc_id, len(string_split(text, chr(10))) as lines, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) as longest from {docs}", ("docs",))
def line_cap(docs):
    lines = F.split("text", "\n", -1)
    return docs.select("doc_id", F.size(lines).alias("lines"), F.array_max(F.transform(lines, F.length)).alias("longest"))


_LINES = "select doc_id, unnest(string_split(text, chr(10))) as line from {docs}"


@R.query("line_containment", f"with d as (select distinct doc_id, md5(line) as h from ({_LINES}) t where length(line) >= 20), b as (select item_id, md5(line) as h from (select item_id, unnest(string_split(text, chr(10))) as line from {{benchmark}}) t where length(line) >= 20) select b.item_id, count(distinct d.doc_id) as docs, count(distinct b.h) as lines from b join d on b.h = d.h group by 1", ("docs", "benchmark"))
def line_containment(docs, benchmark):
    lines = lambda df, key: df.select(key, F.explode(F.split("text", "\n", -1)).alias("line")).where("length(line) >= 20").select(key, F.md5("line").alias("h")).distinct()
    return lines(benchmark, "item_id").join(lines(docs, "doc_id"), "h").groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("h").alias("lines"))


@R.query("repeated_lines", f"select md5(line) as h, count(*) as n, count(distinct doc_id) as docs from ({_LINES}) t where length(line) >= 20 group by 1 having count(distinct doc_id) > 1", ("docs",))
def repeated_lines(docs):
    lines = docs.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).where("length(line) >= 20")
    return lines.groupBy(F.md5("line").alias("h")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).where("docs > 1")


@R.query("literal_grep", "select doc_id, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'the'))) as n, len(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'the'))) as n_i from {docs}", ("docs",))
def literal_grep(docs):
    lines = F.split("text", "\n", -1)
    return docs.select("doc_id", F.size(F.filter(lines, lambda x: x.contains("the"))).alias("n"), F.size(F.filter(lines, lambda x: F.lower(x).contains("the"))).alias("n_i"))


@R.query("hex_tokens", "select doc_id, list_sort(list_filter(list_transform(regexp_extract_all(text, '\\b[0-9a-fA-F]{7,64}\\b'), lambda h: lower(h)), lambda h: regexp_matches(h, '[0-9]') and regexp_matches(h, '[a-f]') and length(h) in (7, 8, 10, 12, 16, 20, 24, 32, 40, 56, 64))) as tokens from {docs} where regexp_matches(text, '[0-9][a-f]|[a-f][0-9]')", ("docs",))
def hex_tokens(docs):
    return docs.where(F.col("text").rlike("[0-9][a-f]|[a-f][0-9]")).select("doc_id", F.array_sort(text.hex_tokens(F.col("text"))).alias("tokens"))


@R.query("digest_defects", """
with m as (select doc_id, regexp_replace(text, '\\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\\b', ' ', 'g') as t from {docs}),
f as (select doc_id, lower(unnest(regexp_extract_all(t, '\\b[0-9a-fA-F]{7,64}\\b'))) as h from m),
k as (select doc_id, h, row_number() over () as id from f where length(h) between 20 and 64 and regexp_matches(h, '[0-9]') and regexp_matches(h, '[a-f]')),
d as (select id, i, (strpos('0123456789abcdef', substr(h, i + 2, 1)) - strpos('0123456789abcdef', substr(h, i, 1)) + 16) % 16 = 1 as up from (select id, h, unnest(range(1, length(h) - 1)) as i from k) x),
g as (select id, up, i - row_number() over (partition by id, up order by i) as grp from d), r as (select id, max(n) as run from (select id, grp, count(*) as n from g where up group by 1, 2) y group by 1)
select doc_id, h, case when length(h) not in (32, 40, 56, 64) then 'hex_length_' || length(h) when coalesce(run, 0) >= 12 then 'ascending_nibble_template' end as defect from k left join r on r.id = k.id""", ("docs",))
def digest_defects(docs):
    found = docs.select("doc_id", F.explode(text.hex_tokens(F.col("text"), tuple(range(20, 65)))).alias("h"))
    return found.select("doc_id", "h", text.digest_defect(F.col("h")).alias("defect"))


@R.query("digest_support", """
with h as (select doc_id, sha256(text) as sha, lag(sha256(text)) over (order by doc_id) as other from {docs}),
c as (select *, substr(case when doc_id % 3 = 0 then coalesce(other, sha) else sha end, 1, cast(8 + doc_id % 20 as int)) || case when doc_id % 7 = 0 then 'g' else '' end as claimed from h)
select doc_id, starts_with(sha, claimed) or starts_with(claimed, sha) as supported from c""", ("docs",))
def digest_support(docs):
    from ..tables import running

    full = F.sha2("text", 256)
    # the document before in the order of ids, by its number
    numbered = running(docs.select("doc_id", full.alias("full")), [F.col("doc_id")])
    before = numbered.select((F.col("no") + 1).alias("no"), F.col("full").alias("other"))
    c = numbered.join(before, "no", "left")
    own = F.when(F.col("doc_id") % 3 == 0, F.coalesce("other", "full")).otherwise(F.col("full"))
    claimed = F.concat(F.substr(own, F.lit(1), (8 + F.col("doc_id") % 20).cast("int")), F.when(F.col("doc_id") % 7 == 0, "g").otherwise(""))
    return c.select("doc_id", text.digest_supported(claimed, F.array("full")).alias("supported"))


@R.query("url_paths", "select page_id, array_to_string(list_slice(list_filter(string_split(p, '/'), lambda x: x <> ''), -2, -1), '/') as key from (select page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/$', '') as p from {pages}) t", ("pages",))
def url_paths(pages):
    p = F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", text.path_key(p).alias("key"))


@R.query("clip", "select doc_id, md5(case when length(text) > 150 then substr(text, 1, 100) || '...[' || cast(length(text) - 150 as string) || ']...' || substr(text, length(text) - 49) else text end) as clipped from {docs}", ("docs",))
def clip(docs):
    return docs.select("doc_id", F.md5(text.clip(F.col("text"), 100, 50)).alias("clipped"))


@R.query("positional_entropy", "with c as (select unnest(range(1, 9)) as i, cast(doc_id as string) as s from {docs}), n as (select i - 1 as pos, substr(s, i, 1) as ch, count(*) as n from c where i <= length(s) group by 1, 2) select pos, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) as bits, count(*) as symbols from n group by 1", ("docs",))
def positional_entropy(docs):
    got = ids.positional_entropy(docs.select(F.col("doc_id").cast("string").alias("s")), "s")
    return got.select(F.col("pos").cast("long").alias("pos"), F.round("bits", 6).alias("bits"), "symbols")


@R.query("tools_folded", "select event_type, case event_type when 'view' then 'read' else event_type end as tool, count(*) as n from {events} group by 1", ("events",))
def tools_folded(events):
    return events.select("event_type", text.normalize_tool(F.col("event_type")).alias("tool")).groupBy("event_type", "tool").agg(F.count("*").alias("n"))


_CUT = " or ".join("regexp_matches(t, '{}')".format(p.replace("'", "''")) for p in text.TRUNCATION)


@R.query("error_marks", f"""
with t as (select doc_id, case when doc_id % 5 = 0 then 'Exit code 1' || chr(10) else '' end || text as t from {{docs}})
select doc_id, case when regexp_matches(t, '^Exit code [0-9]+') then 'cc_exit_code' when starts_with(t, '<tool_use_error>') then 'cc_tool_use_error'
                    when regexp_matches(t, '(?m)^Exit Code: 0*[1-9]') then 'gemini_exit_code_nonzero' when regexp_matches(t, '^exitcode: 0*[1-9]') then 'whowhen_exitcode_nonzero' end as mark,
       {_CUT} as truncated from t""", ("docs",))
def error_marks(docs):
    t = F.concat(F.when(F.col("doc_id") % 5 == 0, "Exit code 1\n").otherwise(""), F.col("text"))
    return docs.select("doc_id", text.error_marker(t).alias("mark"), text.truncated(t).alias("truncated"))


@R.query("large_integers", """
with n as (select doc_id, unnest(regexp_extract_all(text, '[0-9.]+')) as x from {docs}), v as (select doc_id, try_cast(x as bigint) as v from n where regexp_matches(x, '^[0-9]{5,15}$'))
select doc_id, v from v where v >= 10000 and not (v between 1500000000 and 2000000000) and not (v between 1500000000000 and 2000000000000)""", ("docs",))
def large_integers(docs):
    return docs.select("doc_id", F.explode(text.large_integers(F.col("text"))).alias("v"))


@R.query("commands", "select conv_id, turn, regexp_replace(trim(text), '\\s+', ' ', 'g') as command from {conversations} where text is not null and role = 'user'", ("conversations",))
def commands(conversations):
    c = F.concat(F.lit("cd /w && "), F.trim("text"), F.lit(" 2>&1"))
    return conversations.where("text is not null and role = 'user'").select("conv_id", "turn", text.normalize_command(c).alias("command"))


@R.query("text_lines", r"""
with t as (select doc_id, regexp_replace(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e' || chr(133) || chr(8232) || chr(8233) || ']', chr(10), 'g') as t from {docs})
select doc_id, case when t = '' then 0 else len(string_split(t, chr(10))) - case when ends_with(t, chr(10)) then 1 else 0 end end as lines,
       md5(case when ends_with(t, chr(10)) then substr(t, 1, length(t) - 1) else t end) as h from t""", ("docs",))
def text_lines(docs):
    lines = text.split_lines(F.col("text"))
    return docs.select("doc_id", F.size(lines).alias("lines"), F.md5(F.array_join(lines, "\n")).alias("h"))


@R.query("git_dates", """
with d as (select o_orderkey, o_orderdate as t, o_orderkey % 3 as f from {orders})
select o_orderkey, epoch_us(t) - 7200000000 as us from d""", ("orders",))
def git_dates(orders):
    t, f = F.col("o_orderdate"), F.col("o_orderkey") % 3
    spelled = F.when(f == 0, F.concat(F.lit("Mon "), F.date_format(t, "MMM d HH:mm:ss yyyy"))).when(f == 1, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).otherwise(F.concat(F.lit("Tue, "), F.date_format(t, "d MMM yyyy HH:mm:ss")))
    return orders.select("o_orderkey", F.unix_micros(text.git_date(F.concat(spelled, F.lit(" +0200")))).alias("us"))


@R.query("path_depths", """
with p as (select page_id, case page_id % 4 when 0 then '/w' when 1 then '/w/a/./b.txt' when 2 then '/other/c' else 'd//e/f.py' end as path from {pages})
select page_id, case page_id % 4 when 0 then 0 when 1 then 2 when 3 then 3 end as depth from p""", ("pages",))
def path_depths(pages):
    k = F.col("page_id") % 4
    path = F.when(k == 0, "/w").when(k == 1, "/w/a/./b.txt").when(k == 2, "/other/c").otherwise("d//e/f.py")
    return pages.select("page_id", text.path_depth(path, F.lit("/w/")).alias("depth"))


@R.query("id_alphabets", """
with i as (select doc_id, case doc_id % 5 when 0 then cast(doc_id as string) when 1 then md5(cast(doc_id as string)) when 2 then upper(md5(cast(doc_id as string))) when 3 then 'x_' || md5(cast(doc_id as string)) else repeat('ab', 6) end as v from {docs})
select doc_id, case when regexp_matches(v, '^[0-9]+$') then 'digits' when doc_id % 5 = 1 then 'hex' when doc_id % 5 = 2 then 'HEX' when doc_id % 5 = 3 then 'base64url' else 'hex' end as alphabet,
       len(list_distinct(string_split(v, ''))) < 3 or doc_id % 5 = 4 or (doc_id % 5 = 0 and length(v) >= 3 and length(v) % 3 = 0 and v = repeat(substr(v, 1, length(v) // 3), 3)) as degenerate from i where doc_id % 5 <> 0 or doc_id < 1000""", ("docs",))
def id_alphabets(docs):
    d, h = F.col("doc_id"), F.md5(F.col("doc_id").cast("string"))
    v = F.when(d % 5 == 0, d.cast("string")).when(d % 5 == 1, h).when(d % 5 == 2, F.upper(h)).when(d % 5 == 3, F.concat(F.lit("x_"), h)).otherwise(F.lit("ab" * 6))
    return docs.where("doc_id % 5 <> 0 or doc_id < 1000").select("doc_id", text.alphabet(v).alias("alphabet"), text.degenerate(v).alias("degenerate"))
