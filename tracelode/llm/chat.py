"""Chat formatting: tool calls linked to results, ordered by dependency, validated and serialised as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import word_count, written

#: Tools by name; a field has a JSON type, and `required`, `min` or `min_length` if such holds.
TOOLS = {"ask": {"query": {"type": "string", "required": True, "min_length": 1}, "turn": {"type": "integer", "required": True, "min": 0}, "words": {"type": "integer", "min": 0}}}
#: JSON types with the prefix that Spark's schema of a variant gives them.
_KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}
MAX_TOOLS = 200
#: Bytes of results in a shuffle partition, on average, up to which a hash join holds them; beyond it, both sides are sorted.
HASH_BYTES = 64_000_000


def _field_errors(args: Column, name: str, rule: dict) -> list[Column]:
    path = f"$['{name}']"
    value = F.try_variant_get(args, path, "variant")
    kind = F.schema_of_variant(value)
    wrong = value.isNotNull() & ~F.coalesce(F.greatest(*[kind.startswith(k) for k in _KINDS[rule["type"]]], F.lit(False)), F.lit(False))
    found = [F.when(wrong, f"{name}:type")]
    if rule.get("required"):
        found.append(F.when(value.isNull(), f"{name}:missing"))
    if "min" in rule:
        found.append(F.when(F.try_variant_get(args, path, "double") < rule["min"], f"{name}:min"))
    if "min_length" in rule:
        found.append(F.when(F.length(F.try_variant_get(args, path, "string")) < rule["min_length"], f"{name}:min_length"))
    return found


def errors_of(name: Column, arguments: Column, tools: dict = TOOLS) -> Column:
    """Sorted list of what is wrong with a call's JSON arguments; empty if all is well."""
    if len(tools) > MAX_TOOLS:
        raise ValueError(f"more than {MAX_TOOLS} tools don't belong in one expression")
    args = F.try_parse_json(arguments)
    keys = F.json_object_keys(F.when(args.isNotNull(), arguments))
    out = F.when(args.isNull(), F.array(F.lit("arguments:json"))).when(keys.isNull(), F.array(F.lit("arguments:object")))
    for tool, fields in sorted(tools.items()):
        checks = [c for f, rule in sorted(fields.items()) for c in _field_errors(args, f, rule)]
        unknown = F.transform(F.array_except(keys, F.array(*map(F.lit, sorted(fields)))), lambda k: F.concat(k, F.lit(":unknown")))
        out = out.when(name == tool, F.array_sort(F.concat(F.array_compact(F.array(*checks)), unknown)))
    return out.otherwise(F.array(F.lit("name:unknown")))


def canonical(text: Column) -> Column:
    """JSON without white space and with sorted keys at every level; null if it doesn't parse. (A variant keeps its keys sorted.)"""
    return F.to_json(F.try_parse_json(text))


def levels(calls: DataFrame) -> DataFrame:
    """(conv, call_id, level): the longest chain of dependencies below each call of calls(conv, call_id, after array<string>).

    A dependency on a call that isn't there holds nothing up. Each written round settles the calls whose
    dependencies are all settled, and shortens the rest by pointer doubling: a dependency on a call that itself waits for one
    other only becomes a dependency on that one, by as many steps more. So a chain of n takes about log2(n)
    rounds. A call that comes to wait for itself, or by more steps than its conversation has calls, lies on a cycle: it,
    and what waits for it, never settles and has a null level.
    """
    nodes = written(calls.select("conv", "call_id").distinct(), "calls")
    size = nodes.groupBy("conv").agg(F.count("*").alias("n"))
    edges = calls.select("conv", "call_id", F.explode("after").alias("on")).distinct().join(nodes.select("conv", F.col("call_id").alias("on")), ["conv", "on"])
    edges = written(edges.select("conv", "call_id", "on", F.lit(1).cast("long").alias("steps")).join(size, "conv"), "depends")
    waiting = edges.select("conv", "call_id").distinct()
    settled = written(nodes.join(waiting, ["conv", "call_id"], "left_anti").withColumn("level", F.lit(0).cast("long")), "levels")
    # base: the level that settled dependencies alone would give a waiting call
    base, found = waiting.withColumn("base", F.lit(0).cast("long")), [settled]
    while True:
        done = settled.select("conv", F.col("call_id").alias("on"), "level")
        met = written(edges.join(done, ["conv", "on"], "left"), "met")
        base = base.unionByName(met.where("level is not null").select("conv", "call_id", (F.col("steps") + F.col("level")).alias("base")))
        base = written(base.groupBy("conv", "call_id").agg(F.max("base").alias("base")), "bases")
        left = met.where("level is null").drop("level")
        open_ = written(left.groupBy("conv", "call_id").agg(F.count("*").alias("k"), F.min("on").alias("to"), F.max("steps").alias("by")), "open")
        settled = written(base.join(open_, ["conv", "call_id"], "left_anti").select("conv", "call_id", F.col("base").alias("level")), "levels")
        found.append(settled)
        base = base.join(open_, ["conv", "call_id"], "left_semi")
        one = open_.where("k = 1").join(base, ["conv", "call_id"]).select("conv", F.col("call_id").alias("on"), "to", "by", F.col("base").alias("below"))
        hop = left.join(one, ["conv", "on"], "left")
        # what the passed-over call's settled dependencies ask for goes to those that waited for it
        asked = hop.where("to is not null").select("conv", "call_id", (F.col("steps") + F.col("below")).alias("base"))
        base = base.unionByName(asked).groupBy("conv", "call_id").agg(F.max("base").alias("base"))
        hop = hop.select("conv", "call_id", F.coalesce("to", "on").alias("on"), (F.col("steps") + F.coalesce("by", F.lit(0))).alias("steps"), "n", F.col("to").isNotNull().alias("hopped"))
        after = hop.where("on <> call_id and steps <= n").groupBy("conv", "call_id", "on", "n").agg(F.max("steps").alias("steps"), F.max("hopped").alias("hopped"))
        # a call that has lost a dependency to a cycle waits for ever, as do those that wait for it
        lost = hop.where("on = call_id or steps > n").select("conv", "call_id").distinct()
        after = after.join(lost, ["conv", "call_id"], "left_anti")
        gone = lost.select("conv", F.col("call_id").alias("on"))
        stuck = after.join(gone, ["conv", "on"], "left_semi").select("conv", "call_id").distinct()
        after = written(after.join(stuck, ["conv", "call_id"], "left_anti"), "depends")
        kept = after.select("conv", "call_id").distinct()
        base = written(base.join(kept, ["conv", "call_id"], "left_semi"), "bases")
        if after.isEmpty() or (settled.isEmpty() and after.where("hopped").isEmpty()):
            break
        edges = after.drop("hopped")
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return nodes.join(whole, ["conv", "call_id"], "left")


def out_of_order(calls: DataFrame) -> DataFrame:
    """(conv) of conversations in which some call depends on one that doesn't come before it in log order."""
    first = calls.groupBy("conv", "call_id").agg(F.min("at").alias("at"))
    edges = calls.select("conv", "call_id", "at", F.explode("after").alias("on"))
    met = edges.join(first.select("conv", F.col("call_id").alias("on"), F.col("at").alias("on_at")), ["conv", "on"])
    before = F.struct(F.col("on_at"), F.col("on")) < F.struct(F.col("at"), F.col("call_id"))
    return met.where(~F.coalesce(before, F.lit(False))).select("conv").distinct()


def link(calls: DataFrame, results: DataFrame, tools: dict = TOOLS) -> DataFrame:
    """calls(conv, call_id, name, arguments, after, at) with results(conv, call_id, content, at), one row a call.

    status: `linked`, `missing` without a result, `duplicate` for all but an id's first
    call (by at, then name and arguments), which get no result; of several results the
    first counts. A null conv or id never links. position is the topological order: log
    order (at, then id) where every dependency comes before its call, as logs mostly have it;
    else by levels, log order inside them, with calls in or behind a cycle last. Only
    conversations of the second kind cost rounds. json is the canonical message.
    """
    first = Window.partitionBy("conv", "call_id").orderBy("at", "name", "arguments")
    numbered = calls.withColumn("nth", F.row_number().over(first))
    answer = results.where("conv is not null and call_id is not null").groupBy("conv", "call_id").agg(F.min(F.struct("at", "content")).alias("r"))
    named = calls.where("conv is not null and call_id is not null")
    astray = written(out_of_order(named), "out-of-order")
    ordered = named.select("conv", "call_id").limit(0).withColumn("level", F.lit(0).cast("long")) if astray.isEmpty() else levels(named.join(astray, "conv", "left_semi"))
    ordered = ordered.withColumn("level", F.coalesce("level", F.lit(2**31 - 1)).cast("long"))
    # hash joins build their tables of results, one row an identifier, where these fit a task by a count of their bytes
    size = results.agg(F.sum(F.coalesce(F.octet_length("content"), F.lit(0)) + 64)).first()[0] or 0
    small = size <= HASH_BYTES * int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = (lambda df: df.hint("shuffle_hash")) if small else (lambda df: df)
    joined = numbered.join(hashed(answer), ["conv", "call_id"], "left").join(hashed(ordered), ["conv", "call_id"], "left")
    own = F.col("nth") == 1
    status = F.when(~own, "duplicate").when(F.col("r").isNull(), "missing").otherwise("linked")
    order = Window.partitionBy("conv").orderBy(F.coalesce("level", F.lit(0)), "at", "call_id", "nth")
    problems = errors_of(F.col("name"), F.col("arguments"), tools)
    out = joined.select("conv", "call_id", "name", "arguments", F.row_number().over(order).alias("position"), status.alias("status"), problems.alias("errors"), F.when(own, F.col("r.content")).alias("content"))
    message = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")),
        F.lit(',"id":'), _quoted(F.col("call_id")), F.lit(',"name":'), _quoted(F.col("name")),
        F.lit(',"result":'), _quoted(F.col("content")), F.lit("}"))
    return out.withColumn("valid", F.size("errors") == 0).withColumn("json", message)


def _quoted(text: Column) -> Column:
    """A JSON string, or null."""
    whole = F.to_json(F.struct(text.alias("v")), {"ignoreNullFields": "false"})
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of conv_id, turn, role, text rows: a user's turn asks, the assistant's next turn answers by its identifier; each question needs the one before."""
    name = lambda back: F.concat(F.lit("call-"), F.col("conv_id"), F.lit("-"), F.col("turn") - back)
    text = F.coalesce("text", F.lit(""))
    arguments = F.to_json(F.struct(F.col("turn").alias("turn"), word_count(text).alias("words"), text.alias("query")))
    calls = turns.where("role = 'user'").select(F.col("conv_id").alias("conv"), name(0).alias("call_id"), F.lit("ask").alias("name"), arguments.alias("arguments"), F.array(name(2)).alias("after"), F.col("turn").alias("at"))
    results = turns.where("role = 'assistant'").select(F.col("conv_id").alias("conv"), name(1).alias("call_id"), F.col("text").alias("content"), F.col("turn").alias("at"))
    return calls, results
