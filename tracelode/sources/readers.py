"""Readers of turn logs, event tables, raw transcripts and SQLite tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from .. import schema
from ..functions import text as X
from . import formats

#: Held-out names that a reader refuses unless told otherwise.
FORBIDDEN = ("test", "heldout", "answers")
#: Secrets that ingest replaces, by kind: fixed values.
SECRETS = {
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----",
    "slack_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b",
}


def guarded(path: str, allow_held_out: bool = False) -> str:
    parts = re.split(r"[/._-]", path.lower())
    if not allow_held_out and any(p in FORBIDDEN for p in parts[-3:]):
        raise ValueError(f"{path} names a held-out split")
    return path


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, line) of non-empty lines, pos being the line's number from 0 in its file.

    Files are read in byte ranges of any number of tasks; lines are numbered inside their range, and a count for each range
    gives its offset, so no task holds a file.
    """
    from ..tables import written

    meta = lambda c: F.col(f"_metadata.{c}")
    raw = spark.read.text(path).select(meta("file_path").alias("path"), meta("file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    raw = written(raw, "lines")
    per = raw.groupBy("path", "start").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per.select("path", "start", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("path", "start").orderBy("id")) - 1
    numbered = raw.withColumn("inside", inside).join(offsets, ["path", "start"])
    return numbered.where("trim(line) <> ''").select("path", (F.col("offset") + F.col("inside")).cast("long").alias("pos"), F.regexp_replace("line", "\r$", "").alias("line"))


def turns_jsonl(spark: SparkSession, path: str, key: str = "path") -> DataFrame:
    """Turn logs, one JSON object a line: key, pos and the turn columns. A broken line stops the read and is named.

    A turn's number or stamp may be of another JSON type; tool_input_json may be an object.
    """
    parsed = lines(spark, path).withColumn("v", F.try_parse_json("line"))
    parsed = parsed.withColumn("_ok", F.assert_true(F.col("v").isNotNull(), F.concat_ws(":", F.lit("not JSON"), "path", F.col("pos") + 1)))
    return _as_turns(parsed.where("_ok is null"), key)


def turns_array(spark: SparkSession, path: str) -> DataFrame:
    """Turn logs that are one JSON array a file."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("a"))
    items = F.expr("cast(a as array<variant>)")
    return _as_turns(whole.select("path", F.posexplode(items).alias("pos", "v")).withColumn("pos", F.col("pos").cast("long")), "path")


def _as_turns(parsed: DataFrame, key: str) -> DataFrame:
    def take(f: T.StructField):
        if f.name == "tool_input_json":
            v = F.try_variant_get("v", "$.tool_input_json", "variant")
            return F.coalesce(F.when(F.schema_of_variant(v).startswith("OBJECT"), F.to_json(v)), F.try_variant_get("v", "$.tool_input_json", "string")).alias(f.name)
        return F.try_variant_get("v", f"$.{f.name}", "bigint" if isinstance(f.dataType, T.LongType) else "string").alias(f.name)

    return parsed.select(F.col(key).alias("key") if key == "path" else F.try_variant_get("v", f"$.{key}", "string").alias("key"), "pos", *[take(f) for f in schema.TURN])


def events_parquet(spark: SparkSession, path: str, sessions: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """An event table with exactly the pinned columns; sessions and columns reach the scan."""
    df = spark.read.parquet(guarded(path))
    if df.columns != schema.EVENT.names:
        raise ValueError("the columns are not the event columns in order")
    df = schema.conform(df)
    if sessions is not None:
        df = df.where(F.col("session_id").isin(sessions))
    return df.select(*columns) if columns else df


def redacted(events: DataFrame, columns: tuple[str, ...] = ("args", "command", "text", "stderr")) -> tuple[DataFrame, DataFrame]:
    """events with secrets replaced by marks, and the counts per column and kind."""
    out, counts = events, []
    for c in columns:
        for kind, p in SECRETS.items():
            counts.append(F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.coalesce(F.sum(F.regexp_count(F.col(c), F.lit(p))), F.lit(0)).alias("n")))
            out = out.withColumn(c, F.regexp_replace(c, p, f"[{kind}]"))
    tallied = events.agg(F.array(*counts).alias("t")).select(F.explode("t").alias("t")).select("t.*").where("n > 0")
    return out, tallied


# Fixed values: (role, turn type) of a turn to the kind of its event; the other metadata is meta.
KIND_OF = {("tool_use", "tool_use"): "call", ("tool_result", "tool_result"): "result", ("user", "user_prompt"): "user", ("user", "system_injected"): "system", ("assistant", "assistant_response"): "assistant", ("assistant", "assistant_thinking"): "meta"}


def turns_to_events(turns: DataFrame) -> DataFrame:
    """Turn logs (key, pos, + turn columns) as events.

    seq follows turn_number, nulls last, then file order. A call without id gets
    `turn:<turn_id>`; a result takes the tool of its id's latest earlier call, else of its first.
    """
    log = Window.partitionBy("key").orderBy(F.asc_nulls_last("turn_number"), "pos")
    kind = F.lit(None).cast("string")
    for (role, kind_type), k in KIND_OF.items():
        kind = F.coalesce(kind, F.when((F.col("role") == role) & (F.col("turn_type") == kind_type), k))
    t = turns.withColumns({"seq": (F.row_number().over(log) - 1).cast("long"), "kind": F.coalesce(kind, F.lit("meta"))})
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    t = t.withColumn("call_id", F.when(call, F.coalesce(F.nullif("tool_call_id", F.lit("")), F.concat(F.lit("turn:"), "turn_id"))).when(result, F.col("tool_call_id")))
    same = Window.partitionBy("key", "call_id").orderBy("seq")
    raw = F.when(call, F.col("tool_name"))
    earlier = F.last(F.when(call, F.struct(F.col("tool_name").alias("x"))), ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first(F.when(call, F.struct(F.col("tool_name").alias("x"))), ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    t = t.withColumn("tool_raw", F.when(result & F.col("call_id").isNotNull(), F.coalesce(earlier["x"], first["x"])).otherwise(raw))
    said = F.col("kind") == "assistant"
    stamp = X.iso(F.col("timestamp"))
    extra = F.to_json(F.struct("turn_id", F.when(F.col("kind") == "meta", F.col("turn_type")).alias("turn_type"), F.when(F.col("turn_type") == "assistant_thinking", F.length(F.coalesce("content", F.lit("")))).alias("thinking_chars")))
    made = {
        "corpus": F.lit("turns"), "stratum": F.col("source"), "ts": stamp, "ts_kind": F.when(stamp.isNotNull(), "event").otherwise("none"), "tool": X.normalize_tool(F.col("tool_raw")),
        "args": F.when(call, F.col("tool_input_json")), "command": F.when(call, F.col("command")), "text": F.when(F.col("kind").isin("result", "user", "system", "assistant"), F.col("content")),
        "usage_in": F.when(said, F.col("input_tokens")), "usage_out": F.when(said, F.col("output_tokens")), "usage_cache_read": F.when(said, F.col("cache_read_input_tokens")), "usage_cache_create": F.when(said, F.col("cache_creation_input_tokens")),
        "model": F.when(said, F.col("model")), "extra": extra,
    }
    for name in ("stderr", "native_error", "exit_code", "api_msg_id", "request_id", "is_subagent", "parent_call_id", "agent_id"):
        made[name] = F.lit(None)
    return schema.conform(t.select(*[made[f.name].alias(f.name) if f.name in made else F.col(f.name) for f in schema.EVENT]))


# --- raw transcripts -------------------------------------------------------------------------


# Record types by which a transcript's first line is told.
CODEX_TYPES = ("session_meta", "turn_context", "response_item", "event_msg", "compacted")
CLAUDE_TYPES = ("queue-operation", "file-history-snapshot", "summary", "progress", "system", "user", "assistant", "attachment", "last-prompt", "permission-mode", "custom-title", "agent-name", "ai-title", "pr-link", "tool_use", "tool_result")


def sniff(text: str) -> str:
    """The format of a transcript, told by its whole first line, or by the whole text where that is one document; never by its name."""
    s = text.lstrip("\ufeff \t\r\n")
    if s.startswith("["):
        return "json_array"
    try:
        first = json.loads(s.split("\n", 1)[0])
    except ValueError:
        try:
            first = json.loads(s)
        except ValueError:
            first = next(iter(_salvaged(s.split("\n", 1)[0])[0]), None)
    if not isinstance(first, dict):
        return "unknown"
    kind = first.get("type")
    if "steps" in first and "schema_version" in first:
        return "atif"
    if "payload" in first and kind in CODEX_TYPES:
        return "codex"
    if "role" in first and ("turn_number" in first or "turn_id" in first):
        return "turns"
    if other := formats.told(first, s):
        return other
    if "sessionId" in first or "parentUuid" in first or kind in CLAUDE_TYPES:
        return "claude_code"
    return "unknown"


def _salvaged(text: str) -> tuple[list[dict], int]:
    """JSON objects of a text: one a line, several run together, or cut off at the end; and how many pieces were lost."""
    decoder, out, lost = json.JSONDecoder(strict=False), [], 0
    for line in text.splitlines():
        at, n = 0, len(line)
        while at < n:
            while at < n and line[at] in " \t﻿\x00":
                at += 1
            if at >= n:
                break
            try:
                value, at = decoder.raw_decode(line, at)
            except ValueError:
                lost += 1
                break
            if isinstance(value, dict):
                out.append(value)
    return out, lost


def _flat(content) -> str | None:
    if isinstance(content, list):
        parts = [x.get("text", "") if isinstance(x, dict) else str(x) for x in content]
        return "\n".join(p for p in parts if p)
    return content if content is None or isinstance(content, str) else json.dumps(content, ensure_ascii=False)


def _claude(records: list[dict]) -> Iterator[dict]:
    """One event a content block; a record's uuid counts once; thinking is carried to the next event of its message."""
    seen, names = set(), {}
    for r in records:
        if r.get("type") == "progress":
            r = (r.get("data") or {}).get("message") or r
        if r.get("uuid") is not None:
            if r["uuid"] in seen:
                continue
            seen.add(r["uuid"])
        m = r.get("message") or {}
        u = m.get("usage") or {}
        base = {"session_id": r.get("sessionId"), "ts": r.get("timestamp"), "uuid": r.get("uuid"), "parent_uuid": r.get("parentUuid"), "request_id": r.get("requestId"), "api_msg_id": m.get("id"), "model": m.get("model"), "is_subagent": r.get("isSidechain"), "usage_in": u.get("input_tokens"), "usage_out": u.get("output_tokens"), "usage_cache_read": u.get("cache_read_input_tokens"), "usage_cache_create": u.get("cache_creation_input_tokens")}
        content, role = m.get("content"), m.get("role") or r.get("type")
        thinking = 0
        for block in content if isinstance(content, list) else [{"type": "text", "text": content}]:
            kind = block.get("type")
            if kind == "thinking":
                thinking += len(block.get("thinking") or "")
            elif kind == "tool_use":
                names[block.get("id")] = block.get("name")
                args = block.get("input") or {}
                yield base | {"kind": "call", "call_id": block.get("id"), "tool_raw": block.get("name"), "args": json.dumps(args, ensure_ascii=False, separators=(",", ":")), "command": args.get("command"), "extra": {"thinking_chars": thinking}}
                thinking = 0
            elif kind == "tool_result":
                yield base | {"kind": "result", "call_id": block.get("tool_use_id"), "tool_raw": names.get(block.get("tool_use_id")), "text": _flat(block.get("content")), "native_error": block.get("is_error")}
            elif block.get("text"):
                yield base | {"kind": role if role in ("user", "assistant", "system") else "meta", "text": block.get("text"), "extra": {"thinking_chars": thinking}}
                thinking = 0


def _codex(records: list[dict]) -> Iterator[dict]:
    session, names, model = None, {}, None
    for r in records:
        p, kind = r.get("payload") or {}, r.get("type")
        base = {"session_id": session, "ts": r.get("timestamp"), "model": model}
        if kind == "session_meta":
            session = p.get("id")
        elif kind == "turn_context":
            model = p.get("model")
        elif kind == "response_item" and p.get("type") == "message":
            role = p.get("role")
            yield base | {"kind": {"developer": "system"}.get(role, role) if role in ("user", "assistant", "system", "developer") else "meta", "text": _flat(p.get("content"))}
        elif kind == "response_item" and p.get("type") in ("function_call", "custom_tool_call", "local_shell_call"):
            names[p.get("call_id")] = p.get("name") or "local_shell"
            args = p.get("arguments") or p.get("input") or json.dumps(p.get("action") or {})
            try:
                command = json.loads(args).get("command")
            except (ValueError, AttributeError):
                command = None
            yield base | {"kind": "call", "call_id": p.get("call_id"), "tool_raw": names[p.get("call_id")], "args": args, "command": " ".join(command) if isinstance(command, list) else command}
        elif kind == "response_item" and p.get("type") in ("function_call_output", "custom_tool_call_output"):
            yield base | {"kind": "result", "call_id": p.get("call_id"), "tool_raw": names.get(p.get("call_id")), "text": _flat(p.get("output"))}


def _atif(doc: dict) -> Iterator[dict]:
    for s in doc.get("steps") or []:
        base = {"session_id": doc.get("session_id"), "ts": s.get("timestamp"), "model": (doc.get("agent") or {}).get("model_name")}
        source = s.get("source")
        if s.get("message"):
            yield base | {"kind": "assistant" if source == "agent" else source if source in ("user", "system") else "meta", "text": _flat(s["message"])}
        for c in s.get("tool_calls") or []:
            args = c.get("arguments") or {}
            yield base | {"kind": "call", "call_id": c.get("tool_call_id"), "tool_raw": c.get("function_name"), "args": json.dumps(args, ensure_ascii=False), "command": args.get("command") if isinstance(args, dict) else None}
        for o in (s.get("observation") or {}).get("results") or []:
            yield base | {"kind": "result", "call_id": o.get("source_call_id"), "text": _flat(o.get("content"))}


def _stamp(ts) -> str | None:
    """A stamp as text; a number is epoch milliseconds."""
    if isinstance(ts, (int, float)) and not isinstance(ts, bool):
        return datetime.fromtimestamp(ts / 1000, timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    return ts if isinstance(ts, str) else None


def parse_transcript(text: str, name: str) -> list[dict]:
    """Events of one raw transcript, in order, in the event columns."""
    form = sniff(text)
    if form == "atif":
        found = list(_atif(json.loads(text.lstrip("\ufeff \t\r\n"))))
    elif form in ("claude_code", "codex"):
        records, _ = _salvaged(text)
        found = list((_claude if form == "claude_code" else _codex)(records))
    elif form in formats.DOCUMENTS:
        found = list(formats.DOCUMENTS[form](json.loads(text.lstrip("\ufeff \t\r\n"))))
    elif form in formats.LINES:
        found = list(formats.LINES[form](_salvaged(text)[0]))
    else:
        return []
    rows = []
    for seq, e in enumerate(found):
        row = dict.fromkeys(schema.EVENT.names) | {k: v for k, v in e.items() if k != "extra"}
        row |= {"corpus": form, "session_id": e.get("session_id") or name, "seq": seq, "ts": _stamp(e.get("ts")), "ts_kind": "event" if e.get("ts") else "none", "extra": json.dumps(e["extra"], sort_keys=True) if e.get("extra") else None}
        rows.append(row)
    return rows


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Raw transcripts of any known format as events: one task parses whole files, each by its sniffed format."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, value in zip(pdf["path"], pdf["value"]):
                rows = parse_transcript(value, p.rsplit("/", 1)[-1].rsplit(".", 1)[0])
                if rows:
                    yield pd.DataFrame(rows, columns=schema.EVENT.names).astype(object)

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    out = files.mapInPandas(run, schema.EVENT)
    return out.withColumn("tool", X.normalize_tool(F.col("tool_raw")))


def unread(spark: SparkSession, path: str) -> DataFrame:
    """(path, format) of the files that transcripts has no reader for and gives no rows of."""
    told = F.udf(lambda t: sniff(t or ""), "string")
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), told("value").alias("format"))
    return files.where(~F.col("format").isin("atif", "claude_code", "codex", *formats.DOCUMENTS, *formats.LINES))


class SQLiteSource(DataSource):
    """spark.read.format("sqlite").option("path", file).option("dbtable", name).schema(...): a table in rowid ranges."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        import sqlite3

        kinds = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "BLOB": "binary"}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            cols = con.execute(f'pragma table_info("{self.options["dbtable"]}")').fetchall()
        return ", ".join(f"`{c[1]}` {kinds.get(c[2].upper(), 'string')}" for c in cols)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SQLiteReader(self.options, schema)


class _SQLiteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.table, self.names = options["path"], options["dbtable"], schema.names
        self.parts = int(options.get("numpartitions", "4"))

    def partitions(self):
        """Ranges of rowids, equal in width; a view, which has none, is one range."""
        import sqlite3

        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            try:
                low, high = con.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
            except sqlite3.OperationalError:
                return [InputPartition(None)]
        if low is None:
            return [InputPartition(None)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [InputPartition((at, min(high, at + step - 1))) for at in range(low, high + 1, step)]

    def read(self, partition):
        import sqlite3

        cols = ", ".join(f'"{n}"' for n in self.names)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            if partition.value is None:
                yield from con.execute(f'select {cols} from "{self.table}"')
            else:
                yield from con.execute(f'select {cols} from "{self.table}" where rowid between ? and ?', partition.value)


# --- sidecars --------------------------------------------------------------------------------


def shown_line_counts(spark: SparkSession, path: str) -> DataFrame:
    """(call_id, lines): how many lines of a file each read was given, as raw transcript lines record beside the result; the first record of an id counts.

    Natively: lines are parsed as variants, and what isn't an object with such a record is passed over.
    """
    v = lines(spark, path).where(F.col("line").contains('"numLines"')).withColumn("v", F.try_parse_json("line"))
    n = F.try_variant_get("v", "$.toolUseResult.file.numLines", "variant")
    blocks = F.from_json(F.to_json(F.try_variant_get("v", "$.message.content", "variant")), "array<struct<type:string,tool_use_id:string>>")
    own = F.get(F.filter(blocks, lambda b: b["type"] == "tool_result"), F.lit(0))["tool_use_id"]
    found = v.where(F.schema_of_variant(n) == "BIGINT").select(own.alias("call_id"), F.try_variant_get("v", "$.toolUseResult.file.numLines", "bigint").alias("lines"), "path", "pos")
    return found.where("call_id is not null").groupBy("call_id").agg(F.min_by("lines", F.struct("path", "pos")).alias("lines"))


def session_tallies(sessions: DataFrame, logs: DataFrame) -> DataFrame:
    """(session_id, api, in, cc, cr, out): what a capture tool tallied, for sessions whose log metadata hold a token_usage object; other counts are null, missing ones 0."""
    meta = F.try_parse_json("session_metadata_raw")
    gate = logs.select("session_id", F.coalesce(F.schema_of_variant(F.try_variant_get(meta, "$.token_usage", "variant")).startswith("OBJECT"), F.lit(False)).alias("ok")).groupBy("session_id").agg(F.bool_or("ok").alias("ok"))
    names = {"api": "api_call_count", "in": "input_tokens", "cc": "cache_creation_tokens", "cr": "cache_read_tokens", "out": "output_tokens"}
    whole = sessions.join(gate, "session_id", "left")
    count = lambda c: F.when(F.col("ok"), F.coalesce(F.col(c).cast("string").try_cast("bigint"), F.lit(0)))
    return whole.select("session_id", *[count(c).alias(n) for n, c in names.items()])


def copied_request_ids(events: DataFrame) -> DataFrame:
    """(request_id, keeper): request ids that more than one session holds, and the smallest of these sessions."""
    from ..operators.joins import shared_keys

    return shared_keys(events, "request_id", "session_id").select("request_id", F.col("first").alias("keeper"))
