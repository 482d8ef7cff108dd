"""Writers of verdicts, packs and small reports."""

from __future__ import annotations

import hashlib
import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verdicts_jsonl(verdicts: DataFrame, path: str, places: int = 6) -> None:
    """One JSON object a verdict with keys in column order; doubles are rounded."""
    cols = [F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in verdicts.dtypes]
    verdicts.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def session_summary(verdicts: DataFrame, path: str) -> None:
    """Beside the verdicts of a file: one JSON object a session with its counts of verdicts and the checks that ran."""
    v = lambda name: F.count_if(F.col("verdict") == name).alias(name)
    g = verdicts.groupBy("session_id").agg(
        F.countDistinct("call_key").alias("calls"), v("contradicted"), v("supported"), v("unconstrained"), F.array_sort(F.collect_set("check")).alias("checks")
    )
    g.select(F.to_json(F.struct(*g.columns)).alias("value")).write.mode("overwrite").text(path)


def packed(events: DataFrame, path: str, by: str = "corpus") -> dict:
    """pack, then a file _META.json with counts and the schema's hash, which stands only when everything before it does: a folder without it isn't whole."""
    from ..schema import schema_sha

    spark = events.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_META.json")
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(place, False)
    pack(events, path, by)
    held = spark.read.parquet(path)
    rows = held.groupBy(by).agg(F.count("*").alias("rows"), F.countDistinct("session_id").alias("sessions")).orderBy(by).collect()
    meta = {"schema": schema_sha(), "corpora": {r[by]: {"rows": r["rows"], "sessions": r["sessions"]} for r in rows}}
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_META.json.tmp")
    out = system.create(part, True)
    out.write(bytearray(json.dumps(meta, sort_keys=True).encode()))
    out.close()
    system.rename(part, place)
    return meta


def whole_pack(spark, path: str) -> dict:
    """The meta of a packed folder; an error where it is missing."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/_META.json")
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def pack(events: DataFrame, path: str, by: str = "corpus") -> None:
    """Events as zstd Parquet in one folder per corpus, a session's rows together and in order."""
    events.repartition("session_id").sortWithinPartitions("session_id", "seq").write.mode("overwrite").partitionBy(by).option("compression", "zstd").parquet(path)


def census(verdicts: DataFrame, path: str) -> None:
    verdicts.write.mode("overwrite").partitionBy("corpus").parquet(path)


def report(tables: dict[str, DataFrame], limit: int = 1000) -> dict:
    """Small aggregates as a dict with a hash of their content; a table of more rows than the limit is refused."""
    out = {}
    for name, df in tables.items():
        rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
        if len(rows) > limit:
            raise ValueError(f"{name} has more than {limit} rows")
        out[name] = sorted(rows, key=lambda r: json.dumps(r, default=str, sort_keys=True))
    return out | {"sha256": hashlib.sha256(json.dumps(out, default=str, sort_keys=True).encode()).hexdigest()}


def markdown(rows: list[dict]) -> str:
    if not rows:
        return "(no rows)\n"
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    cols = list(rows[0])
    return "\n".join(["| " + " | ".join(cols) + " |", "|" + " --- |" * len(cols), *("| " + " | ".join(cell(r[c]) for c in cols) + " |" for r in rows)]) + "\n"


def html_table(rows: list[dict]) -> str:
    cols = list(rows[0]) if rows else []
    line = lambda tag, values: "<tr>" + "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in values) + "</tr>"
    return "<table>" + line("th", cols) + "".join(line("td", [r[c] for c in cols]) for r in rows) + "</table>"


def exit_status(counts: dict[str, int]) -> int:
    """1 with a contradiction, 2 if nothing could be decided, else 0."""
    return 1 if counts.get("contradicted") else 0 if counts.get("supported") else 2
