"""The verdicts of one transcript as text or JSON: python -m tracelode.report FILE [--json] [--flagged-only]."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import replay, structural
from .sources import readers

#: Checks by short name, and those whose support counts for a call.
CHECKS = {"T0": structural.verdicts, "T1": replay.verdicts}
CONTENT = ("T1",)


def verdicts(turns: DataFrame) -> DataFrame:
    """(key, n, turn, call_id, tool, input, verdict, checks, reason) of every call in order of its first appearance.

    Contradicted if any check says so, supported if a check of content does; checks names those that decide. A violation that blames
    no call is a row without number.
    """
    said = None
    for name, check in CHECKS.items():
        one = check(turns).select("key", "call_id", F.lit(name).alias("check"), "verdict", "reason")
        said = one if said is None else said.unionByName(one)
    given = F.coalesce("tool_input_json", "content", F.lit("{}"))
    shown = F.coalesce(*[F.get_json_object(given, f"$.{k}") for k in ("command", "file_path", "path", "pattern")], given)
    call = turns.where("role in ('tool_use', 'tool_result') and tool_call_id is not null")
    first = call.groupBy("key", F.col("tool_call_id").alias("call_id")).agg(
        F.min("pos").alias("pos"), F.min_by("turn_number", "pos").alias("turn"), F.min_by("tool_name", "pos").alias("tool"),
        F.min_by(F.when(F.col("role") == "tool_use", F.regexp_replace(shown, r"\s+", " ")), "pos").alias("input"),
    )
    v, c = F.col("verdict"), F.col("check")
    by = lambda on: F.array_sort(F.array_compact(F.collect_list(F.when(on, F.struct("check", "reason")))))
    per = said.groupBy("key", "call_id").agg(by(v == "contradicted").alias("bad"), by((v == "supported") & c.isin(*CONTENT)).alias("good"), by(F.lit(True)).alias("each"))
    met = first.join(per, ["key", "call_id"], "full")
    verdict = F.when(F.size("bad") > 0, "CONTRADICTED").when(F.size("good") > 0, "SUPPORTED").otherwise("UNCONSTRAINED")
    deciding = F.when(F.size("bad") > 0, F.col("bad")).when(F.size("good") > 0, F.col("good")).otherwise(F.array().cast("array<struct<check:string,reason:string>>"))
    spoken = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(" ", x["check"], x["reason"])), "; ")
    reason = F.when(F.size(deciding) > 0, spoken(deciding)).otherwise(F.concat(F.lit("no check could decide: "), spoken("each")))
    met = met.withColumns({"verdict": verdict, "checks": F.transform(deciding, lambda x: x["check"]), "reason": reason})
    from pyspark.sql.window import Window

    n = F.when(F.col("pos").isNotNull(), F.row_number().over(Window.partitionBy("key").orderBy(F.asc_nulls_last("pos"))))
    return met.where(F.col("pos").isNotNull() | (F.col("verdict") == "CONTRADICTED")).select("key", n.alias("n"), "turn", "call_id", "tool", "input", "verdict", "checks", "reason")


def _clip(text, n: int) -> str:
    text = text or ""
    return text if len(text) <= n else text[: n - 3] + "..."


def text(rows: list, name: str, flagged: bool = False) -> tuple[str, int]:
    """A table of calls with a summary, and the exit status: 1 with a contradiction, else 0."""
    calls = sorted((r for r in rows if r["n"] is not None), key=lambda r: r["n"])
    session = [r for r in rows if r["n"] is None]
    count = {v: sum(r["verdict"] == v for r in calls) for v in ("CONTRADICTED", "SUPPORTED", "UNCONSTRAINED")}
    bad = count["CONTRADICTED"] + len(session)
    out = [f"{name}  ({len(calls)} tool calls)", "", f"  {'#':>3} {'turn':>4}  {'tool':8s} {'input':38s} {'verdict':13s} {'check':5s}  reason"]
    for r in calls:
        if not flagged or r["verdict"] == "CONTRADICTED":
            out.append(f"  {r['n']:>3} {r['turn']!s:>4}  {_clip(r['tool'], 8):8s} {_clip(r['input'], 38):38s} {r['verdict']:13s} {','.join(r['checks']) or '-':5s}  {r['reason']}")
    out += [f"  session-level: {r['reason']}" for r in session]
    more = f", {len(session)} session-level violation(s)" if session else ""
    end = "CONTRADICTED" if bad else "no contradiction found"
    out += ["", f"  {count['CONTRADICTED']} contradicted, {count['SUPPORTED']} supported, {count['UNCONSTRAINED']} unconstrained{more}  ->  {end} (exit {int(bool(bad))})"]
    return "\n".join(out) + "\n", int(bool(bad))


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(description="Verdicts of one transcript of turns, one JSON object a line.")
    ap.add_argument("transcript")
    ap.add_argument("--json", action="store_true", help="the rows as JSON")
    ap.add_argument("--flagged-only", action="store_true", help="contradicted calls only")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        turns = readers.turns_jsonl(spark, a.transcript)
        empty = turns.isEmpty()
    except Exception as e:  # a path that isn't there, or a broken line
        print(f"{a.transcript}: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2
    if empty:
        print(f"{a.transcript}: empty transcript", file=sys.stderr)
        return 2
    rows = [r.asDict() for r in verdicts(turns).collect()]  # one transcript's calls
    shown, status = text(rows, a.transcript, a.flagged_only)
    print(json.dumps({"file": a.transcript, "calls": rows}, indent=1, ensure_ascii=False) if a.json else shown, end="\n" if a.json else "")
    return status


if __name__ == "__main__":
    sys.exit(main())
