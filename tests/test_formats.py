"""Transcripts of further harnesses, sidecars, lines by byte ranges, SQLite ranges, and the report of one transcript."""

import json
import sqlite3

import pytest

from tracelode import report
from tracelode.operators import replay
from tracelode.sources import formats, readers


def events(text, name="n"):
    return [{k: v for k, v in e.items() if v is not None} for e in readers.parse_transcript(text, name)]


def test_opencode():
    doc = {"info": {"id": "ses", "parentID": "p"}, "messages": [{"info": {"role": "user", "id": "m1", "time": {"created": 1700000000000}}, "parts": [{"type": "text", "text": "go"}]}, {"info": {"role": "assistant", "id": "REDACTED", "modelID": "m"}, "parts": [{"type": "reasoning", "text": "x"}, {"type": "tool", "tool": "bash", "callID": "c1", "state": {"status": "completed", "input": {"command": "ls"}, "output": "a", "metadata": {"exit": 2}, "time": {"start": 1, "end": 2}}}, {"type": "step-finish", "tokens": {"input": 5, "output": 6, "cache": {"read": 7, "write": 8}}}]}]}
    e = events(json.dumps(doc, indent=1))
    assert [x["kind"] for x in e] == ["user", "call", "result", "meta"] and {x["corpus"] for x in e} == {"opencode"}
    assert e[0]["ts"] == "2023-11-14T22:13:20.000Z" and e[1]["command"] == "ls" and e[2]["native_error"] and e[2]["exit_code"] == 2 and e[3]["usage_cache_create"] == 8 and e[1]["is_subagent"]


def test_gemini():
    doc = {"sessionId": "g", "projectHash": "h", "messages": [{"type": "user", "content": [{"text": "hi"}]}, {"type": "gemini", "id": "a", "content": "ok", "tokens": {"input": 3, "output": 4}, "toolCalls": [{"id": "c", "name": "run_shell_command", "args": {"command": "x"}, "status": "error", "result": [{"functionResponse": {"response": {"error": "bad"}}}]}]}, {"type": "info", "content": "z"}]}
    e = events(json.dumps(doc))
    assert [x["kind"] for x in e] == ["user", "assistant", "call", "result", "meta"] and e[3]["text"] == "bad" and e[3]["native_error"] and e[2]["usage_out"] == 4


def test_line_formats():
    cursor = [{"role": "user", "message": {"content": "hi"}}, {"role": "assistant", "message": {"content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "name": "read", "input": {"path": "a"}}]}}]
    assert [x["kind"] for x in events("\n".join(map(json.dumps, cursor)))] == ["user", "assistant", "call"]
    copilot = [{"type": "session.start", "data": {"x": 1}}, {"type": "session.model_change", "data": {"newModel": "m"}}, {"type": "user.message", "data": {"content": "go"}}, {"type": "assistant.message", "data": {"content": "sure", "outputTokens": 9, "toolRequests": [{"name": "bash", "toolCallId": "t", "arguments": {"command": "ls"}}]}}, {"type": "tool.execution_complete", "data": {"toolCallId": "t", "success": False, "error": {"message": "no"}}}]
    e = events("\n".join(map(json.dumps, copilot)))
    assert [x["kind"] for x in e] == ["meta", "meta", "user", "assistant", "call", "result"] and e[5]["text"] == "no" and e[5]["native_error"] and e[5]["tool_raw"] == "bash" and e[4]["model"] == "m"
    simple = [{"type": "user", "message": "a", "timestamp": "2026-01-01T00:00:00Z"}, {"type": "assistant", "message": "b"}]
    assert [(x["kind"], x["text"]) for x in events("\n".join(map(json.dumps, simple)))] == [("user", "a"), ("assistant", "b")]
    assert formats.told({"type": "x"}, "") is None


def test_files_of_formats(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"type": "user", "message": "a"}) + "\n")
    (tmp_path / "b.json").write_text(json.dumps({"messages": [{"type": "user", "content": "q"}], "sessionId": "g"}))
    got = {(r.corpus, r.kind, r.text) for r in readers.transcripts(spark, str(tmp_path)).collect()}
    assert got == {("simple_text", "user", "a"), ("gemini", "user", "q")}
    assert readers.unread(spark, str(tmp_path)).count() == 0


def test_lines_are_numbered_over_byte_ranges(spark, tmp_path):
    want = {}
    for name, n in (("x", 5000), ("y", 10)):
        rows = [f"{name} line {k} é" if k % 7 else "" for k in range(n)]
        (tmp_path / name).write_text("\n".join(rows))
        want |= {(name, k): r for k, r in enumerate(rows) if r}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = {(r.path.rsplit("/", 1)[-1], r.pos): r.line for r in readers.lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want


def test_sqlite_ranges(spark, tmp_path):
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as con:
        con.execute("create table t (a integer, b text)")
        con.executemany("insert into t values (?, ?)", [(k, f"v{k}") for k in range(100)])
        con.execute("delete from t where a between 20 and 60")
        con.execute("create view w as select a from t")
        con.execute("create table none (a integer)")
    spark.dataSource.register(readers.SQLiteSource)
    load = lambda name: spark.read.format("sqlite").option("path", path).option("dbtable", name).load()
    assert sorted(r.a for r in load("t").collect()) == [k for k in range(100) if not 20 <= k <= 60]
    assert load("w").count() == 59 and load("none").count() == 0


def test_sidecars(spark, tmp_path):
    rows = [{"toolUseResult": {"file": {"numLines": 7}}, "message": {"content": [{"type": "text"}, {"type": "tool_result", "tool_use_id": "c1"}]}}, {"toolUseResult": {"file": {"numLines": 9}}, "message": {"content": [{"type": "tool_result", "tool_use_id": "c1"}]}}, {"toolUseResult": {"file": {"numLines": True}}, "message": {"content": [{"type": "tool_result", "tool_use_id": "c2"}]}}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)) + '\n{"numLines" broken')
    assert [(r.call_id, r.lines) for r in readers.shown_line_counts(spark, str(tmp_path)).collect()] == [("c1", 7)]
    sessions = spark.createDataFrame([("a", 1, 2, None, 4, 5), ("b", 1, 2, 3, 4, 5)], "session_id string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, api_call_count long")
    logs = spark.createDataFrame([("a", '{"token_usage": {"x": 1}}'), ("b", "{}")], "session_id string, session_metadata_raw string")
    got = {r.session_id: tuple(r)[1:] for r in readers.session_tallies(sessions, logs).collect()}
    assert got == {"a": (5, 1, 0, 4, 2), "b": (None,) * 5}


@pytest.mark.parametrize(("command", "body", "want"), [("false", "", "false"), ("grep x f", "(no output)", "grep_no_lines"), ("grep -q x f", "", None), ("grep x f", "grep: f: No such file or directory", "grep_missing"), ("pytest -q", "no tests ran in 0.01s", "pytest_no_tests"), ("pytest --lf", "no tests ran in 0.01s", None), ("cat f", "cat: f: No such file or directory", "cat_missing"), ("python a.py", '  File "a.py", line 1\n    x = (\n        ^\nSyntaxError: was never closed', "python_syntax"), ("cd a && ls b", "ls: cannot access 'b': No such file or directory", "ls_missing")])
def test_implied_failures(command, body, want):
    assert replay.implied_failure(replay.words(command), body) == want


def test_report(spark, tmp_path, capsys):
    turn = lambda n, role, **more: {"turn_id": f"s:{n}", "session_id": "s", "turn_number": n, "role": role, "uuid": f"u{n}", "parent_uuid": f"u{n - 1}" if n > 1 else None, "timestamp": f"2026-01-01T00:00:{n:02d}.000Z", "source": "swarm"} | more
    turns = [turn(1, "user", content="go"), turn(2, "tool_use", tool_call_id="a", tool_name="Bash", content='{"command": "echo hi"}', command="echo hi", tool_input_json='{"command": "echo hi"}'), turn(3, "tool_result", tool_call_id="a", tool_name="Bash", content="ho\n"), turn(4, "tool_use", tool_call_id="b", tool_name="Bash", content='{"command": "echo hi"}', command="echo hi", tool_input_json='{"command": "echo hi"}'), turn(5, "tool_result", tool_call_id="b", tool_name="Bash", content="hi\n")]
    path = tmp_path / "t.jsonl"
    path.write_text("\n".join(map(json.dumps, turns)))
    assert report.main([str(path)]) == 1
    out = capsys.readouterr().out
    assert "CONTRADICTED" in out and "SUPPORTED" in out and "exit 1" in out and "echo hi" in out
    assert report.main([str(path), "--json"]) == 1
    assert len(json.loads(capsys.readouterr().out)["calls"]) == 2
    assert report.main([str(tmp_path / "absent")]) == 2
