import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode import schema
from tracelode.functions import ids, text
from tracelode.operators import claims, grammar, ledger, pairing, scoring, stats
from tracelode.sources import readers, sinks


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


def test_stamps_and_tools(spark):
    assert one(spark, text.iso, "2026-10-04 03:00:01+00:00") == "2026-10-04T03:00:01Z"
    assert one(spark, text.iso, "1700000000123") == "2023-11-14T22:13:20.123Z" and one(spark, text.iso, "") is None
    assert [one(spark, text.normalize_tool, x) for x in ("Bash", "mcp__x__bash", "MultiEdit", "Odd")] == ["shell", "shell", "edit", "odd"]
    assert one(spark, text.error_marker, "exitcode: 0 (ok)") is None and one(spark, text.error_marker, "x\nExit Code: 3") == "gemini_exit_code_nonzero"


def test_text_counts(spark):
    got = one(spark, text.text_counts, "Hello world don't 12 abcdefghijklmnopqrs!!!\n\nx deadbeef1234567890 é")
    assert (got.words, got.word_excess, got.long_chars, got.digits, got.punct_runs, got.punct_chars, got.nl_runs, got.nonascii, got.hexlike) == (8, 15, 19, 12, 1, 3, 1, 1, 18)
    empty = one(spark, text.text_counts, None)
    assert set(empty) == {0.0}


def test_masks_and_keys(spark):
    masked = one(spark, text.mask_volatile, "at 2026-01-02T03:04:05Z pid 12 in /tmp/x took 3.5 ms, 2 hours ago 0xdeadbeef")
    assert masked == "at <V> <V> in <V> took <V>, <V> <V>"
    assert one(spark, text.normalize_command, "cd /a && cd 'b c' && ls  -l 2>&1 ") == "ls -l"
    assert one(spark, text.path_key, "/a//b/./c.txt/") == "b/c.txt" and one(spark, text.utf16_length, "a😀") == 3
    assert one(spark, text.ascending_run, "a1b2c3d4e5f60718") == 14 and one(spark, text.digest_defect, "a" * 63) == "hex_length_63"


def test_ids(spark):
    value = "req_01" + ids_encode((0x01901234ABCD << 80) | (7 << 76) | (2 << 62) | 5)
    assert one(spark, ids.embedded_ms, value) == float(0x01901234ABCD)
    assert one(spark, ids.embedded_ms, "01901234-abcd-7abc-8def-0123456789ab") == float(0x01901234ABCD)
    assert one(spark, ids.id_family, "resp_" + "0" * 50) == "openai_resp_hex50" and one(spark, ids.embedded_ms, "zzz") is None


def ids_encode(x):
    out = ""
    while x:
        x, r = divmod(x, 58)
        out = ids.BASE58[r] + out
    return out.rjust(22, "1")


def test_pairing_truth_table(spark):
    kinds = [("call", "c1"), ("result", "c1"), ("call", "c1"), ("result", "c1"), ("result", "c1"), ("result", "x"), ("result", "c9"), ("call", "c9"), ("result", None)]
    df = spark.createDataFrame([("s", i, k, c) for i, (k, c) in enumerate(kinds)], "session_id string, seq long, kind string, call_id string")
    assert sorted((r.call_seq, r.result_seq, r.n_results) for r in pairing.pair_calls(df).collect()) == [(0, 1, 1), (2, 3, 2), (7, None, 0)]
    assert sorted(r.seq for r in pairing.orphans(df).collect()) == [5, 6, 8]
    assert sorted(r.call_key for r in pairing.call_keys(df).collect()) == ["c1@0", "c1@2", "c9"]


def test_special_functions():
    assert stats.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.beta_cdf(0.5, 2, 3) == pytest.approx(0.6875) and stats.clopper_pearson_upper(0, 10) == pytest.approx(1 - 0.05**0.1, abs=1e-9)


def test_cluster_rate_is_partition_free(spark):
    rng = np.random.default_rng(0)
    rows = [(int(s), int(rng.random() < 0.3)) for s in rng.integers(0, 60, 2000)]
    df = spark.createDataFrame(rows, "s long, y int")
    a = stats.cluster_rate(df.repartition(1), "s", F.col("y"), F.lit(1)).first()
    b = stats.cluster_rate(df.repartition(7), "s", F.col("y"), F.lit(1)).first()
    assert a == b and a.lo < a.rate < a.hi and 0.2 < a.rate < 0.4 and a.n_clusters == 60


def test_huber_and_ledger_fit(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    y = 2 * x + 1 + rng.normal(scale=0.1, size=300)
    y[:10] += 50
    df = spark.createDataFrame(list(zip(map(float, x), map(float, y))), "x double, y double")
    assert np.allclose(stats.huber(df, ["x"], "y"), [2, 1], atol=0.3)
    w = df.withColumn("intercept", F.lit(1.0))
    coef = ledger.fit(w, ("intercept", "x"), "y", keep=0.95)
    assert coef["x"] == pytest.approx(2, abs=0.05) and coef["intercept"] == pytest.approx(1, abs=0.05)


def test_allocation_and_draw(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 2)], "cell string, n long")
    got = {r.cell: r.alloc for r in scoring.allocate(sizes, 50).collect()}
    assert sum(got.values()) == 50 and got["c"] == 2 and got["b"] >= 5


def test_grammar(spark):
    cases = [("ls -la", "total 4\ndrwxr-xr-x 1 a b 4096 Oct  4 02:44 x\n-rw-r--r-- 1 a b 1 Oct  4 02:44 y\n-rw-r--r-- 1 a b 1 Oct  4 02:44 z", ["ls_all_missing_dotdirs"]), ("head -2 f", "a\nb\nc", ["line_cap"]), ("cat -n f", "     1\ta\n     3\tb\n     4\tc", ["line_numbering"]), ("grep foo f", "a foo\nbar", ["grep_match"]), ("grep -i FOO f", "a foo", []), ("find . -name '*.py'", "./a.py\n./b.txt", ["find_name"]), ("git log --oneline", "abc1234 x\nnot a row", ["git_oneline_format"]), ("ls | head -n 1", "a\nb", []), ("pytest -q", "....... [100%]\n2 passed in 1.0s", ["pytest_count"])]
    df = spark.createDataFrame([(i, c, o) for i, (c, o, _) in enumerate(cases)], "i int, c string, o string")
    got = {r.i: r.b for r in df.select("i", grammar.violations(F.col("c"), F.col("o"))[0].alias("b")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}
    d = spark.createDataFrame([("a 1\nb", "a 2\nb")], "r string, c string").select(grammar.delta("r", "c").alias("d")).first().d
    assert d.numbers_changed == ["1->2"] and 0 < d.ratio < 1 and not d.only_space


def test_claims(spark):
    c = spark.createDataFrame([(1, "s", 5, "/f", 3), (2, "s", 9, "/f", 3), (3, "t", 1, "/f", 3)], "claim_id long, session_id string, pos long, path string, lines long")
    views = spark.createDataFrame([("s", 2, "/f", 3), ("s", 8, "/f", 4)], "session_id string, pos long, path string, lines long")
    changes = spark.createDataFrame([("s", 7, "/f")], "session_id string, pos long, path string")
    assert {r.claim_id: r.reason for r in claims.line_counts(c, views, changes).collect()} == {1: "ok:lines", 2: "violation:lines", 3: "missing:no_view"}
    full = "0123456789abcdef" * 4
    d = spark.createDataFrame([(1, "s", 5, "9f8e7d6c5b4a39281706f5e4d3c2b1a0"), (2, "s", 5, "9f8e7d6c5b"), (3, "s", 5, "a" * 63)], "claim_id long, session_id string, pos long, digest string")
    shown = spark.createDataFrame([("s", 2, "9f8e7d6c5b4a3928"), ("s", 7, full)], "session_id string, pos long, digest string")
    assert {r.claim_id: r.reason for r in claims.digest_claims(d, shown).collect()} == {1: "ok:digest", 2: "ok:digest", 3: "violation:hex_length_63"}
    runs = spark.createDataFrame([("s", 1, "all", False), ("s", 3, "one", True)], "session_id string, pos long, scope string, passed boolean")
    q = spark.createDataFrame([(1, "s", 5, "all"), (2, "s", 5, "one"), (3, "s", 5, "x"), (4, "z", 5, "x")], "claim_id long, session_id string, pos long, scope string")
    assert {r.claim_id: r.reason for r in claims.check_scope(q, runs).collect()} == {1: "violation:check_failed", 2: "ok:check", 3: "violation:check_substituted", 4: "missing:no_check"}


def test_readers(spark, tmp_path):
    turns = [{"turn_id": "s:1", "session_id": "s", "turn_number": 1, "role": "user", "turn_type": "user_prompt", "content": "go", "timestamp": "2026-10-04T03:00:00Z"}, {"turn_id": "s:2", "session_id": "s", "turn_number": 2, "role": "tool_use", "turn_type": "tool_use", "tool_call_id": "c", "tool_name": "Bash", "tool_input_json": {"command": "ls"}, "timestamp": 1700000000000}, {"turn_id": "s:3", "session_id": "s", "turn_number": 3, "role": "tool_result", "turn_type": "tool_result", "tool_call_id": "c", "content": "x"}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, turns)) + "\n\n")
    (tmp_path / "b.json").write_text(json.dumps(turns))
    got = readers.turns_jsonl(spark, str(tmp_path / "a.jsonl"))
    assert [r.tool_input_json for r in got.orderBy("pos").collect()] == [None, '{"command":"ls"}', None]
    assert readers.turns_array(spark, str(tmp_path / "b.json")).count() == 3
    events = readers.turns_to_events(got).orderBy("seq").collect()
    assert [(e.kind, e.tool, e.call_id, e.text) for e in events] == [("user", None, None, "go"), ("call", "shell", "c", None), ("result", "shell", "c", "x")]
    assert schema.violations(readers.turns_to_events(got)).first().asDict() == {"bad_kind": 0, "bad_ts_kind": 0, "calls_without_id": 0, "broken_sessions": 0}
    (tmp_path / "bad.jsonl").write_text('{"role": "user"}\n{oops\n')
    with pytest.raises(Exception, match="not JSON"):
        readers.turns_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    with pytest.raises(ValueError, match="held-out"):
        readers.guarded("/x/test/part")


def test_transcripts(spark, tmp_path):
    claude = [{"type": "user", "uuid": "1", "sessionId": "s", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": "hi"}}, {"type": "assistant", "uuid": "2", "parentUuid": "1", "sessionId": "s", "message": {"id": "m", "role": "assistant", "content": [{"type": "thinking", "thinking": "hmm"}, {"type": "tool_use", "id": "t", "name": "Bash", "input": {"command": "ls"}}], "usage": {"input_tokens": 1, "output_tokens": 2}}}, {"type": "user", "uuid": "3", "sessionId": "s", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t", "content": [{"type": "text", "text": "out"}], "is_error": False}]}}]
    codex = [{"type": "session_meta", "timestamp": "t", "payload": {"id": "z"}}, {"type": "response_item", "timestamp": "t", "payload": {"type": "function_call", "call_id": "k", "name": "shell", "arguments": '{"command": ["ls", "-l"]}'}}, {"type": "response_item", "timestamp": "t", "payload": {"type": "function_call_output", "call_id": "k", "output": "o"}}]
    atif = {"schema_version": "1", "session_id": "q", "agent": {"model_name": "m"}, "steps": [{"step_id": 1, "source": "agent", "message": "a", "tool_calls": [{"tool_call_id": "w", "function_name": "bash", "arguments": {"command": "pwd"}}], "observation": {"results": [{"source_call_id": "w", "content": "/"}]}}]}
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, [*claude, claude[0]])) + '\n{"cut')
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, codex)))
    (tmp_path / "c.json").write_text(json.dumps(atif))
    rows = readers.transcripts(spark, str(tmp_path)).orderBy("session_id", "seq").collect()
    assert [(r.session_id, r.kind, r.tool, r.command, r.text) for r in rows] == [("q", "assistant", None, None, "a"), ("q", "call", "shell", "pwd", None), ("q", "result", None, None, "/"), ("s", "user", None, None, "hi"), ("s", "call", "shell", "ls", None), ("s", "result", "shell", None, "out"), ("z", "call", "shell", "ls -l", None), ("z", "result", "shell", None, "o")]
    assert schema.violations(readers.transcripts(spark, str(tmp_path))).first().broken_sessions == 0


def test_sqlite_and_sinks(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "d.db")
    con.execute("create table items (row_id integer, name text)")
    con.executemany("insert into items values (?, ?)", [(i, f"n{i}") for i in range(25)])
    con.commit()
    con.close()
    spark.dataSource.register(readers.SQLiteSource)
    df = spark.read.format("sqlite").option("path", str(tmp_path / "d.db")).option("dbtable", "items").load()
    assert sorted(map(tuple, df.collect())) == [(i, f"n{i}") for i in range(25)]
    sinks.verdicts_jsonl(spark.createDataFrame([("s", None, 0.12345678)], "session_id string, rule string, confidence double"), str(tmp_path / "v"))
    assert [r.value for r in spark.read.text(str(tmp_path / "v")).collect()] == ['{"session_id":"s","rule":null,"confidence":0.123457}']
    r = sinks.report({"t": df.groupBy().count()})
    assert r["t"] == [{"count": 25}] and len(r["sha256"]) == 64 and sinks.markdown(r["t"]).startswith("| count |") and sinks.exit_status({"contradicted": 1}) == 1
    secret = spark.createDataFrame([("ghp_" + "a" * 36, None)], "text string, args string").withColumns({"command": F.lit(None).cast("string"), "stderr": F.lit(None).cast("string")})
    out, counts = readers.redacted(secret)
    assert out.first().text == "[github_token]" and [tuple(x) for x in counts.collect()] == [("text", "github_token", 1)]


def test_long_first_lines_are_told(spark, tmp_path):
    pad = "x" * 10_000
    user = {"type": "user", "uuid": "1", "sessionId": "s", "message": {"role": "user", "content": "hi"}}
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, [{"type": "session_meta", "payload": {"instructions": pad, "id": "z"}}, {"type": "response_item", "payload": {"type": "message", "role": "user", "content": "go"}}])))
    (tmp_path / "b.json").write_text(json.dumps({"notes": pad, "steps": [{"source": "user", "message": "do"}], "schema_version": "1", "session_id": "q"}, indent=1))
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, [{"type": "summary", "summary": pad}, user])))
    (tmp_path / "d.txt").write_text("no transcript")
    assert sorted((r.session_id, r.text) for r in readers.transcripts(spark, str(tmp_path)).collect()) == [("q", "do"), ("s", "hi"), ("z", "go")]
    assert [(r.path.rsplit("/", 1)[-1], r.format) for r in readers.unread(spark, str(tmp_path)).collect()] == [("d.txt", "unknown")]


def test_long_outputs_are_compared_by_character():
    real = "\n".join(f"line {k} of the output, value 1" for k in range(70))
    assert len(real) ** 2 > 4_000_000 and grammar.difference(real, real.replace("value 1", "value 2"))["ratio"] > 0.9
