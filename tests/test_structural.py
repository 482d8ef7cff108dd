import copy

import pytest
from pyspark.sql import functions as F

from tracelode import schema
from tracelode.operators import structural


def session(calls=3, source="swarm"):
    turns = [{"role": "user", "turn_type": "user_prompt", "content": "go"}]
    for c in range(calls):
        turns += [{"role": "assistant", "turn_type": "assistant_response"}, {"role": "tool_use", "turn_type": "tool_use", "tool_call_id": f"c{c}", "tool_name": "Bash"}, {"role": "tool_result", "turn_type": "tool_result", "tool_call_id": f"c{c}", "tool_name": "Bash"}]
    for k, t in enumerate(turns):
        t |= {"session_id": "s", "turn_number": k + 1, "turn_id": f"s:{k + 1}", "uuid": f"u{k + 1:03d}", "parent_uuid": f"u{k:03d}" if k else None, "timestamp": f"2026-10-04T03:00:{k:02d}.000+00:00", "source": source}
    return turns


def judged(spark, turns):
    rows = [{f.name: t.get(f.name) for f in schema.TURN} | {"key": "s", "pos": k} for k, t in enumerate(turns)]
    full = schema.TURN.add("key", "string").add("pos", "long") if "key" not in schema.TURN.names else schema.TURN
    df = spark.createDataFrame([tuple(r[f.name] for f in full) for r in rows], full)
    return {r.call_id: r for r in structural.verdicts(df).collect()}


@pytest.fixture(autouse=True)
def _plain_schema(monkeypatch):
    monkeypatch.setattr(schema, "TURN", copy.deepcopy(schema.TURN))


def test_intact(spark):
    got = judged(spark, session())
    assert {k: v.reason for k, v in got.items()} == {f"c{i}": "ok:structure_intact" for i in range(3)}


def test_deleted_call(spark):
    t = session()
    del t[5]
    got = judged(spark, t)
    assert got["c1"].reason == "violation:orphan_result"
    assert set(got["c1"].rules) == {"orphan_result", "parent_chain_break", "turn_number_gap"}
    assert got["c0"].reason == "abstain:session_structure_broken"


def test_deleted_result(spark):
    t = session()
    del t[6]
    assert judged(spark, t)["c1"].reason == "violation:missing_result"


def test_truncated_end(spark):
    got = judged(spark, session()[:-1])
    assert got["c2"].reason == "missing:result_truncated_at_end"
    assert got["c0"].reason == "ok:structure_intact"


def test_result_before_its_call(spark):
    t = session()
    t[6]["timestamp"] = "2026-10-04T03:00:04.500+00:00"
    got = judged(spark, t)
    assert got["c1"].rules == ["timestamp_regression"] and got["c2"].verdict == "unconstrained"


def test_duplicate_id(spark):
    t = session()
    for k in (8, 9):
        t[k]["tool_call_id"] = "c1"
    assert "duplicate_call_id" in judged(spark, t)["c1"].rules


def test_reparented_result(spark):
    t = session()
    t[6]["parent_uuid"] = "u002"
    assert judged(spark, t)["c1"].reason == "violation:parent_chain_break"


def test_unblamed_break(spark):
    t = session()
    t[4]["parent_uuid"] = "u001"
    got = judged(spark, t)
    assert got["__session__"].reason == "violation:parent_chain_break"
    assert got["c0"].reason == "abstain:session_structure_broken"


def test_other_harness(spark):
    assert {v.reason for v in judged(spark, session(source="other")).values()} == {"abstain:unvalidated_harness"}


def test_stamps(spark):
    df = spark.createDataFrame([("2026-10-04T03:00:01.123456789Z",), ("1700000000123",), ("2026-10-04 03:00:01",), ("bad",), (None,)], "t string")
    got = [r[0] for r in df.select(structural.seconds(F.col("t"))).collect()]
    assert got[0] == pytest.approx(1791082801.123456) and got[1] == pytest.approx(1700000000.123) and got[2] == 1791082801.0 and got[3:] == [None, None]
