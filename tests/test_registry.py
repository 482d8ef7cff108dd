import pytest
from pyspark.sql import functions as F

from tracelode import schema
from tracelode.operators import registry, scoring


def test_gate_fill_and_compose(spark):
    rows = []
    for s, with_text in (("a", True), ("b", False)):
        for i, (kind, cid) in enumerate([("call", "x"), ("result", "x"), ("call", "y"), ("result", "y")]):
            r = dict.fromkeys(schema.EVENT.names) | {"session_id": s, "seq": i, "kind": kind, "call_id": cid, "ts_kind": "none", "text": "Exit code 1" if with_text and kind == "result" else None}
            rows.append(tuple(r[n] for n in schema.EVENT.names))
    events = spark.createDataFrame(rows, schema.EVENT)
    none = F.lit(None)
    said = lambda e, verdict, reason: e.where("kind = 'call' and call_id = 'x'").select("session_id", F.col("call_id").alias("call_key"), F.lit(verdict).alias("verdict"), F.lit(reason).alias("reason"), F.lit(0.9).alias("confidence"), F.lit(True).alias("localized"), F.array(F.struct(F.col("seq").alias("seq"), F.lit("text").alias("field"), F.lit("subject").alias("role"), none.cast("string").alias("value"))).alias("evidence"))
    checks = registry.Checks()
    checks.register(registry.Check("one", "1", "identity", "identity", ("result.text", "error.marker"), lambda e: said(e, "contradicted", "violation:one")))
    checks.register(registry.Check("two", "1", "statistical", "statistical", (), lambda e: said(e, "supported", "ok:two")))
    with pytest.raises(ValueError):
        checks.register(registry.Check("two", "1", "identity", "identity", (), None))
    got = checks.run(events)
    by = {(r.session_id, r.call_key, r.check): r.reason for r in got.collect()}
    assert len(by) == 8 and by["a", "x", "one"] == "violation:one" and by["b", "x", "one"] == "missing:capability" and by["a", "y", "two"] == "abstain:not_decided"
    assert set(registry.broken_contracts(got).first()) == {0}
    calls = got.select("session_id", "call_key").distinct()
    final = {(r.session_id, r.call_key): (r.verdict, r.rule, r.reason, r.disagreement, r.blame_seq) for r in scoring.compose(calls, got, ["session_id", "call_key"]).collect()}
    assert final == {("a", "x"): ("contradicted", "one", "violation:one", True, 0), ("b", "x"): ("supported", "two", "ok:two", False, None), ("a", "y"): ("unconstrained", None, "abstain:not_decided", False, None), ("b", "y"): ("unconstrained", None, "abstain:not_decided", False, None)}


def test_change_points_can_be_significant(spark):
    from tracelode.plans import aggregates

    rows = [("s", i, "result", float(i >= 20) * 100 + i % 3) for i in range(40)]
    got = aggregates.change_points(spark.createDataFrame(rows, "session_id string, seq long, kind string, value double")).first()
    assert got.p <= 0.01
