"""Every perturbation plans, changes only the fields that it names, and leaves a log whose order is whole."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracelode import schema
from tracelode.operators import attacks

FIELD_COLUMNS = {"ts": {"ts"}, "order": set(), "request_id": {"request_id"}, "text": {"text", "stderr"}, "error": {"native_error", "stderr"}, "args": {"args", "command", "tool"}, "usage": {"usage_out"}, "tool": {"tool", "tool_raw"}}


@pytest.fixture(scope="module")
def events(spark):
    rows, t0 = [], datetime(2026, 1, 5, 10)
    for s in range(5):
        at, seq = t0 + timedelta(minutes=11 * s), 0
        for k in range(8):
            at += timedelta(seconds=7 + k)
            tool = ("shell", "read", "gui")[k % 3]
            text = f"line {s}{k}\nsecond {k % 4}\nthird\nend" if k != 5 else "no digits"
            for kind, extra in (("assistant", {"usage_in": 10 * k, "usage_out": 30, "text": "say"}), ("call", {"call_id": f"c{s}-{k}", "tool": tool, "tool_raw": tool, "args": f'{{"a":{k}}}', "command": f"cmd {k % 2}"}), ("result", {"call_id": f"c{s}-{k}", "tool": tool, "text": text, "native_error": (s + k) % 2 == 0, "stderr": "e"})):
                at += timedelta(seconds=2)
                row = dict.fromkeys(schema.EVENT.names) | {"corpus": "x", "session_id": f"s{s}", "seq": seq, "kind": kind, "ts": at.isoformat(timespec="milliseconds") + "Z", "ts_kind": "event", "uuid": f"u{s}-{seq}"}
                if kind != "result":
                    row["request_id"] = f"r{s}-{k}"
                rows.append(tuple((row | extra)[n] for n in schema.EVENT.names))
                seq += 1
    return spark.createDataFrame(rows, schema.EVENT).cache()


@pytest.mark.parametrize("name", [n for n, (params, _) in attacks.ATTACKS.items() if params])
def test_plans_and_applies(events, name):
    params, fields = attacks.ATTACKS[name]
    plans = attacks.targets(events, name).cache()
    got = {(r.param, r.n) for r in plans.groupBy("param").agg(F.count("*").alias("n")).collect()}
    assert {p for p, _ in got} == set(params) and all(0 < n <= 5 for _, n in got)
    assert plans.select("plan_id").distinct().count() == plans.count()
    copies = attacks.apply(events, plans, name).cache()
    broken = copies.groupBy("plan_id").agg(F.min("seq").alias("a"), F.max("seq").alias("b"), F.count("*").alias("n"), F.countDistinct("seq").alias("d"))
    assert broken.where("a <> 0 or b + 1 <> n or d <> n").count() == 0
    foot = attacks.footprint(events, copies).collect()
    assert len(foot) == plans.count()
    if name.startswith("delete"):
        assert all(f.removed == 2 and f.added == 0 for f in foot)
    elif name.startswith("insert"):
        assert all(f.added == 2 and f.removed == 0 for f in foot)
    else:
        assert all(f.added == f.removed == 0 and f.changed > 0 for f in foot)
        allowed = set().union(*[FIELD_COLUMNS[x] for x in fields])
        one = plans.select("plan_id").first().plan_id
        own = {r.seq: r for r in events.where(F.col("session_id") == plans.where(F.col("plan_id") == one).first().session_id).collect()}
        for r in copies.where(F.col("plan_id") == one).collect():
            off = {c for c in schema.EVENT.names if r[c] != own[r.seq][c]}
            assert off <= allowed, (name, off)


def test_values(events):
    own = {(r.session_id, r.seq): r for r in events.collect()}
    plans = attacks.targets(events, "sub_single_digit")
    for r in attacks.apply(events, plans, "sub_single_digit").join(plans.select("plan_id", F.col("target").alias("seq")), ["plan_id", "seq"]).collect():
        before = own[r.session_id, r.seq].text
        at = max(i for i, c in enumerate(before) if c.isdigit())
        assert r.text == before[:at] + str((int(before[at]) + 1) % 10) + before[at + 1 :]
    plans = attacks.targets(events, "time_result_early").where("param = '300'")
    for r in attacks.apply(events, plans, "time_result_early").join(plans.select("plan_id", F.col("target").alias("seq"), "called"), ["plan_id", "seq"]).collect():
        assert r.called < r.ts < own[r.session_id, r.seq].ts
    plans = attacks.targets(events, "sub_single_flip_error").select("plan_id", "session_id", "target", "error", "donor")
    assert all(r.donor.error != r.error and r.donor.session_id != r.session_id for r in plans.collect())
    plans = attacks.targets(events, "id_splice_foreign").select("session_id", "other")
    assert all(not r.other.startswith("r" + r.session_id[1:] + "-") for r in plans.collect())
    assert attacks.attack_class("reorder_lines") == "exec" and attacks.attack_class("delete_pair") == "edit"
    with pytest.raises(ValueError):
        attacks.targets(events, "image_insert_screenshot")
