"""Packs with their meta last, and summaries of sessions."""

import json

import pytest

from tracelode import schema
from tracelode.sources import sinks


def events(spark, n):
    rows = [tuple((dict.fromkeys(schema.EVENT.names) | {"corpus": f"c{k % 2}", "session_id": f"s{k % 3}", "seq": k, "kind": "user"})[f] for f in schema.EVENT.names) for k in range(n)]
    return spark.createDataFrame(rows, schema.EVENT)


def test_pack_is_whole_only_with_its_meta(spark, tmp_path):
    path = f"file://{tmp_path}/pack"
    meta = sinks.packed(events(spark, 12), path)
    assert meta["corpora"]["c0"] == {"rows": 6, "sessions": 3} and sinks.whole_pack(spark, path) == meta
    assert spark.read.parquet(path).count() == 12
    (tmp_path / "pack" / "_META.json").unlink()
    with pytest.raises(Exception):
        sinks.whole_pack(spark, path)
    assert sinks.packed(events(spark, 4), path)["corpora"]["c1"]["rows"] == 2


def test_session_summary(spark, tmp_path):
    v = spark.createDataFrame([("s", "a", "x", "supported"), ("s", "a", "y", "contradicted"), ("s", "b", "x", "unconstrained")], "session_id string, call_key string, check string, verdict string")
    sinks.session_summary(v, str(tmp_path / "o"))
    got = json.loads(spark.read.text(str(tmp_path / "o")).first().value)
    assert got == {"session_id": "s", "calls": 2, "contradicted": 1, "supported": 1, "unconstrained": 1, "checks": ["x", "y"]}
