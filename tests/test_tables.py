"""Tables that are still read stay, however the shared folder is spelled."""

import pytest

from tracelode import tables


@pytest.mark.parametrize("spelled", ["file:{}", "file://{}", "{}", "{}/", "{}//inner", "{}/a b%20é"])
def test_a_table_that_is_read_is_not_released(spark, tmp_path, monkeypatch, spelled):
    monkeypatch.setattr(tables, "shared_folder", lambda _: spelled.format(tmp_path))
    other, kept = tables.written(spark.range(3), "other"), tables.written(spark.range(4), "kept")
    tables.release_unread(kept)
    assert kept.count() == 4
    assert [p.name.split("-")[0] for p in tmp_path.rglob("*-*") if p.is_dir()] == ["kept"]
    tables.release(kept)
