"""Every stage keeps what it should, and the whole gives the last stage's rows."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near duplicates", "mixing", "packing"]
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0 and counts[5] == counts[4]
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names go through every stage."""
    real = spark.read.parquet(f"{SF}/documents.parquet").limit(30).collect()
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 1, "x", None) for r in real]
    odd = [(None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (901, "", "en", "s", 0, 1, "x", 2), (902, " \n", None, None, 2, 1, "x", 2), (903, "word " * 60_000, "en", "s", 300_000, 1, "x", 2), (904, "é" * 200_000, "en", None, 200_000, 1, "x", 2), (None, real[3].text, "en", "s", 1, 1, "x", 2)]
    docs = spark.createDataFrame(base + base[:5] + odd, "doc_id long, text string, lang string, source string, n_chars long, row int, all string, length int")
    columns, rows = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert docs.columns == columns
        if name in ("quality", "toxicity", "near duplicates"):
            assert docs.count() <= rows
            rows = docs.count()
        if name == "near duplicates":
            assert docs.where("text is null or trim(text) = ''").count() <= 1
            assert docs.groupBy("text").count().where("count > 1").count() == 0


def test_toxic_and_clean_rows(spark):
    """A toxic document that is repeated, without id and with extra words around it goes each time; an empty text is no crash."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bad = docs.join(labels.where("toxic = 1").select("doc_id"), "doc_id").select(*docs.columns)
    kept = dict(corpus_pipeline.STAGES)["toxicity"](spark, bad.unionByName(bad).unionByName(docs.limit(0)), SF)
    assert kept.count() % 2 == 0 and kept.count() < bad.count()
