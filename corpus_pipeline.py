"""The corpus pipeline: quality, toxicity, near duplicates, mixing and packing, each stage written before the next reads it.

Stages handle nulls in any column, empty and very long texts, ties, repeated rows, empty tables and columns of any name as
their operators do: a null text is empty, a null id is an id like others, a null source is a source of its own. A stage
begins by deleting the intermediate tables of this thread that its docs don't read, as the one before has been stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import mixing, packing, quality, simhash, toxicity
from tracelode.llm.common import release_unread, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of label quality = 1 reaches the threshold; null and empty texts are scored, too, and repeated rows alike."""
    release_unread(docs)
    model = quality.fit_tables(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.where(quality.score(model, F.col("text"), spark) >= quality.THRESHOLD)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of label toxic = 1 stays below the threshold; null and empty texts are scored, too, and repeated rows alike."""
    release_unread(docs)
    model = toxicity.fit_tables(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(model, F.col("text"), spark) < toxicity.THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id: five-word shingles, similarity 0.8 or more. Texts without words are one group."""
    release_unread(docs)
    return simhash.keep_one_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts, and runs of their words, as often as the mix takes them; texts without words aren't taken."""
    release_unread(docs)
    return mixing.mixed_rows(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every mixed row, its text included, with its length bucket, batch and slot; texts without words have length 0."""
    release_unread(docs)
    return packing.packed_rows(docs)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near duplicates", drop_copies),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: SQL has no classifier to fit; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
