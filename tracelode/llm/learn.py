"""Bounded samples of labelled texts, and fits that run in one executor task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_fold, release, written

#: Labelled texts of label 0 and 1 that a model is fitted on at most: those with the smallest seeded hashes.
PER_CLASS = (3000, 3000)
#: Their UTF-8 bytes in all. A text of over a 128th of that would take the place of many and isn't drawn.
TEXT_BYTES = 32_000_000
#: Bytes of a model at most, which the driver receives and broadcasts.
MODEL_BYTES = 64_000_000


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, kept_out: int, per_class: tuple[int, int] = PER_CLASS, text_bytes: int = TEXT_BYTES, seed: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y, usual) rows to learn from: labelled documents outside the held-out fold, one row an id.

    Of each class come the per_class ids with the smallest seeded hashes and, of those, whole texts in that
    order as long as a class stays within half of text_bytes. usual is the share of label 1 among
    all labels outside the fold, the only number that comes to the driver. An id that is labelled more than
    once has its highest label, one that is in docs more than once its least text; null ids and labels, and
    labels other than 0 and 1, count as none; a null text is empty. The sample is bounded in rows and in
    bytes, whatever the tables hold.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
    own = own.where(F.col("y").isin(0, 1) & F.col("id").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))
    own = own.where(crc_fold(F.col("id"), folds) != kept_out)
    usual = own.agg(F.avg("y")).first()[0]
    h, picked = F.xxhash64("id", F.lit(seed)), None
    for k in (0, 1):
        some = own.where(F.col("y") == k).orderBy(h, "id").limit(per_class[k])
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    found = written(found.withColumn("n", F.octet_length("text")).where(F.col("n") <= text_bytes // 128), "labelled")
    so_far = F.sum("n").over(Window.partitionBy("y").orderBy(h, "id"))
    within = found.select("id", "n", "y").withColumn("so_far", so_far).where(F.col("so_far") <= text_bytes // 2)
    return found.join(F.broadcast(within.select("id")), "id", "left_semi").select("id", "text", "y", F.lit(usual).cast("double").alias("usual"))


def fitted(rows: DataFrame, fit: Callable):
    """What fit(texts, labels, usual) makes of rows(id, text, y, usual) in one executor task: texts never reach the driver.

    The model comes back through the shared folder; a lost executor costs the fit again. Without rows,
    fit gets empty lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, usual = [], [], None
        for b in batches:
            texts += b.column(1).to_pylist()
            labels += b.column(2).to_pylist()
            usual = b.column(3)[0].as_py() if len(b) else usual
        if texts:
            yield pa.record_batch([pa.array([pickle.dumps(fit(texts, labels, usual), 5)], pa.binary())], names=["model"])

    made = written(rows.repartition(1).sortWithinPartitions("id").mapInArrow(run, "model binary"), "model")
    size = made.agg(F.max(F.octet_length("model"))).first()[0]
    if size is None:
        return fit([], [], None)
    if size > MODEL_BYTES:
        raise ValueError(f"a model of {size} bytes is not broadcast")
    model = pickle.loads(made.first().model)
    release(made)
    return model
