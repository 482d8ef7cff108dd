"""Shared pieces of the training-data operators: tables, text rules and written intermediate results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import release, release_unread, running, shared_folder, written

__all__ = ["WORD", "crc_fold", "nth_copy", "release", "release_unread", "running", "shared_folder", "table", "word_count", "wrapped", "written"]

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words as a long; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key's decimal text, modulo folds; a null key falls in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(0))


def wrapped(df: DataFrame, name: str = "row") -> Column:
    """All columns of df as one struct, so that no name of theirs meets one that an operator uses inside."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias(name)


def nth_copy(df: DataFrame, key: list[str], row: str) -> DataFrame:
    """df with `copy`: 0, 1, ... among rows that are equal in the key columns, in order of the row id.

    row is a monotonically increasing id, whose upper bits name the task that gave it. Copies
    are numbered inside their task, and a row for each key and task gives the offsets, so
    that no task holds all copies. Keys that are there once cost a count.
    """
    named = df.withColumn("key", F.xxhash64(*key))
    several = written(named.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "copies")
    if several.isEmpty():
        return df.withColumn("copy", F.lit(0).cast("long"))
    once = named.join(several, "key", "left_anti").withColumn("copy", F.lit(0).cast("long"))
    more = named.join(several, "key", "left_semi").withColumn("task", F.shiftright(row, 33))
    up = Window.partitionBy("key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = more.groupBy("key", "task").agg(F.count("*").alias("n")).select("key", "task", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("key", "task").orderBy(row)) - 1
    more = more.withColumn("inside", inside).join(offsets, ["key", "task"]).withColumn("copy", F.col("inside") + F.col("offset"))
    return once.select(*df.columns, "copy").unionByName(more.select(*df.columns, "copy"))
