"""Tables that plans write on their way, and orders over whole tables in two levels."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints.

    Where none is named, as in local tests, a temporary folder is made once, set as the
    checkpoint folder and removed at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="tracelode-"))
        atexit.register(shutil.rmtree, _own_folder[0], True)
    spark.sparkContext.setCheckpointDir(_own_folder[0])
    return "file://" + _own_folder[0]


#: Paths of the tables that this thread has written and not released.
_held = threading.local()


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns a reader of the written files.

    Cuts the lineage: a lost executor costs a reread of the files, not the work behind
    them. The files go when they are released, else when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, system = _file(spark, path)
    system.deleteOnExit(place)
    _held.__dict__.setdefault("paths", set()).add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _file(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def release(*tables: DataFrame) -> None:
    """Deletes what written wrote, once nothing that is still to run reads it."""
    for t in tables:
        _delete(t.sparkSession, t.written_to)


def _delete(spark: SparkSession, path: str) -> None:
    place, system = _file(spark, path)
    system.delete(place, True)
    system.cancelDeleteOnExit(place)
    _held.__dict__.setdefault("paths", set()).discard(path)


def release_unread(df: DataFrame) -> None:
    """Deletes all tables that this thread has written and that df doesn't read: for steps that each begin with what the one before has stored elsewhere.

    A folder has many spellings (file:/x, file:///x, /x, //x, x) and input files are given with escapes, so both are
    compared by their qualified paths.
    """
    read = [unquote(urlsplit(f).path) for f in df.inputFiles()]
    for path in list(_held.__dict__.get("paths", ())):
        place, system = _file(df.sparkSession, path)
        folder = system.makeQualified(place).toUri().getPath() + "/"
        if not any(f.startswith(folder) for f in read):
            _delete(df.sparkSession, path)


def running(df: DataFrame, order: list[Column], sums: list[str] | tuple = (), name: str = "no") -> DataFrame:
    """df with name, each row's place from 0 in the order, and `<c>_before` for each c in sums: the sum of c over the rows before it.

    Rows are dealt by ranges of the order and numbered inside each range; a row for each
    range, as many as the session has shuffle partitions, gives the offsets. So no task holds all
    rows. Rows that are equal in the order lie in one range.
    """
    laid = written(df.withColumn("order", F.struct(*order)).repartitionByRange("order").withColumn("part", F.spark_partition_id()), "ordered")
    before = Window.partitionBy("part").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    one = laid.withColumn("one", F.lit(1).cast("long"))
    cols = {name: "one"} | {f"{c}_before": c for c in sums}
    parts = one.groupBy("part").agg(*[F.sum(c).alias(f"{n}_part") for n, c in cols.items()])
    up = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("part"), *[F.coalesce(F.sum(f"{n}_part").over(up), F.lit(0)).alias(f"{n}_offset") for n in cols])
    inside = one.withColumns({n: F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in cols.items()})
    return inside.join(offsets, "part").select(*df.columns, *[(F.col(n) + F.col(f"{n}_offset")).alias(n) for n in cols])
