"""Packing: optimal length buckets from the global histogram, then token-budget batches inside each bucket."""

from __future__ import annotations

from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import nth_copy, word_count, wrapped, written

#: Length buckets, and tokens of a batch with its padding.
BUCKETS, BUDGET = 16, 16_384
#: Rows of a batch at most, which bounds batches of empty texts.
MAX_ROWS = 16_384
#: Hash ranges by which a bucket's rows are numbered.
SHARDS = 1024


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most so many buckets over ascending lengths with the least padding in all.

    least[k][j], the padding of the first j lengths in k buckets, is a minimum of lines in
    lengths[j - 1]: their slopes fall and the points ascend, so a pointer walks one
    hull per layer and the whole takes buckets * lengths steps, in exact integers.
    """
    n = len(lengths)
    if not n:
        return []
    c, s = [0], [0]
    for x, m in zip(lengths, counts):
        c.append(c[-1] + m)
        s.append(s[-1] + x * m)
    least, origin = [0] + [None] * n, []
    for _ in range(min(buckets, n)):
        hull: list[tuple[int, int, int]] = []
        at, now, came = 0, [None] * (n + 1), array("i", bytes(4 * (n + 1)))
        now[0] = 0
        for j in range(1, n + 1):
            if least[j - 1] is not None:
                slope, cut = -c[j - 1], least[j - 1] + s[j - 1]
                while len(hull) >= 2 and (hull[-1][1] - hull[-2][1]) * (hull[-1][0] - slope) >= (cut - hull[-1][1]) * (hull[-2][0] - hull[-1][0]):
                    hull.pop()
                hull.append((slope, cut, j - 1))
                at = min(at, len(hull) - 1)
            if not hull:
                continue
            x = lengths[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            now[j], came[j] = x * c[j] - s[j] + hull[at][0] * x + hull[at][1], hull[at][2]
        least = now
        origin.append(came)
    ends, j = [], n
    for came in reversed(origin):
        if j:
            ends.append(lengths[j - 1])
            j = came[j]
    return ends[::-1]


def pack(sized: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, max_rows: int = MAX_ROWS, shards: int = SHARDS) -> DataFrame:
    """sized(row, id, length, tie) rows with bucket, padded, batch and slot.

    row is a monotonically increasing id of written rows, tie a hash of what tells rows of one id apart. A batch
    holds rows of one bucket, budget // padded of them (at least one: a text longer than
    the budget is a batch of its own), and only a bucket's last batch is not full. The
    histogram is aggregated before the shuffle and has a row for each distinct length at the
    driver: at most the root of twice the sum of all lengths, however long one text is. Rows
    are numbered in two levels, by hash range and inside it, so no task holds a bucket, and copies of a row
    are numbered to spread over the ranges. A null length counts as 0; null ids and repeated rows are rows like others.
    """
    told = nth_copy(sized.withColumn("length", F.coalesce("length", F.lit(0)).cast("long")), ["id", "length", "tie"], "row")
    laid = written(told.select("row", "id", "length", F.xxhash64("id", "length", "tie", "copy").alias("h")), "lengths")
    bins = laid.groupBy(F.col("length").alias("x")).agg(F.count("*").alias("m")).toArrow().sort_by("x")
    ends = boundaries(bins.column("x").to_pylist(), bins.column("m").to_pylist(), buckets) or [0]
    ends_col = F.array(*[F.lit(e).cast("long") for e in ends])
    bucket = F.size(F.filter(ends_col, lambda e: e < F.col("length")))
    placed = laid.withColumn("bucket", bucket).withColumn("padded", F.element_at(ends_col, F.col("bucket") + 1)).withColumn("shard", F.pmod(F.shiftright("h", 20), F.lit(shards)).cast("int"))
    per_batch = F.greatest(F.lit(1), F.least(F.lit(max_rows), F.call_function("div", F.lit(budget), F.greatest(F.lit(1), F.col("padded")))))
    counts = placed.groupBy("bucket", "shard").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("offset", before).select("bucket", "shard", "offset")
    number = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("h", "id", "length", "row"))
    numbered = placed.join(offsets, ["bucket", "shard"]).withColumn("at", F.col("offset") + number - 1).withColumn("per", per_batch)
    return numbered.select("row", "id", "length", "bucket", "padded", F.call_function("div", F.col("at"), F.col("per")).alias("batch"), (F.col("at") % F.col("per")).cast("int").alias("slot"))


def _sized(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    text = F.col(text_col)
    sized = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), word_count(text).alias("length"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"), *more)
    return written(sized, "documents")


def pack_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, length, bucket, padded, batch, slot) of every row, the length being its words; a null or empty text has length 0; see pack."""
    return pack(_sized(docs, id_col, text_col), **how).drop("row")


def packed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, texts included, with length, bucket, padded, batch and slot; see pack_texts.

    A column of docs with one of these five names gives way. The rows are written once with a row id, and move
    once to meet their places.
    """
    held = _sized(docs, id_col, text_col, wrapped(docs, "all"))
    got = pack(held.select("row", "id", "length", "tie"), **how).drop("id")
    new = ["length", "bucket", "padded", "batch", "slot"]
    return held.select("row", "all").join(got, "row").select(*[F.col("all")[c].alias(c) for c in docs.columns if c.lower() not in new], *new)
