"""Exact top-k search by inner product: tiled matrix products, partial selection, tree merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors in a packed block: one side of a tile.
BLOCK = 1024
LONG_MAX = 2**63 - 1


def floored(embedding: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component as an array of doubles; null for a vector that is null or holds a null or non-finite component."""
    x = F.transform(embedding, lambda v: F.floor(v.cast("double") * F.lit(scale)).cast("double"))
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when(embedding.isNotNull() & ~bad, x)


_PACKED = pa.schema([("shard", pa.int32()), ("dim", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("data", pa.binary())])
PACKED = "shard int, dim int, rows binary, ids binary, data binary"


def _packer(block: int, shards: int, every: bool):
    """Packs (row, id, vec) rows into blocks of one dimension; every: a copy for each shard, else the shards in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        turn = 0

        def out(rows: np.ndarray, ids: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
            nonlocal turn
            to = list(range(shards)) if every else [(int(rows[0]) + turn) % shards]
            turn += 1
            n = len(to)
            parts = [pa.array([x.tobytes()] * n, pa.binary()) for x in (rows, ids, data)]
            return pa.record_batch([pa.array(to, pa.int32()), pa.array([data.shape[1]] * n, pa.int32()), *parts], schema=_PACKED)

        for b in batches:
            rows, ids = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            sizes = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            flat, begin = b.column(2).flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                held.setdefault(int(dim), []).append([rows[at], ids[at], flat[begin[at][:, None] + np.arange(dim)]])
                if sum(len(x[0]) for x in held[int(dim)]) >= block:
                    whole = [np.concatenate(x) for x in zip(*held[int(dim)])]
                    cut = len(whole[0]) - len(whole[0]) % block
                    for k in range(0, cut, block):
                        yield out(*[x[k : k + block] for x in whole])
                    held[int(dim)] = [[x[cut:] for x in whole]]
        for parts in held.values():
            rest = [np.concatenate(x) for x in zip(*parts)]
            if len(rest[0]):
                yield out(*rest)

    return run


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products as longs; those beyond a long's range are held at its ends."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    if bound < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object)
    return np.clip(whole(q) @ whole(c).T, -LONG_MAX - 1, LONG_MAX).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, skipped: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row of a tile, ties to smaller ids, rows in order; pairs in skipped don't count.

    A partition of the whole tile gives each row's k-th score; only what reaches it is sorted.
    """
    low = np.iinfo(np.int64).min
    held = np.where(skipped, low, scores)
    if held.shape[1] > k:
        least = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
        row, col = np.nonzero((held >= least[:, None]) & ~skipped)
    else:
        row, col = np.nonzero(~skipped)
    order = np.lexsort((ids[col], ~held[row, col], row))  # ~x reverses the order of longs, the least one included
    row, col = row[order], col[order]
    first = np.r_[0, np.cumsum(np.bincount(row, minlength=len(held)))[:-1]]
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], col[keep]


_TOP = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("part", pa.int32())])


def _tiles(k: int):
    """Reads (q_rows, q_ids, q_data, rows, ids, data, dim, shard); yields each query's top k of the tiles that follow each other for its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, q, top = None, None, None

        def out() -> Iterator[pa.RecordBatch]:
            if top is not None and len(top[0]):
                at, ids, scores, shard = top
                yield pa.record_batch([pa.array(q[0][at]), pa.array(q[1][at]), pa.array(ids), pa.array(scores), pa.array(np.full(len(at), shard, np.int32))], schema=_TOP)

        for b in batches:
            for q_rows, q_ids, q_data, rows, ids, data, dim, shard in zip(*b.columns):
                d = dim.as_py()
                if (q_rows, d) != name:
                    yield from out()
                    name = (q_rows, d)
                    q = [np.frombuffer(x.as_py(), np.int64) for x in (q_rows, q_ids)]
                    q.append(np.frombuffer(q_data.as_py(), np.float64).reshape(len(q[0]), d))
                    top = None
                c_rows, c_ids = (np.frombuffer(x.as_py(), np.int64) for x in (rows, ids))
                tile = products(q[2], np.frombuffer(data.as_py(), np.float64).reshape(len(c_rows), d))
                row, col = best(tile, c_ids, q[0][:, None] == c_rows[None, :], k)
                found = [row, c_ids[col], tile[row, col]]
                if top is not None:
                    row, ids_, scores = (np.r_[a, x] for a, x in zip(top, found))
                    order = np.lexsort((ids_, ~scores, row))
                    row, ids_, scores = row[order], ids_[order], scores[order]
                    first = np.r_[0, np.cumsum(np.bincount(row, minlength=len(q[0])))[:-1]]
                    keep = np.arange(len(row)) - first[row] < k
                    found = [row[keep], ids_[keep], scores[keep]]
                top = [*found, shard.as_py()]
        yield from out()

    return run


#: Lists that one task merges at a level of the tree.
FAN = 8


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, block: int = BLOCK, shards: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best candidates by exact integer inner product.

    Both sides are (row long, id long, vec array<double>) with whole-numbered components; row names a row, so that a
    query is never its own candidate while other rows of its id are, and a repeated query id asks once a row. Rows
    with a null id or vec take no part, vectors of different
    lengths have no product, that of empty vectors is 0, and ties go to the smaller id. A query with no candidate
    has no row. Candidates are packed into blocks and dealt to shards; query blocks visit every shard and stream
    through its tiles without being sorted, each worker task keeps a top list per query while it
    walks them, and the shards' lists are merged in a tree, FAN at a time, by ranked windows whose group
    limits run before the shuffles. shards: twice the session's parallelism unless given.
    """
    shards = shards or max(12, 2 * queries.sparkSession.sparkContext.defaultParallelism)
    own = lambda df: df.where("row is not null and id is not null and vec is not null").select(F.col("row").cast("long"), F.col("id").cast("long"), "vec")
    qs = own(queries).mapInArrow(_packer(block, shards, True), PACKED)
    qs = qs.select("shard", "dim", F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    cs = own(candidates).mapInArrow(_packer(block, shards, False), PACKED)
    tiles = qs.join(cs, ["shard", "dim"]).select("q_rows", "q_ids", "q_data", "rows", "ids", "data", "dim", "shard")
    merged = tiles.mapInArrow(_tiles(k), "row long, query_id long, vec_id long, score long, part int")
    while shards > 1:
        shards = -(-shards // FAN)
        level = Window.partitionBy("row", "part").orderBy(F.desc("score"), F.asc("vec_id"))
        merged = merged.withColumn("part", F.call_function("div", F.col("part"), F.lit(FAN)).cast("int"))
        merged = merged.withColumn("rank", F.row_number().over(level)).where(F.col("rank") <= k)
    if "rank" not in merged.columns:
        level = Window.partitionBy("row").orderBy(F.desc("score"), F.asc("vec_id"))
        merged = merged.withColumn("rank", F.row_number().over(level)).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")
