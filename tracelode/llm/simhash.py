"""SimHash fingerprints and near-duplicate components found through pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, wrapped, written

#: Reference fingerprints whose distances to every fingerprint form its row of the table.
N_PIVOTS = 16
#: Blocks of candidates with more distinct fingerprints are split by further bits.
MAX_BLOCK = 1024
#: Shingles hashed at a time, so that a very long text needs little more memory than itself.
_STEP = 65_536


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """Hashes of the word shingles in order, repeats included, some at a time; none without words."""
    w = text.lower().split()
    if not w:
        return
    n = max(1, len(w) - words + 1)
    length = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(length + 1)
    line, last = b" ".join(w), min(words, len(w)) - 1
    begin, end = (ends - length - 1)[:n].tolist(), (ends[last : last + n] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _STEP):
        yield np.array([digest(line[a:b], 42) for a, b in zip(begin[at : at + _STEP], end[at : at + _STEP])], "<u8")


def _vote(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _ones(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint_bytes(text: bytes, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, words):
        ones += _ones(h)
        n += len(h)
    return _vote(ones, n)


def fingerprint(text: Column, words: int = 3) -> Column:
    """The fingerprint as a signed long. A null text has the empty text's fingerprint, zero."""

    @F.arrow_udf("long")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = np.fromiter((fingerprint_bytes((t.as_py() or "").encode(), words) for t in texts), np.uint64, len(texts))
            yield pa.array(found.view(np.int64))

    return simhash(text)


def hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


# --- pairs ---------------------------------------------------------------------------------


def pivots(seed: int = 7, n: int = N_PIVOTS) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, np.uint64, endpoint=False)


def distances(fps: np.ndarray) -> np.ndarray:
    """The pivot table: Hamming distances of unsigned fingerprints to all pivots, a byte each."""
    return np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.uint8)


def _tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (fp); yields (fp, table)."""
    for b in batches:
        table = distances(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.record_batch([b.column(0), pa.array([row.tobytes() for row in table], pa.binary())], names=["fp", "table"])


def survivors(fps: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the index pairs, those within the radius.

    By the triangle inequality a pivot's distances to two fingerprints differ by no more
    than their own distance, so a pair goes as soon as one coordinate differs by more
    than the radius. What the table leaves is verified bit by bit.
    """
    apart = np.abs(table[i].astype(np.int8) - table[j].astype(np.int8)).max(1, initial=0)
    i, j = i[apart <= radius], j[apart <= radius]
    near = np.bitwise_count(fps[i] ^ fps[j]) <= radius
    return i[near], j[near]


def _stars(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """What the pairs connect, as pairs of each member with the first of its kind: stars, which leave little to do afterwards."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        x, y = top(a), top(b)
        if x != y:
            above[max(x, y)] = min(x, y)
    return [(x, top(x)) for x in list(above) if top(x) != x]


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("path", pa.int32()), ("table", pa.binary())])


def _links(radius: int, limit: int | None):
    """Reads (path, part, fp, table) sorted by (path, part, table); yields stars of what is linked and, for blocks beyond the limit, their rows (b null).

    As a block is sorted by its distances to the first pivot, a row meets only those behind it that are
    within the radius there; the other pivots discard most of these before any bit is compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, path, held) -> pa.RecordBatch:
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(path, pa.int32()), pa.array(held, pa.binary())], schema=_LINK)

        def settle(path, part, fp, held) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (part[1:] != part[:-1])])
            size = np.diff(np.r_[edge, len(fp)])
            block = np.repeat(np.arange(len(edge)), size)
            large = np.repeat(size > limit, size) if limit else np.zeros(len(fp), bool)
            if large.any():
                yield out(fp[large], [None] * int(large.sum()), path[large], held[large])
            fps = fp.view(np.uint64)
            table = np.frombuffer(b"".join(held), np.uint8).reshape(len(fp), -1)
            first = table[:, 0].astype(np.int16)
            near_i, near_j, at, step = [], [], np.flatnonzero(~large), 0
            while len(at):
                step += 1
                at = at[at + step < len(fp)]
                at = at[(block[at] == block[at + step]) & (first[at + step] - first[at] <= radius)]
                i, j = survivors(fps, at, at + step, table[:, 1:], radius)
                near_i.append(i)
                near_j.append(j)
            kept = _stars(np.concatenate(near_i), np.concatenate(near_j)) if near_i else []
            if kept:
                pick = np.array(kept)
                yield out(fp[pick[:, 0]], fp[pick[:, 1]], path[pick[:, 0]], [None] * len(pick))

        held: list[list[np.ndarray]] = []
        beyond = None  # the block that has outgrown the limit
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if beyond is not None:
                same = (cols[0] == beyond[0]) & (cols[1] == beyond[1])
                if same.any():
                    yield out(cols[2][same], [None] * int(same.sum()), cols[0][same], cols[3][same])
                    cols = [x[~same] for x in cols]
                if not len(cols[0]):
                    continue
                beyond = None
            held.append(cols)
            cols = [np.concatenate(x) for x in zip(*held)]
            held = []
            if not len(cols[0]):
                continue
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            if not last.all():
                yield from settle(*[x[~last] for x in cols])
            if limit and last.sum() > limit:
                beyond = (cols[0][-1], cols[1][-1])
                yield out(cols[2][last], [None] * int(last.sum()), cols[0][last], cols[3][last])
            else:
                held = [[x[last] for x in cols]]
        if held:
            yield from settle(*held[0])

    return run


def _bands(free: list[int]) -> list[list[int]]:
    n = len(free) // 4
    return [free[k * n : (k + 1) * n] for k in range(4)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def _splits(free: list[int]) -> list[tuple[int, list[int]]]:
    """Six ways to fix two of the free bits' four bands: mask of the fixed bits, and the bits left free."""
    bands = _bands(free)
    return [(_mask(bands[i] + bands[j]), sum((b for k, b in enumerate(bands) if k not in (i, j)), [])) for i in range(4) for j in range(i)]


def linked(fps: DataFrame, radius: int = 2, max_block: int = MAX_BLOCK) -> DataFrame:
    """(a, b) for distinct fingerprints fps(fp): pairs whose closure is that of all pairs within the radius.

    Two fingerprints that differ in up to two bits agree in two of four bands of 16 bits,
    so every pair meets in one of six blocks; inside a block the pivot table discards and
    a bit count verifies. A block of more than max_block members is split the same way by
    its 32 free bits, then by the 16 that this leaves, and ends with 8 free bits, which
    256 members fill: nothing is capped, and no task holds a large block.
    """
    if not 0 <= radius <= 2:
        raise ValueError("the four bands guarantee pairs of up to two differing bits")
    # a path numbers the choices made so far; fixed bits add up along it
    ways = {0: (0, list(range(64)))}
    tabled = fps.select(F.col("fp").cast("long")).mapInArrow(_tabled, "fp long, table binary")
    rows, found = tabled.withColumn("path", F.lit(0)), []
    for level in range(3):
        after, choices = {}, {}
        for path, (fixed, free) in ways.items():
            for k, (mask, left) in enumerate(_splits(free)):
                after[path * 6 + k + 1] = (fixed | mask, left)
                choices.setdefault(path, []).append((path * 6 + k + 1, fixed | mask))
        ways = after
        offered = {w: F.array(*[F.struct(F.lit(p).alias("path"), F.lit(m).alias("mask")) for p, m in own]) for w, own in sorted(choices.items())}
        options = offered[0] if level == 0 else F.element_at(F.create_map(*[x for w, own in offered.items() for x in (F.lit(w), own)]), F.col("path"))
        blocks = rows.select(F.explode(options).alias("y"), "fp", "table")
        # the masked bits name a block together with its path, whatever it was split from
        blocks = blocks.select(F.col("y.path").cast("int").alias("path"), F.col("fp").bitwiseAND(F.col("y.mask")).alias("part"), "fp", "table")
        ranked = blocks.repartition("path", "part").sortWithinPartitions("path", "part", "table", "fp")
        made = written(ranked.mapInArrow(_links(radius, max_block if level < 2 else None), "a long, b long, path int, table binary"), "links")
        found.append(made.where("b is not null").select("a", "b"))
        rows = made.where("b is null").select(F.col("a").alias("fp"), "path", "table").distinct()
        if level == 2 or rows.isEmpty():
            break
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Whether every u of edges(u, v) has one v, which is no u itself: one count of each node's parts."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")), F.struct(F.col("v").alias("x"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))).alias("e")).select("e.*")
    parts = ends.groupBy("x").agg(F.sum("as_u").alias("u"), F.max("as_v").alias("v"))
    return parts.where("u > 1 or (u = 1 and v = 1)").isEmpty()


def roots(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b): the smallest node that it reaches.

    Alternating stars: every node passes its smallest neighbour to its larger ones, then
    to its smaller ones, until only stars are left; a logarithmic number of written
    rounds. Neighbour lists are never gathered: a minimum per node is aggregated before
    the shuffle and joined back, and Spark splits a hot node's side of that join.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _only_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "edges")
        release(edges)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = written(small, "edges")
        release(large)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def components(docs: DataFrame, id_col: str, text_col: str, words: int, radius: int, max_block: int) -> DataFrame:
    """(id, fp, root) of every row; root names the fingerprints that reach each other."""
    known = written(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), words).alias("fp")), "fingerprints")
    of = roots(linked(known.select("fp").distinct(), radius, max_block)).withColumnRenamed("node", "fp")
    return known.join(of, "fp", "left").select("id", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, max_block: int = MAX_BLOCK) -> DataFrame:
    """(id, fp, component): the smallest id that a row reaches over fingerprints within the radius.

    A null, empty or white-space text has fingerprint zero and links like any other.
    Equal texts, and repeated rows, share a component. A null id takes part and is never
    the smallest; a component of null ids only has a null name. No rows, no result.
    """
    known = written(components(docs, id_col, text_col, words, radius, max_block), "components")
    named = written(known.groupBy("fp", "root").agg(F.min("id").alias("first")), "named")
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    # joined back by fingerprint, through an exchange of its own: Spark then splits a hot one
    return known.join(named.join(least, "root").select("fp", "component"), "fp").select("id", "fp", "component")


def _keep(docs: DataFrame, known: DataFrame, mark, id_col: str, text_col: str) -> DataFrame:
    """docs with one row for each root of known(id, mark, root): that of the smallest id, nulls last, then smallest mark.

    Where an id is on several rows, mark(text) tells them apart, and of rows equal in both
    the one with the least text, then the least JSON of all columns, stays. The columns of docs
    travel as one struct, whatever their names.
    """
    first = known.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("r")).select("r.id", "r.mark")
    several = written(known.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").select("id"), "repeated")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), wrapped(docs))
    if several.isEmpty():
        return own.join(first.select("id"), "id", "left_semi").select("row.*")
    x, y = own.alias("x"), several.alias("y")
    same = F.col("x.id").eqNullSafe(F.col("y.id"))
    once = first.alias("x").join(y, same, "left_anti")
    kept = x.join(once.alias("y"), same, "left_semi").select("row.*")
    again = x.join(y, same, "left_semi").select("id", "text", mark(F.col("text")).alias("mark"), "row")
    again = again.alias("x").join(first.alias("y"), same & (F.col("x.mark") == F.col("y.mark")), "left_semi")
    one = again.groupBy("id", "mark").agg(F.min_by("row", F.struct("text", F.to_json("row"))).alias("row"))
    return kept.unionByName(one.select("row.*"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, max_block: int = MAX_BLOCK) -> DataFrame:
    """docs with one row of each component of near_duplicates; see _keep."""
    known = written(components(docs, id_col, text_col, words, radius, max_block), "components").withColumnRenamed("fp", "mark")
    return _keep(docs, known, lambda text: fingerprint(text, words), id_col, text_col)


# --- similarity of shingle sets ----------------------------------------------------------------

#: Classes of which one in so many is looked at for common hashes, and how many of those are told apart. Both only order the hashes; no result depends on them.
SAMPLED, COMMON = 16, 100_000
#: Rounds in which each set is compared with those next to it only, and how many of these.
ROUNDS, LINKS = 2, 4
#: Differing bits at which the fingerprints of two sets make them candidates.
RADIUS = 2
#: Rows of a tile of a large block.
TILE = 2048


def distinct_hashes(text: bytes, words: int = 5) -> np.ndarray:
    """All distinct 64-bit shingle hashes in ascending order."""
    found = np.empty(0, np.uint64)
    for h in shingle_hashes(text, words):
        found = np.unique(np.r_[found, h])
    return found


def set_fingerprint(hashes: np.ndarray) -> int:
    """Signed SimHash of a set's distinct hashes, which repeats in a text don't move; 0 without any."""
    fp = _vote(sum((_ones(hashes[at : at + _STEP]) for at in range(0, len(hashes), _STEP)), np.zeros(64, np.int64)), len(hashes))
    return fp - (1 << 64) * (fp >> 63)


def _named(hashes: np.ndarray) -> tuple[int, bytes]:
    held = np.unique((hashes >> np.uint64(32)).astype("<u4")).tobytes()
    name = xxhash.xxh64_intdigest(held, 1)
    return name - (1 << 64) * (name >> 63), held


def shingle_set(text: bytes, words: int = 5) -> tuple[int, bytes]:
    """(class, set): all distinct 32-bit shingle hashes in ascending order, and a digest of them as a signed long."""
    return _named(distinct_hashes(text, words))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Exact Jaccard similarity of two ascending sets; 1 for two empty ones."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(both) - shared) if len(both) else 1.0


def pivot_row(members: np.ndarray) -> bytes:
    """A set's row of the pivot table: how many of its hashes lie in each of 256 equal ranges, modulo 4, as 512 bits.

    The reference fingerprints are all 2 ** 256 unions of these cells. A set's Hamming distance to
    such a reference P is |P| + |A| - 2 |A and P|, so the largest coordinate difference of
    two sets is the sum over the cells of their counts' differences (P being the cells
    in which the second holds more), and it never exceeds the sets' own distance. Counts modulo 4, taken
    around the circle, differ by no more than the counts; in Gray code that is the number of
    bits in which they differ.
    """
    n = np.bincount(members >> np.uint32(24), minlength=256)
    return np.packbits(np.r_[(n ^ n >> 1) & 1, n >> 1 & 1].astype(np.uint8)).tobytes()


def pivot_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A bound from below on the largest difference of two sets' pivot distances over all references; x and y hold rows of the table as unsigned longs."""
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def pivots_allow(apart, both, least: float):
    """Whether that largest difference leaves a similarity of `least` possible to sets with so many members together: their distance is then (1 - s) / (1 + s) of that at most."""
    return apart <= (1 - least) / (1 + least) * both + 1e-6


def _prefixes(common: np.ndarray, often: np.ndarray, least: float):
    """Reads (class, members); yields (key, class, size, at), a row for each hash of a set's prefix, see similar_links. common ascends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                keys, name, size, place = [], [], [], []
                for c, x in zip(batch.column(0).slice(at, 256).to_pylist(), batch.column(1).slice(at, 256)):
                    own = np.frombuffer(x.as_buffer(), "<u4")
                    n = len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1
                    if len(common):
                        near = np.minimum(np.searchsorted(common, own), len(common) - 1)
                        own = own[np.argsort(np.where(common[near] == own, often[near], 0), kind="stable")]
                    keys.append(own[:n])
                    name.append(np.full(n, c, np.int64))
                    size.append(np.full(n, len(own), np.int32))
                    place.append(np.arange(n, dtype=np.int32))
                if keys:
                    yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int32)), pa.array(np.concatenate(name)), pa.array(np.concatenate(size)), pa.array(np.concatenate(place))], names=["key", "class", "size", "at"])

    return run


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of batches that are sorted by their first, cut so that no block of an equal first column is torn."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        last = cols[0] == cols[0][-1]
        if not last.all():
            yield [x[~last] for x in cols]
        held = [x[last] for x in cols]
    if held is not None:
        yield held


def _alike(least: float):
    """Reads (a, b, x, y), classes and their sets; yields the similar pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similarity(np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")) >= least - 1e-9 for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def _within(least: float, nearest: bool):
    """Reads (block, side, class, size, at, root, table) sorted by (block, size); yields pairs of a block that may be similar and have different roots.

    nearest: each row with the one at the least pivot distance, as (row, other), else all pairs, each once. Rows of
    one side are not compared with each other, unless it is 2. A pair's overlap reaches need; at
    the first hash that it shares no more than the rest of either set is left to share, so that hash
    is among the first size - need + 1 of each. Sizes beyond size / least end a row's
    partners. What is left goes to the pivot table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, side, name, size, place, root, held in _whole_blocks(batches):
            table = np.frombuffer(b"".join(held), np.uint64).reshape(len(held), -1)
            size, found, step = size.astype(np.int64), ([], []), 0
            rest, at = size - place, np.arange(len(block))
            next_to, closest = np.zeros(len(block), np.int64), np.full(len(block), 1 << 30)
            while len(at):
                step += 1
                at = at[at + step < len(block)]
                at = at[(block[at] == block[at + step]) & (size[at + step] * least <= size[at] + 1e-6)]
                i = at[(root[at] != root[at + step]) & ((side[at] == 2) | (side[at] != side[at + step]))]
                need = np.ceil(least / (1 + least) * (size[i] + size[i + step]) - 1e-6)
                i = i[(rest[i] >= need) & (rest[i + step] >= need)]
                apart = pivot_distance(table[i], table[i + step])
                fits = pivots_allow(apart, size[i] + size[i + step], least)
                i, apart = i[fits], apart[fits]
                if nearest:
                    for one, other in ((i, i + step), (i + step, i)):
                        closer = apart < closest[one]
                        next_to[one[closer]], closest[one[closer]] = other[closer], apart[closer]
                elif len(i):
                    found[0].append(np.minimum(name[i], name[i + step]))
                    found[1].append(np.maximum(name[i], name[i + step]))
            if nearest:
                i = np.flatnonzero(closest < 1 << 30)
                found = [name[i]], [name[next_to[i]]]
            if found[0] and len(found[0][0]):
                a, b = (np.concatenate(x) for x in found)
                if not nearest:  # a pair that several blocks here hold goes on once
                    a, b = np.unique(np.stack([a, b], 1), axis=0).T
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def fingerprint_pairs(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) between the classes of classes(class, fp): each with the first of its fingerprint, and the firsts of fingerprints that `linked` joins through their pivot table."""
    first = written(classes.groupBy("fp").agg(F.min("class").alias("first"), F.count("*").alias("n")), "prints")
    same = classes.join(first.where("n > 1"), "fp").select(F.col("first").alias("a"), F.col("class").alias("b"))
    of = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_class"))
    near = linked(first.select("fp"), radius).join(of("a"), "a").join(of("b"), "b").select(F.least("a_class", "b_class").alias("a"), F.greatest("a_class", "b_class").alias("b"))
    return same.unionByName(near).where("a <> b").distinct()


def similar_links(classes: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """(a, b) between the classes of classes(class, members, table, fp), one row a class: pairs whose closure is that of all pairs of a similarity of at least `least`.

    Classes whose SimHash fingerprints meet within RADIUS bits, by the pivot table of fingerprints, are compared first, and those
    that are similar are connected. A fingerprint's distance bounds no set similarity, so a prefix filter finds all others:
    two sets of that similarity share at least ceil(least * size) hashes of either. So, in
    any one order of all hashes, they share one among the first size - ceil(least * size) + 1
    of each: these are a set's keys, and every pair meets under one. The order puts hashes
    that are common in a sample last, which keeps blocks small and decides nothing else.
    Then each class is compared with those that lie next to it by pivot distance in most of its
    blocks, in ROUNDS rounds, each time among those that aren't connected to it yet, which connects most of
    what is alike; a class that meets no other within reach leaves. In the end all pairs of a block that aren't
    connected yet and that their sizes, places in the order and pivot tables allow are compared,
    each once: only their sets are moved.

    No task holds a large block. In the rounds a block of more than `tile` rows is dealt into tiles by a hash
    that changes with the round. In the end the rows of its most frequent root and the others are tiled each, and
    every tile of the others meets all tiles, which one root's need not.
    """
    some = classes.where(F.pmod("class", F.lit(SAMPLED)) == 0)
    counted = written(some.select("members").mapInArrow(_hashes, "h int").groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "common")
    often = counted.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    release(counted)
    h, n = often.column("h").to_numpy().view(np.uint32), often.column("n").to_numpy()
    up = np.argsort(h)
    keys = written(classes.select("class", "members").mapInArrow(_prefixes(h[up], n[up], least), "key int, class long, size int, at int"), "keys")
    several = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        x, y = (sets.select(F.col("class").alias(c), F.col("members").alias(m)) for c, m in (("a", "x"), ("b", "y")))
        both = pairs.join(x, "a").join(y.join(pairs.select("b").distinct(), "b", "left_semi"), "b").select("a", "b", "x", "y")
        found = written(both.mapInArrow(_alike(least), "a long, b long"), "similar")
        release(pairs)
        return found

    def met(rows: DataFrame, tiles: list, side, nearest: bool) -> DataFrame:
        """What _within yields over the blocks that a key and its tiles name."""
        blocks = rows.select(F.xxhash64("key", *tiles).alias("block"), side.alias("side"), "class", "size", "at", "root", "table")
        return blocks.repartition("block").sortWithinPartitions("block", "size").mapInArrow(_within(least, nearest), "a long, b long")

    met_by_print = written(fingerprint_pairs(classes.select("class", "fp")), "candidates")
    of_those = met_by_print.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    sets = written(classes.select("class", "members").join(of_those, "class", "left_semi"), "sets")
    near = compared(met_by_print, sets)
    release(met_by_print, sets)
    blocks = keys.join(several, "key").join(classes.select("class", "table"), "class").join(roots(near).withColumnRenamed("node", "class"), "class", "left")
    rows = written(blocks.withColumn("root", F.coalesce("root", "class")), "blocks")
    release(keys)
    sets, deal = classes, F.ceil(F.col("n") / tile)
    for k in range(ROUNDS):
        dealt = F.pmod(F.xxhash64("class", F.lit(k)), deal)
        best = met(rows, [dealt], F.lit(2), True).groupBy("a", "b").agg(F.count("*").alias("n"))
        best = best.withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))).where(F.col("nth") <= LINKS)
        best = written(best.select("a", "b"), "nearest")
        alive = best.select(F.col("a").alias("class")).unionByName(rows.where(F.col("n") > tile).select("class")).distinct()
        if k == 0:  # from here on only these classes' sets are needed
            sets = written(classes.select("class", "members").join(alive, "class", "left_semi"), "sets")
        found = compared(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets)
        near = near.unionByName(found)
        rooted = rows.drop("root").join(alive, "class", "left_semi").join(roots(near).withColumnRenamed("node", "class"), "class", "left")
        after = written(rooted.withColumn("root", F.coalesce("root", "class")), "rooted")
        release(best, rows)
        rows = after
    per = rows.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("n"), F.max("m").alias("m"), F.max_by("root", F.struct("m", "root")).alias("major"))
    per = per.where("m < n").select("key", "major", F.ceil((F.col("n") - F.col("m")) / tile).alias("minors"), F.ceil(F.col("m") / tile).alias("majors"), (F.col("n") > tile).alias("large"))
    mixed = rows.drop("n").join(per, "key")
    own = F.pmod(F.xxhash64("class"), F.when(F.col("root") == F.col("major"), F.col("majors")).otherwise(F.col("minors")))
    cell = lambda x, y, side: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), side.alias("side"))
    # tiles of the others are numbered from 0, those of the most frequent root from minors on
    everyone = F.sequence(F.lit(0), F.col("minors") + F.col("majors") - 1)
    of_minor = F.transform(everyone, lambda t: cell(F.least(t, own), F.greatest(t, own), F.when(t == own, F.lit(2)).when(own < t, F.lit(0)).otherwise(F.lit(1))))
    of_major = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda t: cell(t, own + F.col("minors"), F.lit(1)))
    whole = F.array(cell(F.lit(0), F.lit(0), F.lit(2)))
    cells = F.explode(F.when(~F.col("large"), whole).when(F.col("root") == F.col("major"), of_major).otherwise(of_minor))
    across = met(mixed.withColumn("cell", cells), ["cell.x", "cell.y"], F.col("cell.side"), False).distinct()
    links = near.unionByName(compared(across, sets))
    release(rows, sets)
    return links


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column(0):
            yield pa.record_batch([pa.array(np.frombuffer(x.as_buffer(), "<i4"))], names=["h"])


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, tile: int = TILE) -> DataFrame:
    """docs with one row of each group of texts whose shingle sets reach each other at a similarity of at least `least`; see _keep.

    Null, empty and white-space texts are one group. Equal texts collapse before any pair is looked at; see similar_links
    for the SimHash fingerprints, their pivot table and the exact search behind them.
    """
    schema = pa.schema([("id", pa.int64()), ("class", pa.int64()), ("members", pa.binary()), ("table", pa.binary()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 1024):
                ids, some = b.column(0).slice(at, 1024), b.column(1).slice(at, 1024)
                name, members, prints = [], [], []
                for t in some:
                    hashes = distinct_hashes(t.as_py() or b"", words)
                    prints.append(set_fingerprint(hashes))
                    for held, x in zip((name, members), _named(hashes)):
                        held.append(x)
                tables = [pivot_row(np.frombuffer(m, "<u4")) for m in members]
                yield pa.record_batch([ids, pa.array(name, pa.int64()), pa.array(members, pa.binary()), pa.array(tables, pa.binary()), pa.array(prints, pa.int64())], schema=schema)

    @F.arrow_udf("long")
    def class_of(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set((t.as_py() or "").encode(), words)[0] for t in texts], pa.int64())

    made = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "id long, class long, members binary, table binary, fp long")
    made = written(made.withColumn("row", F.monotonically_increasing_id()), "shingle-sets")
    one = made.where(F.length("members") > 0).groupBy("class").agg(F.min("row").alias("row"))
    classes = written(made.join(one.select("row"), "row", "left_semi").select("class", "members", "table", "fp"), "classes")
    known = written(made.select("id", "class"), "members")
    release(made)
    links = similar_links(classes, least, tile)
    release(classes)
    of = roots(links).withColumnRenamed("node", "class")
    grouped = written(known.join(of, "class", "left").select("id", F.col("class").alias("mark"), F.coalesce("root", "class").alias("root")), "components")
    release(known)
    return _keep(docs, grouped, class_of, id_col, text_col)
