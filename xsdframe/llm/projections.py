"""Near-duplicate vectors by collision counting over sorted one-dimensional projections.

Unit vectors are projected on LISTS random lines. On each line the vectors are sorted, and
every vector is a query: those within half-width w of it, found by binary search, collide
with it. The projections of a pair at the threshold differ by a normal variable whose
deviation is their distance, so the pair's number of collisions is binomial; the count that
a pair must reach is calibrated for MISS_COUNT, and pairs that reach it are verified by
cosine in double precision.

On a single line a window that holds nearly all near pairs holds a third of all others, so
over whole tables the windows of all queries are quadratic whatever their width. So the
lists are cut: a group of `bits` lines cut at zero (random hyperplanes) makes a cell, the
sorted lists are those of a cell, and `tables` such groups are enough that a pair at the
threshold shares a cell with all but MISS_CELL probability (closer pairs miss far less).
bits grows with the logarithm of the number of vectors, so lists stay short.

Two passes keep vectors out of the shuffle. The first ships keys and projections of one
byte (windows are wider by the rounding, so no collision is lost) and finds the vectors
that take part in a pair that reaches the count. Only those are fetched for the second,
which counts again among them and verifies.

A cell of more than `block` vectors (a large group of near copies) is cut into chunks, and
each pair of chunks is a task's work of its own. Links are counted in the first cell that a
pair shares, and only star links of each block's connected groups leave it, so no group is
ever expanded into pairs. Equal vectors are one class, recognised by 128 bits of hash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, pick, tune
from .graph import components

THRESHOLD, LISTS, WINDOW, MISS_COUNT, MISS_CELL, BLOCK, SEED = 0.95, 24, 2.0, 1e-4, 8e-4, 2048, 17
#: Vectors in a cell, about.
CELL = 128
#: Steps of a projection's byte in one unit, lines whose windows are searched before pairs
#: that cannot reach the count are left, and collisions that are counted at once.
STEPS, EARLY, AT_ONCE = 30, 16, 1 << 22


def calibrated(threshold: float = THRESHOLD, lists: int = LISTS, window: float = WINDOW, miss: float = MISS_COUNT) -> tuple[float, int]:
    """Half-width of the windows, and the largest count that a pair at the threshold fails to
    reach with probability `miss` at most. window: half-width in deviations."""
    distance = math.sqrt(2 - 2 * threshold)
    p = math.erf(window / math.sqrt(2))
    below = 0.0
    for count in range(lists + 1):
        below += math.comb(lists, count) * p**count * (1 - p) ** (lists - count)
        if below > miss:
            return window * distance, count
    return window * distance, lists


def layout(vectors: int, threshold: float = THRESHOLD, miss: float = MISS_CELL) -> tuple[int, int]:
    """Lines of a cell, and how many groups of them."""
    bits = min(30, max(4, round(math.log2(max(vectors, 1) / CELL)) if vectors > CELL else 4))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; large and tiny rows do not overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _lines(dim: int, n: int, kind: int) -> np.ndarray:
    return np.random.default_rng([SEED, kind, dim]).standard_normal((dim, n))


def cell_codes(u: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Each row's cell in each table."""
    signs = (u @ _lines(u.shape[1], bits * tables, 0) > 0).reshape(len(u), tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(2)


def projected(u: np.ndarray) -> np.ndarray:
    """Places on the lines as bytes; far ends are clipped, which brings no pair further apart."""
    return np.clip(np.rint(u @ _lines(u.shape[1], LISTS, 1) * STEPS) + 128, 0, 255).astype(np.uint8)


def _expand(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[k], begin[k] + 1, ... of count[k] numbers each, in a row."""
    out = np.repeat(begin - (np.cumsum(count) - count), count)
    out += np.arange(len(out), dtype=out.dtype)
    return out


def passing(p: np.ndarray, right: np.ndarray, width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of rows that collide on `least` lines at least.

    p: bytes of each row on each line. right: which rows are of the second chunk; if any
    are, only pairs between the chunks count. On the first EARLY lines lists are sorted,
    windows found by binary search, and the collisions of each pair counted, at most about
    AT_ONCE at a time; the other lines are looked at for pairs only that can still reach
    the count.
    """
    lines, early = p.shape[1], min(EARLY, p.shape[1])
    queries = np.flatnonzero(~right)
    held = np.flatnonzero(right) if right.any() else queries
    m = len(held)
    if not m or not len(queries):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shift = 1024 * np.arange(early, dtype=np.int32)  # further apart than any window reaches
    order = np.argsort(p[held, :early], axis=0, kind="stable").T
    lists = (np.take_along_axis(p[held, :early].T.astype(np.int32), order, 1) + shift[:, None]).ravel()
    order = order.ravel().astype(np.int32)
    out = []

    def reach(rows: np.ndarray, counts: np.ndarray) -> None:
        i, j = np.nonzero(counts >= max(1, least - (lines - early)))
        for s in range(0, len(i), 1 << 16):
            a, b = rows[i[s : s + (1 << 16)]], held[j[s : s + (1 << 16)]]
            apart = np.abs(p[a, early:].astype(np.int16) - p[b, early:])
            enough = counts[i[s : s + (1 << 16)], j[s : s + (1 << 16)]] + (apart <= width).sum(1) >= least
            if held is queries:
                enough &= a < b
            a, b = a[enough], b[enough]
            out.append((np.minimum(a, b), np.maximum(a, b)))

    if held is queries:
        # Each pair from its lower end only; where most pairs collide, those that do not are counted.
        begin = np.arange(1, len(lists) + 1, dtype=np.int32)
        end = np.searchsorted(lists, lists + np.int32(width), side="right").astype(np.int32)
        last = np.repeat(np.arange(1, early + 1, dtype=np.int32) * np.int32(m), m)
        apart = (last - end).sum(dtype=np.int64) < (end - begin).sum(dtype=np.int64)
        begin, end = (end, last) if apart else (begin, end)
        if (end - begin).sum(dtype=np.int64) <= AT_ONCE and m <= 1 << 11:
            codes = np.repeat(order * np.int32(m), end - begin)
            codes += order[_expand(begin, end - begin)]
            counts = np.bincount(codes, minlength=m * m).reshape(m, m)
            counts = counts + counts.T
            reach(held, np.triu(early - counts if apart else counts, 1))
            queries = queries[:0]  # all done
    if len(queries):
        for k in range(0, len(queries), step := max(1, AT_ONCE // (early * m))):
            rows = queries[k : k + step]
            centre = (p[rows, :early].astype(np.int32) + shift).ravel()
            low = np.searchsorted(lists, centre - np.int32(width), side="left")
            count = np.searchsorted(lists, centre + np.int32(width), side="right") - low
            codes = np.repeat(np.repeat(np.arange(len(rows)) * m, early), count)
            codes += order[_expand(low, count)]
            reach(rows, np.bincount(codes, minlength=len(rows) * m).reshape(len(rows), m))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches by the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        after = root.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        np.minimum.at(after, root[i], low)
        np.minimum.at(after, root[j], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _bytes(column: pa.Array) -> np.ndarray:
    """A binary column whose values are of one length, as rows of bytes."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of an array as a binary column."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _vectors(batch: pa.RecordBatch, at: int, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of a batch for each length of vectors."""
    lists = batch.column(at)
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    dims = np.diff(ends)
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        yield rows, flat[_expand(ends[rows].astype(np.int64), np.full(len(rows), dim))].reshape(len(rows), dim).astype(kind)


#: A block: vectors of one length in one cell of a table, or in two chunks of it.
HEAD = "dim int, cell long, chunks long"


def _grouped(work: Callable[[tuple, list[pa.RecordBatch]], pa.RecordBatch | None]):
    """A function for mapInArrow that gives `work` the rows of each block; rows come sorted."""

    def run(batches):
        head, rows = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            heads = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)], 1)
            cuts = [0, *(np.flatnonzero((heads[1:] != heads[:-1]).any(1)) + 1).tolist(), len(heads)]
            for a, b in zip(cuts, cuts[1:]):
                own = tuple(heads[a].tolist())
                if own != head:
                    if sum(r.num_rows for r in rows) > 1 and (got := work(head, rows)) is not None:
                        yield got
                    head, rows = own, []
                rows.append(batch.slice(a, b - a))
        if sum(r.num_rows for r in rows) > 1 and (got := work(head, rows)) is not None:
            yield got

    return run


def _codes(classes: DataFrame, bits: int, tables: int, kind: type, sums: bool) -> DataFrame:
    """A row for each class and table: its cell, key and projections; or with sums, how many
    rows of each cell a batch has."""

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                for rows, x in _vectors(batch, 1, kind):
                    u, dim = unit(x), x.shape[1]
                    cells = (cell_codes(u, bits, tables) | np.arange(tables, dtype=np.int64) << 32).ravel()
                    if sums:
                        cells, n = np.unique(cells, return_counts=True)
                        yield pa.record_batch([pa.array(np.full(len(cells), dim, np.int32)), pa.array(cells), pa.array(n)], ["dim", "cell", "n"])
                        continue
                    keys = np.repeat(batch.column(0).to_numpy()[rows], tables)
                    yield pa.record_batch(
                        [pa.array(np.full(len(cells), dim, np.int32)), pa.array(cells), pa.array(keys), _binary(np.repeat(projected(u), tables, 0))],
                        ["dim", "cell", "key", "p"],
                    )

    return classes.select("key", "vec").mapInArrow(run, "dim int, cell long, n long" if sums else "dim int, cell long, key long, p binary")


def _blocks(codes: DataFrame, crowded: DataFrame) -> DataFrame:
    """HEAD, second, key, p: cells that are not crowded are one block, the others one for each
    pair of chunks; second: the row is of the second chunk."""
    rows = codes.join(crowded, ["dim", "cell"], "left")
    chunk = F.pmod(F.xxhash64("key"), F.col("parts"))
    rows = rows.withColumn("chunk", F.when(F.col("parts").isNotNull(), chunk)).withColumn(
        "other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    )
    chunks = F.coalesce(F.shiftleft(F.least("chunk", "other"), 32) + F.greatest("chunk", "other"), F.lit(0).cast("long"))
    return rows.select("dim", "cell", chunks.alias("chunks"), F.coalesce(F.col("chunk") > F.col("other"), F.lit(False)).alias("second"), "key", "p")


def _split(chunks: int, second: np.ndarray) -> np.ndarray:
    """Which rows count as the second chunk's: none where a chunk meets itself."""
    return second if chunks >> 32 != chunks & 0xFFFFFFFF else np.zeros(len(second), bool)


def active(blocks: DataFrame, threshold: float) -> DataFrame:
    """HEAD, second, key of the rows that take part in a pair that reaches the count."""
    width, least = calibrated(threshold)
    reach = math.floor(width * STEPS + 1)

    def work(head, rows):
        p = np.concatenate([_bytes(r.column(5)) for r in rows])
        second = _split(head[2], np.concatenate([r.column(3).to_numpy(zero_copy_only=False) for r in rows]))
        own = np.unique(np.concatenate(passing(p, second, reach, least)))
        if not len(own):
            return None
        key = np.concatenate([r.column(4).to_numpy() for r in rows])[own]
        constant = [pa.array(np.full(len(own), v), t) for v, t in zip(head, (pa.int32(), pa.int64(), pa.int64()))]
        return pa.record_batch([*constant, pa.array(second[own]), pa.array(key)], ["dim", "cell", "chunks", "second", "key"])

    by = ["dim", "cell", "chunks"]
    return blocks.repartition(*by).sortWithinPartitions(*by).mapInArrow(_grouped(work), f"{HEAD}, second boolean, key long")


def found_links(chosen: DataFrame, bits: int, tables: int, kind: type, threshold: float) -> DataFrame:
    """(a, a_first, b, b_first, n): with b null, vectors n that a links to, found in one block;
    else a link that holds a block's connected group together. chosen: HEAD, second, key,
    first, weight, vec."""
    width, least = calibrated(threshold)
    reach = math.floor(width * STEPS + 1)

    def work(head, rows):
        x = np.concatenate([v for r in rows for _, v in _vectors(r, 7, kind)])
        key, first, weight = (np.concatenate([r.column(c).to_numpy() for r in rows]) for c in (4, 5, 6))
        second = _split(head[2], np.concatenate([r.column(3).to_numpy(zero_copy_only=False) for r in rows]))
        by = np.argsort(first, kind="stable")  # so the stars of all cells have the same centres
        x, key, first, weight, second = x[by], key[by], first[by], weight[by], second[by]
        u, table = unit(x), head[1] >> 32
        codes = cell_codes(u, bits, tables).T
        i, j, out = *passing(projected(u), second, reach, least), []
        for earlier in codes[:table]:  # pairs that share an earlier cell count there
            fresh = earlier[i] != earlier[j]
            i, j = i[fresh], j[fresh]
        for s in range(0, len(i), 1 << 13):
            a, b = i[s : s + (1 << 13)], j[s : s + (1 << 13)]
            near = np.einsum("ij,ij->i", u[a], u[b]) >= threshold
            out.append((a[near], b[near]))
        if not out or not sum(len(a) for a, _ in out):
            return None
        i, j = (np.concatenate(c) for c in zip(*out))
        n = np.zeros(len(key), np.int64)
        np.add.at(n, i, weight[j])
        np.add.at(n, j, weight[i])
        some = np.flatnonzero(n)
        root = stars(len(key), i, j)
        tied = np.flatnonzero(root != np.arange(len(key)))
        none = pa.nulls(len(some), pa.int64())
        left = np.concatenate([some, root[tied]])
        return pa.record_batch(
            [
                pa.array(key[left]), pa.array(first[left]), pa.concat_arrays([none, pa.array(key[tied])]), pa.concat_arrays([none, pa.array(first[tied])]),
                pa.array(np.concatenate([n[some], np.zeros(len(tied), np.int64)])),
            ],
            ["a", "a_first", "b", "b_first", "n"],
        )

    by = ["dim", "cell", "chunks"]
    rows = chosen.select(*by, "second", "key", "first", "weight", "vec").repartition(*by).sortWithinPartitions(*by)
    return rows.mapInArrow(_grouped(work), "a long, a_first long, b long, b_first long, n long")


#: Stands for a null id: after all others, so that it names no component.
_NO_ID = 2**63 - 1


def _node(key: str, first: str) -> Column:
    """Classes in order of their smallest ids, so a component's smallest class names it."""
    return F.struct(F.col(first).alias("first"), F.col(key).alias("key"))


def near_duplicates(
    vectors: DataFrame, vector: str = "embedding", id: str = "vec_id", threshold: float = THRESHOLD, block: int = BLOCK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing, nor do vectors of different lengths. Repeated rows link with each other; a
    null vec_id never names a component (nor does the largest 64-bit one). An empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    rows = pick(vectors, id, vector).toDF("vec_id", "vec")
    double = "double" in dict(rows.dtypes)["vec"]
    kind = np.float64 if double else np.float32
    rows = rows.withColumn("vec", F.col("vec").cast("array<double>" if double else "array<float>"))
    sound = F.expr(
        "vec IS NOT NULL AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(vec, x -> x <> 0)"
    )
    hashes = [F.xxhash64("vec").alias("h"), F.xxhash64(F.lit(SEED), F.col("vec")).alias("g")]
    good = rows.where(sound)
    classes = good.select("vec_id", "vec", *hashes).groupBy("h", "g").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    classes = classes.withColumn("first", F.coalesce("first", F.lit(_NO_ID))).withColumn("key", F.monotonically_increasing_id())
    tune(spark)
    classes = materialise(classes, "vectors")
    bits, tables = layout(classes.count(), threshold)
    crowded = _codes(classes, bits, tables, kind, True).groupBy("dim", "cell").agg(F.sum("n").alias("n")).where(F.col("n") > block)
    crowded = materialise(crowded.select("dim", "cell", F.ceil(F.col("n") / block).alias("parts")), "vector-cells")
    chosen = materialise(active(_blocks(_codes(classes, bits, tables, kind, False), crowded), threshold), "vector-active")
    chosen = chosen.join(classes.select("key", "first", "weight", "vec"), "key")
    found = materialise(found_links(chosen, bits, tables, kind, threshold), "vector-links")
    reach = components(found.where("b IS NOT NULL").select(_node("a", "a_first").alias("a"), _node("b", "b_first").alias("b")))
    reach = reach.select(F.col("node.key").alias("key"), F.col("label.first").alias("component"))
    counted = found.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    component = F.coalesce("component", "first")
    of = classes.select("h", "g", "key", "first", "weight").join(counted, "key", "left").join(reach, "key", "left")
    of = of.select(
        F.col("h").alias("of_h"), F.col("g").alias("of_g"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.when(component != _NO_ID, component).alias("component_id"),
    )
    of = materialise(of, "vector-components")
    for done in (classes, crowded, found):
        discard(done)
    mine = good.select("vec_id", *hashes)
    linked = mine.join(of, (F.col("h") == F.col("of_h")) & (F.col("g") == F.col("of_g"))).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return linked.unionByName(alone).withColumn("kept", kept)
