"""Packing along a space-filling curve.

Each document's ids are hashed into a bag of BUCKETS counts; square roots of the counts,
scaled to length one and projected by a fixed random matrix, give a point in DIMS
dimensions, whose place on a Hilbert curve is the document's key. Documents are ordered
by (key, a hash of the id), laid end to end, and the line is cut every `length` ids:
only the last sequence has padding, and neighbours in a sequence are neighbours on the
curve. The hash below the key keeps a large group of equal documents from being one
indivisible key.

The order is cut into ranges by range-partitioning the keys; a range's documents are
summed in a window, ranges by their totals, so no task and no driver sees more than its
range. Ids travel as 16-bit numbers where the vocabulary allows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_slices, materialise, pick, shuffle_parts, tune
from .spans import tokenizer_encoder

BUCKETS, DIMS, BITS, TIE_BITS, SEED = 256, 4, 8, 24, 7
#: Ids in a range: so many at least, where there are, and so many at most, about. Ranges for
#: each shuffle partition.
LEAST_IDS, MOST_IDS, SPREAD = 1 << 18, 1 << 25, 8


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows of cells, 0 <= cell < 2**bits).

    Works from the highest bit down: a set bit reflects the first axis below it, a clear
    one exchanges them; a Gray code over the axes then orders the sub-cubes.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        low = q - 1
        for d in range(dims):
            up = (x[d] & q) > 0
            swap = np.where(up, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[dims - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[d] >> level & 1)
    return key


def _projection() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((BUCKETS, DIMS))


def _mix(ids: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of integers."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def curve_keys(ids: np.ndarray, count: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """The curve key of each document, from all ids in a row and each document's number of them."""
    n = len(count)
    bucket = (_mix(ids) >> np.uint64(56)).astype(np.int64) % BUCKETS
    owner = np.repeat(np.arange(n), count)
    bags = np.bincount(owner * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    v = np.sqrt(bags)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    point = np.clip((v @ projection + 3) / 6, 0, 1)
    return hilbert_key(np.minimum((point * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def encoded(docs: DataFrame, tokenizer: str, end_id: int, wide: bool, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, okey long, doc_tokens long, ids binary): the order key and the ids with the end id."""
    kind = "<u4" if wide else "<u2"

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, count = tokenizer_encoder(tokenizer, True).encode(part.column(1).to_pylist())
        count = count + 1
        ends = np.cumsum(count)
        whole = np.full(int(ends[-1]), end_id, np.uint32)
        own = np.ones(len(whole), bool)
        own[ends - 1] = False
        whole[own] = ids
        doc = part.column(0).cast(pa.int64())
        tie = _mix(doc.fill_null(-1).to_numpy(zero_copy_only=False)) >> np.uint64(64 - TIE_BITS)
        key = curve_keys(whole, count, _projection()) << TIE_BITS | tie.astype(np.int64)
        raw = whole.astype(kind).tobytes()
        size = np.dtype(kind).itemsize
        held = pa.Array.from_buffers(
            pa.binary(), len(count), [None, pa.py_buffer(np.concatenate(([0], ends * size)).astype(np.int32)), pa.py_buffer(raw)]
        )
        return pa.record_batch([doc, pa.array(key), pa.array(count), held], ["doc_id", "okey", "doc_tokens", "ids"])

    return map_slices(
        pick(docs, id, text).toDF("doc_id", "text"), "text", work, "doc_id long, okey long, doc_tokens long, ids binary"
    )


def ranges_for(total: int, parts: int) -> int:
    """How many ranges the order is cut into: SPREAD for each shuffle partition, with no fewer
    than LEAST_IDS ids each where that can be, and never more than MOST_IDS. Ranges hold
    about as many documents each, and long documents lie together on the curve; dealt in
    turn, ranges of long documents go to different partitions."""
    return max(1, min(SPREAD * parts, total // LEAST_IDS), -(-total // MOST_IDS))


def range_codes(spark: SparkSession, ranges: int, parts: int) -> np.ndarray:
    """A number for each range, such that hashing deals them evenly to the partitions. (Some 40
    numbers for each partition come to the driver.)"""
    tried = 40 * parts + 4 * ranges
    dealt = spark.range(tried).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p"), "id")
    lists: dict[int, list[int]] = {}
    for r in dealt.groupBy("p").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect():
        lists[r.p] = r.ids
    out = []
    for k in range(ranges):
        fit = lists.get(k % parts, [])
        out.append(fit[k // parts] if k // parts < len(fit) else tried + k)
    return np.array(out, np.int32)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _placed(table: DataFrame) -> DataFrame:
    """`at`: how many ids stand before each document in the whole order.

    Spark's range partitioner orders the keys alone; the last key and the sum of ids of each
    range come to the driver (16 bytes for each), and one pass over the documents gives each
    its range and what stands before it."""
    spark = table.sparkSession
    total = table.agg(F.sum("doc_tokens")).first()[0] or 0
    ranges = ranges_for(total, shuffle_parts(spark))
    keys = table.select("okey", "doc_tokens").repartitionByRange(ranges, "okey")
    found = keys.groupBy(F.spark_partition_id().alias("p")).agg(F.max("okey").alias("last"), F.sum("doc_tokens").alias("n"))
    with _setting(spark, "spark.sql.execution.rangeExchange.sampleSizePerPartition", "8"):  # of keys that the driver sees
        found = sorted((r.last, r.n) for r in found.collect())  # no key is in two ranges
    last, n = (np.array(c, np.int64) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    bounds = spark.sparkContext.broadcast((last, np.cumsum(n) - n, range_codes(spark, len(last), shuffle_parts(spark))))

    @F.arrow_udf("struct<range:int,base:long>")
    def range_of(key: pa.Array) -> pa.Array:
        cuts, base, codes = bounds.value
        at = np.searchsorted(cuts, key.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(codes[at]), pa.array(base[at])], ["range", "base"])

    rows = table.withColumn("r", range_of.asNondeterministic()("okey"))  # so it runs once
    inside = Window.partitionBy("r.range").orderBy("okey", "doc_id", "doc_tokens", "ids").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("at", F.col("r.base") + F.coalesce(F.sum("doc_tokens").over(inside), F.lit(0)))


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 4096, text: str = "text", id: str = "doc_id",
    wide: bool = False, with_ids: bool = False,
) -> DataFrame:
    """The pieces of all documents, as PIECE and, with_ids, `ids array<int>`.

    Sequences have `length` ids, but for the last, which is padded. Null and empty texts
    have the end id only; repeated rows are packed as often as they occur (which of two
    equal rows comes first does not show); ties in the order go by id, number of ids and
    ids; null ids come first; an empty table gives no pieces. wide: the vocabulary has
    more than 65,536 ids.
    """
    kind = "<u4" if wide else "<u2"
    tune(docs.sparkSession)
    table = materialise(encoded(docs, tokenizer, end_id, wide, text, id), "packing")

    def run(batches):
        for batch in batches:
            doc, at = batch.column(0), batch.column(1).to_numpy()
            count = batch.column(2).to_numpy()
            pieces = (at + count - 1) // length - at // length + 1
            row = np.repeat(np.arange(len(at)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = (at // length)[row] + nth
            begin = np.maximum(at[row], sequence * length)
            end = np.minimum((at + count)[row], (sequence + 1) * length)
            crc, parts = [], []
            held, last = batch.column(3), -1
            for r, a, b in zip(row.tolist(), (begin - at[row]).tolist(), (end - at[row]).tolist()):
                if r != last:
                    ids, last = np.frombuffer(held[r].as_buffer(), kind), r
                crc.append(zlib.crc32(ids[a:b].astype("<u4")))
                if with_ids:
                    parts.append(ids[a:b].astype(np.int32))
            out = [
                doc.take(pa.array(row)), pa.array(begin - at[row]), pa.array(end - begin), pa.array(crc, pa.int64()),
                pa.array(count[row]), pa.array(sequence), pa.array(begin - sequence * length),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                out.append(pa.array(parts, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(out, names)

    placed = _placed(table).select("doc_id", "at", "doc_tokens", "ids")
    return placed.mapInArrow(run, PIECE + (", ids array<int>" if with_ids else ""))
