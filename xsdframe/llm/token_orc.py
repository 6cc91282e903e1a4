"""Token files in ORC.

Documents are range-partitioned and sorted by id, encoded in place, and written one
file for each partition: a row is a document with its ids as a list of integers, which
ORC stores run-length encoded (version 2) in stripes. Row indexes and Bloom filters on
doc_id let a reader that looks for some documents skip stripes and row groups by
metadata; stripes are the unit of parallel reading.

A writer knows how many ids precede a document in its file, not in all files, so that
is what the file holds; readers add the totals of the files before.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, pick, slices, tune
from .spans import MANY, tokenizer_encoder

SCHEMA = "doc_id long, start_in_file long, n_tokens long, ids array<int>"


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 0, text: str = "text", id: str = "doc_id") -> DataFrame:
    """SCHEMA rows in ascending doc_id order (null first; ties by text, null first). Null
    and empty texts have the end id only; repeated rows are encoded as often as they occur."""

    def run(batches):
        encoder, done = tokenizer_encoder(tokenizer, False, MANY), 0
        for batch in batches:
            for part in slices(batch, "text", 2 * SLICE_BYTES):
                ids, count = encoder.encode(part.column(1).to_pylist())
                count = count + 1
                ends = np.cumsum(count)
                out = np.empty(int(ends[-1]), np.int32)
                end = np.zeros(len(out), bool)
                end[ends - 1] = True
                out[end], out[~end] = end_id, ids
                lists = pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), pa.array(out))
                yield pa.record_batch(
                    [part.column(0).cast(pa.int64()), pa.array(done + ends - count), pa.array(count), lists],
                    ["doc_id", "start_in_file", "n_tokens", "ids"],
                )
                done += int(ends[-1])

    tune(docs.sparkSession)
    rows = pick(docs, id, text).toDF("doc_id", "text")
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA)


def write(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, text: str = "text", id: str = "doc_id",
    stripe_bytes: int = 64 << 20, index_rows: int = 1000, bloom_fpp: float = 0.01, compression: str = "zstd",
) -> None:
    """Write the token files of all documents to the folder `path`."""
    (
        encoded(docs, tokenizer, end_id, text, id)
        .write.format("orc").option("compression", compression)
        .option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", index_rows)
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", bloom_fpp)
        .save(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """SCHEMA and the file's number. Filters on doc_id reach the stripes' metadata. Files of an
    empty table give no row."""
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    return spark.read.schema(SCHEMA).orc(path).select("*", part.alias("part"))


def with_starts(files: DataFrame, rows: DataFrame) -> DataFrame:
    """`start`, the ids of all documents before, for rows that kept part and start_in_file.
    files: all files as read() gives them; of each only its total is gathered."""
    total = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = total.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "part").withColumn("start", F.col("base") + F.col("start_in_file")).drop("base", "part", "start_in_file")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files. An empty table
    gives an empty result."""

    def run(batches):
        for batch in batches:
            lists = batch.column(4)
            ids, ends = np.ascontiguousarray(lists.values.to_numpy(), "<i4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.record_batch(
                [*(batch.column(i) for i in range(4)), pa.array(crc, pa.int64())],
                ["doc_id", "part", "start_in_file", "n_tokens", "ids_crc32"],
            )

    tune(spark)
    files = read(spark, path)
    rows = files.select("doc_id", "part", "start_in_file", "n_tokens", "ids").mapInArrow(
        run, "doc_id long, part long, start_in_file long, n_tokens long, ids_crc32 long"
    )
    return with_starts(files, rows).select("doc_id", "start", "n_tokens", "ids_crc32")
