"""What the operators share: picking columns, the shared folder, sliced Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that the JVM puts in one Arrow batch at most; long texts then
#: cannot make a batch of many gigabytes.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Bytes of text that Python code works on at once: array operations hold some 60 bytes for
#: each, so operators that keep several arrays take HALF_SLICE.
SLICE_BYTES, HALF_SLICE = 1 << 20, 1 << 19

_LOCAL_DIRS: dict[str, str] = {}


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session. Results are lazy, and a plan takes these
    settings when it runs, so they stay; tighter ones of the caller's are kept."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        told = re.fullmatch(r"(\d+)", spark.conf.get(f"spark.sql.execution.arrow.{name}"))
        if not told or not 0 < int(told[1]) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact name, whatever other columns there are.

    Columns whose names differ by case only, or that occur twice, do not make a
    reference ambiguous: the first exact match is taken, by its position.
    """
    have = df.columns
    at = [have.index(n) for n in names]
    return named_by_place(df).select(*(F.col(f"_c{i}").alias(n) for i, n in zip(at, names)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a temporary folder is set, in local mode only: on a
    cluster a machine's own folder is not seen by the others.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="xsdframe-")
    return _LOCAL_DIRS[sc.applicationId]


_SCRATCH: list[list[str]] = []


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def named_by_place(df: DataFrame) -> DataFrame:
    """df with columns _c0, _c1, ...: no name clashes with another."""
    return df.toDF(*(f"_c{i}" for i in range(len(df.columns))))


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and the
    files survive a lost executor. Names that differ by case only, or occur twice, are kept."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    names = df.columns
    clash = len({n.lower() for n in names}) < len(names)
    plain = named_by_place(df) if clash else df
    plain.write.parquet(path)
    back = spark.read.schema(plain.schema).parquet(path)
    return back.toDF(*names) if clash else back


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in paths:
        path = hadoop.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def discard_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that fresh_path() named."""
    _delete(spark, [path])


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialise() wrote."""
    _delete(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end what the code inside wrote to the shared folder. The list of those
    folders is given; what is taken out of it stays."""
    _SCRATCH.append([])
    try:
        yield _SCRATCH[-1]
    finally:
        made = _SCRATCH.pop()
        _delete(spark, made)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch whose texts hold about `most` bytes; one row at least."""
    values = batch.column(batch.schema.get_field_index(column))
    sizes = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(n)
    if begin < len(sizes):
        yield batch.slice(begin)


def map_slices(
    df: DataFrame, column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, most: int = SLICE_BYTES
) -> DataFrame:
    """mapInArrow over slices of bounded text size."""
    tune(df.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, most):
                yield work(part)

    return df.mapInArrow(run, schema)


def filter_slices(df: DataFrame, column: str, keep: Callable[[pa.Array], object], most: int = SLICE_BYTES) -> DataFrame:
    """The rows that `keep`, given a slice of the column, marks as true; all columns stay as
    they are, whatever their names."""
    tune(df.sparkSession)
    at = df.columns.index(column)
    plain = named_by_place(df)

    def run(batches):
        for batch in batches:
            for part in slices(batch, f"_c{at}", most):
                yield part.filter(pa.array(keep(part.column(at)), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)
