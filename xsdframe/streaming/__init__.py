"""Streams of XML. Every row function is stateless, so plans run unchanged on streams; this
package has the source and a sink that keeps bad documents apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Plan, safe_parse_xml
from ..operators.shred import decoded


def read_documents(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """A stream of (path, xml): whole files as they arrive, decoded by their own encoding."""
    files = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", max_files).schema(
        "path string, modificationTime timestamp, length long, content binary"
    ).load(folder)
    return files.select("path", decoded(F.col("content")).alias("xml"))


def parse_stream(stream: DataFrame, column: str, plan: Plan, into: str = "doc") -> DataFrame:
    """A stream with typed values and violations."""
    return safe_parse_xml(stream, column, plan, into)


def write_split(parsed: DataFrame, good: str, bad: str, checkpoint: str, into: str = "doc") -> StreamingQuery:
    """Documents without violations go to `good`, the others with their violations to `bad`,
    both as Parquet, in one pass over each batch; runs until all input there is is done.

    Each batch has folders of its own (batch=N, a column when the tables are read), which a
    batch that is run again after a failure replaces, so no document is written twice."""

    def split(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            batch.where(F.size("_issues") == 0).drop("_issues").write.mode("overwrite").parquet(f"{good}/batch={number}")
            batch.where(F.size("_issues") > 0).drop(into).write.mode("overwrite").parquet(f"{bad}/batch={number}")
        finally:
            batch.unpersist()

    return parsed.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
