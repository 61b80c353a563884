"""Operation logs on disk, and sinks for results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyledger.operators.stats import with_bucket


def write_log(log: DataFrame, path: str, num_buckets: int = 16, mode: str = "append") -> None:
    """Appends operations to a log, one directory per bucket."""
    with_bucket(log, num_buckets).write.mode(mode).partitionBy("bucket").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log, with its bucket as a column that prunes directories."""
    return spark.read.parquet(path)


def stream_log(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None, bytes_per_trigger: str | None = None) -> DataFrame:
    """A growing directory of log files as a stream; the limits play the part of buffer sizes."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.parquet(path)


def dispatch(results: DataFrame, handlers: dict[str, Callable[[dict], None]], num_buckets: int = 512) -> None:
    """Calls handlers by callback name, on the executors, per row, in order of arrival within a bucket; callbacks without a handler pass silently.

    A bucket goes through one task, sorted by Spark, which spills, and row by row. Handlers can be any picklable clients.
    """
    wanted = results.where(F.col("callback").isin(*handlers)) if handlers else results.limit(0)

    def send(rows) -> None:
        for row in rows:
            handlers[row["callback"]]({k: v for k, v in row.asDict().items() if k != "bucket"})

    with_bucket(wanted, num_buckets).repartition("bucket").sortWithinPartitions("bucket", "seq").foreachPartition(send)


def console(results: DataFrame, n: int = 20) -> None:
    """Prints some results in dispatch order."""
    results.orderBy("key", "seq").show(n, truncate=False)
