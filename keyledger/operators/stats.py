"""Bytes, counts and state changes of a log or store, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyledger.functions import keys


def with_bucket(log: DataFrame, num_buckets: int) -> DataFrame:
    """Routes operations: adds `bucket`, whose order is the order of keys."""
    return log.withColumn("bucket", keys.range_bucket("key", num_buckets))


def bucket_bytes(log: DataFrame, num_buckets: int) -> DataFrame:
    """Per bucket: operations, bytes of their records and of the auxiliary records."""
    return with_bucket(log, num_buckets).groupBy("bucket").agg(F.count(F.lit(1)).alias("n_ops"), F.sum(keys.log_bytes("value")).alias("kv_bytes"), F.sum(keys.aux_bytes("aux")).alias("aux_bytes"))


def buffered_bytes(log: DataFrame, num_buckets: int) -> DataFrame:
    """Per bucket: bytes that its buffer counts."""
    return with_bucket(log, num_buckets).groupBy("bucket").agg(F.sum(keys.buffer_bytes("value")).alias("kv_bytes"), F.sum(keys.value_bytes("aux")).alias("aux_bytes"))


def buffer_state_changes(log: DataFrame, num_buckets: int, limit: int) -> DataFrame:
    """Operations at which a bucket's buffer passes from one state to another.

    A bucket is EMPTY before its first operation. While nothing is taken out of it, it is WITHIN_LIMIT as long as neither its bytes of keys and values
    nor those of auxiliary data are more than the limit, and EXCEEDED_LIMIT from then on. Equal to the limit is within.
    """
    w = W.partitionBy("bucket").orderBy("seq")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = with_bucket(log, num_buckets).withColumns({"total": F.sum(keys.buffer_bytes("value")).over(upto), "aux_total": F.sum(keys.value_bytes("aux")).over(upto)})
    rows = rows.withColumn("state", F.when((F.col("total") > limit) | (F.col("aux_total") > limit), "EXCEEDED_LIMIT").otherwise("WITHIN_LIMIT"))
    rows = rows.withColumn("before", F.coalesce(F.lag("state").over(w), F.lit("EMPTY")))
    return rows.where(F.col("state") != F.col("before")).select("bucket", "seq", "state", "total", "aux_total")


def store_length(store: DataFrame) -> DataFrame:
    """Entries and bytes of a store."""
    return store.agg(F.count(F.lit(1)).alias("n_entries"), F.coalesce(F.sum(keys.entry_bytes("value")), F.lit(0)).cast("long").alias("n_bytes"))


def result_counts(results: DataFrame) -> DataFrame:
    """Operations per kind and result."""
    return results.groupBy("op", "result").agg(F.count(F.lit(1)).alias("n"))
