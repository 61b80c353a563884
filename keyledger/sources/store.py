"""Versioned stores: each commit writes the buckets that it changes, then one small file that names the directory of every bucket.

Layout: ``<path>/version=<n>-<unique>/bucket=<b>/*.parquet`` sorted by key in each file, and ``<path>/_commits/<n>``, written last.
The current version is the highest commit, so a writer that dies leaves the old version in force. All files go
through Hadoop's file system API: the path may be on any store that Spark reaches. Buckets are ranges of keys, so
a lookup of one key reads one bucket, and a batch rewrites only the buckets in which it writes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyledger.errors import LedgerError
from keyledger.functions import keys


class ParquetStore:
    """A set of (key, value) with unique keys, kept as snapshots. A store that exists keeps its own number of buckets."""

    def __init__(self, spark: SparkSession, path: str, value_type: str = "string", num_buckets: int = 16, keep: int = 2):
        keys.bucket_bits(num_buckets)
        self.spark, self.path, self.value_type, self.num_buckets, self.keep = spark, path.rstrip("/"), value_type, num_buckets, max(2, keep)
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(f"{self.path}/_commits"))
        found = self.versions()
        if found:
            self.num_buckets = self._commit(found[-1])["num_buckets"]

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        # an empty file is a commit that is being written
        names = (s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/_commits")) if s.getLen())
        return sorted(int(n) for n in names if n.isdigit())

    def notes(self) -> dict:
        """What the current commit says of itself; empty before the first."""
        found = self.versions()
        return self._commit(found[-1])["notes"] if found else {}

    def _commit(self, number: int) -> dict:
        stream = self._fs.open(self._at(f"{self.path}/_commits/{number}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, buckets: Collection[int] | None = None) -> DataFrame:
        """The current snapshot, or some buckets of it: bucket, key, value; empty before the first commit."""
        found = self.versions()
        held = self._commit(found[-1])["buckets"] if found else {}
        paths = [f"{self.path}/version={v}/bucket={b}" for b, v in held.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], f"bucket long, key long, value {self.value_type}")
        reader = self.spark.read.schema(f"key long, value {self.value_type}, version string, bucket long").option("basePath", self.path)
        return reader.parquet(*paths).select("bucket", "key", "value")

    def lookup(self, key: int) -> DataFrame:
        """The entry of one key, if any: one bucket is read, and of it the row groups that may hold the key."""
        bucket = (key >> (64 - keys.bucket_bits(self.num_buckets))) + self.num_buckets // 2 if self.num_buckets > 1 else 0
        return self.read([bucket]).where(F.col("key") == key)

    def commit(self, entries: DataFrame, after_version: int | None = None, buckets: Collection[int] | None = None, dealt: bool = False, **notes) -> int:
        """Writes the next version to a directory of its own and makes it current, by a file that one writer only can create.

        after_version: the version that `entries` were made from (-1: none); by default the current one. Of two writers after one version the later fails.
        buckets: those that `entries` replace, where it isn't the whole store; the others stay as they are, files included.
        dealt: `entries` are already partitioned by ranges of keys.
        """
        found = self.versions()
        before = after_version if after_version is not None else found[-1] if found else -1
        number, unique = 1 + before, uuid.uuid4().hex
        target = f"{self.path}/version={number}-{unique}"
        if buckets is None or buckets:
            rows = entries.select("key", F.col("value").cast(self.value_type).alias("value"))
            # by range of the key, not by bucket: a bucket with most keys is still written by many tasks. Buckets are ranges too, so files stay few
            rows = (rows if dealt else rows.repartitionByRange("key")).withColumn("bucket", keys.range_bucket("key", self.num_buckets))
            rows.sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(target)
        last = self._commit(before) if buckets is not None and before in found else {"buckets": {}, "num_buckets": self.num_buckets}
        if last["num_buckets"] != self.num_buckets:
            raise LedgerError(f"{self.path} has {last['num_buckets']} buckets, not {self.num_buckets}")
        held = last["buckets"]
        held = {b: v for b, v in held.items() if int(b) not in buckets} | {b: f"{number}-{unique}" for b in self._written(target)}
        try:
            out = self._fs.create(self._at(f"{self.path}/_commits/{number}"), False)
        except Py4JJavaError as e:
            self._fs.delete(self._at(target), True)
            raise LedgerError(f"version {number} of {self.path} was committed by another writer") from e
        out.write(bytearray(json.dumps({"num_buckets": self.num_buckets, "buckets": held, "notes": notes}).encode()))
        out.close()
        self._forget(number)
        return number

    def _written(self, directory: str) -> list[str]:
        """Buckets of which a directory holds files."""
        there = self._at(directory)
        names = (s.getPath().getName() for s in self._fs.listStatus(there)) if self._fs.exists(there) else ()
        return [n.removeprefix("bucket=") for n in names if n.startswith("bucket=")]

    def _forget(self, current: int) -> None:
        """Drops commits beyond the last `keep`, and the files that no kept commit names."""
        found = [n for n in self.versions() if n <= current]
        old, kept = found[: -self.keep], found[-self.keep :]
        pairs = lambda numbers: {x for n in numbers for x in self._commit(n)["buckets"].items()}
        gone, live = pairs(old), pairs(kept)
        for number in old:
            self._fs.delete(self._at(f"{self.path}/_commits/{number}"), False)
        for bucket, version in gone - live:
            self._fs.delete(self._at(f"{self.path}/version={version}/bucket={bucket}"), True)
        for version in {v for _, v in gone} - {v for _, v in live}:
            self._fs.delete(self._at(f"{self.path}/version={version}"), True)

    def count(self) -> int:
        """Number of entries."""
        return self.read().count()
