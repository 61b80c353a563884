"""The façade: a named ledger with a store, to which logs of operations are put."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyledger.errors import LedgerClosed, NotAppendable
from keyledger.functions import keys
from keyledger.operators import oplog, stats
from keyledger.operators.combine import Combiner, combiner as as_combiner
from keyledger.operators.merge import merge_into
from keyledger.sources.store import ParquetStore


@dataclass(frozen=True)
class Settings:
    """name: of the ledger and its directory. num_buckets: physical layout only; results don't depend on it. merge_bytes: buffered bytes after which `put` merges."""

    name: str
    path: str
    value_type: str = "string"
    aux_type: str = "string"
    num_buckets: int = 512
    merge_bytes: int = 65_536
    combine: str | Combiner | None = None

    def __post_init__(self) -> None:
        keys.bucket_bits(self.num_buckets)
        keys.bucket_bits(self.merge_bytes)
        as_combiner(self.combine)


class Engine:
    """A ledger. `apply` merges a log and returns its results; the four builders put logs that `flush` merges together."""

    def __init__(self, spark: SparkSession, settings: Settings, store: ParquetStore | None = None, dispatcher: Callable[[DataFrame], None] | None = None):
        self.spark, self.settings = spark, settings
        self.store = store or ParquetStore(spark, f"{settings.path.rstrip('/')}/{settings.name}", settings.value_type, settings.num_buckets)
        self._dispatcher, self._listeners, self._waiting, self._closed = dispatcher, [], [], False
        self._merged, self._bytes = [], [0, 0]

    @property
    def name(self) -> str:
        return self.settings.name

    @property
    def num_buckets(self) -> int:
        return self.settings.num_buckets

    def add_listener(self, listener: Callable[[dict], None]) -> None:
        """`listener` gets events: kind, and what belongs to it."""
        self._listeners.append(listener)

    def remove_listener(self, listener: Callable[[dict], None]) -> None:
        self._listeners.remove(listener)

    def _tell(self, **event) -> None:
        for f in self._listeners:
            f({"ledger": self.name} | event)

    def put(self, log: DataFrame) -> None:
        """Adds a log to those that wait; `seq` orders them. More than `merge_bytes` of keys and values, or of auxiliary data, that wait are merged."""
        if self._closed:
            raise LedgerClosed(f"{self.name} is closed")
        if log is not None:
            sizes = log.agg(F.coalesce(F.sum(keys.buffer_bytes("value")), F.lit(0)), F.coalesce(F.sum(keys.value_bytes("aux")), F.lit(0))).first()
            self._bytes = [x + y for x, y in zip(self._bytes, sizes, strict=True)]
            self._waiting.append(log)
            self._tell(kind="put", waiting=len(self._waiting))
            if max(self._bytes) > self.settings.merge_bytes:
                self._merge()

    def _typed(self) -> dict:
        return {"value_type": self.settings.value_type, "aux_type": self.settings.aux_type}

    def check(self, df: DataFrame, key, seq, aux=None) -> None:
        self.put(oplog.check(df, key, seq, aux, **self._typed()))

    def update(self, df: DataFrame, key, seq, value, aux=None) -> None:
        self.put(oplog.update(df, key, seq, value, aux, **self._typed()))

    def check_update(self, df: DataFrame, key, seq, value=None, aux=None) -> None:
        self.put(oplog.check_update(df, key, seq, value, aux, **self._typed()))

    def append_update(self, df: DataFrame, key, seq, value, aux=None) -> None:
        if self.settings.combine is None:
            raise NotAppendable(f"{self.name} has no combiner")
        self.put(oplog.append_update(df, key, seq, value, aux, **self._typed()))

    def _merge(self) -> None:
        """Merges what waits. Operations wait on if that fails."""
        if self._waiting:
            self._merged.append(self.apply(oplog.concat_logs(*self._waiting)))
            self._waiting, self._bytes = [], [0, 0]

    def flush(self) -> DataFrame | None:
        """Merges what waits; the results since the last flush, those of merges that `put` made too, or none."""
        self._merge()
        done, self._merged = self._merged, []
        return functools.reduce(DataFrame.unionByName, done) if done else None

    def apply(self, log: DataFrame) -> DataFrame:
        """Merges one log, commits the new store, and returns the results as read back from disk: all or nothing."""
        if self._closed:
            raise LedgerClosed(f"{self.name} is closed")
        self._tell(kind="merging")
        found = self.store.versions()
        out = f"{self.store.path}/_results/{found[-1] + 1 if found else 0}-{uuid.uuid4().hex}"
        done, number = merge_into(self.store, log, out, self.settings.combine)
        if self._dispatcher:
            self._dispatcher(done)
        if self._listeners:
            self._tell(kind="finished", version=number, entries=self.store.count())
        return done

    def statistics(self) -> DataFrame:
        """Entries and bytes of the store."""
        return stats.store_length(self.store.read())

    def close(self) -> DataFrame | None:
        """Merges what waits, then refuses more."""
        if self._closed:
            return None
        try:
            return self.flush()
        finally:
            self._closed = True
            self._tell(kind="closed")

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()
