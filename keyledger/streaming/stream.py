"""Continuous operation: each micro-batch of a log merges into a versioned store.

State is the store, without a watermark: operations carry no event time, and dropping late ones would be wrong.
A batch commits its number with its snapshot, so a replayed batch is skipped; its results, which are written
under the batch's number, are replaced by equal ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from keyledger.operators.combine import Combiner
from keyledger.operators.merge import merge_into
from keyledger.sources.store import ParquetStore


def start(log: DataFrame, store: ParquetStore, results_path: str, checkpoint: str, combine: str | Combiner | None = None, on_batch: Callable[[DataFrame, int], None] | None = None, available_now: bool = True) -> StreamingQuery:
    """Starts the stream; `results_path` receives ``batch=<n>`` directories of results."""

    def step(batch: DataFrame, number: int) -> None:
        if store.notes().get("batch", -1) >= number:
            return
        ops = batch.persist()
        try:
            out = f"{results_path}/batch={number}"
            merge_into(store, ops, out, combine, before_commit=on_batch and (lambda done: on_batch(done, number)), batch=number)
        finally:
            ops.unpersist()

    writer = log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


class Progress(StreamingQueryListener):
    """Collects phases of a stream for registered listeners: started, progress with rows, terminated."""

    def __init__(self, tell: Callable[[dict], None]):
        self._tell = tell

    def onQueryStarted(self, event) -> None:
        self._tell({"kind": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._tell({"kind": "progress", "id": str(p.id), "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:
        self._tell({"kind": "idle", "id": str(event.id)})

    def onQueryTerminated(self, event) -> None:
        self._tell({"kind": "terminated", "id": str(event.id), "error": event.exception})
