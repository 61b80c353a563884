"""Merge an operation log with a store: one shuffle on the key, one sort, one pass.

The store's rows join the log as rows with ``op = 's'`` and ``seq = -1``, so that each key's state and operations lie
together in order. The value an operation reports is the key's state right after it. Presence is tracked apart
from the value, as stored values may be null.

Hot keys, those with more than `chunk` operations by a count of the log, are dealt out by ranges of `seq`, and each range starts
from a carried state: an aggregate of one row per key and range. A key's ranges are equally wide and hold `chunk` operations on
average, so one task holds a range of a hot key, not the key, though its operations depend on each other in order. Replacing writes only need
the last write of a range; appends need the merged values of a range since its last replacement. All other keys
go the short way, and results are the same for every `chunk`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyledger.errors import NotAppendable
from keyledger.functions import keys
from keyledger.operators import oplog
from keyledger.operators.combine import Combiner, combiner as as_combiner
from keyledger.sources.store import ParquetStore

UNIQUE, DUPLICATE = "UNIQUE_KEY", "DUPLICATE_KEY"
#: Operations of a key beyond which it is hot.
HOT = 100_000
#: Hot keys, of 24 bytes each, that may be broadcast.
FEW = 10_000
_REPLACES = ("u", "b")


def _writes() -> Column:
    return F.col("op") != oplog.CHECK


def _states(rows: DataFrame, by: list[str], comb: Combiner | None) -> DataFrame:
    """Adds `seen` (the key was present before) and `state` (its value after the row)."""
    order = W.partitionBy(*by).orderBy("seq")
    before, upto = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, 0)
    seen = F.coalesce(F.max(_writes()).over(before), F.lit(False))
    if comb is None:
        last = F.last(F.when(_writes(), F.struct("value")), ignorenulls=True).over(upto)
        return rows.withColumns({"seen": seen, "state": last["value"]})
    seg = F.sum(F.col("op").isin(*_REPLACES).cast("int")).over(upto)
    frame = W.partitionBy(*by, "seg").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumns({"seen": seen, "seg": seg}).withColumn("state", comb.running(F.when(_writes(), F.col("value")), frame)).drop("seg")


def _carried(seeded: DataFrame, comb: Combiner | None) -> DataFrame:
    """A seed row per key and range of `seq`, with the state in which the range begins."""
    if comb is None:
        ends = seeded.where(_writes()).groupBy("key", "range").agg(F.max_by(F.struct("value"), "seq").alias("last"))
        ends = ends.select("key", "range", F.lit("u").alias("op"), F.col("last.value").alias("value"))
    else:
        rows = seeded.where(_writes())
        since = W.partitionBy("key", "range")
        rows = rows.withColumn("cut", F.max(F.when(F.col("op").isin(*_REPLACES), F.col("seq"))).over(since))
        rows = rows.where(F.col("cut").isNull() | (F.col("seq") >= F.col("cut")))
        rows = rows.withColumn("state", comb.running(F.col("value"), W.partitionBy("key", "range").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)))
        ends = rows.groupBy("key", "range").agg(F.max_by(F.struct("state"), "seq").alias("last"), F.max("cut").isNotNull().alias("cut"))
        ends = ends.select("key", "range", F.when(F.col("cut"), "u").otherwise("a").alias("op"), F.col("last.state").alias("value"))
    here = seeded.select("key", "range").distinct().withColumn("op", F.lit(oplog.CHECK))
    ends = ends.withColumn("seq", F.col("range") * 2 + 1).drop("range")
    asks = here.select("key", (F.col("range") * 2).alias("seq"), "op", F.lit(None).cast(seeded.schema["value"].dataType).alias("value"))
    found = _states(ends.unionByName(asks), ["key"], comb).where((F.col("op") == oplog.CHECK) & F.col("seen"))
    return found.select(F.lit(-1).cast("long").alias("seq"), F.lit(oplog.SEED).alias("op"), "key", F.col("state").alias("value"), F.expr("seq div 2").alias("range"))


def _hot(log: DataFrame, chunk: int) -> DataFrame | None:
    """Keys with more than `chunk` operations, with the first `seq` and the width of their ranges; none if no key is hot.

    One count of the log, in part before the shuffle. Up to `FEW` hot keys are broadcast, so that the log isn't shuffled for them; more are left to Spark.
    """
    found = log.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi")).where(F.col("n") > chunk)
    found = found.select("key", "lo", F.greatest(F.expr(f"(hi - lo + 1) div ((n + {chunk - 1}) div {chunk})"), F.lit(1).cast("long")).alias("width"))
    some = found.limit(FEW + 1).collect()
    if len(some) > FEW:
        return found
    return F.broadcast(log.sparkSession.createDataFrame(some, found.schema)) if some else None


def _folded(rows: DataFrame, comb: Combiner) -> DataFrame:
    """The same as `_states` for a Python combiner: a key's rows stream through in order, with one state in memory."""
    out = T.StructType([*rows.schema.fields, T.StructField("seen", T.BooleanType()), T.StructField("state", rows.schema["value"].dataType)])
    fold = comb.fold

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, seen, state = None, False, None
        for pdf in batches:
            was, now = [], []
            for k, op, value in zip(pdf["key"], pdf["op"], pdf["value"], strict=True):
                if k != key:
                    key, seen, state = k, False, None
                was.append(seen)
                if op != oplog.CHECK:
                    missing = value is None or (isinstance(value, float) and value != value) or value is pd.NaT
                    value = None if missing else value
                    if op in _REPLACES or state is None:
                        state = value
                    elif value is not None:
                        state = fold(state, value)
                    seen = True
                now.append(state)
            yield pdf.assign(seen=was, state=pd.Series(now, index=pdf.index, dtype=object))

    dealt = rows.repartition("key").sortWithinPartitions("key", "seq")
    return dealt.mapInPandas(walk, out)


def merge(store: DataFrame, log: DataFrame, combine: str | Combiner | None = None, chunk: int | None = HOT, appends: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Results of the log's operations, and the store after it.

    store: `key`, `value`; log: see `oplog`. combine: how appends merge; without one, set `appends` to false
    (the default) and an append fails when it is met. chunk: see above; none splits no key. Results: seq, op, key, result, value, aux, callback. Empty
    inputs give empty results; other columns of the inputs are left out.
    """
    comb = as_combiner(combine)
    if appends and comb is None:
        raise NotAppendable("append-update needs a combiner")
    log = oplog.normalise(log)
    if comb is None:
        refuse = F.raise_error(F.lit("NotAppendable: append-update needs a combiner")).cast("string")
        log = log.withColumn("op", F.when(F.col("op") == oplog.APPEND_UPDATE, refuse).otherwise(F.col("op")))
    kind = log.schema["value"].dataType
    seeds = store.select(F.lit(-1).cast("long").alias("seq"), F.lit(oplog.SEED).alias("op"), F.col("key").cast("long").alias("key"), F.col("value").cast(kind).alias("value"), F.lit(None).cast(log.schema["aux"].dataType).alias("aux"))
    rows = seeds.unionByName(log)
    if comb is not None and comb.fold is not None:
        done = _folded(rows, comb)
        last = done
    elif chunk and (found := _hot(log, int(chunk))) is not None:
        place = F.when(F.col("width").isNull(), F.lit(0)).when(F.col("seq") < 0, F.lit(-1)).otherwise(F.expr("(seq - lo) div width"))
        rows = rows.join(found, "key", "left").withColumn("range", place.cast("long"))
        hot = rows.where(F.col("width").isNotNull()).drop("lo", "width")
        carried = _carried(hot, comb).where(F.col("range") >= 0).withColumn("aux", F.lit(None).cast(log.schema["aux"].dataType))
        done = _states(rows.where(F.col("range") >= 0).drop("lo", "width").unionByName(carried), ["key", "range"], comb)
        kept = seeds.withColumns({"range": F.lit(-1).cast("long"), "seen": F.lit(False), "state": F.col("value")})
        last = done.where(F.col("op") != oplog.SEED).unionByName(kept)
    else:
        done = _states(rows, ["key"], comb)
        last = done
    tests = F.col("op").isin(oplog.CHECK, oplog.CHECK_UPDATE)
    result = F.when(tests, F.when(F.col("seen"), DUPLICATE).otherwise(UNIQUE))
    results = done.where(F.col("op") != oplog.SEED).select("seq", "op", "key", result.alias("result"), F.when((F.col("op") != oplog.CHECK) | F.col("seen"), F.col("state")).alias("value"), "aux")
    results = results.withColumn("callback", callback())
    # the last row of a key that wrote has its final state; a struct keeps null values
    after = last.where(_writes()).groupBy("key").agg(F.max_by(F.struct("state"), "seq").alias("x")).select("key", F.col("x.state").alias("value"))
    return results, after


def callback() -> Column:
    """Name of the sink's callback for a result row."""
    many = F.col("result") == DUPLICATE
    return (
        F.when(F.col("result").isNull(), "update")
        .when(F.col("op") == oplog.CHECK, F.when(many, "duplicate_key_check").otherwise("unique_key_check"))
        .otherwise(F.when(many, "duplicate_key_update").otherwise("unique_key_update"))
    )


def check_only(store: DataFrame, log: DataFrame) -> DataFrame:
    """Results of a log of checks alone: a left join, as checks don't write. Broadcasts only what Spark's own size check allows."""
    log = oplog.normalise(log)
    held = store.select(F.col("key").alias("k"), F.col("value").alias("stored"), F.lit(True).alias("there"))
    joined = log.join(held, F.col("key") == F.col("k"), "left")
    result = F.when(F.col("there"), DUPLICATE).otherwise(UNIQUE)
    return joined.select("seq", "op", "key", result.alias("result"), F.col("stored").alias("value"), "aux")


def final_store(store: DataFrame, log: DataFrame) -> DataFrame:
    """The store after a log of replacing writes: a partial aggregate per key before the shuffle, so a hot key is no burden."""
    log = oplog.normalise(log).where(_writes())
    rows = store.select("key", F.lit(-1).cast("long").alias("seq"), F.col("value").cast(log.schema["value"].dataType).alias("value")).unionByName(log.select("key", "seq", "value"))
    return rows.groupBy("key").agg(F.max_by(F.struct("value"), "seq").alias("x")).select("key", F.col("x.value").alias("value"))


def merge_into(store: ParquetStore, log: DataFrame, out: str, combine: str | Combiner | None = None, chunk: int | None = HOT, before_commit: Callable[[DataFrame], None] | None = None, **notes) -> tuple[DataFrame, int]:
    """Merges a log with a store on disk and commits: the results, as read back from `out`, and the number of the new version.

    Only buckets that the log names are read, and of them only its keys are merged, once. The state after a write is its result, so the next
    version comes from the results on disk: one more shuffle, of the buckets in which the log writes. The others keep their files.
    The driver gets numbers of buckets, at most `num_buckets`.
    """
    spark, found = store.spark, store.versions()
    before = found[-1] if found else -1
    bucket = lambda df: {r[0] for r in df.select(keys.range_bucket("key", store.num_buckets)).distinct().collect()}
    held = store.read(bucket(log)) if found else store.read()
    asked = held.join(log.select(F.col("key").cast("long").alias("key")).distinct(), "key", "left_semi")
    merge(asked, log, combine, chunk)[0].write.mode("overwrite").parquet(out)
    done = spark.read.parquet(out)
    if before_commit:
        before_commit(done)
    written = done.where(_writes()).groupBy("key").agg(F.max_by(F.struct("value"), "seq").alias("x")).select("key", F.col("x.value").alias("value"), F.lit(1).alias("age"))
    touched = bucket(done.where(_writes()))
    kept = store.read(touched).select("key", F.col("value").cast(written.schema["value"].dataType).alias("value"), F.lit(0).alias("age"))
    rows = kept.unionByName(written).repartitionByRange("key").groupBy("key").agg(F.max_by(F.struct("value"), "age").alias("x"))
    number = store.commit(rows.select("key", F.col("x.value").alias("value")), before, touched, dealt=True, **notes)
    return done, number
