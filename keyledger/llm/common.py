"""What the operators share: scratch tables on storage that all executors see, and Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyledger.llm.url_filter import build_filter, may_contain


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where none is named, one in the warehouse, which executors share too."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return found.rstrip("/") if found else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/keyledger-shared"


_held: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps between batches and tasks: one thing at a time, of the operator that runs now. Workers live on from stage to
    stage, so what an earlier operator left goes when another one takes the place, and its memory goes back to the system."""
    if key not in _held:
        if _held:
            _held.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass
        _held[key] = make()
    return _held[key]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Tables written to cut lineage: a lost executor costs a stage, never the whole history. `drop` frees one early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self._n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.base}/{self._n}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the table and reads it back."""
        path = self.path(name)
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._scratch_path = path
        return saved

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def free(self) -> None:
        """Lets the executors delete shuffle files that no plan needs any more: Spark does so when the driver collects garbage, which may be much later."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def among(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of `df` whose key is in `ids` (saved, one column of that name and type), by a semi-join that shuffles few other rows.

    A blocked Bloom filter of bounded size goes before it. With more ids than it is made for it lets more rows pass, and the join stays exact.
    """
    words, blocks = build_filter(ids, key)
    return df.where(may_contain(F.col(key), words, blocks)).join(ids, key, "left_semi")


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch] | None], schema: str) -> DataFrame:
    """Applies `f` to each batch; it gives a batch, several, or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = f(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out

    return df.mapInArrow(run, schema)


def flag(column: Column, test: Callable[[pa.Array], pa.Array]) -> Column:
    """A boolean column: `test` of a column's batches. Only that column goes to Python."""

    @F.arrow_udf("boolean")
    def run(x: pa.Array) -> pa.Array:
        return test(x)

    return run(column)


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """The strings of a column, one at a time, so that a batch is not held twice."""
    for x in column:
        yield x.as_py()


def pieces(column: pa.Array, most: int = 500_000) -> Iterator[tuple[int, list[str | None]]]:
    """Rows of a text column in pieces of about that many characters: where a piece begins, and its texts."""
    part, begin, size = [], 0, 0
    for k, text in enumerate(texts_of(column)):
        part.append(text)
        size += len(text or "")
        if size >= most:
            yield begin, part
            part, begin, size = [], k + 1, 0
    if part:
        yield begin, part
