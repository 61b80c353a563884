"""The operation log: rows ``(seq, op, key, value, aux)``.

``seq`` (0 or more, unique per key) is the order of arrival; a key's operations take effect in that order.
Text values of no length count as null. Null keys, unknown operations and negative ``seq`` fail, never drop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECK, UPDATE, CHECK_UPDATE, APPEND_UPDATE, SEED = "c", "u", "b", "a", "s"
OPS = (CHECK, UPDATE, CHECK_UPDATE, APPEND_UPDATE)
COLUMNS = ("seq", "op", "key", "value", "aux")


def _value(df: DataFrame, value: Column | str | None, like: str) -> Column:
    if value is None:
        return F.lit(None).cast(like)
    return F.col(value) if isinstance(value, str) else value


def operations(df: DataFrame, op: str | Column, key: Column | str, seq: Column | str, value=None, aux=None, value_type: str = "string", aux_type: str = "string") -> DataFrame:
    """An operation log from any DataFrame; `op` is a token or a column of tokens."""
    token = F.lit(op) if isinstance(op, str) and op in OPS else op
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(as_col(seq).cast("long").alias("seq"), as_col(token).alias("op"), as_col(key).cast("long").alias("key"), _value(df, value, value_type).alias("value"), _value(df, aux, aux_type).alias("aux"))


def check(df, key, seq, aux=None, **kw):
    """Existence tests."""
    return operations(df, CHECK, key, seq, None, aux, **kw)


def update(df, key, seq, value, aux=None, **kw):
    """Inserts or replacements."""
    return operations(df, UPDATE, key, seq, value, aux, **kw)


def check_update(df, key, seq, value=None, aux=None, **kw):
    """Existence tests that write."""
    return operations(df, CHECK_UPDATE, key, seq, value, aux, **kw)


def append_update(df, key, seq, value, aux=None, **kw):
    """Inserts, or merges with the stored value."""
    return operations(df, APPEND_UPDATE, key, seq, value, aux, **kw)


def concat_logs(*logs: DataFrame) -> DataFrame:
    """One log of several; `seq` decides the order."""
    return reduce(lambda a, b: a.unionByName(b), logs)


def normalise(log: DataFrame) -> DataFrame:
    """Checked log: bad rows raise when they are read; empty texts become null."""
    known = F.coalesce(F.col("op").isin(*OPS), F.lit(False))
    fail = lambda ok, what, c, kind: F.when(ok, F.col(c)).otherwise(F.raise_error(F.lit(what)).cast(kind)).alias(c)
    kinds = dict(zip(log.columns, (f.dataType for f in log.schema.fields), strict=True))
    text = lambda c: F.when(F.length(F.col(c)) > 0, F.col(c)).alias(c) if isinstance(kinds[c], (T.StringType, T.BinaryType)) else F.col(c)
    aux = text("aux") if "aux" in kinds else F.lit(None).cast("string").alias("aux")
    return log.select(
        fail(F.coalesce(F.col("seq") >= 0, F.lit(False)), "an operation needs a seq of 0 or more", "seq", "long"),
        fail(known, "unknown operation", "op", "string"),
        fail(F.col("key").isNotNull(), "an operation needs a key", "key", "long"),
        text("value"),
        aux,
    )
