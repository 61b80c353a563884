"""How an append-update merges with the value before it: null is the identity, order is stored-then-new.

Built-in combiners are column expressions over the values of one segment (the writes since the last replacement,
in order). Any other is a Python function of two values, applied in order by `applyInPandas`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Combiner:
    """name; running: of the value column and the segment's frame, the merged value up to each row; fold: a Python function instead."""

    name: str
    running: Callable[[Column, object], Column] | None = None
    fold: Callable | None = None


def _listed(value: Column, frame) -> Column:
    return F.collect_list(value).over(frame)


def _lists(then: Callable[[Column], Column]) -> Callable:
    def running(value: Column, frame) -> Column:
        parts = _listed(value, frame)
        return F.when(F.size(parts) > 0, then(F.flatten(parts)))

    return running


def _record(array_field: str) -> Callable:
    """Structs: scalar fields of the first non-null value, the set field united."""

    def running(value: Column, frame) -> Column:
        parts = _listed(value, frame)
        merged = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(parts, lambda v: v[array_field].isNotNull()), lambda v: v[array_field]))))
        return F.when(F.size(parts) > 0, F.element_at(parts, 1).withField(array_field, merged))

    return running


SET_UNION = Combiner("set_union", _lists(lambda x: F.array_sort(F.array_distinct(x))))
LIST_CONCAT = Combiner("list_concat", _lists(lambda x: x))
SUM = Combiner("sum", lambda v, f: F.sum(v).over(f))
MIN = Combiner("min", lambda v, f: F.min(v).over(f))
MAX = Combiner("max", lambda v, f: F.max(v).over(f))
REGISTRY = {c.name: c for c in (SET_UNION, LIST_CONCAT, SUM, MIN, MAX)}


def struct_union(array_field: str) -> Combiner:
    """Records whose `array_field` is a set: sets unite, other fields stay as first stored."""
    return Combiner(f"struct_union({array_field})", _record(array_field))


def custom(fold: Callable) -> Combiner:
    """A user's merge of two non-null values, ``fold(stored, new)``."""
    return Combiner("custom", fold=fold)


def combiner(spec: str | Combiner | None) -> Combiner | None:
    """By name, itself, or none."""
    if spec is None or isinstance(spec, Combiner):
        return spec
    if spec not in REGISTRY:
        raise ValueError(f"unknown combiner {spec!r}; known: {', '.join(REGISTRY)}")
    return REGISTRY[spec]
