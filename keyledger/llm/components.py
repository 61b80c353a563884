"""Connected components of an edge table: edges contracted within each task, then rounds of large-star and small-star, each a written table.

A task replaces the edges that it holds, a bounded number at a time, by one edge from each end to the least end that they reach. This
drops only what is implied, so it is exact, and what one task holds needs no rounds. Every round is aggregates and joins on the edge's
ends. A hub's edges are reduced to its least neighbour by a partial aggregate before the shuffle; the join that hands it back is one
that adaptive execution splits. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyledger.llm.common import Scratch

#: Edges that a task contracts at a time.
HELD = 1 << 20


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (end, least end that it reaches) with the same components; loops go."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        now = label.copy()
        least = np.minimum(label[a], label[b])
        for end in (a, b, label[a], label[b]):
            np.minimum.at(now, end, least)
        while not np.array_equal(far := now[now], now):
            now = far
        if np.array_equal(now, label):
            break
        label = now
    ends = np.flatnonzero(label != np.arange(len(ids)))
    return ids[ends], ids[label[ends]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges u > v, contracted within each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, n = [], [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in contract(np.concatenate(u), np.concatenate(v))], ["u", "v"])

        for batch in batches:
            u.append(batch.column(0).to_numpy())
            v.append(batch.column(1).to_numpy())
            n += batch.num_rows
            if n >= HELD:
                out = done()
                if out.num_rows > n // 2:  # few are implied: give them away
                    yield out
                    u, v, n = [], [], 0
                else:
                    u, v, n = [out.column(0).to_numpy()], [out.column(1).to_numpy()], out.num_rows
        if n:
            yield done()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        sides = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m"))
    joined = sides.join(least, "u").withColumn("m", F.least("m", "u"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _stars_only(edges: DataFrame) -> bool:
    """Whether every end is either a centre or has one edge to its centre, which then is the least of its component."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """`(id, component)` for every id with an edge; component: the smallest id reachable. edges: `u`, `v` longs, any order, repeats and loops allowed, no nulls."""
    now = scratch.save(_contracted(edges).repartition("u").transform(_contracted).distinct(), "edges")
    while not _stars_only(now):
        then = scratch.save(_stars(_stars(now, True), False), "edges")
        scratch.drop(now)
        now = then
    members = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
