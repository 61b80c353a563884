"""Links between items with nearly equal shingle sets, and the components they form.

Items come with several keys (a band, or a prefix of a sorted signature order) and a 16-byte sketch. Rows are sorted
by key across the cluster, by range, so that even one key's rows are split between tasks. Then:

1. A key with few rows (LIGHT) gives all its pairs, a bounded number per row. In a key with more rows each row meets its
   WINDOW next ones in the sorted order, which share the longest prefixes. Pairs that the ends of two tasks cut apart are
   made up for from the edges of all tasks.
2. Pairs whose sketches differ by far more than the similarity allows (6 standard errors) go. Of the others each item's
   two nearest are verified on the full sets, and the links give components.
3. What a crowded key left out is made up for: a crowded key whose rows all lie in one component needs nothing. In any other
   every row outside the largest component meets every row, tile by tile, on sketches. Each such row's nearest few are
   verified, the components grow, and what then still lies between two components is verified within the tiles, on full sets. So
   links aren't lost to crowding, nor does any task hold a whole crowd, and no row is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyledger.llm import shingles as S
from keyledger.llm.common import Scratch, arrow_map
from keyledger.llm.components import components

LIGHT, WINDOW, TILE = 32, 8, 2048
PAIR = "a long, b long, agree int"


def least_agreement(num: int, den: int) -> int:
    """Sketch bits that two sets of this similarity agree in, less 6 standard errors."""
    p = (1 + num / den) / 2
    return int(S.PERMS * p - 6 * (S.PERMS * p * (1 - p)) ** 0.5)


def _bits(column: pa.Array) -> np.ndarray:
    """Rows of two 64-bit words from a column of 16-byte values."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (S.PERMS - np.bitwise_count(x ^ y).sum(axis=-1)).astype(np.int32)


def _pair_batch(a: np.ndarray, b: np.ndarray, agree: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(agree)], ["a", "b", "agree"])


def _near(p: np.ndarray, ids: np.ndarray, bits: np.ndarray, first: int, least: int):
    """Pairs at and after row `first` of sorted rows with rows before them: the whole of light keys, windows of others."""
    n = len(p)
    start = np.concatenate([[0], np.flatnonzero(p[1:] != p[:-1]) + 1]) if n else np.empty(0, np.int64)
    counts = np.diff(np.append(start, n))
    size, begin = np.repeat(counts, counts), np.repeat(start, counts)
    for step in range(1, LIGHT):
        hi = np.arange(max(step, first), n)
        lo = hi - step
        ok = (lo >= begin[hi]) & ((step <= WINDOW) | (size[hi] <= LIGHT))
        hi, lo = hi[ok], lo[ok]
        if not len(hi):
            if step > WINDOW:
                break
            continue
        agree = _agree(bits[hi], bits[lo])
        ok = (agree >= least) & (ids[hi] != ids[lo])
        if ok.any():
            yield ids[hi[ok]], ids[lo[ok]], agree[ok]


def _neighbours(keyed: DataFrame, least: int) -> DataFrame:
    """One pass over rows (p, s, id, bits), sorted within each partition. Gives pairs, and with `b` null the rows at a partition's edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of the last key so far, of a crowded one the last LIGHT
        head: list[tuple] = []
        tail: tuple | None = None
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("agree", pa.int32()), ("p", pa.int64()), ("s", pa.binary()), ("bits", pa.binary())])

        def edge(rows: tuple) -> pa.RecordBatch:
            p, s, ids, bits = rows
            n = len(p)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(p), pa.array(s, pa.binary()), pa.array([x.tobytes() for x in bits], pa.binary())], schema=schema)

        def pairs(found) -> Iterator[pa.RecordBatch]:
            for a, b, agree in found:
                n = len(a)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(agree), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            now = (batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object), batch.column(2).to_numpy(), _bits(batch.column(3)))
            need = LIGHT + 1 - sum(len(x[0]) for x in head)
            if need > 0:
                head.append(tuple(x[:need] for x in now))
            rows = now if held is None else tuple(np.concatenate([x, y]) for x, y in zip(held, now, strict=True))
            first = 0 if held is None else len(held[0])
            yield from pairs(_near(rows[0], rows[2], rows[3], first, least))
            end = rows[0]
            keep = max(int(np.searchsorted(end, end[-1], "left")), len(end) - LIGHT - 1)
            held = tuple(x[keep:] for x in rows)
            tail = tuple(x[-LIGHT - 1 :] for x in rows)
        for rows in head:
            yield edge(rows)
        if tail is not None:
            yield edge(tail)

    return keyed.mapInArrow(run, f"{PAIR}, p long, s binary, bits binary")


def candidates(keyed: DataFrame, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs with the bits they agree in, and the crowded keys with their rows. keyed: saved rows p, s, id, bits."""
    dealt = keyed.repartitionByRange("p", "s", "id").sortWithinPartitions("p", "s", "id")
    found = scratch.save(_neighbours(dealt, least), "neighbours")
    # rows at the edges of tasks: at most 2 * (LIGHT + 1) a task; a key's edges meet again, by key
    edges = found.where("b is null").select("p", "s", F.col("a").alias("id"), "bits").distinct()
    again = _neighbours(edges.repartition("p").sortWithinPartitions("p", "s", "id"), least).where("b is not null")
    pairs = found.where("b is not null").select("a", "b", "agree").unionByName(again.select("a", "b", "agree")).distinct()
    crowded = keyed.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LIGHT)
    pairs = scratch.save(pairs, "pairs")
    scratch.drop(found)
    return pairs, keyed.join(crowded, "p").select("p", "id", "bits")


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int, near: Callable | None = None) -> DataFrame:
    """`(u, v, linked)` of pairs a, b, by their full sets. sets: id, set (sorted 64-bit values as bytes)."""
    one = sets.select(F.col("id").alias("a"), F.col("set").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("set").alias("y"))

    def test(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = [S.linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), num, den) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], ["u", "v", "linked"])

    return arrow_map(pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y"), test, "u long, v long, linked boolean")


def _labelled(df: DataFrame, comp: DataFrame, column: str, name: str) -> DataFrame:
    return df.join(comp.select(F.col("id").alias(column), F.col("component").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))


def _between(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    return _labelled(_labelled(pairs, comp, "a", "ca"), comp, "b", "cb").where("ca <> cb")


def _nearest(pairs: DataFrame, n: int) -> DataFrame:
    """Pairs that are among the n nearest of either end."""
    ends = pairs.select(F.col("a").alias("e"), "a", "b", "agree").unionByName(pairs.select(F.col("b").alias("e"), "a", "b", "agree"))
    rank = F.row_number().over(W.partitionBy("e").orderBy(F.desc("agree"), "a", "b"))
    return ends.withColumn("rank", rank).where(F.col("rank") <= n).select("a", "b").distinct()


def _tiles(rows: DataFrame, comp: DataFrame, least: int, sets: DataFrame | None = None, num: int = 1, den: int = 1, top: int = 3) -> DataFrame:
    """Of crowded keys: each row outside its key's largest component against all rows of the key that lie in another component than it.

    Without `sets`, the `top` nearest of each row and tile by sketch. With them, pairs are verified where they meet, and a tile gives one link for
    each two components that it finds linked: never all its pairs.
    """
    rows = _labelled(rows, comp, "id", "c")
    sizes = rows.groupBy("p", "c").agg(F.count(F.lit(1)).alias("n"))
    keys = sizes.groupBy("p").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")).where("n > most")
    rows = rows.join(keys, "p")
    size = TILE if sets is None else TILE // 4
    cols = ["p", "i", "j", "id", "c", "bits"]
    if sets is not None:
        rows, cols = rows.join(sets, "id"), [*cols, "set"]
    asks, all_ = F.ceil((F.col("n") - F.col("most")) / size).cast("int"), F.ceil(F.col("n") / size).cast("int")
    spread = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")
    ask = rows.where("c <> main").withColumns({"i": spread(asks, 1), "j": F.explode(F.sequence(F.lit(0), all_ - 1))})
    side = rows.withColumns({"j": spread(all_, 2), "i": F.explode(F.sequence(F.lit(0), asks - 1))})
    exact = sets is not None

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        ids, other, ca, cb = left.column("id").to_numpy(), right.column("id").to_numpy(), left.column("c").to_numpy(), right.column("c").to_numpy()
        if len(ids) and len(other):
            x, y = _bits(left.column("bits")), _bits(right.column("bits"))
            own, others = ([np.frombuffer(v.as_buffer(), np.uint64) for v in t.column("set")] if exact else [] for t in (left, right))
            known: set[tuple[int, int]] = set()
            for k in range(0, len(ids), 256):
                agree = _agree(x[k : k + 256, None, :], y[None, :, :])
                ok = (agree >= least) & (ca[k : k + 256, None] != cb[None, :])
                if not exact and len(other) > top:
                    at = np.argpartition(-np.where(ok, agree, -1), top, axis=1)[:, :top]
                    best = np.zeros_like(ok)
                    np.put_along_axis(best, at, True, axis=1)
                    ok &= best
                r, c = np.nonzero(ok)
                if exact:
                    good = []
                    for n, (a, b) in enumerate(zip((k + r).tolist(), c.tolist(), strict=True)):
                        two = (int(min(ca[a], cb[b])), int(max(ca[a], cb[b])))
                        if two not in known and S.linked(own[a], others[b], num, den):
                            known.add(two)
                            good.append(n)
                    r, c = r[good], c[good]
                out.append(pa.Table.from_batches([_pair_batch(ids[k + r], other[c], agree[r, c])]))
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "agree": pa.array([], pa.int32())})
        return pa.concat_tables(out) if out else empty

    met = ask.select(*cols).groupBy("p", "i", "j").cogroup(side.select(*[F.col(c).alias(c) for c in cols]).groupBy("p", "i", "j")).applyInArrow(meet, PAIR)
    return met.groupBy("a", "b").agg(F.max("agree").alias("agree"))


def linked_components(keyed: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int, scratch: Scratch) -> DataFrame:
    """`(id, component)` of the items that have links.

    keyed: rows p (key), s (order within the key), id, bits (sketch). sets_of: gives (id, set) for a table of ids.
    """
    least = least_agreement(num, den)
    keyed = scratch.save(keyed, "keyed")
    pairs, crowd = candidates(keyed, least, scratch)
    crowd = scratch.save(crowd, "crowd")
    scratch.drop(keyed)
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(crowd.select("id")).distinct()
    sets = scratch.save(sets_of(ids), "sets")
    tested = scratch.save(verify(_nearest(pairs, 2), sets, num, den), "tested")
    comp = scratch.save(components(tested.where("linked"), scratch), "components")

    def grow(more: DataFrame, tested: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Verifies pairs that aren't yet, and joins what they link."""
        fresh = more.join(tested.select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"], "left_anti")
        new = scratch.save(verify(fresh, sets, num, den), "tested")
        if not new.where("linked").limit(1).count():
            return tested.unionByName(new), comp
        grown = scratch.save(components(new.where("linked").select("u", "v").unionByName(comp.select(F.col("id").alias("u"), F.col("component").alias("v"))), scratch), "components")
        return tested.unionByName(new), grown

    tested, comp = grow(_between(pairs, comp).select("a", "b"), tested, comp)
    if crowd.limit(1).count():
        # the nearest first, so that few rows are left outside the largest components
        tested, comp = grow(_nearest(_tiles(crowd, comp, least), 2), tested, comp)
        links = _tiles(crowd, comp, least, sets, num, den)
        comp = scratch.save(components(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(comp.select(F.col("id").alias("u"), F.col("component").alias("v"))), scratch), "components")
    for table in (pairs, crowd, sets):
        scratch.drop(table)
    return comp
