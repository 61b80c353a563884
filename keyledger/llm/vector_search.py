"""Exact top-k search by inner product: a KD-tree per shard, best-first, with the kth score so far passed on.

Vectors are dealt to shards; each shard builds a KD-tree by median splits of the widest dimension, with tight bounding boxes. A
query visits a shard's boxes in the order of the most that any point in them could score, and stops at the first box that can't beat its kth best.
Queries go to one shard each first; the kth score found there bounds the visits to all other shards. Queries come in blocks, so that a task
holds one shard and one block.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyledger.llm.common import Scratch

LEAF, SHARD, BLOCK = 256, 32_768, 2_048
_MOST = 2**63 - 2  # negated in sorting
NONE = -_MOST
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class KDTree:
    """Over integer vectors. Nodes: bounding box, children or a leaf's rows."""

    def __init__(self, x: np.ndarray):
        self.x, self.lo, self.hi, self.kids, self.rows = x, [], [], [], []
        self._build(np.arange(len(x)))
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)
        self.most = max(float(np.abs(self.lo[0].astype(float)).max()), float(np.abs(self.hi[0].astype(float)).max()))

    def _build(self, rows: np.ndarray) -> int:
        part = self.x[rows]
        lo, hi = part.min(axis=0), part.max(axis=0)
        me = len(self.lo)
        self.lo.append(lo)
        self.hi.append(hi)
        self.kids.append(())
        self.rows.append(None)
        wide = int((hi.astype(float) - lo).argmax())
        if len(rows) <= LEAF or hi[wide] == lo[wide]:
            self.rows[me] = rows
            return me
        order = np.argpartition(part[:, wide], len(rows) // 2)
        half = len(rows) // 2
        self.kids[me] = (self._build(rows[order[:half]]), self._build(rows[order[half:]]))
        return me

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The most that a point of each node could score with each query, rounded up past any error of the float product."""
        up, down = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
        hi, lo = self.hi.T.astype(float), self.lo.T.astype(float)
        size = up @ np.abs(hi) - down @ np.abs(lo)  # of the terms, whatever they cancel
        return up @ hi + down @ lo + size * 1e-12 + 1e-6

    def search(self, q: np.ndarray, bounds: np.ndarray, ids: np.ndarray, own: int, k: int, floor: int) -> list[tuple[int, int]]:
        """`(score, id)` of the k best, larger scores first and ties to smaller ids; `floor`: a score that k others reach already."""
        best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst on top
        wide = float(np.abs(q.astype(float)).max()) * self.most * len(q) >= 2.0**62
        todo = [(-bounds[0], 0)]
        while todo:
            bound, node = heapq.heappop(todo)
            least = max(floor, best[0][0]) if len(best) == k else floor
            if least <= NONE:  # no bound, as what lies beyond ties with it
                least = -(2**200)
            if -bound < least:
                break
            if self.kids[node]:
                for kid in self.kids[node]:
                    if bounds[kid] >= least:
                        heapq.heappush(todo, (-bounds[kid], kid))
                continue
            rows = self.rows[node]
            scores = self.x[rows].astype(object) @ q.astype(object) if wide else self.x[rows] @ q
            for at in np.flatnonzero(scores >= least):
                i = int(ids[rows[at]])
                entry = (max(-_MOST, min(_MOST, int(scores[at]))), -i)
                if i == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return sorted(((s, -i) for s, i in best), key=lambda e: (-e[0], e[1]))


def _vectors(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks]).reshape(-1, dim)


def _search_shard(k: int) -> Callable:
    def search(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return _OUT.empty_table()
        dim = len(vectors.column("v")[0])
        tree, ids = KDTree(_vectors(vectors.column("v"), dim)), vectors.column("id").to_numpy()
        own, floors = queries.column("id").to_numpy(), queries.column("floor").to_numpy()
        out: list[tuple[int, int, int]] = []
        q = _vectors(queries.column("v"), dim)
        for at in range(0, len(q), 256):
            bounds = tree.bounds(q[at : at + 256])
            for i in range(len(bounds)):
                j = at + i
                out += [(int(own[j]), v, s) for s, v in tree.search(q[j], bounds[i], ids, int(own[j]), k, int(floors[j]))]
        return pa.table([pa.array(c) for c in zip(*out, strict=True)], schema=_OUT) if out else _OUT.empty_table()

    return search


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best per query: per-task partial lists of at most k per shard meet here, so a query has few rows."""
    lists = found.groupBy("query_id").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v"))).alias("x"))
    return lists.select("query_id", F.slice(F.array_sort("x"), 1, k).alias("x"))


def scaled(vector: str, by: int = 256) -> Column:
    """floor(by * x) per component, of doubles; null if the vector is, or holds a null or non-finite component."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(x.isNotNull() & ~bad, F.transform(x, lambda c: F.floor(c * by).cast("long")))


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, by: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query's other vectors the k with the highest integer inner product, ties to smaller ids.

    Vectors that are null, hold null or non-finite components, or have a null id take no part; vectors of another length aren't compared. Equal
    ids count as the query's own. Fewer than k others are all given. Scores are exact, in whole numbers of any size where 64 bits may not do; scaled components
    beyond 64 bits, and scores beyond, are given as the last number within.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    flagged = vectors.withColumn("__q", F.coalesce(is_query, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), "__q", scaled(vector_col, by).alias("v"))
    clean = flagged.where("id is not null and v is not null and size(v) > 0").withColumn("dim", F.size("v"))
    clean = scratch.save(clean, "clean")
    n, m = clean.agg(F.count(F.lit(1)), F.sum(F.col("__q").cast("int"))).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-(m or 0) // BLOCK))
    home = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int")
    dealt = clean.withColumns({"shard": home, "block": block})
    queries = dealt.where("__q").select("id", "v", "dim", "shard", "block")
    points = dealt.select(*[F.col(c).alias(c) for c in ("id", "v", "dim", "shard")], F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    by_task, kind = ["dim", "shard", "block"], "query_id long, vec_id long, score long"
    run = lambda q: q.groupBy(*by_task).cogroup(points.groupBy(*by_task)).applyInArrow(_search_shard(k), kind)
    first = scratch.save(run(queries.withColumn("floor", F.lit(NONE).cast("long"))), "first")
    if shards > 1:  # the kth score of the first shard bounds the visits to the others
        floors = _best(first, k).select(F.col("query_id").alias("id"), F.when(F.size("x") == k, -F.element_at("x", -1)["s"]).alias("floor"))
        rest = queries.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(NONE).cast("long")))
        others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("shard"))
        rest = rest.withColumn("shard", F.explode(others)).select("id", "v", "dim", "shard", "block", "floor")
        first = first.unionByName(run(rest))
    best = _best(first, k).select("query_id", F.posexplode("x").alias("at", "y"))
    return best.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("y.v").alias("vec_id"), (-F.col("y.s")).alias("score"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all other vectors for every fiftieth of `embeddings`."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP8_SQL = """
with e as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint score from e q join e c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""
QUERIES = {"op8_top_k": op8_top_k}
ORACLE = {"op8_top_k": OP8_SQL}
