"""MinHash near-duplicates by an LSH forest: several sorted signature orders, whose neighbours are the candidates.

Each of 16 trees orders the texts by 8 MinHash values. Texts that share 4 or more leading values are a region of the
order. A small region is compared wholly. In a crowded one only the neighbours with the longest common prefixes meet,
up to all 8 values deep, and the rest of it is made up for exactly (see `similar`). Two sets with Jaccard 0.85 miss all 16
regions with a chance of 8e-6, with 0.8 of 2e-4 (0.59 to the power 16 at most); every link is confirmed on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyledger.llm import shingles as S
from keyledger.llm.common import Scratch, among, arrow_map, fresh, pieces
from keyledger.llm.similar import linked_components


def _signed(docs: DataFrame, n: int) -> DataFrame:
    """id, text_hash, n_shingles, d1 and d2 (digest of the set, null if empty), sig."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, d1, d2, sig = [], [], [], []
        for _, texts in pieces(batch.column(1)):
            for s in S.shingle_sets(texts, n):
                a, b = S.digest(s) if len(s) else (None, None)
                counts.append(len(s))
                d1.append(a)
                d2.append(b)
                sig.append(S.signature(s).tobytes() if len(s) else None)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary())], ["id", "text_hash", "n_shingles", "d1", "d2", "sig"])

    return arrow_map(docs.select("id", "text", F.xxhash64("text")), sign, "id long, text_hash long, n_shingles long, d1 long, d2 long, sig binary")


def _trees(reps: DataFrame) -> DataFrame:
    """A row for each text and tree: p (the first 4 values), s (the other 4), id, bits."""
    least = S.LEAST_DEPTH

    def grow(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, S.TREES, S.DEPTH)
        p = np.broadcast_to(np.arange(1, S.TREES + 1, dtype=np.uint64), sig.shape[:2]).copy()
        for k in range(least):
            p = S.mix(p * np.uint64(0x165667B19E3779F9) + sig[:, :, k].astype(np.uint64))
        rest = np.ascontiguousarray(sig[:, :, least:].astype(">u4")).tobytes()
        width = 4 * (S.DEPTH - least)
        s = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(sig) * S.TREES, [None, pa.py_buffer(rest)]).cast(pa.binary())
        bits = [b for x in sig for b in [S.sketch(x.reshape(-1))] * S.TREES]
        return pa.RecordBatch.from_arrays([pa.array(p.reshape(-1).view(np.int64)), s, pa.array(np.repeat(batch.column(0).to_numpy(), S.TREES)), pa.array(bits, pa.binary())], ["p", "s", "id", "bits"])

    return arrow_map(reps.select("id", "sig"), grow, "p long, s binary, id long, bits binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 4, den: int = 5, tell: bool = False) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id, kept; with `tell` also text_hash, the xxhash64 of the text.

    Words: A-Z lower-cased, split at ASCII white space. Sets: distinct n-word shingles, the whole text as one if it has
    fewer words. Texts link with den * intersection >= num * union; component_id is the smallest id that links reach, and
    kept says that it is the row's own. Null and empty texts have no shingles and link with nothing. Rows with equal ids
    are judged by their own texts each. A null id gets a null component_id, isn't kept, and names no component. Other columns
    don't matter, an empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-duplicates")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.save(_signed(docs, n), "signed")
    reps = signed.where("d1 is not null and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("rep"))
    reps = scratch.save(reps, "classes")
    first = signed.join(reps.select(F.col("rep").alias("id"), "d1", "d2"), ["id", "d1", "d2"], "left_semi").select("id", "sig")

    def sets_of(ids: DataFrame) -> DataFrame:
        def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [s.tobytes() for _, texts in pieces(batch.column(1)) for s in S.shingle_sets(texts, n)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "set"])

        return arrow_map(among(docs, scratch.save(ids, "ids"), "id"), sets, "id long, set binary")

    comp = linked_components(_trees(first), sets_of, num, den, scratch)
    named = reps.join(comp, reps["rep"] == comp["id"], "left").select("d1", "d2", F.coalesce("component", "rep").alias("c"))
    out = signed.drop("sig").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    return out.select(F.col("id").alias(id_col), *(["text_hash"] if tell else []), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """`docs` without the rows that `near_duplicates` does not keep; columns stay as they are.

    Rows go by their id and text, so a row of a kept text stays whatever other rows have its id. Rows that share the kept id all stay if they
    are texts of its component; rows with a null id stay.
    """
    text = F.xxhash64(F.col(text_col).cast("string"))
    found = near_duplicates(docs, id_col, text_col, tell=True, **how)
    a, b = fresh(docs, "gone_id"), fresh(docs, "gone_text")
    gone = found.where(~F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias(a), F.col("text_hash").alias(b)).distinct()
    return docs.join(gone, (F.col(id_col).cast("long") == F.col(a)) & (text == F.col(b)), "left_anti")


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of `documents`: 3-word shingles, Jaccard of 0.85 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, num=85, den=100)


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP9_SQL = f"""
with recursive w as (select doc_id, {_WORDS} ws from documents where text is not null),
s as (select doc_id, unnest(list_distinct(case when len(ws) >= 3 then list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) else [array_to_string(ws, ' ')] end)) g from w where len(ws) > 0),
c as (select doc_id, count(*) n from s group by doc_id),
ids as (select g, row_number() over (order by n, g) rk from (select g, count(*) n from s group by g)),
r as (select doc_id, rk, row_number() over (partition by doc_id order by rk) pos, n from s join ids using (g) join c using (doc_id)),
f as (select * from r where pos <= n - (85 * n + 99) // 100 + 1),
cand as (select distinct a.doc_id a, b.doc_id b from f a join f b on a.rk = b.rk and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
i as (select a, b, count(*) k from cand join r x on x.doc_id = a join r y on y.doc_id = b and y.rk = x.rk group by a, b),
e as (select a, b from i join c x on x.doc_id = a join c y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
two as (select a, b from e union all select b, a from e),
reach(a, b) as (select a, b from two union select reach.a, two.b from reach join two on reach.b = two.a),
m as (select a doc_id, min(b) b from reach group by a)
select doc_id, coalesce(n, 0)::bigint n_shingles, least(doc_id, coalesce(b, doc_id)) component_id, least(doc_id, coalesce(b, doc_id)) = doc_id kept
from documents left join c using (doc_id) left join m using (doc_id)
"""

QUERIES = {"op9_near_dup": op9_near_dup}
ORACLE = {"op9_near_dup": OP9_SQL}
