"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade > k) is the logistic function of w . x - t_k: one weight per feature for all thresholds, thresholds in order. Features
are the distinct words of a text and their beginnings, each as often as distinct words have it. The model is fitted on a bounded
sample of labelled rows, keeps the features that tell most, and scores every text by a sum over its distinct words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyledger.llm.common import Scratch, arrow_map, flag, held, texts_of

#: Labelled rows that the model is fitted on, and features it keeps, at most.
SAMPLE, FEATURES = 6_000, 1_000
STARTS = (4, 5, 6, 7)
#: A feature is kept if it is in so many rows, and tells that much by chi-square.
LEAST, TELLING = 4, 6.6
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    """Distinct words of a whole text, lower-cased."""
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(word: str) -> list[int]:
    """Numbers of a word's features: itself, and its beginnings."""
    names = [f"w:{word}", *(f"{n}:{word[:n]}" for n in STARTS if len(word) > n)]
    return [xxhash.xxh3_64_intdigest(x) >> 1 for x in names]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    """weights: by feature number. thresholds: ascending, one less than there are grades."""

    weights: dict[int, float]
    thresholds: list[float]

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features_of(word))

    def above(self, score: float) -> list[float]:
        """P(grade > k) for each threshold."""
        return [float(_sigmoid(np.float64(score - t))) for t in self.thresholds]


def counted(words: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct features, ascending, and how many of its words have each."""
    return np.unique(np.array([f for w in words for f in features_of(w)], np.int64), return_counts=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], grades: int, features: int = FEATURES, decay: float = 2e-5, steps: int = 300) -> OrdinalModel:
    """rows: a text's features and counts as `counted` gives them, its grade from 0. Without two grades in the rows, the model gives grade 0 to all."""
    y = np.array([g for *_, g in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return OrdinalModel({}, [30.0 + k for k in range(grades - 1)])
    doc = np.repeat(np.arange(len(rows)), [len(f) for f, *_ in rows])
    names, column = np.unique(np.concatenate([f for f, *_ in rows]), return_inverse=True)
    many = np.concatenate([c for _, c, _ in rows])
    # how a feature's presence differs between graded and other rows: chi-square
    there, hits = np.bincount(column, minlength=len(names)), np.bincount(column[y[doc] > 0], minlength=len(names))
    n, k = len(rows), int((y > 0).sum())
    expected = there * k / n
    chi = (hits - expected) ** 2 / (expected * (1 - k / n) * (1 - there / n) + 1e-9)
    chi[there < LEAST] = 0
    best = np.argsort(-chi, kind="stable")[:features]
    best = best[chi[best] > TELLING]
    place = np.full(len(names), -1)
    place[best] = np.arange(len(best))
    used = place[column] >= 0
    d, c, many = doc[used], place[column][used], many[used].astype(float)
    w, free = np.zeros(len(best)), np.zeros(grades - 1)
    share = [max(1e-3, float((y > k).mean())) for k in range(grades - 1)]
    start = np.log(np.array([(1 - s) / s for s in share]))
    free[0] = start[0]
    free[1:] = np.log(np.maximum(np.diff(start), 1e-2))
    m1, m2 = np.zeros(len(best) + grades - 1), np.zeros(len(best) + grades - 1)
    for step in range(1, steps + 1):
        gaps = np.exp(free[1:])
        t = free[0] + np.append(0, np.cumsum(gaps))
        score = np.bincount(d, w[c] * many, minlength=n)
        above = _sigmoid(score[:, None] - t[None, :])  # P(grade > k)
        full = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
        p = np.maximum(full[np.arange(n), y] - full[np.arange(n), y + 1], 1e-12)
        slope = full * (1 - full)
        upper, lower = slope[np.arange(n), y], slope[np.arange(n), y + 1]
        by_score = -(upper - lower) / p / n
        by_t = np.zeros(grades - 1)
        for k in range(grades - 1):
            by_t[k] = ((upper / p) * (y == k + 1) - (lower / p) * (y == k)).sum() / n
        g_free = np.append(by_t.sum(), [by_t[k:].sum() * gaps[k - 1] for k in range(1, grades - 1)])
        g = np.append(np.bincount(c, by_score[d] * many, minlength=len(best)) + decay * w, g_free)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w -= move[: len(best)]
        free -= move[len(best) :]
    t = free[0] + np.append(0, np.cumsum(np.exp(free[1:])))
    return OrdinalModel(dict(zip(names[best].tolist(), w.tolist(), strict=True)), t.tolist())


def train(docs: DataFrame, labels: DataFrame, grade: Column, grades: int, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> OrdinalModel:
    """Fits on at most about `sample` labelled rows, picked by a hash of their id. grade: of a label row, 0 to grades - 1; null grades are left out."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), grade.cast("int").alias("grade")).where("id is not null and grade is not null").dropDuplicates(["id"])
    n = known.count()
    if n > sample:  # 1.02: the hash's own spread; limit() holds the bound of what is broadcast and collected
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / n))).limit(int(1.1 * sample))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    picked = slim.join(F.broadcast(known), "id").select("id", "grade", "text")  # at most 1.1 * sample rows of two numbers

    def features(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            found = [counted(words_of(t)) for t in texts_of(part.column(2))]
            stops = pa.array(np.cumsum([0, *(len(f) for f, _ in found)]).astype(np.int32))
            lists = (pa.ListArray.from_arrays(stops, pa.array(np.concatenate([x[m] for x in found]))) for m in (0, 1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["id", "grade", "f", "n"])

    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.save(arrow_map(picked, features, "id long, grade int, f array<long>, n array<long>"), "sample")
    total, graded = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("grade") > 0).cast("int")), F.lit(0))).first()
    best: list[int] = []
    if 0 < graded < total:  # of all features the driver gets those that the fit keeps
        seen = rows.select("grade", F.explode("f").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("there"), F.sum((F.col("grade") > 0).cast("int")).alias("hits"))
        expected, there = F.col("there") * F.lit(graded / total), F.col("there")
        chi = (F.col("hits") - expected) ** 2 / (expected * F.lit(1 - graded / total) * (1 - there / total) + 1e-9)
        best = [r.f for r in seen.where(there >= LEAST).withColumn("chi", chi).where(F.col("chi") > TELLING).orderBy(F.desc("chi"), "f").limit(FEATURES).select("f").collect()]
    kept = np.array(sorted(best), np.int64)

    def few(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for f, n in zip(batch.column(2), batch.column(3), strict=True):
            f, n = f.values.to_numpy(), n.values.to_numpy()
            at = np.isin(f, kept)
            out.append((f[at], n[at]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[m] for x in out], pa.list_(pa.int64())) for m in (0, 1))], ["id", "grade", "f", "n"])

    table = arrow_map(rows, few, "id long, grade int, f array<long>, n array<long>").toArrow()
    scratch.drop(rows)
    found = sorted(zip(*(table.column(c).to_pylist() for c in ("id", "f", "n", "grade")), strict=True))
    return fit([(np.array(f, np.int64), np.array(m, np.int64), g) for _, f, m, g in found], grades)


class _Weights(dict):
    """Word weights of a worker."""

    def __init__(self, model: OrdinalModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        x = self.model.word_weight(word)
        if len(self) >= 300_000:
            self.clear()
        if len(word) <= 64:
            self[word] = x
        return x


def _scorer(key: str, model: OrdinalModel) -> _Weights:
    return held(("toxicity", key), lambda: _Weights(model))


def _scores(w: _Weights, column: pa.Array) -> list[float]:
    return [float(np.sort(np.fromiter(map(w.__getitem__, words := words_of(t)), float, len(words))).sum()) for t in texts_of(column)]  # sorted: the same sum everywhere


def _share(spark: SparkSession, model: OrdinalModel):
    import uuid

    return uuid.uuid4().hex, spark.sparkContext.broadcast(model)  # FEATURES weights at most


def severity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", reject: float = 0.1) -> DataFrame:
    """One row per row of `docs`: id, grade (the most likely), expected_severity, toxic_probability (grade over 0), rejected.

    expected_severity: the sum over thresholds of P(grade > k). rejected: toxic_probability of `reject` or more. Null and empty texts have no features and get
    the thresholds' own odds. Whole texts count; repeated rows and null ids are scored each; an empty table gives none.
    """
    key, shared = _share(docs.sparkSession, model)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        above = [shared.value.above(x) for x in _scores(_scorer(key, shared.value), batch.column(1))]
        full = [[1.0, *a, 0.0] for a in above]
        grade = [max(range(len(f) - 1), key=lambda k, f=f: f[k] - f[k + 1]) for f in full]
        cols = [batch.column(0), pa.array(grade, pa.int32()), pa.array([round(sum(a), 6) for a in above]), pa.array([round(a[0], 6) for a in above]), pa.array([a[0] >= reject for a in above])]
        return pa.RecordBatch.from_arrays(cols, [id_col, "grade", "expected_severity", "toxic_probability", "rejected"])

    slim = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return arrow_map(slim, score, f"{id_col} long, grade int, expected_severity double, toxic_probability double, rejected boolean")


def remove_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text", reject: float = 0.1) -> DataFrame:
    """`docs` without rejected rows; no shuffle, columns stay as they are. Texts alone go to Python, and only a flag comes back."""
    key, shared = _share(docs.sparkSession, model)

    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.above(x)[0] < reject for x in _scores(_scorer(key, shared.value), texts)], pa.bool_())

    return docs.where(flag(F.col(text_col).cast("string"), clean))


def labelled_grade() -> Column:
    """Grades of `labels`: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    return F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1))


def train_from_tables(docs: DataFrame, sf_dir: str) -> OrdinalModel:
    """The model of the registered query, fitted on `labels` and the texts of `docs`."""
    return train(docs, docs.sparkSession.read.parquet(f"{sf_dir}/labels.parquet"), labelled_grade(), 3)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of `documents`. `labels` names no grades: they are made here as not toxic, toxic, and toxic with quality 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return severity(docs, train_from_tables(docs, sf_dir))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE: dict[str, str] = {}
