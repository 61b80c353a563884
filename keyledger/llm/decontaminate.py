"""Benchmark decontamination: rare n-gram seeds find test items in training texts, Smith-Waterman scores what they found.

Words of the test items are numbered, and the corpus's counts of them tell how often an n-gram would occur by chance. An item's
n-grams that are rare in this sense are its seeds. Being judged by their words, seeds of a passage that leaked into a third of the corpus are still rare.
Each task joins its passages with the seeds by hash. Around the hits of an item a local alignment of words (match 2, mismatch and
gap -1) finds copies with words edited, dropped or put in. Test sets larger than a block are taken in blocks, so what is broadcast is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyledger.llm import shingles as S
from keyledger.llm.common import arrow_map, flag, held, texts_of

N, MATCH, LEAST, LEAST_WORDS = 3, 2, 0.5, 8
SHORT = 0.75  # similarity that is enough for an item of 8 words or more, if 8 words' score would be more
BLOCK_BYTES = 16_000_000
RARE = 2e-7  # chance of a seed per word of the corpus
_MARKS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "¡¿«»“”„‘’–—…·"


def word(raw: bytes) -> str:
    """A word without marks around it, case folded; may be empty."""
    return raw.decode("utf-8", "replace").strip(_MARKS).casefold()


class Vocabulary(dict):
    """Numbers of the items' words by raw word: -1 for others, -2 for marks alone."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, raw: bytes) -> int:
        w = word(raw)
        n = self.numbers.get(w, -1) if w else -2
        if len(self) >= 500_000:
            self.clear()
        if len(raw) <= 64:
            self[raw] = n
        return n

    def read(self, text: str | None) -> np.ndarray:
        words = S.words_of(text) if text else []
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return ids[ids != -2]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local score of `item` in `text`, and where in `text` it ends (stop excluded); numbers below 0 match nothing."""
    j = np.arange(len(text) + 1)
    above, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for w in item:
        step = np.where((text == w) & (w >= 0), MATCH, -1)
        here = np.maximum(above - 1, 0)
        here[1:] = np.maximum(here[1:], above[:-1] + step)
        here = np.maximum.accumulate(here + j) - j  # gaps in the item
        top = int(here.max())
        if top > best:
            best, end = top, int(here.argmax())
        above = here
    return best, end


class Index:
    """Seeds of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.numbers: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for number, text in items:
            words = [w for w in map(word, S.words_of(text or "")) if w]
            self.items.append((number, np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words], np.int64)))

    def seed(self, counts: np.ndarray, total: int, rare: float) -> None:
        """counts: of the numbered words in a corpus of `total` words."""
        p = (counts + 1) / (total + len(counts) + 1)
        size = np.uint64(len(self.numbers) + 1)
        keys, at, of = [], [], []
        for k, (_, ids) in enumerate(self.items):
            n = min(N, len(ids))
            if not n:
                continue
            grams = np.lib.stride_tricks.sliding_window_view(ids, n)
            chance = p[grams].prod(axis=1)
            ok = chance <= max(rare, chance.min())  # the rarest, if none is rare
            key = np.zeros(len(grams), np.uint64)
            for i in range(n):
                key = key * size + grams[:, i].astype(np.uint64) + np.uint64(1)
            keys.append(key[ok])
            at.append(np.flatnonzero(ok))
            of.append(np.full(ok.sum(), k))
        self.keys, self.at, self.of = (np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((keys, np.uint64), (at, np.int64), (of, np.int64)))
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.at, self.of = self.keys[order], self.at[order], self.of[order]
        self.sizes = sorted({min(N, len(ids)) for _, ids in self.items if len(ids)})

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, where in the text it would begin) of each seed in a text."""
        size = np.uint64(len(self.numbers) + 1)
        for n in self.sizes:
            if len(ids) < n or not len(self.keys):
                continue
            known = ids >= 0
            ok = known[: len(ids) - n + 1].copy()
            key = np.zeros(len(ok), np.uint64)
            for i in range(n):
                part = slice(i, len(ids) - n + 1 + i)
                ok &= known[part]
                key = key * size + (ids[part] + 1).astype(np.uint64)
            pos = np.flatnonzero(ok)
            lo, hi = np.searchsorted(self.keys, key[pos], "left"), np.searchsorted(self.keys, key[pos], "right")
            for x, a, b in zip(pos[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                for s in range(a, b):
                    if min(N, len(self.items[self.of[s]][1])) == n:
                        yield int(self.of[s]), int(x - self.at[s])

    def find(self, ids: np.ndarray, least: float) -> list[tuple[int, int, float, int, int]]:
        """(item id, score, similarity, first word, stop) of the items that a text holds, the best place of each."""
        starts: dict[int, set[int]] = {}
        for k, start in self.hits(ids):
            starts.setdefault(k, set()).add(start)
        out = []
        for k, found in starts.items():
            number, item = self.items[k]
            m, best = len(item), (0, 0, 0)
            slack = max(4, m // 2)
            places: list[list[int]] = []
            for start in sorted(found):
                if places and start <= places[-1][1] + slack:
                    places[-1][1] = start
                else:
                    places.append([start, start])
            for a, b in places:
                lo = max(0, a - slack)
                window = ids[lo : b + m + slack]
                score, end = align(item, window)
                if score > best[0]:
                    _, back = align(item[::-1], window[:end][::-1])
                    best = (score, lo + end - back, lo + end)
            similarity = best[0] / (MATCH * m)
            if similarity >= least and best[0] >= (MATCH * m if m < LEAST_WORDS else min(MATCH * LEAST_WORDS, SHORT * MATCH * m)):
                out.append((number, best[0], similarity, best[1], best[2]))
        return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK_BYTES, each of which fits the driver and a broadcast."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK_BYTES))
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect() if n > 1 else items.collect()
        yield sorted(((r[0], r[1]) for r in rows if r[1]), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _vocabulary(key: str, numbers: dict[str, int]) -> Vocabulary:
    return held(("items", key), lambda: Vocabulary(numbers))


def _counts(docs: DataFrame, key: str, numbers) -> tuple[np.ndarray, int]:
    """How often the corpus has each numbered word, and all its words: a bounded list per task, summed by position on the executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(key, numbers.value)
        total = np.zeros(len(v.numbers) + 1, np.int64)
        for batch in batches:
            for text in texts_of(batch.column(0)):
                ids = v.read(text)
                total[: len(v.numbers)] += np.bincount(ids[ids >= 0], minlength=len(v.numbers))
                total[-1] += len(ids)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["w", "n"])

    size = len(numbers.value)
    out = np.zeros(size + 1, np.int64)
    for w, n in docs.select("text").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n")).collect():
        out[w] = n
    return out[:size], int(out[size])


def _indexes(docs: DataFrame, items: DataFrame, rare: float) -> Iterator[tuple[str, object]]:
    """A broadcast index for each block of items."""
    import uuid

    context = docs.sparkSession.sparkContext
    for block in _blocks(items):
        index, key = Index(block), uuid.uuid4().hex
        numbers = context.broadcast(index.numbers)
        index.seed(*_counts(docs, key, numbers), rare)
        yield key, context.broadcast(index)


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST, rare: float = RARE) -> DataFrame:
    """id, item_id, score, similarity, word_start, word_stop: the test items that texts hold, the best place of each.

    similarity: score of the alignment over that of a full match; `least` or more counts, with 8 words' worth of score or 0.75 of a full match at least (all words of an item
    below 8 words). Words are split at ASCII white space, without marks around them, case folded; positions count such words. Null
    and empty texts and items hold and find nothing. Repeated rows are judged each, null ids stay. Empty tables give no rows.
    """
    slim = _slim(docs, id_col, text_col)
    tests = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    out = None
    for key, shared in _indexes(slim, tests, rare):

        def search(batch: pa.RecordBatch, key=key, shared=shared) -> pa.RecordBatch:
            index = shared.value
            v = _vocabulary(key, index.numbers)
            rows = [(doc, *found) for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True) for found in index.find(v.read(text), least)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [id_col, "item_id", "score", "similarity", "word_start", "word_stop"])

        part = arrow_map(slim, search, f"{id_col} long, item_id long, score long, similarity double, word_start long, word_stop long")
        out = part if out is None else out.unionByName(part)
    return out


def remove_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST, rare: float = RARE) -> DataFrame:
    """`docs` without the rows whose texts hold a test item; no shuffle, columns stay as they are. Texts alone go to Python, and only a flag comes back."""
    tests = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    slim = docs.select(F.col(text_col).cast("string").alias("text"))
    for key, shared in _indexes(slim, tests, rare):

        def clean(texts: pa.Array, key=key, shared=shared) -> pa.Array:
            index = shared.value
            v = _vocabulary(key, index.numbers)
            return pa.array([not index.find(v.read(text), least) for text in texts_of(texts)], pa.bool_())

        docs = docs.where(flag(F.col(text_col).cast("string"), clean))
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of `benchmark` in `documents`."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLE: dict[str, str] = {}
