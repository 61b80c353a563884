"""Substring dedup: passages that repeat across documents, wherever in a line they stand, unchanged or edited.

Passages begin and end anywhere, so a paragraph here is every run of 25 words. Its MinHash is the least hash of its 13-word shingles, which is
its one band; neighbouring paragraphs mostly share it, so that a text has a band every 7 words or so. Paragraphs that are equal always
collide. A passage of 51 words or more at a Jaccard of 0.8 (5-word shingles) to another holds such a pair: an edit costs each side 4 shingles at
least, so there are too few edits to cut it into shorter pieces. So the recall of the bands is 1 on what they are made for.

1. A band comes with a hash of its surroundings, up to 64 words at either side. Bands of one document only go.
2. Surroundings that an earlier document has too are a repeated passage as they are: equal ones are one class, which its first document keeps.
3. Classes that collide in a band are verified: they grow word by word from the band's shingle while both are equal, then across edits of up to
   11 words where 5 equal words follow. What is over 50 words long and has an exact Jaccard of 0.8 or more is to remove; spans of a document
   that overlap are one.
4. Removals that share a verified band are a cluster: the connected component of their bands.

No colliding pair is left out, and none is written: a band's classes meet in a task, in tiles if they are many, as arrays. Surroundings bound
what an edit can be judged by: 141 words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyledger.llm import shingles as S
from keyledger.llm.common import Scratch, among, arrow_map, fresh, pieces, texts_of
from keyledger.llm.components import components

N, SEED, GAP, AROUND, EDIT, TILE = 5, 13, 13, 64, 11, 2048
RUN = SEED + GAP - 1  # words of a paragraph
LEAST = 51
#: Rows and pairs of classes that are compared at a time.
ROWS, PAIRS = 4096, 32_768

_U = np.uint64
class Words:
    """Hashes of the words of some texts, one after another, and of any run of them at the cost of a subtraction."""

    def __init__(self, texts: list[str | None]):
        h, sizes = S.word_hashes(texts)
        short = sizes < RUN
        self.h = h[~np.repeat(short, sizes)]
        sizes = np.where(short, 0, sizes)
        n = len(self.h)
        up, self._down = S.scales(n)
        self._sums = np.concatenate([np.zeros(1, _U), np.cumsum(self.h * up[:n], dtype=_U)])
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        self.starts = np.cumsum(sizes) - sizes
        self.stops = self.starts + sizes

    def runs(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return S.mix((self._sums[hi] - self._sums[lo]) * self._down[lo] + (hi - lo).astype(_U) * S._M3)


def _each(x: np.ndarray, n: int, f: np.ufunc) -> np.ndarray:
    """The least or most of every n in a row."""
    k = 1
    while 2 * k <= n:
        x = f(x[:-k], x[k:])
        k *= 2
    return f(x[: len(x) - (n - k)], x[n - k :]) if k < n else x


def anchors(g: np.ndarray, text: np.ndarray | None = None, whole: np.ndarray | None = None) -> np.ndarray:
    """Where bands are: positions that hold the least of some GAP hashes in a row. Of equal hashes close together one every GAP or so.

    text: of which text each position is. whole: of the GAP hashes from each position on, whether all are of its text.
    """
    if len(g) < GAP:
        return np.empty(0, np.int64)
    least = _each(g, GAP, np.minimum)
    if whole is not None:
        least = np.where(whole[: len(least)], least, 0)
    edge = np.zeros(GAP - 1, g.dtype)
    at = np.flatnonzero(_each(np.concatenate([edge, least, edge]), GAP, np.maximum) == g)
    new = (g[at[1:]] != g[at[:-1]]) | (np.diff(at) >= GAP)
    if text is not None:
        new |= text[at[1:]] != text[at[:-1]]
    new = np.append(True, new)[: len(at)]
    part = (at - np.maximum.accumulate(np.where(new, at, 0))) // GAP
    return at[new | np.append(True, part[1:] != part[:-1])[: len(at)]]


def blocks(texts: list[str | None]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of some texts, and of their bands: positions in all of these words, hashes, classes (hash of the surroundings), words before and after the band's shingle."""
    words = Words(texts)
    i = np.arange(max(0, len(words.h) - SEED + 1))
    g = words.runs(i, i + SEED)
    at = anchors(g, words.text, i + RUN <= words.stops[words.text[: len(i)]])
    of = words.text[at]
    before, after = np.minimum(at - words.starts[of], AROUND), np.minimum(words.stops[of] - at - SEED, AROUND)
    classes = words.runs(at - before, at + SEED + after) + S.mix(before.astype(_U))
    return words, at, g[at].view(np.int64), classes.view(np.int64), before, after


def _bands(docs: DataFrame) -> DataFrame:
    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        docs, ts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for k, texts in pieces(batch.column(2)):
            words, at, d, c, before, after = blocks(texts)
            of = words.text[at]
            columns = (d, c, docs[k + of], ts[k + of], (at - words.starts[of]).astype(np.int32), before.astype(np.int8), after.astype(np.int8))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["d", "c", "doc", "t", "pos", "before", "after"])

    return arrow_map(docs, cut, "d long, c long, doc long, t long, pos int, before byte, after byte")


def _surroundings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """d, i, j, c, doc, side, before, words of the wanted classes (c, doc, tiles): a row for each pair of tiles that a class is in, i <= j, side: whether it is of tile j."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("c", "tiles")).alias("x"))  # at most a document's own bands
    lists = lists.select("doc", F.col("x.c").alias("c"), F.col("x.tiles").alias("tiles"))

    def walk(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        docs = batch.column(0).to_numpy()
        named = lambda c, row: S.mix(c.view(_U) + S.mix(row.astype(_U)))
        for k, texts in pieces(batch.column(1)):
            words, at, d, c, before, after = blocks(texts)
            asked, tiles = (batch.column(x).slice(k, len(texts)) for x in (2, 3))
            sizes = np.diff(asked.offsets.to_numpy())
            names = named(asked.flatten().to_numpy(), np.repeat(np.arange(len(texts)), sizes))
            order = np.argsort(names)
            names, tiles = names[order], tiles.flatten().to_numpy()[order]
            mine = named(c, words.text[at])
            place = np.minimum(np.searchsorted(names, mine), len(names) - 1)
            x = np.flatnonzero(names[place] == mine)
            x = x[np.unique(mine[x], return_index=True)[1]]
            n = tiles[place[x]].astype(np.int64)
            x, many = np.repeat(x, n), np.repeat(n, n)
            other = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            own = c[x] % many
            h = words.h.astype(np.uint32)
            for a in range(0, len(x), 8192):
                y, o, w = x[a : a + 8192], own[a : a + 8192], other[a : a + 8192]
                size = before[y] + SEED + after[y]
                ends = np.cumsum(size)
                place_of = np.arange(ends[-1]) + np.repeat((at - before)[y] - ends + size, size)
                around = pa.Array.from_buffers(pa.binary(), len(y), [None, pa.py_buffer(np.append(0, 4 * ends).astype(np.int32)), pa.py_buffer(h[place_of])])
                columns = (d[y], np.minimum(o, w).astype(np.int32), np.maximum(o, w).astype(np.int32), c[y], docs[k + words.text[at[y]]], o > w, before[y].astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in columns), around], ["d", "i", "j", "c", "doc", "side", "before", "words"])

    schema = "d long, i int, j int, c long, doc long, side boolean, before int, words binary"
    return arrow_map(docs.join(lists, "doc").select("doc", "text", "c", "tiles"), walk, schema)


def _shingles(words: np.ndarray) -> np.ndarray:
    out = np.full(max(0, len(words) - N + 1), _U(N), _U)
    for i in range(N):
        out = S.mix(out * S._M3 + words[i : i + len(out)])
    return out


#: The order in which pairs of places behind an edit are taken: those that skip least first.
_RANK = np.empty((EDIT + 1) ** 2, np.int16)
_RANK[sorted(range(len(_RANK)), key=lambda k: (max(divmod(k, EDIT + 1)), sum(divmod(k, EDIT + 1)), k))] = np.arange(len(_RANK))


def steps(g: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How far rows x and y of a table of shingles, outwards, go together: n words, then after each edit that 5 equal words follow.

    g: AROUND columns, zeros for no shingle, and as many zeros and one more. Gives the words of either side, a column for each edit passed, how many columns a pair has, and how many shingles went together behind edits.
    """
    i, j = n.astype(np.int64), n.astype(np.int64)
    near, far = (np.lib.stride_tricks.sliding_window_view(g, k, axis=1) for k in (EDIT + 1, AROUND + 1))  # copied a row at a time
    along, across, many, going = [i.copy()], [j.copy()], np.zeros(len(x), np.int64), np.arange(len(x))
    shared = [np.zeros(len(x), np.int64)]
    while len(going):
        a, b = near[x[going], i[going]], near[y[going], j[going]]
        rank = np.where((a[:, :, None] == b[:, None, :]) & (a != 0)[:, :, None], _RANK.reshape(EDIT + 1, -1), 9999).reshape(len(going), -1)
        best = rank.argmin(axis=1)
        ok = rank[np.arange(len(going)), best] < 9999
        going, best = going[ok], best[ok]
        i[going] += best // (EDIT + 1)
        j[going] += best % (EDIT + 1)
        a = far[x[going], i[going]]
        run = ((a != far[y[going], j[going]]) | (a == 0)).argmax(axis=1)
        i[going] += run + N - 1
        j[going] += run + N - 1
        many[going] += 1
        along.append(i.copy())
        across.append(j.copy())
        shared.append(shared[-1].copy())
        shared[-1][going] += run
    return np.stack(along, axis=1), np.stack(across, axis=1), many + 1, np.stack(shared, axis=1)


class Classes:
    """Classes of some bands, those of a band in a row and sorted by document, as arrays: words at either side, outwards, and the shingles there."""

    def __init__(self, bands: np.ndarray, docs: np.ndarray, before: np.ndarray, words: list[np.ndarray]):
        self.docs, self.before = docs, before.astype(np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        self.after = sizes - self.before - SEED
        flat = np.concatenate(words)
        self.starts = np.cumsum(sizes) - sizes
        middle = self.starts + self.before
        out = np.arange(AROUND)
        self.sides = []
        self.grams = np.append(_shingles(flat), np.zeros(2 * AROUND + SEED, _U))  # so many from any place on
        for limit, begin, sign, shift in ((self.before, middle - 1, -1, N - 1), (self.after, middle + SEED, 1, 0)):
            at = np.clip(begin[:, None] + sign * out, 0, len(flat) - 1)
            h = np.where(out < limit[:, None], flat[at], 0)
            g = np.where(out <= limit[:, None] - N, self.grams[np.clip(at - shift, 0, len(self.grams) - 1)], 0)
            # a last column that always differs ends every comparison
            self.sides.append((limit, np.hstack([h, np.zeros((len(h), 1), h.dtype)]), np.hstack([g, np.zeros((len(g), AROUND + 1), g.dtype)]), h[:, : (RUN - SEED) // 2].astype(_U) @ _HALF))
        self._bands = bands
        self._sizes = sizes
        self.reach = (self.before, self.after)
        self._trees: list[tuple[np.ndarray, np.ndarray]] | None = None

    def index(self) -> None:
        """For many pairs: makes what pairs have in common a few look-ups each, and narrows `reach`, the words at either side that an earlier document may have."""
        n = len(self.docs)
        # of each shingle: whether an earlier document's class of the band has it, and whether a later one's
        row = np.repeat(np.arange(n), self._sizes - N + 1)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(self._sizes - N + 1) - (self._sizes - N + 1), self._sizes - N + 1)
        place = self.starts[row] + offset
        key = S.mix(self.grams[place] + S.mix(self._bands[row].astype(_U)))
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, key[order[1:]] != key[order[:-1]]))
        stop = np.append(first[1:], len(key))
        docs = self.docs[row]
        earlier, later = np.empty(len(key), bool), np.empty(len(key), bool)
        earlier[order] = np.repeat(docs[order[first]], stop - first) < docs[order]
        later[order] = np.repeat(docs[order[stop - 1]], stop - first) > docs[order]
        begin = np.flatnonzero(offset == 0)
        low = np.minimum.reduceat(np.where(earlier, offset, 2 * AROUND + SEED), begin)
        high = np.maximum.reduceat(np.where(earlier, offset, -N), begin)
        self.reach = (np.maximum(self.before - low, 0), np.maximum(high + N - SEED - self.before, 0))
        numbers = np.empty(len(key), np.uint32)  # shorter than hashes, and equal where these are
        numbers[order] = np.repeat(np.arange(1, len(first) + 1, dtype=np.uint32), stop - first)
        self.grams = np.zeros(len(self.grams), np.uint32)
        self.grams[place] = numbers
        # a bit for each shingle within an edit's reach behind so many equal words
        bit = _U(1) << (key >> _U(58))
        ahead, behind = np.zeros(len(self.grams), _U), np.zeros(len(self.grams), _U)
        ahead[place], behind[place] = np.where(earlier, bit, 0), np.where(later, bit, 0)
        self._bits, self._trees = [], []
        middle, out = self.starts + self.before, np.arange(AROUND)
        for side, at in zip((0, 1), (middle[:, None] - N - out, (middle + SEED)[:, None] + out), strict=True):
            limit, h, _, half = self.sides[side]
            at, there = np.clip(at, 0, len(self.grams) - 1), out <= limit[:, None] - N
            wide = [np.hstack([np.where(there, x[at], 0), np.zeros((n, EDIT + 1), _U)]) for x in (ahead, behind)]
            self._bits.append([np.append(_each(x.ravel(), EDIT + 1, np.bitwise_or), np.zeros(EDIT, _U)).reshape(x.shape)[:, : AROUND + 1].copy() for x in wide])
            self.sides[side] = (limit, h, np.hstack([np.where(there, self.grams[at], 0), np.zeros((n, AROUND + 1), np.uint32)]), half)
            # sorted by their words, two classes share the fewest that any neighbours between them share
            h = h[:, :AROUND]
            order = np.argsort(np.ascontiguousarray(h.astype(">u4")).view(f"V{4 * AROUND}").ravel(), kind="stable")
            order = order[np.argsort(self._bands[order], kind="stable")]
            differs = np.hstack([h[order[1:]] != h[order[:-1]], np.ones((n - 1, 1), bool)])
            least = [np.append(differs.argmax(axis=1), 0).astype(np.int8)]
            for k in range(max(1, n - 1).bit_length() - 1):
                least.append(np.append(np.minimum(least[-1][: -(1 << k)], least[-1][1 << k :]), np.zeros(1 << k, np.int8)))
            ranks = np.empty(n, np.int64)
            ranks[order] = np.arange(n)
            self._trees.append((ranks, np.concatenate(least)))
        self._log = np.zeros(n + 1, np.int64)
        for k in range(1, n.bit_length()):
            self._log[1 << k :] = k

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether pairs may share a paragraph: half of its other words at one side or the other."""
        return (self.sides[0][3][x] == self.sides[0][3][y]) | (self.sides[1][3][x] == self.sides[1][3][y])

    def equal(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words next to the band's shingle classes x and y share, before and after."""
        out = []
        if self._trees is not None:
            for (limit, *_), (ranks, least) in zip(self.sides, self._trees, strict=True):
                p, q = ranks[x], ranks[y]
                p, q = np.minimum(p, q), np.maximum(p, q)
                k = self._log[q - p]
                level = k * len(ranks)
                out.append(np.minimum(np.minimum(least[level + p], least[level + q - (1 << k)]), np.minimum(limit[x], limit[y])))
            return out[0], out[1]
        for limit, h, *_ in self.sides:
            differs = h[x] != h[y]
            differs[:, -1] = True
            out.append(np.minimum(differs.argmax(axis=1), np.minimum(limit[x], limit[y])))
        return out[0], out[1]

    def may_bridge(self, x: np.ndarray, y: np.ndarray, far: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Whether behind what is equal x and y may have a shingle in common, within an edit's reach: those that have one, and few others."""
        (p, q), (r, s) = self._bits
        return ((p[x, far[0]] & q[y, far[0]]) | (r[x, far[1]] & s[y, far[1]])) != 0

    def grown(self, x: np.ndarray, y: np.ndarray, l: np.ndarray, r: np.ndarray, top: dict[int, list[int]], num: int, den: int, least: int) -> None:  # noqa: E741
        """Takes what classes y have of classes x across edits into top: by x, words before, after, and keeper. x in order, the nearest y first."""
        first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        stop = np.append(first[1:], len(x))
        more = 1
        while len(first):
            take = np.minimum(more, stop - first)
            take = take[: max(1, int(np.searchsorted(np.cumsum(take), PAIRS // 4)))]
            pairs = np.repeat(first[: len(take)] - np.cumsum(take) + take, take) + np.arange(take.sum())
            self._grow(x[pairs], y[pairs], l[pairs], r[pairs], top, num, den, least)
            first[: len(take)] += take
            open_ = np.array([a < b and (top[k][0] < p or top[k][1] < q) for a, b, k, p, q in zip(first.tolist(), stop.tolist(), *(v[np.minimum(first, len(x) - 1)].tolist() for v in (x, self.reach[0][x], self.reach[1][x])), strict=True)], bool)
            if len(take) == len(first):
                more = min(2 * more, 256)
            first, stop = first[open_], stop[open_]

    def _grow(self, x: np.ndarray, y: np.ndarray, l: np.ndarray, r: np.ndarray, top: dict[int, list[int]], num: int, den: int, least: int) -> None:  # noqa: E741
        left, right = (steps(s[2], x, y, n) for s, n in zip(self.sides, (l, r), strict=True))
        # nothing but pairs that pass an edit, are long enough, and reach beyond what is found
        far = [np.take_along_axis(s[0], s[2][:, None] - 1, axis=1)[:, 0] for s in (left, right)]
        known = np.array([top[k][:2] for k in x.tolist()]).reshape(-1, 2)
        use = ((left[2] > 1) | (right[2] > 1)) & (far[0] + far[1] + SEED >= least) & ((far[0] > known[:, 0]) | (far[1] > known[:, 1]))
        k = np.flatnonzero(use)
        # if the widest span is similar enough, no other of the pair says more
        ok, both = self._similar(x[k], y[k], left, right, k, left[2][k] - 1, right[2][k] - 1, num, den)
        good = [(k[ok], left[2][k[ok]] - 1, right[2][k[ok]] - 1)]
        k, both = k[~ok], both[~ok]
        n = left[2][k] * right[2][k] - 2  # all spans but what is equal as it is, and the widest
        k, both = np.repeat(k, n), np.repeat(both, n)
        i, j = np.divmod(np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + 1, right[2][k])
        p, q = left[0][k, i], right[0][k, j]
        mine, theirs = p + q + SEED - N + 1, left[1][k, i] + right[1][k, j] + SEED - N + 1
        # without repeats a span shares what goes together, and of the rest no more than the widest
        same = l[k] + r[k] + SEED - N + 1 + left[3][k, i] + right[3][k, j]
        rest = both - (l[k] + r[k] + SEED - N + 1 + left[3][k, left[2][k] - 1] + right[3][k, right[2][k] - 1])
        most = np.minimum(same + rest, np.minimum(mine, theirs))
        use = (p + q + SEED >= least) & ((p > known[k, 0]) | (q > known[k, 1])) & ((both < 0) | (den * most >= num * (mine + theirs - most)))
        sure = (both >= 0) & (den * same >= num * (mine + theirs - same))
        u = np.flatnonzero(use & sure)
        good.append((k[u], i[u], j[u]))
        u = np.flatnonzero(use & ~sure)
        k, i, j = k[u], i[u], j[u]
        ok, _ = self._similar(x[k], y[k], left, right, k, i, j, num, den)
        good.append((k[ok], i[ok], j[ok]))
        k, i, j = (np.concatenate(v) for v in zip(*good, strict=True))
        p, q = left[0][k, i], right[0][k, j]
        order = np.lexsort((-q, -p, -p - q, k))  # of a pair the longest first
        for row, before, after, doc in zip(*(v[order].tolist() for v in (x[k], p, q, self.docs[y[k]])), strict=True):
            best = top[row]
            if before > best[0] or after > best[1]:
                best[:] = max(best[0], before), max(best[1], after), min(best[2], doc)

    def _similar(self, x: np.ndarray, y: np.ndarray, left: tuple, right: tuple, k: np.ndarray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether x and y, as far as step i before and step j after of pairs k, have a Jaccard of num / den: exactly, of the sets of their shingles.

        And how many shingles they share, or -1 where one of them has a shingle twice.
        """
        out, shared = np.empty(len(x), bool), np.empty(len(x), np.int64)
        wide = np.arange(2 * AROUND + SEED - N + 1)
        pad = np.iinfo(self.grams.dtype).max
        rows = np.lib.stride_tricks.sliding_window_view(self.grams, len(wide))

        def distinct(rows: np.ndarray) -> np.ndarray:
            rows.sort(axis=1)
            return ((rows[:, 1:] != rows[:, :-1]) & (rows[:, 1:] != pad)).sum(axis=1) + (rows[:, 0] != pad)

        for a in range(0, len(x), 2048):
            part = slice(a, a + 2048)
            both, size = [], 0
            for side, row in enumerate((x[part], y[part])):
                p, q = left[side][k[part], i[part]], right[side][k[part], j[part]]
                at = self.starts[row] + self.before[row] - p
                size = size + p + q + SEED - N + 1
                both.append(np.where(wide < (p + q + SEED - N + 1)[:, None], rows[at], pad))
            union = distinct(np.hstack(both))
            each = distinct(both[0]) + distinct(both[1])
            out[part] = den * (each - union) >= num * union
            shared[part] = np.where(each == size, each - union, -1)
        return out, shared


_HALF = np.cumprod(np.full((RUN - SEED) // 2, S.BASE, _U), dtype=_U)


def matches(bands: np.ndarray, docs: np.ndarray, before: np.ndarray, words: list[np.ndarray], num: int, den: int, least: int, side: np.ndarray | None = None, cross: np.ndarray | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(row, words before, words after, keeper) of what repeats: rows sorted by band and document, each against those of its band and earlier documents.

    side, cross: where rows are of a pair of different tiles, those of one side meet those of the other only.
    """
    all_ = Classes(bands, docs, before, words)
    n = len(docs)
    starts = np.append(True, bands[1:] != bands[:-1])
    begin = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    same = np.append(False, (docs[1:] == docs[:-1]) & ~starts[1:])
    many = np.maximum.accumulate(np.where(same, 0, np.arange(n))) - begin  # rows of the band before the row's own document
    total = np.cumsum(many)
    crowded = total[-1] > 16 * n
    if crowded:
        all_.index()
    most = 8 * PAIRS if crowded else PAIRS
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        m = many[at:upto]
        x = np.repeat(np.arange(at, upto), m)
        y = np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m) + begin[x]
        at = upto
        ok = all_.near(x, y)
        if side is not None:
            ok &= ~cross[x] | (side[x] != side[y])
        x, y = x[ok], y[ok]
        if not len(x):
            continue
        l, r = all_.equal(x, y)  # noqa: E741
        size = l + r + SEED
        first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        whole = size >= least
        found = np.stack([np.maximum.reduceat(np.where(whole, v, -1), first) for v in (l, r)] + [np.minimum.reduceat(np.where(whole, docs[y], 2**63 - 1), first)], axis=1)
        rows = x[first]
        open_ = (found[:, 0] < all_.reach[0][rows]) | (found[:, 1] < all_.reach[1][rows])
        top = dict(zip(rows.tolist(), found.tolist(), strict=True))
        left = np.flatnonzero((size >= RUN) & np.repeat(open_, np.diff(np.append(first, len(x)))))
        if crowded and len(left):
            left = left[all_.may_bridge(x[left], y[left], (l[left], r[left]))]
        if len(left):
            left = left[np.lexsort((y[left], -size[left], x[left]))]
            all_.grown(x[left], y[left], l[left], r[left], top, num, den, least)
        for row, best in top.items():
            if best[0] >= 0:
                yield row, *best


def _compared(around: DataFrame, num: int, den: int, least: int) -> DataFrame:
    """c, before, after, keeper of classes that repeat what an earlier document has."""
    names = ["c", "before", "after", "keeper"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            d, i, j, c, docs, before = (table.column(k).to_numpy() for k in ("d", "i", "j", "c", "doc", "before"))
            side = table.column("side").to_numpy()
            words = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("words")]
            bands = np.cumsum(np.append(False, (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            out = list(matches(bands, docs, before, words, num, den, least, side, i != j))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
                rows = [(int(c[x]), *rest) for x, *rest in out]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        def last_cut(table: pa.Table) -> int:
            """Where the last key's rows begin."""
            ends = np.ones(table.num_rows, bool)
            for k in ("d", "i", "j"):
                v = table.column(k).to_numpy()
                ends &= v == v[-1]
            return int(ends.argmax())

        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                held.append(batch.slice(k, ROWS))
                table = pa.Table.from_batches(held)
                at = last_cut(table)
                if at:
                    yield from done(table.slice(0, at))
                    held = table.slice(at).to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    return around.repartition("d", "i", "j").sortWithinPartitions("d", "i", "j", "doc").mapInArrow(run, "c long, before int, after int, keeper long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, text, and t, which tells rows of one id apart."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"), F.xxhash64(text).alias("t")).where("doc is not null")


def _spans(docs: DataFrame, num: int, den: int, least: int, scratch: Scratch) -> DataFrame:
    """doc, t, d, start, stop, keeper of all that repeats, spans of a document not yet joined."""
    bands = scratch.save(_bands(docs.select("doc", "t", "text")), "bands")
    several = bands.groupBy("d").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x < y").select("d")
    seen = scratch.save(among(bands, scratch.save(several, "several"), "d"), "seen")
    scratch.drop(bands)
    scratch.free()
    classes = scratch.save(seen.groupBy("c").agg(F.min("doc").alias("doc"), F.max("doc").alias("last"), F.min("d").alias("d")), "classes")
    scratch.free()
    varied = classes.groupBy("d").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"), F.count(F.lit(1)).alias("n")).where("n > 1").select("d", "tiles")
    around = _surroundings(docs, classes.join(varied, "d").select("c", "doc", "tiles"))
    found = _compared(around, num, den, least).groupBy("c").agg(F.max("before").alias("more"), F.max("after").alias("beyond"), F.min("keeper").alias("keeper"))
    # a class's later documents have all of it in the first; of the first's, a part may be in other classes' documents
    found = scratch.save(found, "found")
    scratch.free()
    known = classes.join(found, "c", "left").where("doc < last or keeper is not null").select("c", F.col("doc").alias("first"), "more", "beyond", "keeper")
    rows = seen.join(known, "c")
    whole = (F.col("doc") > F.col("first")) & (F.col("before") + SEED + F.col("after") >= least)
    rows = rows.where(whole | F.col("keeper").isNotNull())
    start = F.col("pos") - F.when(whole, F.col("before").cast("int")).otherwise(F.col("more"))
    stop = F.col("pos") + SEED + F.when(whole, F.col("after").cast("int")).otherwise(F.col("beyond"))
    keeper = F.when(whole, F.least("first", "keeper")).otherwise(F.col("keeper"))
    spans = scratch.save(rows.select("doc", "t", "d", start.alias("start"), stop.alias("stop"), keeper.alias("keeper")), "spans")
    scratch.drop(seen)
    return spans


def _passages(docs: DataFrame, num: int, den: int, least: int) -> DataFrame:
    """doc, t, word_start, word_stop, keeper_id, cluster. docs: doc, text, t."""
    scratch = Scratch(docs.sparkSession, "passages")
    order = W.partitionBy("doc", "t").orderBy("start", "stop")  # a document's own spans
    reach = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    spans = _spans(docs, num, den, least, scratch).withColumn("new", (F.col("start") >= F.coalesce(reach, F.lit(-1))).cast("int"))
    runs = spans.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    own = W.partitionBy("doc", "t", "run")
    runs = scratch.save(runs.withColumn("m", F.min("d").over(own)), "runs")
    out = runs.groupBy("doc", "t", "run", "m").agg(F.min("start").alias("word_start"), F.max("stop").alias("word_stop"), F.min("keeper").alias("keeper_id"))
    clusters = components(runs.select(F.col("d").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), scratch)
    out = out.join(clusters.withColumnRenamed("id", "m"), "m", "left")
    return out.select("doc", "t", "word_start", "word_stop", "keeper_id", F.coalesce("component", "m").alias("cluster"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 4, den: int = 5, least: int = LEAST) -> DataFrame:
    """The passages to remove: id, word_start, word_stop (positions of words split at ASCII white space, stop excluded), n_words, keeper_id, cluster.

    What an earlier document by id has is listed if it has `least` words or more; keeper: the first of those that its parts were found in, cluster:
    the least band of those that removals link. Passages that overlap are one. What repeats within one document only is no concern of this
    operator, and rows with equal ids count as one document: each has its own passages, and equal rows the same. Null, empty and short texts and rows
    with a null id have none; an empty table gives none; other columns don't matter.
    """
    out = _passages(_keyed(docs, id_col, text_col), num, den, least)
    return out.select(F.col("doc").alias(id_col), "word_start", "word_stop", (F.col("word_stop") - F.col("word_start")).alias("n_words"), "keeper_id", "cluster")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut(text: str, starts: list[int], stops: list[int]) -> str:
    """The text without those words and the white space that follows each."""
    spans = [m.start() for m in _WORD.finditer(text)]
    spans.append(len(text))
    out, at = [], 0
    for a, b in sorted(zip(starts, stops, strict=True)):
        if a < len(spans) - 1:
            out.append(text[at : spans[a]])
            at = spans[min(b, len(spans) - 1)]
    return "".join(out) + text[at:]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 4, den: int = 5, least: int = LEAST) -> DataFrame:
    """`docs` with the repeated passages cut from their texts; rows and columns stay as they are, texts may become empty.

    Passages are cut from the row that they were found in, by its id and text, so rows of one id with other texts keep theirs. Null ids and texts stay.
    """
    cuts = _passages(_keyed(docs, id_col, text_col), num, den, least).groupBy("doc", "t").agg(F.collect_list(F.struct("word_start", "word_stop")).alias("cuts"))
    a, b, c = (fresh(docs, name) for name in ("cut_id", "cut_text", "cut_places"))
    cuts = cuts.select(F.col("doc").alias(a), F.col("t").alias(b), F.col("cuts").alias(c))
    joined = docs.join(cuts, (F.col(id_col).cast("long") == F.col(a)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(b)), "left")

    @F.arrow_udf("string")
    def cut_all(texts: pa.Array, starts: pa.Array, stops: pa.Array) -> pa.Array:
        return pa.array([t if p is None else cut(t, p, q) for t, p, q in zip(texts_of(texts), starts.to_pylist(), stops.to_pylist(), strict=True)], pa.string())

    # only texts with something to cut go to Python
    text = F.when(F.col(c).isNull(), F.col(text_col)).otherwise(cut_all(F.when(F.col(c).isNotNull(), F.col(text_col).cast("string")), F.col(f"{c}.word_start"), F.col(f"{c}.word_stop")))
    return joined.select(*[text.alias(x) if x == text_col else F.col(x) for x in docs.columns])


def op3_substring_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of `documents`."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_substring_dup": op3_substring_dup}
ORACLE: dict[str, str] = {}
