"""Token counts by a SentencePiece BPE model, and encoding by an Aho-Corasick automaton with Viterbi.

Both cut texts into pre-tokens that no piece crosses: a run of spaces with the word behind it, up to the next space or line feed.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyledger.llm.common import arrow_map, held, texts_of

SPACE = "▁"
_PRE = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")
_CACHE = 1_000_000  # pre-tokens a worker remembers
_LONG = 48  # longer pre-tokens aren't remembered


def default_model() -> str:
    """Place of the public model on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pretokens(text: str) -> list[str]:
    """Pre-tokens, with spaces written as the model has them and the one put before the text; none for an empty text."""
    return _PRE.findall(SPACE + text.replace(" ", SPACE)) if text else []


def _plain(text: str) -> tuple[list[str], list[str]] | None:
    """A quick cut of texts without runs of spaces: pre-tokens after a space (without it), and those after a line feed."""
    if "  " in text or SPACE in text or text[0] == " ":
        return None
    spaced: list[str] = []
    starts: list[str] = []
    for i, line in enumerate(text.split("\n")):
        words = line.split(" ")
        if i:
            starts.append(words[0])
            spaced += words[1:]
        else:
            spaced += words
    return spaced, starts


_processors: dict[str, object] = {}


def _processor(model: str):
    if model not in _processors:
        import sentencepiece

        p = _processors[model] = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        if any(SPACE in x.lstrip(SPACE) or "\n" in x for x in names):
            raise ValueError("a piece of this model crosses pre-tokens")
    return _processors[model]


class _Lengths(dict):
    """Tokens of a pre-token (as in `pretokens`): the frequent ones are given, misses go to the library and are remembered."""

    def __init__(self, model: str, frequent: dict[str, int]):
        super().__init__(frequent)
        self.model, self.frequent = _processor(model), frequent

    def __missing__(self, pre: str) -> int:
        if pre.startswith(SPACE):
            n = len(self.model.encode(pre[1:].replace(SPACE, " "))) if len(pre) > 1 else 1
        else:  # the library puts a space before a text, which a line feed keeps apart
            n = len(self.model.encode(pre)) - 1 if pre == "\n" else len(self.model.encode("\n" + pre)) - 2
        if len(pre) <= _LONG:
            if len(self) >= _CACHE:
                self.clear()
                self.update(self.frequent)
            self[pre] = n
        return n


def _heads(docs: DataFrame, keep: int) -> list[tuple[str, int]]:
    """Frequent pre-tokens over all texts: each task counts its own, and bounded lists merge in a tree; no pre-token is shuffled by itself."""

    def top(counts: Counter) -> pa.RecordBatch:
        best = counts.most_common(keep)
        return pa.RecordBatch.from_arrays([pa.array([[w for w, _ in best]], pa.list_(pa.string())), pa.array([[n for _, n in best]], pa.list_(pa.int64()))], ["words", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch.column(0)):
                if text:
                    counts.update(text.split())
                    if len(counts) > 20 * keep:  # rare ones go; this costs speed at most
                        counts = Counter(dict(counts.most_common(10 * keep)))
        if counts:
            yield top(counts)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for words, ns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w, n in zip(words, ns, strict=True):
                    counts[w] += n
        if counts:
            yield top(counts)

    kind = "words array<string>, counts array<long>"
    lists = docs.select("text").mapInArrow(count, kind)
    parts = docs.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // 32)
        lists = lists.repartition(parts).mapInArrow(join, kind)
    row = lists.first()
    return list(zip(row.words, row.counts, strict=True)) if row else []


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = 4096, keep: int = 8192) -> DataFrame:
    """One row per row of `docs`: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    n_tokens is what the library gives for the whole text, without begin or end. Two tiers on the map side: a table of the
    `keep` most frequent words' lengths is broadcast, misses are encoded once per worker. Null and empty texts have none; a null
    id stays. Texts of any length and repeated rows are counted each; an empty table gives none.
    """
    spark = docs.sparkSession
    path = model or default_model()
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    driver = _Lengths(path, {})
    table = spark.sparkContext.broadcast({SPACE + w: driver[SPACE + w] for w, _ in _heads(docs, keep) if len(w) <= _LONG and SPACE not in w})

    key = uuid.uuid4().hex

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths, bare = held(("lengths", key), lambda: (x := _Lengths(path, table.value), _Bare(x)))
        out = []
        for text in texts_of(batch.column(2)):
            if not text:
                out.append(0)
            elif (cut := _plain(text)) is not None:
                out.append(sum(map(bare.__getitem__, cut[0])) + sum(map(lengths.__getitem__, filter(None, cut[1]))) + len(cut[1]) * lengths["\n"])
            else:
                out.append(sum(map(lengths.__getitem__, pretokens(text))))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64()), pa.array([n > limit for n in out])], [id_col, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return arrow_map(rows, count, f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean")


class _Bare(dict):
    """The same lengths by the word behind one space."""

    def __init__(self, lengths: dict):
        super().__init__({k[1:]: v for k, v in lengths.items() if k.startswith(SPACE)})
        self.lengths = lengths

    def __missing__(self, word: str) -> int:
        n = self.lengths.__missing__(SPACE + word)
        self.lengths.pop(SPACE + word, None)
        if len(word) <= _LONG:
            if len(self) >= _CACHE:
                self.clear()
                self.update({k[1:]: v for k, v in self.lengths.frequent.items()})
            self[word] = n
        return n


# --- encoding ---


class Automaton:
    """Aho-Corasick over pieces. Per state: children, the state of the longest proper suffix, the piece that ends here, and the next state on the suffix path at which one ends (the output link)."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        self.next: list[dict[str, int]] = [{}]
        self.piece: list[tuple[int, int, float] | None] = [None]
        for text, (number, score) in pieces.items():
            at = 0
            for c in text:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.piece.append(None)
                at = self.next[at][c]
            self.piece[at] = (len(text), number, score)
        n = len(self.next)
        self.fail, self.link = [0] * n, [0] * n
        todo = deque(self.next[0].values())
        while todo:
            at = todo.popleft()
            for c, child in self.next[at].items():
                f = self.fail[at]
                while f and c not in self.next[f]:
                    f = self.fail[f]
                f = self.next[f].get(c, 0)
                self.fail[child] = f if f != child else 0
                self.link[child] = self.fail[child] if self.piece[self.fail[child]] else self.link[self.fail[child]]
                todo.append(child)
        # all pieces that end at a state, longest first: the output links followed once
        self.ends: list[list[tuple[int, int, float]]] = [[] for _ in range(n)]
        for at in range(n):
            s = at if self.piece[at] else self.link[at]
            while s:
                self.ends[at].append(self.piece[s])
                s = self.link[s]


class Encoder:
    """Best-scoring segmentation of texts into a model's pieces, and texts of pieces.

    Of equal scores the longer last piece wins. A character that no piece covers costs the least score less 10, and is given as the
    pieces of its UTF-8 bytes if the model has them, else as the unknown piece.
    """

    def __init__(self, model: str):
        p = _processor(model)
        ids = range(p.get_piece_size())
        own = {p.id_to_piece(i): (i, p.get_score(i)) for i in ids if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))}
        self.automaton, self.unknown_score, self.unknown = Automaton(own), min(s for _, s in own.values()) - 10, p.unk_id()
        self.bytes = {int(p.id_to_piece(i)[3:5], 16): i for i in ids if p.is_byte(i)}
        self.texts = [b"" if p.is_control(i) else bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else " ⁇ ".encode() if p.is_unknown(i) else p.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
        self.cache: dict[str, bytes] = {}

    def _unknown(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if len(self.bytes) == 256 else [self.unknown]

    def viterbi(self, text: str) -> list[int]:
        """Pieces of one pre-token, in a single pass: at each position the output links relax the best score."""
        a = self.automaton
        trie, fail, ends, unknown = a.next, a.fail, a.ends, self.unknown_score
        best, back = [0.0], [(0, -1)]
        at = 0
        for i, c in enumerate(text, 1):
            while at and c not in trie[at]:
                at = fail[at]
            at = trie[at].get(c, 0)
            top, how, single = -1e300, (1, -1), False
            for n, number, score in ends[at]:
                x = best[i - n] + score
                if x > top:
                    top, how = x, (n, number)
                single |= n == 1
            if not single and (x := best[i - 1] + unknown) > top:
                top, how = x, (1, -1)
            best.append(top)
            back.append(how)
        out: list[list[int]] = []
        i = len(text)
        while i:
            n, number = back[i]
            out.append([number] if number >= 0 else self._unknown(text[i - 1]))
            i -= n
        return [x for piece in reversed(out) for x in piece]

    def _pre(self, pre: str) -> bytes:
        found = self.cache.get(pre)
        if found is None:
            found = np.array(self.viterbi(pre), np.uint32).tobytes()
            if len(pre) <= _LONG:
                if len(self.cache) >= _CACHE:
                    self.cache.clear()
                self.cache[pre] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """Piece ids of a whole text; none for null or empty."""
        return np.frombuffer(b"".join(map(self._pre, pretokens(text))), np.uint32) if text else np.empty(0, np.uint32)

    def decode(self, ids) -> str:
        """Text of piece ids, without the space put before it."""
        data = b"".join(map(self.texts.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def encoder(model: str) -> Encoder:
    """One per worker and model."""
    return held(("encoder", model), lambda: Encoder(model))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """One row per row of `docs`: id, ids (piece ids), n_tokens, round_trip (decoding gives the text again).

    The model's own space mark counts as a space. Null and empty texts have no pieces and round trip; a null id stays; repeated rows
    are encoded each; an empty table gives none. No text is cut: pre-tokens of any length go through the automaton.
    """
    path = model or default_model()
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            found, trips = [], []
            for text in texts_of(part.column(1)):
                ids = e.encode(text)
                found.append(ids)
                trips.append(e.decode(ids) == (text or "").replace(SPACE, " "))
            n = np.array([len(x) for x in found])
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, n.cumsum()).astype(np.int32)), pa.array(np.concatenate(found).view(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(n, pa.int64()), pa.array(trips)], [id_col, "ids", "n_tokens", "round_trip"])

    return arrow_map(rows, run, f"{id_col} long, ids array<int>, n_tokens long, round_trip boolean")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """id and text of encoded rows; null ids give an empty text."""
    path = model or default_model()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([e.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in batch.column(1)], pa.string())], [id_col, "text"])

    return arrow_map(encoded.select(F.col(id_col).cast("long"), ids_col), run, f"{id_col} long, text string")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of `documents`."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as pieces."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable] = {"op5_token_counts": op5_token_counts, "op10_sentencepiece": op10_sentencepiece}
ORACLE: dict[str, str] = {}
