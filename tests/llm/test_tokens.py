import random

import pytest
import sentencepiece

from keyledger.llm import tokens as T

TEXTS = ["", " ", "  ", " a", "a ", "a  b", "a \n b\n\n", "▁x ▁ y", "\n", "\n\n a", "x\x00y zﬁ\r\nq", "漢字😀 𝔘 é", "\t\ta", "trail  ", "　全角", "<s> </s> <0x0A>", "y" * 3000, ("word " * 20000).strip(), "The quick brown fox.\nJumps", None]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=T.default_model())


def test_counts_equal_the_library(spark, library):
    rows = [(i, t, "x", 3) for i, t in enumerate(TEXTS)] + [(None, "a b", "x", 3), (3, " a", "x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, id long")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in T.token_counts(df, limit=100).collect())
    want = [(-1 if i is None else i, len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for i, t, *_ in rows]
    assert got == sorted(want)
    assert T.token_counts(spark.createDataFrame([], df.schema)).collect() == []


def brute(e, text):
    """Best segmentation by trying every piece at every position."""
    own = {}
    p = T._processor(T.default_model())
    for i in range(p.get_piece_size()):
        if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)):
            own[p.id_to_piece(i)] = p.get_score(i)
    least = min(own.values()) - 10
    best = [0.0] + [-1e300] * len(text)
    for i in range(1, len(text) + 1):
        for k in range(max(0, i - 16), i):
            s = own.get(text[k:i], least if i - k == 1 else None)
            if s is not None:
                best[i] = max(best[i], best[k] + s)
    return best[-1], own, least


def test_viterbi_is_best(library):
    e = T.encoder(T.default_model())
    rnd = random.Random(2)
    for text in ["▁the", "▁▁▁and", "ﬁ", "▁entionally"] + ["▁" + "".join(rnd.choice("etaoinshr▁éß漢") for _ in range(rnd.randint(1, 14))) for _ in range(200)]:
        best, own, least = brute(e, text)
        ids = e.viterbi(text)
        score, rest = 0.0, e.decode([e.automaton.piece and 0][:0])
        pieces = [library.id_to_piece(i) for i in ids]
        score = sum(own[p] for p in pieces if not p.startswith("<0x"))
        unknown = sum(1 for c in text if c not in own)
        assert abs(score + unknown * least - best) < 1e-3 and rest == ""
        assert b"".join(e.texts[i] for i in ids).decode() == text.replace("▁", " ")


def test_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    coded = T.encode(df)
    got = coded.collect()
    assert len(got) == len(rows) and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    back = {r.doc_id: r.text for r in T.decode(coded).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in rows}
    assert T.encode(spark.createDataFrame([], df.schema)).collect() == []
