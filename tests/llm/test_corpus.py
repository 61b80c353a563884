import random

import numpy as np
import pytest

import corpus_pipeline as C
from keyledger.llm import decontaminate as D, tokens, toxicity as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rnd, n):
    return ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 6))) for _ in range(n)]


def plain_align(a, b):
    best, table = 0, np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i, j] = max(0, table[i - 1, j - 1] + (2 if x == y and x >= 0 else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
    return int(table.max())


def test_alignment_equals_the_plain_one():
    rnd = random.Random(1)
    for _ in range(60):
        a, b = (np.array([rnd.randrange(-1, 6) for _ in range(rnd.randint(0, 20))], np.int64) for _ in range(2))
        assert D.align(a, b)[0] == plain_align(a, b)


def contaminated(rnd, items):
    docs = []
    for i in range(60):
        w = words(rnd, 40)
        item = items[i % len(items)][1].split()
        kind = i % 4
        if kind == 1:
            w += item
        elif kind == 2:  # every seventh word changed, one dropped, one put in
            w += [x if k % 7 else "changed" for k, x in enumerate(item)][:-1] + ["more"]
        elif kind == 3:
            w += item[:6]
        docs.append((i, " ".join(w + words(rnd, 40)), kind in (1, 2)))
    return docs


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(2)
    items = [(k, " ".join(words(rnd, rnd.randint(15, 50)))) for k in range(12)]
    docs = contaminated(rnd, items)
    table = spark.createDataFrame([(i, t.upper(), "x", 1) for i, t, _ in docs] + [(900, None, "x", 1), (901, "", "x", 1), (None, items[0][1], "x", 1), (902, " ".join(words(rnd, 60000)) + " " + items[3][1], "x", 1)], "doc_id long, text string, item_id string, score long")
    tests = spark.createDataFrame([*items, (90, None), (91, ""), (92, "| | |")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.leaks(table, tests).collect()}
    index = D.Index(items)
    v = D.Vocabulary(index.numbers)
    want = {(i, n) for i, t, _ in docs for n, item in index.items if plain_align(item, v.read(t)) >= D.LEAST * 2 * len(item)}
    assert got == want | {(None, 0), (902, 3)} and {i for i, _ in want} == {i for i, _, bad in docs if bad}
    left = D.remove_leaks(table, tests)
    assert left.columns == table.columns and {r.doc_id for r in left.collect()} == {i for i, _, bad in docs if not bad} | {900, 901}
    none = spark.createDataFrame([], tests.schema)
    assert D.leaks(table, none).collect() == [] and D.remove_leaks(table, none).count() == 64 and D.leaks(spark.createDataFrame([], table.schema), tests).collect() == []


@pytest.mark.parametrize("m", [8, 9, 10, 12])
def test_short_items_with_a_word_changed(m):
    item = [f"w{k}" for k in range(m)]
    index = D.Index([(0, " ".join(item))])
    index.seed(np.zeros(m, np.int64), 1000, D.RARE)
    text = ["x"] * 9 + item[: m // 2] + ["new"] + item[m // 2 + 1 :] + ["x"] * 9
    assert [r[0] for r in index.find(D.Vocabulary(index.numbers).read(" ".join(text)), D.LEAST)] == [0]


def test_test_sets_in_blocks(spark, monkeypatch):
    rnd = random.Random(3)
    items = [(k, " ".join(words(rnd, 30))) for k in range(20)]
    docs = spark.createDataFrame([(k, "a b " + t) for k, t in items], "doc_id long, text string")
    monkeypatch.setattr(D, "BLOCK_BYTES", 500)
    tests = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.leaks(docs, tests).collect()} == {(k, k) for k in range(20)} and D.remove_leaks(docs, tests).count() == 0


def labelled(rnd, n, start=0):
    out = []
    for i in range(start, start + n):
        w, grade = words(rnd, rnd.randint(5, 120)), rnd.choice((0, 0, 0, 1, 2))
        for _ in range((0, 2, 6)[grade]):
            w.insert(rnd.randrange(len(w)), rnd.choice(("qidiot", "qscum", "qmoron")) + rnd.choice(("", "s", "!")))
        out.append((i, " ".join(w), grade))
    return out


def test_ordinal_model(spark):
    rnd = random.Random(4)
    rows, held = labelled(rnd, 900), labelled(rnd, 300, 5000)
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(None, "x", 1), (7000, None, 1)], "doc_id long, text string, grade long")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows] + [(None, 1), (1, 0), (8000, None)], "doc_id long, g int")
    from pyspark.sql import functions as F

    model = T.train(docs, labels, F.col("g"), 3)
    assert model.thresholds == sorted(model.thresholds)
    table = spark.createDataFrame([(i, t) for i, t, _ in held] + [(None, None), (1, ""), (2, "a " * 50000)], "doc_id long, text string")
    got = {r.doc_id: r for r in T.severity(table, model, reject=0.5).collect()}
    assert np.mean([got[i].rejected == (g > 0) for i, _, g in held]) > 0.98
    means = [np.mean([got[i].expected_severity for i, _, g in held if g == k]) for k in range(3)]
    assert means == sorted(means) and not got[None].rejected and not got[1].rejected and not got[2].rejected
    # plain sums over distinct words give the same scores
    for i, t, _ in held[:20]:
        score = sum(model.weights.get(f, 0.0) for w in T.words_of(t) for f in T.features_of(w))
        assert abs(got[i].expected_severity - sum(model.above(score))) < 1e-5
    kept = T.remove_toxic(table, model, reject=0.5)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.rejected}
    empty = T.train(docs, spark.createDataFrame([], labels.schema), F.col("g"), 3)
    assert not any(r.rejected for r in T.severity(table, empty).collect()) and T.severity(spark.createDataFrame([], table.schema), model).collect() == []


def test_thresholds_in_fit():
    rows = [(np.array([1] if g else [2], np.int64), np.array([1], np.int64), g) for g in [0, 1] * 40]
    m = T.fit(rows, 2)
    assert m.above(m.weights.get(1, 0))[0] > 0.9 > 0.1 > m.above(m.weights.get(2, 0))[0]


def test_pipeline(spark, tmp_path):
    rnd = random.Random(6)
    clean = [(i, " ".join(words(rnd, 120))) for i in range(40)]
    toxic = [(100 + i, t + " qscum qidiot qmoron qscum qidiots") for i, (_, t) in enumerate((k, " ".join(words(rnd, 60))) for k in range(40))]
    copies = [(200 + i, clean[i][1] + " extra") for i in range(10)]
    passage = " ".join(words(rnd, 70))
    shared = [(300 + i, f"{' '.join(words(rnd, 60))} {passage} {' '.join(words(rnd, 60))}") for i in range(8)]
    items = [(k, " ".join(words(rnd, 30))) for k in range(3)]
    leaked = [(400 + i, " ".join(words(rnd, 60)) + " " + items[i % 3][1]) for i in range(6)]
    again = (0, " ".join(words(rnd, 80)))  # another text of an id that has copies
    rows = clean + toxic + copies + shared + leaked + [again, (500, None), (501, "")]
    rnd.shuffle(rows)
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 140)) for i, _ in rows if i % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    found = C.run(spark, d).collect()
    assert sorted(r.n_tokens for r in found if r.doc_id == 0) == sorted(len(tokens.encoder(tokens.default_model()).encode(t)) for t in (clean[0][1], again[1]))
    out = {r.doc_id: r for r in found}
    assert set(out) == {i for i, _ in clean} | {i for i, _ in shared} | {500, 501}
    e = tokens.encoder(tokens.default_model())
    texts = {i: e.decode(r.ids) for i, r in out.items()}
    assert sum(passage in t for t in texts.values()) == 1 and all(texts[i] == t for i, t in clean[1:])


@pytest.mark.parametrize("name,stage", C.STAGES[:-1])
def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path, name, stage):
    d = str(tmp_path)
    docs = spark.createDataFrame([], DOCS)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert stage(spark, docs, d).schema == docs.schema and stage(spark, docs, d).count() == 0
