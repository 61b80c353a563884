import random

import numpy as np
import pytest

from keyledger.llm import near_dup, shingles as S, similar, substring_dup as sub
from keyledger.llm.common import Scratch
from keyledger.llm.components import components

DOCS = "doc_id long, text string, lang string, a long, id string"


def words(rnd, n):
    return ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 6))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, "x") for i, t in rows], DOCS)


def brute(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                ra, rb = sorted((find(a), find(b)))
                top[rb] = ra
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rnd, base, k):
    w = list(base)
    for _ in range(k):
        w[rnd.randrange(len(w))] = words(rnd, 1)[0]
    return " ".join(w)


@pytest.mark.parametrize("n,num,den", [(3, 85, 100), (5, 4, 5)])
def test_near_duplicates_equal_brute_force(spark, n, num, den):
    rnd = random.Random(n)
    rows = []
    for _ in range(8):
        base = words(rnd, rnd.randint(5, 200))
        rows += [" ".join(base)] + [edited(rnd, base, rnd.randint(0, 6)) for _ in range(rnd.randint(0, 6))]
    crowd = words(rnd, 150)  # a crowd around one text: its copies are nearer to it than to each other
    rows += [" ".join(crowd)] + [edited(rnd, crowd, 5) for _ in range(80)] + [" ".join(crowd)] * 50
    rows += [None, "", " \n\t", "one", "One", "one two", "Ä", "ä", "x " * 30000, "x " * 29999]
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(frame(spark, rows), n=n, num=num, den=den).collect()}
    assert got == brute(rows, n, num, den)


def test_near_duplicates_edge_cases(spark):
    assert near_dup.near_duplicates(frame(spark, [])).collect() == []
    df = spark.createDataFrame([(None, "a b c", "en", 1, "x"), (1, "a b c", "en", 1, "x"), (1, "a b c", "en", 1, "x"), (2, "a b c", "en", 1, "x"), (None, None, None, None, None)], DOCS)
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect())
    assert got == [(-1, None, False), (-1, None, False), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert sorted((r.doc_id or -1) for r in near_dup.keep_one(df).collect()) == [-1, -1, 1, 1] and near_dup.keep_one(df).columns == df.columns


def test_keep_one_goes_by_row(spark):
    x, y = (" ".join(words(random.Random(k), 40)) for k in (1, 2))
    rows = [(0, x), (1, y), (1, x), (1, None), (None, x)]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, Gone_ID int, text_hash string")
    left = near_dup.keep_one(df)
    assert left.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(0, x), (1, y), (1, None), (None, x)], key=str)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, x) for x in range(2001, 2100)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        ra, rb = sorted((find(a), find(b)))
        top[rb] = ra
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).collect() == []


def test_contract_keeps_components():
    from keyledger.llm.components import contract

    rnd = np.random.default_rng(2)
    for n, m in ((1, 1), (50, 20), (50, 60), (3000, 2500)):
        u, v = rnd.integers(0, n, m), rnd.integers(0, n, m)
        top = list(range(n))

        def find(x, top=top):
            while top[x] != x:
                x = top[x]
            return x

        for a, b in zip(u.tolist(), v.tolist()):
            ra, rb = sorted((find(a), find(b)))
            top[rb] = ra
        ends, least = contract(u, v)
        assert dict(zip(ends.tolist(), least.tolist())) == {x: find(x) for x in {*u.tolist(), *v.tolist()} if find(x) != x}


def test_sketch_bound():
    assert similar.least_agreement(4, 5) < S.PERMS * 0.9 and S.linked(np.array([1, 2], np.uint64), np.array([1, 2], np.uint64), 1, 1)


def test_anchors_are_the_same_wherever_a_passage_stands():
    rnd = random.Random(3)
    passage = words(rnd, 51)
    for k in range(30):
        a, b = (" ".join(words(rnd, rnd.randint(0, 90)) + passage + words(rnd, rnd.randint(0, 90))) for _ in range(2))
        assert set(sub.blocks([a])[2].tolist()) & set(sub.blocks([b])[2].tolist()), k
    texts = [" ".join(rnd.choice((["is"] * 60, words(rnd, 70), words(rnd, rnd.randint(0, 30))))) for _ in range(40)]
    together = sub.blocks(texts)
    alone = [sub.blocks([t]) for t in texts]
    assert all(np.array_equal(together[k], np.concatenate([x[k] for x in alone])) for k in range(2, 6))  # texts side by side don't touch each other
    at = sub.anchors(np.random.default_rng(1).integers(0, 2**63, 200_000, dtype=np.uint64))
    assert np.diff(at).max() <= sub.GAP and (sub.anchors(np.zeros(30, np.uint64)) >= 0).all()


def test_repeated_passages(spark):
    rnd = random.Random(4)
    passages = [words(rnd, n) for n in (51, 60, 200)]
    short = words(rnd, 45)
    rows = []
    for i in range(60):
        lead, tail = ([f"{w}{i}" for w in words(rnd, rnd.randint(20, 80))] for _ in range(2))  # never equal by chance
        rows.append((i, lead, (passages + [short, []])[i % 5], tail))
    docs = [(i, "\n".join([" ".join(a + p[:7]), " ".join(p[7:] + b)])) for i, a, p, b in rows]
    docs += [(100, None), (101, ""), (None, docs[0][1]), (102, " ".join(["is"] * 400)), (103, " ".join(words(rnd, 60) * 3))]
    got = {r.doc_id: (r.word_start, r.word_stop) for r in sub.repeated_passages(frame(spark, docs)).collect()}
    want = {i: (len(a), len(a) + len(p)) for i, a, p, _ in rows if p and len(p) > 50 and i >= 5}
    assert got == want
    left = {r.doc_id: r.text for r in sub.remove_repeats(frame(spark, docs)).collect()}
    for i, a, p, b in rows:
        assert left[i].split() == (a + b if p and len(p) > 50 and i >= 5 else a + p + b)
    assert left[100] is None and left[101] == "" and left[None] == docs[0][1] and left[102] == docs[-2][1] and left[103] == docs[-1][1]
    assert sub.repeated_passages(frame(spark, [])).collect() == []


def test_edited_passages_and_one_in_most_documents(spark):
    rnd = random.Random(5)
    p = words(rnd, 150)
    rows = [(i, " ".join(words(rnd, 30) + p + words(rnd, 30))) for i in range(120)]
    rows[7] = (7, " ".join(words(rnd, 30) + p[:75] + ["new"] + p[76:] + words(rnd, 30)))
    got = {r.doc_id: r.n_words for r in sub.repeated_passages(frame(spark, rows)).collect()}
    assert set(got) == set(range(1, 120)) and all(abs(n - 150) <= 4 for i, n in got.items() if i != 7) and got[7] >= 74


@pytest.mark.parametrize("n", [52, 60, 75, 100])
def test_passages_with_one_edit(spark, n):
    rnd = random.Random(n)
    rows, want = [], {}
    for k, at in enumerate(range(5, n - 5, 5)):
        p = words(rnd, n)
        new = p[:at] + [["NEW"], [], ["NEW", p[at]]][k % 3] + p[at + 1 :]
        lead = words(rnd, 30)
        rows += [(2 * k, " ".join(words(rnd, 30) + p + words(rnd, 30))), (2 * k + 1, " ".join(lead + new + words(rnd, 30)))]
        want[2 * k + 1] = (30, 30 + len(new))
    got = {r.doc_id: (r.word_start, r.word_stop) for r in sub.repeated_passages(frame(spark, rows)).collect()}
    assert set(got) == set(want) and all(abs(x - y) <= 1 for i in want for x, y in zip(got[i], want[i]))  # a word beyond may be equal by chance


def test_blocks_at_the_bound_are_all_found(spark):
    rnd = random.Random(6)
    rows, want = [], set()
    for k in range(60):  # two edits in 100 words: Jaccard 86 of 106
        p = words(rnd, 100)
        a, b = rnd.randrange(8, 45), rnd.randrange(55, 92)
        rows += [(2 * k, " ".join(words(rnd, 9) + p)), (2 * k + 1, " ".join(words(rnd, 9) + p[:a] + ["new"] + p[a + 1 : b] + ["new"] + p[b + 1 :]))]
        want.add(2 * k + 1)
    got = {r.doc_id: r.n_words for r in sub.repeated_passages(frame(spark, rows)).collect()}
    assert set(got) == want and min(got.values()) >= 98


def test_variants_of_a_crowded_text(spark, monkeypatch):
    monkeypatch.setattr(sub, "TILE", 7)
    rnd = random.Random(8)
    core = words(rnd, 28)
    tails = [words(rnd, 30) for _ in range(40)]
    rows = [(i, " ".join(words(rnd, 30) + core + t + words(rnd, 30))) for i, t in enumerate(tails)]
    again = list(enumerate(tails, 100))
    rnd.shuffle(again)
    rows += [(i, " ".join(words(rnd, 30) + core + t[:20] + ["new"] + t[21:] + words(rnd, 30))) for i, t in again]
    got = {r.doc_id: r for r in sub.repeated_passages(frame(spark, rows)).collect()}
    assert set(got) == set(range(100, 140)) and all(r.keeper_id == i - 100 and abs(r.n_words - 58) <= 2 for i, r in got.items())


def test_first_holder_of_a_part_hides_no_passage(spark):
    rnd = random.Random(9)
    for n in (51, 60, 75):
        for part in (slice(0, 28), slice(n - 28, n)):
            p = words(rnd, n)
            rows = [(1, " ".join(words(rnd, 40) + p[part] + words(rnd, 40)))] + [(i, " ".join(words(rnd, 40) + p + words(rnd, 40))) for i in (5, 9)]
            got = [(r.doc_id, r.word_start, r.word_stop, r.keeper_id) for r in sub.repeated_passages(frame(spark, rows)).collect()]
            assert len(got) == 1 and got[0][0] == 9 and got[0][3] == 5 and abs(got[0][1] - 40) <= 1 and abs(got[0][2] - 40 - n) <= 1


def brute_repeats(docs, least=51):
    """Positions of words in runs of `least` or more that an earlier document has too: every run of `least` words of every pair."""
    out = {}
    for i, w in docs.items():
        earlier = {tuple(v[k : k + least]) for j, v in docs.items() if j < i for k in range(len(v) - least + 1)}
        out[i] = {x for k in range(len(w) - least + 1) if tuple(w[k : k + least]) in earlier for x in range(k, k + least)}
    return out


def test_unchanged_repeats_equal_brute_force(spark):
    rnd = random.Random(12)
    stock = [words(rnd, n) for n in (20, 30, 50, 51, 52, 70, 120, 300)]
    docs = {}
    for i in range(150):
        w = []
        for _ in range(rnd.randint(0, 5)):
            part = rnd.choice(stock)
            a = rnd.choice((0, 0, rnd.randrange(len(part))))
            w += rnd.choice(([], [f"{x}{i}" for x in words(rnd, 12)], ["junk"] * rnd.randint(1, 90))) + part[a : a + rnd.choice((51, 60, 1000))]
        docs[i] = w
    got = {i: set() for i in docs}
    for r in sub.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in docs.items()])).collect():
        assert not got[r.doc_id] & set(range(r.word_start, r.word_stop))
        got[r.doc_id] |= set(range(r.word_start, r.word_stop))
    want = brute_repeats(docs)
    assert all(want[i] <= got[i] for i in docs) and sum(map(len, want.values())) > 10_000
    # the rest is passages that go on across an edit
    assert sum(len(got[i] - want[i]) for i in docs) <= 0.02 * sum(map(len, docs.values()))


def test_clusters_and_rows_of_one_id(spark):
    rnd = random.Random(13)
    one, two = words(rnd, 80), words(rnd, 80)
    own = lambda k: [f"{w}-{k}" for w in words(rnd, 30)]
    texts = [(1, own(1) + one), (2, own(2) + two), (3, own(3) + one + own(4)), (4, own(5) + two), (5, own(6) + one + own(7) + two)]
    df = frame(spark, [(i, " ".join(w)) for i, w in texts])
    got = sorted((r.doc_id, r.word_start, r.cluster) for r in sub.repeated_passages(df).collect())
    by = {k: c for *k, c in [(i, s, c) for i, s, c in got] for k in [tuple(k)]}
    assert by[3, 30] == by[5, 30] and by[4, 30] == by[5, 140] and by[3, 30] != by[4, 30] and len(got) == 4
    # rows of one id: each is cut by its own passages
    plain = own(8) * 1 + own(9) + own(10) + own(11)
    rows = [(0, " ".join(one)), (1, " ".join(own(12) + one)), (1, " ".join(plain)), (1, " ".join(own(13) + one)), (2, None)]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, Cut_ID int, cut_places string")
    left = sorted((r.doc_id, len((r.text or "").split())) for r in sub.remove_repeats(df).collect())
    assert left == [(0, 80), (1, 30), (1, 30), (1, 120), (2, 0)] and sub.remove_repeats(df).columns == df.columns


def band_of(windows, copies):
    """Arguments of `matches` for one band: windows of 64 words at either side, a document each; copies: of the first of them."""
    return [np.zeros(len(windows), np.int64), np.arange(len(windows)) // copies, np.full(len(windows), sub.AROUND), [np.array(w, np.uint32) for w in windows], 4, 5, 51]


def test_crowded_band_follows_few_pairs_across_edits(monkeypatch):
    rnd = random.Random(14)
    windows = []
    for _ in range(1200):  # one word again and again, other words again and again before and after it
        before, after = rnd.randrange(64), rnd.randrange(64)
        windows.append([rnd.randrange(2, 60)] * (64 - before) + [1] * (before + 13 + after) + [rnd.randrange(2, 60)] * (64 - after))
    followed, steps = [], sub.steps

    def counted(g, x, y, n):
        followed.append(len(x))
        return steps(g, x, y, n)

    monkeypatch.setattr(sub, "steps", counted)
    got = sorted(r[:3] for r in sub.matches(*band_of(windows, 5)))
    assert sum(followed) < 1200**2 / 2 / 5  # either side of a pair counts
    monkeypatch.setattr(sub.Classes, "index", lambda self: None, raising=False)
    monkeypatch.setattr(sub.Classes, "may_bridge", lambda self, x, *_: np.ones(len(x), bool))
    assert got == sorted(r[:3] for r in sub.matches(*band_of(windows, 5))) and len(got) > 1000


def test_spans_of_many_near_copies_equal_brute_force(monkeypatch):
    rnd = random.Random(15)
    base = [rnd.randrange(1, 2**31) for _ in range(141)]
    windows = []
    for k in range(80):
        often = rnd.choice((8, 15, 30, 60))
        w = [base[:64][::-1], base[77:]]
        for side in w:
            for at in range(63, 0, -1):
                if not rnd.randrange(often):
                    side[at : at + 1] = rnd.choice(([], [rnd.randrange(1, 40)], [rnd.randrange(1, 2**31), side[at]], side[max(0, at - 6) : at] if k % 8 == 0 else []))
            side.extend(rnd.randrange(1, 2**31) for _ in range(64))
        windows.append(w[0][:64][::-1] + base[64:77] + w[1][:64])
    judged, similar = [], sub.Classes._similar

    def counted(self, x, *rest):
        judged.append(len(x))
        return similar(self, x, *rest)

    monkeypatch.setattr(sub.Classes, "_similar", counted)
    args = band_of(windows, 1)
    got = {r: (p, q) for r, p, q, _ in sub.matches(*args)}
    all_ = sub.Classes(*args[:4])
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    want, spans = {}, 0
    for x in range(80):
        for y in range(x):
            one = (np.array([x]), np.array([y]))
            l, r = all_.equal(*one)  # noqa: E741
            if l[0] + r[0] + 13 < sub.RUN:
                continue
            left, right = (sub.steps(s[2], *one, n) for s, n in zip(all_.sides, (l, r)))
            for i in range(left[2][0]):
                for j in range(right[2][0]):
                    p, q = int(left[0][0, i]), int(right[0][0, j])
                    a = shingles(windows[x][64 - p : 77 + q])
                    b = shingles(windows[y][64 - left[1][0, i] : 77 + right[1][0, j]])
                    spans += 1
                    if p + q + 13 >= 51 and 5 * len(a & b) >= 4 * len(a | b):
                        want[x] = tuple(map(max, want.get(x, (0, 0)), (p, q)))
    assert got == want and len(want) > 50
    assert sum(judged) < spans / 8


def test_cut():
    assert sub.cut("a b\nc  d e", [1], [3]) == "a d e" and sub.cut("a b", [0], [2]) == "" and sub.cut("a b", [5], [9]) == "a b"
