import random

import pytest

from keyledger import Engine, LedgerClosed, NotAppendable, merge
from keyledger.engine import Settings
from keyledger.functions import keys
from keyledger.operators import combine, oplog
from keyledger.operators.merge import check_only, final_store, merge_into
from keyledger.sources.oplogs import dispatch
from keyledger.sources.store import ParquetStore

LOG = "seq long, op string, key long, value array<long>, aux string"
TEXT = "seq long, op string, key long, value string, aux string"


def model(store, log, fold):
    """The contract, one operation after another."""
    state, out = dict(store), []
    for seq, op, key, value, aux in sorted(log):
        here = key in state
        result = ("DUPLICATE_KEY" if here else "UNIQUE_KEY") if op in "cb" else None
        if op in "ub":
            state[key] = value
        elif op == "a":
            old = state.get(key)
            state[key] = fold(old, value) if old is not None and value is not None else (old if value is None else value)
        out.append((seq, op, key, result, state.get(key), aux))
    return out, state


def union(a, b):
    return sorted({*a, *b})


def rows(df):
    return sorted((r.seq, r.op, r.key, r.result, r.value, r.aux) for r in df.collect())


def random_log(seed, n=300, ops="cuba"):
    rnd = random.Random(seed)
    value = lambda: None if rnd.random() < 0.2 else sorted({rnd.randrange(9) for _ in range(rnd.randint(1, 3))})
    return [(i, rnd.choice(ops), rnd.randrange(20), value(), f"x{i}") for i in range(n)]


@pytest.mark.parametrize("chunk", [None, 1, 17, 10_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_all_ops_equal_the_model(spark, seed, chunk):
    log, store = random_log(seed), [(k, [k] if k % 3 else None) for k in range(8)]
    log = [(s, o, k, None if o == "c" else v, a) for s, o, k, v, a in log]
    results, after = merge(spark.createDataFrame(store, "key long, value array<long>"), spark.createDataFrame(log, LOG), "set_union", chunk)
    want, state = model(store, log, union)
    assert rows(results) == sorted(want)
    assert {r.key: r.value for r in after.collect()} == state


@pytest.mark.parametrize("chunk", [None, 13])
def test_replacing_ops_and_batches(spark, chunk):
    log = [(s, o, k, None if o == "c" or v is None else str(v), a) for s, o, k, v, a in random_log(3, ops="cub")]
    store = [(k, None if k % 2 else "old") for k in range(6)]
    want, state = model(store, log, None)
    got, now = [], spark.createDataFrame(store, "key long, value string")
    for i in range(3):  # three batches give what one gives
        part = spark.createDataFrame(log[i * 100 : (i + 1) * 100], TEXT)
        results, after = merge(now, part, chunk=chunk)
        got += rows(results)
        now = spark.createDataFrame(after.collect(), "key long, value string")
    assert sorted(got) == sorted(want)
    assert {r.key: r.value for r in now.collect()} == state
    whole = final_store(spark.createDataFrame(store, "key long, value string"), spark.createDataFrame(log, TEXT))
    assert {r.key: r.value for r in whole.collect()} == state


@pytest.mark.parametrize("name,fold", [("sum", lambda a, b: a + b), ("min", min), ("max", max), ("list_concat", lambda a, b: a + b), ("custom", lambda a, b: a * 2 + b)])
def test_combiners(spark, name, fold):
    rnd = random.Random(5)
    wrap = (lambda x: [x]) if name == "list_concat" else (lambda x: x)
    kind = "array<long>" if name == "list_concat" else "long"
    log = [(i, rnd.choice("aaacu"), rnd.randrange(4), wrap(rnd.randrange(9)), None) for i in range(60)]
    log = [(s, o, k, None if o == "c" else v, a) for s, o, k, v, a in log]
    how = combine.custom(fold) if name == "custom" else name
    for chunk in (None, 7):
        results, after = merge(spark.createDataFrame([], f"key long, value {kind}"), spark.createDataFrame(log, f"seq long, op string, key long, value {kind}, aux string"), how, chunk)
        want, state = model([], log, fold)
        assert rows(results) == sorted(want, key=lambda r: r[0])
        assert {r.key: r.value for r in after.collect()} == state


def test_record_sets(spark):
    rnd = random.Random(21)
    kind = "struct<hash: long, budget: int, neighbours: array<long>>"
    record = lambda k: (k, rnd.randrange(9), sorted(rnd.sample(range(40), rnd.randint(1, 6))))
    stored = {k: record(k) for k in range(0, 12, 2)}
    log = [(n, "a", k, record(k), None) for n, k in enumerate(rnd.choices(range(12), k=30))]
    want = {k: set(v[2]) for k, v in stored.items()}
    for _, _, k, v, _ in log:
        want.setdefault(k, set()).update(v[2])
    _, after = merge(spark.createDataFrame(list(stored.items()), f"key long, value {kind}"), spark.createDataFrame(log, f"seq long, op string, key long, value {kind}, aux string"), combine.struct_union("neighbours"))
    assert {r.key: r.value.neighbours for r in after.collect()} == {k: sorted(v) for k, v in want.items()}


def test_bad_rows_fail(spark):
    empty = spark.createDataFrame([], "key long, value string")
    for bad in ((0, "x", 1, None, None), (0, "c", None, None, None), (None, "c", 1, None, None), (-1, "c", 1, None, None), (0, None, 1, None, None), (0, "a", 1, "v", None)):
        with pytest.raises(Exception):  # noqa: B017
            merge(empty, spark.createDataFrame([bad], TEXT))[0].collect()
    with pytest.raises(NotAppendable):
        merge(empty, spark.createDataFrame([], TEXT), appends=True)
    assert merge(empty, spark.createDataFrame([], TEXT))[0].collect() == []


def test_url_seen_and_empty_text(spark):
    urls = ["http://a.example", "http://b.example", "http://a.example", "http://a.example"]
    df = spark.createDataFrame(list(enumerate(urls)), "n long, url string").withColumn("k", keys.string_key("url"))
    log = oplog.check_update(df.withColumn("v", df.url.substr(1, 0)), "k", "n", "v", "url")
    got = merge(spark.createDataFrame([], "key long, value string"), log)[0].orderBy("seq").collect()
    assert [r.result for r in got] == ["UNIQUE_KEY", "UNIQUE_KEY", "DUPLICATE_KEY", "DUPLICATE_KEY"]
    assert [r.value for r in got] == [None] * 4 and [r.aux for r in got] == urls
    checks = check_only(spark.createDataFrame([(1, None)], "key long, value string"), spark.createDataFrame([(0, "c", 1, None, None), (1, "c", 2, None, None)], TEXT))
    assert sorted((r.seq, r.result) for r in checks.collect()) == [(0, "DUPLICATE_KEY"), (1, "UNIQUE_KEY")]


def test_store_lengths(spark, tmp_path):
    rnd, model = random.Random(22), {}
    with Engine(spark, Settings("lengths", str(tmp_path), num_buckets=4)) as engine:
        for _ in range(3):
            writes = [(rnd.randrange(15), rnd.choice((None, "x" * rnd.randint(1, 30), "ö"))) for _ in range(8)]
            model |= dict(writes)
            engine.update(spark.createDataFrame([(i, *w) for i, w in enumerate(writes)], "n long, k long, v string"), "k", "n", "v")
            engine.flush()
            assert tuple(engine.statistics().first()) == (len(model), sum(12 + len((v or "").encode()) for v in model.values()))


def test_put_merges_when_enough_waits(spark, tmp_path):
    told = []
    engine = Engine(spark, Settings("full", str(tmp_path), num_buckets=2, merge_bytes=64))
    engine.add_listener(lambda e: told.append(e["kind"]))
    one = lambda n, v: spark.createDataFrame([(n, n, v)], "n long, k long, v string")
    engine.update(one(1, "x" * 56), "k", "n", "v")  # 64 bytes with the key: not more than the limit
    assert "merging" not in told
    engine.check(one(2, None), "k", "n")
    assert told.count("merging") == 1
    engine.check(one(1, None), "k", "n")
    assert sorted((r.seq, r.op, r.result) for r in engine.flush().collect()) == [(1, "c", "DUPLICATE_KEY"), (1, "u", None), (2, "c", "UNIQUE_KEY")] and engine.flush() is None


def test_failed_merge_keeps_its_operations(spark, tmp_path):
    engine = Engine(spark, Settings("kept", str(tmp_path), num_buckets=2))
    engine.update(spark.createDataFrame([(1, 1, "v")], "n long, k long, v string"), "k", "n", "v")
    commit, engine.store.commit = engine.store.commit, lambda *a, **k: 1 / 0
    with pytest.raises(ZeroDivisionError):
        engine.flush()
    engine.store.commit = commit
    engine.flush()
    assert [(r.key, r.value) for r in engine.store.read().collect()] == [(1, "v")]


def test_of_two_writers_the_later_fails(spark, tmp_path):
    from keyledger.errors import LedgerError

    one, two = (ParquetStore(spark, str(tmp_path / "w"), num_buckets=2) for _ in range(2))
    one.commit(spark.createDataFrame([(1, "first")], "key long, value string"), after_version=-1)
    with pytest.raises(LedgerError):
        two.commit(spark.createDataFrame([(1, "second")], "key long, value string"), after_version=-1)
    assert [(r.key, r.value) for r in two.read().collect()] == [(1, "first")]


def test_buffer_states_at_the_limit(spark):
    from keyledger.operators import stats

    log = spark.createDataFrame([(0, "u", 1, "x" * 56, None), (1, "u", 1, None, None), (2, "u", 1, None, None)], TEXT)
    assert [(r.seq, r.state) for r in stats.buffer_state_changes(log, 1, 64).orderBy("seq").collect()] == [(0, "WITHIN_LIMIT"), (1, "EXCEEDED_LIMIT")]
    aux = spark.createDataFrame([(0, "c", 1, None, "a" * 65)], TEXT)
    assert [(r.seq, r.state) for r in stats.buffer_state_changes(aux, 1, 64).collect()] == [(0, "EXCEEDED_LIMIT")]


def test_engine_lifecycle(spark, tmp_path):
    told, sent = [], []
    engine = Engine(spark, Settings("seen", str(tmp_path), num_buckets=2), dispatcher=lambda df: sent.extend(r.callback for r in df.collect()))
    engine.add_listener(told.append)
    df = spark.createDataFrame([(0, 9, "v")], "n long, k long, v string")
    engine.put(None)
    engine.check_update(df, "k", "n", "v")
    engine.check(df.selectExpr("n + 1 n", "k"), "k", "n")
    with pytest.raises(NotAppendable):
        engine.append_update(df, "k", "n", "v")
    engine.close()
    engine.close()
    assert sorted(sent) == ["duplicate_key_check", "unique_key_update"]
    assert [e["kind"] for e in told] == ["put", "put", "merging", "finished", "closed"]
    with pytest.raises(LedgerClosed):
        engine.check(df, "k", "n")
    again = Engine(spark, Settings("seen", str(tmp_path), num_buckets=2))
    assert [(r.key, r.value) for r in again.store.read().collect()] == [(9, "v")] and again.store.lookup(9).count() == 1 and again.store.lookup(-9).count() == 0
    for bad in ({"num_buckets": 3}, {"merge_bytes": 100}, {"combine": "what"}):
        with pytest.raises(ValueError):
            Settings("x", str(tmp_path), **bad)


def test_versions(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "s"), num_buckets=2)
    assert store.read().count() == 0 and store.notes() == {}
    for i in range(4):
        store.commit(spark.createDataFrame([(i, str(i))], "key long, value string"), batch=i)
    assert store.versions() == [2, 3] and store.notes() == {"batch": 3} and [r.key for r in store.read().collect()] == [3]


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "s"), num_buckets=4)
    quarter = 2**62
    keys_ = [-2 * quarter, -quarter, 0, quarter]  # one in each bucket
    store.commit(spark.createDataFrame([(k, "old") for k in keys_], "key long, value string"))
    files = lambda: {r.bucket: r.f for r in store.read().selectExpr("bucket", "input_file_name() f").collect()}
    before = files()
    log = spark.createDataFrame([(0, "u", 0, "new", None), (1, "c", quarter, None, None), (2, "u", 7, None, None)], TEXT)
    done, number = merge_into(store, log, str(tmp_path / "out"))
    assert number == 1 and sorted((r.seq, r.result) for r in done.collect() if r.result) == [(1, "DUPLICATE_KEY")]
    assert {r.key: r.value for r in store.read().collect()} == {-2 * quarter: "old", -quarter: "old", 0: "new", 7: None, quarter: "old"}
    assert {b for b, f in files().items() if f != before[b]} == {2}
    for i in range(2):  # the first version goes, and what later ones still name stays
        merge_into(store, spark.createDataFrame([(i, "u", -quarter, str(i), None)], TEXT), str(tmp_path / f"out{i}"))
    assert files()[0] == before[0] and store.versions() == [2, 3] and store.count() == 5
    assert ParquetStore(spark, str(tmp_path / "s"), num_buckets=16).lookup(quarter).first().value == "old"
    checks = spark.createDataFrame([(0, "c", 5, None, None)], TEXT)
    merge_into(store, checks, str(tmp_path / "c"))
    assert store.versions() == [3, 4] and store.count() == 5


@pytest.mark.parametrize("few", [0, 10_000])
def test_hot_keys_alone_are_dealt_out(spark, monkeypatch, few):
    monkeypatch.setattr("keyledger.operators.merge.FEW", few)
    rnd = random.Random(31)
    hot = [(n * n, rnd.choice("cub"), 5, f"v{n}", None) for n in range(400)]  # gaps that grow
    log = [(s, o, k, None if o == "c" else v, a) for s, o, k, v, a in hot + [(n, rnd.choice("cub"), 100 + n % 40, f"w{n}", None) for n in range(200)]]
    store = [(5, "stored"), (101, None), (999, "alone")]
    results, after = merge(spark.createDataFrame(store, "key long, value string"), spark.createDataFrame(log, TEXT), chunk=50)
    want, state = model(store, log, None)
    assert rows(results) == sorted(want) and {r.key: r.value for r in after.collect()} == state


def test_dispatch_is_in_order_within_a_bucket(spark, tmp_path):
    log = spark.createDataFrame([(n, "u", n % 3 - 1, str(n), None) for n in reversed(range(60))], TEXT)
    results, _ = merge(spark.createDataFrame([], "key long, value string"), log)
    out = str(tmp_path)

    def note(row):
        with open(f"{out}/{row['key'] < 0}", "a") as f:
            f.write(f"{row['seq']}\n")

    dispatch(results, {"update": note}, num_buckets=2)
    for name, want in (("True", [n for n in range(60) if n % 3 == 0]), ("False", [n for n in range(60) if n % 3])):
        assert [int(x) for x in open(f"{out}/{name}")] == want
