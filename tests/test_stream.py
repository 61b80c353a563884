import random

from keyledger.operators.merge import merge
from keyledger.sources.oplogs import stream_log
from keyledger.sources.store import ParquetStore
from keyledger.streaming import stream

TEXT = "seq long, op string, key long, value string, aux string"


def test_stream_equals_batch_and_replay(spark, tmp_path):
    rnd = random.Random(7)
    log = [(i, rnd.choice("cub"), rnd.randrange(9), f"v{i}", None) for i in range(90)]
    for i in range(3):
        spark.createDataFrame(log[i * 30 : (i + 1) * 30], TEXT).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    whole = spark.createDataFrame(log, TEXT)
    store, told = ParquetStore(spark, str(tmp_path / "store"), num_buckets=4), []
    run = lambda ck: stream.start(stream_log(spark, str(tmp_path / "log"), whole.schema, 1), store, str(tmp_path / "out"), str(tmp_path / ck), on_batch=lambda df, n: told.append(n)).awaitTermination()
    run("a")
    want, after = merge(spark.createDataFrame([], "key long, value string"), whole)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(got.collect()) == sorted(want.collect()) and told == [0, 1, 2]
    run("b")  # the same batches again: already committed, so skipped
    assert told == [0, 1, 2] and sorted(store.read().select("key", "value").collect()) == sorted(after.collect())
