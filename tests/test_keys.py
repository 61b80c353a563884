import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyledger.functions import keys

#: One known pair, the empty text's key, as evidence that keys are compatible; others are compared with the model.
KNOWN = ("", 1125899906842597)
URLS = ["https://news.example/a?id=1", "https://shop.example/", "ftp://files.example/x.tar", "mailto:someone@mail.example", "", "h"]


def model(text: str) -> int:
    h = 1125899906842597
    data = text.encode("utf-16-le")
    for i in range(0, len(data), 2):
        h = (31 * h + int.from_bytes(data[i : i + 2], "little")) % 2**64
    return h - 2**64 if h >= 2**63 else h


def test_string_keys_and_their_buckets(spark):
    df = spark.createDataFrame([(t,) for t in URLS], "t string")
    got = df.select("t", keys.string_key("t").alias("k"), keys.range_bucket(keys.string_key("t"), 4).alias("b")).collect()
    assert [(r.t, r.k, r.b) for r in got] == [(t, model(t), (model(t) >> 62) + 2) for t in URLS] and model(KNOWN[0]) == KNOWN[1]


def test_string_key_equals_model(spark):
    texts = ["é漢😀", "a" * 5000, "\n\t", "𝔘nicode", "x\u0000y"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(keys.string_key("t")).collect()
    assert [r[0] for r in got] == [model(t) for t in texts]
    assert spark.createDataFrame([(None,)], "t string").select(keys.string_key("t")).first()[0] is None


def test_buckets(spark):
    ks = [-(2**63), -1, 0, 1, 2**63 - 1]
    df = spark.createDataFrame([(k,) for k in ks], "k long")
    for n in (1, 2, 4, 512):
        bits = n.bit_length() - 1
        got = df.select(keys.range_bucket("k", n), keys.top_bits64("k", n)).collect()
        assert [r[0] for r in got] == [(k >> (64 - bits)) + n // 2 if n > 1 else 0 for k in ks]
        assert [r[1] for r in got] == [(k % 2**64) >> (64 - bits) if n > 1 else 0 for k in ks]
    for bad in (0, 3, -4):
        with pytest.raises(ValueError):
            keys.range_bucket("k", bad)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=20))
def test_codec_round_trip(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = df.select("v", keys.long_to_bytes("v").alias("b"), keys.bytes_to_long(keys.long_to_bytes("v")).alias("back")).collect()
    assert all(bytes(r.b) == r.v.to_bytes(8, "big", signed=True) and r.back == r.v for r in got)


def test_short_bytes_and_text(spark):
    df = spark.createDataFrame([(bytearray(b"\xff\xfe"),), (bytearray(b"\x01"),), (bytearray(b""),)], "b binary")
    assert [r[0] for r in df.select(keys.bytes_to_long("b")).collect()] == [-2, 1, None]
    text = "sieben Bären äßen Öl"
    n = len(text.encode())
    row = spark.createDataFrame([(text,)], "t string").select(F.octet_length(keys.encode_text("t")), keys.decode_text(keys.encode_text("t")), keys.entry_bytes("t"), keys.log_bytes("t"), keys.aux_bytes("t"), keys.buffer_bytes("t")).first()
    assert tuple(row) == (n, text, 12 + n, 13 + n, 4 + n, 8 + n)
