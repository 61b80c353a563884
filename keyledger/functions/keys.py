"""Key, bucket and codec functions as column expressions: no UDF, JVM-side (higher-order functions are interpreted)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the 64-bit string key: seed and multiplier.
HASH_SEED, HASH_FACTOR = 1125899906842597, 31
_LOW = 0xFFFFFFFF


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utf16_units(text: Column | str) -> Column:
    """UTF-16 code units of a string: a code point above 0xFFFF is two units."""
    points = F.transform(F.filter(F.split(_col(text), ""), lambda c: c != ""), lambda c: F.ascii(c))
    pair = lambda c: F.array(F.shiftright(c - 65536, 10) + 55296, (c - 65536).bitwiseAND(F.lit(1023)) + 56320)
    return F.flatten(F.transform(points, lambda c: F.when(c >= 65536, pair(c)).otherwise(F.array(c))))


def string_key(text: Column | str) -> Column:
    """64-bit key of a string: ``h = 31 * h + unit`` over UTF-16 units, modulo 2**64; null stays null.

    Held as two 32-bit limbs, since a plain product overflows under ANSI mode.
    """
    limbs = lambda hi, lo: F.struct(hi.cast("long").alias("hi"), lo.cast("long").alias("lo"))

    def step(a: Column, unit: Column) -> Column:
        lo = a["lo"] * HASH_FACTOR + unit
        hi = a["hi"] * HASH_FACTOR + F.shiftright(lo, 32)
        return limbs(hi.bitwiseAND(F.lit(_LOW)), lo.bitwiseAND(F.lit(_LOW)))

    start = limbs(F.lit(HASH_SEED >> 32), F.lit(HASH_SEED & _LOW))
    return F.aggregate(utf16_units(text), start, step, lambda a: F.shiftleft(a["hi"], 32).bitwiseOR(a["lo"]))


def value_key(value: Column | str) -> Column:
    """Key of an integer or string value: the key of its decimal text."""
    return string_key(_col(value).cast("string"))


def bucket_bits(num_buckets: int) -> int:
    """Bits of a bucket number; the count must be a power of two."""
    if num_buckets < 1 or num_buckets & (num_buckets - 1):
        raise ValueError(f"the number of buckets must be a power of two, not {num_buckets}")
    return num_buckets.bit_length() - 1


def range_bucket(key: Column | str, num_buckets: int) -> Column:
    """Bucket by the top bits of a signed key, so that bucket order is key order."""
    bits = bucket_bits(num_buckets)
    if not bits:
        return F.lit(0).cast("long")
    return F.shiftright(_col(key), 64 - bits) + F.lit(num_buckets // 2).cast("long")


def top_bits64(key: Column | str, num_buckets: int) -> Column:
    """The top bits of a 64-bit key, unsigned."""
    bits = bucket_bits(num_buckets)
    return F.shiftrightunsigned(_col(key), 64 - bits) if bits else F.lit(0).cast("long")


def top_bits32(key: Column | str, num_buckets: int) -> Column:
    """The top bits of a 32-bit key, unsigned."""
    bits = bucket_bits(num_buckets)
    return F.shiftrightunsigned(_col(key).cast("int"), 32 - bits) if bits else F.lit(0)


def long_to_bytes(value: Column | str) -> Column:
    """Eight bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(_col(value).cast("long")), 16, "0"))


def int_to_bytes(value: Column | str) -> Column:
    """Four bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(_col(value).cast("long").bitwiseAND(F.lit(_LOW))), 8, "0"))


def bytes_to_long(data: Column | str) -> Column:
    """Signed integer of up to eight bytes, most significant first; shorter input is sign-extended."""
    h = F.hex(_col(data))
    negative = F.substring(h, 1, 1).isin(*"89ABCDEF")
    full = F.when(negative, F.lpad(h, 16, "F")).otherwise(F.lpad(h, 16, "0"))
    return F.when(F.length(h) > 0, F.conv(full, 16, -10).cast("long"))


def bytes_to_int(data: Column | str) -> Column:
    """Signed integer of up to four bytes, most significant first."""
    return bytes_to_long(data).cast("int")


def encode_text(text: Column | str) -> Column:
    """UTF-8 bytes of a string."""
    return F.encode(_col(text), "utf-8")


def decode_text(data: Column | str) -> Column:
    """String of UTF-8 bytes."""
    return F.decode(_col(data), "utf-8")


def value_bytes(value: Column | str) -> Column:
    """Stored bytes of a string value; null has none."""
    return F.coalesce(F.octet_length(_col(value)), F.lit(0)).cast("long")


def entry_bytes(value: Column | str) -> Column:
    """Bytes of a stored entry: 8 of the key, 4 of the length, the value."""
    return F.lit(12).cast("long") + value_bytes(value)


def log_bytes(value: Column | str) -> Column:
    """Bytes of an operation record: token, key, length, value."""
    return F.lit(13).cast("long") + value_bytes(value)


def aux_bytes(aux: Column | str) -> Column:
    """Bytes of an auxiliary record: length and data."""
    return F.lit(4).cast("long") + value_bytes(aux)


def buffer_bytes(value: Column | str) -> Column:
    """Bytes that a buffered operation counts: key and value."""
    return F.lit(8).cast("long") + value_bytes(value)
