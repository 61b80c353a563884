"""URL filters, DataFrame functions only: a blocked Bloom filter passes possible hits to an exact hash join.

A rule is a host and a path start; it fits the host, its subdomains, and paths that start with its own. A URL can only be
fit by rules made of a suffix of its host and a start of its path whose length some rule has, so these few keys per URL are
looked up. The filter is blocks of 512 bits, eight words of 64: a key's hash picks the block, and one bit in each of 4 of its words, so a
test touches one block. What passes is joined with the rules by equality, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS, PROBES, KEYS_PER_BLOCK = 8, 4, 32
#: Blocks at most: 16 MB of filter. With more rules than it is made for it passes more false positives, and the join stays exact.
MOST_BLOCKS = 262_144
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _probes(key: Column) -> list[tuple[Column, Column]]:
    """(word, bit) of each probe: two words of the first half and two of the second, so that they differ."""
    h = F.xxhash64(key, F.lit(7))
    part = lambda at, bits: F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    return [(part(8 * i, 1) + 2 * i, part(8 * i + 1, 6)) for i in range(PROBES)]


def build_filter(keys: DataFrame, key: str = "key") -> tuple[Column, int]:
    """The filter's words as one array, a scalar subquery made on the executors, and its blocks. keys: one column of keys."""
    n = keys.count()
    blocks = 1
    while blocks * KEYS_PER_BLOCK < n and blocks < MOST_BLOCKS:
        blocks *= 2
    k = F.col(key)
    bit = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)
    bits = keys.select(F.explode(F.array(*[F.struct((_block(k, blocks) * WORDS + w).alias("at"), bit(b).alias("bit")) for w, b in _probes(k)])).alias("x"))
    words = bits.groupBy(F.col("x.at").cast("long").alias("id")).agg(F.bit_or("x.bit").alias("word"))
    every = keys.sparkSession.range(blocks * WORDS).join(words, "id", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0)).alias("word")))), lambda x: x["word"]).alias("words")).scalar(), blocks


def may_contain(key: Column, words: Column, blocks: int) -> Column:
    """Whether the filter, a column of its words, may hold the key."""
    at = _block(key, blocks) * WORDS
    tests = [F.call_function("shiftrightunsigned", F.get(words, at + w), b).bitwiseAND(F.lit(1).cast("long")) == 1 for w, b in _probes(key)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of `pages`: id, host, path, rule, verdict.

    rules: `rule` (host and path start, like ``org/``), `verdict` (allow or block). Of the rules that fit a URL the longest decides, of
    equally long ones the last by verdict and text; of repeated rules the least verdict. Without one `default` does. Null URLs and
    those without `://` have an empty host and path, and no rule. Repeated rows and null ids are judged each; empty tables give none.
    """
    rules = rules.select(F.concat(F.translate(F.regexp_extract("rule", "^[^/]*", 0), _UPPER, _LOWER), F.regexp_extract("rule", "(?s)/.*$", 0)).alias("key"), F.col("rule"), F.col("verdict"))
    rules = rules.where("rule is not null").groupBy("key").agg(F.min(F.struct("rule", "verdict")).alias("r")).select("key", "r.rule", "r.verdict")
    # lengths of path starts that some rule has: one number each, at most as long as URLs get
    lengths = sorted(r[0] for r in rules.select(F.length(F.regexp_extract("key", "(?s)/.*$", 0)).alias("n")).distinct().collect())
    rows = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    out = [F.col("id").alias(id_col), "host", "path"]
    if not lengths:
        return rows.select(*out, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    words, blocks = build_filter(rules.select("key"))
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "words": words})
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array_distinct(F.filter(F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: F.when(F.length("path") >= n, F.substring(F.col("path"), F.lit(1), n))), lambda s: s.isNotNull()))
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(starts, lambda s: F.concat(h, s))))
    maybe = F.when(F.col("host") != "", F.filter(keys, lambda k: may_contain(k, F.col("words"), blocks)))
    hits = rows.select("row", "id", "host", "path", F.explode_outer(maybe).alias("key"))
    # the exact join; Spark broadcasts the rules only below its size limit
    joined = hits.join(rules, "key", "left")
    best = F.max_by(F.struct("rule", "verdict"), F.when(F.col("rule").isNotNull(), F.struct(F.length("key"), F.col("verdict"), F.col("key"))))
    found = joined.groupBy("row", "id", "host", "path").agg(best.alias("best"))
    return found.select(*out, F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


#: The rules of the registered query.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of `pages`; a URL that no rule fits is allowed."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.sql("select * from values " + ", ".join(f"('{r}', '{v}')" for r, v in RULES) + " as t(rule, verdict)"))


_VALUES = ", ".join(f"('{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{v}')" for r, v in RULES)
OP1_SQL = f"""
with rules(rule, rh, rp, v) as (values {_VALUES}),
p as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path from pages),
b as (select page_id, max_by(rule, length(rule)) rule, max_by(v, length(rule)) v from p join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id)
select page_id, host, path, rule, coalesce(v, 'allow') verdict from p left join b using (page_id)
"""
QUERIES = {"op1_url_filter": op1_url_filter}
ORACLE = {"op1_url_filter": OP1_SQL}
