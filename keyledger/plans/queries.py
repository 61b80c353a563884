"""The registered queries of the ledger, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyledger.functions import keys
from keyledger.operators import combine, oplog, stats
from keyledger.operators import merge as m
from keyledger.sources.oplogs import stream_log, write_log
from keyledger.sources.store import ParquetStore
from keyledger.streaming import stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the log and store that most queries use: events over customers, whose keys are spread so that half of the log's keys have none ---


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    op = F.when(kind == "click", "b").when(kind == "purchase", "u").when(kind.isin("view", "signup"), "c").otherwise("b")
    return oplog.operations(_table(spark, sf_dir, "events"), op, "user_id", "event_id", "props", "event_type")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).cast("long").alias("key"), F.col("c_name").alias("value"))


_LOG = """
x as (
  select event_id seq, user_id as key, event_type aux,
         case event_type when 'view' then 'c' when 'click' then 'b' when 'purchase' then 'u' when 'signup' then 'c' else 'b' end op,
         nullif(props, '') as value from events
  union all select -1, 2 * c_custkey, null, 's', c_name from customer),
y as (select *, last_value(case when op in ('u','b','s') then struct_pack(v := value) end ignore nulls)
        over (partition by key order by seq rows between unbounded preceding and 1 preceding) prev from x),
r as (select seq, key, op, case when op in ('c','b') then case when prev is null then 'UNIQUE_KEY' else 'DUPLICATE_KEY' end end result,
        case when op = 'c' then prev.v else value end as value, aux from y where op <> 's'),
f as (select key, last(value order by seq) as value from x where op <> 'c' group by key)
"""


def _sql(select: str, more: str = "") -> str:
    return f"with {_LOG}{more} {select}"


@query(_sql("select seq, key, op, result, value from r"))
def mixed_ops_classify(spark, sf_dir):
    """All of check, update and check-update in one log: the flagship."""
    return m.merge(_customers(spark, sf_dir), _events(spark, sf_dir))[0].select("seq", "key", "op", "result", "value")


@query(_sql("select seq, key, op, result, value from r"))
def mixed_ops_hot_keys(spark, sf_dir):
    """The same, with each key's operations dealt out by ranges of seq."""
    return m.merge(_customers(spark, sf_dir), _events(spark, sf_dir), chunk=1000)[0].select("seq", "key", "op", "result", "value")


@query(_sql("select seq, key, value, aux, case when result is null then 'update' else (case result when 'UNIQUE_KEY' then 'unique' else 'duplicate' end) || (case op when 'c' then '_key_check' else '_key_update' end) end callback, (key >> 60) + 8 as bucket from r"))
def dispatch_events(spark, sf_dir):
    """What a sink is called with, with the bucket that orders it."""
    return stats.with_bucket(m.merge(_customers(spark, sf_dir), _events(spark, sf_dir))[0], 16).select("bucket", "seq", "key", "value", "aux", "callback")


@query(_sql("select op, result, count(*) n from r group by all"))
def result_counts(spark, sf_dir):
    return stats.result_counts(m.merge(_customers(spark, sf_dir), _events(spark, sf_dir))[0])


@query(_sql("select key, value from f"))
def merge_final_store(spark, sf_dir):
    """The merged store, from one partial aggregate per key."""
    return m.final_store(_customers(spark, sf_dir), _events(spark, sf_dir))


@query(_sql("select count(*) n_entries, sum(12 + coalesce(octet_length(encode(value)), 0))::bigint n_bytes from f"))
def store_length(spark, sf_dir):
    return stats.store_length(m.final_store(_customers(spark, sf_dir), _events(spark, sf_dir)))


@query(_sql("select count(*) n_entries, (select count(*) from r where result = 'UNIQUE_KEY' and op = 'b') n_new from f"))
def store_count(spark, sf_dir):
    """Entries of the store, and keys that check-updates added."""
    log, store = _events(spark, sf_dir), _customers(spark, sf_dir)
    results, after = m.merge(store, log)
    new = results.where("result = 'UNIQUE_KEY' and op = 'b'").agg(F.lit(0).cast("long").alias("n_entries"), F.count(F.lit(1)).alias("n_new"))
    return after.agg(F.count(F.lit(1)).alias("n_entries"), F.lit(0).cast("long").alias("n_new")).unionByName(new).agg(F.sum("n_entries").alias("n_entries"), F.sum("n_new").alias("n_new"))


@query(_sql("select key from f"))
def stored_keys(spark, sf_dir):
    return m.final_store(_customers(spark, sf_dir), _events(spark, sf_dir)).select("key")


@query("select c_custkey as key, c_name as value from customer order by key")
def sorted_scan(spark, sf_dir):
    """The store in the order of signed keys: a range exchange, then sorted files."""
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value")).orderBy("key")


@query("select c_custkey as key, c_name as value from customer where c_custkey = 42")
def point_lookup(spark, sf_dir):
    """One key: the filter reaches the scan."""
    return _table(spark, sf_dir, "customer").where("c_custkey = 42").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))


@query("with x as (select event_id seq, user_id as key, nullif(props, '') as value from events union all select -1, 2 * c_custkey, c_name from customer) select key, last(value order by seq) as value from x group by key")
def update_upsert(spark, sf_dir):
    """A log of updates alone."""
    return m.final_store(_customers(spark, sf_dir), oplog.update(_table(spark, sf_dir, "events"), "user_id", "event_id", "props"))


# --- checks alone ---


def _orders_log(spark, sf_dir):
    return oplog.check(_table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


_CHECKS = "select o_orderkey seq, o_custkey as key, case when c_custkey is null then 'UNIQUE_KEY' else 'DUPLICATE_KEY' end result, c_name as value from orders left join customer on o_custkey = 2 * c_custkey"


@query(_CHECKS)
def check_classify(spark, sf_dir):
    """Checks against a store, by one join."""
    return m.check_only(_customers(spark, sf_dir), _orders_log(spark, sf_dir)).select("seq", "key", "result", "value")


@query(f"select seq, key from ({_CHECKS}) where result = 'UNIQUE_KEY'")
def check_unique_only(spark, sf_dir):
    return m.check_only(_customers(spark, sf_dir), _orders_log(spark, sf_dir)).where("result = 'UNIQUE_KEY'").select("seq", "key")


@query(f"select seq, key from ({_CHECKS}) where result = 'DUPLICATE_KEY'")
def check_duplicate_only(spark, sf_dir):
    return m.check_only(_customers(spark, sf_dir), _orders_log(spark, sf_dir)).where("result = 'DUPLICATE_KEY'").select("seq", "key")


# --- string keys ---

_FOLD = "list_reduce(list_prepend(1125899906842597::HUGEINT, list_transform(regexp_extract_all({0}, '(?s).'), lambda c: unicode(c)::HUGEINT)), lambda a, b: (a * 31 + b) % 18446744073709551616)"


def _key_sql(column: str) -> str:
    fold = _FOLD.format(column)
    return f"(case when {fold} >= 9223372036854775808 then {fold} - 18446744073709551616 else {fold} end)::bigint"


def _empty(spark, kind: str = "string"):
    return spark.createDataFrame([], f"key long, value {kind}")


@query(f"select page_id, url, {_key_sql('url')} as key from pages")
def key_hash_url(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", "url", keys.string_key("url").alias("key"))


@query(f"select o_orderkey, {_key_sql('o_custkey::varchar')} as key from orders")
def key_hash_int(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", keys.value_key("o_custkey").alias("key"))


@query(f"with k as (select page_id seq, {_key_sql('url')} as key, url aux from pages), x as (select * from k union all select seq + 1000000000, key, aux from k where seq % 3 = 0) select seq, key, case row_number() over (partition by key order by seq) when 1 then 'UNIQUE_KEY' else 'DUPLICATE_KEY' end result, aux from x")
def url_seen(spark, sf_dir):
    """URL-seen test: every third page comes by a second time."""
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), keys.string_key("url").alias("key"), F.col("url").alias("aux"))
    again = pages.where("seq % 3 = 0").withColumn("seq", F.col("seq") + 1_000_000_000)
    log = oplog.check_update(pages.unionByName(again), "key", "seq", aux="aux")
    return m.merge(_empty(spark), log)[0].select("seq", "key", "result", "aux")


@query(f"select doc_id seq, key, case row_number() over (partition by key order by doc_id) when 1 then 'UNIQUE_KEY' else 'DUPLICATE_KEY' end result, source as value from (select doc_id, source, {_key_sql('source')} as key from documents)")
def check_update_seen(spark, sf_dir):
    """Source-seen test over documents."""
    log = oplog.check_update(_table(spark, sf_dir, "documents").withColumn("k", keys.string_key("source")), "k", "doc_id", "source")
    return m.merge(_empty(spark), log)[0].select("seq", "key", "result", "value")


@query(f"select page_id, (key >> 62) + 2 as bucket, (key >> 60) + 8 as bucket16 from (select page_id, {_key_sql('url')} as key from pages)")
def bucket_for_key(spark, sf_dir):
    k = _table(spark, sf_dir, "pages").select("page_id", keys.string_key("url").alias("key"))
    return k.select("page_id", keys.range_bucket("key", 4).alias("bucket"), keys.range_bucket("key", 16).alias("bucket16"))


@query(f"select page_id, xor((key >> 60) + 8, 8) as bucket from (select page_id, {_key_sql('url')} as key from pages)")
def bucket_of_key64(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", keys.top_bits64(keys.string_key("url"), 16).alias("bucket"))


@query("select o_orderkey, (((o_custkey * 40503 * 65537) % 4294967296) >> 28)::int as bucket from orders")
def bucket_of_key32(spark, sf_dir):
    spread = F.col("o_custkey") * 40503 * 65537 % 4294967296
    signed = F.when(spread >= 2147483648, spread - 4294967296).otherwise(spread).cast("int")
    return _table(spark, sf_dir, "orders").select("o_orderkey", keys.top_bits32(signed, 16).alias("bucket"))


@query("select o_orderkey, lpad(hex(o_orderkey), 16, '0') as hex64, lpad(hex(o_custkey), 8, '0') as hex32, o_orderkey as back64, o_custkey::int as back32, -o_orderkey as negative from orders")
def codec_roundtrip(spark, sf_dir):
    df = _table(spark, sf_dir, "orders")
    wide, narrow = keys.long_to_bytes("o_orderkey"), keys.int_to_bytes("o_custkey")
    return df.select("o_orderkey", F.hex(wide).alias("hex64"), F.hex(narrow).alias("hex32"), keys.bytes_to_long(wide).alias("back64"), keys.bytes_to_int(narrow).alias("back32"), keys.bytes_to_long(keys.long_to_bytes(-F.col("o_orderkey"))).alias("negative"))


@query("select doc_id, octet_length(encode(text))::bigint as n_bytes, text as back from documents")
def codec_utf8(spark, sf_dir):
    data = keys.encode_text("text")
    return _table(spark, sf_dir, "documents").select("doc_id", F.octet_length(data).cast("long").alias("n_bytes"), keys.decode_text(data).alias("back"))


# --- bytes and routes ---


def _hashed(spark, sf_dir):
    return oplog.update(_table(spark, sf_dir, "events").withColumn("k", keys.value_key("user_id")), "k", "event_id", "props", "event_type")


_HASHED = f"h as (select event_id seq, {_key_sql('user_id::varchar')} as key, props as value, event_type aux from events), b as (select *, (key >> 60) + 8 as bucket, coalesce(octet_length(encode(value)), 0)::bigint vb, coalesce(octet_length(encode(aux)), 0)::bigint ab from h)"


@query(f"with {_HASHED} select bucket, seq, key, value from b")
def op_log_routing(spark, sf_dir):
    return stats.with_bucket(_hashed(spark, sf_dir), 16).select("bucket", "seq", "key", "value")


@query(f"with {_HASHED} select bucket, count(*) n_ops, sum(13 + vb)::bigint kv_bytes, sum(4 + ab)::bigint aux_bytes from b group by bucket")
def bucket_bytes(spark, sf_dir):
    return stats.bucket_bytes(_hashed(spark, sf_dir), 16)


@query(f"with {_HASHED} select bucket, sum(8 + vb)::bigint kv_bytes, sum(ab)::bigint aux_bytes from b group by bucket")
def buffer_bytes(spark, sf_dir):
    return stats.buffered_bytes(_hashed(spark, sf_dir), 16)


@query(f"with {_HASHED}, t as (select *, (sum(8 + vb) over w)::bigint total, (sum(ab) over w)::bigint aux_total from b window w as (partition by bucket order by seq rows unbounded preceding)), e as (select bucket, min(seq) first_seq, min(case when total > 4096 or aux_total > 4096 then seq end) over_seq from t group by bucket) select t.bucket, seq, case when seq = over_seq then 'EXCEEDED_LIMIT' else 'WITHIN_LIMIT' end state, total, aux_total from t join e on t.bucket = e.bucket and (seq = first_seq or seq = over_seq)")
def buffer_state_changes(spark, sf_dir):
    return stats.buffer_state_changes(_hashed(spark, sf_dir), 16, 4096)


# --- appends ---


def _neighbours(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), "l_suppkey").distinct()
    return items.groupBy("key").agg(F.array_sort(F.collect_list("l_suppkey")).alias("neighbours"))


@query("select l_partkey as key, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') neighbours from lineitem group by l_partkey")
def append_set_union(spark, sf_dir):
    """Final sets per key: distinct pairs before the sets are gathered."""
    return _neighbours(spark, sf_dir).select("key", F.concat_ws(",", F.col("neighbours").cast("array<string>")).alias("neighbours"))


@query("select l_partkey as key, count(distinct l_suppkey) indegree from lineitem group by 1 order by indegree desc, key limit 20")
def indegree_topk(spark, sf_dir):
    """Keys with the largest sets."""
    return _neighbours(spark, sf_dir).select("key", F.size("neighbours").cast("long").alias("indegree")).orderBy(F.desc("indegree"), "key").limit(20)


def _append_log(spark, sf_dir, replace: bool):
    value = F.array(F.col("event_id") % 17)
    op = F.when(F.col("event_type") == "view", "c").when(F.lit(replace) & (F.col("event_type") == "purchase"), "u").otherwise("a")
    return oplog.operations(_table(spark, sf_dir, "events"), op, "user_id", "event_id", value)


def _append_sql(replace: str) -> str:
    return f"""with x as (select event_id seq, user_id as key, case when event_type = 'view' then 'c' when {replace} and event_type = 'purchase' then 'u' else 'a' end op, event_id % 17 v from events),
    s as (select *, sum((op = 'u')::int) over (partition by key order by seq rows unbounded preceding) seg, coalesce(max((op <> 'c')::int) over (partition by key order by seq rows between unbounded preceding and 1 preceding), 0) seen from x)
    select seq, key, op, case when op = 'c' then case seen when 1 then 'DUPLICATE_KEY' else 'UNIQUE_KEY' end end result,
      array_to_string(list_sort(list_distinct(list(v) filter (op <> 'c') over (partition by key, seg order by seq rows unbounded preceding))), ',') as value from s"""


def _set_text(df: DataFrame) -> DataFrame:
    return df.select("seq", "key", "op", "result", F.when(F.col("value").isNotNull(), F.concat_ws(",", F.col("value").cast("array<string>"))).alias("value"))


@query(_append_sql("false"))
def append_running(spark, sf_dir):
    """Each append reports the merged set so far."""
    return _set_text(m.merge(_empty(spark, "array<long>"), _append_log(spark, sf_dir, False), "set_union")[0])


@query(_append_sql("true"))
def append_then_update(spark, sf_dir):
    """Replacements start the sets anew; dealt out by ranges of seq."""
    return _set_text(m.merge(_empty(spark, "array<long>"), _append_log(spark, sf_dir, True), "set_union", chunk=2000)[0])


def _cents(spark, sf_dir):
    return oplog.append_update(_table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long")), "user_id", "event_id", "cents", value_type="long")


@query("select event_id seq, user_id as key, (sum(round(value * 100)::bigint) over (partition by user_id order by event_id rows unbounded preceding))::bigint as value from events")
def append_sum(spark, sf_dir):
    """Running sums, in whole cents."""
    return m.merge(_empty(spark, "long"), _cents(spark, sf_dir), "sum", chunk=2000)[0].select("seq", "key", "value")


def _xor(stored: int, new: int) -> int:
    return int(stored) ^ int(new)


@query("select event_id seq, user_id as key, bit_xor(round(value * 100)::bigint) over (partition by user_id order by event_id rows unbounded preceding) as value from events")
def append_custom(spark, sf_dir):
    """A user's combiner in Python: exclusive or."""
    return m.merge(_empty(spark, "long"), _cents(spark, sf_dir), combine.custom(_xor))[0].select("seq", "key", "value")


# --- streaming ---


def _scratch(spark: SparkSession, name: str) -> str:
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/keyledger-{name}-{uuid.uuid4().hex}"


@query(ORACLE["mixed_ops_classify"])
def stream_equals_batch(spark, sf_dir):
    """The flagship as a stream of four files with a store that is carried from batch to batch."""
    base = _scratch(spark, "stream")
    log = _events(spark, sf_dir)
    top = log.agg(F.max("seq")).first()[0] or 0
    for i in range(4):  # files are taken in the order in which they were written
        part = log.where((F.col("seq") * 4 >= i * (top + 1)) & (F.col("seq") * 4 < (i + 1) * (top + 1)))
        part.coalesce(1).write.mode("append").parquet(f"{base}/log")
    store = ParquetStore(spark, f"{base}/store", num_buckets=4)
    store.commit(_customers(spark, sf_dir))
    run = stream.start(stream_log(spark, f"{base}/log", log.schema, files_per_trigger=1), store, f"{base}/results", f"{base}/checkpoint")
    run.awaitTermination()
    return spark.read.parquet(f"{base}/results").select("seq", "key", "op", "result", "value")


@query(_sql("select key, value from f"))
def store_commit_reopen(spark, sf_dir):
    """Two commits to a store, read through a handle that was opened afterwards."""
    base = _scratch(spark, "store")
    store = ParquetStore(spark, base)
    store.commit(_customers(spark, sf_dir))
    store.commit(m.final_store(store.read(), _events(spark, sf_dir)))
    return ParquetStore(spark, base).read().select("key", "value")


@query("select c_custkey * 2 as key, c_name as value from customer where c_custkey = 42")
def store_lookup(spark, sf_dir):
    """One key of a store: one bucket is read."""
    store = ParquetStore(spark, _scratch(spark, "lookup"))
    store.commit(_customers(spark, sf_dir))
    return store.lookup(84).select("key", "value")


@query(f"with {_HASHED} select bucket, seq, key from b")
def log_write_read(spark, sf_dir):
    """A log written by bucket and read again."""
    base = _scratch(spark, "log")
    write_log(_hashed(spark, sf_dir), base)
    return spark.read.parquet(base).select(F.col("bucket").cast("long").alias("bucket"), "seq", "key")
