"""WARC: archives of one gzip member per record, an index of them, and reads that go by the index.

Writing gives the index (file, offset, length, URL, digest per record) before anything is read back. A read sorts the selected
records by file and offset, joins those that lie close together to byte ranges, and each task fetches whole ranges. Archives are
written to storage that all executors share. A file's name is its task attempt's own, and only attempts that succeed are in the index, so a
lost executor leaves a file that nothing names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyledger.llm.common import Scratch, texts_of

LEAST_REVISIT = 100
TASKS = 20_000  # of a read, at most
INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string, refers_to long"
_BREAKS = re.compile(r"[\x00-\x1f\x7f]")


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else re.sub(r"^file:/(?!/)", "file:///", path))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit has no block. Control characters of the URL are escaped, for headers are lines."""
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id, digest)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + _BREAKS.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to, digest)}"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return headers, rest[:n]


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _name(page_id: int | None, digest: str) -> str:
    """A record's name: of its page and payload, as ids may repeat."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest[:32]}>"


_NAME = re.compile(r"<urn:page:(-?\d+):")


def _number(urn: str) -> int | None:
    """The page of a record's name; none in names that others gave."""
    found = _NAME.match(urn)
    return int(found[1]) if found else None


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Writes a record per row under `path` and returns the index (not yet saved; save it to run the job once).

    Payload: the html in UTF-8; null is empty. Of rows with equal payloads of `least` bytes or more those with the smallest id are responses, and
    the others revisit it; smaller ones are all responses. Null ids are written as responses.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload")})
    slim = rows.where(F.col("n") >= least).where("id is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("many"))
    again = slim.where("many > 1").select("digest", "first")
    # slim rows find their response; bodies move once at most, by their own id
    refers = rows.where(F.col("n") >= least).select("id", "digest").join(again, "digest").where("id <> first").select("id", "digest", "first").distinct()
    rows = rows.join(refers, ["id", "digest"], "left").select("id", "url", "payload", "digest", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    files, base = _file_system(path)
                    files.create_dir(base, recursive=True)
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                places = []
                for i in range(batch.num_rows):
                    number, url, digest, first = (batch.column(k)[i].as_py() for k in (0, 1, 3, 4))
                    data = _member(record(number, url, batch.column(2)[i].as_py(), digest, first))
                    out.write(data)
                    places.append((at, len(data)))
                    at += len(data)
                n = batch.num_rows
                kinds = ["revisit" if x else "response" for x in batch.column(4).is_valid().to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * n), pa.array([x for x, _ in places], pa.int64()), pa.array([x for _, x in places], pa.int64()), batch.column(1), batch.column(3), pa.array(kinds), batch.column(4)], ["page_id", "file", "offset", "length", "url", "digest", "record_type", "refers_to"])
        finally:
            if out is not None:
                out.close()

    return rows.mapInArrow(write, INDEX)


def read_records(index: DataFrame, path: str, gap: int = 65_536, most: int = 8_388_608) -> DataFrame:
    """Fetches the index's records (select some first, if need be): page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Records of a file that lie at most `gap` bytes apart are one range, of `most` bytes or so. payload: the block, null for a revisit.
    payload_bytes and payload_digest are of the full payload; a response's are computed from what was read and compared with its header.
    """
    order = W.partitionBy("file").orderBy("offset")  # a file is one task's output
    start = F.col("offset") > F.lag(F.col("offset") + F.col("length")).over(order) + gap
    rows = index.select("file", "offset", "length").distinct()
    rows = rows.withColumn("far", F.coalesce(start, F.lit(True)).cast("int")).withColumn("part", F.sum("far").over(order))
    ranges = rows.groupBy("file", "part", F.expr(f"offset div {most}").alias("piece")).agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records"))
    # by the bytes that are to be read, of which the descriptors' own size tells nothing
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    ranges = ranges.select("file", "records").repartition(min(TASKS, 1 + total // most), "file", F.col("records")[0]["offset"])
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _file_system(path)
        for batch in batches:
            for i in range(batch.num_rows):
                records = batch.column(1)[i].as_py()
                begin = records[0]["offset"]
                with files.open_input_file(f"{base}/{batch.column(0)[i].as_py()}") as f:
                    data = f.read_at(records[-1]["offset"] + records[-1]["length"] - begin, begin)
                out = []
                for r in records:
                    headers, block = parse(zlib.decompress(data[r["offset"] - begin : r["offset"] - begin + r["length"]], 31))
                    kind, own = headers["warc-type"], hashlib.sha256(block).hexdigest()
                    # records of other writers may name another digest, and no length
                    name, told = headers.get("warc-payload-digest", ""), headers.get("x-payload-length")
                    digest = name.removeprefix("sha256:") if name.startswith("sha256:") else own if kind == "response" else None
                    n = int(told) if told else len(block) if kind == "response" else None
                    if kind == "response" and (len(block) != n or own != digest):
                        raise ValueError(f"a record of {batch.column(0)[i]} is damaged")
                    refers = headers.get("warc-refers-to")
                    out.append((_number(headers.get("warc-record-id", "")), headers.get("warc-target-uri"), kind, _number(refers) if refers else None, n, digest, block if kind == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return ranges.mapInArrow(fetch, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def archive(pages: DataFrame, path: str | None = None, **columns: str) -> tuple[DataFrame, str]:
    """Writes archives and their index under a shared folder; gives the saved index and the archives' path."""
    scratch = Scratch(pages.sparkSession, "warc")
    path = path or scratch.path("archives")
    return scratch.save(write_archives(pages, path, **columns), "index"), path


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pages` written as WARC and read back."""
    index, path = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_records(index, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
with p as (select page_id, encode(coalesce(html, '')) b, sha256(coalesce(html, '')) d from pages),
f as (select d, min(page_id) m from p where octet_length(b) >= 100 group by d)
select page_id, octet_length(b)::bigint payload_bytes, d payload_digest, case when m < page_id then 'revisit' else 'response' end record_type, case when m < page_id then m end refers_to
from p left join f using (d)
"""
QUERIES = {"op4_warc": op4_warc}
ORACLE = {"op4_warc": OP4_SQL}
