"""WARC archives of pages, written and read as streams of payload chunks.

Writing takes a table of (record, chunk number, bytes) rows in order and streams each record's
chunks to its archive; reading gives such a table back, every row with the count and the SHA-256
of its record's payload up to and including that chunk. Neither side holds a whole payload beyond
the page row it came in. Payloads that were archived before are written as revisit records.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risekit.llm.common import new_path, table, written

#: Bytes of a payload in one row.
CHUNK_BYTES = 1 << 18
#: Shorter payloads are always stored.
MIN_REVISIT_BYTES = 100
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "2000-01-01T00:00:00Z"
READ_SCHEMA = (
    "record_id string, page_id long, url string, record_type string, refers_to long, chunk_no long, "
    "data binary, bytes_so_far long, digest_so_far string, is_last boolean"
)


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; workers reach it without the JVM."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _header(kind: str, length: int, fields: dict[str, str | None]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {_DATE}", f"Content-Length: {length}"]
    lines += [f"{k}: {_clean(v)}" for k, v in fields.items() if v is not None]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _clean(value: str) -> str:
    """A header value on one line; per cent signs keep it reversible."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unclean(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_plan(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """pages with payload (bytes), payload_bytes, payload_digest, record_type and refers_to."""
    salts = 16
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    base = pages.withColumn("payload", payload).drop(payload_col)
    base = base.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    shared = (
        base.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min(id_col).alias("first_id"), F.count("*").alias("n"))
        .where(F.col("n") > 1)
        .select("payload_digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    # a payload of a third of all pages is dealt over the salts
    salted = base.withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int"))
    joined = salted.join(shared, ["payload_digest", "salt"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("first_id"))
    return (
        joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("first_id")))
        .drop("salt", "first_id")
    )


def chunk_rows(plan: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row per chunk of each record; a revisit record and an empty payload have one empty chunk."""
    stored = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(F.lit(0))
    chunks = F.greatest(F.lit(1), F.ceil(stored / chunk_bytes)).cast("int")
    rows = plan.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), chunks - 1)))
    data = F.when(F.col("record_type") == "response", F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)))
    return rows.withColumn("data", F.coalesce(data, F.lit("").cast("binary"))).drop("payload")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES, chunk_bytes: int = CHUNK_BYTES, compress: bool = True) -> DataFrame:
    """Write a record per row of pages; returns the manifest (archive, records, bytes), already written.

    Of rows with equal payloads of at least min_bytes the one with the smallest id is the response
    and the others revisit it; rows that repeat that smallest id are responses too. Null payloads
    are empty, null ids and urls are written without that field; a null id is never the smallest.
    Each task streams one archive to a name of its own attempt and moves it to its final name, so
    a task that runs again replaces its archive as a whole. No rows: no archives.
    """
    spark = pages.sparkSession
    plan = record_plan(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html")), "page_id", "html", min_bytes)
    rows = chunk_rows(plan, chunk_bytes)
    # without another shuffle: explode keeps a record's chunks together and in order
    rows = rows.select("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "chunk_no", "data", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(path)
        sink, raw, temporary, name, records, out = None, None, "", "", 0, None
        for batch in batches:
            for r in batch.to_pylist():
                if sink is None:
                    fs.create_dir(root, recursive=True)
                    name = f"{root}/pages-{r['part']:06d}.warc" + ".gz" * compress
                    temporary = f"{name}.{uuid.uuid4().hex}"
                    sink = fs.open_output_stream(temporary, compression=None)
                if r["chunk_no"] == 0:
                    if out is not None:
                        _end(out, raw)
                    raw = sink
                    out = gzip.GzipFile(fileobj=_Keep(sink), mode="wb", compresslevel=4, mtime=0) if compress else sink
                    out.write(_start(r))
                    records += 1
                out.write(r["data"])
        if sink is not None:
            _end(out, raw)
            size = sink.tell()
            sink.close()
            fs.move(temporary, name)
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return written(rows.mapInArrow(run, "archive string, records long, bytes long"), "warc-manifest")


class _Keep:
    """A sink that a gzip member may close without closing the archive."""

    def __init__(self, sink):
        self.sink = sink

    def write(self, data) -> int:
        return self.sink.write(bytes(data))

    def flush(self) -> None:
        pass


def _start(r: dict) -> bytes:
    """The header of a record, and of its HTTP response where it has one."""
    fields = {
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Target-URI": r["url"],
        "WARC-Payload-Digest": f"sha256:{r['payload_digest']}",
        "X-Page-ID": None if r["page_id"] is None else str(r["page_id"]),
        "X-Payload-Length": str(r["payload_bytes"]),
    }
    if r["record_type"] == "revisit":
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["X-Refers-To-Page-ID"] = str(r["refers_to"])
        return _header("revisit", 0, fields)
    fields["Content-Type"] = "application/http;msgtype=response"
    return _header("response", len(_HTTP) + r["payload_bytes"], fields) + _HTTP


def _end(out, sink) -> None:
    out.write(b"\r\n\r\n")
    if out is not sink:
        out.close()


def read_records(stream: BinaryIO, chunk_bytes: int) -> Iterator[dict]:
    """The chunk rows of an archive, in order, from a stream that is read once."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should start: {line[:40]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            k, _, v = line.decode().partition(": ")
            fields[k] = _unclean(v)
        left = int(fields["Content-Length"])
        page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
        row = {
            "record_id": fields["WARC-Record-ID"],
            "page_id": None if page is None else int(page),
            "url": fields.get("WARC-Target-URI"),
            "record_type": fields["WARC-Type"],
            "refers_to": None if refers is None else int(refers),
        }
        if fields["WARC-Type"] == "revisit":
            stored = fields["WARC-Payload-Digest"].removeprefix("sha256:")
            yield row | {"chunk_no": 0, "data": b"", "bytes_so_far": int(fields["X-Payload-Length"]), "digest_so_far": stored, "is_last": True}
        else:
            while (head := stream.readline()).strip():  # the HTTP header ends with an empty line
                left -= len(head)
            left -= len(head)
            digest, done, number = hashlib.sha256(), 0, 0
            while number == 0 or left:
                data = stream.read(min(left, chunk_bytes))
                if len(data) < min(left, chunk_bytes):
                    raise ValueError("the archive ends within a record")
                left -= len(data)
                done += len(data)
                digest.update(data)
                yield row | {"chunk_no": number, "data": data, "bytes_so_far": done, "digest_so_far": digest.copy().hexdigest(), "is_last": left == 0}
                number += 1
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")


def read_archives(spark: SparkSession, manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of the manifest's archives: record_id, chunk_no, data, running digest and more.

    A record's rows are its payload's chunks in order; the row with is_last has the digest and the
    length of the full payload. A revisit record has one row, without data, with those of the
    payload that it revisits. No archives: an empty table.
    """
    # a task per archive: a partitioning of a given size isn't coalesced, however small the paths are
    paths = manifest.select("archive").coalesce(1).repartition(max(1, manifest.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = open_fs(path)
                with fs.open_input_stream(name, compression=None, buffer_size=1 << 20) as raw:
                    stream = gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw
                    rows, size = [], 0
                    for row in read_records(_Lines(stream), chunk_bytes):
                        rows.append(row)
                        size += len(row["data"])
                        if size > 1 << 23 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, _ARROW)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return paths.mapInArrow(run, READ_SCHEMA)


_ARROW = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("is_last", pa.bool_())])


class _Lines:
    """readline and exact reads over a stream that may give less than asked for."""

    def __init__(self, stream):
        self.stream, self.held = stream, b""

    def readline(self) -> bytes:
        while (at := self.held.find(b"\n")) < 0:
            more = self.stream.read(1 << 16)
            if not more:
                line, self.held = self.held, b""
                return line
            self.held += more
        line, self.held = self.held[: at + 1], self.held[at + 1 :]
        return line

    def read(self, n: int) -> bytes:
        parts = [self.held[:n]]
        self.held = self.held[n:]
        n -= len(parts[0])
        while n:
            more = self.stream.read(n)
            if not more:
                break
            parts.append(more)
            n -= len(more)
        return b"".join(parts)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    manifest = write_archives(pages, new_path(spark, "warc"))
    rows = read_archives(spark, manifest)
    return rows.where("is_last").select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")


def op1_sql() -> str:
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
