"""WARC archives, index first: offset, length, URL and digest of each record, then coalesced reads of sorted byte ranges.

Records are gzip members of their own, so any of them can be read alone. Files are written by tasks through
``pyarrow.fs`` under names that no other attempt uses, and only the index (a Parquet table, committed by Spark) says
which files count; an executor that is lost leaves at most files that no index names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import lean, partitions, ready, saved, scratch, table

INDEX = "page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, file string, offset long, length long"


def _fs(uri: str):
    """Filesystem and path of a URI; a plain path is a local (shared) folder."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value) -> str:
    """One header line: no control characters."""
    return "".join(c for c in str(value) if c.isprintable())


def record(page_id, url, payload: bytes, digest: str, refers_to=None, refers_url=None) -> bytes:
    """One WARC/1.1 record with an HTTP block; a revisit has the HTTP head only."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    rid = uuid.uuid5(uuid.NAMESPACE_OID, f"{page_id}:{digest}")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{rid}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(url) if url else f'urn:page:{page_id}'}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{refers_to}:{digest}')}>", f"WARC-Refers-To-Target-URI: {_clean(refers_url) if refers_url else f'urn:page:{refers_to}'}"]
    head += [f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers of a record, and its payload's size; a response's payload is digested anew."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        if len(payload) != size or base32_sha1(payload) != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    number = lambda x: int(x) if x else None
    return {"page_id": number(fields["X-Page-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": number(fields["X-Refers-To-Page-ID"]), "payload_digest": digest, "payload_bytes": size, "payload": payload}


def decided(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages with sha (hex) and refers_to: of equal payloads of at least ``least_bytes``, the largest page_id is the response.

    The largest id is found with partial sums, so a payload that a third of the pages have is one row a task; the
    join back has one row a payload on its other side, and Spark splits a hot key's rows there. Rows of that very
    page_id (repeats) are responses, as is a row without page_id."""
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"), F.sha1(body).alias("sha"))
    best = (
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha1(body).alias("sha"), F.length(body).alias("bytes"))
        .where((F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull())
        .groupBy("sha").agg(F.max("page_id").alias("kept"), F.max_by("url", F.struct("page_id", "url")).alias("kept_url"), F.count("*").alias("n"))
        .where("n > 1").drop("n")
    )
    same = F.col("kept").isNull() | F.col("page_id").isNull() | (F.col("page_id") == F.col("kept"))
    return rows.join(best, "sha", "left").select("page_id", "url", "payload", "sha", F.when(~same, F.col("kept")).alias("refers_to"), F.when(~same, F.col("kept_url")).alias("refers_url"))


def write_warc(pages: DataFrame, out: str, least_bytes: int = 0, roll_mb: int = 256, level: int = 4) -> DataFrame:
    """Write a record for each page (null html: an empty payload; null url: ``urn:page:<id>``) and return the index table, already written."""
    ready(pages.sparkSession)

    def run(batches):
        fs, top = _fs(out)
        fs.create_dir(top, recursive=True)
        sink, name, at = None, "", 0
        try:
            for b in batches:
                rows = []
                for r in b.to_pylist():
                    if sink is None or at >= roll_mb << 20:
                        if sink is not None:
                            sink.close()
                        name = f"{top}/{uuid.uuid4().hex}.warc.gz"
                        sink, at = fs.open_output_stream(name, compression=None), 0
                    payload = r["payload"]
                    digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = z.compress(record(r["page_id"], r["url"], payload, digest, r["refers_to"], r["refers_url"])) + z.flush()
                    sink.write(data)
                    rows.append((r["page_id"], r["url"], "response" if r["refers_to"] is None else "revisit", r["refers_to"], digest, len(payload), name, at, len(data)))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, _TYPES)], names=_NAMES)
        finally:
            if sink is not None:
                sink.close()

    return saved(decided(pages, least_bytes).mapInArrow(lean(run), INDEX), "warc-index")


_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_TYPES = [pa.int64() if x.split()[1] == "long" else pa.string() for x in INDEX.split(", ")]
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def coalesced(rows: list[tuple], gap: int, most: int):
    """Groups of (file, offset, length, ...) sorted by file and offset that one read of at most ``most`` bytes can serve (a longer record is read alone)."""
    group, start, end = [], 0, 0
    for r in rows:
        if group and (r[0] != group[0][0] or r[1] - end > gap or r[1] + r[2] - start > most):
            yield group
            group = []
        if not group:
            start = r[1]
        group.append(r)
        end = r[1] + r[2]
    if group:
        yield group


def read_warc(index: DataFrame, gap: int = 64 << 10, most: int = 8 << 20, payloads: bool = False) -> DataFrame:
    """Read the records that the rows of ``index`` name (filter it first to select): sorted ranges, near ones in one read."""
    spark = ready(index.sparkSession)
    schema = _READ + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = _TYPES and [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches):
        at, stream, fs = None, None, None
        for b in batches:
            got = []
            for group in coalesced(list(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")))), gap, most):
                if group[0][0] != at:
                    if stream is not None:
                        stream.close()
                    at = group[0][0]
                    fs, path = _fs(at)
                    stream = fs.open_input_file(path)
                start = group[0][1]
                data = stream.read_at(group[-1][1] + group[-1][2] - start, start)
                got += [parse(zlib.decompress(data[o - start : o - start + n], 31)) for _, o, n in group]
            yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], t) for c, t in zip(names, types)], names=names)
        if stream is not None:
            stream.close()

    ranges = index.select("file", "offset", "length").repartitionByRange(partitions(spark), "file", "offset").sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(lean(run), schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each page, written and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    index = write_warc(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_warc(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS kept FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST(('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = kept THEN NULL ELSE kept END AS refers_to
FROM m
"""
