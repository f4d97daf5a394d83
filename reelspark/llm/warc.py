"""WARC archives (operator 10), index first.

Each task writes one archive of gzip members, a record each, and returns the index: archive, offset,
length, URL and digest. Reading begins with the index: selected records are sorted by place, ranges
that lie near each other are read at once, and records are cut from them. A task that runs anew
writes another archive; only the archive in its index rows counts.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import column, cut, shared_folder, small_batches, table

#: Payloads from this size on are stored once.
LEAST_REVISIT = 1000
#: Bytes between two selected records up to which one read covers both, and bytes of one read.
GAP = 64 << 10
RANGE = 4 << 20
#: Bytes of an archive that one reading task covers.
SPAN = 64 << 20
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: All records bear the time of the crawl; the input has none.
DATE = datetime(2026, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

INDEX = "archive string, offset bigint, length bigint, page_id bigint, url string, digest string"


def urn(page_id: int) -> str:
    """The record's identifier, the same for a page at every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its HTTP head and payload, or a revisit with the head alone. Identifiers are not
    to be turned back, so the pages' numbers have fields of their own. A null URL has no field."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {page_id}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def fields_of(head: bytes) -> dict[str, str]:
    """Named fields after the first line of a head."""
    return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])


def parse(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """A record's fields, the size of the payload that its HTTP head tells, and the payload that it holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = fields_of(head)
    http, _, body = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, int(fields_of(http)["Content-Length"]), body


def digests(pages: DataFrame) -> DataFrame:
    """(page_id, digest, n_bytes, local): the payload's SHA-1, and the largest page_id of the equal
    payloads in the task; only those rows stand for their payload later."""

    def run(batches):
        rows, most = [], {}
        for batch in small_batches(batches, "html"):
            for page, html in zip(column(batch, "page_id"), column(batch, "html"), strict=True):
                payload = (html or "").encode()
                key = hashlib.sha1(payload).digest()
                if len(payload) >= LEAST_REVISIT:
                    most[key] = max(page, most.get(key, page))
                rows.append((page, key, len(payload)))
        for a in range(0, len(rows), 20_000):
            page, key, size = zip(*rows[a : a + 20_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(key, pa.binary()), pa.array(size, pa.int64()), pa.array([most.get(k) for k in key], pa.int64())], names=["page_id", "digest", "n_bytes", "local"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id bigint, digest binary, n_bytes bigint, local bigint")


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, refers_to) of the pages whose payload a larger page_id has."""
    facts = cut(digests(pages))
    local = facts.where("local = page_id").select("digest", "local").distinct()
    largest = cut(local.join(local.groupBy("digest").agg(F.max("local").alias("refers_to")), "digest").select("local", "refers_to"))
    return facts.where("local is not null").join(largest, "local").where("refers_to <> page_id").select("page_id", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) in ``folder``, a URI that all tasks reach; the index.

    A null html is an empty payload, a null URL stays null. page_id is taken as a key (rows with none are left out); rows
    that repeat one are records of their own, and equal payloads among them are responses all. Other
    columns are not read; an empty table gives an empty index.
    """
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).where("page_id is not null")
    joined = pages.join(cut(revisits(pages)), "page_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, offset = None, 0
        for batch in small_batches(batches, "html"):
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            rows = []
            for page, url, html, refers in zip(*(column(batch, c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                payload = (html or "").encode()
                digest = hashlib.sha1(payload).hexdigest()
                data = member(record(page, url, payload, digest, refers))
                out.write(data)
                rows.append((name, offset, len(data), page, url, digest))
                offset += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])
        if out is not None:
            out.close()

    return cut(joined.mapInArrow(run, INDEX))


def ranges(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Reads (begin, end, spans within) that cover the sorted (offset, length) spans."""
    held: list[tuple[int, int]] = []
    for offset, length in spans:
        if held and (offset - (held[-1][0] + held[-1][1]) > GAP or offset + length - held[0][0] > RANGE):
            yield held[0][0], held[-1][0] + held[-1][1], held
            held = []
        held.append((offset, length))
    if held:
        yield held[0][0], held[-1][0] + held[-1][1], held


_RECORDS = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records that ``index`` (archive, offset, length, ...) selects, read by sorted ranges.

    A response's payload is checked against its digest; a mismatch raises. A revisit's payload is
    null, its payload_bytes are those of the payload that it refers to.
    """
    def run(batches):
        fs, root = pa.fs.FileSystem.from_uri(folder)
        opened: tuple[str, object] = ("", None)
        pending: list[tuple[int, int]] = []

        def records(archive):
            nonlocal opened
            if opened[0] != archive:
                opened = (archive, fs.open_input_file(f"{root}/{archive}"))
            for begin, end, spans in ranges(pending):
                data = opened[1].read_at(end - begin, begin)
                rows = []
                for offset, length in spans:
                    fields, size, body = parse(zlib.decompress(data[offset - begin : offset - begin + length], 31))
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = fields["WARC-Type"] == "response"
                    if response and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"{archive} at {offset}: the payload does not have its digest")
                    refers = fields.get("X-Refers-To-Page-ID")
                    rows.append((int(fields["X-Page-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], size, digest, int(refers) if refers else None, body if response and with_payload else None))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _RECORDS.split(", ")])

        archive = None
        for batch in batches:
            for name, offset, length in zip(*(column(batch, c) for c in ("archive", "offset", "length")), strict=True):
                if name != archive:
                    if pending:
                        yield from records(archive)
                    archive, pending = name, []
                pending.append((offset, length))
        if pending:
            yield from records(archive)

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.select("archive", "offset", "length", F.expr(f"offset div {SPAN}").alias("span")).repartition(parts, "archive", "span")
    return dealt.sortWithinPartitions("archive", "offset").select("archive", "offset", "length").mapInArrow(run, _RECORDS)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS digest FROM p),
m AS (SELECT digest, max(page_id) AS most FROM d WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN most IS NULL OR most = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN most <> page_id THEN most END AS refers_to
FROM d LEFT JOIN m ON d.digest = m.digest
"""
