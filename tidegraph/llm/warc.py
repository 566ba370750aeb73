"""WARC archives: writing with segmentation and identical-payload revisits, reading with reassembly.

A record whose block is longer than a segment is written as a first record with WARC-Segment-Number 1 and
continuation records that name its WARC-Segment-Origin-ID; the last one has WARC-Segment-Total-Length. HTTP payloads
travel in chunked transfer framing. Archives are rows (archive, data) of a few MB, kept as a table that any Spark
file system holds; `read_files` reads the same from .warc and .warc.gz files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.workers import ready, stored

# fixed values of the format
VERSION = b"WARC/1.1"
STARTS = re.compile(rb"WARC/\d\.\d\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

RECORDS = "kind string, record_id string, origin string, number int, total long, page_id long, refers_to long, digest string, block binary, error string"
#: Kinds of records that are read.
KINDS = ("response", "revisit", "resource", "conversion", "continuation")


class BadRecord(ValueError):
    """A record or message that doesn't hold what it announces."""


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(data: bytes, size: int = 4096) -> bytes:
    """Chunked transfer framing of data."""
    parts = [b"%x\r\n%b\r\n" % (len(data[i : i + size]), data[i : i + size]) for i in range(0, len(data), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """What chunked framing holds; chunk extensions and trailers are dropped."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise BadRecord("chunk size")
        try:
            size = int(data[at:end].split(b";")[0].strip(), 16)
        except ValueError as e:
            raise BadRecord("chunk size") from e
        at = end + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or data[at + size : at + size + 2] != b"\r\n":
            raise BadRecord("chunk cut short")
        out.append(data[at : at + size])
        at += size + 2


def http_body(block: bytes) -> bytes:
    """The payload of an HTTP response message, unframed if it is chunked."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise BadRecord("no end of the HTTP header")
    fields = dict(line.lower().partition(b":")[::2] for line in head.split(b"\r\n")[1:])
    return unchunked(body) if fields.get(b"transfer-encoding", b"").strip() == b"chunked" else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def header_value(url: str | None) -> str | None:
    """A URL as a header value: control characters, which would end the header, percent-encoded."""
    return None if url is None else "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


DATE, HTTP = "2024-01-01T00:00:00Z", "application/http; msgtype=response"


def new_id() -> str:
    return f"<urn:uuid:{uuid.uuid4()}>"


def page_fields(kind: str, me: str, page_id: int | None, url: str | None, sha: bytes) -> list[tuple[str, object]]:
    return [("WARC-Type", kind), ("WARC-Record-ID", me), ("WARC-Date", DATE), ("WARC-Target-URI", header_value(url)), ("X-Page-Id", page_id), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha).decode()), ("Content-Type", HTTP)]


def revisit_record(page_id: int | None, url: str | None, sha: bytes, refers: int | None) -> bytes:
    return record([*page_fields("revisit", new_id(), page_id, url, sha), ("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", refers)], HTTP_HEAD)


def response_records(page_id: int | None, url: str | None, payload: bytes, sha: bytes, segment: int) -> Iterator[bytes]:
    """The record of one page, or its segments."""
    me, block = new_id(), HTTP_HEAD + chunked(payload)
    first = page_fields("response", me, page_id, url, sha)
    if len(block) <= segment:
        yield record(first, block)
        return
    yield record([*first, ("WARC-Segment-Number", 1)], block[:segment])
    for number, at in enumerate(range(segment, len(block), segment), 2):
        last = at + segment >= len(block)
        yield record(
            [("WARC-Type", "continuation"), ("WARC-Record-ID", new_id()), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", me), ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", len(block) if last else None)],
            block[at : at + segment],
        )


def number(text: str | None) -> int | None:
    """A header's whole number."""
    if text is None:
        return None
    try:
        return int(text)
    except ValueError as e:
        raise BadRecord(f"not a number: {text[:40]}") from e


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(header fields by lower-case name, block, error) of each record of an archive.

    Where no whole record can be read there is an error instead of a record, and reading goes on where one seems to start.
    """
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        fields: dict[str, str] = {}
        try:
            if not data.startswith(b"WARC/", at) or end < 0:
                raise BadRecord("no record where one should start")
            for line in data[at:end].split(b"\r\n")[1:]:
                k, _, v = line.partition(b":")
                fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
            size = number(fields.get("content-length", "-1"))
            stop = end + 4 + size
            if size < 0 or data[stop : stop + 4] != b"\r\n\r\n":
                raise BadRecord("record cut short")
            yield fields, data[end + 4 : stop], None
            at = stop + 4
        except BadRecord as e:
            yield fields, b"", str(e)
            again = STARTS.search(data, at + 1)
            at = again.start() if again else len(data)


def write_pages(pages: DataFrame, segment: int = 4096, archive: int = 2 << 20) -> DataFrame:
    """pages (page_id, url, html) -> archives (archive, data): one record each, revisits for repeated payloads.

    Of pages with equal payloads (null html: empty) the one with the largest page_id is the response and others
    revisit it; rows that repeat a page_id and payload share its fate. Records are found equal by SHA-1 and length
    in a narrow table; the payloads of revisits don't travel.
    """
    ready(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("sha", F.sha1("html"))
    narrow = stored(rows.select("page_id", "sha", F.length("html").alias("n")))
    heads = narrow.groupBy("sha", "n").agg(F.max("page_id").alias("head"), F.count("*").alias("rows")).filter("rows > 1").select(F.col("sha").alias("s"), "n", "head")
    others = narrow.join(stored(heads).withColumnRenamed("n", "m"), (F.col("sha") == F.col("s")) & (F.col("n") == F.col("m"))).filter(~F.col("page_id").eqNullSafe(F.col("head")))
    others = stored(others.select(F.col("page_id").alias("p"), "s", "head").distinct())
    marked = rows.join(others, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left")
    marked = marked.select("page_id", "url", F.when(F.col("s").isNull(), F.col("html")).alias("html"), "sha", "head", F.col("s").isNotNull().alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{uuid.uuid4().hex}.warc"]), pa.array([b"".join(held)], pa.binary())], names=["archive", "data"])

        for batch in batches:
            for row in batch.to_pylist():
                sha = bytes.fromhex(row["sha"])
                if row["revisit"]:
                    made = [revisit_record(row["page_id"], row["url"], sha, row["head"])]
                else:
                    made = response_records(row["page_id"], row["url"], row["html"], sha, segment)
                for r in made:
                    held.append(r)
                    size += len(r)
                    if size >= archive:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return marked.mapInArrow(run, "archive string, data binary")


def unpacked(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """What a .warc or .warc.gz file holds, in pieces; members that follow each other are one stream. A harmed end is left out."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + step] for i in range(0, len(data), step))
        return
    rest = data
    while rest[:2] == b"\x1f\x8b":
        stream = zlib.decompressobj(31)
        try:
            more = rest
            while not stream.eof:
                piece = stream.decompress(more, step)
                if piece:
                    yield piece
                more = stream.unconsumed_tail
                if not more and not piece:
                    return
        except zlib.error:
            return
        rest = stream.unused_data


def whole_records(pieces: Iterator[bytes], archive: int = 2 << 20) -> Iterator[bytes]:
    """Pieces of a file -> archives of about so many bytes, cut between records, so that a large file isn't held at once."""
    held, known, size = bytearray(), 0, len(b"\r\n\r\n")
    for piece in pieces:
        held += piece
        while known < len(held):
            end = held.find(b"\r\n\r\n", known)
            if end < 0:
                break
            length = next((x.partition(b":")[2].strip() for x in bytes(held[known:end]).split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), b"")
            if not length.isdigit() or not held.startswith(b"WARC/", known):  # harmed: what follows is cut by its reader
                known = end + size
                continue
            stop = end + size + int(length) + size
            if stop > len(held):
                break
            known = stop
            if known >= archive:
                yield bytes(held[:known])
                del held[:known]
                known = 0
    if held:
        yield bytes(held)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """.warc and .warc.gz files -> archives (archive, data): rows of a few MB, cut between records. A file is read as one binary value, so that it may have up to 2 GB packed."""
    ready(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("archive").to_pylist(), batch.column("data"), strict=True):
                for part in whole_records(unpacked(data.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.binary())], names=["archive", "data"])

    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), F.col("content").alias("data")).mapInArrow(run, "archive string, data binary")


SCHEMA = pa.schema([("kind", pa.string()), ("record_id", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("block", pa.binary()), ("error", pa.string())])


def _record(f: dict[str, str], block: bytes, error: str | None) -> tuple:
    kind = f.get("warc-type")
    named = (f.get("warc-record-id"), f.get("warc-segment-origin-id"))
    try:
        if error:
            raise BadRecord(error)
        numbers = [number(f.get(k)) for k in ("warc-segment-number", "warc-segment-total-length", "x-page-id", "x-refers-to-page-id")]
        if any(n is not None and abs(n) >= 1 << 63 for n in numbers) or (numbers[0] or 0) >= 1 << 31:
            raise BadRecord("number out of range")
        return (kind, *named, *numbers, f.get("warc-payload-digest"), None if kind == "revisit" else block, None)
    except BadRecord as e:
        return (kind or "unknown", *named, None, None, None, None, f.get("warc-payload-digest"), None, str(e))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("data").to_pylist():
            rows = [r for r in (_record(*x) for x in parse(data or b"")) if r[0] in KINDS or r[-1]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)


def read_records(archives: DataFrame) -> DataFrame:
    """archives -> record_id, page_id, kind, refers_to, digest, payload, error: every response, resource, conversion and revisit, segments joined.

    Every archive is parsed once. Only segments are shuffled: by origin, in the order of their numbers, whose sum must be the announced total.
    A record whose segments are incomplete, whose framing is broken or whose payload doesn't match its digest
    keeps its row: error says why, payload is null. So does what can't be read as a record at all (kind unknown, or as far
    as its header went); the records before and after it are read. Revisits have a null payload; the payload of resources
    and conversions is their block. Other kinds (warcinfo, request, metadata) give no rows. Empty archives: no rows.
    """
    ready(archives.sparkSession)
    records = stored(archives.select("data").mapInArrow(_records, RECORDS))
    single = records.filter("number is null")
    parts = records.filter("number is not null")
    joined = (
        parts.groupBy(F.coalesce("origin", "record_id").alias("record_id"))
        .agg(
            F.max(F.when(F.col("number") == 1, F.struct("kind", "page_id", "refers_to", "digest"))).alias("first"),
            F.max("total").alias("total"),
            F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"),
        )
        .select("record_id", "first.*", "total", "parts", F.lit(None).cast("string").alias("error"))
    )
    kinds = {"record_id": pa.string(), "page_id": pa.int64(), "kind": pa.string(), "refers_to": pa.int64(), "digest": pa.string(), "payload": pa.binary(), "error": pa.string()}

    def whole(row: dict) -> tuple[bytes | None, str | None]:
        if row["kind"] == "revisit" or row["error"]:
            return None, row["error"]
        try:
            if row["total"] is None or row["kind"] is None or [p["number"] for p in row["parts"]] != list(range(1, len(row["parts"]) + 1)):
                raise BadRecord("segments missing")
            block = b"".join(p["block"] for p in row["parts"])
            if len(block) != row["total"]:
                raise BadRecord("total length")
            body = http_body(block) if row["kind"] == "response" else block
            if row["digest"] and row["digest"] != "sha1:" + digest32(body):
                raise BadRecord("payload digest")
        except BadRecord as e:
            return None, str(e)
        return body, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            made = [whole(r) for r in rows]
            cols = [pa.array([r[k] for r in rows], t) for k, t in kinds.items() if k not in ("payload", "error")]
            cols += [pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=list(kinds))

    shape = "record_id string, page_id long, kind string, refers_to long, digest string, payload binary, error string"
    alone = single.select("record_id", "kind", "page_id", "refers_to", "digest", F.length("block").cast("long").alias("total"), F.array(F.struct(F.lit(1).alias("number"), "block")).alias("parts"), "error")
    return joined.select("record_id", "kind", "page_id", "refers_to", "digest", "total", "parts", "error").unionByName(alone).mapInArrow(run, shape)


def page_digests(records: DataFrame) -> DataFrame:
    """read_records' rows -> page_id, payload_bytes, payload_digest, record_type, refers_to; revisits take length and digest from their response.

    A response that couldn't be read has null length and digest. Digests are bare base32.
    """
    bare = F.substring_index("digest", ":", -1)
    rows = stored(records.select("page_id", "kind", "refers_to", bare.alias("digest"), F.length("payload").cast("long").alias("payload_bytes")))
    answers = stored(rows.filter("kind = 'response' and payload_bytes is not null").select(F.col("page_id").alias("a"), F.col("digest").alias("d"), F.col("payload_bytes").alias("n")).distinct())
    revisits = rows.filter("kind = 'revisit'").join(answers, F.col("refers_to").eqNullSafe(F.col("a")) & (F.col("digest") == F.col("d")), "left")
    told = rows.filter("kind = 'response'").select("page_id", "payload_bytes", F.when(F.col("payload_bytes").isNotNull(), F.col("digest")).alias("payload_digest"), F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return told.unionByName(revisits.select("page_id", F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to"))


def archive_pages(pages: DataFrame, segment: int = 4096) -> DataFrame:
    """Writes every page to archives in the shared folder, reads them back: page_digests of what was read."""
    return page_digests(read_records(stored(write_pages(pages, segment))))
