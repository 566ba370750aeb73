"""Media columns: PNG pictures in binary columns, written, tested, read and hashed with numpy.

A payload is the samples of a grey or colour picture of 8 bits. Reading checks the signature, each chunk's length
and checksum, inflates the data chunks and undoes the five row filters; a low-frequency cosine transform gives a
64-bit hash of how the picture looks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.workers import ready
from tidegraph.llm.common import slices

# fixed values of the format
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
WIDTH = 64


class BadPicture(ValueError):
    """Bytes that are not a whole, unharmed picture of a kind that this module reads."""


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def filtered(rows: np.ndarray, kind: int, step: int) -> np.ndarray:
    """Rows of bytes after a row filter: 0 none, 1 left, 2 above, 3 mean of both, 4 the nearest of left, above and above left."""
    left = np.zeros_like(rows)
    left[:, step:] = rows[:, :-step]
    above = np.zeros_like(rows)
    above[1:] = rows[:-1]
    if kind == 0:
        return rows
    if kind == 1:
        return rows - left
    if kind == 2:
        return rows - above
    if kind == 3:
        return rows - ((left.astype(np.uint16) + above) >> 1).astype(np.uint8)
    corner = np.zeros_like(rows)
    corner[1:, step:] = rows[:-1, :-step]
    return rows - nearest(left, above, corner)


def nearest(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, above and corner the one nearest to left + above - corner; ties in that order."""
    x, y, z = a.astype(np.int16), b.astype(np.int16), c.astype(np.int16)
    da, db, dc = np.abs(y - z), np.abs(x - z), np.abs(x + y - 2 * z)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))


def unfiltered(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Undoes the filters. Runs of rows of the same simple kind go at once: sums along rows or columns, modulo 256."""
    out = np.zeros_like(rows)
    blank = np.zeros(rows.shape[1], np.uint8)
    at = 0
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for to in [*cuts.tolist(), len(kinds)]:
        kind, part = int(kinds[at]), rows[at:to]
        above = out[at - 1] if at else blank
        if kind == 0:
            out[at:to] = part
        elif kind == 1:
            out[at:to] = np.cumsum(part.reshape(len(part), -1, step), axis=1, dtype=np.uint8).reshape(part.shape)
        elif kind == 2:
            out[at:to] = np.cumsum(part, axis=0, dtype=np.uint8) + above
        elif kind in (3, 4):
            # a pixel needs its left, upper and corner ones: pixels on a slant are independent
            h, w = len(part), rows.shape[1] // step
            grid = np.zeros((h + 1, w + 1, step), np.uint8)
            grid[0, 1:] = above.reshape(w, step)
            given = part.reshape(h, w, step)
            for d in range(h + w - 1):
                i = np.arange(max(0, d - w + 1), min(h, d + 1))
                j = d - i
                a, b, c = grid[i + 1, j], grid[i, j + 1], grid[i, j]
                grid[i + 1, j + 1] = given[i, j] + (((a.astype(np.uint16) + b) >> 1).astype(np.uint8) if kind == 3 else nearest(a, b, c))
            out[at:to] = grid[1:, 1:].reshape(part.shape)
        else:
            raise BadPicture(f"row filter {kind}")
        at = to
    return out


def encode_png(samples: bytes, width: int = WIDTH, colour: int = 0, row_filter: int = 2, level: int = 1, most: int = 1 << 16) -> bytes:
    """A picture whose samples are these bytes, row by row; data chunks of at most `most` bytes."""
    step = CHANNELS[colour]
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width * step)
    lines = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    lines[:, 0] = row_filter
    lines[:, 1:] = filtered(rows, row_filter, step)
    packed = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, colour, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + b"".join(chunk(b"IDAT", packed[i : i + most]) for i in range(0, len(packed), most)) + chunk(b"IEND", b"")


def decode_png(data: bytes, most: int = 1 << 30) -> tuple[np.ndarray, int]:
    """(rows of sample bytes, channels) of a picture of at most so many bytes; BadPicture for anything cut, changed or of another kind."""
    if data[:8] != SIGNATURE:
        raise BadPicture("signature")
    at, head, packed, ended = 8, None, [], False
    while not ended:
        if at + 12 > len(data):
            raise BadPicture("cut short")
        size = struct.unpack_from(">I", data, at)[0]
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data):
            raise BadPicture("cut short")
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise BadPicture("checksum of " + kind.decode("latin-1"))
        at += 12 + size
        if kind == b"IHDR":
            if size != 13 or head:
                raise BadPicture("header")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:  # upper case: needed to read the picture
            raise BadPicture("chunk " + kind.decode("latin-1"))
    if not head or head[2] != 8 or head[3] not in CHANNELS or head[4:] != (0, 0, 0):
        raise BadPicture("only 8 bits, grey or true colour, not interlaced")
    width, height, step = head[0], head[1], CHANNELS[head[3]]
    size = height * (width * step + 1)
    if size > most:
        raise BadPicture("too large")
    try:
        stream = zlib.decompressobj()
        raw = stream.decompress(b"".join(packed), size + 1)  # no more than the header announces
    except zlib.error as e:
        raise BadPicture(str(e)) from e
    if len(raw) != size or not stream.eof:
        raise BadPicture("amount of data")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width * step + 1)
    return unfiltered(lines[:, 0], lines[:, 1:], step), step


def cosines(n: int, k: int = 8) -> np.ndarray:
    """The k lowest cosine waves over n samples."""
    return np.cos(np.pi / n * np.outer(np.arange(k), np.arange(n) + 0.5)).astype(np.float32)


_waves: dict[int, np.ndarray] = {}


def dct_hash(rows: np.ndarray, channels: int = 1) -> str:
    """64 bits as 16 hex digits: which of the 8 x 8 lowest cosine coefficients of the grey picture are above their median."""
    grey = rows.astype(np.float32) if channels == 1 else rows.reshape(len(rows), -1, channels)[:, :, : max(1, channels - (channels in (2, 4)))].mean(axis=2, dtype=np.float32)
    h, w = grey.shape
    if w not in _waves:
        _waves[w] = cosines(w)
    low = cosines(h) @ (grey @ _waves[w].T)
    return np.packbits((low > np.median(low)).ravel()).tobytes().hex()


def payload(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, those bytes padded with zeros to a positive multiple of 64)."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0")


def to_media(docs: DataFrame, key: str = "doc_id", text: str = "text", row_filter: int = 2) -> DataFrame:
    """Every row of docs -> doc_id, n_bytes, media: its text as a grey picture of 64 columns in a binary column. Null like empty."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                made = [payload(t) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), pa.array([encode_png(p, row_filter=row_filter) for _, p in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media -> with payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error.

    All are computed from the stored bytes. Null or harmed media keep their row: its error says why, the payload's
    columns and the feature are null.
    """
    ready(media.sparkSession)
    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "error": pa.string()}

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None, None, None, None, None, None, "null")
        stored = (len(data), hashlib.sha256(data).hexdigest())
        try:
            rows, channels = decode_png(data)
        except BadPicture as e:
            return (None, None, None, *stored, None, str(e))
        raw = rows.tobytes()
        return (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-WIDTH:]), *stored, dct_hash(rows, channels), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(zip(*map(one, batch.column("media").to_pylist()), strict=True)) or [()] * len(kinds)
            columns = [pa.array(v, t) for v, t in zip(made, kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=["doc_id", "n_bytes", *kinds])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
