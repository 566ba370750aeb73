"""Hashes of the words and shingles of many texts at once, in numpy, and an exact prefix filter over shingle sets.

Words are runs of anything but ASCII white space, A-Z lower-cased. A word's hash is a polynomial over its bytes, taken
from running sums, so that no step is made per word. A shingle's hash combines its words' hashes in their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.workers import discard, ready, stored
from tidegraph.llm.common import slices

#: Bytes hashed at a time; a longer word is still taken whole.
BLOCK = 1 << 20
_rng = np.random.default_rng(20240229)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = int(_rng.integers(1, 1 << 62, dtype=np.uint64)) * 2 + 1
TURN = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2 to the 64, at least n of each."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            rise = np.full(max(n, 2 * len(_powers[k])), b & 0xFFFFFFFFFFFFFFFF, np.uint64)
            rise[0] = 1
            _powers[k] = np.cumprod(rise)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def words_in(raw: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one, and every word's hash, start and end in it; how many words each text has. raw: texts in lower case, in UTF-8."""
    data = b"\n".join(raw) + b"\n"
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    found, starts_at, ends_at = [], [], []
    at = 0
    while at < len(data):
        to = min(at + BLOCK, len(data))
        if to < len(data):  # blocks end behind white space
            cut = max(data.rfind(c, at, to) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut < at:
                cut = min(k for k in (data.find(c, to) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if k >= 0)
            to = cut + 1
        part = np.frombuffer(data, np.uint8, to - at, at)
        space = SPACE[part]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts = edge[~space[edge]] if len(edge) else edge
        if not space[0]:
            starts = np.concatenate(([0], starts))
        ends = edge[space[edge]] if len(edge) else edge
        up, down = _power(len(part))
        total = np.cumsum(BYTE[part] * up[: len(part)])
        before = np.where(starts > 0, total[starts - 1], np.uint64(0))
        found.append(mixed((total[ends - 1] - before) * down[starts]))
        starts_at.append(starts + at)
        ends_at.append(ends + at)
        at = to
    where = np.concatenate(starts_at)
    return data, np.concatenate(found), where, np.concatenate(ends_at), np.diff(np.searchsorted(where, np.concatenate(([0], np.cumsum(sizes)))))


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of all texts, one after another; number of words of each)."""
    _, h, _, _, n = words_in(raw)
    return h, n


def distinct(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text sorted, each once; how many of each text. h is sorted in place."""
    ends = np.cumsum(n)
    for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
        h[a:b].sort()
    whose = np.repeat(np.arange(len(n)), n)
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (whose[1:] != whose[:-1])
    return h[keep], np.bincount(whose[keep], minlength=len(n))


def lowered(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]


def shingle_sets(texts: list[str | None], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's distinct shingles, sorted, one text after another; how many of each). A text of fewer words is one shingle."""
    h, n = word_hashes(lowered(texts))
    ends = np.cumsum(n)
    short = np.flatnonzero(n < words)
    whose = np.repeat(np.arange(len(n)), n)
    if len(h) >= words:
        x = h[: len(h) - words + 1] * TURN[0]
        for i in range(1, words):
            x += h[i : len(h) - words + 1 + i] * TURN[i]
        inside = whose[: len(x)] == whose[words - 1 :]
        x, own = mixed(x[inside]), whose[: len(inside)][inside]
    else:
        x, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(short):
        alone = mixed((np.array([(h[ends[d] - n[d] : ends[d]] * TURN[: n[d]]).sum(dtype=np.uint64) for d in short.tolist()], np.uint64) + n[short].astype(np.uint64)) * TURN[63])
        x, own = np.concatenate([x, alone]), np.concatenate([own, short])
        order = np.argsort(own, kind="stable")
        x, own = x[order], own[order]
    return distinct(x, np.bincount(own, minlength=len(n)))


def set_fingerprints(h: np.ndarray, n: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """The 64-bit SimHash of each text's distinct hashes: a bit is 1 if more than half of them have it."""
    whose = np.repeat(np.arange(len(n)), n)
    ones = np.zeros((len(n), 64), np.int64)
    for at in range(0, len(h), block):
        bits = np.unpackbits(h[at : at + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = whose[at : at + block]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits((2 * ones > n[:, None]).astype(np.uint8), axis=1, bitorder="little").view("<u8").ravel()


def text_key(raw: bytes) -> tuple[int, int]:
    """128 bits over a text's words in their order, as two signed longs."""
    x = xxhash.xxh3_128_intdigest(b" ".join(raw.split()), 7)
    return tuple((v ^ (1 << 63)) - (1 << 63) for v in (x >> 64, x & 0xFFFFFFFFFFFFFFFF))


#: A task gathers so many shingles, of at most so many texts, into one chunk before it deals them to buckets; a bucket is
#: made for about so many words.
CHUNK, TEXTS, BUCKET = 2_000_000, 1 << 16, 2_000_000
#: Shingles found in SEEN of the texts sampled, one of SAMPLED, are taken as equally common; workers know the first HOT of them.
COMMON, SAMPLED, SEEN, HOT = 1 << 30, 64, 16, 10_000
LOW = np.uint64((1 << 40) - 1)
KEPT = "bucket int, chunk long, kind int, a binary, b binary"


def _ids(s: np.ndarray, buckets: int) -> np.ndarray:
    """A shingle's name: its bucket, then 40 bits of its hash."""
    return ((s >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(40) | (s & LOW)


def _deal(words: int, buckets: int, common: np.ndarray, most: int, most_texts: int):
    """Texts (k, text) -> packed rows. Kind 0: shingles of a bucket (5 bytes each) and whose they are (2 bytes, by place in the
    chunk); kind 1: k and number of shingles of a chunk's texts; kind 2: its common shingles (8 bytes) and whose."""
    near = np.zeros(1 << 20, bool)
    near[(common & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = texts = 0

        def out() -> Iterator[pa.RecordBatch]:
            chunk = task << 24 | made
            k = np.concatenate([x for x, _, _ in held])
            n = np.concatenate([x for _, x, _ in held])
            ids = _ids(np.concatenate([x for _, _, x in held]), buckets)
            whose = np.repeat(np.arange(len(n)), n).astype(np.uint16)
            maybe = np.flatnonzero(near[(ids & np.uint64((1 << 20) - 1)).astype(np.int64)])
            hot = maybe[np.isin(ids[maybe], common)] if len(maybe) else maybe
            home = (31 * task + made) % buckets
            rows = [(home, 1, k.astype("<i8").tobytes(), n.astype("<i4").tobytes())]
            if len(hot):
                rows.append((home, 2, ids[hot].astype("<u8").tobytes(), whose[hot].astype("<u2").tobytes()))
                keep = np.ones(len(ids), bool)
                keep[hot] = False
                ids, whose = ids[keep], whose[keep]
            bucket = (ids >> np.uint64(40)).astype(np.int32)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
            ids, whose, bucket = ids[order], whose[order], bucket[order]
            edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(ids) else np.zeros(0, np.int64)
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(ids)], strict=True) if len(edge) else ():
                five = ids[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                rows.append((int(bucket[a]), 0, five.tobytes(), whose[a:b].astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], names=["bucket", "chunk", "kind", "a", "b"])

        for batch in batches:
            for piece in slices(batch, "text"):
                s, n = shingle_sets(piece.column("text").to_pylist(), words)
                if held and (size + len(s) > most or texts + len(n) > most_texts):
                    yield from out()
                    held, size, texts, made = [], 0, 0, made + 1
                held.append((piece.column("k").to_numpy(zero_copy_only=False), n, s))
                size, texts = size + len(s), texts + len(n)
        if held:
            yield from out()

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of sorted batches, all of one key together."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != held[-1][key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _places(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(2, -1).T).view("<u2").ravel()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows of whole buckets -> by chunk: shingles (8 bytes) found in more than one text, whose, in how many texts. Other kinds pass."""
    for rows in _groups(batches, "bucket"):
        out = [(r["chunk"], r["kind"], r["a"], r["b"], None) for r in rows if r["kind"]]
        rows = [r for r in rows if not r["kind"]]
        if rows:
            flat = np.frombuffer(b"".join(r["a"] for r in rows), np.uint8).reshape(-1, 5)
            ids = np.zeros((len(flat), 8), np.uint8)
            ids[:, :5] = flat
            ids = ids.view("<u8").ravel()
            sizes = [len(r["b"]) // 2 for r in rows]
            whose = np.concatenate([_places(r["b"]) for r in rows])
            order = np.argsort(ids)
            sorted_ids = ids[order]
            edge = np.flatnonzero(np.concatenate(([True], sorted_ids[1:] != sorted_ids[:-1])))
            n = np.diff(np.append(edge, len(ids)))
            df = np.empty(len(ids), np.int64)
            df[order] = np.repeat(n, n)
            more, ends = df > 1, np.cumsum(sizes)
            for r, a, b in zip(rows, (ends - sizes).tolist(), ends.tolist(), strict=True):
                hit = np.flatnonzero(more[a:b]) + a
                if len(hit):
                    out.append((r["chunk"], 0, (ids[hit] | np.uint64(r["bucket"] << 40)).tobytes(), whose[hit].astype("<u2").tobytes(), np.minimum(df[hit], COMMON - 1).astype("<i4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["chunk", "kind", "a", "b", "c"])


def _prefixes(similarity: float):
    """Packed rows of whole chunks -> (u: k, v: shingle) of the prefixes of texts that may have a similar one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "chunk"):
            head = next(r for r in rows if r["kind"] == 1)
            rows = [r for r in rows if r["kind"] != 1]
            if not rows:
                continue
            k, size = np.frombuffer(head["a"], "<i8"), np.frombuffer(head["b"], "<i4")
            ids = np.concatenate([np.frombuffer(r["a"], "<u8") for r in rows])
            whose = np.concatenate([np.frombuffer(r["b"], "<u2") for r in rows]).astype(np.int64)
            df = np.concatenate([np.frombuffer(r["c"], "<i4") if r["kind"] == 0 else np.full(len(r["b"]) // 2, COMMON, np.int32) for r in rows])
            held = np.bincount(whose, minlength=len(k))
            spare = held - np.ceil(size * similarity - 1e-9).astype(np.int64)
            some = spare[whose] >= 0
            ids, whose, df = ids[some], whose[some], df[some]
            order = np.lexsort((ids, df, whose))
            ids, whose = ids[order], whose[order]
            edge = np.flatnonzero(np.concatenate(([True], whose[1:] != whose[:-1]))) if len(whose) else np.zeros(0, np.int64)
            at = np.arange(len(whose)) - np.repeat(edge, np.diff(np.append(edge, len(whose))))
            first = at <= spare[whose]
            yield pa.RecordBatch.from_arrays([pa.array(k[whose[first]]), pa.array(ids[first].view(np.int64))], names=["u", "v"])

    return run


def prefix_links(classes: DataFrame, n_words: int, similarity: float, words: int = 5) -> DataFrame:
    """classes (k, text), k distinct -> edges (u, v): classes of this Jaccard similarity or more are connected by them. n_words: of all texts, about.

    An exact prefix filter. Similar sets share at least `need` = ceil(similarity * size) of either's shingles, so a class
    with fewer shingles that occur elsewhere has no near copy and goes. Of the m that do, in one order for all (rarest
    first), the first m - need + 1 are enough: at most m - need of them are missing in a similar set, and the first that
    both hold is in both prefixes. Each shared shingle of prefixes links its classes to the smallest of them.
    Exact whatever the order is, so a shingle that a sample finds to be common counts as such without being counted.

    Shingles travel packed, 7 bytes each, dealt by hash to buckets whose number grows with the words; then only those
    found in several texts travel back to their texts' chunk, and only prefixes are rows of their own. Rows of `classes`
    must come in the same order when a lost task runs again (a scan, or a sort-merge join), as chunks number their texts.
    """
    spark = classes.sparkSession
    ready(spark)
    buckets = min(1 << 23, max(2 * spark.sparkContext.defaultParallelism, n_words // BUCKET + 1))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                ids, n = np.unique(_ids(shingle_sets(piece.column("text").to_pylist(), words)[0], buckets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(n.astype(np.int64))], names=["s", "n"])

    sample = classes.filter(F.pmod(F.xxhash64("k"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(seen, "s long, n long")
    top = sample.groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= SEEN).orderBy(F.desc("n"), "s").limit(HOT).collect()
    common = np.array(sorted(r["s"] for r in top), np.int64).view(np.uint64)
    dealt = classes.select("k", "text").mapInArrow(_deal(words, buckets, common, CHUNK, TEXTS), KEPT)
    shared = dealt.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(_shared, "chunk long, kind int, a binary, b binary, c binary")
    parts = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    home = (F.shiftright("chunk", 24) + F.col("chunk").bitwiseAND(F.lit((1 << 24) - 1)) * 31).cast("long")
    back = shared.repartitionById(parts, F.pmod(home, F.lit(parts)).cast("int")).sortWithinPartitions("chunk")
    prefixes = stored(back.mapInArrow(_prefixes(similarity), "u long, v long"))
    least = prefixes.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")).filter("n > 1").select("v", "m")
    links = stored(prefixes.join(least, "v").filter("u <> m").select("u", F.col("m").alias("v")).distinct())
    discard(prefixes)
    return links
