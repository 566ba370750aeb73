"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within r bits of each other have balls of radius r/2 that meet: each emits every variant of itself
within half the radius, rows are shuffled by variant, and fingerprints that share one are compared. On all 64 bits
and r = 4 that is 2,081 variants per fingerprint, so the bits are first split into parts: of `parts` parts, the
`kept` with fewest differences hold at most floor(r * kept / parts) of them, and the balls are formed on each choice of
`kept` parts with that smaller radius. With 3 parts of which 2 are kept (42 or 43 bits, radius 2), a fingerprint
emits 3 * 44 variants, and no pair within the radius is lost. parts = kept = 1 is the unsplit method.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.workers import discard, ready, stored
from tidegraph.llm.common import Forest, connected_components, maybe_broadcast, slices, spread
from tidegraph.llm.shingles import distinct, lowered, prefix_links, set_fingerprints, shingle_sets, text_key, word_hashes

#: Shingle hashes turned to bits at a time.
BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: bit b is 1 if more than half of the shingle hashes have it. No word: 0."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(found) - words + 1].tolist()
    ends = (ends[words - 1 :] - 1).tolist()
    line = b" ".join(found)
    cuts = map(line.__getitem__, map(slice, starts, ends))
    h = np.fromiter(map(xxhash.xxh64_intdigest, cuts, repeat(seed)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), BLOCK):
        part = h[at : at + BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, key: str = "doc_id") -> DataFrame:
    """Every row of docs -> (doc_id, fp): fp is the fingerprint's 64 bits as a signed long. Whole texts, null like empty."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                fp = np.fromiter((fingerprint(t, words) for t in piece.column("text").to_pylist()), np.uint64, piece.num_rows)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def choices(radius: int, parts: int, kept: int) -> list[tuple[int, int]]:
    """(mask of the kept bits, half radius) of each choice of parts."""
    edges = [64 * i // parts for i in range(parts + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(parts)]
    inner = radius * kept // parts
    return [(sum(masks[i] for i in chosen), (inner + 1) // 2) for chosen in combinations(range(parts), kept)]


def flips(mask: int, radius: int) -> np.ndarray:
    """All patterns of at most `radius` set bits within mask."""
    bits = [1 << b for b in range(64) if mask >> b & 1]
    return np.array([sum(c) for r in range(radius + 1) for c in combinations(bits, r)], dtype=np.uint64)


def _variants(masks: list[tuple[int, int]]):
    patterns = [(np.uint64(m), flips(m, r)) for m, r in masks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), 2048):
                fp = every[at : at + 2048]
                for i, (mask, flip) in enumerate(patterns):
                    key = ((fp & mask)[:, None] ^ flip[None, :]).ravel()
                    # the choice of parts goes into the bits that the choice leaves out
                    key ^= (~mask) & np.uint64(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(fp, len(flip)).view(np.int64))], names=["variant", "fp"])

    return run


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def link_bucket(fp: np.ndarray, radius: int, forest: Forest, block: int = 1024) -> None:
    """Links of one bucket's distinct fingerprints, block against block; what already hangs together isn't tried again."""
    for i in range(0, len(fp), block):
        for j in range(i, len(fp), block):
            a, b = np.nonzero(distance(fp[i : i + block, None], fp[None, j : j + block]) <= radius)
            if i == j:
                a, b = a[a < b], b[a < b]
            for x, y in zip(fp[i + a].tolist(), fp[j + b].tolist(), strict=True) if len(a) < 4 * block else spread(fp, i + a, j + b):
                forest.join(x, y)


def _links(radius: int):
    """Sorted (variant, fp) batches -> edges (u, v): a spanning forest of each batch's verified links. A bucket may run over batches."""

    def pairs(variant: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
        forest = Forest()
        starts = np.flatnonzero(np.concatenate(([True], variant[1:] != variant[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(variant)])))
        # small buckets together: every row against the next ones of its bucket
        for step in range(1, int(min(8, sizes.max(initial=0)))):
            a, b = fp[:-step], fp[step:]
            near = np.flatnonzero((variant[:-step] == variant[step:]) & (a != b) & (distance(a, b) <= radius))
            for x, y in {(x, y) for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True)}:
                forest.join(x, y)
        for k in np.flatnonzero(sizes > 8):
            link_bucket(np.unique(fp[starts[k] : starts[k] + sizes[k]]), radius, forest)
        return forest.edges()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(v: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            edges = np.array(pairs(v, f), dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(edges[:, 0].copy()), pa.array(edges[:, 1].copy())], names=["u", "v"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows, limit = 0, 200_000
        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            rows += batch.num_rows
            if rows < limit:
                continue
            v, f = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            cut = int(np.flatnonzero(v != v[-1])[-1]) + 1 if v[0] != v[-1] else 0
            if cut:
                yield out(v[:cut], f[:cut])
            held, rows = [(v[cut:], f[cut:])], len(v) - cut
            limit = max(200_000, 2 * rows)  # a bucket that goes on isn't copied again with each batch
        if rows:
            yield out(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))

    return run


def fingerprint_links(distinct: DataFrame, radius: int = 4, parts: int = 3, kept: int = 2) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (u, v) whose components are those of all pairs within the radius.

    The shuffle is by variant; each partition is sorted by variant, so a bucket is read as one run. A bucket holds
    distinct fingerprints only (copies were folded before), compared in blocks in bounded memory; only a spanning
    forest of the links leaves a batch, never all pairs.
    """
    variants = distinct.mapInArrow(_variants(choices(radius, parts, kept)), "variant long, fp long")
    spread = variants.repartition("variant").sortWithinPartitions("variant", "fp")
    return spread.mapInArrow(_links(radius), "u long, v long").distinct()


def _dense(col: np.ndarray, row: np.ndarray, part: np.ndarray, rows: int) -> np.ndarray:
    """0/1 matrix of rows against the sorted columns `part`."""
    at = np.searchsorted(part, col)
    at[at == len(part)] = 0
    hit = part[at] == col
    out = np.zeros((rows, len(part)), np.float32)
    out[row[hit], at[hit]] = 1
    return out


def shingle_links(sets: list[np.ndarray], similarity: float, first: int | None = None, block: int = 512, columns: int = 8192) -> np.ndarray:
    """Label (smallest index reachable) of each set over pairs of at least this Jaccard similarity; with `first`, only pairs across that index count.

    Block against block: common shingles are a matrix product over those that both blocks hold. Blocks that hang together
    already are skipped.
    """
    m = len(sets)
    sizes = np.array([len(x) for x in sets], np.float64)
    owner = np.repeat(np.arange(m), sizes.astype(np.int64))
    _, col, n = np.unique(np.concatenate(sets) if m else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    shared = n[col] > 1  # what one set alone holds is in no intersection
    col, owner = col[shared], owner[shared]
    edge = np.searchsorted(owner, np.arange(0, m + block, block))
    label = np.arange(m)
    for i in range(0, m, block):
        for j in range(i, m, block):
            x, y = label[i : i + block], label[j : j + block]
            if (x == x[0]).all() and (y == x[0]).all():
                continue
            if first is not None and (i >= first or j + block <= first):
                continue
            (ca, ra), (cb, rb) = ((col[edge[k // block] : edge[k // block + 1]], owner[edge[k // block] : edge[k // block + 1]] - k) for k in (i, j))
            both = np.intersect1d(ca, cb)
            common = np.zeros((len(x), len(y)), np.float64)
            for at in range(0, len(both), columns):
                part = both[at : at + columns]
                common += _dense(ca, ra, part, len(x)) @ _dense(cb, rb, part, len(y)).T
            a, b = np.nonzero(common >= similarity * (sizes[i : i + block, None] + sizes[None, j : j + block] - common))
            a, b = a + i, b + j
            wanted = a < b if first is None else (a < first) & (b >= first)
            a, b = label[a[wanted]], label[b[wanted]]
            a, b = a[a != b], b[a != b]
            if len(a):
                to = np.arange(m)
                for p, q in spread(np.arange(m), a, b):
                    to[p] = q
                label = to[label]
    return label


def _tile_links(similarity: float):
    """Sorted rows (i, j, tile, k, s) of tiles -> links (u, v): of each tile (or pair of tiles) of a cluster a spanning forest of its similar pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            names = [table.column(c).to_numpy() for c in ("key", "cluster", "i", "j")]
            edge = np.flatnonzero(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in names], axis=0))))
            tile, k, s = table.column("tile").to_numpy(), table.column("k").to_numpy(), table.column("s").to_pylist()
            made: list[np.ndarray] = []
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(k)], strict=True):
                sets = [np.frombuffer(x, np.int64) for x in s[a:b]]
                crossing = names[2][a] != names[3][a]
                label = shingle_links(sets, similarity, int((tile[a:b] == tile[a]).sum()) if crossing else None)
                far = np.flatnonzero(label != np.arange(len(label)))
                made.append(np.stack([k[a + far], k[a + label[far]]]))
            flat = np.concatenate(made, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(flat[0].copy()), pa.array(flat[1].copy())], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            names = ("key", "cluster", "i", "j")
            same = np.all([batch.column(c).to_numpy(zero_copy_only=False) == batch.column(c)[batch.num_rows - 1].as_py() for c in names], axis=0)
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if held and any(held[-1].column(c)[held[-1].num_rows - 1].as_py() != batch.column(c)[0].as_py() for c in names):
                yield from out(pa.Table.from_batches(held))
                held = []
            if cut:
                yield from out(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from out(pa.Table.from_batches(held))

    return run


#: A tile of a cluster holds at most so many sets and about so many shingles. Clusters are cut finer, so that many tasks share
#: them, as long as that makes no more than FINE tiles, for each set is sent to all tiles of its cluster.
TILE_SETS, TILE_SHINGLES, FINE, SMALL = 8192, 2_000_000, 24, 128


def _keyed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.array([text_key(r) for r in lowered(texts)], np.int64).reshape(-1, 2)
    return keys[:, 0].copy(), keys[:, 1].copy()


def _right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text has the key (cid, chk) that they carry."""
    for batch in batches:
        for piece in slices(batch, "text"):
            cid, chk = _keyed(piece.column("text").to_pylist())
            yield piece.filter(pa.array((cid == piece.column("cid").to_numpy(zero_copy_only=False)) & (chk == piece.column("chk").to_numpy(zero_copy_only=False))))


def _groups_of(docs: DataFrame, similarity: float, words: int, radius: int, parts: int, kept: int) -> tuple[DataFrame, bool]:
    """near_copies, and whether doc_id names each row."""
    spark = docs.sparkSession
    ready(spark)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                raw = lowered(piece.column("text").to_pylist())
                h, n = word_hashes(raw)
                keys = np.array([text_key(r) for r in raw], np.int64).reshape(-1, 2)
                fp = set_fingerprints(*distinct(h, n)).view(np.int64)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array(fp), pa.array(n.astype(np.int64))], names=["doc_id", "cid", "chk", "fp", "n"])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 200_000):
                flat, n = shingle_sets(piece.column("text").to_pylist(), words)
                made = np.split(flat, np.cumsum(n)[:-1])
                rows = []
                for k, cluster, tile, of, s in zip(*(piece.column(c).to_pylist() for c in ("k", "cluster", "tile", "tiles")), made, strict=True):
                    rows += [(cluster, min(tile, o), max(tile, o), tile, k, s.tobytes()) for o in range(of)]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["cluster", "i", "j", "tile", "k", "s"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = stored(texts.mapInArrow(sets, "doc_id long, cid long, chk long, fp long, n long"))
    unique = not marked.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    found = marked.groupBy("cid", "chk").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("n").alias("n"))
    again = F.row_number().over(Window.partitionBy("cid").orderBy("chk"))  # a name for each class, even if 64 bits of two texts agree
    classes = stored(found.withColumn("k", F.when(again == 1, F.col("cid")).otherwise(F.xxhash64("cid", "chk"))))
    here = ["k", "cid", "chk", "least"]
    # fingerprints within the radius
    prints = stored(classes.groupBy("fp").agg(F.min("k").alias("first"), F.count("*").alias("n")))
    balls = stored(fingerprint_links(prints.select("fp"), radius, parts, kept))
    ends = [maybe_broadcast(prints.select(F.col("fp").alias(e), F.col("first").alias(x))) for e, x in (("u", "x"), ("v", "y"))]
    near = balls.join(ends[0], "u").join(ends[1], "v").select(F.col("x").alias("u"), F.col("y").alias("v"))
    equal = classes.select("k", "fp").join(maybe_broadcast(prints.filter("n > 1").select("fp", "first")), "fp").filter("k <> first").select(F.col("k").alias("u"), F.col("first").alias("v"))

    # classes of similar shingles whose fingerprints are further apart
    def with_texts(of: DataFrame) -> DataFrame:
        both = texts.join(maybe_broadcast(of, 500_000), F.col("doc_id").eqNullSafe(F.col("least"))).select("text", *(c for c in of.columns if c != "least"))
        return both if unique else both.mapInArrow(_right, both.schema)

    total = classes.agg(F.sum("n")).first()[0] or 0
    further = prefix_links(with_texts(classes.select(*here)).select("k", "text"), total, similarity, words)
    cluster = stored(connected_components(near.unionByName(equal).unionByName(further)).groupBy(F.col("node").alias("k")).agg(F.min("component").alias("cluster")))
    discard(balls, prints, further)
    sized = cluster.join(classes.select(*here, "n"), "k")
    sizes = sized.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    many = F.least(F.ceil(F.col("m") / SMALL), F.greatest(F.lit(FINE), F.ceil(F.col("m") / TILE_SETS)))
    sizes = stored(sizes.select("cluster", F.greatest(many, F.ceil(F.col("n") / TILE_SHINGLES), F.lit(1)).cast("int").alias("tiles")))
    wanted = stored(sized.drop("n").join(maybe_broadcast(sizes), "cluster").withColumn("tile", F.pmod(F.xxhash64("k"), F.col("tiles")).cast("int")))
    placed = with_texts(wanted).mapInArrow(tiles, "cluster long, i int, j int, tile int, k long, s binary")
    placed = placed.withColumn("key", F.xxhash64("cluster", "i", "j")).repartition("key").sortWithinPartitions("key", "cluster", "i", "j", "tile", "k")
    links = stored(placed.mapInArrow(_tile_links(similarity), "u long, v long"))
    nodes = connected_components(links)
    grouped = stored(classes.join(nodes, F.col("k") == F.col("node"), "left").select("cid", "chk", "least", F.coalesce("component", "k").alias("root")))
    named = stored(grouped.groupBy("root").agg(F.min("least").alias("keep_id")))
    lookup = stored(grouped.join(named, "root").select(F.col("cid").alias("c1"), F.col("chk").alias("c2"), "keep_id", "root"))
    discard(cluster, sizes, wanted, links, grouped, named)
    told = marked.join(maybe_broadcast(lookup, 500_000), (F.col("cid") == F.col("c1")) & (F.col("chk") == F.col("c2"))).select("doc_id", "cid", "chk", "keep_id", "root")
    return told, unique


def near_copies(docs: DataFrame, similarity: float = 0.8, words: int = 5, radius: int = 4, parts: int = 3, kept: int = 2) -> DataFrame:
    """docs (doc_id, text) -> doc_id, cid, chk, keep_id, root: which document stays of each group (root) of near copies.

    Texts of the same words in the same order are one class (cid and chk, 128 bits). Classes whose SimHash over the set of
    words is within the radius are one cluster; its links come from ball hashing. So are classes that share a shingle of
    their prefixes (prefix_links): every pair of at least `similarity` is in one cluster, however far its fingerprints are.
    Within a cluster classes link if the Jaccard similarity of their sets of `words`-word shingles is at least
    `similarity`: all of them are compared, tile by tile, and only a spanning forest of the links leaves a task. A
    tile is bounded, so a cluster of any size runs in bounded memory; a set of a cluster of n tiles is sent n times. keep_id
    is the smallest doc_id of the group, null if it has none. Null text: like empty; empty texts are copies of each other.
    Empty input: no rows.
    """
    return _groups_of(docs, similarity, words, radius, parts, kept)[0]


def without_near_copies(docs: DataFrame, similarity: float = 0.8, words: int = 5, radius: int = 4, parts: int = 3, kept: int = 2) -> DataFrame:
    """docs with one document of each group of near copies, columns unchanged: the one of the smallest doc_id. Of rows that repeat it with texts of the group one stays."""
    told, unique = _groups_of(docs, similarity, words, radius, parts, kept)
    told = stored(told)
    gone = told.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if unique:
        drop = stored(gone.select(F.col("doc_id").alias("__gone")))
        return docs.join(maybe_broadcast(drop, 500_000), F.col("doc_id").cast("long").eqNullSafe(F.col("__gone")), "left_anti")
    columns, types = docs.columns, dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, chk = _keyed(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cid), pa.array(chk)], names=[*columns, "__cid", "__chk"])

    drop = stored(gone.select(F.col("doc_id").alias("__gone"), F.col("cid").alias("__c"), F.col("chk").alias("__k")).distinct())
    me = F.col("doc_id").cast("long")
    marked = docs.mapInArrow(run, "".join(f"`{c}` {types[c]}, " for c in columns) + "__cid long, __chk long")
    left = marked.join(maybe_broadcast(drop, 500_000), me.eqNullSafe(F.col("__gone")) & (F.col("__cid") == F.col("__c")) & (F.col("__chk") == F.col("__k")), "left_anti")
    # several rows of the id that stays: of one text, or of texts of the same group
    stays = told.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    again = stored(stays.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("__again")))
    if again.limit(1).count():
        hit = me.eqNullSafe(F.col("__again"))
        roots = stays.select(F.col("doc_id").alias("__i"), F.col("cid").alias("__c"), F.col("chk").alias("__k"), F.col("root").alias("__r")).distinct()
        once = left.join(maybe_broadcast(again, 500_000), hit, "left_semi").join(roots, me.eqNullSafe(F.col("__i")) & (F.col("__cid") == F.col("__c")) & (F.col("__chk") == F.col("__k"))).dropDuplicates(["__i", "__r"])
        left = left.join(maybe_broadcast(again, 500_000), hit, "left_anti").select(*columns).unionByName(once.select(*columns))
    return left.select(*columns)


def simhash_dedup(docs: DataFrame, radius: int = 4, words: int = 4, parts: int = 3, kept: int = 2, key: str = "doc_id") -> DataFrame:
    """Every row of docs (doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id, kept.

    Words are runs of anything but ASCII white space, A-Z lower-cased; shingles of `words` words, repeats included;
    a text of fewer words is one shingle; null, empty and blank texts have fingerprint zero and link like any other.
    component_id is the smallest doc_id reachable over links of at most `radius` differing bits; documents of equal
    fingerprints are always linked. kept: doc_id = component_id. Rows that repeat a doc_id each get a row. A null
    doc_id is kept in its component but names it only if all its ids are null. Empty input: no rows.
    """
    marked = stored(fingerprints(docs, words, key))
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = connected_components(fingerprint_links(classes.select("fp"), radius, parts, kept))
    grouped = stored(classes.join(nodes, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root")))
    named = stored(grouped.groupBy("root").agg(F.min("least").alias("component_id")))
    lookup = stored(grouped.join(named, "root").select(F.col("fp").alias("f"), "component_id"))
    out = marked.join(lookup, F.col("fp") == F.col("f")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
    return out
