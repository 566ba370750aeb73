"""Near-duplicate embeddings: exact cosine links within labels, by tiles in the order of principal components.

Exact copies are folded first. Vectors are cut into cells by their leading three principal coordinates: linked unit
vectors lie within sqrt(2 - 2t) of each other in every projection, so only cells that touch are compared, and a
vector goes only to cells whose box is that near. Cells are split into blocks. A block's own vectors stay in one task,
and those of the blocks that it meets pass by; of two blocks only one travels. A tile adds up products over the
leading components and drops a pair once the rest, bounded by the norms of both suffixes, can't reach the threshold;
what is left is verified on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.workers import discard, ready, stored
from tidegraph.llm.common import connected_components, maybe_broadcast, spread

#: Leading components that make cells.
LEAD = 3
#: Vectors of a block, while that makes at most FINE blocks of a cell; larger cells have larger blocks, of at most so many bytes.
BLOCK, FINE, BYTES = 4096, 8, 64 << 20
#: Components are learned for so many lengths of vectors, the most frequent ones up to LONGEST; others are compared without.
LENGTHS, LONGEST = 16, 2048
#: Vectors compared at a time, and components added at a time.
SIDE, STEP = 1024, 16


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of norm one, in double precision; scaled first, so that squares neither overflow nor vanish."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


class Turned:
    """Unit vectors, turned to their components, with the norms of what follows each step of components."""

    def __init__(self, u: np.ndarray, turn: np.ndarray | None) -> None:
        self.u, self.x = u, u if turn is None else u @ turn
        cuts = range(STEP, self.x.shape[1], STEP)
        squares = np.add.reduceat(self.x * self.x, range(0, self.x.shape[1], STEP), axis=1)
        self.rest = np.sqrt(np.maximum(0, np.cumsum(squares[:, ::-1], axis=1)[:, ::-1][:, 1:])) if cuts else np.zeros((len(u), 0))


def near_pairs(a: Turned, b: Turned, threshold: float, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all rows of a and b whose cosine reaches the threshold; i < j if both are the same."""
    slack, n, found = 1e-9, a.x.shape[1], []
    for i0 in range(0, len(a.x), SIDE):
        for j0 in range(i0 if same else 0, len(b.x), SIDE):
            got = a.x[i0 : i0 + SIDE, :STEP] @ b.x[j0 : j0 + SIDE, :STEP].T
            if n > STEP:
                i, j = np.nonzero(got + np.outer(a.rest[i0 : i0 + SIDE, 0], b.rest[j0 : j0 + SIDE, 0]) >= threshold - slack)
            else:
                i, j = np.nonzero(got >= threshold - slack)
            part = got[i, j]
            i, j = i + i0, j + j0
            if same:
                keep = i < j
                i, j, part = i[keep], j[keep], part[keep]
            for k, at in enumerate(range(STEP, n, STEP)):
                if not len(i):
                    break
                part = part + np.einsum("ij,ij->i", a.x[i, at : at + STEP], b.x[j, at : at + STEP])
                bound = a.rest[i, k + 1] * b.rest[j, k + 1] if at + STEP < n else 0.0
                keep = part + bound >= threshold - slack
                i, j, part = i[keep], j[keep], part[keep]
            for at in range(0, len(i), 1 << 16):
                x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                exact = np.einsum("ij,ij->i", a.u[x], b.u[y]) >= threshold
                found.append((x[exact], y[exact]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def rows_of(v: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(v.to_pylist()), np.float64).reshape(-1, dim)


def components_of(classes: DataFrame, dims: list[int]) -> dict[int, np.ndarray]:
    """Principal components of all unit vectors of each of these lengths: sums of products from every partition, added by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {d: np.zeros((d, d)) for d in dims}
        for batch in batches:
            dim = batch.column("dim").to_numpy(zero_copy_only=False)
            for d in np.unique(dim).tolist():
                u = unit(rows_of(batch.column("v").filter(pa.array(dim == d)), d))
                total[d] += u.T @ u
        for d, t in total.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(t[i, j])], names=["d", "i", "j", "s"])

    if not dims:
        return {}
    sums = classes.filter(F.col("dim").isin(dims)).select("dim", "v").mapInArrow(run, "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    out = {}
    for d, part in sums.groupby("d"):
        m = np.zeros((d, d))
        m[part["i"], part["j"]] = m[part["j"], part["i"]] = part["s"]
        out[int(d)] = np.linalg.eigh(m)[1][:, ::-1].copy()
    return out


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays to bytes of doubles; vectors that can't link go."""
    for batch in batches:
        column = batch.column("embedding")
        sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
        flat = np.asarray(pc.fill_null(column.flatten().cast(pa.float64()), np.nan))
        ends = np.cumsum(sizes)
        some = np.flatnonzero(sizes)
        good = np.zeros(len(sizes), bool)
        if len(some):
            first = (ends - sizes)[some]
            good[some] = np.logical_and.reduceat(np.isfinite(flat), first) & np.logical_or.reduceat(flat != 0, first)
        raw = flat.tobytes()
        made = [raw[8 * (e - n) : 8 * e] for e, n, g in zip(ends.tolist(), sizes.tolist(), good.tolist(), strict=True) if g]
        keep = pa.array(good)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(keep), batch.column("label").filter(keep), pa.array(made, pa.binary())], names=["vec_id", "label", "v"])


def embedding_dedup(table: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Every row of table (vec_id, embedding, label) -> vec_id, n_links, component_id, kept.

    Rows link when labels are equal and not null and the cosine in double precision is at least the threshold.
    n_links: other rows linked directly, copies included; component_id: the smallest vec_id reachable, itself
    included; kept: vec_id = component_id. Vectors that are null, empty, zero or hold null or non-finite values, and
    those of different lengths, link with nothing. Rows that repeat a vec_id are vectors of their own. No rows in, no
    rows out. Threshold: over 0 up to 1.
    """
    ready(table.sparkSession)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = rows.filter("label is not null and embedding is not null").mapInArrow(_prepare, "vec_id long, label string, v binary")
    good = stored(good.select("vec_id", "label", "v", F.xxhash64("label", "v").alias("cid"), F.xxhash64("v", "label").alias("chk")))
    found = good.groupBy("cid", "chk").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count("*").alias("n"))
    again = F.row_number().over(Window.partitionBy("cid").orderBy("chk"))  # a name for each class, even if 64 bits of two vectors agree
    classes = stored(found.withColumn("dim", F.expr("cast(length(v) / 8 as int)")).withColumn("k", F.when(again == 1, F.col("cid")).otherwise(F.xxhash64("cid", "chk"))))
    common = classes.filter(F.col("dim") <= LONGEST).groupBy("dim").count().filter("count > 1").orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()
    links = stored(_links(classes, components_of(classes, [r["dim"] for r in common]), threshold))
    degree = links.filter("b is null").groupBy(F.col("a").alias("c")).agg(F.sum("w").alias("w"))
    nodes = connected_components(links.filter("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = stored(classes.select("k", "cid", "chk", "least", "n").join(nodes, F.col("k") == F.col("node"), "left").select("k", "cid", "chk", "least", "n", F.coalesce("component", "k").alias("root")))
    named = stored(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    told = placed.join(named, "root").join(degree, F.col("k") == F.col("c"), "left")
    told = stored(told.select(F.col("cid").alias("c1"), F.col("chk").alias("c2"), "component_id", (F.col("n") - 1 + F.coalesce("w", F.lit(0))).alias("n_links")))
    discard(classes, links, placed, named)
    linked = good.select("vec_id", "cid", "chk").join(told, (F.col("cid") == F.col("c1")) & (F.col("chk") == F.col("c2"))).select("vec_id", "n_links", "component_id")
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    alone = rows.filter(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _cells(turns: dict[int, np.ndarray], reach: float):
    """Each vector: its cell, and the touching cells whose box is within reach, itself first. Labels that aren't wide, and lengths without components, are one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, wide = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "wide"))
            cell, other = np.full(len(dim), "", object), np.empty(len(dim), object)
            other[:] = [[""]] * len(dim)
            for d in np.unique(dim).tolist():
                if d not in turns:
                    continue
                at, lead = np.flatnonzero((dim == d) & wide), min(LEAD, d)
                if not len(at):
                    continue
                steps = np.stack(np.meshgrid(*[[0, -1, 1]] * lead, indexing="ij"), axis=-1).reshape(-1, lead)
                x = unit(rows_of(batch.column("v").take(pa.array(at)), d)) @ turns[d][:, :lead] / reach
                own = np.floor(x).astype(np.int64)
                inside = x - own
                gap = np.where(steps[None] < 0, inside[:, None], np.where(steps[None] > 0, 1 - inside[:, None], 0.0))
                near = (gap * gap).sum(axis=2) <= 1.0 + 1e-9
                name = lambda c: ",".join(map(str, c))
                cell[at] = [name(c) for c in own.tolist()]
                for k, i in enumerate(at.tolist()):
                    other[i] = [name(c) for c in (own[k] + steps[near[k]]).tolist()]
            columns = [batch.column(c) for c in ("k", "label", "dim", "v", "n")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cell.tolist(), pa.string()), pa.array(other.tolist(), pa.list_(pa.string()))], names=["k", "label", "dim", "v", "n", "cell", "near"])

    return run


def _tiles(turns: dict[int, np.ndarray], threshold: float):
    """Sorted rows (label, dim, block, visits, k, v, n) -> rows (a, null, w): rows that a class links to, and edges (a, b, 0)."""
    names = ("label", "dim", "block", "visits")

    def told(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """(ids, weights, place, place) of linked pairs -> rows."""
        for ids, n, x, y in pairs:
            degree = np.bincount(x, weights=n[y], minlength=len(ids)) + np.bincount(y, weights=n[x], minlength=len(ids))
            some, edges = np.flatnonzero(degree), spread(ids, x, y) if len(x) else []
            a = np.concatenate([ids[some], np.array([p for p, _ in edges], np.int64)])
            b = [None] * len(some) + [q for _, q in edges]
            w = np.concatenate([degree[some].astype(np.int64), np.zeros(len(edges), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64()), pa.array(w)], names=["a", "b", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, ids, weights = None, [], [], []
        block: Turned | None = None

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal block
            block = Turned(unit(np.concatenate(own)), turns.get(key[1]))
            i, j = near_pairs(block, block, threshold, True)
            yield from told([(np.concatenate(ids), np.concatenate(weights), i, j)])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.array(batch.column(c).to_pylist(), object) for c in names]
            edge = np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0)))).tolist()
            for a, b in zip(edge, [*edge[1:], batch.num_rows], strict=True):
                here, part = tuple(c[a] for c in columns[:3]), batch.slice(a, b - a)
                if here != key:
                    if own and block is None:
                        yield from closed()
                    key, own, ids, weights, block = here, [], [], [], None
                v, k, n = rows_of(part.column("v"), here[1]), part.column("k").to_numpy(), part.column("n").to_numpy()
                if not columns[3][a]:
                    own.append(v)
                    ids.append(k)
                    weights.append(n)
                    continue
                if block is None:
                    yield from closed()
                i, j = near_pairs(block, Turned(unit(v), turns.get(here[1])), threshold)
                if len(i):
                    mine, back = np.unique(i, return_inverse=True)
                    yield from told([(np.concatenate([np.concatenate(ids)[mine], k]), np.concatenate([np.concatenate(weights)[mine], n]), back, j + len(mine))])
        if own and block is None:
            yield from closed()

    return run


def _links(classes: DataFrame, turns: dict[int, np.ndarray], threshold: float, only_sent: bool = False) -> DataFrame:
    """Classes -> rows (a, b, w): (class, null, rows it links to in a tile) and edges (class, class, 0).

    A vector is sent to its own block and to half of those that its block meets. Blocks grow with their cell, so that up
    to FINE * BYTES of vectors in a cell cost a fixed number of copies of each; labels of a few blocks are one cell.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    counts = classes.groupBy(F.col("label").alias("l0"), F.col("dim").alias("d0")).agg((F.count("*") > BLOCK * FINE).alias("wide"))
    sized = classes.join(maybe_broadcast(counts), (F.col("label") == F.col("l0")) & (F.col("dim") == F.col("d0")))
    placed = stored(sized.select("k", "label", "dim", "v", "n", "wide").mapInArrow(_cells(turns, reach), "k long, label string, dim int, v binary, n long, cell string, near array<string>"))
    most = F.greatest(F.lit(1), F.floor(F.lit(BYTES) / (8 * F.col("dim"))))
    few = F.ceil(F.count("*") / F.least(F.lit(BLOCK), most))
    sizes = stored(placed.groupBy("label", "dim", "cell").agg(F.when(few <= FINE, few).otherwise(F.greatest(F.lit(FINE), F.ceil(F.count("*") / most))).cast("int").alias("blocks")))
    mine = maybe_broadcast(sizes.select(F.col("label").alias("l1"), F.col("dim").alias("d1"), F.col("cell").alias("c1"), F.col("blocks").alias("own_blocks")))
    yours = maybe_broadcast(sizes.select(F.col("label").alias("l2"), F.col("dim").alias("d2"), F.col("cell").alias("c2"), F.col("blocks").alias("other_blocks")))
    met = (
        placed.join(mine, (F.col("label") == F.col("l1")) & (F.col("dim") == F.col("d1")) & (F.col("cell") == F.col("c1")))
        .withColumn("me", F.concat_ws("/", "cell", F.expr("cast(pmod(xxhash64(k, 7), own_blocks) as string)")))
        .withColumn("other", F.explode("near"))
        .join(yours, (F.col("label") == F.col("l2")) & (F.col("dim") == F.col("d2")) & (F.col("other") == F.col("c2")))
        .withColumn("block", F.explode(F.transform(F.sequence(F.lit(0), F.col("other_blocks") - 1), lambda j: F.concat_ws("/", "other", j.cast("string")))))
    )
    # of two blocks that meet, a hash says which one travels
    first = F.xxhash64(F.least("me", "block"), F.greatest("me", "block")).bitwiseAND(F.lit(1)) == 0
    visits = F.col("me") != F.col("block")
    sent = met.filter(~visits | (F.when(first, F.least("me", "block")).otherwise(F.greatest("me", "block")) == F.col("block")))
    sent = sent.select("label", "dim", "block", visits.alias("visits"), "k", "v", "n")
    if only_sent:
        return sent
    sent = sent.repartition("label", "dim", "block").sortWithinPartitions("label", "dim", "block", "visits")
    return sent.mapInArrow(_tiles(turns, threshold), "a long, b long, w long")
