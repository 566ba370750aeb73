"""What several operators of this subpackage share: tables in the shared folder, batches, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.workers import discard, stored

#: Words of every contract: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Tables up to this many rows may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows, by counting no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted size allows it, else as it is (a shuffle join, which AQE can split)."""
    return F.broadcast(df) if small_enough(df, rows) else df


def slices(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """batch, in pieces whose texts hold about `most` bytes; one longer text is a piece of its own."""
    sizes = np.fromiter((x or 0 for x in pc.binary_length(batch.column(column)).to_pylist()), np.int64, batch.num_rows)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


class Forest:
    """Union-find over a few integers of one batch, the smallest member as root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, self.root(x)) for x in self.up]


def spread(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A forest of many links at once, (node, least node it hangs together with): repeated least-label steps on arrays. a, b: places in nodes."""
    some, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(some))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            return [(p, q) for p, q in zip(nodes[some].tolist(), nodes[some[label]].tolist(), strict=True) if p != q]
        label = new


def _star(pairs: DataFrame, large: bool, made: list[DataFrame]) -> DataFrame:
    """One star step on edges (u > v). Large: higher neighbours link to the least of a node's neighbourhood. Small: a node and its lower neighbours do."""
    if large:
        sides = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = pairs.select("u", "v")
    least = stored(sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")))
    made.append(least)
    joined = sides.join(least, F.col("u") == F.col("k"))
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Edges (u, v) of longs -> (node, component): the smallest node reachable. Nodes without edges don't appear.

    Alternating large and small stars: rounds grow with the logarithm of the longest path. Each round is a table in
    the shared folder; joins look up one row per node, so a node with very many edges is split by AQE's skew join.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    mark = None
    for _ in range(rounds):
        before, made = now, []
        now = stored(_star(_star(now, True, made), False, made))
        discard(before, *made)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    )
