"""Mixing sources to target weights, with DataFrame operations only.

Documents are put in the order of a hash of their id and text. A source's target is a number of whole passes and a rest; the
rest is the part of its documents below a hash threshold. The thresholds come from nested histograms: words by
source and hash bucket, then only the bucket that holds the boundary in finer buckets, until single hashes remain.
Nothing is sorted, and each level moves at most one row per source and bucket and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.workers import stored
from tidegraph.llm.common import WORD, maybe_broadcast

#: Bits of the hash that each level looks at; together they are the whole hash.
LEVELS = (12, 16, 32)
BITS = sum(LEVELS)


def word_count(text: Column) -> Column:
    """Words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_hash(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """60 bits of MD5 over seed, id and text, as a long: the same everywhere and in other engines. Only rows alike in both share it."""
    whole = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, BITS // 4), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, size) rows -> source, source_size, target.

    Weights repeat over the sources by code point, null last. `share` of all words is shared by weight; a target
    stops at `most` times its source's size and the excess is shared again among the others. That ends at one level:
    target = least(most * size, level * weight), found from running sums over sources in the order of the level at
    which each stops. One row per source, so the windows are over a table as long as the list of sources.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int"))
    stop = Window.orderBy("stops", F.col("source").asc_nulls_last())
    before = stop.rowsBetween(Window.unboundedPreceding, -1)
    rest = stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(0))
    ranked = (
        by.withColumn("weight", weight)
        .withColumn("stops", most * F.col("source_size") / F.col("weight"))
        .withColumn("level", (share * F.sum("source_size").over(everything) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("stops"), F.struct("stops", F.col("source").isNull().alias("n"), "source", "level"))).over(everything)["level"])
    )
    return ranked.select("source", "source_size", F.least(most * F.col("source_size"), F.coalesce("level", F.lit(float("inf"))) * F.col("weight")).alias("target"))


def sized_rows(docs: DataFrame, seed: str = "mix", key: str = "doc_id") -> DataFrame:
    """docs -> doc_id, source, size, h: all that a mix is planned from."""
    return docs.select(F.col(key).alias("doc_id"), "source", word_count(F.col("text")).alias("size"), order_hash(F.col(key), F.col("text"), seed).alias("h"))


def plan_mix(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Stored sized_rows -> source, source_size, target, passes, cut, tie, ties: all of a source is taken `passes` times, and once more what hashes
    below `cut`, and of several rows that hash to `tie` the first `ties`."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = stored(source_targets(sized, weights, share, most).withColumn("passes", whole.cast("int")).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    edge = targets.select("source", F.lit(0).cast("long").alias("low"), F.col("rest").alias("left"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("rows"))
    fine = BITS
    for bits in LEVELS:
        coarse, fine = fine, fine - bits
        inside = sized.alias("d").join(maybe_broadcast(edge).alias("e"), F.expr("d.source <=> e.source"))
        if coarse < BITS:
            inside = inside.filter(F.shiftright("h", coarse) == F.shiftright("low", coarse))
        cells = inside.groupBy(F.col("d.source").alias("source"), F.shiftright("h", fine).alias("cell")).agg(F.sum("size").alias("words"), F.first("left").alias("left"), F.count("*").alias("rows"))
        up_to = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # the boundary cell is the first that the rest doesn't cover whole; only a source without words has none
        last = cells.withColumn("upto", F.sum("words").over(up_to)).groupBy("source").agg(F.min(F.when(F.col("upto") > F.col("left"), F.struct("cell", "words", "upto", "left", "rows"))).alias("b"))
        found = last.filter("b is not null").select("source", F.shiftleft("b.cell", fine).alias("low"), (F.col("b.left") - (F.col("b.upto") - F.col("b.words"))).alias("left"), F.col("b.words").alias("words"), F.col("b.rows").alias("rows"))
        edge = stored(edge.alias("o").join(maybe_broadcast(stored(found)).alias("n"), F.expr("o.source <=> n.source"), "left").select("o.source", F.coalesce("n.low", "o.low").alias("low"), F.coalesce("n.left", "o.left").alias("left"), F.coalesce("n.words", F.lit(0)).alias("words"), F.coalesce("n.rows", F.lit(0)).alias("rows")))
    # rows of the last hash are alike; each is taken if its middle lies within the rest
    fits = F.when(F.col("words") > 0, F.least(F.col("rows"), F.floor(F.col("left") * F.col("rows") / F.col("words") + 0.5))).otherwise(0).cast("long")
    some = (F.col("fits") > 0) & (F.col("fits") < F.col("rows"))
    cut = edge.withColumn("fits", fits).select("source", F.when((F.col("fits") == F.col("rows")) & (F.col("rows") > 0), F.col("low") + 1).otherwise(F.col("low")).alias("cut"), F.when(some, F.col("low")).alias("tie"), F.when(some, F.col("fits")).alias("ties"))
    return stored(targets.alias("t").join(maybe_broadcast(cut).alias("c"), F.expr("t.source <=> c.source")).select("t.source", "source_size", "target", "passes", "cut", "tie", "ties"))


def taken(rows: DataFrame, plan: DataFrame, source: str = "source", h: str = "h", before: str = "__") -> DataFrame:
    """rows with the plan's columns (their names after `before`) and `copies`: how often each is taken.

    Rows alike at a boundary are numbered to say which of them are taken: by their task, whose counts are added up, and
    their place in it, so that any number of copies is dealt with where it lies.
    """
    plan = stored(plan.select(*(F.col(c).alias(before + c) for c in plan.columns)))
    size, passes, cut, tie, ties = (F.col(before + c) for c in ("source_size", "passes", "cut", "tie", "ties"))
    joined = rows.join(maybe_broadcast(plan), F.col(source).eqNullSafe(F.col(before + "source"))).withColumn(before + "copies", F.when(size > 0, passes + (F.col(h) < cut).cast("int")).otherwise(0).cast("int"))
    if not plan.filter(tie.isNotNull()).limit(1).count():
        return joined
    tied = F.coalesce(F.col(h) == tie, F.lit(False))
    alike = stored(joined.filter(tied).withColumn(before + "at", F.monotonically_increasing_id()))
    alike = alike.withColumn(before + "task", F.shiftright(before + "at", 33))
    counts = alike.groupBy(before + "source", before + "task").agg(F.count("*").alias(before + "n"))
    up = Window.partitionBy(before + "source").orderBy(before + "task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(before + "source").alias(before + "s"), F.col(before + "task").alias(before + "t"), F.coalesce(F.sum(before + "n").over(up), F.lit(0)).alias(before + "first"))
    place = F.row_number().over(Window.partitionBy(before + "source", before + "task").orderBy(before + "at"))
    placed = alike.withColumn(before + "place", place).join(maybe_broadcast(counts), F.col(before + "source").eqNullSafe(F.col(before + "s")) & (F.col(before + "task") == F.col(before + "t")))
    more = (F.col(before + "first") + F.col(before + "place") <= ties).cast("int")
    placed = placed.withColumn(before + "copies", (F.col(before + "copies") + more).cast("int"))
    return joined.filter(~tied).unionByName(placed.select(*joined.columns))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", key: str = "doc_id") -> DataFrame:
    """Every row of docs (doc_id, text, source) -> doc_id, size, source_size, target, taken, copies, source.

    copies is how often the mix takes a document, never over `most` rounded down; taken = copies * size. Of each
    source, the whole passes are taken by all, and the rest by the documents of the least hashes whose middle lies
    within it, so a source misses its target by at most half of its boundary document. The order depends on id, text and
    seed alone: reruns agree. Rows alike in id and text are taken one by one: which of them doesn't matter. Null text:
    size 0. Null source: a source of its own, last. Null ids are ordered by their text. Empty input: no rows. A source
    without words has target 0 and its documents are taken 0 times. Other columns don't matter. Sources are sorted in one
    task: one short row of each.
    """
    sized = stored(sized_rows(docs, seed, key))
    out = taken(sized, plan_mix(sized, weights, share, most))
    return out.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("size")).cast("long").alias("taken"), F.col("__copies").alias("copies"), "source")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """docs as the mix takes them: each row as often as its copies, columns unchanged. The texts are joined to one row per source, and not shuffled where that list is short."""
    plan = plan_mix(stored(sized_rows(docs, seed)), weights, share, most)
    rows = taken(docs.withColumn("__h", order_hash(F.col("doc_id"), F.col("text"), seed)), plan, h="__h")
    return rows.filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(*docs.columns)
