"""Embedded text: exact filtered top-k, two-step retrieval, matching, clustering, canonical labels, tool selection, recall."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.scalars import NAMESPACE_OID, cosine, uuid5
from tidegraph.functions.workers import ready

#: Bytes of query vectors that go out with one scan of the points, and queries compared at a time.
QUERY_BYTES, QUERY_BLOCK = 64 << 20, 1024


def search(points: DataFrame, query: Sequence[float], limit: int = 10, threshold: float | None = 0.7, **equal: object) -> DataFrame:
    """Points that equal the conditions, by cosine to a query, best first: filters come before scores. Exact."""
    rows = points
    for column, value in equal.items():
        rows = rows.filter(F.col(column) == F.lit(value))
    score = cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query)))
    scored = rows.withColumn("score", score).filter("score is not null")
    if threshold is not None:
        scored = scored.filter(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), "id").limit(limit)


def unit_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a column of lists, and which of its rows are vectors of this length with a norm."""
    good = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), width), False))
    out = np.zeros((len(column), width))
    if good.any():
        rows = np.asarray(pc.fill_null(column.filter(pa.array(good)).flatten().cast(pa.float64()), np.nan)).reshape(-1, width)
        norm = np.sqrt((rows * rows).sum(axis=1))
        fine = np.isfinite(norm) & (norm > 0)
        out[good] = np.where(fine[:, None], rows / np.where(fine, norm, 1)[:, None], 0)
        good[good] = fine
    return out, good


def batch_search(points: DataFrame, queries: DataFrame, k: int = 5, threshold: float | None = None, sections: bool = True, skip_self: bool = False) -> DataFrame:
    """queries (qid, embedding, section) against points (id, embedding, section) -> qid, id, score, rank.

    The best k points of each query, of its own section if `sections`; a query meets the points of its own length. As many
    queries as fit in QUERY_BYTES go out with one scan of the points; a task keeps the best k of each query, and only those
    are shuffled.
    """
    spark = points.sparkSession
    ready(spark)
    asked = queries.select("qid", "embedding", "section")
    about = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    scans = max(1, -(-(about["n"] * max(1, about["width"] or 0) * 8) // QUERY_BYTES))
    types = dict(queries.dtypes) | dict(points.dtypes)
    out = None
    for b in range(scans):
        part = (asked if scans == 1 else asked.filter(F.pmod(F.xxhash64("qid"), F.lit(scans)) == b)).toArrow()
        sizes = pc.fill_null(pc.list_value_length(part.column("embedding").combine_chunks()), 0).to_numpy()
        sent, names = {}, {}
        for width in np.unique(sizes[sizes > 0]).tolist():
            rows = part.filter(pa.array(sizes == width)).combine_chunks()
            unit, good = unit_rows(rows.column("embedding").combine_chunks(), width)
            qid = np.array(rows.column("qid").to_pylist())[good]
            section = np.array([names.setdefault(x, len(names)) for x in rows.column("section").to_pylist()])[good]
            sent[width] = (qid, unit[good], section)
        if not sent:
            continue
        shared = spark.sparkContext.broadcast((names, sent))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held: list[pd.DataFrame] = []

            def best() -> pd.DataFrame:
                rows = pd.concat(held).sort_values(["qid", "score", "id"], ascending=[True, False, True], kind="stable")
                return rows.groupby("qid", sort=False).head(k)

            for batch in batches:
                if not batch.num_rows:
                    continue
                known, asked_for = shared.value
                ids, own = np.array(batch.column("id").to_pylist()), np.array([known.get(x, -1) for x in batch.column("section").to_pylist()])
                for width, (qid, every, section) in asked_for.items():
                    p, fine = unit_rows(batch.column("embedding"), width)
                    if not fine.any():
                        continue
                    p, here, named = p[fine], ids[fine], own[fine]
                    for at in range(0, len(qid), QUERY_BLOCK):
                        q = slice(at, at + QUERY_BLOCK)
                        score = np.round(every[q] @ p.T, 12)
                        if sections:
                            score[section[q][:, None] != named[None, :]] = -np.inf
                        if skip_self:
                            score[qid[q][:, None] == here[None, :]] = -np.inf
                        if threshold is not None:
                            score[score < threshold] = -np.inf
                        if score.shape[1] > k:  # all that reach the k-th best score, so that ties are decided over all batches
                            score[score < np.partition(score, -k, axis=1)[:, -k][:, None]] = -np.inf
                        i, j = np.nonzero(score > -np.inf)
                        if len(i):
                            held.append(pd.DataFrame({"qid": qid[q][i], "id": here[j], "score": score[i, j]}))
                if len(held) > 64:
                    held = [best()]
            if held:
                yield pa.RecordBatch.from_pandas(best(), preserve_index=False)

        found = points.select("id", "embedding", "section").mapInArrow(run, f"qid {types['qid']}, id {types['id']}, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"qid {types['qid']}, id {types['id']}, score double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def two_step(hits: DataFrame, summaries: DataFrame) -> DataFrame:
    """hits (qid, graph_id, score) of section queries -> the best score of each graph, with its summary, best first."""
    best = hits.groupBy("qid", "graph_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("graph_id").orderBy("id")
    first = summaries.filter("section = 'Summary'").withColumn("n", F.row_number().over(w)).filter("n = 1").select("graph_id", F.col("content").alias("summary"))
    return best.join(first, "graph_id").orderBy(F.desc("score"), "graph_id")


# fixed values: how a section's query begins
SECTION_PREFIXES = {"Error": "Error: ", "Task_Feature": "Task features: ", "Environment": "Environment: ", "Component": "Component: "}


def section_queries(clues: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """clues (task_id, clue_type, clue), tasks (task_id, description) -> task_id, section, query.

    One query of all clues of a type, joined by commas behind its prefix; every context is a query of its own, and a task's
    description is one of the Error section.
    """
    prefix = F.create_map(*[F.lit(x) for pair in SECTION_PREFIXES.items() for x in pair])
    told = clues.filter(F.col("clue_type").isin(*SECTION_PREFIXES)).groupBy("task_id", "clue_type").agg(F.array_join(F.array_sort(F.collect_set("clue")), ", ").alias("text"))
    out = told.select("task_id", F.col("clue_type").alias("section"), F.concat(prefix[F.col("clue_type")], "text").alias("query"))
    out = out.unionByName(clues.filter("clue_type = 'Task_Context'").select("task_id", F.col("clue_type").alias("section"), F.col("clue").alias("query")))
    if tasks is not None:
        out = out.unionByName(tasks.filter(F.col("description") != "").select("task_id", F.lit("Error").alias("section"), F.col("description").alias("query")))
    return out


def best_match(items: DataFrame, library: DataFrame, threshold: float) -> DataFrame:
    """items (id, embedding) -> id, name, score of the best library entry that reaches the threshold; ties by name."""
    return batch_search(library.withColumn("section", F.lit("")), items.select(F.col("id").alias("qid"), "embedding", F.lit("").alias("section")), 1, threshold).select(F.col("qid").alias("item"), "id", "score")


def _usual(column: pa.Array) -> int:
    """The most frequent length of a column's lists."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return int(np.bincount(sizes[sizes > 0], minlength=1).argmax())


def greedy_clusters(items: DataFrame, threshold: float, key: str = "section") -> DataFrame:
    """items (id, embedding, key), in the order of id within a key -> key, id, opener.

    The first item that is in no cluster opens one and takes every later free item at least so similar to it. Order
    decides, so a key's openers are found in one group; items meet the openers alone, never each other.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        column = pa.array(group["embedding"].tolist(), pa.list_(pa.float64()))
        unit, good = unit_rows(column, _usual(column))
        opener = np.full(len(group), -1)
        for i in range(len(group)):
            if opener[i] < 0:
                opener[i] = i
                if good[i]:
                    rest = np.flatnonzero((opener[i + 1 :] < 0) & good[i + 1 :]) + i + 1
                    opener[rest[unit[rest] @ unit[i] >= threshold]] = i
        return pd.DataFrame({key: group[key], "id": group["id"], "opener": group["id"].to_numpy()[opener]})

    ready(items.sparkSession)
    types = dict(items.dtypes)
    return items.select(key, "id", "embedding").groupBy(key).applyInPandas(run, f"{key} {types[key]}, id {types['id']}, opener {types['id']}")


def canonical_id(kind: Column, label: Column) -> Column:
    return uuid5(F.concat_ws("::", F.lit("canonical"), kind, label), NAMESPACE_OID)


def point_id(*parts: Column) -> Column:
    return uuid5(F.concat_ws(":", *parts))


def canonicalise(labels: DataFrame, embed: Callable[[str], Sequence[float]], threshold: float = 0.82, validate: Callable[[str, str], bool] | None = None) -> DataFrame:
    """labels (kind, seq, raw, label) -> kind, seq, raw, canonical, score, is_new.

    In the order of seq, a label takes the best canonical label of its kind that is at least so similar (and that
    `validate` accepts), or else becomes one. Each decision depends on those before it, so a kind is one group of
    its distinct labels; repeats are joined back.
    """
    first = labels.groupBy("kind", "label").agg(F.min("seq").alias("first"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        names: list[str] = []
        units: list[np.ndarray] = []
        rows = []
        for kind, label, at in group.sort_values(["first", "label"])[["kind", "label", "first"]].itertuples(index=False):
            v = np.asarray(embed(label), float)
            v = v / max(float(np.linalg.norm(v)), 1e-12)
            score = np.stack(units) @ v if units else np.zeros(0)
            if len(score) and score.max() >= threshold and (validate is None or validate(label, names[int(score.argmax())])):
                rows.append((kind, label, names[int(score.argmax())], float(score.max()), False, at))
            else:
                names.append(label)
                units.append(v)
                rows.append((kind, label, label, 0.0, True, at))
        return pd.DataFrame(rows, columns=["kind", "label", "canonical", "score", "new", "first"])

    ready(labels.sparkSession)
    told = first.groupBy("kind").applyInPandas(run, "kind string, label string, canonical string, score double, new boolean, first long")
    return labels.join(told, ["kind", "label"]).select("kind", "seq", "raw", "label", "canonical", "score", (F.col("new") & (F.col("seq") == F.col("first"))).alias("is_new"))


def coverage(errors: DataFrame, database: DataFrame, library: DataFrame, threshold: float = 0.85) -> DataFrame:
    """errors (id, embedding) -> id, tier: covered by the database's symptoms, matched in the library, or new."""
    hit = best_match(errors, database, threshold).select(F.col("item").alias("id"), F.lit(True).alias("c"))
    also = best_match(errors, library, threshold).select(F.col("item").alias("id"), F.lit(True).alias("m"))
    return errors.select("id").join(hit, "id", "left").join(also, "id", "left").select("id", F.when(F.col("c"), "covered").when(F.col("m"), "matched").otherwise("new").alias("tier"))


def merge_sources(first: DataFrame, second: DataFrame, reserved: int) -> DataFrame:
    """(key, name, pos) lists -> one list: first and second in turn while second has reserved places, then the rest of both; repeats keep the earliest."""
    a = first.select("key", "name", F.when(F.col("pos") < reserved, F.col("pos") * 2).otherwise(F.col("pos") + reserved).cast("double").alias("place"))
    b = second.select("key", "name", F.when(F.col("pos") < reserved, F.col("pos") * 2 + 1).otherwise(F.col("pos") + 1e9).cast("double").alias("place"))
    earliest = a.unionByName(b).groupBy("key", "name").agg(F.min("place").alias("place"))
    return earliest.select("key", "name", (F.row_number().over(Window.partitionBy("key").orderBy("place", "name")) - 1).alias("pos"))


def pack(tools: DataFrame, budget: int, cap: int = 25) -> DataFrame:
    """tools (key, name, pos, full, compact: token costs) -> key, name, pos, tier.

    Full descriptions for the first tools until one doesn't fit or the cap is met (the first always fits); of the rest, in
    order, compact ones where they still fit.
    """
    order = Window.partitionBy("key").orderBy("pos")
    sums = tools.withColumn("sum", F.sum("full").over(order)).withColumn("at", F.row_number().over(order))
    misfit = F.max(((F.col("sum") > budget) & (F.col("at") > 1) | (F.col("at") > cap)).cast("int")).over(order)
    tiered = sums.withColumn("rest", misfit == 1)
    spent = F.coalesce(F.max(F.when(~F.col("rest"), F.col("sum"))), F.lit(0))
    later = F.array_sort(F.collect_list(F.when(F.col("rest"), F.struct("pos", "name", "compact"))))
    start = F.struct(spent.cast("long").alias("used"), F.array().cast("array<string>").alias("names"))
    step = lambda s, x: F.when(s["used"] + x["compact"] <= budget, F.struct((s["used"] + x["compact"]).cast("long").alias("used"), F.concat(s["names"], F.array(x["name"])).alias("names"))).otherwise(s)
    chosen = tiered.groupBy("key").agg(start.alias("s"), later.alias("l")).select("key", F.aggregate("l", F.col("s"), step)["names"].alias("compact_names"))
    return tiered.join(chosen, "key").withColumn("tier", F.when(~F.col("rest"), "full").when(F.array_contains("compact_names", F.col("name")), "compact")).filter("tier is not null").select("key", "name", "pos", "tier")


def changed(new: DataFrame, stored: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """Rows of new whose hash over the columns differs from the stored one (key, hash), or is not there."""
    h = F.sha2(F.concat_ws("\x1f", *(F.coalesce(c, F.lit("")) for c in columns)), 256)
    return new.withColumn("hash", h).join(stored.select(key, F.col("hash").alias("__old")), key, "left").filter(~F.col("hash").eqNullSafe(F.col("__old"))).drop("__old")


def keep_last(existing: DataFrame, new: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Upsert: one row per key, the last by order; rows of new come after those of existing."""
    both = existing.withColumn("__n", F.lit(0)).unionByName(new.withColumn("__n", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc("__n"), F.desc(order))
    return both.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "__n")


def recall(expected: DataFrame, found: DataFrame) -> DataFrame:
    """expected (qid, id), found (qid, id) -> qid, recall: share of the expected that was found."""
    hit = expected.distinct().join(found.select("qid", "id").distinct().withColumn("h", F.lit(1)), ["qid", "id"], "left")
    return hit.groupBy("qid").agg((F.count("h") / F.count("*")).alias("recall"))


def summaries(points: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (graph_id, place) -> the first summary point of each graph, score 1.0, in the order asked; graphs without one are left out."""
    w = Window.partitionBy("graph_id").orderBy("id")
    first = points.filter("section = 'Summary'").join(asked.select("graph_id").distinct(), "graph_id", "left_semi").withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    return asked.join(first, "graph_id").withColumn("score", F.lit(1.0)).orderBy("place")


def error_category(error: Column, label: Column, score: Column) -> Column:
    """(category, confidence) of an error: Unknown and 0 for blank texts and where classification failed (null label)."""
    known = (F.trim(F.coalesce(error, F.lit(""))) != "") & label.isNotNull()
    return F.struct(F.when(known, label).otherwise("Unknown").alias("category"), F.when(known, F.coalesce(score, F.lit(0.0))).otherwise(0.0).alias("confidence"))


def add_labels(store: DataFrame, labels: DataFrame) -> DataFrame:
    """store (id, label, auto_generated) with labels (kind, label) added or set by hand: auto_generated false."""
    new = labels.select(canonical_id(F.col("kind"), F.col("label")).alias("id"), "label", F.lit(False).alias("auto_generated")).distinct()
    return store.join(new.select("id"), "id", "left_anti").unionByName(new)


def list_labels(points: DataFrame, sentinel: Sequence[float], section: str, limit: int = 500) -> DataFrame:
    """Stored labels of a section: the nearest to a sentinel, none below a cosine of zero."""
    return search(points, sentinel, limit, 0.0, section=section)


def neighbour_recall(items: DataFrame, k: int = 5) -> DataFrame:
    """items (id, embedding, tools) -> id, recall: share of an item's tools that the union of its k nearest others' holds. Null without tools."""
    p = items.select("id", "embedding", F.lit("").alias("section"))
    hits = batch_search(p, p.withColumnRenamed("id", "qid"), k, sections=False, skip_self=True)
    near = hits.join(items.select("id", F.explode("tools").alias("tool")), "id").select("qid", "tool").distinct()
    want = items.select(F.col("id").alias("qid"), F.explode("tools").alias("tool")).distinct()
    share = want.join(near.withColumn("hit", F.lit(1)), ["qid", "tool"], "left").groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))
    return items.select(F.col("id").alias("qid")).join(share, "qid", "left").select(F.col("qid").alias("id"), "recall")


# tool selection


def selector_parameters(full: int, explore: int, candidates: int = 0) -> tuple[int, int, int]:
    """(candidates to fetch, places reserved for descriptions, full descriptions): explore <= full <= candidates unless those are given."""
    return candidates or max(40, 3 * full), min(explore, full), full


def trigger_points(runs: DataFrame, namespace: str, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """runs (tools, prompt, weight, seq) -> one point per namespace, tool signature and prompt, the last by seq: id, prompt, tools (sorted, distinct), weight.

    Runs without a tool or a prompt give none. A run that led to a cause is added again with weight 2.
    """
    tools = F.array_sort(F.array_distinct(F.filter("tools", lambda t: F.coalesce(t, F.lit("")) != "")))
    rows = runs.select(tools.alias("tools"), F.trim(F.coalesce("prompt", F.lit(""))).alias("prompt"), F.coalesce("weight", F.lit(1.0)).alias("weight"), "seq").filter("size(tools) > 0 and prompt <> ''")
    named = rows.withColumn("id", uuid5(F.concat_ws("::", F.lit("proctrig"), F.lit(namespace), F.array_join("tools", ","), "prompt")))
    w = Window.partitionBy("id").orderBy(F.desc("seq"))
    last = named.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n", "seq")
    return last if embed is None else last.withColumn("embedding", embed(F.col("prompt")))


def catalogue_points(tools: DataFrame, namespace: str, stored: DataFrame) -> DataFrame:
    """tools (name, description, arguments, schema) that are new or changed against stored (id, tool_hash) -> id, name, text, tool_hash."""
    h = F.sha2(F.to_json(F.struct("name", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("schema", F.lit("{}")).alias("schema"))), 256)
    text = F.concat("name", F.lit(": "), F.trim(F.coalesce("description", F.lit(""))), F.when(F.size("arguments") > 0, F.concat(F.lit(" (args: "), F.array_join("arguments", ", "), F.lit(")"))).otherwise(""))
    rows = tools.select(uuid5(F.concat_ws("::", F.lit("toolcat"), F.lit(namespace), "name")).alias("id"), "name", text.alias("text"), h.alias("tool_hash"))
    return rows.join(stored.select("id", F.col("tool_hash").alias("__old")), "id", "left").filter(~F.col("tool_hash").eqNullSafe(F.col("__old"))).drop("__old")


def select_tools(triggers: DataFrame, catalogue: DataFrame, live: DataFrame, budget: int, reserved: int = 4, cap: int = 25) -> DataFrame:
    """Per key the tools to describe: key, name, pos, tier (full or compact).

    triggers (key, tools, score, weight): hits on past runs, the best score * weight first; catalogue (key, name, score): hits on
    descriptions; live (key, name, full, compact: costs). Only live tools count; both lists are merged with `reserved`
    places for the second, and packed into the budget.
    """
    by_key = Window.partitionBy("key")
    ranked = triggers.withColumn("value", F.col("score") * F.coalesce(F.nullif("weight", F.lit(0.0)), F.lit(1.0))).withColumn("r", F.row_number().over(by_key.orderBy(F.desc("value"), F.to_json("tools"))))
    flat = ranked.select("key", "r", F.posexplode("tools").alias("at", "name"))

    def listed(rows: DataFrame, *order: Column | str) -> DataFrame:
        """Live names in their order, each once."""
        here = rows.join(live.select("key", "name"), ["key", "name"], "left_semi")
        first = here.withColumn("n", F.row_number().over(Window.partitionBy("key", "name").orderBy(*order))).filter("n = 1")
        return first.withColumn("pos", F.row_number().over(by_key.orderBy(*order)) - 1).select("key", "name", "pos")

    merged = merge_sources(listed(flat, "r", "at"), listed(catalogue, F.desc("score"), "name"), reserved)
    return pack(merged.join(live, ["key", "name"]).select("key", "name", "pos", "full", "compact"), budget, cap)
