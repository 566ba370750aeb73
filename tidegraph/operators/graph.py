"""The property graph: merging observations into nodes and edges, removing, and the questions asked of it.

Nodes: node_type, id, name, description, metadata (JSON text), concepts. Observations of edges: src_type, src, rel,
tgt_type, tgt, graph_id, confidence, parameters, seq. An edge is a group of observations: merging, removal and
reprocessing are then aggregates and anti-joins, and no row is updated in place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: which relation leads from which kind of clue to a cause
CLUE_RELATIONS = {"Symptom": "indicate", "Task_Feature": "contribute_to", "Environment": "contribute_to", "Component": "originated_from"}
LINKS_TO_CAUSES = {"Symptom": "indicate", "Component": "originated_from", "Environment": "associated_with"}
VECTOR_ONLY = "Task_Context"
REVIEWED_CONCEPTS = ("cpu", "memory", "walltime", "disk", "site", "job_size")

EDGE = ["src_type", "src", "rel", "tgt_type", "tgt"]


def _first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row of each key: the first in the order. Nulls of a key are one value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def merge_nodes(existing: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """existing and those of new whose (node_type, name) is not there; of repeats in new the first stays (first writer wins)."""
    fresh = _first(new, ["node_type", "name"], [order]).drop(order).join(existing.select("node_type", "name"), ["node_type", "name"], "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def with_ends(observations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Observations both of whose ends are there."""
    ends = nodes.select(F.col("node_type"), F.col("name")).distinct()
    for side in ("src", "tgt"):
        observations = observations.join(ends.select(F.col("node_type").alias(f"{side}_type"), F.col("name").alias(side)), [f"{side}_type", side], "left_semi")
    return observations


def once_per_graph(observations: DataFrame) -> DataFrame:
    """The store of edges: one row per edge and graph, by its first observation (seq is unique there). A blank graph_id adds no provenance.

    Which graphs an edge has is this table; no row holds a list that grows with the corpus.
    """
    told = observations.withColumn("graph_id", F.trim(F.coalesce("graph_id", F.lit(""))))
    return told.groupBy(*EDGE, "graph_id").agg(F.min_by("confidence", "seq").alias("confidence"), F.min("seq").alias("seq"))


def merge_edges(observations: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Observations -> edges with frequency (distinct graphs) and confidence (mean over graphs). With nodes, an edge needs both ends there. Both levels of grouping combine before they shuffle."""
    once = once_per_graph(observations if nodes is None else with_ends(observations, nodes))
    return once.groupBy(*EDGE).agg(F.count(F.nullif("graph_id", F.lit(""))).alias("frequency"), F.avg("confidence").alias("confidence"))


def provenance(observations: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with graph_ids and parameters (both sorted) of those asked for: the parameters of each graph's first observation."""
    told = observations.withColumn("graph_id", F.trim(F.coalesce("graph_id", F.lit("")))).join(edges.select(*EDGE).distinct(), EDGE, "left_semi")
    first = told.groupBy(*EDGE, "graph_id").agg(F.min_by("parameters", "seq").alias("parameters"))
    lists = first.groupBy(*EDGE).agg(F.sort_array(F.collect_list(F.nullif("graph_id", F.lit("")))).alias("graph_ids"), F.array_sort(F.collect_list("parameters")).alias("parameters"))
    return edges.join(lists, EDGE, "left")


def remove_graph(observations: DataFrame, nodes: DataFrame, graph_ids: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(observations, nodes, counts) without some graphs: then edges without provenance and all isolated nodes are gone.

    counts: rels_affected, nodes_removed in one row.
    """
    gone = F.col("graph_id").isin(*graph_ids)
    rest = observations.filter(~F.coalesce(gone, F.lit(False)))
    affected = observations.filter(gone).select(*EDGE).distinct()
    ends = rest.select(F.col("src_type").alias("node_type"), F.col("src").alias("name")).union(rest.select("tgt_type", "tgt")).distinct()
    left = nodes.join(ends, ["node_type", "name"], "left_semi")
    counts = affected.agg(F.count("*").alias("rels_affected")).join(nodes.join(ends, ["node_type", "name"], "left_anti").agg(F.count("*").alias("nodes_removed")), how="inner")
    return rest, left, counts


def reprocess(observations: DataFrame, new: DataFrame) -> DataFrame:
    """observations with the graphs of new replaced by new."""
    return observations.join(new.select("graph_id").distinct(), "graph_id", "left_anti").unionByName(new)


def count_events(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """Cause frequencies: 1 where unset, and one more for each event (id)."""
    more = events.groupBy("id").agg(F.count("*").alias("__more"))
    return nodes.join(more, "id", "left").withColumn("frequency", F.coalesce("frequency", F.lit(1)) + F.coalesce("__more", F.lit(0))).drop("__more")


def success_rates(attempts: DataFrame) -> DataFrame:
    """attempts (id, success) -> id, attempts, successes, success_rate."""
    wins = F.sum(F.col("success").cast("int"))
    return attempts.groupBy("id").agg(F.count("*").alias("attempts"), wins.alias("successes"), (wins / F.count("*")).alias("success_rate"))


def override(nodes: DataFrame, changes: DataFrame, column: str, keys: Sequence[str] = ("node_type", "name")) -> DataFrame:
    """nodes with one column set where changes (keys, value, seq) say so, the last change first."""
    last = changes.groupBy(*keys).agg(F.max_by("value", "seq").alias("__value"), F.lit(True).alias("__set"))
    return nodes.join(last, list(keys), "left").withColumn(column, F.when(F.col("__set"), F.col("__value")).otherwise(F.col(column))).drop("__value", "__set")


def storable(nodes: DataFrame, observations: DataFrame) -> DataFrame:
    """Nodes that the graph stores: not kept by vectors alone, and at an end of some edge."""
    ends = observations.select(F.col("src").alias("name")).union(observations.select("tgt")).distinct()
    return nodes.filter(F.col("node_type") != VECTOR_ONLY).join(ends, "name", "left_semi")


def remap(observations: DataFrame, ids: DataFrame, parameters: DataFrame | None = None) -> DataFrame:
    """Observations with ends replaced by stored ids (name -> id); those with an end that isn't stored go. Procedures' parameters (name, parameters)
    fill those that an `investigated_by` edge to them lacks."""
    a = ids.select(F.col("name").alias("src"), F.col("id").alias("src_id"))
    b = ids.select(F.col("name").alias("tgt"), F.col("id").alias("tgt_id"))
    out = observations.join(a, "src").join(b, "tgt")
    if parameters is None:
        return out
    own = parameters.select(F.col("name").alias("tgt"), F.col("parameters").alias("__own"))
    return out.join(own, "tgt", "left").withColumn("parameters", F.when(F.col("rel") == "investigated_by", F.coalesce("parameters", "__own")).otherwise(F.col("parameters"))).drop("__own")


def dedup_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One node per (node_type, name), one edge per (src, tgt, rel), the first by seq; edges by ids follow the node that stays, and self-loops go."""
    kept = _first(nodes, ["node_type", "name"], ["seq"])
    if "id" in nodes.columns:
        to = nodes.select("node_type", "name", F.col("id").alias("__id")).join(kept.select("node_type", "name", F.col("id").alias("__to")), ["node_type", "name"]).select("__id", "__to")
        for side in ("src", "tgt"):
            edges = edges.join(to, F.col(side) == F.col("__id"), "left").withColumn(side, F.coalesce("__to", side)).drop("__id", "__to")
    return kept, _first(edges.filter("src <> tgt"), ["src", "tgt", "rel"], ["seq"])


def reconcile_grouped(rows: DataFrame, confidence: float = 0.7) -> DataFrame:
    """rows (graph_id, node: struct(node_type, name), edge: struct(src, rel, tgt)), either null -> the edges missing within each graph.

    One grouping: a graph's nodes and edges are one incident, and all its pairs are made from its own lists.
    """
    per = rows.groupBy("graph_id").agg(F.collect_set("node").alias("nodes"), F.collect_set("edge").alias("edges"))
    names = lambda kind: F.transform(F.filter("nodes", lambda n: n["node_type"] == kind), lambda n: n["name"])
    pairs = lambda a, rel, b: F.flatten(F.transform(names(a), lambda x: F.transform(names(b), lambda y: F.struct(x.alias("src"), F.lit(rel).alias("rel"), y.alias("tgt")))))
    made = F.concat(*(pairs(kind, rel, "Cause") for kind, rel in LINKS_TO_CAUSES.items()), pairs("Cause", "solved_by", "Resolution"))
    kind = F.create_map(*[F.lit(x) for k, rel in LINKS_TO_CAUSES.items() for x in (rel, k)], F.lit("solved_by"), F.lit("Cause"))
    missing = per.select("graph_id", F.explode(F.array_except(made, "edges")).alias("e"))
    return missing.select("graph_id", kind[F.col("e.rel")].alias("src_type"), "e.src", F.when(F.col("e.rel") == "solved_by", "Resolution").otherwise("Cause").alias("tgt_type"), "e.tgt", "e.rel", F.lit(confidence).alias("confidence"))


def reconcile_links(nodes: DataFrame, edges: DataFrame, confidence: float = 0.7) -> DataFrame:
    """Edges missing within each graph between every symptom, component, environment and cause, and cause and resolution. nodes and edges carry graph_id."""
    n, e = "struct<node_type:string,name:string>", "struct<src:string,rel:string,tgt:string>"
    a = nodes.select("graph_id", F.struct("node_type", "name").cast(n).alias("node"), F.lit(None).cast(e).alias("edge"))
    return reconcile_grouped(a.unionByName(edges.select("graph_id", F.lit(None).cast(n).alias("node"), F.struct("src", "rel", "tgt").cast(e).alias("edge"))), confidence)


def concept_edges(nodes: DataFrame, edges: DataFrame, wanted: Sequence[str], target: str, rel: str, confidence: float) -> DataFrame:
    """Edges from features whose concepts meet `wanted` to every node of one type in their graph, where missing.

    Context edges: ("context",), Symptom, associated_with, 1.0; dimension edges: the failure's dimensions, Cause, contribute_to, 0.9.
    """
    me = nodes.filter((F.col("node_type") == "Task_Feature") & F.arrays_overlap("concepts", F.array(*map(F.lit, wanted)))).select("graph_id", F.col("name").alias("src")).distinct()
    it = nodes.filter(F.col("node_type") == target).select("graph_id", F.col("name").alias("tgt")).distinct()
    made = me.join(it, "graph_id").withColumn("rel", F.lit(rel))
    return made.join(edges.select("graph_id", "src", "rel", "tgt"), ["graph_id", "src", "rel", "tgt"], "left_anti").withColumn("confidence", F.lit(confidence))


def diff_nodes(new: DataFrame, existing: DataFrame) -> DataFrame:
    """new with status: merge where a described node of that type and name exists, else new."""
    there = existing.filter("description is not null").select("node_type", "name", F.lit(True).alias("__there")).distinct()
    return new.join(there, ["node_type", "name"], "left").withColumn("status", F.when(F.col("__there"), "merge").otherwise("new")).drop("__there")


def find_causes(edges: DataFrame, causes: DataFrame, clues: DataFrame, solved: DataFrame | None = None, limit: int = 10, relations: Mapping[str, str] = CLUE_RELATIONS) -> DataFrame:
    """Causes that clues (clue_type, clue) lead to, by how many types of clues, then frequency, confidence and name.

    edges: src_type, src, rel, tgt. causes: name, frequency, confidence. solved: cause, resolution structs; a cause
    without has an empty array. Clues are few and are matched by an equi-join on their type and text.
    """
    rel = F.create_map(*[F.lit(x) for pair in relations.items() for x in pair])
    asked = clues.filter("clue is not null").select(F.col("clue_type").alias("src_type"), F.col("clue").alias("src"), rel[F.col("clue_type")].alias("rel")).distinct()
    hits = edges.join(asked, ["src_type", "src", "rel"]).groupBy(F.col("tgt").alias("name")).agg(F.count_distinct("src_type").alias("match_score"))
    best = hits.join(causes, "name").orderBy(F.desc("match_score"), F.desc("frequency"), F.desc("confidence"), "name").limit(limit)
    if solved is None:
        return best
    told = solved.groupBy(F.col("cause").alias("name")).agg(F.array_sort(F.collect_set("resolution")).alias("resolutions"))
    out = best.join(told, "name", "left").withColumn("resolutions", F.coalesce("resolutions", F.array().cast(dict(told.dtypes)["resolutions"])))
    return out.orderBy(F.desc("match_score"), F.desc("frequency"), F.desc("confidence"), "name")


def procedure_fields(procedures: DataFrame, include_tentative: bool = False) -> DataFrame:
    """Fields of the metadata's JSON with their defaults; tentative procedures only if asked."""
    get = lambda k: F.get_json_object("metadata", f"$.{k}")
    flag = lambda *ks: F.coalesce(*(get(k).cast("boolean") for k in ks), F.lit(False))
    out = procedures if include_tentative else procedures.filter(F.coalesce(get("status"), F.lit("")) != "tentative")
    names = F.coalesce(F.from_json(get("signature"), "array<string>"), F.array().cast("array<string>"))
    text = {k: F.coalesce(get(k), F.lit("")) for k in ("orchestration_code", "code_summary", "tool_name", "trigger_signals", "result_summary")}
    auto = F.coalesce(F.col("auto_run"), flag("auto_run")) if "auto_run" in out.columns else flag("auto_run")
    return out.withColumns({**text, "external_access": flag("external_access", "has_side_effects"), "signature": names, "auto_run": auto})


def find_procedures(edges: DataFrame, procedures: DataFrame, causes: Sequence[str], include_tentative: bool = False) -> DataFrame:
    """Procedures that investigate any of the causes, most frequent first."""
    hit = edges.filter((F.col("rel") == "investigated_by") & F.col("src").isin(*causes)).select(F.col("src").alias("cause"), F.col("tgt").alias("name"), F.coalesce("frequency", F.lit(1)).alias("frequency"), F.coalesce("parameters", F.array().cast("array<string>")).alias("parameters"))
    return procedure_fields(hit.join(procedures, "name"), include_tentative).orderBy(F.desc("frequency"), "name", "cause")


def all_procedures(edges: DataFrame, procedures: DataFrame, limit: int = 50, include_tentative: bool = False) -> DataFrame:
    """Every procedure with its summed frequency and causes; the limit comes before the tentative ones go."""
    told = edges.filter("rel = 'investigated_by'").groupBy(F.col("tgt").alias("name")).agg(F.sum(F.coalesce("frequency", F.lit(0))).alias("f"), F.array_sort(F.collect_set("src")).alias("c"))
    out = procedures.join(told, "name", "left").withColumn("frequency", F.coalesce("f", F.lit(0))).withColumn("cause_names", F.coalesce("c", F.array().cast("array<string>"))).drop("f", "c")
    return procedure_fields(out.orderBy(F.desc("frequency"), "name").limit(limit), include_tentative).orderBy(F.desc("frequency"), "name")


def common_pattern(observations: DataFrame, graph_ids: DataFrame | None = None, least: int = 2) -> DataFrame:
    """Edges that at least `least` of the graphs (all, or those listed) share: with occurrences and mean confidence. seq is unique within an edge and graph."""
    some = observations if graph_ids is None else observations.join(graph_ids.select("graph_id").distinct(), "graph_id", "left_semi")
    once = some.groupBy(*EDGE, "graph_id").agg(F.min_by("confidence", "seq").alias("confidence"))
    return once.groupBy(*EDGE).agg(F.count("*").alias("occurrences"), F.avg("confidence").alias("confidence")).filter(F.col("occurrences") >= least)


def pattern_report(pattern: DataFrame) -> DataFrame:
    """Distinct nodes of a pattern's edges, by type."""
    ends = pattern.select(F.col("src_type").alias("node_type"), F.col("src").alias("name")).union(pattern.select("tgt_type", "tgt")).distinct()
    return ends.groupBy("node_type").agg(F.count("*").alias("n"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows per node type and per relation."""
    return nodes.groupBy(F.lit("node").alias("kind"), F.col("node_type").alias("label")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.lit("relation").alias("kind"), F.col("rel").alias("label")).agg(F.count("*").alias("n")))


def novelty(edges: DataFrame, symptoms: DataFrame) -> DataFrame:
    """symptoms (name) -> name, matched: whether any cause is known for each."""
    known = edges.filter("src_type = 'Symptom' and rel = 'indicate'").select(F.col("src").alias("name"), F.lit(True).alias("k")).distinct()
    return symptoms.select("name").distinct().join(known, "name", "left").select("name", F.coalesce("k", F.lit(False)).alias("matched"))


def causes_unless_novel(edges: DataFrame, causes: DataFrame, clues: DataFrame, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """(causes of the clues, symptoms without any known cause): one such symptom makes the incident novel, and no cause is given."""
    unmatched = novelty(edges, clues.filter("clue_type = 'Symptom'").select(F.col("clue").alias("name"))).filter("not matched").select("name")
    found = find_causes(edges, causes, clues, limit=limit)
    gate = unmatched.agg(F.count("*").alias("__unmatched"))
    return found.join(F.broadcast(gate), F.col("__unmatched") == 0).drop("__unmatched"), unmatched


def causes_of_symptom(edges: DataFrame, causes: DataFrame, symptom: str, limit: int = 10) -> DataFrame:
    """The causes that one symptom leads to."""
    return find_causes(edges, causes, edges.sparkSession.createDataFrame([("Symptom", symptom)], "clue_type string, clue string"), limit=limit)


def procedures_of_cause(edges: DataFrame, procedures: DataFrame, cause: str) -> DataFrame:
    """The procedures that investigate one cause."""
    return find_procedures(edges, procedures, [cause])


def set_auto_run(procedures: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(procedures with auto_run set by changes (name, value, seq), name and whether it was there of each change)."""
    out = override(procedures, changes, "auto_run", ["name"])
    there = procedures.select("name", F.lit(True).alias("matched")).distinct()
    return out, changes.select("name").distinct().join(there, "name", "left").select("name", F.coalesce("matched", F.lit(False)).alias("matched"))


def clue_lists(nodes: DataFrame) -> DataFrame:
    """Per graph the names of each kind of clue; contexts by their description."""
    text = F.when(F.col("node_type") == VECTOR_ONLY, F.col("description")).otherwise(F.col("name"))
    kinds = {"symptoms": "Symptom", "task_features": "Task_Feature", "environment_factors": "Environment", "components": "Component", "contexts": VECTOR_ONLY}
    return nodes.groupBy("graph_id").agg(*(F.array_sort(F.collect_set(F.when(F.col("node_type") == t, text))).alias(k) for k, t in kinds.items()))


def missing_parts(nodes: DataFrame) -> DataFrame:
    """Per graph the required node types that it lacks."""
    return nodes.groupBy("graph_id").agg(F.array_except(F.array(*map(F.lit, ("Symptom", "Cause", "Procedure"))), F.collect_set("node_type")).alias("missing"))


def reviewed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a reviewer sees: no features without a reviewed concept, descriptions of 120 characters, edges between the rest."""
    seen = nodes.filter((F.col("node_type") != "Task_Feature") | F.coalesce(F.arrays_overlap("concepts", F.array(*map(F.lit, REVIEWED_CONCEPTS))), F.lit(False))).withColumn("description", F.substring("description", 1, 120))
    names = seen.select("graph_id", "name").distinct()
    ends = edges.join(names.withColumnRenamed("name", "src"), ["graph_id", "src"], "left_semi").join(names.withColumnRenamed("name", "tgt"), ["graph_id", "tgt"], "left_semi")
    return seen, ends


def chain(links: DataFrame, starts: DataFrame, hops: int = 3) -> DataFrame:
    """links (id, next) from starts (id) -> start, hop, id: at most `hops` steps, none back to where the chain has been."""
    step = starts.select(F.col("id").alias("start"), F.lit(0).alias("hop"), "id", F.array("id").alias("seen"))
    out = step
    for _ in range(hops):
        step = step.join(links.filter("next is not null").withColumnRenamed("id", "from"), F.col("id") == F.col("from")).filter(~F.array_contains("seen", F.col("next")))
        step = step.select("start", (F.col("hop") + 1).alias("hop"), F.col("next").alias("id"), F.concat("seen", F.array("next")).alias("seen"))
        out = out.unionByName(step)
    return out.drop("seen")


# fixed values: what is kept of a task in a chain of retries
CHAIN_FIELDS = ("status", "errorDialog", "retryID", "transUses")


def retry_chain(tasks: DataFrame, starts: DataFrame, hops: int = 3) -> DataFrame:
    """starts (task_id) -> start, hop, task_id and CHAIN_FIELDS of up to `hops` tasks that each was a retry of; errors are cut to 500 characters. It ends at unknown tasks and where it has been."""
    links = tasks.select(F.col("task_id").alias("id"), F.col("retryID").alias("next"))
    path = chain(links, starts.select(F.col("task_id").alias("id")), hops).filter("hop > 0").withColumnRenamed("id", "task_id")
    fields = [F.substring(F.col(c).cast("string"), 1, 500).alias(c) if c == "errorDialog" else F.col(c) for c in CHAIN_FIELDS]
    return path.join(tasks.select("task_id", *fields), "task_id").select("start", "hop", "task_id", *CHAIN_FIELDS)


def parent_task(tasks: DataFrame, starts: DataFrame) -> DataFrame:
    """starts (task_id, retryID) -> task_id, and all fields of its parent as a struct; null where it isn't known."""
    parent = tasks.select(F.col("task_id").alias("__id"), F.struct(*tasks.columns).alias("parent"))
    return starts.join(parent, F.col("retryID") == F.col("__id"), "left").select("task_id", "parent")
