"""Typed nodes and edges from a model's JSON answers, and promotion of a finished investigation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.scalars import procedure_name, tool_references
from tidegraph.functions.workers import ready
from tidegraph.operators.classify import tolerant_json as tolerant
from tidegraph.operators.vectors import point_id

ANSWER = (
    "nodes array<struct<node_type:string,name:string,description:string,metadata:map<string,string>,steps:array<string>>>,"
    " relationships array<struct<source_name:string,target_name:string,relation_type:string,confidence:double>>"
)
# fixed values: what each kind of text may give
LOG_TYPES = ("Symptom", "Component", "Task_Context", "Task_Feature")
EMAIL_TYPES = ("Cause", "Resolution", "Procedure", "Task_Context")
NARRATED_TYPES = ("Cause", "Resolution", "Task_Context")


def parse_answers(answers: DataFrame, types: Sequence[str], key: str = "graph_id", column: str = "answer", labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """answers (key, JSON text, fenced or not) -> (nodes, edges): nodes of the allowed types, edges whose ends both stay.

    Text that isn't JSON gives nothing. Confidences outside 0 to 1 are clamped, missing ones 1. labels (node_type,
    raw, canonical) renames nodes of a type by their description or, without one, by their name; edges follow.
    """
    told = answers.select(key, tolerant(F.col(column), ANSWER).alias("a"))
    nodes = told.select(key, F.posexplode("a.nodes").alias("place", "n")).select(key, "place", "n.*").filter(F.col("node_type").isin(*types) & (F.trim(F.coalesce("name", F.lit(""))) != ""))
    nodes = nodes.withColumn("raw_name", F.col("name"))
    if labels is not None:
        said = F.coalesce(F.nullif(F.trim("description"), F.lit("")), F.col("name"))
        renamed = labels.select(F.col("node_type").alias("t"), F.col("raw").alias("r"), "canonical")
        nodes = nodes.join(renamed, (F.col("node_type") == F.col("t")) & (said == F.col("r")), "left").withColumn("name", F.coalesce("canonical", "name")).drop("t", "r", "canonical")
    edges = told.select(key, F.posexplode("a.relationships").alias("place", "e")).select(key, "place", "e.*")
    ends = nodes.groupBy(key, "raw_name").agg(F.min_by("name", "place").alias("to"))
    for side in ("source_name", "target_name"):
        edges = edges.join(ends.select(key, F.col("raw_name").alias(side), F.col("to").alias(f"{side}_to")), [key, side]).drop(side).withColumnRenamed(f"{side}_to", side)
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(1.0))))
    return nodes.drop("raw_name"), edges.select(key, "place", F.col("source_name").alias("src"), F.col("relation_type").alias("rel"), F.col("target_name").alias("tgt"), confidence.alias("confidence"))


def actions(answers: DataFrame, key: str = "graph_id", column: str = "answer") -> tuple[DataFrame, DataFrame]:
    """Atomic actions of answers -> (procedures, edges): each investigates its cause; only stated dependencies become depends_on, from the later to the earlier."""
    told = answers.select(key, F.explode(tolerant(F.col(column), "atomic_actions array<struct<name:string,description:string,cause:string,depends_on:array<string>>>")["atomic_actions"]).alias("a")).select(key, "a.*").filter(F.trim(F.coalesce("name", F.lit(""))) != "")
    known = told.select(key, F.col("name").alias("tgt")).distinct()
    needs = told.select(key, F.col("name").alias("src"), F.explode("depends_on").alias("tgt")).join(known, [key, "tgt"], "left_semi").filter("src <> tgt").select(key, "src", F.lit("depends_on").alias("rel"), "tgt")
    asks = told.filter("cause is not null").select(key, F.col("cause").alias("src"), F.lit("investigated_by").alias("rel"), F.col("name").alias("tgt"))
    return told.select(key, F.lit("Procedure").alias("node_type"), "name", "description"), asks.unionByName(needs).distinct()


def append_partial(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, key: str = "graph_id") -> tuple[DataFrame, DataFrame]:
    """A session's graph with new nodes whose type and name aren't there (the first of repeats), and all new edges, repeated or not."""
    by = Window.partitionBy(key, "node_type", "name").orderBy(*(c for c in ("place", "seq") if c in new_nodes.columns) or ["name"])
    once = new_nodes.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")
    fresh = once.join(nodes.select(key, "node_type", "name").distinct(), [key, "node_type", "name"], "left_anti")
    return nodes.unionByName(fresh, allowMissingColumns=True), edges.unionByName(new_edges, allowMissingColumns=True)


# fixed values: relations that edges may have
RELATIONS = (
    "indicate", "solved_by", "contribute_to", "originated_from", "investigated_by",
    "associated_with", "signals", "leads_to", "has_component", "depends_on", "suggests", "improves", "triggers", "affects", "performed_by", "reported_by", "assigned_to", "approved_by",
)


def merge_narration(nodes: DataFrame, edges: DataFrame, answers: DataFrame, key: str = "graph_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A session's graph with what a narrated answer adds, and key, added: how many nodes and edges the answer gave.

    Only causes, resolutions and contexts with a name; edges need both ends in the graph or the answer, and a known relation.
    """
    told = answers.select(key, tolerant(F.col("answer"), ANSWER).alias("a"))
    more = told.select(key, F.posexplode("a.nodes").alias("place", "n")).select(key, "place", "n.node_type", "n.name", "n.description").filter(F.col("node_type").isin(*NARRATED_TYPES) & (F.coalesce("name", F.lit("")) != ""))
    names = nodes.select(key, "name").union(more.select(key, "name")).distinct()
    links = told.select(key, F.posexplode("a.relationships").alias("place", "e")).select(key, "place", F.col("e.source_name").alias("src"), F.col("e.relation_type").alias("rel"), F.col("e.target_name").alias("tgt"), F.coalesce("e.confidence", F.lit(1.0)).alias("confidence"))
    links = links.filter(F.col("rel").isin(*RELATIONS))
    for side in ("src", "tgt"):
        links = links.join(names.withColumnRenamed("name", side), [key, side], "left_semi")
    count = answers.select(key).distinct().join(more.select(key).unionByName(links.select(key)).groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("added"))
    return *append_partial(nodes, edges, more, links, key), count


def atomic_action(runs: DataFrame, key: str = "graph_id") -> DataFrame:
    """runs (key, action_id, strategy, code, summary, error, result: JSON text) -> two nodes each: a tentative procedure and a context with the result's first 4,000 characters."""
    signature = F.coalesce(tool_references(F.col("code")), F.array().cast("array<string>"))
    about = F.to_json(F.struct(F.col("code").alias("orchestration_code"), F.col("summary").alias("code_summary"), "action_id", "signature", F.when(F.size("signature") > 0, procedure_name(F.col("signature"))).otherwise("").alias("tool_name"), "error"))
    rows = runs.withColumn("signature", signature)
    procedure = F.struct(F.lit("Procedure").alias("node_type"), F.concat_ws(":", "strategy", F.lit("tentative"), "action_id").alias("name"), F.coalesce(F.nullif("summary", F.lit("")), F.col("strategy")).alias("description"), about.alias("metadata"))
    context = F.struct(F.lit("Task_Context").alias("node_type"), F.concat(F.lit("result:"), "action_id").alias("name"), F.substring("result", 1, 4000).alias("description"), F.to_json(F.struct(F.lit("investigate:tool_result").alias("source"), "action_id")).alias("metadata"))
    return rows.select(key, F.explode(F.array(procedure, context)).alias("n")).select(key, "n.*")


def finalisation_edges(nodes: DataFrame, key: str = "graph_id") -> DataFrame:
    """Edges that a finished investigation gets: to its causes from symptoms (1.0) and features (0.5), and from causes to resolutions (1.0) and procedures, by tool name."""
    name = F.when(F.col("node_type") == "Procedure", F.coalesce("tool_name", "name")).otherwise(F.col("name"))
    me = nodes.select(key, "node_type", name.alias("name")).distinct()
    cause = me.filter("node_type = 'Cause'").select(key, F.col("name").alias("cause"))
    out = None
    for kind, rel, confidence, to_cause in (("Symptom", "indicate", 1.0, True), ("Task_Feature", "contribute_to", 0.5, True), ("Resolution", "solved_by", 1.0, False), ("Procedure", "investigated_by", 1.0, False)):
        pairs = me.filter(F.col("node_type") == kind).select(key, F.col("name").alias("other")).join(cause, key)
        ends = ("other", "cause") if to_cause else ("cause", "other")
        made = pairs.select(key, F.col(ends[0]).alias("src"), F.lit(rel).alias("rel"), F.col(ends[1]).alias("tgt"), F.lit(confidence).alias("confidence"))
        out = made if out is None else out.unionByName(made)
    return out


def rewrite_batches(rows: DataFrame, column: str, rewrite: Callable[[list[str]], list[str]], size: int = 20) -> DataFrame:
    """Each distinct text of a column with what a model made of it: text, new. Texts go in batches; a batch whose answer has another length keeps its texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            texts, made = f["text"].tolist(), []
            for at in range(0, len(texts), size):
                part = texts[at : at + size]
                answer = rewrite(part)
                made += answer if len(answer) == len(part) else part
            yield pd.DataFrame({"text": texts, "new": made})

    ready(rows.sparkSession)
    return rows.filter(F.coalesce(column, F.lit("")) != "").select(F.col(column).alias("text")).distinct().mapInPandas(run, "text string, new string")


def rewritten(rows: DataFrame, rewrite: DataFrame, column: str) -> DataFrame:
    """rows with a column replaced by what a model made of each distinct text (text, new); without an answer it stays."""
    last = rewrite.groupBy("text").agg(F.first("new", ignorenulls=True).alias("__new"))
    return rows.join(last.withColumnRenamed("text", "__text"), F.col(column) == F.col("__text"), "left").withColumn(column, F.coalesce("__new", column)).drop("__new", "__text")


def insights(nodes: DataFrame) -> DataFrame:
    """Contexts and symptoms with a description -> what goes to the vector store: the raw description if there is one."""
    raw = F.nullif(F.trim(F.coalesce(F.col("metadata")["raw_description"], F.lit(""))), F.lit(""))
    return nodes.filter(F.col("node_type").isin("Task_Context", "Symptom") & (F.trim(F.coalesce("description", F.lit(""))) != "")).withColumn("content", F.coalesce(raw, "description"))


def leads(initial: DataFrame, causes: DataFrame, novel: DataFrame, key: str = "task_id") -> DataFrame:
    """Per task what to look into, in order: initial (key, cause, confidence), the first three causes (key, name, rank), the first five novel symptoms (key, name, place)."""
    a = initial.filter(F.coalesce("cause", F.lit("")) != "").select(key, F.lit(0).alias("part"), F.lit(0).alias("at"), F.concat(F.lit("Initial root cause hypothesis (confidence "), F.coalesce(F.col("confidence").cast("string"), F.lit("None")), F.lit("): "), "cause", F.lit(" — fetch evidence to confirm or refute.")).alias("lead"))
    b = causes.filter("rank <= 3").select(key, F.lit(1).alias("part"), F.col("rank").cast("int").alias("at"), F.concat(F.lit("Candidate cause from graph DB: "), "name", F.lit(" — fetch evidence to confirm or refute against this task.")).alias("lead"))
    w = Window.partitionBy(key).orderBy("place", "name")
    c = novel.withColumn("at", F.row_number().over(w)).filter("at <= 5").select(key, F.lit(2).alias("part"), "at", F.concat(F.lit("Novel symptom with no graph DB precedent: "), "name", F.lit(" — fetch evidence to characterise it.")).alias("lead"))
    rows = a.unionByName(b).unionByName(c)
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "at", "lead"))), lambda x: x["lead"]).alias("leads"))


def vector_points(nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """What a graph gives the vector store: one point per insight, and one Summary (graph_id, summary) -> id, section, content, graph_id."""
    told = insights(nodes).select(point_id(F.col("graph_id"), F.col("node_type"), F.col("name")).alias("id"), F.col("node_type").alias("section"), "content", "graph_id")
    return told.unionByName(summaries.select(point_id(F.col("graph_id"), F.lit("summary")).alias("id"), F.lit("Summary").alias("section"), F.col("summary").alias("content"), "graph_id"))
