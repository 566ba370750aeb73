"""What sessions and models are given and give back: texts from records, answers to fields."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.scalars import expanded
from tidegraph.operators.classify import tolerant_json, unfenced
from tidegraph.operators.privacy import SENSITIVE, redact
from tidegraph.operators.records import has_side_effects

# fixed values: fields of a task that a session begins with, how statuses look, fields that a reviewer sees
SIGNALS = ("status", "taskType", "processingType", "site", "gshare", "ramCount", "coreCount")
STYLES = {"failed": "red", "broken": "red", "aborted": "red", "exhausted": "yellow", "finished": "green", "done": "green"}
TASK_SUMMARY = ("jediTaskID", "status", "errorDialog", "retryID", "transUses", "prodSourceLabel", "taskName", "taskType", "nJobs", "nJobsFinished", "nJobsFailed")
# characters shown of mails, logs, documentation
MAIL, LOG, PAGES = 2000, 1000, 3000


def signals(task: Column) -> Column:
    """Lines `  key: value` of a task's (map) known fields; a remark without any."""
    lines = [F.when(F.coalesce(task[k], F.lit("")) != "", F.concat(F.lit(f"  {k}: "), task[k])) for k in SIGNALS]
    some = F.concat_ws("\n", *lines)
    return F.when(task.isNull() | (F.size(task) <= 0), "(no task_data)").when(some == "", "(no recognised signals)").otherwise(some)


def status_style(status: Column) -> Column:
    """The colour of a status; cyan for others."""
    styles = F.create_map(*[F.lit(x) for pair in STYLES.items() for x in pair])
    return F.coalesce(styles[status], F.lit("cyan"))


def task_summary(task: Column) -> Column:
    """JSON of a task's (map) fields that matter to a reviewer; errors are cut to 500 characters."""
    kept = F.map_filter(task, lambda k, v: k.isin(*TASK_SUMMARY))
    short = F.transform_values(kept, lambda k, v: F.when(k == "errorDialog", F.substring(v, 1, 500)).otherwise(v))
    order = F.array(*map(F.lit, TASK_SUMMARY))
    entries = F.map_from_entries(F.array_sort(F.map_entries(short), lambda a, b: (F.array_position(order, a["key"]) - F.array_position(order, b["key"])).cast("int")))
    return F.when(F.size(kept) > 0, F.to_json(entries)).otherwise("(no task context available)")


def excerpts(mails: DataFrame, logs: DataFrame, pages: DataFrame) -> DataFrame:
    """mails (task_id, text, investigation), logs (task_id, name, text), pages (task_id, query, text) -> task_id, label, text that a reviewer is given.

    What was found of investigations in a mail stands for the mail itself; blank texts are left out.
    """
    some = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")) != ""
    told = some(F.col("investigation"))
    a = mails.filter(told | some(F.col("text"))).select("task_id", F.when(told, "email_investigation").otherwise("email").alias("label"), F.when(told, F.regexp_replace("investigation", r"^\s+|\s+$", "")).otherwise(F.substring("text", 1, MAIL)).alias("text"))
    b = logs.filter(some(F.col("text"))).select("task_id", F.concat(F.lit("task_log:"), "name").alias("label"), F.substring("text", 1, LOG).alias("text"))
    c = pages.filter(some(F.col("text"))).select("task_id", F.concat(F.lit("panda_docs:"), F.substring("query", 1, 40)).alias("label"), F.substring("text", 1, PAGES).alias("text"))
    return a.unionByName(b).unionByName(c)


def mail_text(transcript: Column, cause: Column, resolution: Column) -> Column:
    """A discussion with its stated cause and resolution behind it."""
    said = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), F.trim(c)))
    return F.regexp_replace(F.concat_ws("\n", F.trim(transcript), F.lit(""), said("Cause", cause), said("Resolution", resolution)), r"^\s+|\s+$", "")


def extraction_input(mail: Column, task: Column, external: Column, hints: Column, logs: Column) -> Column:
    """One text of all that an extraction reads: mail, task and external fields (maps, as JSON), documentation, logs (map); empty parts are left out."""
    part = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{title}:\n"), c))
    as_json = lambda m: F.when(F.size(m) > 0, F.to_json(m))
    shown = F.transform(F.map_entries(F.map_filter(logs, lambda k, v: F.trim(F.coalesce(v, F.lit(""))) != "")), lambda e: F.concat(F.lit("TASK-LEVEL LOG ("), e["key"], F.lit("):\n"), e["value"]))
    documented = F.when(F.size(hints) > 0, F.array_join(F.map_values(hints), "\n\n"))
    return F.concat_ws("\n\n", part("EMAIL THREAD", mail), part("TASK DATA", as_json(task)), part("EXTERNAL INFORMATION", as_json(external)), part("DOMAIN DOCUMENTATION (PanDA system knowledge)", documented), F.when(F.size(shown) > 0, F.array_join(shown, "\n\n")))


def cause_inputs(task: Column, external: Column, hits: Column, fields: Sequence[str] = SENSITIVE) -> Column:
    """struct(task, external, hits: JSON) that a cause is sought from: sensitive fields redacted, hits (array of score, entry, content) cut to 500 characters."""
    rows = F.transform(hits, lambda h: F.struct(h["score"].alias("score"), h["entry"].alias("entry"), F.substring(h["content"], 1, 500).alias("content")))
    return F.struct(F.to_json(redact(task, fields)).alias("task"), F.coalesce(F.to_json(redact(external, fields)), F.lit("{}")).alias("external"), F.to_json(rows).alias("hits"))


def cause_answer(answer: Column) -> Column:
    """struct(root_cause, confidence, resolution, reasoning) of a model's answer; fixed texts and confidence 0 where it can't be read."""
    parsed = tolerant_json(answer, "root_cause string, confidence double, resolution string, reasoning string")
    good = F.try_parse_json(unfenced(answer)).isNotNull()
    bad = F.struct(F.lit("Unable to determine root cause").alias("root_cause"), F.lit(0.0).alias("confidence"), F.lit("Manual investigation required").alias("resolution"), F.lit("LLM response could not be parsed.").alias("reasoning"))
    return F.when(good, parsed).otherwise(bad)


def largest_keys(records: DataFrame, column: str, key: str = "task_id", most: int = 10) -> DataFrame:
    """records (key, a map) -> key, name, size of the entries with the longest JSON."""
    rows = records.select(key, F.explode(column).alias("name", "v")).select(key, "name", F.length(F.to_json(F.array("v"))).alias("size"))
    w = Window.partitionBy(key).orderBy(F.desc("size"), "name")
    return rows.withColumn("size", F.col("size") - 2).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def graph_json(nodes: DataFrame, edges: DataFrame, key: str = "graph_id", about: DataFrame | None = None) -> DataFrame:
    """Per graph one JSON text: nodes (type, name, description) and relationships (source, target, type), in their order; with about (key, summary, key_insights) as an export."""
    order = lambda c: F.transform(F.array_sort(c), lambda x: x["v"])
    n = nodes.groupBy(key).agg(F.collect_list(F.struct("place", F.struct(F.col("node_type").alias("type"), "name", "description").alias("v"))).alias("n"))
    e = edges.groupBy(key).agg(F.collect_list(F.struct("place", F.struct(F.col("src").alias("source"), F.col("tgt").alias("target"), F.col("rel").alias("type")).alias("v"))).alias("e"))
    both = n.join(e, key, "left")
    parts = [order("n").alias("nodes"), F.coalesce(order("e"), F.array()).alias("relationships")]
    if about is not None:
        both, parts = both.join(about, key, "left"), [F.col("summary"), F.col("key_insights"), *parts]
    return both.select(key, F.to_json(F.struct(*parts)).alias("json"))


def split_procedures(procedures: DataFrame, changing: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """procedures (cause, name, strategy, code, summary, description, parameters, triggers) -> (to be run again from stored code, to be suggested only since their code changes things, to be made anew from an instruction)."""
    has_code = F.trim(F.coalesce("code", F.lit(""))) != ""
    told = procedures.filter(has_code).withColumn("changes", has_side_effects(F.col("code"), changing)).withColumn("summary", F.coalesce(F.nullif(F.trim("summary"), F.lit("")), F.lit("(no summary)")))
    suggested = told.filter("changes").select("cause", "name", F.concat(F.col("strategy"), F.lit(" (cause: "), "cause", F.lit(") — "), "summary").alias("suggestion"))
    text = F.concat(
        F.lit("Procedure '"), "name", F.lit("' (strategy: "), "strategy", F.lit(", for cause: '"), "cause", F.lit("'): "), F.coalesce(F.nullif(F.trim("description"), F.lit("")), F.lit("(no description)")),
        F.lit(". Historical parameters: "), F.coalesce(F.to_json("parameters"), F.lit("[]")), F.when(F.size("triggers") > 0, F.concat(F.lit("\n  Trigger signals (past incidents): "), F.array_join("triggers", "; "))).otherwise(""),
    )
    return told.filter("not changes").drop("changes"), suggested, procedures.filter(~has_code).select("cause", "name", text.alias("instruction"))


def stored_results(results: DataFrame, logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """results (strategy, key, value) under the names that stored procedures give, logs (name, text) cut to 2,000 characters."""
    return results.select(F.concat_ws(":", F.lit("stored"), "strategy", "key").alias("label"), "value"), logs.select("name", F.substring("text", 1, 2000).alias("text"))


# fixed values: names under which code is given
CODE_KEYS = ("orchestration_code", "orchest_code", "code")


def code_answer(answer: Column) -> Column:
    """struct(code, gaps) of a model's answer: code under the first of the known names that is there, gaps that say what to investigate; empty where it can't be read."""
    text = unfenced(answer)
    keys = F.json_object_keys(text)
    code = F.lit("")
    for k in reversed(CODE_KEYS):
        is_text = F.schema_of_variant(F.try_parse_json(text)).rlike(rf"\b{k}: STRING")
        code = F.when(F.array_contains(keys, k), F.when(is_text, F.get_json_object(text, f"$.{k}"))).otherwise(code)
    kind = "array<struct<investigation:string,suggested_tool_capability:string>>"
    gaps = F.filter(F.coalesce(F.from_json(F.get_json_object(text, "$.capability_gaps"), kind), F.array().cast(kind)), lambda g: F.coalesce(g["investigation"], F.lit("")) != "")
    readable = F.try_parse_json(text).isNotNull() & keys.isNotNull()
    return F.struct(F.when(readable, F.coalesce(code, F.lit(""))).otherwise("").alias("code"), F.when(readable, gaps).otherwise(F.array().cast(kind)).alias("gaps"))


def draft_body(answer: Column, task_id: Column, error: Column) -> Column:
    """struct(background, cause, resolution, procedure) of a model's draft; a placeholder where it can't be read."""
    parsed = tolerant_json(answer, "background string, cause string, resolution string, procedure array<string>")
    good = F.try_parse_json(unfenced(answer)).isNotNull()
    none = F.array().cast("array<string>")
    bad = F.struct(F.concat(F.lit("Task "), task_id.cast("string"), F.lit(" failed with: "), F.coalesce(error, F.lit(""))).alias("background"), F.lit("(DRAFT GENERATION FAILED — fill in manually)").alias("cause"), F.lit("").alias("resolution"), none.alias("procedure"))
    return F.when(F.coalesce(good, F.lit(False)), parsed).otherwise(bad)


# configuration


def allowed_names(names: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), column: str = "name") -> DataFrame:
    """Rows whose name matches any pattern to include (all, if there is none) and none to exclude."""
    hit = lambda patterns: F.col(column).rlike("|".join(f"(?:{p})" for p in patterns))
    out = names.filter(hit(include)) if include else names
    return out.filter(~hit(exclude)) if exclude else out


def servers(text: str | None, variables: Mapping[str, str]) -> list[dict]:
    """External servers of a JSON configuration: exactly one of url and command each, variables in headers and environment filled in, patterns that can't be read dropped. A file that is missing or wrong gives none."""
    try:
        found = []
        for entry in json.loads(text or "{}").get("servers", []):
            if bool(entry.get("url")) == bool(entry.get("command")):
                raise ValueError(f"{entry['name']}: either url or command")
            out = {"name": str(entry["name"]), "url": entry.get("url", ""), "command": entry.get("command", ""), "args": list(entry.get("args", [])), "enabled": bool(entry.get("enabled", True))}
            out |= {k: {n: expanded(str(v), variables) for n, v in entry.get(k, {}).items()} for k in ("headers", "env")}
            out |= {k: [p for p in entry.get(k, []) if _readable(p)] for k in ("include_tools", "exclude_tools")}
            found.append(out)
        return found
    except (ValueError, TypeError, KeyError, AttributeError):
        return []


def _readable(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True
