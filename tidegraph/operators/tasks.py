"""Questions about tasks, answered from landed tables: jobs, datasets, logs, funnels; and the list of tools that ask them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.scalars import hrefs
from tidegraph.operators import compare, docs, graph, logs, telemetry
from tidegraph.operators.classify import site_list
from tidegraph.sources import files

# fixed values: links read of an error text; a job's log; which datasets are asked for by default
LINKS = 5
LOG = "payload.stdout"
INPUTS = ("input", "pseudo_input")


def envelope(status: Column, body: Column) -> Column:
    """struct(data, error: JSON text and message) of a service's answer: an error where the transport failed (status not 0) or the answer doesn't say success."""
    parsed = F.from_json(body, "success boolean, message string")
    data = F.get_json_object(body, "$.data")
    failed = F.when(status != 0, F.concat(F.lit("connection error: "), F.coalesce(body, F.lit("")))).when(F.try_parse_json(body).isNull() | parsed.isNull(), body).when(~F.coalesce(parsed["success"], F.lit(False)), F.coalesce(parsed["message"], F.lit("unknown error")))
    return F.struct(F.when(failed.isNull(), data).alias("data"), failed.alias("error"))


def fetched(responses: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """responses (task_id, status, body) -> (task_id and the record of each that succeeded, task_id and error of the others)."""
    told = responses.withColumn("e", envelope(F.col("status"), F.col("body")))
    return told.filter("e.error is null").select("task_id", F.from_json("e.data", schema).alias("r")).select("task_id", "r.*"), told.filter("e.error is not null").select("task_id", "e.error")


def jobs_of(jobs: DataFrame, tasks: DataFrame, unsuccessful_only: bool = False) -> DataFrame:
    """Jobs of the tasks (task_id), all or only those that failed, were cancelled or closed."""
    rows = jobs.join(tasks.select("task_id").distinct(), "task_id", "left_semi")
    return rows.filter(F.col("status").isin(*telemetry.UNSUCCESSFUL)) if unsuccessful_only else rows


def datasets_of(entries: DataFrame, tasks: DataFrame, types: Sequence[str] = INPUTS, dataset_only: bool = False) -> DataFrame:
    """entries (task_id, dataset_id, dataset, type, file) -> one row per dataset of the tasks: its name and, unless dataset_only, its files, sorted."""
    rows = entries.join(tasks.select("task_id").distinct(), "task_id", "left_semi").filter(F.col("type").isin(*types))
    names = [F.min("dataset").alias("dataset")]
    return rows.groupBy("task_id", "dataset_id", "type").agg(*names, *([] if dataset_only else [F.array_sort(F.collect_set("file")).alias("files")]))


def job_logs(jobs: DataFrame, logs_: DataFrame, filename: str = LOG) -> DataFrame:
    """jobs (job_id) with the text of a log file of theirs, logs_ (job_id, filename, text); null where there is none."""
    return jobs.join(logs_.filter(F.col("filename") == filename).select("job_id", "text"), "job_id", "left")


def log_url(base: str, job_id: Column, filename: str = LOG) -> Column:
    """Where a job's log file is kept."""
    return F.concat(F.lit(f"{base}/filebrowser/?pandaid="), job_id.cast("string"), F.lit(f"&json&filename={filename}"))


def first_jobs(jobs: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Per task the first job of these statuses: task_id, job_id."""
    return jobs.filter(F.col("status").isin(*statuses)).groupBy("task_id").agg(F.min("job_id").alias("job_id"))


def log_summaries(jobs: DataFrame, logs_: DataFrame, filename: str = LOG) -> DataFrame:
    """jobs (job_id, ...) -> their columns, filename, and the summary of each log; a log that isn't there is empty: no lines."""
    texts = job_logs(jobs, logs_, filename)
    told = logs.summarise(logs.split_lines(texts, "text", "job_id"), "job_id")
    out = jobs.join(told, "job_id", "left").withColumn("filename", F.lit(filename))
    none = F.array().cast("array<string>")
    return out.withColumns({"total_lines": F.coalesce("total_lines", F.lit(0)), "total_chars": F.coalesce("total_chars", F.lit(0)), "sections_seen": F.coalesce("sections_seen", none), "error_lines": F.coalesce("error_lines", none), "tail_raw": F.coalesce("tail_raw", F.lit(""))})


def failed_log_summaries(tasks: DataFrame, jobs: DataFrame, logs_: DataFrame, filename: str = LOG) -> DataFrame:
    """Per task the summary of its first unsuccessful job's log, or an error where it has none."""
    found = log_summaries(first_jobs(jobs, telemetry.UNSUCCESSFUL), logs_, filename)
    out = tasks.select("task_id").distinct().join(found, "task_id", "left")
    return out.withColumn("error", F.when(F.col("job_id").isNull(), "no failed jobs found"))


def linked_logs(tasks: DataFrame, texts: DataFrame) -> DataFrame:
    """tasks (task_id, error) and texts (url, text) -> task_id, place, url, text of the first links in each error; those without text are left out."""
    links = tasks.select("task_id", F.posexplode(F.slice(hrefs(F.col("error")), 1, LINKS)).alias("place", "url"))
    return links.join(texts.filter(F.length("text") > 0), "url")


def embedded_logs(tasks: DataFrame, texts: DataFrame) -> DataFrame:
    """tasks (task_id, error, label) -> task_id, url, text: each linked log through the filter that its task's label asks for."""
    found = linked_logs(tasks, texts).join(tasks.select("task_id", logs.log_source(F.col("label")).alias("source")), "task_id").withColumn("log_id", F.concat_ws(" ", F.col("task_id").cast("string"), "url"))
    told = logs.filter_auto(logs.split_lines(found), found.select("log_id", "source"))
    return found.select("task_id", "url", "log_id").join(told, "log_id").drop("log_id")


def funnels(tasks: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stages by task_id and url of each linked log with a funnel, what became there of the task's sites: site, includedSite)."""
    found = linked_logs(tasks, texts).withColumn("log_id", F.concat_ws(" ", F.col("task_id").cast("string"), "url"))
    stages, fates = logs.parse_funnel(logs.split_lines(found))
    names = found.select("log_id", "task_id", "url")
    asked = tasks.select("task_id", F.explode(site_list(F.col("site"), F.col("includedSite"))).alias("site"))
    return names.join(stages, "log_id").drop("log_id"), names.join(fates, "log_id").join(asked, ["task_id", "site"], "left_semi").drop("log_id")


def compared_logs(tasks: DataFrame, jobs: DataFrame, logs_: DataFrame) -> DataFrame:
    """tasks (task_id, reference_id) -> the first unsuccessful job's log against the first finished job's of the reference, or an error."""
    told = compare.job_log_pairs(jobs, logs_, tasks)
    found = compare.compare_logs(told.filter("error is null"))
    return told.select("pair_id", "error").join(found, "pair_id", "left").withColumnRenamed("pair_id", "task_id")


@dataclass(frozen=True)
class Tool:
    """A question that can be asked of landed tables."""

    name: str
    description: str
    ask: Callable[..., object]
    requires_interaction: bool = False
    read_only: bool = True


#: The tools, by name; the first of a name holds.
TOOLS = {
    t.name: t
    for t in reversed(
        (
            Tool("fetch_linked_log_files", "logs linked in a task's error text", linked_logs),
            Tool("get_parent_task", "the task that a task was a retry of", graph.parent_task),
            Tool("get_retry_chain", "the tasks before a task, up to three", graph.retry_chain),
            Tool("get_task_jobs_summary", "a task's jobs by status, and their most frequent errors", telemetry.job_summary),
            Tool("get_scout_job_details", "scouts and jobs of each error code", telemetry.sample_jobs),
            Tool("get_task_input_datasets", "a task's input datasets", datasets_of),
            Tool("find_similar_successful_tasks", "tasks like a task that ended well", files.similar_tasks),
            Tool("get_failed_job_log_summary", "the summary of a failed job's log", failed_log_summaries),
            Tool("compare_failed_vs_successful_job_logs", "a failed job's log against a successful one's", compared_logs),
            Tool("summarize_job_log", "the summary of a job's log", log_summaries),
            Tool("search_panda_server_source", "lines of source code where all words stand together", logs.keyword_windows),
            Tool("search_panda_docs", "documentation by words", docs.bm25),
            Tool("fetch_brokerage_context", "candidate funnels in a task's linked logs", funnels),
            Tool("fetch_cli_options", "options of a command by their help text", lambda help_texts, component: help_texts.filter(F.col("component") == component)),
            Tool("request_human_input", "an answer that a person gave", lambda answers, question: answers.filter(F.col("question") == question), True),
            Tool("find_causes_for_symptom", "causes that a symptom leads to", graph.causes_of_symptom),
            Tool("find_procedures_for_cause", "procedures that investigate a cause", graph.procedures_of_cause),
        )
    )
}


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
