"""Reading and writing what the engine works on: JSON folders, lists, logs, snapshots, sample files."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.scalars import safe_filename

#: Columns that may hold a task's number, in the order of preference.
ID_COLUMNS = ("task_id", "taskid", "id", "task")


def read_json_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All *.json files of a folder, one record each, with file; malformed files are skipped."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("file", F.input_file_name()).filter("_corrupt_record is null").drop("_corrupt_record")


def read_id_list(spark: SparkSession, path: str, names: Sequence[str] = ID_COLUMNS) -> DataFrame:
    """A CSV with a header -> task_id, from the first column of a known name whatever its case."""
    rows = spark.read.option("header", True).csv(path)
    known = {c.lstrip("\ufeff").strip().lower(): c for c in rows.columns}
    column = next((known[n] for n in names if n in known), None)
    if column is None:
        raise ValueError(f"none of {', '.join(names)} among {', '.join(rows.columns)}")
    return rows.select(F.col(f"`{column}`").try_cast("long").alias("task_id")).filter("task_id is not null")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Whole log files, plain or .gz -> log_id (path), text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("log_id"), F.col("value").alias("text"))


def linked_logs(tasks: DataFrame, logs: DataFrame, most: int = 5) -> DataFrame:
    """The first links in each task's error text, joined to logs (url, text); missing and empty logs are dropped."""
    from tidegraph.functions.scalars import hrefs

    links = tasks.select("task_id", F.posexplode(F.slice(hrefs(F.col("error")), 1, most)).alias("place", "url"))
    return links.join(logs.filter(F.length("text") > 0), "url")


def similar_tasks(tasks: DataFrame, like: Mapping[str, object], fields: Sequence[str], since: str | None = None, most: int = 50) -> DataFrame:
    """Tasks that ended well and equal a task in those fields that it has, newest first, those without a time last."""
    out = tasks.filter(F.col("status").rlike("finished|done"))
    for f in fields:
        if like.get(f) is not None:
            out = out.filter(F.col(f) == F.lit(like[f]))
    if since is not None:
        out = out.filter(F.col("modified") >= F.lit(since))
    return out.orderBy(F.desc_nulls_last("modified"), "task_id").limit(most)


def write_snapshot(tables: Mapping[str, DataFrame], path: str, **about: object) -> dict:
    """Every table as Parquet under path, by name, and a manifest with schemas, which is returned."""
    spark = next(iter(tables.values())).sparkSession
    manifest = {"tables": {}, **about}
    for name in sorted(tables):
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
        manifest["tables"][name] = tables[name].schema.jsonValue()
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def read_snapshot(spark: SparkSession, path: str, dimension: int | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot; a snapshot of vectors of another length is refused."""
    manifest = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()[0])
    if dimension is not None and manifest.get("dimension") not in (None, dimension):
        raise ValueError(f"the snapshot's vectors have {manifest['dimension']} numbers, not {dimension}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}


def write_results(results: DataFrame, path: str, name: str = "label") -> DataFrame:
    """results (label, ok, ...) as JSON by safe file name, errors apart; returns counts: ok, novel, failed, exit_code."""
    named = results.withColumn("file", safe_filename(F.col(name)))
    named.filter("ok").write.mode("overwrite").partitionBy("file").json(f"{path}/results")
    named.filter("not ok").write.mode("overwrite").partitionBy("file").json(f"{path}/errors")
    failed = F.count_if(~F.col("ok"))
    return results.agg(F.count_if(F.col("ok") & ~F.col("novel")).alias("ok"), F.count_if(F.col("ok") & F.col("novel")).alias("novel"), failed.alias("failed"), (failed > 0).cast("int").alias("exit_code"))


def write_samples(samples: DataFrame, path: str) -> None:
    """Samples as tab-separated lines with a header; nulls are empty."""
    samples.write.mode("append").option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)
