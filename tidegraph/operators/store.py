"""Tables as stores: inserts, lookups, removal, drafts, archives, session logs; and where they are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.registry import Registry
from tidegraph.operators.records import same_email


class Parquet:
    """Tables as folders of Parquet files below one path, which may be in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        at, fs = self._at(name)
        return fs.exists(at)

    def ensure(self, name: str, schema: str) -> bool:
        """Makes an empty table unless there is one; whether it was made."""
        if self.exists(name):
            return False
        self.clear(name, schema)
        return True

    def clear(self, name: str, schema: str) -> None:
        """An empty table in place of what is there."""
        self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> bool:
        """Removes tables; whether any was there."""
        found = False
        for name in names:
            at, fs = self._at(name)
            found = fs.delete(at, True) or found
        return found

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")

    def replace(self, name: str, rows: DataFrame) -> None:
        """rows in place of the table; rows may come from the table itself, for they are written beside it first."""
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}.new")
        self.drop(name)
        at, fs = self._at(name)
        fs.rename(self._at(f"{name}.new")[0], at)


#: Where tables are kept, by name: makers from a session and a path.
STORES = Registry("store")
STORES.register("parquet", Parquet, "folders of Parquet files")

#: How a task's material becomes a graph, by name: functions of DataFrames to (nodes, edges).
STRATEGIES = Registry("extraction strategy")

DOC_TABLES = ("panda_docs", "panda_docs_meta", "doc_node_cache")


def invalidate_docs(store: Parquet) -> bool:
    """Drops the document index, its metadata and its cache; whether anything was there."""
    return store.drop(*DOC_TABLES)


def create_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes with all of new, repeated or not: those without an id get one, and maps become JSON text."""
    maps = {c: F.to_json(c) for c, t in new.dtypes if t.startswith("map<")}
    given = F.coalesce(F.nullif("id", F.lit("")), F.uuid()) if "id" in new.columns else F.uuid()
    return nodes.unionByName(new.withColumns({**maps, "id": given}), allowMissingColumns=True)


def clear_all(table: DataFrame) -> DataFrame:
    """The table without its rows."""
    return table.limit(0)


def get_by_id(points: DataFrame, id_: str) -> DataFrame:
    """The one point of an id, or none."""
    return points.filter(F.col("id") == id_).limit(1)


def delete_by_id(points: DataFrame, ids: DataFrame) -> DataFrame:
    """points without those of ids (id)."""
    return points.join(ids.select("id").distinct(), "id", "left_anti")


def merge_descriptions(stored: DataFrame, new: DataFrame, merge: Callable[[Column, Column], Column]) -> DataFrame:
    """new nodes (node_type, name, description) with what `merge` makes of a procedure's stored and new description, where both are there and differ."""
    known = stored.filter("node_type = 'Procedure' and description is not null").select("name", F.col("description").alias("__old")).dropDuplicates(["name"])
    some = (F.col("node_type") == "Procedure") & (F.coalesce("description", F.lit("")) != "") & F.col("__old").isNotNull()
    return new.join(known, "name", "left").withColumn("description", F.when(some & (F.trim("__old") != F.trim("description")), merge(F.col("__old"), F.col("description"))).otherwise(F.col("description"))).drop("__old").select(*new.columns)


def drafts(tasks: DataFrame, canonical: DataFrame, created: str, key: str = "error") -> DataFrame:
    """tasks (task_id, error, task: map, body) -> one unreviewed draft per error: its first task, all task ids, and its canonical label (error, label)."""
    by = tasks.groupBy(F.col(key).alias("error")).agg(F.array_sort(F.collect_set("task_id")).alias("task_ids"), F.min_by("task", "task_id").alias("task_data"), F.min_by("body", "task_id").alias("email_body"), F.min("task_id").alias("task_id"))
    told = by.join(canonical.select("error", F.col("label").alias("errorDialog_canonical")), "error", "left")
    return told.withColumns({"reviewed": F.lit(False), "matched_from": F.lit(None).cast("string"), "errorDialog_canonical": F.coalesce("errorDialog_canonical", F.lit("")), "created_at": F.lit(created)})


def novel_drafts(results: DataFrame, created: str) -> DataFrame:
    """results (task_id, task: map, root_cause, resolution, explanation, hints, unmatched) of incidents without a precedent -> unreviewed drafts."""
    body = F.struct(F.col("explanation").alias("background"), F.col("root_cause").alias("cause"), "resolution", F.coalesce("hints", F.array().cast("array<string>")).alias("procedure"))
    hint = F.concat(F.lit("Novel incident — unmatched symptoms: "), F.array_join("unmatched", ", "), F.lit(". Verify root cause and resolution are correct before approving."))
    return results.select("task_id", F.array("task_id").alias("task_ids"), F.col("task").alias("task_data"), F.coalesce(F.col("task")["errorDialog"], F.lit("")).alias("errorDialog_canonical"), body.alias("email_body"), hint.alias("review_hint"), F.lit(False).alias("reviewed"), F.lit(None).cast("string").alias("matched_from"), F.lit(created).alias("created_at"))


def archive(drafts_: DataFrame, approved: DataFrame, stamp: str, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Drafts (task_id, matched_from, email_body, error) to be added to approved entries (file, email_body): file, and reviewed.

    A draft that was filled in from an entry and still says the same isn't archived; one whose source is gone is. A file name
    that is taken gets a time stamp.
    """
    source = approved.select(F.col("file").alias("matched_from"), F.col("email_body").alias("__source")).dropDuplicates(["matched_from"])
    same = F.col("matched_from").isNotNull() & F.col("__source").isNotNull() & same_email(F.col("email_body"), F.col("__source"))
    kept = drafts_.join(source, "matched_from", "left").filter(~F.coalesce(same, F.lit(False))).drop("__source")
    name = F.concat(F.lit("task_"), F.col("task_id").cast("string"))
    taken = approved.select("file").distinct().withColumn("__taken", F.lit(True))
    out = kept.withColumn("file", F.concat(name, F.lit(".json"))).join(taken, "file", "left")
    out = out.withColumn("file", F.when(F.col("__taken"), F.concat(name, F.lit(f"_{stamp}.json"))).otherwise(F.col("file"))).drop("__taken").withColumn("reviewed", F.lit(True))
    return out if embed is None else out.withColumn("embedding", embed(F.col("error")))


def approved_entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Approved drafts of a folder of JSON files that have an embedding, with their file; malformed files are skipped."""
    from tidegraph.sources.files import read_json_folder

    return read_json_folder(spark, path, schema).filter("errorDialog_embedding is not null")


def asked_errors(rows: DataFrame) -> DataFrame:
    """rows of an evaluation's input (a column errorDialog, jediTaskID or taskID, the first that is there) -> value, is_task: whether all of the first five are task numbers."""
    column = next((c for c in ("errorDialog", "jediTaskID", "taskID") if c in rows.columns), rows.columns[0])
    told = rows.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value"))
    first = [r["value"] for r in told.limit(5).collect()]
    return told.withColumn("is_task", F.lit(bool(first) and all(x.strip().isdigit() for x in first)))


def log_turns(turns: DataFrame, path: str) -> None:
    """Turns of sessions as JSON lines, added to what is there."""
    turns.write.mode("append").json(path)
