"""The driver's tables as graphs, vectors, jobs, samples, logs and documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))


#: Kinds of clues: the column that names them, their relation, and when there is one.
CLUES = {"Symptom": ("o_orderpriority", "indicate", "true"), "Task_Feature": ("p_type", "contribute_to", "true"), "Environment": ("n_name", "contribute_to", "true"), "Component": ("s_name", "originated_from", "l_returnflag = 'R'")}


def edge_observations(spark: SparkSession, sf_dir: str, only: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Line items as observations: clues of an order, part and supplier lead to the part's brand; the order is the graph.

    only: names by kind; others are dropped before a line item is spread to a row for each clue.
    """
    clue = lambda kind, name, rel, when: F.when(F.expr(when) & (F.col(name).isin(*only.get(kind, ())) if only is not None else F.lit(True)), F.struct(F.lit(kind).alias("src_type"), F.col(name).alias("src"), F.lit(rel).alias("rel")))
    clues = F.array_compact(F.array(*(clue(kind, *how) for kind, how in CLUES.items())))
    rows = _joined(spark, sf_dir).withColumn("clues", clues).filter("size(clues) > 0")
    return rows.select(F.explode("clues").alias("c"), "p_brand", "l_orderkey", "l_discount", "l_linenumber", "l_partkey", "l_suppkey").select("c.*", F.lit("Cause").alias("tgt_type"), F.col("p_brand").alias("tgt"), F.col("l_orderkey").cast("string").alias("graph_id"), F.col("l_discount").alias("confidence"), F.lit(None).cast("string").alias("parameters"), (F.col("l_linenumber") * 10**14 + F.col("l_partkey") * 10**7 + F.col("l_suppkey")).alias("seq"))


def first_clues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clue_type, clue: the first of each kind by name."""
    least = _joined(spark, sf_dir).agg(*(F.min(F.when(F.expr(when), F.col(name))).alias(kind) for kind, (name, _, when) in CLUES.items()))
    return least.select(F.explode(F.array(*(F.struct(F.lit(k).alias("clue_type"), F.col(k).alias("clue")) for k in CLUES))).alias("c")).select("c.*").filter("clue is not null")


def causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands with how often they were ordered and their mean discount."""
    line, part = table(spark, sf_dir, "lineitem").select("l_partkey", "l_discount"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("frequency"), F.round(F.avg("l_discount"), 6).alias("confidence"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with their label as section."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("section"), (F.col("vec_id") % 97).alias("graph_id"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs: a user's task, an event's type as status, the type's letters as diagnoses."""
    e = table(spark, sf_dir, "events")
    low = F.col("event_type").isin("click", "view")
    return e.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("job_id"), F.when(low, "failed").otherwise(F.col("event_type")).alias("status"), F.when(F.col("event_type") == "click", F.col("props")).otherwise("").alias("pilot_error"), F.when(F.col("value") > 50, "slow").alias("ddm_error"), F.lit("other").alias("exe_error"), (F.col("event_id") % 3).alias("error_code"), (F.col("event_id") % 4 == 0).alias("is_scout"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as accelerator samples: a user's host, the hour of its events as offsets, the value as load."""
    e = table(spark, sf_dir, "events")
    n = lambda c: c.cast("int")
    return e.select(F.col("user_id").alias("host"), F.col("event_id").alias("seq"), F.col("event_id").alias("offset_s"), n(F.col("event_id") % 4).alias("idx"), n(F.floor("value")).alias("sm"), n(F.floor(F.col("value") / 2)).alias("membw"), F.lit(80).alias("total"), n(F.floor("value")).alias("used"), n(80 - F.floor("value")).alias("free"), F.col("event_type").alias("state"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents, as logs."""
    from tidegraph.operators.logs import split_lines

    return split_lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("log_id"), "text"))


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lines for each event, in its user's log: a marker, a line with a time, and an error, a blank or `ok`."""
    e = table(spark, sf_dir, "events")
    third = F.when(F.col("value") > 60, F.concat(F.lit("ERROR: value "), "event_id")).when(F.col("value") < 10, "  ").otherwise("ok")
    lines = F.array(F.concat(F.lit("=== "), "event_type", F.lit(" ===")), F.concat(F.lit("2024-01-01 10:00:"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"), F.lit(" value "), F.floor("value").cast("string")), third)
    return e.select(F.col("user_id").alias("log_id"), "event_id", F.posexplode(lines).alias("j", "line")).select("log_id", (F.col("event_id") * 3 + F.col("j")).alias("line_no"), "line")


def brokerage_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of a candidate funnel for each customer: a -> b -> c candidates."""
    k = F.col("c_custkey")
    a, b, c = (50 + k % 50).cast("string"), (20 + k % 20).cast("string"), (5 + k % 5).cast("string")
    stamp = F.lit("2024-01-01 10:00:00 : ")
    lines = F.array(
        F.concat(stamp, F.lit("initial "), a, F.lit(" candidates")), F.concat(stamp, F.lit("  skip site=S"), k % 7, F.lit(" too small criteria=-memory")), F.concat(stamp, b, F.lit(" candidates passed memory check")),
        F.concat(stamp, F.lit("  skip site=S"), (k + 1) % 7, F.lit(" busy criteria=-busy")), F.concat(stamp, c, F.lit(" candidates for final check")), F.lit("===== Job brokerage summary ====="),
        F.concat(F.lit("  "), a, F.lit(" -> "), b, F.lit(" candidates,  60% cut : memory")), F.concat(F.lit("  "), b, F.lit(" -> "), c, F.lit(" candidates,  75.5% cut : busy")), F.concat(stamp, F.lit("the number of final candidates: "), c),
    )
    dealt = table(spark, sf_dir, "customer").select("c_custkey").hint("rebalance")  # else a small file is one task, whatever its lines
    return dealt.select(k.alias("log_id"), F.posexplode(lines).alias("line_no", "line"))
