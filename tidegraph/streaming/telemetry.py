"""Streams of samples and events: windows with late data, keyed state, replay of files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidegraph.functions.workers import ready, shared_dir


def replay(spark: SparkSession, path: str, schema: str | StructType, files: int = 1, only: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder as a stream, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", only).parquet(path)


def to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there now and returns what it wrote, as a table in the shared folder.

    Complete results replace the table with each batch; appended rows go to a folder of their batch, written again
    as a whole when a batch is repeated.
    """
    spark = stream.sparkSession
    ready(spark)
    path = shared_dir(spark)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={n}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").select(*stream.columns)


def event_windows(events: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """events (ts, event_type, value) -> counts and sums of tumbling windows; later data than the watermark is left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def state_changes(samples: DataFrame, timeout: str = "NoTimeout") -> DataFrame:
    """samples (host, seq, state) -> a row (host, seq, before, state) whenever a host's state is another than before.

    The last state of each host is kept between batches; rows of a batch are taken in the order of seq.
    """

    ready(samples.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, now in zip(rows["seq"], rows["state"], strict=True):
            if now != before:
                out.append((key[0], int(seq), before, now))
                before = now
        state.update((before,))
        yield pd.DataFrame(out, columns=["host", "seq", "before", "state"])

    return samples.groupBy("host").applyInPandasWithState(run, "host string, seq long, before string, state string", "last string", "append", getattr(GroupStateTimeout, timeout))


def posts(raw: DataFrame, channels: list[str], me: str) -> DataFrame:
    """Chat events as JSON text -> thread, author, text: only posts of the allowed channels that aren't our own."""
    body = F.from_json("value", "event string, data struct<channel:string,user:string,root_id:string,id:string,message:string>")
    rows = raw.select(body.alias("b")).filter("b.event = 'posted'").select("b.data.*")
    return rows.filter(F.col("channel").isin(*channels) & (F.col("user") != me)).select(F.coalesce(F.nullif("root_id", F.lit("")), "id").alias("thread"), F.col("user").alias("author"), F.col("message").alias("text"))
