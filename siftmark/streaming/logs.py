"""Streams over file sources (ST1, ST3, ST6, ST8, ST9)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Events of Parquet files as they come (ST3)."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def log_sink(logs: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append micro-batches of logs with their byte cost (ST1). A slow sink holds the source back; nothing is dropped.

    Batches are written under their number, so one that is run again after a failure replaces itself. Without an
    interval, what is there is written and the query ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        sized = batch.withColumn("bytes", (F.octet_length("props") + F.octet_length("event_type") + 8).cast("long"))
        sized.write.mode("overwrite").parquet(f"{path}/batch={number}")

    to = logs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (to.trigger(processingTime=interval) if interval else to.trigger(availableNow=True)).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by kind and window of event time; later than the watermark is late."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")


def open_items(events: DataFrame) -> DataFrame:
    """user_id, begin_id, end_id: a begin event with the end that follows it, across batches (ST9, ST6).

    The state of a user is the begin event that is still open.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("event_id")
        begin = state.get[0] if state.exists else None
        out = []
        for id, kind in zip(rows["event_id"], rows["event_type"], strict=True):
            if kind == "click":
                begin = int(id)
            elif kind == "purchase" and begin is not None:
                out.append((key[0], begin, int(id)))
                begin = None
        state.update((begin,)) if begin is not None else state.remove()
        yield pd.DataFrame(out, columns=["user_id", "begin_id", "end_id"]).astype("int64")

    kinds = events.where(F.col("event_type").isin("click", "purchase"))
    return kinds.groupBy("user_id").applyInPandasWithState(run, "user_id long, begin_id long, end_id long", "begin_id long", "append", GroupStateTimeout.NoTimeout)


def standing(steps: DataFrame) -> DataFrame:
    """user_id, level (from 1), items, first_id, last_id of the turns that stand after all steps (user_id, event_id, step: 1 begins a turn, -1 takes the
    last one back, 0 belongs to it).

    Turns are a stack, so running sums give each event its level: how many turns are open. A level's events between two
    beginnings are one turn; it stands if nothing ends it. What is kept of a user is two running numbers, not their events.
    """
    at = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = steps.select("user_id", "event_id", "step").withColumn("sum", F.sum("step").over(at))
    # what is taken back without a turn changes nothing
    levels = summed.withColumn("level", F.col("sum") - F.least(F.lit(0), F.min("sum").over(at)))
    undone = (F.col("step") == -1).cast("int")
    # a step back belongs to the level that it ends; at the bottom it may have had nothing to end
    own = levels.withColumn("level", F.col("level") + undone).where("level > 0")
    inside = Window.partitionBy("user_id", "level").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = own.withColumn("turn", F.sum(F.when(F.col("step") == 1, 1).otherwise(0)).over(inside)).where("turn > 0")
    kept = numbered.groupBy("user_id", "level", "turn").agg(F.count(F.when(F.col("step") >= 0, 1)).alias("items"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.max(undone).alias("undone")).where("undone = 0")
    return kept.select("user_id", "level", "items", "first_id", "last_id")


def turns(events: DataFrame) -> DataFrame:
    """user_id, turn, items, first_id, last_id of a batch of events (ST8): a signup begins a turn, an error takes the last one back."""
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return standing(events.withColumn("step", step)).select("user_id", (F.col("level") - 1).cast("long").alias("turn"), "items", "first_id", "last_id")
