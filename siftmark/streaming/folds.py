"""Streams with state across batches: a fold of events by field (ST6), pairs of two streams (ST9), and replacement by key (ST12)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.snapshots import Snapshots

METADATA = "user_id long, last_type string, first_type string, last_purchase double, first_signup string, events long"
#: Where transformWithState keeps its values.
PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Metadata(StatefulProcessor):
    """One value state per field: what it holds and the event that it is from, so that events may come in any order."""

    # field, its column, the kind of events that it is taken from (any: None), and whether the last one wins
    FIELDS = (("last_type", "event_type", None, True), ("first_type", "event_type", None, False), ("last_purchase", "value", "purchase", True), ("first_signup", "props", "signup", False))
    TYPES = {"event_type": "string", "value": "double", "props": "string"}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fields = {name: handle.getValueState(name, f"held {self.TYPES[column]}, at long") for name, column, _, _ in self.FIELDS}
        self.events = handle.getValueState("events", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        n = self.events.get()[0] if self.events.exists() else 0
        best = {name: tuple(state.get()) if state.exists() else None for name, state in self.fields.items()}
        for batch in rows:
            n += len(batch)
            for name, column, kind, last in self.FIELDS:
                own = batch if kind is None else batch[batch["event_type"] == kind]
                if len(own):
                    row = own.loc[own["event_id"].idxmax() if last else own["event_id"].idxmin()]
                    at = int(row["event_id"])
                    if best[name] is None or (at > best[name][1] if last else at < best[name][1]):
                        held = row[column]
                        best[name] = None if pd.isna(held) else held, at
        for name, found in best.items():
            if found is not None:
                self.fields[name].update(found)
        self.events.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], **{name: [found[0] if found else None] for name, found in best.items()}, "events": [n]})

    def close(self) -> None:
        pass


def metadata_stream(events: DataFrame, table: Snapshots, checkpoint: str) -> StreamingQuery:
    """Fold a stream of events into each thread's metadata (METADATA), kept up to date in `table`. What is there is read, and the query ends; the next one goes on from its state."""
    folded = events.groupBy("user_id").transformWithStateInPandas(_Metadata(), METADATA, "Update", "None")
    return keyed_stream(folded, table, checkpoint, "metadata", "update")


def keyed_stream(rows: DataFrame, table: Snapshots, checkpoint: str, writer: str, mode: str = "append", newest: str | None = None) -> StreamingQuery:
    """Replace the rows of each batch's keys in `table` (ST12). A batch that is replayed after a failure is committed once."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            table.replace(kept.select(table.key), kept, writer, number, newest)
        finally:
            kept.unpersist()

    return rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def paired_streams(begins: DataFrame, ends: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """call, begin_id, end_id: ends (call, end_id, end_ts) joined to the begins (call, begin_id, begin_ts) of their call at most `within` before (ST9).

    Both sides are kept only as long as the other's watermark leaves a partner possible.
    """
    a, b = begins.withWatermark("begin_ts", late), ends.withWatermark("end_ts", late).withColumnRenamed("call", "_call")
    met = (F.col("call") == F.col("_call")) & (F.col("end_ts") >= F.col("begin_ts")) & (F.col("end_ts") <= F.col("begin_ts") + F.expr(f"interval {within}"))
    return a.join(b, met).select("call", "begin_id", "end_id")
