"""Operator 9: token ids as ORC files, in ascending document order.

Texts are range-partitioned and sorted by document id, then encoded, so that
file order is id order. The files hold `doc_id`, `part`, `part_start`, `n_tokens` and
`ids`; ORC writes integers in its run-length encoding, keeps a row index, and
a Bloom filter on the document id. Readers take stripes in parallel,
and look-ups by id skip stripes and row groups by these.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import shared_path
from .tokens import id_bytes, slices

#: ORC settings: stripes of 32 MB, a row index and Bloom filter entry for each 1,000 documents.
ORC = {
    "compression": "zstd",
    "orc.stripe.size": str(32 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def write_ids(df: DataFrame, path: str, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every whole text, each followed by `end_id`, to ORC files at `path`.

    A null or empty text gives `end_id` alone. Null document ids come first, rows with equal ids
    stay separate in any order and can go to several files, an empty table gives files without rows. Other columns are dropped.
    A task holds a few MB of texts and their ids at a time.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, start = id_bytes(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for rows in slices(batch, "text"):
                found = [x + end for x in ids_of([x or "" for x in rows.column("text").to_pylist()])]
                sizes = np.array([len(x) // 4 for x in found], np.int64)
                before = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.full(len(sizes), part), pa.int32()), pa.array(before), pa.array(sizes), ids], ["doc_id", "part", "part_start", "n_tokens", "ids"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # the tie column splits rows with one id over tasks
    laid = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    laid.mapInArrow(encode, "doc_id long, part int, part_start long, n_tokens long, ids array<int>").write.options(**ORC).orc(path)


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows with `start`, the ids of all documents before. `doc_ids` is pushed down to the files' indexes."""
    files = spark.read.schema("doc_id long, part int, part_start long, n_tokens long, ids array<int>").orc(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per written file, whatever the number of documents
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    found = files if doc_ids is None else files.where(F.col("doc_id").isin(doc_ids))
    return found.join(F.broadcast(parts), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def ids_crc32(df: DataFrame) -> DataFrame:
    """`doc_id`, `start`, the number of ids, and their unsigned crc32 as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            crc = pa.array([zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at).astype(np.int64)), crc], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return df.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document with their place in the whole order, read back from the ORC files; see `write_ids`."""
    import public_tokenizers

    path = shared_path(spark, "ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), 0)
    return ids_crc32(read_ids(spark, path))
