"""Operator 10: best-fit packing of token sequences by hierarchical residual rounds.

Documents become pieces of at most `capacity` tokens. Partitions pack their
pieces best-fit, longest first. Bins that are nearly full are done; the others go
on as items of the next round, where fewer, larger groups of them are packed in
the same way, up to one group. Only lengths travel, and a group's size is bounded,
so no round needs a large task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize
from .tokens import id_bytes, slices

#: Items of a group in a round, and the free share of a bin that is nearly full.
GROUP = 40_000
FULL = 0.005
#: Bits of an item's number within its partition, of a bin's number within its group, and of its round.
ITEM_BITS, BIN_BITS, LEVEL_BITS = 40, 18, 10


def bin_ids(level: int, group: int, bins: np.ndarray) -> np.ndarray:
    """Ids of a group's bins: negative, while items are not, and different for every round, group (up to 2^34) and bin."""
    if level >> LEVEL_BITS or group >> (62 - LEVEL_BITS - BIN_BITS) or (len(bins) and int(bins.max()) >> BIN_BITS):
        raise ValueError(f"no id for a bin of round {level}, group {group}")
    return -1 - ((((group << BIN_BITS) + bins) << LEVEL_BITS) + level)


def first_item(partition: int) -> int:
    return partition << ITEM_BITS


def token_pieces(df: DataFrame, capacity: int, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every whole text's ids followed by `end_id`: item, doc_id, piece, start, length, ids_crc32.

    Only documents longer than `capacity` are cut. A null or empty text is `end_id` alone. Every row has pieces
    of its own, also rows that repeat a document id; `item` tells them apart.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, item = id_bytes(vocabulary), first_item(TaskContext.get().partitionId())
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for rows in slices(batch, "text"):
                out: list[tuple] = []
                found = ids_of([x or "" for x in rows.column("text").to_pylist()])
                for doc, ids in zip(rows.column("doc_id").to_pylist(), found, strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        out.append((item + len(out), doc, piece, at // 4, len(own) // 4, zlib.crc32(own)))
                item += len(out)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["item", "doc_id", "piece", "start", "length", "ids_crc32"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = rows.mapInArrow(encode, "item long, doc_id long, piece long, start long, length long, ids_crc32 long")
    return out.withColumn("piece", F.col("piece").cast("int"))


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, in the order given, and each bin's fill. An item goes where it leaves the least room.

    Bins wait by their room; a bit set of the rooms that occur finds the least that is enough.
    """
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    fills: list[int] = []
    bins, offsets = [], []
    for n in lengths:
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins.append(b)
        offsets.append(fills[b])
        fills[b] += n
        if room > n:
            waiting[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, fills


def _round(items: DataFrame, groups: int, level: int, capacity: int, seed: int) -> DataFrame:
    """item, bin, at, fill: items dealt into `groups` groups, each packed best-fit, longest first."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if tables:
            rows = pa.Table.from_batches(tables)
            bins, offsets, fills = best_fit(rows.column("length").to_pylist(), capacity)
            where = np.array(bins, np.int64)
            out = [rows.column("item").combine_chunks(), pa.array(bin_ids(level, TaskContext.get().partitionId(), where)), pa.array(np.array(offsets, np.int64)), pa.array(np.array(fills, np.int64)[where])]
            for batch in pa.Table.from_arrays(out, ["item", "bin", "at", "fill"]).to_batches(10_000):
                yield batch

    dealt = items.withColumn("_deal", F.xxhash64("item", F.lit(seed))).repartition(groups, "_deal")
    ordered = dealt.sortWithinPartitions(F.desc("length"), "item").select("item", "length")
    return ordered.mapInArrow(pack, "item long, bin long, at long, fill long")


def pack_pieces(pieces: DataFrame, capacity: int = 2048, seed: int = 11) -> DataFrame:
    """`pieces` (item, length, ...) with `sequence_id` (long) and `offset` (long), gapless from 0 in each sequence.

    Lengths are 1 to `capacity`, items are different and not negative. A full piece's sequence has its item's id, all others negative ones. Equal lengths are told apart by `item`, so a lost task
    packs the same way again. An empty table gives no rows.
    """
    length = F.col("length")
    whole = pieces.where(length == capacity).select("item", F.col("item").alias("bin"), F.lit(0).cast("long").alias("at"))
    level, maps, last = 1, [], None
    items = pieces.where(length < capacity).select("item", "length")
    count = items.count()
    while count:
        groups = max(1, -(-count // GROUP))
        packed = materialize(_round(items, groups, level, capacity, seed + level), f"bins{level}")
        maps.append(packed.select("item", "bin", "at"))
        items = packed.where((F.col("at") == 0) & (F.col("fill") < int(capacity * (1 - FULL)))).select(F.col("bin").alias("item"), F.col("fill").alias("length"))
        left = items.count()
        # the last round is one group; where groups hardly shrink any more, few bins can still be joined
        if groups == 1 or (last is not None and left > 0.98 * count and groups == last):
            break
        count, last, level = left, groups, level + 1
    placed = maps[0] if maps else None
    for up in maps[1:]:
        higher = up.select(F.col("item").alias("bin"), F.col("bin").alias("_bin"), F.col("at").alias("_at"))
        placed = placed.join(higher, "bin", "left").select("item", F.coalesce("_bin", "bin").alias("bin"), (F.col("at") + F.coalesce("_at", F.lit(0))).alias("at"))
    placed = reduce(DataFrame.unionByName, [x for x in (placed, whole) if x is not None])
    return pieces.join(placed.select("item", F.col("bin").alias("sequence_id"), F.col("at").alias("offset")), "item")


def pack_documents(df: DataFrame, capacity: int, vocabulary: str, end_id: int) -> DataFrame:
    """Placement of every piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece, `end_id` alone. Rows that repeat an id or a whole document are packed each by itself. No rows give none;
    other columns of `df` are dropped.
    """
    pieces = materialize(token_pieces(df, capacity, vocabulary, end_id), "pieces")
    return pack_pieces(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its sequence of at most 2048 tokens; see `pack_documents`."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 2048, public_tokenizers.path("word_bpe_49k.json"), 0)
