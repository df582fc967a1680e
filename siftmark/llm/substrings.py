"""Operator 2: substring dedup by relative Lempel-Ziv parsing.

A window is `width` consecutive words of one document; it repeats if its words also
start anywhere else. Documents are parsed against reference blocks that cover the
whole table:

1. A window's anchor is its smallest hash of ANCHOR words, so equal windows
   have equal anchors. Neighbouring windows of one anchor form a block: its key is
   the anchor's hash, its content the words that its windows cover.
2. Blocks are the index. A block whose content occurs elsewhere gets a reference: the
   row and place it can be copied from. Of blocks whose key occurs elsewhere with
   other content, single windows are looked up among those of the key's other contents.
3. Each document is factored greedily (`parse`): a factor goes on from block to block while
   their references go on in the same source. Where that ends, the factor's boundary is checked window
   by window. Factors of `width` words or more become duplicate spans; nothing else does.

Only hashes of blocks meet in joins; copies of a block are counted and stand as one
reference block, so a passage that a third of all documents share costs a row per
occurrence and never a pair of documents. Contents and windows are equal if two independent
64-bit hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import discard, materialize
from .wordhash import RangeHashes, Words, pieces, sliding_min

#: Words of an anchor, and the bits of a word's place beside its hash when the smallest is sought.
ANCHOR = 8
PLACE = np.uint64(28)

_BLOCK = "struct<key:bigint,content:bigint,check:bigint,first:int,last:int>"


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _blocks(words: Words, width: int, bits: int) -> tuple[np.ndarray, ...]:
    """Of every block: document, key, content (two hashes), and its first and last window (by their first word in the document)."""
    empty = tuple(np.zeros(0, np.int64) for _ in range(6))
    n = len(words) - width + 1
    if n <= 0:
        return empty
    hashes = RangeHashes(words.hashes())
    document = np.searchsorted(words.first, np.arange(len(words)), side="right") - 1
    places = np.arange(len(words) - ANCHOR + 1)
    keys = hashes(places, places + ANCHOR)
    smallest = sliding_min((keys >> PLACE << PLACE) | places.astype(np.uint64), width - ANCHOR + 1)
    anchor = (smallest & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
    inside = np.flatnonzero(document[:n] == document[width - 1 :])
    if not len(inside):
        return empty
    anchor, doc = anchor[inside], document[inside]
    head = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
    first, last = inside[head], inside[np.append(head[1:], len(inside)) - 1]
    at = anchor[head]
    content = (hashes(first, last + width) ^ ((at - first).astype(np.uint64) << np.uint64(20))) & _mask(bits)
    check = RangeHashes(words.hashes(1))(first, last + width)
    start = words.first[doc[head]]
    return doc[head], keys[at].view(np.int64), content.view(np.int64), check.view(np.int64), first - start, last - start


def _list(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def index_blocks(df: DataFrame, width: int, text: str, columns: list[str], bits: int = 64) -> DataFrame:
    """row (a number of its own), own (a struct of `columns`), n_words, packed (the compressed text) and blocks of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress, row = zstandard.ZstdCompressor(level=3).compress, TaskContext.get().partitionId() << 36
        for batch in batches:
            for at, end, data, offsets in pieces(batch, "_text"):
                words = Words(data, offsets)
                doc, *block, first, last = _blocks(words, width, bits)
                sizes = np.bincount(doc, minlength=end - at)
                block = pa.StructArray.from_arrays([*map(pa.array, block), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["key", "content", "check", "first", "last"])
                packed = [compress(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                own = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + end - at)), own.column("own"), pa.array(np.diff(words.first)), pa.array(packed, pa.binary()), _list(block, sizes)],
                    ["row", "own", "n_words", "packed", "blocks"],
                )
                row += end - at

    rows = df.select(F.struct(*columns).alias("own"), F.col(text).alias("_text"))
    schema = rows.schema["own"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, own {schema}, n_words long, packed binary, blocks array<{_BLOCK}>")


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, Words]]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    for i, packed in enumerate(batch.column("packed")):
        data = np.frombuffer(expand(packed.as_py()), np.uint8)
        yield i, data, Words(data, np.array([0, len(data)]))


def _boundary_windows(df: DataFrame, width: int, bits: int) -> DataFrame:
    """row, place, n and two hashes of each window in `checks` (first, last, n): n is how often its block's content occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, checks = batch.column("row").to_pylist(), batch.column("checks").to_pylist()
            for i, _, words in _unpacked(batch):
                at = np.concatenate([np.arange(c["first"], c["last"] + 1) for c in checks[i]])
                n = np.concatenate([np.full(c["last"] + 1 - c["first"], c["n"]) for c in checks[i]])
                found = RangeHashes(words.hashes())(at, at + width) & _mask(bits), RangeHashes(words.hashes(1))(at, at + width)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), rows[i])), pa.array(at, pa.int32()), pa.array(n, pa.int64()), *(pa.array(x.view(np.int64)) for x in found)], ["row", "place", "n", "hash", "check"])

    return df.select("row", "packed", "checks").mapInArrow(run, "row long, place int, n long, hash long, check long")


def find_matches(df: DataFrame, width: int = 35, text: str = "text", columns: tuple[str, ...] = ("doc_id",), bits: int = 64) -> DataFrame:
    """row, own (a struct of `columns`), n_words, packed, and what the index knows of every row: `references` (first, last, source_row,
    source_first: blocks that can be copied from elsewhere) and `places` (windows of other blocks that start elsewhere, too).

    A null or empty text, or one of under `width` words, has none. Repeated rows can be copied from
    each other. An empty table gives no rows. Other columns of `df` are dropped. `bits` of the first hash are used; fewer
    mean more chance meetings, which the second hash tells apart.
    """
    indexed = materialize(index_blocks(df, width, text, list(columns), bits), "blocks")
    blocks = indexed.select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    either = F.expr("content ^ check")
    keys = blocks.groupBy("key").agg(F.count("*").alias("_n"), (F.min(either) != F.max(either)).alias("mixed")).where("_n > 1")
    # counted keys and contents are written before they are joined: a join right behind a shuffle can split a hot key
    keys = materialize(keys.drop("_n"), "keys")
    shared = materialize(blocks.join(keys.hint("merge"), "key"), "shared")
    contents = shared.groupBy("key", "content", "check").agg(F.count("*").alias("n"), F.min(F.struct("row", "first")).alias("low"), F.max(F.struct("row", "first")).alias("high"))
    contents = materialize(contents, "contents")
    # of blocks with the same content the lowest stands in the index, with the number of its copies
    met = shared.join(contents, ["key", "content", "check"])
    lowest = (F.col("row") == F.col("low.row")) & (F.col("first") == F.col("low.first"))
    source = F.when(lowest, F.col("high")).otherwise(F.col("low"))
    marks = met.where((F.col("n") > 1) | (F.col("mixed") & lowest)).groupBy("row").agg(
        F.collect_list(F.when(F.col("n") > 1, F.struct("first", "last", source["row"].alias("source_row"), source["first"].alias("source_first")))).alias("references"),
        F.collect_list(F.when(F.col("mixed") & lowest, F.struct("first", "last", "n"))).alias("checks"),
    )
    found = materialize(indexed.drop("blocks").join(marks, "row", "left"), "marked")
    discard(indexed, keys, shared, contents)
    windows = materialize(_boundary_windows(found.where("size(checks) > 0"), width, bits), "windows")
    repeated = windows.groupBy("hash", "check").agg(F.sum("n").alias("_n")).where("_n > 1").select("hash", "check")
    single = windows.where("n = 1").join(repeated, ["hash", "check"]).groupBy("row").agg(F.collect_list("place").alias("places"))
    single = materialize(single, "places")
    discard(windows)
    open_ = found.where("size(checks) > 0").join(single, "row", "left")
    closed = found.where("checks is null or size(checks) = 0").withColumn("places", F.expr("cast(null as array<int>)"))
    return closed.unionByName(open_).select("row", "own", "n_words", "packed", "references", "places")


def parse(references: list[dict], places: list[int], width: int) -> list[tuple[int, int]]:
    """The greedy parse of one document: (first word, words) of its factors of `width` words or more, in order.

    A factor takes in the next reference that begins where it ends, as long as that goes on in the same source, and the checked
    windows at its end; another source, or a gap, begins the next factor.
    """
    steps = [(r["first"], r["last"], (r["source_row"], r["source_first"] - r["first"])) for r in references] + [(p, p, None) for p in places]
    factors: list[tuple[int, int]] = []
    start = end = source = None
    for first, last, own in sorted(steps, key=lambda s: s[:2]):
        if end is not None and first == end + 1 and (own is None or source is None or own == source):
            end, source = last, own or source
            continue
        if end is not None:
            factors.append((start, end - start + width))
        start, end, source = first, last, own
    if end is not None:
        factors.append((start, end - start + width))
    return [f for f in factors if f[1] >= width]


def _covered(words: int, factors: list[tuple[int, int]]) -> np.ndarray:
    change = np.zeros(words + 1, np.int64)
    np.add.at(change, [a for a, _ in factors], 1)
    np.add.at(change, [a + n for a, n in factors], -1)
    return np.cumsum(change)[:-1] > 0


def drop_factors(found: DataFrame, width: int, parse: Callable[[list[dict], list[int], int], list[tuple[int, int]]] = parse) -> DataFrame:
    """own, n_words, n_removed, n_factors, kept_sha256 (of the kept words, joined by one space) and kept: the text
    without the words of its factors and the white space after them, with the white space elsewhere as it was.

    `found` is what `find_matches` gives: a row without references and places keeps its whole text, a null one becomes empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                references, places = (batch.column(c).to_pylist() for c in ("references", "places"))
                removed, count, digests, texts = [], [], [], []
                for i, data, words in _unpacked(batch):
                    factors = parse(references[i] or [], places[i] or [], width)
                    raw, gone = data.tobytes(), _covered(len(words), factors)
                    removed.append(int(gone.sum()))
                    count.append(len(factors))
                    digests.append(hashlib.sha256(b" ".join([raw[a:b] for a, b in zip(words.starts[~gone].tolist(), words.ends[~gone].tolist(), strict=True)])).hexdigest())
                    if removed[-1]:
                        turn = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                        bounds = np.append(words.starts, len(data))
                        edges = [0, *bounds[turn].tolist(), len(data)]
                        raw = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    texts.append(raw.decode(errors="replace"))
                out = [batch.column("own"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(out, ["own", "n_words", "n_removed", "n_factors", "kept_sha256", "kept"])

    schema = found.schema["own"].dataType.simpleString()
    return found.select("own", "n_words", "packed", "references", "places").mapInArrow(run, f"own {schema}, n_words long, n_removed long, n_factors long, kept_sha256 string, kept string")


def dedup_substrings(df: DataFrame, width: int = 35, text: str = "text", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`columns` of every row with n_words, n_removed, n_factors, kept_sha256 and kept, its text without the words of windows that
    repeat anywhere in the table; see `find_matches`, `parse` and `drop_factors`. The new names replace columns of the same name."""
    new = ["n_words", "n_removed", "n_factors", "kept_sha256", "kept"]
    out = drop_factors(find_matches(df, width, text, columns), width)
    return out.select(*(F.col("own")[c].alias(c) for c in columns if c not in new), *new)


def op2_relative_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and a digest of the kept ones of every document; see `dedup_substrings`."""
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")
