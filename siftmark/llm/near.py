"""Operator 5: near-duplicate documents by Order MinHash and banded alignment.

Equal word sequences are one text from the start. Of every text, each of SKETCHES hash
functions samples its PER_SKETCH smallest occurrence-labelled k-mers of K words;
their hash in text order is a bucket. Shuffled words lose that order, so buckets
follow edit similarity rather than overlap. Texts of up to SHORT words have buckets that
leave nothing to chance instead: similar ones share so many two-word k-mers that two
of their smallest are in common (see `_short_buckets`).

Texts that follow one another in a bucket are tried first. Rounds over an eighth of the buckets each then tie every text to
the one of another class that it has most words in common with, as long as that adds more than a few links, which joins crowds of copies up at the cost of a pair for each text and bucket, not for every two texts. At last
every pair of a bucket that is still in different classes is tried, so no link that the buckets hold is lost. What two texts' minima of words
say about the words that they have in common rules most pairs out where they meet; all others are verified by an alignment of their
words within the band that the threshold allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import discard, materialize
from .wordhash import RangeHashes, Words, mix, pieces

#: A pair at similarity 0.8 (words substituted at random places) shares about a third of its 3-mers, so a bucket is common with 0.118 and one of 64 with 0.9997.
K, SKETCHES, PER_SKETCH = 3, 64, 2
#: Most words of a text with exact buckets; those from LONG words on have sketches, so that two texts that are similar have one kind in common.
SHORT, LONG = 30, 25
#: Bins of the occurrence-labelled words of a text, with a byte of each bin's smallest label (0: empty), and how many standard deviations what
#: they say of the share of words in common may be below the least share of similar texts: with 3.2 one of 1,400 pairs at the threshold is lost.
BINS, DEVIATIONS = 256, 3.2
#: Texts of a bucket in a task, and pairs of them that a task holds at a time.
BLOCK, PAIRS = 8192, 1 << 14
#: Parts of the buckets, of which a round takes one, and the share of new links below which rounds end.
PARTS, WORTH = 8, 0.01
#: Most pairs that are sent to the texts instead of the other way round.
FEW = 100_000
#: Texts whose sketches a task gives only once.
SEEN = 500_000
#: Words of a text from which a chain of seeds is tried before the alignment.
CHAINED = 2000
#: Least similarity: one minus the edit distance in words, as a share of the longer text.
SIMILARITY = 0.8

_SEEDS = np.random.RandomState(5).randint(1, 2**62, (2, SKETCHES), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _labelled(grams: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes of k-mers with their occurrence number in their document."""
    order = np.lexsort((np.arange(len(grams)), grams, doc))
    g, d = grams[order], doc[order]
    head = np.append(True, (g[1:] != g[:-1]) | (d[1:] != d[:-1]))
    number = np.arange(len(g)) - np.flatnonzero(head)[np.cumsum(head) - 1]
    out = np.empty_like(grams)
    out[order] = mix(g + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def _word_minima(words: Words, of_words: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The `new` texts, and a byte of each of their bins: a row per text."""
    size = np.diff(words.first)
    some = np.flatnonzero(new & (size > 0))
    runs = size[some]
    at = np.arange(runs.sum()) + np.repeat(words.first[some] - (np.cumsum(runs) - runs), runs)
    text = np.repeat(np.arange(len(some)), runs)
    labels = _labelled(of_words[at], text)
    least = np.full(len(some) * BINS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    np.minimum.at(least, text * BINS + (labels >> np.uint64(56)).astype(np.int64), labels)
    codes = np.where(least == np.uint64(0xFFFFFFFFFFFFFFFF), 0, mix(least) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return some, codes.reshape(-1, BINS)


def _agree(minima_x: np.ndarray, minima_y: np.ndarray, words_x: np.ndarray, words_y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The share of words in common of some pairs as their bins tell it, and whether they can be similar by it and by their lengths.

    Similar texts have all but the band's words of the longer one in common. A bin that is filled in either is one draw, without replacement, of the words
    of both; the error of a share of such draws is that of R (1 - R) (1 / draws - 1 / words).
    """
    longer, both = np.maximum(words_x, words_y), words_x + words_y
    band = ((1 - least) * longer + 1e-9).astype(np.int64)
    filled = np.count_nonzero(minima_x | minima_y, axis=1)
    # bins that are empty in both are equal, too
    same = np.count_nonzero(minima_x == minima_y, axis=1) - (minima_x.shape[1] - filled)
    filled = np.maximum(filled, 1)
    share = same / filled
    common = longer - band
    wanted = np.clip(common / np.maximum(both - common, 1), 0, 1)  # 1 where lengths alone rule a pair out
    error = np.sqrt(wanted * (1 - wanted) * np.maximum(1 / filled - 1 / np.maximum(both - common, 1), 0))
    return share, (2 * longer - both <= band) & (share >= wanted - DEVIATIONS * error - 1.5 / filled)


def _sketches(words: Words, hashes: RangeHashes, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The `new` texts of LONG words or more and their buckets: a row per text and a column per hash function."""
    first, size = words.first[:-1], np.diff(words.first)
    grams_of = np.where(new & (size >= LONG), size - K + 1, 0)
    doc = np.repeat(np.arange(len(new)), grams_of)
    edge = np.append(0, np.cumsum(grams_of))
    at = np.arange(edge[-1]) - np.repeat(edge[:-1] - first, grams_of)
    labels = _labelled(hashes(at, at + K), doc)
    some = np.flatnonzero(grams_of)
    heads, runs = edge[some], grams_of[some]
    buckets = np.empty((len(some), SKETCHES), np.uint64)
    if not len(some):
        return some, buckets
    for j in range(SKETCHES):
        values = (labels ^ _SEEDS[0, j]) * _SEEDS[1, j]
        found, places = [], []
        for _ in range(PER_SKETCH):
            low = np.minimum.reduceat(values, heads)
            here = np.flatnonzero(values == np.repeat(low, runs))
            place = here[np.searchsorted(here, heads)]  # the first of each text
            found.append(labels[place])
            places.append(place)
            values[place] = np.uint64(0xFFFFFFFFFFFFFFFF)
        order = np.argsort(np.stack(places), axis=0, kind="stable")
        bucket = np.full(len(some), j, np.uint64)
        for x in np.take_along_axis(np.stack(found), order, 0):
            bucket = mix(bucket * np.uint64(0x9E3779B97F4A7C15) + x)
        buckets[:, j] = bucket
    return some, buckets


def _band(words: int, least: float) -> int:
    return int((1 - least) * words + 1e-9)


def _short_buckets(words: Words, hashes: RangeHashes, new: np.ndarray, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """The `new` texts and their buckets (a row per text), for each length of 4 to SHORT words.

    An edit changes two 2-mers at most. So the longer of two similar texts has all but twice its band of
    2-mers in common with the other. Where `common` are shared, two of them are among the `size - 1 - common + 2` smallest labels on
    both sides; each two of these are a bucket. `least` has to leave two in common, as 0.8 and more do.
    """
    sizes, out = np.diff(words.first), []
    for size in range(4, SHORT + 1):
        some = np.flatnonzero(new & (sizes == size))
        if not len(some):
            continue
        common = max(2, min(x - 1 - 2 * _band(x, least) for x in range(size, SHORT * 2) if x - size <= _band(x, least)))
        at = words.first[some][:, None] + np.arange(size - 1)
        grams = hashes(at.reshape(-1), at.reshape(-1) + 2)
        labels = np.sort(_labelled(grams, np.repeat(np.arange(len(some)), size - 1)).reshape(at.shape), 1)[:, : max(size - 1 - common + 2, 2)]
        i, j = np.triu_indices(labels.shape[1], 1)
        bucket = mix((labels[:, i] ^ np.uint64(SKETCHES)) * np.uint64(0x9E3779B97F4A7C15) + labels[:, j])
        out.append((some, bucket))
    return out


def sketch_texts(df: DataFrame, text: str, columns: list[str], least: float = SIMILARITY) -> DataFrame:
    """row (a number of its own), own (a struct of `columns`), _same (a hash of the word sequence), words (how many), packed, minima (of words), prints (32 bits of each sketch) and sketches (buckets) of every row.

    A task gives a text's sketches once, however many copies it meets, as long as it can remember SEEN texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress, row, seen = zstandard.ZstdCompressor(level=3).compress, TaskContext.get().partitionId() << 36, set()
        for batch in batches:
            for at, end, data, offsets in pieces(batch, "_text"):
                words, n = Words(data, offsets), end - at
                of_words = words.hashes()
                bounds = words.first[:-1], words.first[1:]
                same = mix(RangeHashes(of_words)(*bounds) ^ RangeHashes(mix(of_words ^ np.uint64(0xA5A5A5A55A5A5A5A)))(*bounds) * np.uint64(0x9E3779B97F4A7C15))
                new = np.zeros(n, bool)
                for i in np.flatnonzero(np.diff(words.first)):
                    if (x := int(same[i])) not in seen:
                        new[i] = True
                        if len(seen) < SEEN:
                            seen.add(x)
                hashes = RangeHashes(of_words)
                kinds = [_sketches(words, hashes, new), *_short_buckets(words, hashes, new, least)]
                of = np.concatenate([np.repeat(x, y.shape[1]) for x, y in kinds])
                bucket = np.concatenate([y.reshape(-1) for _, y in kinds])[np.argsort(of, kind="stable")]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=n))), pa.int32()), pa.array(bucket.view(np.int64)))
                minima: list[bytes | None] = [None] * n
                for i, x in zip(*_word_minima(words, of_words, new), strict=True):
                    minima[i] = x.tobytes()
                prints: list[bytes | None] = [None] * n
                for i, x in zip(*kinds[0], strict=True):
                    prints[i] = x.astype(np.uint32).tobytes()
                packed = [compress(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                own = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), own.column("own"), pa.array(same.view(np.int64)), pa.array(np.diff(words.first), pa.int64()), pa.array(packed, pa.binary()), pa.array(minima, pa.binary()), pa.array(prints, pa.binary()), lists],
                    ["row", "own", "_same", "words", "packed", "minima", "prints", "sketches"],
                )
                row += n

    rows = df.select(F.struct(*columns).alias("own"), F.col(text).alias("_text"))
    schema = rows.schema["own"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, own {schema}, _same long, words long, packed binary, minima binary, prints binary, sketches array<bigint>")


def _neighbours(sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b, n: texts that follow one another in a bucket, and in how many of them; bucket, text: all texts of the buckets with several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last = TaskContext.get().partitionId(), None, None
        names = ["a", "b", "bucket", "part"]
        for batch in batches:
            bucket, text = batch.column("bucket").to_numpy(), batch.column("text").to_numpy()
            if not len(bucket):
                continue
            first = first or (bucket[0], text[0])
            if last is not None:
                bucket, text = np.append(last[0], bucket), np.append(last[1], text)
            last = (bucket[-1], text[-1])
            same = np.flatnonzero((bucket[1:] == bucket[:-1]) & (text[1:] != text[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(text[same]), pa.array(text[same + 1]), pa.array(bucket[same]), pa.nulls(len(same), pa.int32())], names)
        if last is not None:
            # the first and the last row of the task: a bucket can go on in the next
            ends = [pa.array([first[1], last[1]]), pa.nulls(2, pa.int64()), pa.array([first[0], last[0]]), pa.array([2 * part, 2 * part + 1], pa.int32())]
            yield pa.RecordBatch.from_arrays(ends, names)

    laid = sketches.repartitionByRange("bucket", "text").sortWithinPartitions("bucket", "text")
    found = materialize(laid.select("bucket", "text").mapInArrow(run, "a long, b long, bucket long, part int"), "neighbours")
    # two rows per task, whatever the number of texts
    edges = found.where("b is null").select("a", "bucket", F.lag("a").over(Window.orderBy("part")).alias("b"), F.lag("bucket").over(Window.orderBy("part")).alias("before"), "part")
    over = edges.where("part % 2 = 0 and bucket = before and a != b").select("a", "b", "bucket")
    pairs = found.where("b is not null").select("a", "b", "bucket").unionByName(over)
    counted = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n")), "pairs")
    members = materialize(pairs.select("bucket", F.explode(F.array("a", "b")).alias("text")).distinct(), "members")
    discard(found)
    return counted, members


def _apart(members: DataFrame, texts: DataFrame, tied: DataFrame) -> DataFrame:
    """cell (a bucket, and two of its blocks where it has several), side, class, text, words, minima, prints of the texts in buckets with more than one class."""
    known = members.select("text").distinct().join(tied.select(F.col("node").alias("text"), "component"), "text", "left")
    known = materialize(known.select("text", F.coalesce("component", "text").alias("class")), "known")
    placed = materialize(members.join(known, "text"), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.ceil(F.count("*") / BLOCK).alias("blocks")).where("low != high").select("bucket", "blocks")
    dealt = placed.join(mixed, "bucket").withColumn("side", F.pmod(F.xxhash64("text"), F.col("blocks")))
    # a bucket of one block is one cell; only larger ones are met block by block
    small = dealt.where("blocks = 1").withColumn("other", F.col("side"))
    large = dealt.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = small.unionByName(large).select(F.struct("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")).alias("cell"), "side", "class", "text")
    out = materialize(dealt.join(texts.select("text", "words", "minima", "prints"), "text"), "apart")
    discard(known, placed)
    return out


def _across(classes: np.ndarray, two: bool, left: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x, y) of a cell's places in different classes, some at a time. A cell of `two` blocks has `left` rows of the
    first and then those of the second, each sorted by class; places of one class are never paired."""
    n = len(classes)
    if two:
        right = classes[left:]
        low, high = (left + np.searchsorted(right, classes[:left], side) for side in ("left", "right"))
        ranges = [(np.arange(left), np.full(left, left), low), (np.arange(left), high, np.full(left, n))]
    else:
        ranges = [(np.arange(n), np.searchsorted(classes, classes, "right"), np.full(n, n))]
    for x, start, end in ranges:
        total = np.append(0, np.cumsum(end - start))
        at = 0
        while at < len(x):
            to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
            size = (end - start)[at:to]
            yield np.repeat(x[at:to], size), np.arange(total[to] - total[at]) + np.repeat(start[at:to] - (total[at:to] - total[at]), size)
            at = to


def _minima(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x if x is not None else bytes(BINS) for x in column.to_pylist()), np.uint8).reshape(-1, BINS)


def _prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x if x is not None else bytes(4 * SKETCHES) for x in column.to_pylist()), np.uint32).reshape(-1, SKETCHES)


def _here(x: np.ndarray, y: np.ndarray, bucket: int) -> np.ndarray:
    """Whether pairs (their prints) are told in this bucket: in that of the first sketch that they have in common, and in all of theirs if they have none."""
    same = (x == y) & (x > 0)
    first = same.argmax(1)
    return ~same.any(1) | (x[np.arange(len(x)), first] == np.uint32(bucket & 0xFFFFFFFF))


def _top(one: np.ndarray, other: np.ndarray, share: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of each `one`, that with the most in common; ties go to the smaller text."""
    order = np.lexsort((text[other], -share, one))
    one, other, share = one[order], other[order], share[order]
    head = np.append(True, one[1:] != one[:-1])[: len(one)]
    return one[head], other[head], share[head]


def _met(apart: DataFrame, least: float, best: bool) -> DataFrame:
    """Pairs (a, b) of texts of a bucket in different classes that can be similar by their lengths and minima: all, or with `best` only each
    text's best of each bucket. A pair of all goes out in one of the buckets that it shares. A task holds one cell and PAIRS pairs at a time; only what is left of them goes out."""

    def pairs(bucket: int, classes: np.ndarray, side: np.ndarray, text: np.ndarray, words: np.ndarray, minima: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((text, classes, side))
        classes, side, text, words, minima, prints = (x[order] for x in (classes, side, text, words, minima, prints))
        left = int(np.searchsorted(side, side[0], "right"))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for x, y in _across(classes, left < len(text), left):
            share, fit = _agree(minima[x], minima[y], words[x], words[y], least)
            x, y, share = x[fit], y[fit], share[fit]
            if best:
                found[0] = _top(*(np.concatenate(v) for v in ((found[0][0], x, y), (found[0][1], y, x), (found[0][2], share, share))), text)
            else:
                own = _here(prints[x], prints[y], bucket)
                found.append((x[own], y[own], share[own]))
        x, y, _ = (np.concatenate(v) for v in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(text[x], text[y])), pa.array(np.maximum(text[x], text[y]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []

        def cells(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            """The pairs of the table's cells, but for the last one, which can go on; that waits."""
            cell = np.stack([table.column(c).to_numpy() for c in ("bucket", "i", "j")])
            edge = np.append(np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(0)) + 1, table.num_rows)
            edge = np.append(0, edge if last else edge[:-1])
            columns = [table.column(c).to_numpy() for c in ("class", "side", "text", "words")]
            columns += [_minima(table.column("minima")), _prints(table.column("prints"))]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                yield pairs(int(cell[0, a]), *(x[a:b] for x in columns))
            waiting[:] = [table.slice(edge[-1])] if edge[-1] < table.num_rows else []

        for batch in batches:
            if batch.num_rows:
                waiting.append(pa.Table.from_batches([batch]))
                if sum(x.num_rows for x in waiting) >= BLOCK:
                    yield from cells(pa.concat_tables(waiting).combine_chunks(), False)
        if waiting:
            yield from cells(pa.concat_tables(waiting).combine_chunks(), True)

    laid = apart.repartition("cell").sortWithinPartitions("cell").select("cell.*", "class", "side", "text", "words", "minima", "prints")
    return laid.mapInArrow(run, "a long, b long").distinct()


def _possible(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that can be similar by their lengths and minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 2048) for whole in batches for i in range(0, whole.num_rows, 2048)):
            if batch.num_rows:
                _, fit = _agree(_minima(batch.column("x")), _minima(batch.column("y")), batch.column("x_words").to_numpy(), batch.column("y_words").to_numpy(), least)
                yield batch.select(["a", "b"]).filter(pa.array(fit))

    for end, own in (("a", "x"), ("b", "y")):
        pairs = pairs.join(texts.select(F.col("text").alias(end), F.col("minima").alias(own), F.col("words").alias(f"{own}_words")), end)
    return pairs.select("a", "b", "x", "y", "x_words", "y_words").mapInArrow(run, "a long, b long")


def _chain_distance(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Cost of an alignment along a chain of three-word seeds within the band: an upper bound of the edit distance."""
    n, m = len(a), len(b)
    if min(n, m) < 3:
        return max(n, m)
    seeds = []
    for x in (a, b):
        at = np.arange(len(x) - 2)
        values, place, times = np.unique(RangeHashes(x)(at, at + 3), return_index=True, return_counts=True)
        seeds.append((values[times == 1], place[times == 1]))
    _, i, j = np.intersect1d(seeds[0][0], seeds[1][0], assume_unique=True, return_indices=True)
    i, j = seeds[0][1][i], seeds[1][1][j]
    near = np.abs(i - j) <= band
    order = np.argsort(i[near])
    i, j = i[near][order], j[near][order]
    if not len(i):
        return max(n, m)
    up = j > np.append(-1, np.maximum.accumulate(j)[:-1])
    i, j = i[up], j[up]
    over, down = np.diff(i), np.diff(j)
    between = np.maximum(over, down) - np.minimum(np.minimum(over, down), 3)
    return int(max(i[0], j[0]) + between.sum() + max(n - i[-1], m - j[-1]) - 3)


def _banded_distance(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Edit distance of two word sequences within a band around the diagonal; over `band` where it is larger.

    A column of the band is one integer with a bit per diagonal, which says where distances rise or fall; words of `a` take turns.
    """
    a, b = sorted((a, b), key=len)
    n, m, width = len(a), len(b), 2 * band + 1
    if abs(m - n) > band or not n or not m:
        return max(n, m) if not min(n, m) else band + 1
    order = np.argsort(b, kind="stable")
    start, end = (np.searchsorted(b[order], a, side).tolist() for side in ("left", "right"))
    places = order.astype(np.int64)
    whole, bits = (1 << width) - 1, -(-(width + 7) // 8)
    kept: dict[int, int] = {}

    def equal(i: int) -> int:
        """The diagonals on which word i of `a` meets an equal word: bit 0 is place i - band of `b`."""
        x, y = start[i], end[i]
        if y - x > 8 and m <= 1 << 16:
            if x not in kept:
                some = np.zeros(m + band, np.uint8)
                some[places[x:y] + band] = 1
                kept[x] = int.from_bytes(np.packbits(some, bitorder="little").tobytes(), "little")
            return (kept[x] >> i) & whole
        near = places[x:y]
        near = near[np.searchsorted(near, i - band) : np.searchsorted(near, i + band, "right")] - (i - band)
        if len(near) <= 8:
            out = 0
            for p in near.tolist():
                out |= 1 << p
            return out
        some = np.zeros(bits * 8, np.uint8)
        some[near] = 1
        return int.from_bytes(np.packbits(some, bitorder="little").tobytes(), "little")

    rise, fall, far = whole ^ ((1 << band) - 1), 0, band
    diagonal, across = 1 << (width - 1), 1 << (width - 2) if width > 1 else 0
    for i in range(n):
        same = equal(i)
        zero = (((same & rise) + rise) ^ rise) | same | fall
        up, down = (fall | ~(zero | rise)) & whole, zero & rise & whole
        if i + band < m:
            far += not zero & diagonal
            # from the band's edge, the steps that are left lead back to the corner
            if far > 2 * band + n - m:
                return band + 1
        else:
            far += bool(up & across) - bool(down & across)
            across >>= 1
        zero = (zero & whole) >> 1
        rise, fall = (down | ~(zero | up)) & whole, zero & up
    return far if far <= band else band + 1


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether 1 - edit distance / length of the longer is at least `least`.

    Bounds decide most pairs: the words in common, anywhere and within the band, from above, a chain of seeds from below. The rest is aligned in the band.
    """
    longer = max(len(a), len(b))
    band = _band(longer, least)
    if longer - min(len(a), len(b)) > band:
        return False
    values, number, count = np.unique(np.concatenate([a, b]), return_inverse=True, return_counts=True)
    in_a = np.bincount(number[: len(a)], minlength=len(values))
    if longer - int(np.minimum(in_a, count - in_a).sum()) > band:
        return False
    # words by number and place, with room between numbers: blocks in another order have few within the band
    room = longer + 2 * band + 2
    places = np.sort(number[len(a) :] * room + np.arange(len(b)) + band)
    wanted = number[: len(a)] * room + np.arange(len(a))
    next_ = places[np.minimum(np.searchsorted(places, wanted), len(places) - 1)] if len(places) else wanted - 1
    if longer - int(((next_ >= wanted) & (next_ <= wanted + 2 * band)).sum()) > band:
        return False
    return longer > CHAINED and _chain_distance(a, b, band) <= band or _banded_distance(a, b, band) <= band


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs of similar texts; texts travel compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress

        def hashes(packed: bytes) -> np.ndarray:
            data = np.frombuffer(expand(packed), np.uint8)
            return Words(data, np.array([0, len(data)])).hashes()

        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                kept = [similar(hashes(x.as_py()), hashes(y.as_py()), least) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    if pairs.count() <= FEW:
        # few pairs are broadcast, so that no other texts are shuffled
        with_a = texts.select(F.col("text").alias("a"), F.col("packed").alias("x")).join(F.broadcast(pairs.select("a", "b")), "a")
        others = texts.select(F.col("text").alias("b"), F.col("packed").alias("y")).join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
        both = with_a.join(others, "b")
    else:
        with_a = pairs.join(texts.select(F.col("text").alias("a"), F.col("packed").alias("x")), "a")
        both = with_a.join(texts.select(F.col("text").alias("b"), F.col("packed").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _classes(df: DataFrame, text: str, columns: tuple[str, ...], id: str, least: float) -> DataFrame:
    """row, own, class_id, class_row, class_texts of every row; see `near_duplicates`."""
    rows = materialize(sketch_texts(df, text, list(dict.fromkeys([*columns, id])), least), "sketched")
    texts = rows.groupBy(F.col("_same").alias("text")).agg(F.min("row").alias("row"), F.min("words").alias("words"), F.max("minima").alias("minima"), F.max("prints").alias("prints"), F.min(F.struct(F.col("own")[id].alias("id"), F.col("row").alias("row"))).alias("lead"))
    texts = materialize(texts, "texts")
    pairs, members = _neighbours(rows.select(F.col("_same").alias("text"), F.explode("sketches").alias("bucket")))
    met = members.select("text").distinct()
    sketches = materialize(texts.select("text", "words", "minima", "prints").join(met, "text"), "minima")
    # neither side has a bound that would allow a broadcast
    candidates = materialize(rows.select("row", "packed").hint("merge").join(texts.select("text", "row").join(met, "text"), "row").select("text", "packed"), "candidates")
    best = materialize(_possible(pairs.groupBy("b").agg(F.max(F.struct("n", "a")).alias("x")).select("x.a", "b"), sketches, least), "best")
    found = materialize(_verified(best, candidates, least), "links")
    tied = materialize(connected_components(found), "tied")
    links = found.count()
    discard(pairs, best, found)

    def tie(buckets: DataFrame, best: bool) -> int:
        """Tie up what the buckets hold; how many links that added."""
        nonlocal tied
        apart = _apart(buckets, sketches, tied)
        new = materialize(_met(apart, least, best), "met")
        added = materialize(_verified(new, candidates, least), "added")
        if n := added.count():
            before, tied = tied, materialize(connected_components(tied.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(added)), "tied")
            discard(before)
        discard(apart, new, added)
        return n

    for part in range(PARTS):
        more = tie(members.where(F.pmod("bucket", F.lit(PARTS)) == part), best=True)
        links += more
        if more <= WORTH * links:
            break
    tie(members, best=False)
    named = materialize(texts.join(tied.withColumnRenamed("node", "text"), "text", "left").withColumn("component", F.coalesce("component", "text")), "named")
    classes = named.groupBy("component").agg(F.min("lead").alias("lead"), F.count("*").alias("class_texts"))
    # classes and the texts' leads are written before they are joined: a join right behind a shuffle can split a hot class
    classes = materialize(classes, "classes")
    of_text = materialize(named.select(F.col("text").alias("_same"), "component").join(classes, "component").drop("component"), "leads")
    discard(texts, members, sketches, candidates, tied, named, classes)
    return rows.select("row", "own", "_same").join(of_text, "_same").select("row", "own", F.col("lead.id").alias("class_id"), F.col("lead.row").alias("class_row"), "class_texts")


def near_duplicates(df: DataFrame, text: str = "text", columns: tuple[str, ...] = ("doc_id",), id: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """Every row's `columns` with class_id (the smallest `id` of its class) and class_texts (the class's different texts).

    Texts with equal words are in one class, also null, empty and blank ones, which have none. Null ids come first. An empty table gives no rows. Other columns of `df` are dropped, and the
    new names replace columns of the same name.
    """
    kept = [c for c in columns if c not in ("class_id", "class_texts")]
    return _classes(df, text, tuple(kept), id, least).select(*(F.col("own")[c].alias(c) for c in kept), "class_id", "class_texts")


def drop_near_duplicates(df: DataFrame, text: str = "text", id: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """All columns of `df`, with one row of each class: that of the smallest `id`."""
    found = _classes(df, text, tuple(df.columns), id, least)
    return found.where("row = class_row").select(*(F.col("own")[c].alias(c) for c in df.columns))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates; see `near_duplicates`."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "class_texts")
