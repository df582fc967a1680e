"""Operator 13: the prefix trie of conversations, from globally sorted turn arrays.

1. A conversation is an array of its turns' digests and word counts. Arrays are range-partitioned and
   sorted, with the conversation's id behind them, so that copies of a hot one spread over tasks. The layout is checkpointed.
2. Neighbouring arrays share a longest common prefix (LCP). The members of a node stand next to each other,
   so each task sweeps its rows with a stack of open nodes: a row closes what is deeper than its LCP and opens its own rest.
3. A node that a task's edge cuts is open on both sides of it. What its pieces counted is additive: members, children
   (begun by the row that opens them), leaves (ended by the row behind) and saved tokens. So the pieces
   of open stacks are stitched by a sum over their path's digest; only LCPs at the edges meet in one place, a row per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import discard, materialize, ordered_checkpoint

#: Bytes of a digest of SHA-256 that tells turns and paths apart.
DIGEST = 16
#: Children of an open node that wait for its smallest member in the task; more of them get it by a join.
WAITING = 10_000
#: Most open nodes that are broadcast to their children; more of them are joined by a shuffle.
BROADCAST = 100_000
#: Bytes of a piece of a list of ids, and rows of an output batch.
CHUNK, ROWS = 1 << 16, 8192

_NO_ENDS = hashlib.sha256(b"").hexdigest()
_SWEPT = "kind string, key binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, asked boolean, part int, place int, ids binary"
_FIELDS = [x.split()[0] for x in _SWEPT.split(", ")]
OUTPUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_arrays(df: DataFrame, by: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and turns (an array of key, a digest of role and text, and words) of every conversation, by `order`.

    A null role or text is empty; turns with equal `order` follow by role, then text, a null `order` comes first. Rows with a null `by` belong to no
    conversation and are left out. A conversation is one value, so its own turns meet in one task.
    """
    rows = df.where(F.col(by).isNotNull()).select(F.col(by).cast("long").alias("conv_id"), F.col(order).alias("at"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    key = F.expr(f"substring(unhex(sha2(concat(length(role), ':', role, text), 256)), 1, {DIGEST})")
    words = F.size(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))
    turns = rows.select("conv_id", F.struct("at", "role", "text", key.alias("key"), words.alias("words")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("sorted"))
    return turns.select("conv_id", F.expr("transform(sorted, t -> struct(t.key AS key, t.words AS words))").alias("turns"))


def with_shared_heads(turns: DataFrame, of: int = 20, most: int = 4) -> DataFrame:
    """Conversations rebuilt: the first h turns of conversation c - c % `of` (none if it doesn't exist), then their own after the first h; h is crc32(c) % `most`."""
    known = materialize(turns, "turns")
    heads = known.where(F.col("conv_id") % of == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    both = known.withColumns({"base": F.expr(f"conv_id - conv_id % {of}"), "h": F.expr(f"cast(crc32(cast(conv_id as string)) % {most} as int)")}).join(heads, "base", "left")
    return both.select("conv_id", F.expr("concat(if(head is null, slice(turns, 1, 0), slice(head, 1, h)), slice(turns, h + 1, size(turns)))").alias("turns"))


def _common(a: str, b: str) -> Column:
    """Elements that two arrays have in common at their beginning; -1 where one array isn't there."""
    apart = f"array_position(zip_with({a}, {b}, (x, y) -> x <=> y), false)"
    return F.expr(f"cast(if({a} is null or {b} is null, -1, if({apart} = 0, size({a}), {apart} - 1)) as int)")


def _laid(convs: DataFrame) -> DataFrame:
    """Sorted conversations with part (the task), and common_before and common_after: the LCPs across the task's two edges."""
    sort = ["turns", "conv_id"]
    laid = ordered_checkpoint(convs.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    edge = F.struct("at", "turns")
    over = Window.orderBy("part")  # a row per task, whatever the number of conversations
    edges = laid.groupBy("part").agg(F.min_by("turns", "at").alias("first"), F.max_by("turns", "at").alias("last"))
    edges = edges.select("part", "first", "last", F.lag("last").over(over).alias("before"), F.lead("first").over(over).alias("after"))
    known = edges.select("part", _common("before", "first").alias("common_before"), _common("last", "after").alias("common_after"))
    return laid.join(F.broadcast(known), "part")


class _Node:
    """An open node of the stack; what its closed children have counted is in it."""

    __slots__ = ("ends", "key", "n", "low", "children", "leaves", "saved", "words", "begun", "asked", "waiting")

    def __init__(self, key: bytes, words: int, begun: bool):
        self.key, self.words, self.begun = key, words, begun
        self.n = self.children = self.leaves = self.saved = 0
        self.low: int | None = None
        self.ends, self.asked = bytearray(), False
        self.waiting: list[dict] = []


class _Sweep:
    """The stack of one task, and the rows that it has given so far."""

    def __init__(self, part: int, before: int, after: int):
        self.part, self.before, self.after = part, before, after
        self.stack: list[_Node] = []
        self.turns: list[tuple[bytes, int]] | None = None
        self.conv = 0
        self.ready: list[dict] = []

    def _open(self, turns: list[tuple[bytes, int]], depth: int, begun: bool) -> None:
        if depth == 0:
            self.stack.append(_Node(b"", 0, begun))
        else:
            key, words = turns[depth - 1]
            self.stack.append(_Node(hashlib.sha256(self.stack[-1].key + key).digest()[:DIGEST], words, begun))

    def _close(self, whole: bool) -> None:
        """Close the deepest node; `whole` if no task behind this one has more of it."""
        node, depth = self.stack.pop(), len(self.stack) - 1
        depth += 1
        up = self.stack[-1] if self.stack else None
        node.saved += (node.n - node.begun) * node.words
        row = {"key": node.key, "parent": up.key if up else None, "conv_id": node.low, "depth": depth, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved}
        if whole and node.begun:
            for child in node.waiting:
                child["parent_conv_id"] = node.low
                self.ready.append(child | {"kind": "node"})
            row |= {"ends_sha256": hashlib.sha256(node.ends).hexdigest(), "asked": node.asked}
            if up is None:
                self.ready.append(row | {"kind": "node"})
            else:
                up.waiting.append(row)
                if len(up.waiting) > WAITING:
                    self._ask(up)
        else:
            self._ask(node)
            self.ready.append(row | {"kind": "piece"})
            self.ready += [{"kind": "ids", "key": node.key, "part": self.part, "place": i, "ids": bytes(node.ends[i : i + CHUNK])} for i in range(0, len(node.ends), CHUNK)]
        if up:
            up.n, up.leaves, up.saved = up.n + node.n, up.leaves + node.leaves, up.saved + node.saved
            up.low = node.low if up.low is None else min(up.low, node.low)

    def _ask(self, node: _Node) -> None:
        """Children that are closed get the node's smallest member later."""
        node.asked = node.asked or bool(node.waiting)
        self.ready += [child | {"kind": "child"} for child in node.waiting]
        node.waiting = []

    def _ended(self, common: int) -> None:
        """The last row's node is a leaf unless the row behind goes on from it."""
        if common < len(self.turns):
            self.stack[-1].leaves += 1

    def add(self, conv: int, turns: list[tuple[bytes, int]]) -> None:
        if self.turns is None:
            common = self.before
            for depth in range(common + 1):
                self._open(turns, depth, False)
        else:
            shorter = min(len(turns), len(self.turns))
            common = next((i for i in range(shorter) if turns[i][0] != self.turns[i][0]), shorter)
            self._ended(common)
            while len(self.stack) > common + 1:
                self._close(True)
        for depth in range(common + 1, len(turns) + 1):
            if depth:
                self.stack[-1].children += 1
            self._open(turns, depth, True)
        top = self.stack[-1]
        top.n += 1
        top.low = conv if top.low is None else min(top.low, conv)
        top.ends += b",%d" % conv if top.ends else b"%d" % conv
        self.turns = turns

    def end(self) -> None:
        if self.turns is not None:
            self._ended(self.after)
            while self.stack:
                self._close(len(self.stack) - 1 > self.after)

    def taken(self) -> pa.RecordBatch:
        rows, self.ready = self.ready, []
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
        return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in (x.split() for x in _SWEPT.split(", "))], _FIELDS)


def _swept(laid: DataFrame) -> DataFrame:
    """What the tasks' sweeps give: whole nodes, children that still need their parent's smallest member, pieces of open nodes, and their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = None
        for batch in batches:
            turns = batch.column("turns")
            keys, words = (turns.flatten().field(x).to_pylist() for x in ("key", "words"))
            at = [0]
            for n in turns.value_lengths().to_pylist():
                at.append(at[-1] + n)
            for i, conv in enumerate(batch.column("conv_id").to_pylist()):
                if sweep is None:
                    sweep = _Sweep(*(batch.column(c)[0].as_py() for c in ("part", "common_before", "common_after")))
                sweep.add(conv, list(zip(keys[at[i] : at[i + 1]], words[at[i] : at[i + 1]], strict=True)))
                if len(sweep.ready) >= ROWS:
                    yield sweep.taken()
        if sweep is not None:
            sweep.end()
            yield sweep.taken()

    return laid.select("conv_id", "turns", "part", "common_before", "common_after").mapInArrow(run, _SWEPT)


def _digests(ids: DataFrame) -> DataFrame:
    """key and ends_sha256 of open nodes: the pieces of a list of ids, in order, go through a digest; none is held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])
        for batch in batches:
            for key, place, part in zip(batch.column("key").to_pylist(), batch.column("place").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key != last:
                    if digest:
                        yield out()
                    last, digest = key, hashlib.sha256()
                elif place == 0:
                    digest.update(b",")
                digest.update(part)
        if digest:
            yield out()

    laid = ids.select("key", "part", "place", "ids").repartition("key").sortWithinPartitions("key", "part", "place")
    return laid.mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(convs: DataFrame) -> DataFrame:
    """A row per node of the trie of `convs` (conv_id, turns: an array of key and words), see OUTPUT.

    A node is a distinct sequence of first turns; conv_id is its smallest member's, parent_conv_id its parent's (null for the root). n_convs counts members, n_children
    and n_leaves nodes (leaves of its subtree); saved_tokens adds up, over its subtree, each node's (members - 1) times its last turn's words; ends_sha256 is the digest of
    the ascending, comma-joined ids of the members that end there. Conversations without turns are members of the root alone.
    An id that is repeated counts again. An empty table gives no rows. Other columns of `convs` are dropped.
    """
    swept = materialize(_swept(_laid(convs.select("conv_id", "turns"))), "swept")
    pieces = swept.where("kind = 'piece'").groupBy("key").agg(
        F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))
    )
    pieces = pieces.join(_digests(swept.where("kind = 'ids'")), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS)))
    stitched = materialize(pieces, "stitched")
    parents = stitched.select("key", "conv_id").unionByName(swept.where("kind in ('node', 'child') and asked").select("key", "conv_id"))
    parents = materialize(parents.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parents")
    # two rows for each task and level of its edges, and nodes of many children; where that is more than is good to broadcast, a shuffle
    few = F.broadcast(parents) if parents.count() <= BROADCAST else parents
    late = swept.where("kind = 'child'").drop("parent_conv_id").select(*stitched.columns).unionByName(stitched)
    return swept.where("kind = 'node'").select(*OUTPUT).unionByName(late.join(few, "parent", "left").select(*OUTPUT))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt with shared heads; see `turn_arrays`, `with_shared_heads` and `prefix_trie`."""
    return prefix_trie(with_shared_heads(turn_arrays(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


#: crc32 of the decimal digits of conv_id: 8 shifts for each byte.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda y: [256 + ord(y), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, o: CASE WHEN o >= 0 THEN xor(a, o - 256) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""

OP13_SQL = rf"""
WITH o AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(list_slice(b.own, 1, h.h), []), list_slice(h.own, h.h + 1, len(h.own))) AS turns FROM h LEFT JOIN o b ON b.conv_id = h.base),
p AS (SELECT conv_id, len(turns) AS n, turns, unnest(range(0, len(turns) + 1)) AS d FROM r),
q AS MATERIALIZED (SELECT list_slice(turns, 1, d) AS path, d, min(conv_id) AS low, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends
  FROM p GROUP BY ALL),
c AS (SELECT list_slice(path, 1, d - 1) AS path, count(*) AS n_children FROM q WHERE d > 0 GROUP BY ALL),
w AS (SELECT q.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved FROM q LEFT JOIN c USING (path)),
u AS (SELECT path AS below, n_children, saved, d, unnest(range(0, d + 1)) AS a FROM w),
s AS (SELECT list_slice(below, 1, a) AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM u GROUP BY ALL)
SELECT w.low AS conv_id, w.d AS depth, up.low AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends AS ends_sha256
FROM w JOIN s USING (path) LEFT JOIN q up ON w.d > 0 AND up.path = list_slice(w.path, 1, w.d - 1)
"""
