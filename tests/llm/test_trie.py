"""The prefix trie of conversations against brute force: nulls, ties, repeated rows, open stacks across tasks, empty tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from siftmark.llm import trie
from siftmark.llm.trie import OUTPUT, prefix_trie, turn_arrays, with_shared_heads

SCHEMA = "conv_id long, turn long, role string, text string, part string, turns string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return [(c, own.get(c - c % 20, [])[: h[c]] + own[c][h[c] :]) for c in own]


def brute(convs):
    """Rows of OUTPUT from (conv_id, turns of (role, text))."""
    members = defaultdict(list)
    for c, turns in convs:
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, len(turns)))
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    saved = {p: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p, m in members.items()}
    below, leaves = defaultdict(int), defaultdict(int)
    for path in members:
        for d in range(len(path) + 1):
            below[path[:d]] += saved[path]
            leaves[path[:d]] += not children[path]
    low = {p: min(c for c, _ in m) for p, m in members.items()}
    ends = {p: ",".join(map(str, sorted(c for c, n in m if n == len(p)))) for p, m in members.items()}
    rows = ((low[p], len(p), low[p[:-1]] if p else None, len(m), len(children[p]), leaves[p], below[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())
    return sorted(rows, key=str)


def conversations(r: random.Random, n: int):
    rows = []
    for c in range(n):
        turns = r.choice([1, 1, 2, 3, 5])
        hot = r.random() < 0.4
        for t in range(turns):
            text = "the same words" if hot else r.choice(["a b", "a\tb c", "", None, "word " * 5])
            rows.append((c, r.choice([t, t, None, 1]), r.choice(["user", "assistant", None]) if not hot else "user", text))
    rows += rows[:5]  # repeated turns
    rows += [(None, 0, "user", "nobody's"), (5000, 0, "user", "no base"), (5019, 1, "user", "x"), (77, 3, "us", "er:a b"), (78, 3, "user", ":a b")]
    return rows


@pytest.mark.parametrize(("seed", "n", "tasks"), [(1, 60, 1), (2, 200, 4), (3, 200, 40)])
def test_nodes_as_brute_force(spark, monkeypatch, seed, n, tasks):
    rows = conversations(random.Random(seed), n)
    df = spark.createDataFrame([(*r, "p", "t") for r in rows], SCHEMA).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for waiting, few in ((trie.WAITING, trie.BROADCAST), (3, -1)):
            monkeypatch.setattr(trie, "WAITING", waiting)
            monkeypatch.setattr(trie, "BROADCAST", few)
            monkeypatch.setattr(trie, "CHUNK", 7)
            out = prefix_trie(with_shared_heads(turn_arrays(df)))
            assert out.columns == OUTPUT
            assert sorted(map(tuple, out.collect()), key=str) == brute(rebuilt(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_copies_spread_over_tasks(spark):
    """A hot conversation is cut by many tasks' edges; its pieces are stitched, and no task has most of its rows."""
    convs = [(i, [("user", "hi"), ("assistant", "ho ho")]) for i in range(400)] + [(i, [("user", f"hi {i}")]) for i in range(400, 420)] + [(999, [])]
    df = spark.createDataFrame([(c, [(hashlib.sha256(repr(t).encode()).digest()[:16], len(t[1].split())) for t in turns]) for c, turns in convs], "conv_id long, turns array<struct<key:binary,words:int>>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        laid = trie._laid(df)
        assert laid.groupBy("part").count().agg({"count": "max"}).first()[0] < 200
        out = sorted(map(tuple, prefix_trie(df).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out == brute(convs)
    assert [r for r in out if r[1] == 0] == [(0, 0, None, 421, 21, 21, 399 * 3, hashlib.sha256(b"999").hexdigest())]


def test_query_on_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, trie.op13_prefix_trie(spark, folder).collect()), key=str) == brute(rebuilt(rows))


def test_no_conversations(spark):
    assert prefix_trie(with_shared_heads(turn_arrays(spark.createDataFrame([], SCHEMA)))).collect() == []
