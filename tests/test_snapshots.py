"""Tables replaced by key in snapshots, the index on top of them, and streams into them: failures, replays, restarts."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftmark.sources.snapshots import INDEX, Snapshots, apply_index, index_rows
from siftmark.streaming.folds import keyed_stream, paired_streams

ROWS = "key string, n long"


def rows(spark, *x):
    return spark.createDataFrame(list(x), ROWS)


def held(table):
    return sorted(map(tuple, table.read().collect()), key=repr)


def test_replace(spark, tmp_path):
    t = Snapshots(spark, f"file://{tmp_path}/t", ROWS, "key", 4)
    assert held(t) == [] and t.version() == 0
    assert t.replace(rows(spark, ("a", 0), ("b", 0)), rows(spark, ("a", 1), ("a", 2), ("b", 3), ("other", 9)))
    assert held(t) == [("a", 1), ("a", 2), ("b", 3)]  # rows of other keys are ignored
    before = t.read()
    assert t.replace(rows(spark, ("a", 0), ("c", 0)), rows(spark, ("a", 7)))
    assert held(t) == [("a", 7), ("b", 3)] and t.version() == 2
    assert sorted(map(tuple, before.collect())) == [("a", 1), ("a", 2), ("b", 3)]  # an earlier reader still sees what it saw
    assert not t.replace(rows(spark), rows(spark, ("a", 8))) and t.version() == 2
    assert t.replace(rows(spark, ("a", 0), ("b", 0)), rows(spark)) and held(t) == []
    assert t.replace(rows(spark, ("z", 0)), rows(spark, ("z", None), ("z", None))) and held(t) == [("z", None), ("z", None)]


def test_null_keys_are_never_held(spark, tmp_path):
    t = Snapshots(spark, f"file://{tmp_path}/t", ROWS, "key", 4)
    t.replace(rows(spark, (None, 0), ("a", 0)), rows(spark, (None, 1), ("a", 1)))
    assert held(t) == [("a", 1)]


def test_newest(spark, tmp_path):
    t = Snapshots(spark, f"file://{tmp_path}/t", ROWS, "key", 2)
    for batch, x in enumerate([[("a", 1), ("a", 1), ("b", 5)], [("a", 0), ("b", 5), ("b", 4)], [("a", 2)]]):
        t.replace(rows(spark, *x), rows(spark, *x), "w", batch, "n")
    assert held(t) == [("a", 2), ("b", 5), ("b", 5)]


def test_a_writer_that_fails_leaves_nothing(spark, tmp_path, monkeypatch):
    t = Snapshots(spark, f"file://{tmp_path}/t", ROWS, "key", 4)
    t.replace(rows(spark, ("a", 0)), rows(spark, ("a", 1)))
    with monkeypatch.context() as m:
        m.setattr(Snapshots, "_there", lambda self, name: (_ for _ in ()).throw(OSError("lost")) if name.startswith("data/") else True)
        with pytest.raises(OSError):
            t.replace(rows(spark, ("a", 0), ("b", 0)), rows(spark, ("a", 2), ("b", 2)))
    assert held(t) == [("a", 1)] and t.version() == 1
    assert t.replace(rows(spark, ("b", 0)), rows(spark, ("b", 3)))  # over what was left
    assert held(t) == [("a", 1), ("b", 3)] and t.version() == 2


def test_batches_are_committed_once(spark, tmp_path):
    t = Snapshots(spark, f"file://{tmp_path}/t", ROWS, "key", 4)
    assert t.replace(rows(spark, ("a", 0)), rows(spark, ("a", 1)), "w", 0)
    assert t.replace(rows(spark, ("a", 0)), rows(spark, ("a", 2)), "w", 1)
    for batch in (0, 1):
        assert not t.replace(rows(spark, ("a", 0)), rows(spark, ("a", 99)), "w", batch)
    assert t.replace(rows(spark, ("b", 0)), rows(spark, ("b", 5)), "v", 0)  # another writer has its own numbers
    assert held(t) == [("a", 2), ("b", 5)]


def test_index_equals_a_rebuild(spark, tmp_path):
    files = lambda *x: spark.createDataFrame(list(x), "path string, text string")
    index = Snapshots(spark, f"file://{tmp_path}/i", INDEX, "path", 4)
    states = [files(("a", "1\n2"), ("b", "x"), ("c", "")), files(("a", "1\n2"), ("b", "y\nz"), ("d", "new")), files(), files(("e", None), ("a", "q"))]
    for number, state in enumerate(states, 1):
        assert apply_index(index, state) and index.version() == number
        assert not apply_index(index, state) and index.version() == number
        want = index_rows(state.where("text is not null"))
        assert sorted(map(tuple, index.read().where("text is not null").collect())) == sorted(map(tuple, want.collect()))
    assert {r["path"] for r in index.read().collect()} == {"a"}  # a file without a text counts as gone


def test_stream_that_is_replayed(spark, tmp_path):
    t = Snapshots(spark, f"file://{tmp_path}/t", ROWS, "key", 4)
    path = f"file://{tmp_path}/in"
    for batch in ([("a", 1), ("b", 1)], [("a", 2)], [("c", 3), ("a", 3)]):
        rows(spark, *batch).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(ROWS).parquet(path)
        keyed_stream(stream, t, f"file://{tmp_path}/c", "w").awaitTermination()
    assert held(t) == [("a", 3), ("b", 1), ("c", 3)]
    # a checkpoint that is lost makes the stream begin anew; what its writer has committed stays
    version = t.version()
    keyed_stream(spark.readStream.schema(ROWS).parquet(path), t, f"file://{tmp_path}/c2", "w").awaitTermination()
    assert held(t) == [("a", 3), ("b", 1), ("c", 3)] and t.version() == version


def test_pairs_leave_no_state(spark, tmp_path):
    start = datetime(2024, 1, 1)
    batches = [[(1, 10, 0, "b"), (2, 11, 1, "b"), (1, 12, 5, "e")], [(2, 13, 40, "e"), (3, 14, 41, "b")], [(3, 15, 2000, "e"), (9, 16, 9000, "b"), (9, 17, 9001, "e")], [(8, 18, 20000, "b"), (8, 19, 20000, "e")], [(7, 20, 20001, "b"), (7, 21, 20001, "e")]]
    path, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    schema = "call long, id long, ts timestamp, kind string"
    for batch in batches:
        spark.createDataFrame([(c, i, start + timedelta(minutes=m), k) for c, i, m, k in batch], schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        side = lambda k, name: stream.where(F.col("kind") == k).select("call", F.col("id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_ts"))
        query = paired_streams(side("b", "begin"), side("e", "end")).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, 10, 12), (2, 11, 13), (7, 20, 21), (8, 18, 19), (9, 16, 17)]
    left = [s["numRowsTotal"] for p in [query.lastProgress] for s in p["stateOperators"]]
    assert left and max(left) <= 4  # what came last; nothing of the earlier calls
