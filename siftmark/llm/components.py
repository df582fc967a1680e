"""Connected components of an edge table.

A table of up to LOCAL edges is joined up by one task. A larger one goes through rounds: tasks
of about LOCAL edges replace theirs by a star per local component, and a large-star
and a small-star step tie these together, until nothing changes or LOCAL edges are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

#: Edges of a task: its tables take about 100 bytes for each.
LOCAL = 100_000


def _stars(edges: DataFrame) -> DataFrame:
    """u, v: every node of a partition's edges with the smallest node of its local component, where that is another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = root(u), root(v)
                up[max(a, b)] = min(a, b)
        nodes = [x for x in up if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _dealt(edges: DataFrame, count: int, local: int) -> DataFrame:
    """Edges in tasks of about `local`, those of one v together unless it has more."""
    hot = edges.groupBy("v").count().where(F.col("count") > local).select("v", F.ceil(F.col("count") / local).alias("parts"))
    salted = edges.join(hot, "v", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("u"), "parts"), F.lit(0)))
    return salted.repartition(-(-count // local), "v", "salt").select("u", "v")


def _tied(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step over edges with u > v. Minima are combined before the shuffles."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    large = materialize(large, "large")
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", local: int = LOCAL) -> DataFrame:
    """node and component (its smallest node) of every node that has an edge to another.

    Rounds grow with the logarithm of the longest path. Each is written to the shared folder.
    Loops, repeated and reversed edges make no difference; no edges give no rows.
    """
    # u > v always
    now = materialize(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "edges")
    before = None
    while True:
        count, state = now.select(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF)), F.lit(0))).first()
        if count <= local:
            now = materialize(_stars(now.repartition(1)), "stars")
            break
        if (count, state) == before:
            break
        before = count, state
        now = materialize(_tied(_stars(_dealt(now, count, local))), "edges")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
