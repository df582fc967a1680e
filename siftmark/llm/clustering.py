"""Operator 12: clusters around centroids, over distinct vectors with multiplicities.

Vectors become integers, and equal ones are grouped and counted once. Lloyd's rounds then
run over the distinct vectors: each task adds up its own in integers, times their
multiplicities, and only sums by centroid and component meet. So copies cost a round nothing,
results don't depend on how rows are dealt, and ties go to the smaller number. At the end the
distinct vectors' clusters are joined back to all rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import discard, materialize

#: Largest component: squared distances of up to 4,096 components then stay within 64 bits.
LARGEST = 1 << 24
#: A vector with more than this share of all rows is hot; there are at most as many as the share allows.
HOT = 1 / 1000


def quantised(df: DataFrame, id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """id and v (integer components) of the vectors with `dims` components, none of them null or non-finite; others are left out.

    A component beyond LARGEST is an error.
    """
    whole = f"size(v) = {dims} and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    rows = df.select(F.col(id).alias("id"), F.expr(f"transform(`{vector}`, x -> cast(x as double))").alias("v")).where(whole)
    far = f"if(abs({scale}D * x) < {LARGEST}D, {scale}D * x, cast(raise_error('a component is too large for exact distances of 64 bits') as double))"
    return rows.withColumn("v", F.expr(f"transform(v, x -> cast(floor({far}) as int))"))


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each vector's nearest centroid, the smaller one of equals, and the squared distance: exact integers."""
    best, at = np.full(len(vectors), np.iinfo(np.int64).max), np.zeros(len(vectors), np.int64)
    if not len(vectors) or not len(centroids):
        return at, best
    largest = max(int(np.abs(vectors).max()), int(np.abs(centroids).max()), 1)
    if 4 * largest * largest * vectors.shape[1] < 1 << 53:  # then doubles are exact, too
        x, c = vectors.astype(np.float64), centroids.astype(np.float64)
        found = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
        at = found.argmin(1)
        return at, found[np.arange(len(x)), at].astype(np.int64)
    for k, centroid in enumerate(centroids):
        distance = ((vectors - centroid) ** 2).sum(1)
        less = distance < best
        best[less], at[less] = distance[less], k
    return at, best


def _vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(-1, dims).astype(np.int64)


def _sums(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, n and sums (by component) of the vectors nearest to each centroid: at most a row per centroid and task."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors, weight = _vectors(batch, dims), batch.column("weight").to_numpy()
                at, _ = nearest(vectors, centroids)
                order = np.argsort(at, kind="stable")
                found, first = np.unique(at[order], return_index=True)
                n[found] += np.add.reduceat(weight[order], first)
                sums[found] += np.add.reduceat((vectors * weight[:, None])[order], first, axis=0)
        some = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * dims, pa.int32()), pa.array(sums[some].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), lists], ["cluster", "n", "sums"])

    return distinct.mapInArrow(run, "cluster long, n long, sums array<bigint>")


def _moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: exact floors of the means; those without vectors stay."""
    parts = _sums(distinct, centroids).select("cluster", "n", F.posexplode("sums").alias("place", "part"))
    # centroids x components come to the driver, whatever the number of vectors
    found = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).collect()
    out = centroids.copy()
    for r in found:
        out[r["cluster"], r["place"]] = r["total"] // r["n"]
    return out


def _assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """v, weight, cluster and distance of every distinct vector."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, distance = nearest(_vectors(batch, dims), centroids) if batch.num_rows else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("weight"), pa.array(at, pa.int32()), pa.array(distance)], ["v", "weight", "cluster", "distance"])

    return distinct.mapInArrow(run, "v array<int>, weight long, cluster int, distance long")


def cluster_vectors(df: DataFrame, id: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 256, count: int = 40, rounds: int = 5, seed: str = "2") -> DataFrame:
    """`id`, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector with `dims` components, all of them finite.

    Components are floor(scale * x). The first `count` centroids are the vectors with the smallest SHA-256 of `seed`, a colon and their id;
    null ids come last, equal ids by their components. `rounds` of Lloyd follow. Repeated rows are assigned alike, each by a row of its own.
    Fewer vectors than `count` give fewer centroids; equal centroids leave all but the first without vectors. An empty
    table gives no rows. Other columns of `df` are dropped, so names can't clash.
    """
    rows = materialize(quantised(df, id, vector, dims, scale), "quantised")
    distinct = materialize(rows.groupBy("v").agg(F.count("*").alias("weight")), "distinct")
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(start.asc_nulls_last(), "v").limit(count).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, dims)
    for _ in range(rounds):
        centroids = _moved(distinct, centroids)
    assigned = materialize(_assigned(distinct, centroids), "assigned")
    # a row per centroid
    by_cluster = {r["cluster"]: (r["d"], r["n"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("weight") * F.col("distance")).alias("d"), F.sum("weight").alias("n")).collect()}
    inertia, total = (sum(x) for x in zip(*by_cluster.values(), strict=True)) if by_cluster else (0, 0)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = [(k, by_cluster[k][0], inertia, digests[k]) for k in sorted(by_cluster)]
    about = df.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # hot vectors are fewer than 1 / HOT and go to all tasks, so no key of the join below has more than that share of the rows
    hot = assigned.where(F.col("weight") > total * HOT).select("v", "cluster", "distance")
    near = rows.join(F.broadcast(hot), "v", "left")
    rest = near.where("cluster is null").select("id", "v").join(assigned.select("v", "cluster", "distance"), "v")
    out = near.where("cluster is not null").select("id", "cluster", "distance").unionByName(rest.select("id", "cluster", "distance"))
    discard(distinct)
    return out.join(F.broadcast(about), "cluster").select(F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_weighted_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every embedding of 64 components; see `cluster_vectors`."""
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round(i: int) -> str:
    """SQL of the vectors' nearest centroids c{i}, and of the centroids after that."""
    return f"""n{i} AS MATERIALIZED (SELECT r, any_value(v) AS v, min({{'d': CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'k': k}}) AS m FROM x CROSS JOIN c{i} GROUP BY r),
s{i} AS (SELECT k, pos, sum(value) AS s, count(*) AS n FROM (SELECT m.k AS k, unnest(v) AS value, generate_subscripts(v, 1) AS pos FROM n{i}) GROUP BY k, pos),
c{i + 1} AS MATERIALIZED (SELECT k, coalesce(moved, c) AS c FROM c{i} LEFT JOIN (SELECT k, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY pos) AS moved FROM s{i} GROUP BY k) USING (k))"""


OP12_SQL = f"""
WITH x AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda y: CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = 64),
c0 AS MATERIALIZED (SELECT k, v AS c FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS k, v FROM x) WHERE k < 40),
{", ".join(_round(i) for i in range(5))},
f AS MATERIALIZED (SELECT r, min({{'d': CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'k': k}}) AS m FROM x CROSS JOIN c5 GROUP BY r)
SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM x JOIN f USING (r) JOIN c5 ON c5.k = m.k
"""
