"""Centroid clustering against brute force: nulls, ties, repeated rows, hot vectors, empty tables, clashing column names."""

import hashlib
import math
import random

import numpy as np
import pytest

from siftmark.llm import clustering
from siftmark.llm.clustering import cluster_vectors, nearest

SCHEMA = "vec_id long, embedding array<float>, cluster string, v string, weight string"
OUT = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(rows, dims, count, rounds=5, seed="2"):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: (i is None, "" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:count]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        groups: dict[int, list] = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(centroids)]
    found = [(i, *near(v)) for i, v in kept]
    by: dict[int, int] = {}
    for _, d, k in found:
        by[k] = by.get(k, 0) + d
    return sorted(((i, k, d, by[k], sum(by.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, d, k in found), key=str)


def vectors():
    r = random.Random(12)
    rows = [(i, [r.choice([-1.5, -0.25, 0.0, 0.125, 2.75]) + (r.random() if i % 3 else 0) for _ in range(4)]) for i in range(120)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(120, 200)]  # a hot vector
    rows += [(7, rows[7][1]), (7, [9.0, 9.0, 9.0, -9.0]), (None, [1.0, 2.0, 3.0, 4.0]), (None, [0.5, 0.5, 0.5, 0.5])]
    rows += [(300, None), (301, []), (302, [1.0, None, 2.0, 3.0]), (303, [1.0, math.nan, 2.0, 3.0]), (304, [1.0, math.inf, 2.0, 3.0]), (305, [1.0, 2.0, 3.0]), (306, [1.0] * 5)]
    return rows


@pytest.mark.parametrize(("count", "hot"), [(6, clustering.HOT), (6, 2), (300, 0.1)])
def test_clusters_as_brute_force(spark, monkeypatch, count, hot):
    monkeypatch.setattr(clustering, "HOT", hot)
    rows = vectors()
    df = spark.createDataFrame([(i, v, "c", "v", "w") for i, v in rows], SCHEMA).repartition(5)
    out = cluster_vectors(df, dims=4, count=count)
    assert out.columns == OUT
    assert dict(out.dtypes) == dict.fromkeys(["vec_id", "distance", "cluster_inertia", "inertia"], "bigint") | {"cluster": "int", "centroid_sha256": "string"}
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows, 4, count)


def test_query_on_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert sorted(map(tuple, clustering.op12_weighted_lloyd(spark, folder).collect()), key=str) == brute(rows, 64, 40)


def test_no_vectors(spark):
    assert cluster_vectors(spark.createDataFrame([], SCHEMA), dims=4).collect() == []
    assert cluster_vectors(spark.createDataFrame([(1, None, "", "", ""), (2, [1.0], "", "", "")], SCHEMA), dims=4).collect() == []


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="too large for exact distances"):
        cluster_vectors(spark.createDataFrame([(1, [1e6, 0.0], "", "", "")], SCHEMA), dims=2).collect()


def test_nearest_is_exact_with_large_components():
    r = np.random.RandomState(3)
    for top in (100, clustering.LARGEST - 1):
        x, c = r.randint(-top, top, (200, 64)), r.randint(-top, top, (9, 64))
        c[5] = c[2]
        at, distance = nearest(x.astype(np.int64), c.astype(np.int64))
        for i in range(len(x)):
            want = min((sum((int(a) - int(b)) ** 2 for a, b in zip(x[i], y, strict=True)), k) for k, y in enumerate(c))
            assert (int(distance[i]), int(at[i])) == want
