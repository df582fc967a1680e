"""Operator 3: exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into classes, and classes are cut into blocks of a
bounded size. Every query first meets the blocks of the longest vectors,
which bounds its k-th best score from below. A block whose longest vector can't
reach the bound is left out before anything is shuffled; in the others the bound, raised by
the block's own longest vectors, gives a cosine threshold, by
which a query chooses its pruning: by length (a prefix of the block) or by
coordinate (the values that the query's largest coordinate allows). What is left is
verified by exact integer products.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import materialize

#: Ratio of lengths within a class, and the share of a block above which nothing is pruned.
RATIO, WHOLE = 1.05, 0.6
#: Most components of a block's vectors or of a cell's queries together, and the most rows of either.
COMPONENTS, BLOCK = 1 << 20, 1 << 14
#: Longest vectors that every query meets first, and longest vectors of a block that are scored before it is pruned.
SEEDS, FIRST = 1024, 256
#: Vectors of this length or more could give products beyond 64 bits.
TOO_LONG = 3.03e9
#: Room for rounding when exact scores are compared with bounds in floating point.
SLACK = 1e-9

#: Stands for a null id among candidates, behind all others.
NO_ID = 2**63 - 1


def _usable(df: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    """row, id, v (integer components), norm, dims, class of the vectors without null or non-finite components."""
    finite = "v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    rows = df.select(F.col(id).cast("long").alias("id"), F.expr(f"transform({vector}, x -> cast(x as double))").alias("v")).where(finite)
    out = rows.select(F.monotonically_increasing_id().alias("row"), "id", F.expr(f"transform(v, x -> cast(floor({scale} * x) as bigint))").alias("v"))
    out = out.withColumn("norm", F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + cast(x as double) * x))"))
    out = out.withColumn("norm", F.expr(f"if(norm < {TOO_LONG}D, norm, cast(raise_error('a vector is too long for exact products of 64 bits') as double))"))
    return out.withColumns({"dims": F.size("v"), "class": F.expr(f"if(norm > 0, cast(floor(ln(norm) / ln({RATIO}D)) as int), -1000000)")})


class Block:
    """Vectors of similar length, longest first, with an index of each coordinate that was asked for."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        order = np.argsort(-norms, kind="stable")
        self.rows, self.ids, self.vectors, self.norms = rows[order], ids[order], vectors[order], norms[order]
        self.unit = self.vectors / np.where(self.norms > 0, self.norms, 1)[:, None]
        self.small = float(np.abs(vectors).max(initial=0))
        self.doubles = self.vectors.astype(np.float64)
        self.places = np.arange(len(rows))
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def candidates(self, query: np.ndarray, norm: float, bound: float, start: int = 0) -> np.ndarray | slice:
        """Places from `start` on of all vectors that can score `bound` or more with the query, and of some others."""
        if not (bound > 0 and norm > 0 and len(self.norms) > start and self.norms[start] > 0):
            return slice(start, None)
        least = bound / norm * (1 - SLACK)
        by_length = int(np.searchsorted(-self.norms, -least, side="right"))
        cosine = least / self.norms[start]
        if cosine > 1 or by_length <= start:
            return slice(0, 0)
        unit = query / norm
        f = int(np.argmax(np.abs(unit)))
        # with an angle of at most acos(cosine) to the query, a coordinate stays within that angle of the query's
        angle, reach = np.arccos(np.clip(unit[f], -1, 1)), np.arccos(min(cosine, 1.0))
        low, high = np.cos(min(np.pi, angle + reach)) - SLACK, np.cos(max(0.0, angle - reach)) + SLACK
        if f not in self.sorted:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.sorted[f] = (self.unit[order, f], order)
        values, order = self.sorted[f]
        a, b = np.searchsorted(values, low, side="left"), np.searchsorted(values, high, side="right")
        if min(by_length, b - a) > WHOLE * len(self.norms):
            return slice(start, None)
        return slice(start, by_length) if by_length <= b - a else order[a:b][order[a:b] >= start]

    def _scored(self, row: int, query: np.ndarray, places: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Places but for the query's own row, and their exact products."""
        exact = self.small * float(np.abs(query).max(initial=0)) * max(1, len(query)) < 2**53
        scores = (self.doubles[places] @ query.astype(np.float64)).astype(np.int64) if exact else self.vectors[places] @ query
        places = self.places[places]
        other = self.rows[places] != row
        return places[other], scores[other]

    def best(self, row: int, query: np.ndarray, norm: float, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best of all that score at least `bound`, without the query's own row; ties to smaller ids."""
        places, scores = self._scored(row, query, slice(0, FIRST))
        if len(scores) >= k:
            bound = max(bound, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        more, their = self._scored(row, query, self.candidates(query, norm, bound, min(FIRST, len(self.rows))))
        places, scores = np.append(places, more), np.append(scores, their)
        keep = scores >= bound
        places, scores = places[keep], scores[keep]
        if len(scores) > k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            places, scores = places[scores >= kth], scores[scores >= kth]
        order = np.lexsort((self.ids[places], -scores))[:k]
        return places[order], scores[order]


def _score(cells: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """query_row, query_id, vec_id, score: the k best of every query in every cell (a group of queries and a block)."""

    def run(key: tuple, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(queries) and len(vectors):
            block = Block(vectors["row"].to_numpy(), vectors["id"].to_numpy(), np.stack(vectors["v"].to_numpy()).astype(np.int64))
            for row, id, v, norm, bound in zip(queries["row"], queries["id"], queries["v"], queries["norm"], queries["bound"], strict=True):
                places, scores = block.best(row, np.asarray(v, np.int64), norm, bound, k)
                found += [(row, id, int(block.ids[p]), int(s)) for p, s in zip(places, scores, strict=True)]
        return pd.DataFrame(found, columns=["query_row", "query_id", "vec_id", "score"]).astype("int64")

    by = ["cell", "dims", "class", "block"]
    return cells.groupBy(*by).cogroup(blocks.groupBy(*by)).applyInPandas(run, "query_row long, query_id long, vec_id long, score long")


def _reached(need: str, seeds: bool) -> str:
    """SQL of the classes' array: those that a length of `need` reaches, with their blocks that are seeds, or that are not."""
    blocks = "sequence(0, c.seeds - 1)" if seeds else "sequence(c.seeds, c.blocks - 1)"
    some = "c.seeds > 0" if seeds else f"c.seeds < c.blocks and c.most >= {need}"
    return f"flatten(transform(filter(classes, c -> c.dims = dims and {some}), c -> transform({blocks}, b -> struct(c.class AS class, b AS block))))"


def dealt_vectors(rows: DataFrame, is_query: str, block: int = BLOCK, seeds: int = SEEDS) -> tuple[DataFrame, DataFrame]:
    """The rows in their blocks, and the queries in their groups; queries carry the array `classes` (dims, class, blocks, seeds, most)."""
    # classes of lengths: their number is bounded by the range of doubles (under 15,000), not by the table
    counted = rows.groupBy("dims", "class").agg(F.count("*").alias("n"), F.max("norm").alias("most"), F.count(F.when(F.expr(is_query), 1)).alias("queries")).orderBy("dims", F.desc("class")).collect()
    table, met, asking = [], Counter(), Counter()
    for r in counted:
        asking[r["dims"]] += r["queries"]
    size = {dims: max(1, min(block, COMPONENTS // max(1, dims))) for dims in asking}
    for r in counted:
        dims, n = r["dims"], r["n"]
        blocks = -(-n // size[dims])
        first = min(blocks, max(0, -(-(seeds - met[dims]) * blocks // n)))  # of blocks of n / blocks rows each
        met[dims] += first * n / blocks
        table.append(f"struct({dims} AS dims, {r['class']} AS class, {blocks} AS blocks, {first} AS seeds, {r['most']!r}D AS most, {max(1, -(-asking[dims] // size[dims]))} AS groups)")
    known = F.expr(f"array({', '.join(table)})") if table else F.expr("cast(array() as array<struct<dims:int,class:int,blocks:int,seeds:int,most:double,groups:int>>)")
    own = F.expr("filter(classes, c -> c.dims = dims and c.class = class)[0].blocks")
    vectors = rows.withColumn("classes", known).withColumn("block", F.pmod(F.xxhash64("row"), own).cast("int")).select("dims", "class", "block", "row", F.coalesce("id", F.lit(NO_ID)).alias("id"), "v")
    queries = rows.where(is_query).withColumn("classes", known)
    return vectors, queries.withColumn("cell", F.pmod(F.xxhash64("row", F.lit(1)), F.expr("filter(classes, c -> c.dims = dims)[0].groups")).cast("int")).drop("class")


def _cells(queries: DataFrame, vectors: DataFrame, seeds: bool) -> tuple[DataFrame, DataFrame]:
    """Queries (with `bound` and `need`) at each block that they reach, and the vectors of each block at the groups of queries that reach it."""
    groups = queries.groupBy("cell", "dims", "classes").agg(F.min("need").alias("need"))
    reached = groups.select("cell", "dims", F.inline(F.expr(_reached("need", seeds))))
    at = queries.select("cell", "dims", "row", "id", "v", "norm", "bound", F.inline(F.expr(_reached("need", seeds))))
    # new names of the columns: the two sides of a cell must not share them
    return at.select(*(F.col(c).alias(f"{c}_") for c in at.columns)).toDF(*at.columns), vectors.join(reached, ["dims", "class", "block"])


def top_products(df: DataFrame, is_query: str, k: int = 5, id: str = "vec_id", vector: str = "embedding", scale: int = 256, block: int = BLOCK, seeds: int = SEEDS) -> DataFrame:
    """The k highest integer products of every query row (SQL condition `is_query` on `id`) with all other rows.

    query_id, rank (int, from 1), vec_id, score; ties go to the smaller vec_id, nulls last. Components are
    floor(scale * x). Vectors that are null or hold null or non-finite components take no part; vectors of
    different lengths don't meet; one whose products could exceed 64 bits (length TOO_LONG) is an error. Repeated rows are rows of their own. A query with fewer than k others gets
    them all; an empty table gives no rows. Other columns are dropped. `block` and `seeds` change the work, not the result.
    """
    rows = materialize(_usable(df, id, vector, scale), "vectors")
    vectors, queries = dealt_vectors(rows, is_query, block, seeds)
    lowest = F.lit(-(2**63)).cast("long")
    seen = materialize(_score(*_cells(queries.withColumns({"bound": lowest, "need": F.lit(0.0)}), vectors, True), k), "seen")
    bounds = seen.groupBy("query_row").agg(F.sort_array(F.collect_list("score"), False)[k - 1].alias("bound")).select(F.col("query_row").alias("row"), "bound")
    bounded = queries.join(bounds, "row", "left").withColumn("bound", F.coalesce("bound", lowest))
    bounded = bounded.withColumn("need", F.when((F.col("bound") > 0) & (F.col("norm") > 0), F.col("bound") / (F.col("norm") * (1 + SLACK))).otherwise(0.0))
    best = seen.unionByName(_score(*_cells(bounded, vectors, False), k))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    out = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.when(F.col("vec_id") < NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def op3_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best others of every fiftieth vector; see `top_products`."""
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 50 = 0")


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
