"""Hybrid ranked retrieval over text units (CP1 to CP4, TK1 to TK3, WN2, WN3).

Scores are expressions over one scan. Ranks, path anchors and directory anchors are windows and small
aggregates over scored rows; texts are left out as soon as their tokens are compared.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_rank, top_per
from ..functions.text import ancestors, directory, overlap_score, path_hints, repo_path, search_tokens


#: The scored rows of the last retrieval.
_KEPT: list[DataFrame] = []


def _kept(df: DataFrame) -> DataFrame:
    """Narrow rows without texts, which both ranks and both anchors read, stay in memory until the next retrieval's replace them."""
    while _KEPT:
        if _KEPT[-1].sparkSession is df.sparkSession:
            _KEPT[-1].unpersist()
        _KEPT.pop()
    _KEPT.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return _KEPT[0]


def clean_weight(value: float | None, other: float) -> float:
    """A weight in [0, 1]: non-finite gives the default, negative gives 0 (SF37)."""
    if value is None or value != value or value in (float("inf"), float("-inf")):
        return other
    return min(max(value, 0.0), 1.0)


def bounded_int(value: object, other: int, least: int, most: int) -> int:
    """A request's number within bounds, without its fraction; anything that is no finite number gives the default (TK11)."""
    try:
        return min(max(int(float(value)), least), most)
    except (TypeError, ValueError, OverflowError):
        return other


@dataclass(frozen=True)
class Weights:
    """The shares of the parts of a score."""

    semantic: float = 0.62
    lexical: float = 0.22
    rrf: float = 0.08
    changed_path: float = 0.16
    same_directory: float = 0.08
    pattern: float = 0.03
    symbol: float = 0.02
    chunk: float = 0.03


def node_title(path: Column, text: Column) -> Column:
    """What stands for a unit in the title comparison: its path and 180 characters of its first line (SF12)."""
    return F.trim(F.concat(path, F.lit("  "), F.substring(F.substring_index(text, "\n", 1), 1, 180)))


def lexical_input(path: Column, text: Column) -> Column:
    """What stands for a unit in the text comparison: its path, the path's words, and 2,200 characters (SF12)."""
    return F.concat(path, F.lit(" "), F.regexp_replace(path, "[._/-]+", " "), F.lit("  "), F.substring(text, 1, 2200))


def path_boost(path: Column, changed: list[str], hints: Column, w: Weights) -> Column:
    """Nearness of a path to the changed ones, and 0.04 where the query names a part of it (SF11)."""
    dirs = sorted({p.rpartition("/")[0] for p in changed if "/" in p})
    near = F.when(path.isin(changed), w.changed_path).when(directory(path).isin(dirs), w.same_directory).otherwise(0.0) if changed else F.lit(0.0)
    return near + F.when(F.exists(hints, lambda h: F.contains(F.lower(path), h)), 0.04).otherwise(0.0)


def rank_fusion(df: DataFrame, semantic: str = "semantic", lexical: str = "lexical", id: str = "id") -> DataFrame:
    """Add `rrf`: 1 / (50 + rank) for both orders; equal scores rank by descending id (WN2, CP2)."""
    ranked = global_rank(global_rank(df, semantic, id, "_by_semantic"), lexical, id, "_by_lexical")
    return ranked.withColumn("rrf", 1 / (50 + F.col("_by_semantic")) + 1 / (50 + F.col("_by_lexical"))).drop("_by_semantic", "_by_lexical")


def scored_units(units: DataFrame, query: str, changed: list[str], weights: Weights = Weights()) -> DataFrame:
    """Units with all parts of their score (CP1): the texts' own parts, rank fusion, directory affinity, file anchor."""
    w = weights
    q, hints = search_tokens(F.lit(query)), path_hints(F.lit(query))
    kind = F.col("kind")
    base = (
        units.withColumn("path", repo_path(F.col("path")))
        # tokens are columns of their own: a score refers to them several times
        .withColumns({"_title": search_tokens(node_title(F.col("path"), F.col("text"))), "_input": search_tokens(lexical_input(F.col("path"), F.col("text")))})
        .withColumns({"semantic": overlap_score(q, F.col("_title")), "lexical": overlap_score(q, F.col("_input"))})
        .withColumn("path_boost", path_boost(F.col("path"), changed, hints, w))
        .withColumn("pattern_boost", F.when(F.col("is_pattern"), w.pattern).otherwise(0.0))
        .withColumn("kind_boost", F.when(kind == "symbol", w.symbol).when(kind == "chunk", w.chunk).otherwise(0.0))
        .select("id", "path", "kind", "semantic", "lexical", "path_boost", "pattern_boost", "kind_boost")
    )
    base = base.withColumn("base", F.col("semantic") * w.semantic + F.col("lexical") * w.lexical + F.col("path_boost") + F.col("pattern_boost") + F.col("kind_boost"))
    base = _kept(base)
    # CP3: the best of a path is its anchor
    best = base.groupBy("path").agg(F.greatest(F.lit(0.0), F.max(F.col("semantic") * 0.66 + F.col("lexical") * 0.34 + F.col("path_boost"))).alias("anchor"))
    anchored = base.join(best, "path")
    share = F.when(kind == "file", 0.07).when(kind == "symbol", 0.15).otherwise(0.12)
    anchored = anchored.withColumn("file_anchor", F.least(F.lit(0.18), F.col("anchor") * share))
    fused = rank_fusion(anchored)
    affine = directory_affinity(fused, changed, w)
    return affine.withColumn("score", F.col("base") + F.col("rrf") * w.rrf + F.col("affinity") + F.col("file_anchor"))


def directory_affinity(df: DataFrame, changed: list[str], w: Weights) -> DataFrame:
    """Add `affinity` from `path` and `anchor` (CP4): anchors fade by 0.82 for each directory up, changed directories are seeded."""
    spark = df.sparkSession
    dirs = sorted({p.rpartition("/")[0] for p in changed if "/" in p})
    up = df.select("path", "anchor").distinct().select("anchor", F.posexplode(ancestors(F.col("path"))).alias("level", "dir"))
    spread = up.select("dir", (F.col("anchor") * F.pow(F.lit(0.82), F.col("level"))).alias("value"))
    seeds = [(x, 0.72) for x in dirs] + [(x.rpartition("/")[0], 0.54) for x in dirs if "/" in x]
    if seeds:
        spread = spread.unionByName(spark.createDataFrame(seeds, "dir string, value double"))
    anchors = spread.groupBy("dir").agg(F.max("value").alias("dir_anchor"))
    near = df.withColumn("dir", directory(F.col("path"))).join(anchors, "dir", "left")
    reach = F.when(F.col("dir") == "", 0.0).when(F.col("dir").isin(dirs), w.same_directory).otherwise(F.least(F.lit(w.same_directory), F.greatest(F.lit(0.0), F.coalesce("dir_anchor", F.lit(0.0))) * 0.12))
    return near.withColumn("affinity", reach).drop("dir", "dir_anchor")


def diversified_top(df: DataFrame, k: int = 28, per_path: int = 6, changed: list[str] | None = None) -> DataFrame:
    """The k best rows, spread over paths (TK1): `phase` and `place` are added.

    Phase 0: the best row of each changed path, up to a third of k. Phase 1: rows in order of score while their path has
    room; anchors take up room. Phase 2: what had no room. Ties go to the larger id. A blank path has no limit.
    """
    k, per_path = bounded_int(k, 28, 4, 60), bounded_int(per_path, 6, 1, 12)  # TK2
    order = [F.desc("score"), F.desc("id")]
    slots = min(k, max(2, -(-k // 3)))
    blank = F.coalesce("path", F.lit("")) == ""
    # k rows of a path come before its next one in every phase, so that one can't be among the first k
    best = top_per(df, ["path"], order, k, "_in_path")
    anchors = best.where((F.col("_in_path") == 1) & F.col("path").isin(changed or []) & ~blank).orderBy(*order).limit(slots)
    # at most a third of 60 rows
    marked = best.join(F.broadcast(anchors.select("id", F.lit(True).alias("_anchor"))), "id", "left").withColumn("_anchor", F.coalesce("_anchor", F.lit(False)))
    taken = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("_anchor"), *order))
    phased = marked.withColumn("phase", F.when(F.col("_anchor"), 0).when(blank | (taken <= per_path), 1).otherwise(2))
    top = phased.orderBy("phase", *order).limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy("phase", *order))).drop("_in_path", "_anchor")
