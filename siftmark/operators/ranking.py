"""Ranks and tops that don't bring all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Score steps and ids of a bucket in `global_rank`.
STEPS, IDS = 4096, 100_000


def global_rank(df: DataFrame, score: str, id: str, name: str) -> DataFrame:
    """Add the row's place (from 1) by descending `score` in [0, 1], then descending `id`.

    Rows fall into buckets of like scores, rows with score 0 into buckets of ids; a rank is the
    size of all buckets before plus the place within. Only bucket sizes meet in one task.
    """
    bucket = [F.floor(F.col(score) * STEPS).alias("_s"), F.when(F.col(score) == 0, F.floor(F.col(id) / IDS)).otherwise(0).alias("_i")]
    rows = df.select("*", *bucket)
    before = Window.orderBy(F.desc("_s"), F.desc("_i")).rowsBetween(Window.unboundedPreceding, -1)
    # STEPS rows and one per IDS rows of the table
    sizes = rows.groupBy("_s", "_i").agg(F.count("*").alias("_n")).select("_s", "_i", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_s", "_i").orderBy(F.desc(score), F.desc(id)))
    return rows.withColumn(name, inside).join(sizes, ["_s", "_i"]).withColumn(name, F.col(name) + F.col("_before")).drop("_s", "_i", "_before")


def top_per(df: DataFrame, by: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group, with their place; groups are cut to n before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)
