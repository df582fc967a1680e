"""Global row numbers and running totals without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import ordered_checkpoint


def number_rows(df: DataFrame, order: list[str], weight: Column | None = None) -> DataFrame:
    """Add `row_no` (long, from 0, gapless in the order of `order`) and, with `weight`, `weight_before`.

    Rows are range-partitioned and sorted once; the layout is checkpointed, so
    that the second look sees the same partitions. Only one row per partition
    (its count and weight) meets in one place. A tie column splits rows with
    equal keys over partitions; ties are numbered in any order. Null keys come
    first; an empty table gives no rows. All columns of `df` stay as they are, travelling as one value; the new names replace
    columns of the same name.
    """
    weights = F.coalesce(weight.cast("long"), F.lit(0)) if weight is not None else F.lit(0).cast("long")
    keys = [f"key{i}" for i in range(len(order))]
    laid = ordered_checkpoint(
        df.select(F.struct("*").alias("own"), *(F.col(c).alias(k) for c, k in zip(order, keys, strict=True)), weights.alias("weight"), F.monotonically_increasing_id().alias("tie"))
        .repartitionByRange(*keys, "tie")
        .sortWithinPartitions(*keys, "tie")
        .select("own", "weight", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    )
    total = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        laid.groupBy("part")
        .agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
        .select("part", F.coalesce(F.sum("n").over(total), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(total), F.lit(0)).alias("w0"))
    )
    # one row per partition: its size is the partition count, whatever the table's size
    out = laid.join(F.broadcast(parts), "part").withColumn("row_no", F.col("n0") + F.col("at").bitwiseAND((1 << 33) - 1))
    new = ["row_no"]
    if weight is not None:
        inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("weight_before", F.col("w0") + F.coalesce(F.sum("weight").over(inside), F.lit(0)))
        new.append("weight_before")
    return out.select(*(F.col("own")[c].alias(c) for c in df.columns if c not in new), *new)
