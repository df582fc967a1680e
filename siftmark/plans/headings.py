"""Sections of Markdown texts and the tree that their headings form (CP5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Levels of headings.
LEVELS = 6


def heading_sections(docs: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """`id`, node (from 1, in order), level, title, parent (a node, null at the top) and text of the sections of each text.

    A line of one to six `#`, a blank and something else is a heading, unless it stands in a fence of three backticks. A section holds the lines up to the next heading; a heading's parent is the
    nearest one before it with a lower level. Lines before the first heading belong to none; a text without headings, and a null one, has no sections.
    Lines are windows' rows, so a long text is sorted, not collected; only a section is one value.
    """
    lines = docs.select(F.col(id), F.posexplode(F.split(text, "\n")).alias("n", "line"))
    up_to = Window.partitionBy(id).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fences = F.sum(F.col("line").startswith("```").cast("int")).over(up_to)
    marks = F.length(F.regexp_extract("line", r"^(#{1,6})[ \t]+\S", 1))
    known = lines.withColumn("fences", fences).withColumn("level", F.when((marks > 0) & (F.col("fences") % 2 == 0), marks))
    placed = known.withColumn("node", F.count("level").over(up_to)).where("node > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("n", "line")))), lambda x: x["line"]), "\n")
    title = F.trim(F.regexp_replace(F.max(F.when(F.col("level").isNotNull(), F.col("line"))), r"^#{1,6}[ \t]+", ""))
    sections = placed.groupBy(id, "node").agg(F.max("level").alias("level"), title.alias("title"), body.alias("text"))
    before = Window.partitionBy(id).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.max(F.when(F.col("level") == k, F.col("node"))).over(before) for k in range(1, LEVELS)}
    sections = sections.withColumns({f"_{k}": c for k, c in last.items()})
    lower = reduce(lambda x, k: F.greatest(x, F.when(F.col("level") > k, F.col(f"_{k}"))), range(1, LEVELS), F.lit(None).cast("long"))
    return sections.select(id, "node", "level", "title", lower.alias("parent"), "text")
