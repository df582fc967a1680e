"""An inverted index on disk for BM25 search over several fields (CP16): postings in buckets of terms, of which a search reads its own."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of terms, and the weights of a term's frequency and of a text's length.
BUCKETS, K1, B = 64, 1.2, 0.75


def search_text(*fields: Column, keys: Column | None = None) -> Column:
    """What stands for an entry in the index: its fields that aren't blank, and its keys, one behind the other."""
    parts = [F.when(F.trim(f) != "", f) for f in fields]
    return F.concat_ws(" ", *parts, *([] if keys is None else [F.array_join(keys, " ")]))


def words(text: Column) -> Column:
    """Words of a text in lower case: runs of letters and digits, without stemming."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def write_index(docs: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write the index of `docs` (id, text): postings (term, id, tf, and n, the text's words) by bucket of their term, and one row of totals.

    A text's words are summed up before the shuffle; a term that every text has is split over files of its bucket. Texts without words count in the totals alone; a repeated id is one text's with the same length.
    """
    each = docs.select("id", words(F.col("text")).alias("w")).select("id", F.size("w").alias("n"), F.explode("w").alias("term"))
    postings = each.groupBy("term", "id", "n").agg(F.count("*").cast("int").alias("tf")).withColumn("bucket", (F.crc32(F.col("term").cast("binary")) % buckets).cast("int"))
    postings.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    totals = docs.select(F.size(words(F.col("text"))).alias("n")).agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"))
    totals.select("docs", "words", F.lit(buckets).alias("buckets")).write.mode("overwrite").json(f"{path}/totals")


def search_index(spark: SparkSession, path: str, question: str) -> DataFrame:
    """id and score of the texts that share a word with the question; only the buckets of its words are read. A question without words finds nothing."""
    totals = spark.read.schema("docs long, words long, buckets int").json(f"{path}/totals").first()
    asked = sorted({w for w in "".join(c if c.isalnum() else " " for c in question.lower()).split()})
    wanted = sorted({zlib.crc32(w.encode()) % totals["buckets"] for w in asked})
    found = spark.read.schema("term string, id long, tf int, n int, bucket int").parquet(f"{path}/postings").where(F.col("bucket").isin(wanted) & F.col("term").isin(asked))
    df = found.groupBy("term").agg(F.count("*").alias("df"))  # a row per word of the question
    idf = F.ln(1 + (totals["docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = totals["words"] / max(totals["docs"], 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.lit(max(mean, 1e-9))))
    return found.join(F.broadcast(df), "term").groupBy("id").agg(F.sum(part).alias("score"))
