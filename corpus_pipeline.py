"""The corpus pipeline: quality rules, near-dedup, substring dedup, secret scans, best-fit packing.

Each stage takes the documents that the one before kept, and returns them with its decisions
carried out. All but the last return the columns of `documents`; n_chars follows the text.
The last returns where every piece of every document is placed. Stages take any table with these columns: other columns
are dropped, an empty table gives no rows, and nulls are allowed in every column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.llm.near import drop_near_duplicates
from siftmark.llm.packing import pack_documents
from siftmark.llm.quality import drop_rejected
from siftmark.llm.scratch import materialize
from siftmark.llm.secret_scan import mask_secrets
from siftmark.llm.substrings import dedup_substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a distance to their language reject are dropped.

    Null, empty and very short texts fail the base rules. A null or other language has no distance, so the base rules alone decide.
    Repeated rows share their verdict.
    """
    return drop_rejected(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays, a null id first; of rows with equal ids the first read.

    Texts without words are one class.
    """
    return drop_near_duplicates(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 35-word windows that repeat anywhere are cut out; a document that loses all its words stays, empty.

    A null text becomes an empty one. Repeated rows cut one another.
    """
    kept = [c for c in COLUMNS if c not in ("text", "n_chars")]
    out = dedup_substrings(docs.select(*kept, "text"), 35, "text", tuple(kept))
    return out.withColumnRenamed("kept", "text").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that look like secrets are replaced by a mark; null and empty texts stay as they are, repeated rows are masked alike."""
    out = mask_secrets(docs.select("doc_id", "text", "lang", "source"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as sequences of at most 2048 tokens: one row per piece. A null or empty text is the end token alone; repeated rows are packed each by itself."""
    import public_tokenizers

    return pack_documents(docs, 2048, public_tokenizers.path("word_bpe_49k.json"), 0)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("secrets", secrets), ("packing", packing)]

#: The tokenizer, near duplicates and the novelty of strings can't be put into SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
