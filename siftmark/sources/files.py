"""File sources and sinks (SC1, SC7, SC9 to SC11, SC17)."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.procedures import exploded, find_json

# Directories that a walk leaves out.
IGNORED = [".git", "node_modules", "dist", "build", "var"]


def walk(spark: SparkSession, root: str, ignored: list[str] = IGNORED) -> DataFrame:
    """path (below the root), length and content of the files below a directory, without those in ignored ones (SC1).

    `content` is only read where it is asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    skip = "|".join("\\" + d if d.startswith(".") else d for d in ignored)
    return files.where(~F.col("path").rlike(f"/(?:{skip})/")).select("path", "length", "content")


def read_config(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Fields of JSON configuration files, one row per file, with `warning` (SC7)."""
    return parse_configs(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text")), schema)


def parse_configs(texts: DataFrame, schema: StructType | str) -> DataFrame:
    """Fields of configurations (file, text), one row per file, with `warning`: broken JSON is repaired by looking for an object in it, simple `key: value` lines are read as they are, else fields are null."""
    import json

    import pyarrow as pa

    keys = set((schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).fieldNames())
    repaired = exploded(texts, "file", "text", lambda x: [_repair(x, keys, json)], [("json", pa.string(), "string"), ("warning", pa.string(), "string")])
    return repaired.select("file", F.from_json("json", schema).alias("c"), "warning").select("file", "c.*", "warning")


def _repair(text: str, keys: set[str], json) -> tuple[str | None, str | None]:
    try:
        if isinstance(value := json.loads(text), dict):
            unknown = sorted(value.keys() - keys)
            return json.dumps(value), f"unknown keys: {', '.join(unknown)}" if unknown else None
    except ValueError:
        pass
    for key in sorted(keys):
        if (found := find_json(text, {key})) is not None:
            return json.dumps(found), "repaired"
    plain = {k: v for k, v in re.findall(r"(?m)^([A-Za-z_]\w*):[ \t]+(\S.*?)\s*$", text) if k in keys}
    if plain:
        return json.dumps({k: _scalar(v, json) for k, v in plain.items()}), "read as lines"
    return None, "no configuration found"


def _scalar(x: str, json) -> object:
    """A number, truth value or null as JSON has them, else the text itself, without quotes around it."""
    try:
        return json.loads(x)
    except ValueError:
        return x.strip("'")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); a temporary one on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-siftmark-')}"
    return f"{base.rstrip('/')}/siftmark-{name}-{uuid.uuid4().hex}"


def export_events(df: DataFrame, path: str) -> None:
    """Events as CSV, newest first (SC9). Unlike what it replaces, the payload is quoted, so commas in it don't break rows."""
    df.orderBy(F.desc("created")).write.option("header", "true").option("quoteAll", "true").option("escape", '"').mode("overwrite").csv(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Metrics as JSON lines, appended (SC10)."""
    df.write.mode("append").json(path)


def write_bundle(parts: dict[str, DataFrame], path: str) -> None:
    """The parts of a run, each in a folder of its name (SC11): one text column as text, anything else as JSON."""
    for name, df in parts.items():
        to = df.write.mode("overwrite")
        to.text(f"{path}/{name}") if df.dtypes == [(df.columns[0], "string")] else to.json(f"{path}/{name}")


def seeded(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """The existing rows, or the seed where there are none (SC17)."""
    return seed if existing.isEmpty() else existing
