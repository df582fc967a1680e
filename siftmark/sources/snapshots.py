"""Tables whose rows are replaced by key, in snapshots that readers see whole or not at all (CP15, ST12).

A table is a folder of Parquet: `data/v=N/bucket=B` holds a bucket of keys as version N left it, `manifest/v=N` says which version of each bucket counts.
A change writes the buckets that it touches under a new version, and then its manifest; the manifest's own end mark commits it. A
writer that fails before that leaves nothing that is read, and one that runs again overwrites what it left. There is one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Snapshots:
    """`schema` is the rows', `key` their key column; a key's rows are in one of `buckets` buckets."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root.rstrip("/"), schema, key, buckets

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _there(self, name: str) -> bool:
        fs, path = self._path(name)
        return fs.exists(path)

    def version(self) -> int:
        """The last committed version; 0 for a new table."""
        fs, path = self._path("manifest")
        found = [str(x.getPath().getName()) for x in fs.listStatus(path)] if fs.exists(path) else []
        return max((int(x[2:]) for x in found if x.startswith("v=") and self._there(f"manifest/{x}/_SUCCESS")), default=0)

    def _manifest(self) -> tuple[dict[int, int], dict[str, int]]:
        """Versions of the buckets that hold rows, and the last batch of each writer: a row per bucket and writer."""
        if not (now := self.version()):
            return {}, {}
        rows = self.spark.read.schema("bucket int, version long, writer string").json(f"{self.root}/manifest/v={now}").collect()
        return {r["bucket"]: r["version"] for r in rows if r["bucket"] is not None}, {r["writer"]: r["version"] for r in rows if r["writer"] is not None}

    def _read(self, parts: dict[int, int]) -> DataFrame:
        paths = [f"{self.root}/data/v={v}/bucket={b}" for b, v in sorted(parts.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The table as the last committed version has it; later versions don't change what this reads."""
        return self._read(self._manifest()[0])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def replace(self, keys: DataFrame, rows: DataFrame, writer: str | None = None, batch: int = 0, newest: str | None = None) -> bool:
        """Rows of `keys` (a column named as the key) become those of `rows`; whether that made a new version.

        Keys without rows are deleted, rows of other keys ignored. A `writer`'s batch that was committed before changes nothing, and neither do no keys.
        With `newest`, a key keeps the rows, old and new, with the largest value of that column instead.
        """
        parts, done = self._manifest()
        if writer is not None and done.get(writer, -1) >= batch:
            return False
        keys = keys.select(self.key).distinct()
        # as many rows as buckets at most
        touched = sorted(r[0] for r in keys.select(self._bucket()).distinct().collect())
        if not touched and writer is None:
            return False
        version, columns = self.version() + 1, self.spark.createDataFrame([], self.schema).columns
        old = self._read({b: parts[b] for b in touched if b in parts})
        new = rows.select(columns).join(keys, self.key, "left_semi")
        if newest is None:
            new = old.join(keys, self.key, "left_anti").unionByName(new)
        else:
            own = old.join(keys, self.key, "left_semi").unionByName(new)
            best = own.groupBy(self.key).agg(F.max(newest).alias("_newest"))
            new = old.join(keys, self.key, "left_anti").unionByName(own.join(best, self.key).where(F.col(newest).eqNullSafe(F.col("_newest"))).select(columns))
        # a hot key's bucket is split over files
        new.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/v={version}")
        parts = {b: v for b, v in parts.items() if b not in touched} | {b: version for b in touched if self._there(f"data/v={version}/bucket={b}")}
        if writer is not None:
            done[writer] = batch
        entries = [(b, v, None) for b, v in parts.items()] + [(None, n, w) for w, n in done.items()] or [(None, None, None)]
        self.spark.createDataFrame(entries, "bucket int, version long, writer string").coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest/v={version}")
        return True


INDEX = "path string, kind string, n int, text string"


def index_rows(files: DataFrame) -> DataFrame:
    """Rows of an index (INDEX) of files (path, text): one of kind `file` with the text's hash, and one for each line, its child."""
    own = files.select("path", F.lit("file").alias("kind"), F.lit(0).alias("n"), F.sha1("text").alias("text"))
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return own.unionByName(lines.select("path", F.lit("line").alias("kind"), (F.col("at") + 1).alias("n"), "text"))


def apply_index(index: Snapshots, files: DataFrame) -> bool:
    """Bring an index up to `files` (path, text): files with an unchanged hash are skipped, the children of others replaced, files that are gone or have a null text pruned (CP15).

    Readers see the index before or after all of it. A run that failed can be repeated; one that has been applied changes nothing.
    """
    known = index.read().where("kind = 'file'").select("path", F.col("text").alias("before"))
    both = files.select("path", F.sha1("text").alias("now")).join(known, "path", "full")
    changed = both.where(~F.col("now").eqNullSafe(F.col("before"))).select("path")
    return index.replace(changed, index_rows(files.join(changed, "path", "left_semi")))

