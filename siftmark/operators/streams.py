"""Registered queries of file sources, sinks, streams and stateful folds (SC1, SC7, SC9 to SC11, SC17, ST1, ST6, ST8, ST9, ST11, ST12, CP15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import table
from ..registry import query
from ..sources.files import append_metrics, export_events, parse_configs, seeded, shared_folder, walk, write_bundle
from ..sources.snapshots import INDEX, Snapshots, apply_index
from ..streaming.folds import METADATA, PROVIDER, keyed_stream, metadata_stream, paired_streams
from ..streaming.logs import event_stream, log_sink, turns


@query("sc1_walk")
def sc1(spark: SparkSession, d: str) -> DataFrame:
    """The data folder's files by kind."""
    files = walk(spark, d).select(F.regexp_extract("path", r"([A-Za-z]+)\.parquet", 1).alias("name"), "length")
    return files.groupBy("name").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


@query("st8_turns", """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
x AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(items BIGINT, first_id BIGINT, last_id BIGINT)[]) AS t FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT x.user_id, e.n, CASE WHEN event_type = 'signup' THEN list_append(t, {'items': CAST(1 AS BIGINT), 'first_id': event_id, 'last_id': event_id}) WHEN event_type = 'error' THEN t[:-2] WHEN len(t) = 0 THEN t
  ELSE list_append(t[:-2], {'items': t[-1].items + 1, 'first_id': t[-1].first_id, 'last_id': event_id}) END FROM x JOIN e ON e.user_id = x.user_id AND e.n = x.n + 1),
z AS (SELECT user_id, arg_max(t, n) AS t FROM x GROUP BY user_id)
SELECT user_id, turn, s.items AS items, s.first_id AS first_id, s.last_id AS last_id FROM (SELECT user_id, unnest(range(len(t))) AS turn, unnest(t) AS s FROM z)""")
def st8(spark: SparkSession, d: str) -> DataFrame:
    """Turns of every user; the SQL replays events one by one instead."""
    return turns(table(spark, d, "events").select("user_id", "event_id", "event_type"))


@query("sc7_configs", "SELECT CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS BIGINT) WHEN 1 THEN p_partkey END AS cap, CASE p_partkey % 3 WHEN 0 THEN 'unknown keys: x' WHEN 1 THEN 'repaired' ELSE 'no configuration found' END AS warning, count(*) AS n FROM part GROUP BY ALL")
def sc7(spark: SparkSession, d: str) -> DataFrame:
    """Configurations as texts of a table: whole, with noise around them, or none at all."""
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit('{"x": 1, "cap": '), "p_size", F.lit("}"))).when(k % 3 == 1, F.concat(F.lit('see {"cap": '), k, F.lit("} or ask"))).otherwise(F.col("p_name"))
    found = parse_configs(table(spark, d, "part").select(k.alias("file"), text.alias("text")), "cap long")
    return found.groupBy("cap", "warning").agg(F.count("*").alias("n"))


@query("sc9_event_export", "SELECT event_id AS created, event_type, props AS payload FROM events")
def sc9(spark: SparkSession, d: str) -> DataFrame:
    """Events exported as CSV and read back."""
    path = shared_folder(spark, "export")
    export_events(table(spark, d, "events").select(F.col("event_id").alias("created"), "event_type", F.col("props").alias("payload")), path)
    return spark.read.option("header", "true").option("escape", '"').schema("created long, event_type string, payload string").csv(path)


@query("sc10_metric_lines", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY 1")
def sc10(spark: SparkSession, d: str) -> DataFrame:
    """Metrics appended twice as JSON lines, and read back."""
    path = shared_folder(spark, "metrics")
    for _ in range(2):
        append_metrics(table(spark, d, "events").select("event_id", "event_type"), path)
    return spark.read.schema("event_id long, event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("sc11_run_bundle", "SELECT 'names' AS part, CAST(count(*) AS BIGINT) AS rows FROM part UNION ALL SELECT 'regions', count(*) FROM region")
def sc11(spark: SparkSession, d: str) -> DataFrame:
    """The parts of a run's bundle, read back."""
    path = shared_folder(spark, "bundle")
    write_bundle({"names": table(spark, d, "part").select("p_name"), "regions": table(spark, d, "region")}, path)
    count = lambda df, name: df.select(F.lit(name).alias("part")).groupBy("part").agg(F.count("*").alias("rows"))
    return count(spark.read.text(f"{path}/names"), "names").unionByName(count(spark.read.schema("r_regionkey long").json(f"{path}/regions"), "regions"))


@query("sc17_seeded", "SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def sc17(spark: SparkSession, d: str) -> DataFrame:
    """An index that is empty gets its seed; one that isn't stays as it is."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    regions = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    return seeded(nations.where("false"), nations).unionByName(seeded(regions, nations))


@query("st1_log_sink", "SELECT event_type, count(*) AS n, CAST(sum(strlen(props) + strlen(event_type) + 8) AS BIGINT) AS bytes FROM events GROUP BY 1")
def st1(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of files through the log sink, until all of them are written."""
    path = shared_folder(spark, "sink")
    log_sink(event_stream(spark, f"{d}/events*.parquet"), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    out = spark.read.schema("event_type string, bytes long").parquet(f"{path}/out")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("st11_job_dedupe", "SELECT 'review-' || (o_custkey % 500) || '-' || o_orderstatus AS job_id, min(o_orderkey) AS first FROM orders GROUP BY 1")
def st11(spark: SparkSession, d: str) -> DataFrame:
    """Jobs once per id, however often they are asked for: the first asked for stays (its queue and retries are out of scope)."""
    job = F.concat_ws("-", F.lit("review"), F.col("o_custkey") % 500, "o_orderstatus")
    return table(spark, d, "orders").groupBy(job.alias("job_id")).agg(F.min("o_orderkey").alias("first"))


@query("cp15_applied_index", """WITH n AS (SELECT CAST(doc_id AS VARCHAR) AS path, text FROM documents WHERE doc_id % 10 <> 3)
SELECT path, 'file' AS kind, 0 AS n, sha1(text) AS text FROM n UNION ALL SELECT path, 'line', CAST(generate_subscripts(l, 1) AS INTEGER), unnest(l) FROM (SELECT path, string_split(text, chr(10)) AS l FROM n)""")
def cp15_applied(spark: SparkSession, d: str) -> DataFrame:
    """An index of an earlier state of the files, brought up to the present one; the SQL builds it anew."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", "text")
    index = Snapshots(spark, shared_folder(spark, "index"), INDEX, "path", 16)
    apply_index(index, docs.where("doc_id % 6 != 5").withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("old\n"), "text")).otherwise(F.col("text"))))
    apply_index(index, docs.where("doc_id % 10 != 3"))
    return index.read()


def event_parts(spark: SparkSession, d: str, path: str, parts: list[int], of: int = 3) -> None:
    """Append some of `of` runs of the events, each cut off by id, to the files of a stream's folder, with the number of their run (analysis)."""
    events = table(spark, d, "events")
    ids = events.agg((F.max("event_id") + 1).alias("top"))  # one row
    cut = events.join(F.broadcast(ids)).withColumn("analysis", F.floor(F.col("event_id") * of / F.col("top"))).drop("top")
    for i in parts:
        cut.where(F.col("analysis") == i).write.mode("append").parquet(path)


_EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string, analysis long"


@query("st12_replace_stream", """WITH a AS (SELECT (user_id % 10) || ':' || event_type AS key, CAST(floor(event_id * 3 / (max(event_id) OVER () + 1)) AS BIGINT) AS analysis FROM events)
SELECT key, analysis, count(*) AS n FROM a WHERE analysis = (SELECT max(analysis) FROM a b WHERE b.key = a.key) GROUP BY key, analysis""")
def st12_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events of runs that are analysed again and again, as a stream: a later analysis replaces the rows of the same run and kind."""
    root = shared_folder(spark, "replaced")
    kept = Snapshots(spark, f"{root}/table", "key string, analysis long, event_id long", "key", 8)
    event_parts(spark, d, f"{root}/in", [0, 1, 2])
    rows = spark.readStream.schema(_EVENTS).option("maxFilesPerTrigger", 16).parquet(f"{root}/in")
    keyed = rows.select(F.concat_ws(":", (F.col("user_id") % 10).cast("string"), "event_type").alias("key"), "analysis", "event_id")
    keyed_stream(keyed, kept, f"{root}/checkpoint", "analyses", newest="analysis").awaitTermination()
    return kept.read().groupBy("key", "analysis").agg(F.count("*").alias("n"))


@query("st6_metadata_stream", """SELECT user_id, arg_max(event_type, event_id) AS last_type, arg_min(event_type, event_id) AS first_type, arg_max(value, event_id) FILTER (WHERE event_type = 'purchase') AS last_purchase, arg_min(props, event_id) FILTER (WHERE event_type = 'signup') AS first_signup, count(*) AS events FROM events GROUP BY user_id""")
def st6_stream(spark: SparkSession, d: str) -> DataFrame:
    """The fold of st6_thread_metadata over a stream that is stopped and started again."""
    root, before = shared_folder(spark, "metadata"), spark.conf.get(PROVIDER[0], None)
    kept = Snapshots(spark, f"{root}/table", METADATA, "user_id", 8)
    spark.conf.set(*PROVIDER)
    try:
        for parts in ([0, 1], [2]):
            event_parts(spark, d, f"{root}/in", parts)
            rows = spark.readStream.schema(_EVENTS).option("maxFilesPerTrigger", 16).parquet(f"{root}/in")
            metadata_stream(rows.drop("ts", "analysis"), kept, f"{root}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(PROVIDER[0], before) if before else spark.conf.unset(PROVIDER[0])
    return kept.read()


@query("st9_stream_pairs", """SELECT a.user_id AS call, a.event_id AS begin_id, b.event_id AS end_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 DAY""")
def st9_stream(spark: SparkSession, d: str) -> DataFrame:
    """Begins joined to the ends of the same call within a day, as two streams; each is kept as long as the other's watermark needs it."""
    root = shared_folder(spark, "pairs")
    event_parts(spark, d, f"{root}/in", [0, 1, 2])
    rows = spark.readStream.schema(_EVENTS).option("maxFilesPerTrigger", 16).parquet(f"{root}/in")
    side = lambda kind, name: rows.where(F.col("event_type") == kind).select(F.col("user_id").alias("call"), F.col("event_id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_ts"))
    pairs = paired_streams(side("click", "begin"), side("purchase", "end"), "1 day")
    pairs.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("call long, begin_id long, end_id long").parquet(f"{root}/out")
