"""The log store: filters, keyset pages, byte budgets, retention (FP1 to FP3, WN1, WN7, WN8, TK4, ST2, ST3, SC5, SC14 to SC16)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import feedback, logs, table, units
from ..registry import query
from ..streaming.logs import standing
from .ranking import top_per


@dataclass(frozen=True)
class LogFilter:
    """Optional conditions; those not given don't restrict (FP1)."""

    level: str | None = None
    since: int | None = None
    until: int | None = None
    module_like: list[str] = field(default_factory=list)
    threads: list[int] = field(default_factory=list)
    include_threadless: bool = False
    after_id: int | None = None
    search: str | None = None

    def condition(self) -> Column:
        parts: list[Column] = []
        if self.level:
            parts.append(F.upper("level") == self.level.upper())
        if self.since is not None:
            parts.append(F.col("ts") >= self.since)
        if self.until is not None:
            parts.append(F.col("ts") <= self.until)
        if self.module_like:
            parts.append(reduce(Column.__or__, [F.col("target").contains(x) for x in self.module_like]))
        if self.threads or self.include_threadless:
            of = F.col("thread_id").isin(self.threads)
            parts.append((of | F.col("thread_id").isNull()) if self.include_threadless else of)
        if self.after_id is not None:
            parts.append(F.col("id") > self.after_id)
        if self.search:
            parts.append(F.instr("message", self.search) > 0)
        return reduce(Column.__and__, parts, F.lit(True))


@query("fp1_log_filter", """SELECT id, level, target FROM logs WHERE upper(level) = 'INFO' AND ts >= 1704200000 AND ts <= 1706000000 AND (target LIKE '%click%' OR target LIKE '%sign%')
AND (thread_id IN (3, 5, 8, 11, 13, 20) OR thread_id IS NULL) AND id > 100 AND instr(message, '7') > 0""")
def fp1(spark: SparkSession, d: str) -> DataFrame:
    f = LogFilter("info", 1704200000, 1706000000, ["click", "sign"], [3, 5, 8, 11, 13, 20], True, 100, "7")
    return logs(spark, d).where(f.condition()).select("id", "level", "target")


@query("fp2_thread_filter", "SELECT doc_id, source, lang FROM documents WHERE doc_id % 5 <> 0 AND text <> '' AND source IN ('src1', 'src3', 'src8') AND lang IN ('en', 'de')")
def fp2(spark: SparkSession, d: str) -> DataFrame:
    """Threads that aren't archived, with a first message, from given sources and providers."""
    docs = table(spark, d, "documents")
    return docs.where((F.col("doc_id") % 5 != 0) & (F.col("text") != "") & F.col("source").isin("src1", "src3", "src8") & F.col("lang").isin("en", "de")).select("doc_id", "source", "lang")


def before_anchor(column: str, id: str, value: int, anchor_id: int) -> Column:
    """Rows after an anchor in descending order (FP3)."""
    return (F.col(column) < value) | ((F.col(column) == value) & (F.col(id) < anchor_id))


def keyset_page(df: DataFrame, column: str, id: str, n: int, value: int | None = None, anchor_id: int | None = None) -> DataFrame:
    """The n + 1 newest rows after the anchor: the extra one tells that there is a next page (TK4)."""
    rows = df if value is None else df.where(before_anchor(column, id, value, anchor_id))
    return rows.orderBy(F.desc(column), F.desc(id)).limit(n + 1)


@query("fp3_keyset_rows", "SELECT id FROM logs WHERE ts < 1705000000 OR (ts = 1705000000 AND id < 5000)")
def fp3(spark: SparkSession, d: str) -> DataFrame:
    return logs(spark, d).where(before_anchor("ts", "id", 1705000000, 5000)).select("id")


@query("tk4_keyset_page", "SELECT id, ts FROM logs WHERE ts < 1705000000 OR (ts = 1705000000 AND id < 5000) ORDER BY ts DESC, id DESC LIMIT 26")
def tk4(spark: SparkSession, d: str) -> DataFrame:
    return keyset_page(logs(spark, d).select("id", "ts"), "ts", "id", 25, 1705000000, 5000)


def within_budget(df: DataFrame, by: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """Rows whose running cost in their group, newest first, stays within the budget (WN1). A lone row above it goes too."""
    running = F.sum(cost).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running", running).where(F.col("running") <= budget)


_NEWEST = ["ts", "ts_nanos", "id"]


@query("wn1_log_budget", """SELECT kind, owner, id, running FROM (SELECT *, CAST(sum(bytes) OVER (PARTITION BY kind, owner ORDER BY ts DESC, ts_nanos DESC, id DESC) AS BIGINT) AS running FROM
(SELECT *, CASE WHEN thread_id IS NULL THEN 'process' ELSE 'thread' END AS kind, CASE WHEN thread_id IS NULL THEN process_uuid ELSE CAST(thread_id AS VARCHAR) END AS owner FROM logs)) WHERE running <= 1000""")
def wn1(spark: SparkSession, d: str) -> DataFrame:
    """Logs kept under a byte budget per thread, and per process for rows without one: one window for both."""
    threadless = F.col("thread_id").isNull()
    owned = logs(spark, d).select("id", "ts", "ts_nanos", "bytes", F.when(threadless, "process").otherwise("thread").alias("kind"), F.when(threadless, F.col("process_uuid")).otherwise(F.col("thread_id").cast("string")).alias("owner"))
    return within_budget(owned, ["kind", "owner"], [F.desc(c) for c in _NEWEST], "bytes", 1000).select("kind", "owner", "id", "running")


@query("wn7_soft_trim", """WITH h AS (SELECT user_id, event_id, CAST(strlen(props) + 20 AS BIGINT) AS size FROM events),
c AS (SELECT *, CAST(sum(size) OVER (PARTITION BY user_id) AS BIGINT) AS total, CAST(sum(size) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS suffix, first_value(size) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS newest FROM h)
SELECT user_id, event_id FROM c WHERE total <= 1800 OR suffix <= greatest(1440, newest)""")
def wn7(spark: SparkSession, d: str) -> DataFrame:
    """A history over its cap of 1,800 bytes is cut from the oldest to 80 % of it; its newest entry always stays."""
    h = table(spark, d, "events").select("user_id", "event_id", (F.octet_length("props") + 20).cast("long").alias("size"))
    newest_first = Window.partitionBy("user_id").orderBy(F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    c = h.withColumns({"total": F.sum("size").over(Window.partitionBy("user_id")), "suffix": F.sum("size").over(newest_first), "newest": F.first("size").over(newest_first)})
    return c.where((F.col("total") <= 1800) | (F.col("suffix") <= F.greatest(F.lit(1440), F.col("newest")))).select("user_id", "event_id")


@query("wn8_newest_messages", """WITH m AS (SELECT conv_id, turn, (strlen(text) + 3) // 4 AS tokens, text FROM conversations), c AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m)
SELECT conv_id, turn, CAST(least(tokens, 300 - before) AS BIGINT) AS tokens FROM c WHERE before < 300""")
def wn8(spark: SparkSession, d: str) -> DataFrame:
    """The newest messages of a thread within 300 tokens; the one that crosses the budget is cut."""
    m = table(spark, d, "conversations").select("conv_id", "turn", F.expr("(octet_length(text) + 3) div 4").alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return m.withColumn("before", before).where("before < 300").select("conv_id", "turn", F.least(F.col("tokens"), 300 - F.col("before")).cast("long").alias("tokens"))


@query("st2_retention", "SELECT count(*) AS kept, min(id) AS first_id FROM logs WHERE ts >= 1706745600 - 15 * 86400")
def st2(spark: SparkSession, d: str) -> DataFrame:
    """What is left of the logs after a retention of 15 days."""
    return logs(spark, d).where(F.col("ts") >= 1706745600 - 15 * 86400).agg(F.count("*").alias("kept"), F.min("id").alias("first_id"))


@query("st3_tail", "SELECT id, level, target FROM logs WHERE id > 9900")
def st3(spark: SparkSession, d: str) -> DataFrame:
    """What came after the last id that was seen."""
    return logs(spark, d).where("id > 9900").select("id", "level", "target")


@query("sc5_unit_scan", "SELECT id, path, kind FROM units ORDER BY id DESC")
def sc5(spark: SparkSession, d: str) -> DataFrame:
    """All retrieval units by descending id, which breaks ties of later stable sorts. Spark reads them without paging."""
    return units(spark, d).select("id", "path", "kind").orderBy(F.desc("id"))


@query("sc6_scan_with_vector", "SELECT vec_id, label, len(embedding) AS dims FROM embeddings")
def sc6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.size("embedding").cast("long").alias("dims"))


@query("sc14_session_listing", """WITH s AS (SELECT user_id AS session, max(CAST(epoch_us(ts) AS BIGINT)) AS updated, min(CAST(epoch_us(ts) AS BIGINT)) AS created, count(*) AS n FROM events GROUP BY user_id)
SELECT session, updated, created, n FROM s WHERE updated < 1706600000000000 OR (updated = 1706600000000000 AND session < 100) ORDER BY updated DESC, session DESC LIMIT 21""")
def sc14(spark: SparkSession, d: str) -> DataFrame:
    """A page of sessions by the time of their last change, after a cursor of time and id."""
    f = feedback(spark, d)
    s = f.groupBy(F.col("finding_no").alias("session")).agg(F.max("at_us").alias("updated"), F.min("at_us").alias("created"), F.count("*").alias("n"))
    return keyset_page(s, "updated", "session", 20, 1706600000000000, 100)


@query("sc15_latest_name", "SELECT user_id, arg_max(event_type, event_id) AS name, max(event_id) AS position FROM events GROUP BY user_id")
def sc15(spark: SparkSession, d: str) -> DataFrame:
    """An append-only index of names: the last entry of an id holds."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("name"), F.max("event_id").alias("position"))


@query("sc16_log_cost", "SELECT id, bytes FROM logs")
def sc16(spark: SparkSession, d: str) -> DataFrame:
    """Logs with their estimated size in bytes, as they are inserted."""
    return logs(spark, d).select("id", "bytes")


@query("st6_thread_metadata", """SELECT user_id, arg_max(event_type, event_id) AS last_type, arg_min(event_type, event_id) AS first_type, arg_max(value, event_id) FILTER (WHERE event_type = 'purchase') AS last_purchase, arg_min(props, event_id) FILTER (WHERE event_type = 'signup') AS first_signup, count(*) AS events FROM events GROUP BY user_id""")
def st6(spark: SparkSession, d: str) -> DataFrame:
    """Events folded into a thread's metadata: fields by last, first, or first non-empty value."""
    kind, at = F.col("event_type"), F.col("event_id")
    return table(spark, d, "events").groupBy("user_id").agg(
        F.max_by("event_type", at).alias("last_type"),
        F.min_by("event_type", at).alias("first_type"),
        F.max_by("value", F.when(kind == "purchase", at)).alias("last_purchase"),
        F.min_by("props", F.when(kind == "signup", at)).alias("first_signup"),
        F.count("*").alias("events"),
    )


@query("st7_rollback", """WITH e AS (SELECT user_id, list({'id': event_id, 'back': event_type = 'error'} ORDER BY event_id) AS l FROM events WHERE event_type IN ('error', 'purchase', 'signup') GROUP BY user_id)
SELECT user_id, len(s) AS turns, s[-1] AS last_turn FROM (SELECT user_id, list_reduce(list_prepend(CAST([] AS BIGINT[]), list_transform(l, lambda x: CASE WHEN x.back THEN [NULL] ELSE [x.id] END)), lambda a, x: CASE WHEN x[1] IS NULL THEN a[1:-2] ELSE list_concat(a, x) END) AS s FROM e)""")
def st7(spark: SparkSession, d: str) -> DataFrame:
    """How many user turns stand, and the last of them, where a rollback takes the last one away."""
    e = table(spark, d, "events").where(F.col("event_type").isin("error", "purchase", "signup")).withColumn("step", F.when(F.col("event_type") == "error", -1).otherwise(1))
    left = standing(e).groupBy("user_id").agg(F.count("*").alias("turns"), F.max_by("first_id", "level").alias("last_turn"))
    return e.select("user_id").distinct().join(left, "user_id", "left").select("user_id", F.coalesce("turns", F.lit(0)).cast("long").alias("turns"), "last_turn")


@query("st9_lifecycle_pairs", """WITH b AS (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS next_type FROM events WHERE event_type IN ('click', 'purchase'))
SELECT user_id, event_id AS begin_id, CASE WHEN next_type = 'purchase' THEN next_id END AS end_id FROM b WHERE event_type = 'click'""")
def st9(spark: SparkSession, d: str) -> DataFrame:
    """Begin events with the end that follows at once; null while still open."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    b = table(spark, d, "events").where(F.col("event_type").isin("click", "purchase")).withColumns({"next_id": F.lead("event_id").over(w), "next_type": F.lead("event_type").over(w)})
    return b.where("event_type = 'click'").select("user_id", F.col("event_id").alias("begin_id"), F.when(F.col("next_type") == "purchase", F.col("next_id")).alias("end_id"))


@query("st10_head_tail", """WITH c AS (SELECT user_id, event_id, sum(strlen(props)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS head, sum(strlen(props)) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS tail FROM events)
SELECT user_id, event_id, CASE WHEN head <= 100 THEN 'head' ELSE 'tail' END AS side FROM c WHERE head <= 100 OR tail <= 100""")
def st10(spark: SparkSession, d: str) -> DataFrame:
    """A buffer that keeps its first and its last 100 bytes, in whole rows."""
    up = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("user_id").orderBy(F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    size = F.octet_length("props")
    c = table(spark, d, "events").select("user_id", "event_id", F.sum(size).over(up).alias("head"), F.sum(size).over(down).alias("tail"))
    return c.where("head <= 100 or tail <= 100").select("user_id", "event_id", F.when(F.col("head") <= 100, "head").otherwise("tail").alias("side"))


_JOBS_SQL = """SELECT o_orderkey AS job, o_orderkey % 50 AS watermark, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 60 END AS done, o_orderstatus AS status, o_custkey % 100 AS lease_until, o_custkey % 4 AS retries, o_custkey % 70 AS retry_at FROM orders"""


@query("st4_job_claims", f"""WITH j AS ({_JOBS_SQL})
SELECT job, CASE WHEN done >= watermark THEN 'up_to_date' WHEN status = 'O' AND lease_until > 50 THEN 'running' WHEN retries = 0 AND coalesce(done, 0) >= watermark THEN 'exhausted' WHEN retry_at > 50 AND NOT watermark > coalesce(done, -1) THEN 'backoff' ELSE 'claim' END AS decision FROM j""")
def st4(spark: SparkSession, d: str) -> DataFrame:
    """What to do with each job: skip it if it is up to date, leased, out of retries or waiting, else claim it.

    The decision is an expression; claiming one job at a time needs a transactional store, which Spark isn't.
    """
    key = F.col("o_orderkey")
    j = table(spark, d, "orders").select(key.alias("job"), (key % 50).alias("watermark"), F.when(key % 4 != 0, key % 60).alias("done"), F.col("o_orderstatus").alias("status"), F.expr("o_custkey % 100 as lease_until"), F.expr("o_custkey % 4 as retries"), F.expr("o_custkey % 70 as retry_at"))
    done, mark = F.col("done"), F.col("watermark")
    decision = F.when(done >= mark, "up_to_date").when((F.col("status") == "O") & (F.col("lease_until") > 50), "running")
    decision = decision.when((F.col("retries") == 0) & (F.coalesce(done, F.lit(0)) >= mark), "exhausted").when((F.col("retry_at") > 50) & ~(mark > F.coalesce(done, F.lit(-1))), "backoff").otherwise("claim")
    return j.select("job", decision.alias("decision"))


@query("st5_watermarks", f"""WITH j AS ({_JOBS_SQL}) SELECT status, CAST(max(greatest(coalesce(done, -1), CASE WHEN status = 'F' THEN watermark ELSE -1 END)) AS BIGINT) AS watermark, count(*) FILTER (WHERE status = 'P') AS failed FROM j GROUP BY status""")
def st5(spark: SparkSession, d: str) -> DataFrame:
    """Progress after all transitions: a watermark only moves up, by successes."""
    key = F.col("o_orderkey")
    status = F.col("o_orderstatus")
    done = F.coalesce(F.when(key % 4 != 0, key % 60), F.lit(-1))
    return table(spark, d, "orders").groupBy(status.alias("status")).agg(F.max(F.greatest(done, F.when(status == "F", key % 50).otherwise(-1))).alias("watermark"), F.count_if(status == "P").cast("long").alias("failed"))


@query("wn9_latest_per_key", "SELECT o_custkey, max(o_orderkey) AS latest, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey")
def wn9(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each key; max_by combines before the shuffle, a window would not."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("latest"), F.max_by("o_orderstatus", "o_orderkey").alias("status"))


@query("tk10_recent", "SELECT repo_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY run_id DESC) AS r FROM runs) WHERE r <= 20")
def tk10(spark: SparkSession, d: str) -> DataFrame:
    from ..catalog import runs

    return top_per(runs(spark, d).select("repo_id", "run_id"), ["repo_id"], [F.desc("run_id")], 20).select("repo_id", "run_id")
