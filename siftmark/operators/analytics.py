"""Dashboard analytics and feedback learning (AG1 to AG30).

Every query is a group-by with partial aggregation before its shuffle, or a window over the
small result of one. `now` is an argument wherever a cut-off in days is meant, so
that results don't depend on the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import feedback, findings, logs, runs, table
from ..functions.text import is_protected, rounded, weight
from ..registry import query
from .ranking import top_per

DAY_US = 86_400_000_000
#: The moment that stands for now over the generated events: 2024-02-01T00:00:00Z.
NOW_US = 1_706_745_600_000_000

# Reactions that count as agreement or disagreement.
POSITIVE = ["thumbs_up", "+1", "heart", "laugh", "hooray"]
NEGATIVE = ["thumbs_down", "-1", "confused"]


def count_where(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def sentiment_counts() -> list[Column]:
    """Agreeing and disagreeing feedback: reactions by kind, and replies that resolve (AG6)."""
    reaction = F.col("type") == "reaction"
    pos = (reaction & F.col("sentiment").isin(POSITIVE)) | ((F.col("type") == "reply") & (F.col("action") == "resolved"))
    return [count_where(F.coalesce(pos, F.lit(False))).alias("pos"), count_where(F.coalesce(reaction & F.col("sentiment").isin(NEGATIVE), F.lit(False))).alias("neg")]


SENTIMENT_SQL = """CAST(count(*) FILTER (WHERE (type = 'reaction' AND sentiment IN ('thumbs_up','+1','heart','laugh','hooray')) OR (type = 'reply' AND action = 'resolved')) AS BIGINT) AS pos,
  CAST(count(*) FILTER (WHERE type = 'reaction' AND sentiment IN ('thumbs_down','-1','confused')) AS BIGINT) AS neg"""


@query("ag1_severity_status", "SELECT severity, status, count(*) AS n FROM findings GROUP BY ALL")
def ag1(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).groupBy("severity", "status").agg(F.count("*").alias("n"))


@query("ag2_languages", "SELECT source, lang, n, size, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS INTEGER) AS rank FROM (SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS size FROM documents WHERE lang IS NOT NULL GROUP BY ALL)) WHERE rank <= 8")
def ag2(spark: SparkSession, d: str) -> DataFrame:
    """The eight most frequent languages of each repository, with their sizes."""
    counts = table(spark, d, "documents").where("lang is not null").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("size"))
    return top_per(counts, ["source"], [F.desc("n"), F.asc("lang")], 8).select("source", "lang", "n", "size", "rank")


@query("ag3_distinct_authors", "SELECT repo_id, count(DISTINCT pr_id) AS authors FROM runs GROUP BY ALL")
def ag3(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).groupBy("repo_id").agg(F.countDistinct("pr_id").alias("authors"))


@query("ag4_run_summary", """WITH f AS (SELECT count(*) FILTER (WHERE sentiment = 'thumbs_up' OR action = 'resolved') AS p, count(*) FILTER (WHERE sentiment = 'thumbs_down') AS n FROM feedback)
SELECT (SELECT count(*) FROM runs) AS run_count, (SELECT CAST(floor(coalesce(avg(latency_ms), 0) + 0.5) AS BIGINT) FROM runs WHERE status = 'completed') AS avg_latency_ms,
CASE WHEN p + n > 0 THEN CAST(floor(p / (p + n) * 100 + 0.5) AS BIGINT) END AS acceptance_rate FROM f""")
def ag4(spark: SparkSession, d: str) -> DataFrame:
    """Runs, mean latency of completed ones, and acceptance in per cent (null without votes)."""
    r = runs(spark, d).agg(F.count("*").alias("run_count"), F.floor(F.coalesce(F.avg(F.when(F.col("status") == "completed", F.col("latency_ms"))), F.lit(0)) + 0.5).cast("long").alias("avg_latency_ms"))
    f = feedback(spark, d).agg(
        count_where((F.col("sentiment") == "thumbs_up") | (F.col("action") == "resolved")).alias("p"), count_where(F.col("sentiment") == "thumbs_down").alias("n")
    )
    votes = F.col("p") + F.col("n")
    # one row on either side
    return r.join(F.broadcast(f), F.lit(True)).select("run_count", "avg_latency_ms", F.when(votes > 0, F.floor(F.col("p") / votes * 100 + 0.5).cast("long")).alias("acceptance_rate"))


@query("ag5_run_counts", """SELECT run_id, count(*) AS total, count(*) FILTER (WHERE severity = 'blocking') AS blocking, count(*) FILTER (WHERE severity = 'important') AS important, count(*) FILTER (WHERE severity = 'nit') AS nit,
count(*) FILTER (WHERE category = 'security') AS security, count(*) FILTER (WHERE category = 'bug') AS bug, count(DISTINCT category) AS categories FROM findings GROUP BY run_id""")
def ag5(spark: SparkSession, d: str) -> DataFrame:
    """Findings of each run: total, by severity, and by category."""
    of = lambda column, value: count_where(F.col(column) == value).alias(value)
    return findings(spark, d).groupBy("run_id").agg(
        F.count("*").alias("total"), *(of("severity", x) for x in ("blocking", "important", "nit")), of("category", "security"), of("category", "bug"), F.size(F.collect_set("category")).cast("long").alias("categories")
    )


@query("ag6_sentiment", f"SELECT finding_no, {SENTIMENT_SQL} FROM feedback GROUP BY finding_no")
def ag6(spark: SparkSession, d: str) -> DataFrame:
    return feedback(spark, d).groupBy("finding_no").agg(*sentiment_counts())


@query("ag7_rule_suggestions", f"""WITH f AS (SELECT finding_no, {SENTIMENT_SQL} FROM feedback GROUP BY finding_no),
b AS (SELECT repo_id, category, title, count(*) AS n FROM findings, f WHERE findings.rule_id IS NULL AND f.finding_no = findings.run_id % 200 AND pos > neg GROUP BY ALL HAVING count(*) >= 2),
t AS (SELECT *, 'High positive feedback (' || n || ') for repeated finding: ' || title AS reason, 'suggested-' || lower(regexp_replace(category || ':' || title, '[^A-Za-z0-9]+', '-', 'g')) AS rule FROM b)
SELECT repo_id, category, title, n, reason, rule FROM t WHERE reason NOT IN (SELECT 'High positive feedback (' || o_orderkey || ') for repeated finding: Check  Value #1 in loop' FROM orders WHERE o_orderkey < 10)""")
def ag7(spark: SparkSession, d: str) -> DataFrame:
    """Suggested rules: findings without a rule that repeat in a repository and are liked, unless already suggested."""
    liked = feedback(spark, d).groupBy("finding_no").agg(*sentiment_counts()).where("pos > neg")
    bare = findings(spark, d).where("rule_id is null").withColumn("finding_no", F.col("run_id") % 200)
    buckets = bare.join(liked, "finding_no").groupBy("repo_id", "category", "title").agg(F.count("*").alias("n")).where("n >= 2")
    named = buckets.withColumn("reason", F.expr("concat('High positive feedback (', n, ') for repeated finding: ', title)"))
    known = table(spark, d, "orders").where("o_orderkey < 10").select(F.expr("concat('High positive feedback (', o_orderkey, ') for repeated finding: Check  Value #1 in loop')").alias("reason"))
    slug = F.lower(F.regexp_replace(F.concat_ws(":", "category", "title"), "[^A-Za-z0-9]+", "-"))
    return named.join(known, "reason", "left_anti").select("repo_id", "category", "title", "n", "reason", F.concat(F.lit("suggested-"), slug).alias("rule"))


def feedback_policy(votes: DataFrame, mapping: DataFrame, now_us: int, days: int = 30, newest: int = 500) -> DataFrame:
    """Categories that recent feedback speaks against or for (AG8): category, pos, neg, negative, positive.

    `mapping` has finding_no and category. Only the newest votes within `days` count.
    """
    recent = votes.where(F.col("at_us") >= now_us - days * DAY_US).orderBy(F.desc("at_us"), F.desc("feedback_id")).limit(newest)
    counts = recent.join(mapping, "finding_no").groupBy("category").agg(*sentiment_counts())
    flags = {"negative": (F.col("neg") >= 3) & (F.col("neg") >= F.col("pos") * 1.5), "positive": (F.col("pos") >= 3) & (F.col("pos") >= F.col("neg") * 1.5)}
    return counts.withColumns(flags)


_MAPPING_SQL = "SELECT s_suppkey AS finding_no, CASE s_suppkey % 6 WHEN 0 THEN 'security' WHEN 1 THEN 'bug' WHEN 2 THEN 'performance' WHEN 3 THEN 'testing' WHEN 4 THEN 'maintainability' ELSE 'style' END AS category, CASE WHEN s_suppkey % 4 = 0 THEN 'r' || s_suppkey % 3 END AS rule_id FROM supplier"


def _mapping(spark: SparkSession, d: str) -> DataFrame:
    from ..catalog import CATEGORIES

    names = F.array(*map(F.lit, CATEGORIES))
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("finding_no"), F.element_at(names, (F.col("s_suppkey") % 6 + 1).cast("int")).alias("category"), F.expr("if(s_suppkey % 4 = 0, concat('r', s_suppkey % 3), null)").alias("rule_id")
    )


@query("ag8_feedback_policy", f"""WITH m AS ({_MAPPING_SQL}), r AS (SELECT * FROM feedback WHERE at_us >= {NOW_US - 30 * DAY_US} ORDER BY at_us DESC, feedback_id DESC LIMIT 500),
c AS (SELECT category, {SENTIMENT_SQL} FROM r JOIN m USING (finding_no) GROUP BY category)
SELECT *, neg >= 3 AND neg >= pos * 1.5 AS negative, pos >= 3 AND pos >= neg * 1.5 AS positive FROM c""")
def ag8(spark: SparkSession, d: str) -> DataFrame:
    return feedback_policy(feedback(spark, d), _mapping(spark, d).select("finding_no", "category"), NOW_US)


def weight_keys(df: DataFrame) -> DataFrame:
    """A row for a finding's category and, where it has a rule, one for category:rule."""
    keys = F.filter(F.array(F.col("category"), F.concat_ws(":", "category", "rule_id")), lambda k: k.isNotNull())
    return df.withColumn("key", F.explode(F.when(F.col("rule_id").isNotNull(), keys).otherwise(F.array("category"))))


def guarded_weight(addressed: str, ignored: str, positive: str, negative: str) -> Column:
    w = weight(F.col(addressed), F.col(ignored), F.col(positive), F.col(negative))
    return F.when(is_protected(F.col("key")), F.greatest(w, F.lit(0.0))).otherwise(w)


_WEIGHT_SQL = """greatest(CASE WHEN lower(key) IN ('security','injection','authz','xss','sql injection') OR regexp_matches(lower(key), '^(security|injection|authz|xss|sql injection):') THEN 0.0 ELSE -1.0 END, least(1.0,
CASE WHEN addressed + ignored > 0 AND positive + negative > 0 THEN (addressed - ignored) / (addressed + ignored + 1) * 0.6 + (positive - negative) / (positive + negative + 1) * 0.4
WHEN addressed + ignored > 0 THEN (addressed - ignored) / (addressed + ignored + 1) ELSE (positive - negative) / (positive + negative + 1) END))"""
_PRIOR_SQL = "SELECT n_nationkey % 20 AS repo_id, CASE n_nationkey % 3 WHEN 0 THEN 'security' WHEN 1 THEN 'bug' ELSE 'style:r1' END AS key, n_nationkey AS addressed, 25 - n_nationkey AS ignored, n_nationkey % 4 AS positive, n_nationkey % 5 AS negative FROM nation WHERE n_nationkey < 20"


def _prior(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    key = F.when(n % 3 == 0, "security").when(n % 3 == 1, "bug").otherwise("style:r1")
    return table(spark, d, "nation").where(n < 20).select((n % 20).alias("repo_id"), key.alias("key"), n.alias("addressed"), (25 - n).alias("ignored"), (n % 4).alias("positive"), (n % 5).alias("negative"))


def accumulate_outcomes(outcomes: DataFrame, prior: DataFrame) -> DataFrame:
    """Outcome counters added to the prior state, and the weights that follow (AG9, AG11). Keys without new outcomes stay out."""
    new = weight_keys(outcomes).groupBy("repo_id", "key").agg(count_where(F.col("addressed")).alias("new_a"), count_where(~F.col("addressed")).alias("new_i"))
    joined = new.join(prior, ["repo_id", "key"], "left").fillna(0, ["addressed", "ignored", "positive", "negative"])
    summed = joined.withColumns({"addressed": F.col("addressed") + F.col("new_a"), "ignored": F.col("ignored") + F.col("new_i")})
    return summed.select("repo_id", "key", "addressed", "ignored", "positive", "negative", rounded(guarded_weight("addressed", "ignored", "positive", "negative")).alias("weight"))


_KEYS_SQL = "SELECT *, unnest(CASE WHEN rule_id IS NULL THEN [category] ELSE [category, category || ':' || rule_id] END) AS key FROM"


@query("ag9_accumulate_outcomes", f"""WITH k AS ({_KEYS_SQL} findings), n AS (SELECT repo_id, key, count(*) FILTER (WHERE status = 'fixed') AS a, count(*) FILTER (WHERE status <> 'fixed') AS i FROM k GROUP BY ALL), p AS ({_PRIOR_SQL}),
s AS (SELECT n.repo_id, n.key, CAST(coalesce(addressed, 0) + a AS BIGINT) AS addressed, CAST(coalesce(ignored, 0) + i AS BIGINT) AS ignored, CAST(coalesce(positive, 0) AS BIGINT) AS positive, CAST(coalesce(negative, 0) AS BIGINT) AS negative FROM n LEFT JOIN p ON n.repo_id = p.repo_id AND n.key = p.key)
SELECT *, round({_WEIGHT_SQL}, 6) AS weight FROM s""")
def ag9(spark: SparkSession, d: str) -> DataFrame:
    return accumulate_outcomes(findings(spark, d).withColumn("addressed", F.col("status") == "fixed"), _prior(spark, d))


def replace_reactions(votes: DataFrame, mapping: DataFrame, prior: DataFrame, now_us: int, days: int = 90, newest: int = 2000) -> DataFrame:
    """Reaction counters that replace the prior ones, and the weights that follow (AG10, AG11)."""
    recent = votes.where(F.col("at_us") >= now_us - days * DAY_US).orderBy(F.desc("at_us"), F.desc("feedback_id")).limit(newest)
    counts = weight_keys(recent.join(mapping, "finding_no")).groupBy("key").agg(*sentiment_counts())
    joined = counts.join(prior.select("key", "addressed", "ignored"), "key", "left").fillna(0, ["addressed", "ignored"])
    return joined.select("key", "addressed", "ignored", F.col("pos").alias("positive"), F.col("neg").alias("negative"), rounded(guarded_weight("addressed", "ignored", "pos", "neg")).alias("weight"))


@query("ag10_replace_reactions", f"""WITH m AS ({_MAPPING_SQL}), r AS (SELECT * FROM feedback WHERE at_us >= {NOW_US - 90 * DAY_US} ORDER BY at_us DESC, feedback_id DESC LIMIT 2000),
k AS ({_KEYS_SQL} (SELECT * FROM r JOIN m USING (finding_no))), c AS (SELECT key, {SENTIMENT_SQL} FROM k GROUP BY key), p AS (SELECT * FROM ({_PRIOR_SQL}) WHERE repo_id IN (0, 1, 2)),
s AS (SELECT c.key, CAST(coalesce(addressed, 0) AS BIGINT) AS addressed, CAST(coalesce(ignored, 0) AS BIGINT) AS ignored, pos AS positive, neg AS negative FROM c LEFT JOIN p USING (key))
SELECT *, round({_WEIGHT_SQL}, 6) AS weight FROM s""")
def ag10(spark: SparkSession, d: str) -> DataFrame:
    return replace_reactions(feedback(spark, d), _mapping(spark, d), _prior(spark, d).where("repo_id in (0, 1, 2)"), NOW_US)


@query("ag12_top_categories_and_paths", """WITH c AS (SELECT 'category' AS kind, category AS name, count(*) AS n FROM findings GROUP BY ALL UNION ALL SELECT 'path', path, count(*) FROM findings GROUP BY ALL)
SELECT kind, name, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, name) AS INTEGER) AS rank FROM c) WHERE rank <= 5""")
def ag12(spark: SparkSession, d: str) -> DataFrame:
    """The five most frequent categories and paths; ties by name. One scan feeds both counts."""
    pairs = findings(spark, d).select(F.explode(F.array(F.struct(F.lit("category").alias("kind"), F.col("category").alias("name")), F.struct(F.lit("path").alias("kind"), F.col("path").alias("name")))).alias("x"))
    counts = pairs.groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))
    return top_per(counts, ["kind"], [F.desc("n"), F.asc("name")], 5).select("kind", "name", "n", "rank")


@query("ag13_weekly_report", """SELECT repo_id, count(*) AS runs, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
CASE WHEN count(*) FILTER (WHERE status <> 'running') > 0 THEN CAST(floor(100 * count(*) FILTER (WHERE status = 'completed') / count(*) FILTER (WHERE status <> 'running') + 0.5) AS BIGINT) END AS acceptance FROM runs GROUP BY repo_id""")
def ag13(spark: SparkSession, d: str) -> DataFrame:
    """Runs of each repository by status, and the share that completed in per cent."""
    ended = F.count_if(F.col("status") != "running")
    done = F.count_if(F.col("status") == "completed")
    return runs(spark, d).groupBy("repo_id").agg(
        F.count("*").alias("runs"), done.cast("long").alias("completed"), count_where(F.col("status") == "failed").alias("failed"), F.when(ended > 0, F.floor(100 * done / ended + 0.5).cast("long")).alias("acceptance")
    )


@query("ag14_pattern_buckets", """WITH s AS (SELECT category, title, severity, count(*) AS n FROM findings GROUP BY ALL)
SELECT category || ':' || title AS bucket, CAST(sum(n) AS BIGINT) AS total, string_agg(severity || '=' || n, ',' ORDER BY severity) AS by_severity FROM s GROUP BY category, title""")
def ag14(spark: SparkSession, d: str) -> DataFrame:
    """Findings by category and title, with counts by severity."""
    counts = findings(spark, d).groupBy("category", "title", "severity").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.concat_ws("=", "severity", "n")))
    return counts.groupBy("category", "title").agg(F.sum("n").alias("total"), F.array_join(entries, ",").alias("by_severity")).select(F.concat_ws(":", "category", "title").alias("bucket"), "total", "by_severity")


@query("ag18_mean_or_zero", "SELECT repo_id, round(coalesce(avg(latency_ms) FILTER (WHERE status = 'failed' AND latency_ms > 450000), 0), 6) AS mean FROM runs GROUP BY repo_id")
def ag18(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).groupBy("repo_id").agg(rounded(F.coalesce(F.avg(F.when((F.col("status") == "failed") & (F.col("latency_ms") > 450000), F.col("latency_ms"))), F.lit(0.0))).alias("mean"))


def nearest_rank(column: str, percent: int) -> Column:
    """The nearest-rank percentile, 0 without values (AG19)."""
    return F.coalesce(F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {column})"), F.lit(0))


@query("ag19_nearest_rank_p95", "SELECT repo_id, CAST(coalesce(quantile_disc(latency_ms, 0.95), 0) AS BIGINT) AS p95 FROM runs GROUP BY repo_id")
def ag19(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).groupBy("repo_id").agg(nearest_rank("latency_ms", 95).cast("long").alias("p95"))


@query("ag20_p95_by_size", """WITH b AS (SELECT *, CASE WHEN pr_id <= 300 THEN 'small' WHEN pr_id <= 1500 THEN 'medium' ELSE 'large' END AS bucket FROM runs)
SELECT bucket, count(*) AS runs, CAST(coalesce(quantile_disc(latency_ms, 0.95) FILTER (WHERE latency_ms > 0), 0) AS BIGINT) AS p95 FROM b GROUP BY bucket""")
def ag20(spark: SparkSession, d: str) -> DataFrame:
    """95th percentile of positive latencies by repository size."""
    bucket = F.when(F.col("pr_id") <= 300, "small").when(F.col("pr_id") <= 1500, "medium").otherwise("large")
    return runs(spark, d).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("runs"), nearest_rank("if(latency_ms > 0, latency_ms, null)", 95).cast("long").alias("p95"))


@query("ag21_hotspots", """WITH c AS (SELECT path, category, count(*) AS n, count(*) FILTER (WHERE status = 'open') AS o FROM findings GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, category) AS k FROM c),
p AS (SELECT path, CAST(sum(o) AS BIGINT) AS open, CAST(sum(n) AS BIGINT) AS total, string_agg(category, ',' ORDER BY k) FILTER (WHERE k <= 2) AS top FROM r GROUP BY path)
SELECT * FROM p ORDER BY open DESC, total DESC, path LIMIT 8""")
def ag21(spark: SparkSession, d: str) -> DataFrame:
    """The eight paths with most open findings, with their two most frequent categories."""
    counts = findings(spark, d).groupBy("path", "category").agg(F.count("*").alias("n"), count_where(F.col("status") == "open").alias("o"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "category")))
    paths = counts.groupBy("path").agg(F.sum("o").alias("open"), F.sum("n").alias("total"), F.array_join(F.slice(ordered, 1, 2)["category"], ",").alias("top"))
    return paths.orderBy(F.desc("open"), F.desc("total"), "path").limit(8)


@query("ag22_over_budget", "SELECT thread_id, CAST(sum(bytes) AS BIGINT) AS total FROM logs WHERE thread_id IS NOT NULL GROUP BY thread_id HAVING sum(bytes) > 1500")
def ag22(spark: SparkSession, d: str) -> DataFrame:
    """Threads whose logs exceed a byte budget."""
    return logs(spark, d).where("thread_id is not null").groupBy("thread_id").agg(F.sum("bytes").alias("total")).where("total > 1500")


@query("ag23_max_id", "SELECT level, coalesce(max(id) FILTER (WHERE thread_id IS NULL), 0) AS max_id FROM logs GROUP BY level")
def ag23(spark: SparkSession, d: str) -> DataFrame:
    return logs(spark, d).groupBy("level").agg(F.coalesce(F.max(F.when(F.col("thread_id").isNull(), F.col("id"))), F.lit(0)).alias("max_id"))


@query("ag24_job_stats", "SELECT pr_id % 10 AS worker, count(*) AS claimed, count(*) FILTER (WHERE status = 'completed') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(sum(CASE WHEN status = 'completed' AND sha < 3 THEN latency_ms END) AS BIGINT) AS tokens FROM runs GROUP BY 1")
def ag24(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of jobs; the token sum is null where no job reported any."""
    status = F.col("status")
    return runs(spark, d).groupBy((F.col("pr_id") % 10).alias("worker")).agg(
        F.count("*").alias("claimed"), count_where(status == "completed").alias("succeeded"), count_where(status == "failed").alias("failed"), F.sum(F.when((status == "completed") & (F.col("sha") < 3), F.col("latency_ms"))).alias("tokens")
    )


@query("ag25_metric_totals", """SELECT target AS metric, CAST(sum(bytes) AS BIGINT) AS total, CAST(arg_max(id % 50, id) FILTER (WHERE id % 50 > 0) AS BIGINT) AS gauge FROM logs GROUP BY target""")
def ag25(spark: SparkSession, d: str) -> DataFrame:
    """Counters are summed; a gauge keeps its last positive value."""
    value = F.col("id") % 50
    return logs(spark, d).groupBy(F.col("target").alias("metric")).agg(F.sum("bytes").alias("total"), F.max_by(value, F.when(value > 0, F.col("id"))).alias("gauge"))


@query("ag26_coverage", """WITH c AS (SELECT run_id, path, max(CASE WHEN severity <> 'nit' THEN 1 ELSE 0 END) AS covered FROM findings GROUP BY ALL),
s AS (SELECT run_id, count(*) AS files, CAST(sum(covered) AS BIGINT) AS covered FROM c GROUP BY run_id)
SELECT run_id, files, covered, files - covered AS uncovered, round(covered / files, 6) AS ratio, CAST(least(6, greatest(2, ceil(files / 2))) AS BIGINT) AS expected FROM s""")
def ag26(spark: SparkSession, d: str) -> DataFrame:
    """Changed files of each run that have an inline finding, and how many findings are expected."""
    paths = findings(spark, d).groupBy("run_id", "path").agg(F.max((F.col("severity") != "nit").cast("long")).alias("covered"))
    sums = paths.groupBy("run_id").agg(F.count("*").alias("files"), F.sum("covered").alias("covered"))
    return sums.select(
        "run_id", "files", "covered", (F.col("files") - F.col("covered")).alias("uncovered"), rounded(F.col("covered") / F.col("files")).alias("ratio"), F.least(F.lit(6), F.greatest(F.lit(2), F.ceil(F.col("files") / 2))).cast("long").alias("expected")
    )


@query("ag27_confidence", """SELECT run_id, round(CAST(least(0.95, greatest(0.2, CASE run_id % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.75 ELSE 0.6 END - 0.18 * count(*) FILTER (WHERE severity = 'blocking') - 0.08 * count(*) FILTER (WHERE severity = 'important') - 0.02 * count(*) FILTER (WHERE severity = 'nit'))) AS DOUBLE), 6) AS confidence FROM findings GROUP BY run_id""")
def ag27(spark: SparkSession, d: str) -> DataFrame:
    """Merge confidence: a base by risk, less a share for every finding."""
    base = F.when(F.col("run_id") % 3 == 0, 0.9).when(F.col("run_id") % 3 == 1, 0.75).otherwise(0.6)
    counts = findings(spark, d).groupBy("run_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("blocking", "important", "nit")))
    less = F.col("blocking") * 0.18 + F.col("important") * 0.08 + F.col("nit") * 0.02
    return counts.select("run_id", rounded(F.least(F.lit(0.95), F.greatest(F.lit(0.2), base - less))).alias("confidence"))


@query("ag28_breakdown", """SELECT run_id, path, count(*) || ' finding' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || ' (' || count(*) FILTER (WHERE severity = 'blocking') || ' blocking)' AS summary FROM findings GROUP BY ALL""")
def ag28(spark: SparkSession, d: str) -> DataFrame:
    """A line of text for each file of a run."""
    counts = findings(spark, d).groupBy("run_id", "path").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "blocking").alias("b"))
    return counts.select("run_id", "path", F.expr("concat(n, ' finding', if(n = 1, '', 's'), ' (', b, ' blocking)')").alias("summary"))


@query("ag29_vote_tallies", f"""WITH r AS (SELECT * FROM feedback WHERE at_us >= {NOW_US - 30 * DAY_US} ORDER BY at_us DESC, feedback_id DESC LIMIT 400)
SELECT count(*) FILTER (WHERE coalesce(sentiment, action) IN ('thumbs_up','+1','heart','laugh','hooray')) AS positive, count(*) FILTER (WHERE coalesce(sentiment, action) IN ('thumbs_down','-1','confused')) AS negative, count(*) AS votes FROM r""")
def ag29(spark: SparkSession, d: str) -> DataFrame:
    """Votes among the newest 400 of 30 days; here a reply's action is held against the reactions."""
    recent = feedback(spark, d).where(F.col("at_us") >= NOW_US - 30 * DAY_US).orderBy(F.desc("at_us"), F.desc("feedback_id")).limit(400)
    said = F.coalesce("sentiment", "action")
    return recent.agg(count_where(said.isin(POSITIVE)).alias("positive"), count_where(said.isin(NEGATIVE)).alias("negative"), F.count("*").alias("votes"))


@query("ag30_evidence_fold", """WITH e AS (SELECT run_id % 500 AS run, run_id * 10 + ordinal AS pos, repo_id AS score, line % 7 AS via, finding_id FROM findings),
o AS (SELECT run, list({'s': score, 'v': via} ORDER BY pos, score, via, finding_id) AS l FROM e GROUP BY run),
f AS (SELECT run, list_reduce(l, lambda a, x: CASE WHEN x.s > a.s OR x.v > a.v THEN x ELSE a END) AS r FROM o) SELECT run, r.s AS score, r.v AS via FROM f""")
def ag30(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of a path, folded in order: a later one replaces it if its score or its via count is higher."""
    e = findings(spark, d).select((F.col("run_id") % 500).alias("run"), (F.col("run_id") * 10 + F.col("ordinal")).alias("pos"), F.col("repo_id").alias("s"), (F.col("line") % 7).alias("v"), "finding_id")
    ordered = e.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("pos", "s", "v", "finding_id"))).alias("l"))
    fold = F.expr("aggregate(slice(l, 2, greatest(size(l) - 1, 0)), struct(l[0].s as s, l[0].v as v), (a, x) -> if(x.s > a.s or x.v > a.v, struct(x.s as s, x.v as v), a))")
    return ordered.withColumn("r", fold).select("run", F.col("r.s").alias("score"), F.col("r.v").alias("via"))
