"""Review findings: scores, filters, refinement, matching, lifecycle (SF4 to SF6, SF14, SF20, SF22 to SF25, FP8, FP9, FP15, WN4, WN5, TK5 to TK7, JN12, JN13, CP13, CP14)."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import CATEGORIES, findings, table
from ..functions import text as T
from ..plans.stored import stored
from ..registry import query
from .ranking import top_per

_NOISE = ", ".join(f"'{w}'" for w in T.NOISE)


def _title_tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda t: length(t) >= 3 AND t NOT IN ({_NOISE})))"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END"


_COMMENTS_SQL = """SELECT p_partkey AS id, 'src/m' || (p_partkey % 7) || '/f' || (p_partkey % 3) || '.ts' AS path, CASE WHEN p_partkey % 9 = 0 THEN 'LEFT' ELSE 'RIGHT' END AS side, CAST(p_size AS BIGINT) * 3 AS line,
CASE p_partkey % 4 WHEN 0 THEN 'blocking' WHEN 1 THEN 'important' ELSE 'nit' END AS severity, CASE p_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS confidence,
['security', 'bug', 'performance', 'testing', 'maintainability', 'style'][p_partkey % 6 + 1] AS category, p_name || ' should ' || lower(p_type) || ' run' AS title, p_brand || ' with ' || p_name || repeat(' more', CAST(p_partkey % 40 AS BIGINT)) AS body,
CASE WHEN p_partkey % 13 = 0 THEN '' ELSE repeat('evidence ', CAST(p_partkey % 60 AS BIGINT)) END AS evidence, CASE WHEN p_partkey % 5 < 3 THEN 'fix' END AS patch, CASE WHEN p_partkey % 8 = 0 THEN 'summary' ELSE 'inline' END AS comment_type,
CASE WHEN p_partkey % 4 = 0 THEN 'r' || (p_partkey % 3) END AS rule_id, p_partkey AS ordinal FROM part"""


def comments(spark: SparkSession, d: str) -> DataFrame:
    """Review comments before refinement."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("id"),
        F.expr("concat('src/m', p_partkey % 7, '/f', p_partkey % 3, '.ts')").alias("path"),
        F.when(k % 9 == 0, "LEFT").otherwise("RIGHT").alias("side"),
        (F.col("p_size").cast("long") * 3).alias("line"),
        F.when(k % 4 == 0, "blocking").when(k % 4 == 1, "important").otherwise("nit").alias("severity"),
        F.when(k % 3 == 0, "high").when(k % 3 == 1, "low").alias("confidence"),
        F.element_at(F.array(*map(F.lit, CATEGORIES)), (k % 6 + 1).cast("int")).alias("category"),
        F.expr("concat(p_name, ' should ', lower(p_type), ' run')").alias("title"),
        F.expr("concat(p_brand, ' with ', p_name, repeat(' more', cast(p_partkey % 40 as int)))").alias("body"),
        F.expr("if(p_partkey % 13 = 0, '', repeat('evidence ', cast(p_partkey % 60 as int)))").alias("evidence"),
        F.when(k % 5 < 3, "fix").alias("patch"),
        F.when(k % 8 == 0, "summary").otherwise("inline").alias("comment_type"),
        F.expr("if(p_partkey % 4 = 0, concat('r', p_partkey % 3), null)").alias("rule_id"),
        k.alias("ordinal"),
    )


@query("sf4_title_jaccard", f"WITH c AS ({_COMMENTS_SQL}) SELECT a.id, round({_jaccard(_title_tokens('a.title'), _title_tokens('b.title'))}, 9) AS score FROM c a JOIN c b ON b.id = a.id + 1")
def sf4(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of the titles of neighbouring comments."""
    c = comments(spark, d).select("id", T.title_tokens(F.col("title")).alias("tokens"))
    other = c.select((F.col("id") - 1).alias("id"), F.col("tokens").alias("others"))
    return c.join(other, "id").select("id", F.round(T.jaccard(F.col("tokens"), F.col("others")), 9).alias("score"))


def composite_match(title: Column, body: Column, distance: Column, same_side: Column, same_severity: Column) -> Column:
    """Score of a new finding with an old one, null where the titles are too different (SF6)."""
    score = title * 0.64 + body * 0.16 + T.line_proximity(distance) * 0.14 + F.when(same_side, 1.0).otherwise(0.7) * 0.04 + F.when(same_severity, 1.0).otherwise(0.7) * 0.02
    close = (title >= 0.5) | ((title >= 0.34) & (distance <= 8))
    return F.when(close & (score >= 0.5), score)


#: From this distance of lines on their nearness is the same (SF5).
FAR = 26


def sharing_pairs(new: DataFrame, old: DataFrame, on: list[str], tokens: str, least: float) -> DataFrame:
    """id, o_id: pairs with equal `on` whose token sets can reach a Jaccard likeness of `least`, without meeting all of a group.

    Both sides are indexed by their rarest tokens only, as many as can't all be missing from the other: two sets that are like enough share one of these.
    `new` has id, `old` o_id, both `on` and `tokens`.
    """
    often = old.select(F.explode(tokens).alias("t")).groupBy("t").agg(F.count("*").alias("n"))

    def rare(df: DataFrame, id: str) -> DataFrame:
        counted = df.select(id, *on, F.explode(tokens).alias("t")).join(often, "t", "left")
        sorted_ = counted.groupBy(id, *on).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "t"))).alias("ts"))
        some = F.slice("ts", F.lit(1), (F.size("ts") - F.ceil(F.size("ts") * least - 1e-9) + 1).cast("int"))
        return sorted_.select(id, *on, F.explode(some).alias("x")).select(id, *on, "x.t")

    return rare(new, "id").join(rare(old, "o_id"), [*on, "t"]).select("id", "o_id").distinct()


def best_matches(c: DataFrame) -> DataFrame:
    """id, old_id, score: for each finding (id, path, category, side, severity, line, token sets tt and bt) the best one with a smaller id and equal path and category.

    Findings never meet one by one. Those that differ in id and line alone are one kind, and kinds are paired by their titles. Of a kind's findings on a line, and of those too far away for the
    line to count, only the oldest can be the best. A kind can be of use to findings between its oldest and the oldest of a kind that is better for them even from afar.
    Only within that range of ids are findings joined with kinds, and with their lines nearby.
    """
    keys = ["path", "category"]
    sets = c.withColumns({"tt": F.array_sort("tt"), "bt": F.coalesce(F.array_sort("bt"), F.array().cast("array<string>"))})
    titles = stored(sets.select(*keys, "tt").distinct().withColumn("title", F.monotonically_increasing_id()), "titles")
    titled = sets.join(titles, [*keys, "tt"]).select("id", "line", "title", "bt", "side", "severity")
    kind = ["title", "bt", "side", "severity"]
    kinds = stored(titled.groupBy(*kind).agg(F.min("id").alias("oldest"), F.max("id").alias("newest")).withColumn("kind", F.monotonically_increasing_id()), "kinds")
    rows = stored(titled.join(kinds, (titled["title"] == kinds["title"]) & (titled["bt"] == kinds["bt"]) & titled["side"].eqNullSafe(kinds["side"]) & titled["severity"].eqNullSafe(kinds["severity"])).select("id", "kind", "line"), "rows")

    one, other = (titles.select(F.col("title").alias(f"{p}title"), F.col("tt").alias(f"{p}tt")) for p in ("n_", "o_"))
    named = titles.withColumnRenamed("title", "id"), titles.withColumnRenamed("title", "o_id")
    pairs = sharing_pairs(*named, keys, "tt", 0.34).join(one.withColumnRenamed("n_title", "id"), "id").join(other.withColumnRenamed("o_title", "o_id"), "o_id")
    alike = pairs.select(F.col("id").alias("n_title"), F.col("o_id").alias("o_title"), T.jaccard(F.col("n_tt"), F.col("o_tt")).alias("likeness")).where("likeness >= 0.34")
    n, o = (kinds.select(*(F.col(x).alias(f"{p}{x}") for x in kinds.columns)) for p in ("n_", "o_"))
    same = {x: F.coalesce(F.col(f"n_{x}") == F.col(f"o_{x}"), F.lit(False)) for x in ("side", "severity")}
    met = alike.join(n, "n_title").join(o, "o_title").where("o_oldest < n_newest").select("n_kind", "o_kind", "o_oldest", "likeness", T.jaccard(F.col("n_bt"), F.col("o_bt")).alias("body"), same["side"].alias("same_side"), same["severity"].alias("same_severity"))
    score = lambda distance: F.round(composite_match(F.col("likeness"), F.col("body"), distance, F.col("same_side"), F.col("same_severity")), 9)
    bounded = met.withColumns({"best": score(F.lit(0)), "far": score(F.lit(FAR))}).where("best is not null")

    # each pair asks with its best score which surely better kind is there first, and answers with its score from afar
    says = F.array(F.struct(F.col("best").alias("at"), F.lit(0).alias("answers")), F.struct(F.col("far").alias("at"), F.lit(1).alias("answers")))
    told = bounded.withColumn("s", F.explode(says)).where("s.at is not null")
    above = Window.partitionBy("n_kind").orderBy(F.desc("s.at"), "s.answers").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = told.withColumn("until", F.min(F.when(F.col("s.answers") == 1, F.col("o_oldest"))).over(above)).where("s.answers = 0 and (until is null or until > o_oldest)").drop("s", "best")
    asked = stored(rows.withColumnRenamed("kind", "n_kind").join(told, "n_kind").where("id > o_oldest and (until is null or id <= until)").drop("n_kind", "until"), "asked")

    at = rows.where("line is not null").groupBy(F.col("kind").alias("o_kind"), F.col("line").alias("o_line")).agg(F.min("id").alias("o_id"))
    bin = F.floor(F.col("o_line") / FAR)
    near = asked.withColumn("bin", F.floor(F.col("line") / FAR)).join(at.withColumn("bin", F.explode(F.array(bin - 1, bin, bin + 1))), ["o_kind", "bin"]).where("o_id < id")
    scored = near.select("id", "o_id", score(F.abs(F.col("line") - F.col("o_line"))).alias("score")).unionByName(asked.select("id", F.col("o_oldest").alias("o_id"), F.col("far").alias("score")))
    best = scored.where("score is not null").groupBy("id").agg(F.max(F.struct("score", (-F.col("o_id")).alias("o"))).alias("b"))
    return best.select("id", (-F.col("b.o")).alias("old_id"), F.col("b.score").alias("score"))


@query("sf6_best_match", f"""WITH c AS ({_COMMENTS_SQL}), t AS (SELECT *, {_title_tokens('title')} AS tt, {_title_tokens('body')} AS bt FROM c),
j AS (SELECT n.id, o.id AS old_id, {_jaccard('n.tt', 'o.tt')} AS title, {_jaccard('n.bt', 'o.bt')} AS body, abs(o.line - n.line) AS dist, o.side = n.side AS ss, o.severity = n.severity AS sv FROM t n JOIN t o ON n.path = o.path AND n.category = o.category AND o.id < n.id),
s AS (SELECT *, title * 0.64 + body * 0.16 + CASE WHEN dist <= 2 THEN 1.0 WHEN dist <= 6 THEN 0.9 WHEN dist <= 12 THEN 0.75 WHEN dist <= 25 THEN 0.55 ELSE 0.3 END * 0.14 + CASE WHEN ss THEN 1.0 ELSE 0.7 END * 0.04 + CASE WHEN sv THEN 1.0 ELSE 0.7 END * 0.02 AS score FROM j WHERE title >= 0.5 OR (title >= 0.34 AND dist <= 8))
SELECT id, old_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, old_id) AS r FROM s WHERE score >= 0.5) WHERE r = 1""")
def sf6(spark: SparkSession, d: str) -> DataFrame:
    """The best old finding of the same path and category for each new one; ties go to the older."""
    return best_matches(comments(spark, d).select("id", "path", "category", "side", "severity", "line", T.title_tokens(F.col("title")).alias("tt"), T.title_tokens(F.col("body")).alias("bt")))


def priority(policy_negative: list[str], policy_positive: list[str]) -> Column:
    """Priority of a comment (SF23): severity by confidence, category, boosts, penalty, and 20 times the learned weight `w`."""
    category = F.col("category")
    base = T.looked_up(T.SEVERITY, F.col("severity")) * F.coalesce(T.looked_up(T.CONFIDENCE, F.col("confidence")), F.lit(0.7))
    boosts = F.when(F.col("patch").isNotNull(), 6).otherwise(0) + F.least(F.lit(6), F.floor(F.length("evidence") / 80)) + F.when(F.col("in_diff"), 6).otherwise(0) + F.when(F.col("in_changed"), 4).otherwise(0)
    learned = F.when(category.isin(policy_positive), 8).otherwise(0) - F.when(category.isin(policy_negative), 18).otherwise(0) + F.col("w") * 20
    return base + T.looked_up(T.CATEGORY, category) + boosts + learned


_NORMAL_SQL = f"""c AS (SELECT id, path, side, line, confidence, category, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, trim(evidence) AS evidence, patch, ordinal, rule_id, comment_type,
  CASE WHEN category = 'style' THEN 'nit' WHEN severity = 'blocking' AND patch IS NULL THEN 'important' ELSE severity END AS severity FROM ({_COMMENTS_SQL})),
g AS (SELECT *, line % 2 = 0 AS in_diff, line % 5 < 3 AS in_changed, CASE WHEN rule_id = 'r1' AND category = 'bug' THEN 0.5 WHEN category = 'bug' THEN -0.25 WHEN category = 'testing' THEN 1.0 ELSE 0.0 END AS w FROM c WHERE evidence <> ''),
h AS (SELECT *, CASE WHEN comment_type = 'summary' OR NOT in_diff THEN 'summary' ELSE 'inline' END AS kind,
  CASE severity WHEN 'blocking' THEN 100.0 WHEN 'important' THEN 65.0 ELSE 25.0 END * CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 WHEN 'low' THEN 0.35 ELSE 0.7 END
  + CASE category WHEN 'security' THEN 25.0 WHEN 'bug' THEN 20.0 WHEN 'performance' THEN 15.0 WHEN 'testing' THEN 12.0 WHEN 'maintainability' THEN 8.0 ELSE 2.0 END
  + CASE WHEN patch IS NOT NULL THEN 6 ELSE 0 END + least(6, floor(length(evidence) / 80)) + CASE WHEN in_diff THEN 6 ELSE 0 END + CASE WHEN in_changed THEN 4 ELSE 0 END
  + CASE WHEN category = 'performance' THEN 8 ELSE 0 END - CASE WHEN category = 'style' THEN 18 ELSE 0 END + w * 20 AS score FROM g)"""


def normalized_comments(spark: SparkSession, d: str) -> DataFrame:
    """Comments with normal texts (SF24), rewritten severities (SF25), placement, and priority (SF23); those without evidence go."""
    c = comments(spark, d).withColumns({"title": F.trim(F.regexp_replace("title", r"\s+", " ")), "evidence": F.trim("evidence")}).where("evidence != ''")
    severity = F.when(F.col("category") == "style", "nit").when((F.col("severity") == "blocking") & F.col("patch").isNull(), "important").otherwise(F.col("severity"))
    rule, category = F.col("rule_id"), F.col("category")
    weight = F.when((rule == "r1") & (category == "bug"), 0.5).when(category == "bug", -0.25).when(category == "testing", 1.0).otherwise(0.0)
    placed = c.withColumns({"severity": severity, "in_diff": F.col("line") % 2 == 0, "in_changed": F.col("line") % 5 < 3, "w": weight})
    kind = F.when((F.col("comment_type") == "summary") | ~F.col("in_diff"), "summary").otherwise("inline")
    return placed.withColumns({"kind": kind, "score": priority(["style"], ["performance"])})


@query("sf23_priority", f"WITH {_NORMAL_SQL} SELECT id, severity, kind, round(score, 6) AS score FROM h")
def sf23(spark: SparkSession, d: str) -> DataFrame:
    return normalized_comments(spark, d).select("id", "severity", "kind", F.round("score", 6).alias("score"))


@query("sf24_comment_ids", f"WITH c AS ({_COMMENTS_SQL}) SELECT id, 'c-' || substr(sha1(path || '|' || side || '|' || line || '|' || title), 1, 12) AS comment_id, substr(sha1(path || '|' || line || '|' || category || '|' || title), 1, 16) AS comment_key FROM c")
def sf24(spark: SparkSession, d: str) -> DataFrame:
    """Ids and keys of comments that came without."""
    c = comments(spark, d)
    return c.select(
        "id", F.concat(F.lit("c-"), F.substring(F.sha1(F.concat_ws("|", "path", "side", "line", "title")), 1, 12)).alias("comment_id"), F.substring(F.sha1(F.concat_ws("|", "path", "line", "category", "title")), 1, 16).alias("comment_key")
    )


def strongest(df: DataFrame, by: list[Column]) -> DataFrame:
    """The row with the highest score of each key; the first wins ties (WN4). max_by combines before the shuffle."""
    names = [f"_k{i}" for i in range(len(by))]
    keyed = df.select("*", *(k.alias(n) for k, n in zip(by, names, strict=True)))
    best = keyed.groupBy(*names).agg(F.max_by(F.struct(*df.columns), F.struct("score", (-F.col("ordinal")).alias("first"))).alias("row"))
    return best.select("row.*")


_STRONG_SQL = """s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, side, category, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), kind ORDER BY score DESC, ordinal) AS r FROM h) WHERE r = 1)"""


@query("wn4_strongest", f"WITH {_NORMAL_SQL}, {_STRONG_SQL} SELECT id, kind, round(score, 6) AS score FROM s")
def wn4(spark: SparkSession, d: str) -> DataFrame:
    c = normalized_comments(spark, d)
    keys = [F.col("path"), F.col("side"), F.col("category"), T.plain_title(F.col("title")), F.col("kind")]
    return strongest(c, keys).select("id", "kind", F.round("score", 6).alias("score"))


def unique_names(df: DataFrame, id: str, key: str, order: list[Column]) -> DataFrame:
    """Ids and keys with their occurrence number behind them where either has come before (WN5)."""
    nth = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(*order))
    seen = df.withColumns({"_i": nth(id), "_k": nth(key)})
    again = (F.col("_i") > 1) | (F.col("_k") > 1)
    suffixed = lambda c, n: F.when(again, F.concat_ws("-", c, n)).otherwise(F.col(c))
    return seen.withColumns({id: suffixed(id, "_i"), key: suffixed(key, "_k")}).drop("_i", "_k")


@query("wn5_unique_names", """WITH b AS (SELECT p_partkey, p_brand AS id, p_name AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS j FROM part)
SELECT p_partkey, CASE WHEN i > 1 OR j > 1 THEN id || '-' || i ELSE id END AS comment_id, CASE WHEN i > 1 OR j > 1 THEN k || '-' || j ELSE k END AS comment_key FROM b""")
def wn5(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("comment_id"), F.col("p_name").alias("comment_key"))
    return unique_names(named, "comment_id", "comment_key", [F.asc("p_partkey")])


def refine(c: DataFrame, max_inline: int) -> DataFrame:
    """Strongest comments, a cap of inline ones per path, in final order (CP13, WN3, TK6): `place` is added."""
    kept = strongest(c, [F.col("path"), F.col("side"), F.col("line"), F.col("category"), T.plain_title(F.col("title")), F.col("kind")])
    cap = max(3, min(12, -(-max_inline // 2)))
    ordered = F.row_number().over(Window.partitionBy("path", "kind").orderBy(F.desc("score"), "ordinal"))
    capped = kept.withColumn("_n", ordered).where((F.col("kind") == "summary") | (F.col("_n") <= cap))
    return capped.drop("_n")


@query("cp13_refined_comments", f"""WITH {_NORMAL_SQL}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, side, line, category, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), kind ORDER BY score DESC, ordinal) AS r FROM h) WHERE r = 1),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, kind ORDER BY score DESC, ordinal) AS n FROM s) WHERE kind = 'summary' OR n <= 5) SELECT id, kind, severity, round(score, 6) AS score FROM k""")
def cp13(spark: SparkSession, d: str) -> DataFrame:
    return refine(normalized_comments(spark, d), 10).select("id", "kind", "severity", F.round("score", 6).alias("score"))


@query("tk6_comment_order", f"WITH {_NORMAL_SQL} SELECT id, round(score, 6) AS score FROM h ORDER BY round(score, 6) DESC, path, line, id LIMIT 40")
def tk6(spark: SparkSession, d: str) -> DataFrame:
    """The first 40 comments in final order: score, path, line."""
    return normalized_comments(spark, d).select("id", F.round("score", 6).alias("score"), "path", "line").orderBy(F.desc("score"), "path", "line", "id").limit(40).select("id", "score")


@query("tk5_open_findings", """SELECT finding_id, severity, path, line FROM findings WHERE status = 'open' AND repo_id = 3 ORDER BY CASE severity WHEN 'blocking' THEN 0 WHEN 'important' THEN 1 ELSE 2 END, path, line, title, finding_id LIMIT 80""")
def tk5(spark: SparkSession, d: str) -> DataFrame:
    """Open findings by severity, path, line, title. Paths compare by bytes, not by a locale."""
    rank = F.when(F.col("severity") == "blocking", 0).when(F.col("severity") == "important", 1).otherwise(2)
    found = findings(spark, d).where("status = 'open' and repo_id = 3")
    return found.orderBy(rank, "path", "line", "title", "finding_id").limit(80).select("finding_id", "severity", "path", "line")


@query("tk7_uncovered_targets", """WITH c AS (SELECT path, CAST(sum(line) AS BIGINT) AS churn FROM findings WHERE repo_id = 5 GROUP BY path) SELECT path, CASE WHEN churn >= 250 THEN 'high' WHEN churn >= 80 THEN 'medium' ELSE 'low' END AS risk, churn FROM c
ORDER BY CASE WHEN churn >= 250 THEN 3 WHEN churn >= 80 THEN 2 ELSE 1 END * 100 + least(99, churn) DESC, path LIMIT 16""")
def tk7(spark: SparkSession, d: str) -> DataFrame:
    """The 16 files most in need of a look: by risk, then churn, then path (SF22)."""
    churn = findings(spark, d).where("repo_id = 5").groupBy("path").agg(F.sum("line").alias("churn")).withColumn("risk", T.churn_risk(F.col("churn")))
    rank = F.when(F.col("risk") == "high", 3).when(F.col("risk") == "medium", 2).otherwise(1)
    return churn.orderBy(F.desc(rank * 100 + F.least(F.lit(99), F.col("churn"))), "path").limit(16).select("path", "risk", "churn")


def publishable(c: DataFrame, strictness: str, max_inline: int, ignored: str, negative: list[str]) -> DataFrame:
    """Comments that may be published, with `type` (FP8).

    Each condition is a filter; repeated ones keep their first. The cap on inline comments ends the scan, so summary
    comments after the capping one are left out as well.
    """
    confidence = F.coalesce("confidence", F.lit("medium"))
    ok = ~F.col("path").rlike(ignored) & ~F.trim("evidence").isin("", '""', "''")
    ok &= (F.col("comment_type") == "summary") | ((F.col("severity") != "blocking") | F.col("patch").isNotNull()) & F.col("in_diff")
    if strictness == "high":
        ok &= (F.col("severity") != "nit") & (confidence != "low")
    elif strictness == "medium":
        ok &= ~((F.col("severity") == "nit") & (confidence == "low"))
    ok &= ~F.col("category").isin(negative) | (F.col("severity") == "blocking") | (confidence == "high")
    key = F.when(F.col("comment_type") == "summary", F.concat_ws("|", "category", F.lower("title"), F.lower("body"))).otherwise(F.concat_ws("|", "path", "side", "line", F.lower("title")))
    kept = c.where(ok).groupBy("comment_type", key.alias("_key")).agg(F.min_by(F.struct("id", "ordinal"), "ordinal").alias("c")).select("c.*", "comment_type")
    last = kept.where("comment_type = 'inline'").orderBy("ordinal").limit(max_inline).agg(F.max("ordinal").alias("_last"), F.count("*").alias("_n"))  # one row
    return kept.join(F.broadcast(last), F.lit(True)).where((F.col("_n") < max_inline) | (F.col("ordinal") <= F.col("_last"))).select("id", F.col("comment_type").alias("type"))


@query("fp8_publish_filter", f"""WITH c AS (SELECT *, line % 2 = 0 AS in_diff, coalesce(confidence, 'medium') AS conf FROM ({_COMMENTS_SQL})),
k AS (SELECT *, CASE WHEN comment_type = 'summary' THEN category || '|' || lower(title) || '|' || lower(body) ELSE path || '|' || side || '|' || line || '|' || lower(title) END AS key FROM c WHERE NOT regexp_matches(path, '^src/m3/') AND trim(evidence) NOT IN ('', '""', '''''')
AND (comment_type = 'summary' OR ((severity <> 'blocking' OR patch IS NOT NULL) AND in_diff)) AND NOT (severity = 'nit' AND conf = 'low') AND (category NOT IN ('style') OR severity = 'blocking' OR conf = 'high')),
f AS (SELECT *, row_number() OVER (PARTITION BY comment_type, key ORDER BY ordinal) AS r FROM k), u AS (SELECT * FROM f WHERE r = 1),
n AS (SELECT *, sum(CASE WHEN comment_type = 'inline' THEN 1 ELSE 0 END) OVER (ORDER BY ordinal) AS inl FROM u), m AS (SELECT min(ordinal) AS stop FROM n WHERE inl >= 60)
SELECT id, comment_type AS type FROM n, m WHERE stop IS NULL OR ordinal <= stop""")
def fp8(spark: SparkSession, d: str) -> DataFrame:
    return publishable(comments(spark, d).withColumn("in_diff", F.col("line") % 2 == 0), "medium", 60, "^src/m3/", ["style"])


@query("fp9_verdicts", f"""WITH c AS ({_COMMENTS_SQL}), v AS (SELECT p_partkey % 700 AS id, arg_max(CASE p_size % 3 WHEN 0 THEN 'drop' WHEN 1 THEN 'revise' ELSE 'keep' END, p_partkey) AS verdict, arg_max(p_brand, p_partkey) AS revised FROM part GROUP BY 1)
SELECT c.id, CASE WHEN verdict = 'revise' THEN revised ELSE title END AS title FROM c LEFT JOIN v USING (id) WHERE coalesce(verdict, 'keep') <> 'drop'""")
def fp9(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on comments carried out: dropped, revised or kept; the last verdict of an id holds."""
    size = F.col("p_size") % 3
    verdict = F.when(size == 0, "drop").when(size == 1, "revise").otherwise("keep")
    v = table(spark, d, "part").groupBy((F.col("p_partkey") % 700).alias("id")).agg(F.max_by(verdict, "p_partkey").alias("verdict"), F.max_by("p_brand", "p_partkey").alias("revised"))
    joined = comments(spark, d).select("id", "title").join(v, "id", "left").where("coalesce(verdict, 'keep') != 'drop'")
    return joined.select("id", F.when(F.col("verdict") == "revise", F.col("revised")).otherwise(F.col("title")).alias("title"))


@query("fp15_symbol_hits", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = o_custkey AND l_linenumber * 10 BETWEEN o_orderkey % 50 AND o_orderkey % 50 + 15)")
def fp15(spark: SparkSession, d: str) -> DataFrame:
    """Symbols whose range a changed line falls into: distinct lines first, then a semi-join on the file."""
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("o_custkey"), (F.col("l_linenumber") * 10).alias("line")).distinct()
    ranges = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("file"), (F.col("o_orderkey") % 50).alias("first"))
    inside = (F.col("r.file") == F.col("h.o_custkey")) & F.col("h.line").between(F.col("r.first"), F.col("r.first") + 15)
    return ranges.alias("r").join(lines.alias("h"), inside, "left_semi").select("o_orderkey")


@query("jn13_near_base", f"""WITH c AS ({_COMMENTS_SQL}), k AS (SELECT id, line, path || '|' || category || '|' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS key FROM c)
SELECT id FROM k a WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM k b WHERE b.id % 2 = 0 AND a.key = b.key AND abs(a.line - b.line) <= 8)""")
def jn13(spark: SparkSession, d: str) -> DataFrame:
    """New comments that no base comment with the same key stands within eight lines of."""
    c = comments(spark, d)
    keyed = c.select("id", "line", T.semantic_key(F.col("path"), F.col("category"), F.col("title")).alias("key"))
    new, base = keyed.where("id % 2 = 1").alias("n"), keyed.where("id % 2 = 0").alias("b")
    return new.join(base, (F.col("n.key") == F.col("b.key")) & (F.abs(F.col("n.line") - F.col("b.line")) <= 8), "left_anti").select("id")


def kept_in_order(new: DataFrame, base: DataFrame, apart: int = 8) -> DataFrame:
    """Rows of `new` (key, line, ordinal and others) that no row of `base`, and none of `new` that was kept before them, stands within `apart` lines of under the same key (JN13).

    Of rows with one key and line only the first by ordinal can stay. Lines more than `apart` away from their neighbours can't meet, so runs of near lines are decided one by
    one: a run holds as many rows as it has lines, however many rows a key has. A null key or line never stays.
    """
    bin_ = lambda c, by=0: (F.floor(F.col(c) / (apart + 1)) + by).alias("_bin")
    first = new.where("key is not null and line is not null").groupBy("key", "line").agg(F.min("ordinal").alias("ordinal"))
    taken = base.select("key", F.col("line").alias("_line"), F.explode(F.array(*(bin_("line", i) for i in (-1, 0, 1)))).alias("_bin")).distinct()
    free = first.withColumn("_bin", bin_("line")).join(taken, ["key", "_bin"], "left").groupBy("key", "line", "ordinal").agg(F.coalesce(F.min(F.abs(F.col("line") - F.col("_line"))) <= apart, F.lit(False)).alias("_near")).where("not _near")
    by_line = Window.partitionBy("key").orderBy("line")
    gap = (F.col("line") - F.lag("line").over(by_line) > apart).cast("int")
    runs = free.withColumn("_gap", F.coalesce(gap, F.lit(0))).withColumn("_run", F.sum("_gap").over(by_line))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        lines: list[int] = []
        kept = []
        for row in own.sort_values("ordinal").itertuples():
            i = bisect_left(lines, row.line)
            if all(abs(lines[j] - row.line) > apart for j in (i - 1, i) if 0 <= j < len(lines)):
                lines.insert(i, row.line)
                kept.append(row.ordinal)
        return own.loc[own["ordinal"].isin(kept), ["key", "line", "ordinal"]]

    stay = runs.groupBy("key", "_run").applyInPandas(run, first.schema)
    return new.join(stay, ["key", "line", "ordinal"], "left_semi")


@query("jn13_kept_in_order", f"""WITH RECURSIVE c AS ({_COMMENTS_SQL}), k AS (SELECT id, line, path || '|' || category || '|' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS key FROM c),
f AS (SELECT * FROM k a WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM k b WHERE b.id % 2 = 0 AND a.key = b.key AND abs(a.line - b.line) <= 8)),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS n FROM f),
x AS (SELECT key, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept, false AS stays, CAST(NULL AS BIGINT) AS id FROM (SELECT DISTINCT key FROM n)
UNION ALL SELECT x.key, n.n, CASE WHEN len(list_filter(kept, lambda l: abs(l - n.line) <= 8)) = 0 THEN list_append(kept, CAST(n.line AS BIGINT)) ELSE kept END, len(list_filter(kept, lambda l: abs(l - n.line) <= 8)) = 0, CAST(n.id AS BIGINT) FROM x JOIN n ON n.key = x.key AND n.n = x.n + 1)
SELECT id FROM x WHERE stays""")
def jn13_kept(spark: SparkSession, d: str) -> DataFrame:
    """New comments in input order, without those near a base comment or one that was kept before."""
    c = comments(spark, d)
    keyed = c.select("id", F.col("id").alias("ordinal"), "line", T.semantic_key(F.col("path"), F.col("category"), F.col("title")).alias("key"))
    return kept_in_order(keyed.where("id % 2 = 1"), keyed.where("id % 2 = 0")).select("id")


def match_in_order(new: DataFrame, old: DataFrame) -> DataFrame:
    """id, matched and step of each new finding of a request (JN12), in input order: an exact key (1), the nearest line of the same hunk and
    category (2), the most alike by title, body, line, side and severity (3, as SF6), the nearest line of the same title (4).

    Each old finding is consumed by one new one, but an exact key doesn't ask whether it was. All four steps stay within a path, so a
    request's path is a group; in it every step looks old findings up by its own key. Of old findings with one key the first that is open counts, or the last if none is. Columns: request, path, id, ordinal, line,
    hunk, category, key, title_key, side, severity, tt and bt (tokens of title and body), and of old ones status (open without it).
    """

    def run(key: tuple, fresh: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        by: dict[tuple, list] = {}
        known = known.sort_values("id")
        # of equal keys the first open finding, or the last of all where none is open
        open_ = known["status"] == "open" if "status" in known else pd.Series(True, index=known.index)
        exact = known.groupby("key")["id"].last().to_dict() | known[open_].groupby("key")["id"].first().to_dict()
        for o in known.itertuples():
            by.setdefault((2, o.hunk, o.category), []).append(o)
            by.setdefault((4, o.title_key), []).append(o)
            for t in set(o.tt):
                by.setdefault((3, o.category, t), []).append(o)
        rows, used = [], set()
        likeness = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0

        def nearest(where: tuple, line: int) -> int | None:
            return min(((abs(o.line - line), o.id) for o in by.get(where, ()) if o.id not in used), default=(0, None))[1]

        def alike(row) -> int | None:
            titles, bodies, best = set(row.tt), set(row.bt), (0.5, 0)
            for o in {o.id: o for t in titles for o in by.get((3, row.category, t), ()) if o.id not in used}.values():
                title, gap = likeness(titles, set(o.tt)), abs(o.line - row.line)
                near = 1.0 if gap <= 2 else 0.9 if gap <= 6 else 0.75 if gap <= 12 else 0.55 if gap <= 25 else 0.3
                score = title * 0.64 + likeness(bodies, set(o.bt)) * 0.16 + near * 0.14 + (1 if o.side == row.side else 0.7) * 0.04 + (1 if o.severity == row.severity else 0.7) * 0.02
                if title >= 0.5 or title >= 0.34 and gap <= 8:
                    best = max(best, (score, -o.id))
            return -best[1] if best[1] else None

        for row in fresh.sort_values("ordinal").itertuples():
            found, step = exact.get(row.key), 1
            for step, look in ((2, lambda: nearest((2, row.hunk, row.category), row.line)), (3, lambda: alike(row)), (4, lambda: nearest((4, row.title_key), row.line))) if found is None else ():
                found = look()
                if found is not None:
                    break
            if found is not None:
                used.add(found)
            rows.append((key[0], row.id, found, step if found is not None else None))
        return pd.DataFrame(rows, columns=["request", "id", "matched", "step"]).astype({"matched": "Int64", "step": "Int32"})

    return new.groupBy("request", "path").cogroup(old.groupBy("request", "path")).applyInPandas(run, "request long, id long, matched long, step int")


@query("jn12_match_cascade")
def jn12(spark: SparkSession, d: str) -> DataFrame:
    c = comments(spark, d).select(
        (F.col("id") % 9).alias("request"), "path", "id", "ordinal", "line", F.floor(F.col("line") / 40).alias("hunk"), "category", F.concat_ws("|", "path", "title").alias("key"), T.semantic_key(F.col("path"), F.col("category"), F.col("title")).alias("title_key"),
        "side", "severity", T.title_tokens(F.col("title")).alias("tt"), T.title_tokens(F.col("body")).alias("bt"),
    )
    old = c.where("id % 2 = 0").select(*(F.col(x).alias(f"o_{x}") for x in c.columns)).toDF(*c.columns)
    return match_in_order(c.where("id % 2 = 1"), old.withColumn("status", F.when(F.col("id") % 3 == 0, "open").otherwise("fixed")))


def fixed_findings(open_: DataFrame, matched: DataFrame, incoming_keys: DataFrame, changed: list[str] | None, sha: int) -> DataFrame:
    """Open findings that count as fixed (CP14): not matched, not seen again by key, of another commit, and in a changed path if the review is incremental."""
    left = open_.join(matched, "finding_id", "left_anti")
    keyed = left.withColumn("key", T.semantic_key(F.col("path"), F.col("category"), F.col("title"))).join(incoming_keys, "key", "left_anti")
    other = keyed.where(F.coalesce(F.col("sha") != sha, F.lit(True)))
    return (other if changed is None else other.where(F.col("path").isin(changed))).select("finding_id", "path")


@query("cp14_fixed_findings", """WITH o AS (SELECT f.*, r.sha, path || '|' || category || '|' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS key FROM findings f LEFT JOIN runs r USING (run_id) WHERE f.status = 'open' AND f.repo_id = 2)
SELECT finding_id, path FROM o WHERE finding_id NOT IN (SELECT finding_id FROM findings WHERE line % 10 = 0) AND key NOT IN (SELECT path || '|' || category || '|' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) FROM findings WHERE repo_id = 2 AND line > 48) AND coalesce(sha <> 5, true) AND path IN ('src/m1/f1.ts', 'src/m2/f2.ts', 'src/m3/f15.ts', 'src/m5/f5.ts', 'src/m4/f40.ts')""")
def cp14(spark: SparkSession, d: str) -> DataFrame:
    from ..catalog import runs

    f = findings(spark, d)
    open_ = f.where("status = 'open' and repo_id = 2").join(runs(spark, d).select("run_id", "sha"), "run_id", "left")
    keys = f.where("repo_id = 2 and line > 48").select(T.semantic_key(F.col("path"), F.col("category"), F.col("title")).alias("key")).distinct()
    return fixed_findings(open_, f.where("line % 10 = 0").select("finding_id"), keys, ["src/m1/f1.ts", "src/m2/f2.ts", "src/m3/f15.ts", "src/m5/f5.ts", "src/m4/f40.ts"], 5)


def settled_findings(open_: DataFrame, matched: DataFrame, incoming: DataFrame, heads: DataFrame, diff_files: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """repo_id, finding_id, path, status of the open findings of all repositories that a review settles (CP14): obsolete if their path left the diff, else fixed.

    `matched` has finding_id; `incoming` repo_id, key; `heads` repo_id, head (the commit reviewed); `diff_files` and, for incremental reviews, `changed` repo_id, path.
    A finding last seen at the head stays open; one whose commit isn't known doesn't.
    """
    keyed = open_.join(matched.select("finding_id").distinct(), "finding_id", "left_anti").withColumn("key", T.semantic_key(F.col("path"), F.col("category"), F.col("title"))).join(incoming, ["repo_id", "key"], "left_anti")
    left = keyed.join(heads, "repo_id", "left").where(~(F.col("sha").isNotNull() & F.col("sha").eqNullSafe(F.col("head"))))
    if changed is not None:
        left = left.join(changed, ["repo_id", "path"], "left_semi")
    inside = diff_files.select("repo_id", "path").distinct().withColumn("_in", F.lit(True))
    return left.join(inside, ["repo_id", "path"], "left").select("repo_id", "finding_id", "path", F.when(F.col("_in"), "fixed").otherwise("obsolete").alias("status"))


@query("cp14_settled_findings", """WITH k AS (SELECT f.*, path || '|' || category || '|' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS key FROM findings f),
h AS (SELECT repo_id, arg_max(sha, run_id) AS head FROM runs GROUP BY repo_id)
SELECT k.repo_id, finding_id, path, CASE WHEN EXISTS (SELECT 1 FROM findings d WHERE d.repo_id = k.repo_id AND d.path = k.path AND d.severity = 'nit') THEN 'fixed' ELSE 'obsolete' END AS status
FROM k LEFT JOIN runs r USING (run_id) LEFT JOIN h ON h.repo_id = k.repo_id WHERE k.status = 'open' AND finding_id NOT IN (SELECT finding_id FROM findings WHERE line % 10 = 0)
AND NOT EXISTS (SELECT 1 FROM k i WHERE i.line > 48 AND i.repo_id = k.repo_id AND i.key = k.key) AND NOT (r.sha IS NOT NULL AND r.sha IS NOT DISTINCT FROM head)""")
def cp14_settled(spark: SparkSession, d: str) -> DataFrame:
    """What full reviews of all repositories settle."""
    from ..catalog import runs

    f, r = findings(spark, d), runs(spark, d)
    open_ = f.where("status = 'open'").join(r.select("run_id", "sha"), "run_id", "left")
    keys = f.where("line > 48").select("repo_id", T.semantic_key(F.col("path"), F.col("category"), F.col("title")).alias("key")).distinct()
    heads = r.groupBy("repo_id").agg(F.max_by("sha", "run_id").alias("head"))
    return settled_findings(open_, f.where("line % 10 = 0"), keys, heads, f.where("severity = 'nit'"))


def changed_lines(diffs: DataFrame, id: str = "id", patch: str = "patch") -> DataFrame:
    """id, path, line: lines that a unified diff changes on its new side (SF20). Deletions count from where they stood, one line on for each of a run.

    One row per line of the diff, and windows over a diff's lines: the path and the hunk in force, the new-side lines before, the run of deletions.
    """
    lines = diffs.select(id, F.posexplode(F.split(patch, "\n")).alias("n", "l"))
    at = Window.partitionBy(id).orderBy("n")
    target = F.when(F.col("l").startswith("+++ "), F.trim(F.substring(F.col("l"), 5, 1 << 30)))
    start = F.regexp_extract("l", r"^@@\s+-\d+(?:,\d+)?\s+\+(\d+)(?:,\d+)?\s+@@", 1)
    named = lines.withColumns({"target": target, "file": F.sum(F.col("l").startswith("+++ ").cast("int")).over(at), "hunk": F.sum(F.col("l").startswith("@@ ").cast("int")).over(at)})
    marked = named.withColumns({"target": F.last("target", True).over(at), "start": F.when(F.col("l").startswith("@@ ") & (start != ""), start)})
    in_hunk = Window.partitionBy(id, "file", "hunk").orderBy("n")
    # the hunk's first row carries its start; rows before a file's first hunk have none
    body = marked.withColumn("start", F.first("start").over(in_hunk).cast("int")).where("start is not null and target != '/dev/null' and target != ''")
    sign = F.substring("l", 1, 1)
    new = (sign.isin("+", " ") & ~F.col("l").startswith("+++")).cast("int")
    counted = body.withColumns({"sign": sign, "before": F.sum(new).over(in_hunk) - new, "past": F.sum(new).over(in_hunk), "gone": ((sign == "-") & ~F.col("l").startswith("---")).cast("int")})
    run = F.sum("gone").over(Window.partitionBy(id, "file", "hunk", "past").orderBy("n"))
    placed = counted.withColumn("line", F.when((F.col("sign") == "+") & ~F.col("l").startswith("+++"), F.col("start") + F.col("before")).when(F.col("gone") == 1, F.greatest(F.lit(1), F.col("start") + F.col("before") + run - 1)))
    path = F.regexp_replace(T.repo_path(F.col("target")), "^[ab]/", "")
    return placed.where("line > 0").select(id, path.alias("path"), F.col("line").cast("long").alias("line")).distinct()


_DIFF_SQL = """SELECT doc_id AS id, doc_id % 30 + 1 AS start, 'src/' || source || '.ts' AS path, list_transform(string_split_regex(text, '[\\n.]+'), lambda x: ['+', '-', ' '][length(x) % 3 + 1] || 'x' || x) AS ls FROM documents"""


@query("sf20_changed_lines", f"""WITH d AS ({_DIFF_SQL}), l AS (SELECT id, start, path, unnest(ls) AS l, generate_subscripts(ls, 1) AS n FROM d),
w AS (SELECT *, substr(l, 1, 1) AS s, sum(CASE WHEN substr(l, 1, 1) <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS past FROM l),
g AS (SELECT *, past - CASE WHEN s <> '-' THEN 1 ELSE 0 END AS before, sum(CASE WHEN s = '-' THEN 1 ELSE 0 END) OVER (PARTITION BY id, past ORDER BY n) AS run FROM w)
SELECT DISTINCT id, path, CAST(CASE WHEN s = '+' THEN start + before ELSE greatest(1, start + before + run - 1) END AS BIGINT) AS line FROM g WHERE s IN ('+', '-')""")
def sf20(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    body = F.transform(F.split("text", "[\n.]+"), lambda x: F.concat(F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(" ")), (F.length(x) % 3 + 1).cast("int")), F.lit("x"), x))
    patch = F.concat(F.lit("--- a/src/x\n+++ b/src/"), F.col("source"), F.lit(".ts\n@@ -1,5 +"), (F.col("doc_id") % 30 + 1).cast("string"), F.lit(",9 @@ f\n"), F.array_join(body, "\n"))
    return changed_lines(docs.select(F.col("doc_id").alias("id"), patch.alias("patch")))


@query("wn3_top_findings", "SELECT repo_id, finding_id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY line DESC, finding_id) AS r FROM (SELECT DISTINCT repo_id, finding_id, line FROM findings)) WHERE r <= 6")
def wn3(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).select("repo_id", "finding_id", "line").distinct()
    return top_per(f, ["repo_id"], [F.desc("line"), F.asc("finding_id")], 6).select("repo_id", "finding_id")
