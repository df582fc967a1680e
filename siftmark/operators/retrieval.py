"""Registered queries of ranked retrieval (CP1 to CP4, SF1, SF2, SF7 to SF12, TK1 to TK3, WN2, WN3, JN1, SF3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import table, units
from ..functions import text as T
from ..plans.retrieval import diversified_top, lexical_input, node_title, rank_fusion, scored_units
from ..registry import query
from .ranking import top_per

#: The query of the registered retrievals, and the paths that count as changed.
QUERY = "the anthor of thenan and src3/en erly for token des Les main.py read src1/fr/f1.txt"
CHANGED = ["src1/fr/f1.txt", "src2/en/f0.txt"]

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def _tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({x}), '[^a-z0-9_./-]+'), lambda t: length(t) >= 2 AND t NOT IN ({_STOP})))"


_TITLE = "trim(path || '  ' || substr(split_part(text, chr(10), 1), 1, 180))"
_INPUT = "path || ' ' || regexp_replace(path, '[._/-]+', ' ', 'g') || '  ' || substr(text, 1, 2200)"
_Q = QUERY.replace("'", "''")


def _overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / sqrt(len({a}) * len({b})) ELSE 0 END"


_SCORED = f"""q AS (SELECT {_tokens(f"'{_Q}'")} AS q),
t AS (SELECT id, path, dir, kind, is_pattern, {_tokens(_TITLE)} AS tt, {_tokens(_INPUT)} AS tx FROM units),
s AS (SELECT id, path, dir, kind, {_overlap('q', 'tt')} AS semantic, {_overlap('q', 'tx')} AS lexical,
  CASE WHEN path IN ('src1/fr/f1.txt', 'src2/en/f0.txt') THEN 0.16 WHEN dir IN ('src1/fr', 'src2/en') THEN 0.08 ELSE 0.0 END
  + CASE WHEN contains(lower(path), 'src3/en') OR contains(lower(path), 'main.py') OR contains(lower(path), 'src1/fr/f1.txt') THEN 0.04 ELSE 0.0 END AS path_boost,
  CASE WHEN is_pattern THEN 0.03 ELSE 0.0 END AS pattern_boost, CASE kind WHEN 'symbol' THEN 0.02 WHEN 'chunk' THEN 0.03 ELSE 0.0 END AS kind_boost FROM t, q),
b AS (SELECT *, semantic * 0.62 + lexical * 0.22 + path_boost + pattern_boost + kind_boost AS base, max(semantic * 0.66 + lexical * 0.34 + path_boost) OVER (PARTITION BY path) AS anchor,
  1 / (50 + row_number() OVER (ORDER BY semantic DESC, id DESC)) + 1 / (50 + row_number() OVER (ORDER BY lexical DESC, id DESC)) AS rrf FROM s),
u AS (SELECT DISTINCT anchor, dir, split_part(dir, '/', 1) AS top FROM b),
a AS (SELECT d, max(v) AS v FROM (SELECT dir AS d, anchor AS v FROM u UNION ALL SELECT top, anchor * 0.82 FROM u UNION ALL SELECT * FROM (VALUES ('src1/fr', 0.72), ('src2/en', 0.72), ('src1', 0.54), ('src2', 0.54))) GROUP BY d),
f AS (SELECT b.*, least(0.18, anchor * CASE kind WHEN 'file' THEN 0.07 WHEN 'symbol' THEN 0.15 ELSE 0.12 END) AS file_anchor,
  CASE WHEN dir IN ('src1/fr', 'src2/en') THEN 0.08 ELSE least(0.08, v * 0.12) END AS affinity FROM b JOIN a ON d = dir),
z AS (SELECT *, base + rrf * 0.08 + affinity + file_anchor AS score FROM f)"""

_TOP = """p AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, id DESC) AS r FROM z),
c AS (SELECT *, CASE WHEN r = 1 AND path IN ('src1/fr/f1.txt', 'src2/en/f0.txt') THEN 0 END AS anchor_phase FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY anchor_phase NULLS LAST, score DESC, id DESC) AS taken FROM c),
h AS (SELECT *, CAST(coalesce(anchor_phase, CASE WHEN taken <= 2 THEN 1 ELSE 2 END) AS INTEGER) AS phase FROM o)
SELECT id, path, kind, phase, round(score, 9) AS score, CAST(row_number() OVER (ORDER BY phase, score DESC, id DESC) AS INTEGER) AS place FROM h ORDER BY phase, score DESC, id DESC LIMIT 28"""


@query("cp1_hybrid_retrieval", f"WITH {_SCORED}, {_TOP}")
def cp1(spark: SparkSession, d: str) -> DataFrame:
    """The 28 best units for the query, two of a path at most before others (flagship)."""
    top = diversified_top(scored_units(units(spark, d), QUERY, CHANGED), 28, 2, CHANGED)
    return top.select("id", "path", "kind", "phase", F.round("score", 9).alias("score"), "place")


@query("cp1_all_scores", f"WITH {_SCORED} SELECT id, round(semantic, 9) AS semantic, round(lexical, 9) AS lexical, round(CAST(path_boost AS DOUBLE), 9) AS path_boost, round(rrf, 9) AS rrf, round(affinity, 9) AS affinity, round(file_anchor, 9) AS file_anchor, round(score, 9) AS score FROM z")
def cp1_all(spark: SparkSession, d: str) -> DataFrame:
    """All parts of every unit's score (CP1, CP2, CP3, CP4, SF11, JN1)."""
    parts = ["semantic", "lexical", "path_boost", "rrf", "affinity", "file_anchor", "score"]
    return scored_units(units(spark, d), QUERY, CHANGED).select("id", *(F.round(c, 9).alias(c) for c in parts))


@query("cp2_rank_fusion", """WITH s AS (SELECT doc_id AS id, (doc_id % 97) / 97 AS semantic, (n_chars % 1000) / 1000 AS lexical FROM documents)
SELECT id, round(1 / (50 + row_number() OVER (ORDER BY semantic DESC, id DESC)) + 1 / (50 + row_number() OVER (ORDER BY lexical DESC, id DESC)), 9) AS rrf FROM s""")
def cp2(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 97 / 97).alias("semantic"), (F.col("n_chars") % 1000 / 1000).alias("lexical"))
    return rank_fusion(scores).select("id", F.round("rrf", 9).alias("rrf"))


@query("tk3_score_cutoff", """WITH s AS (SELECT doc_id AS id, (doc_id * 37 % 101) / 101 AS semantic FROM documents), r AS (SELECT *, row_number() OVER (ORDER BY semantic DESC, id DESC) AS k FROM s)
SELECT id, round(CASE WHEN k <= 84 THEN semantic ELSE 0 END, 9) AS semantic FROM r""")
def tk3(spark: SparkSession, d: str) -> DataFrame:
    """A scorer reports its best 3k units only; all others score 0."""
    scores = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") * 37 % 101 / 101).alias("semantic"))
    kept = scores.orderBy(F.desc("semantic"), F.desc("id")).limit(max(4, min(200, 3 * 28))).select("id", F.lit(True).alias("kept"))
    return scores.join(F.broadcast(kept), "id", "left").select("id", F.round(F.when(F.col("kept"), F.col("semantic")).otherwise(0.0), 9).alias("semantic"))


@query("wn3_cap_per_path", "SELECT id, path FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY length(text) DESC, id) AS r FROM units) WHERE r <= 3")
def wn3(spark: SparkSession, d: str) -> DataFrame:
    """The three longest units of each path."""
    sized = units(spark, d).select("id", "path", F.length("text").alias("n"))
    return top_per(sized, ["path"], [F.desc("n"), F.asc("id")], 3).select("id", "path")


@query("sf1_search_tokens", f"SELECT doc_id, len({_tokens('text')}) AS n, list_aggregate(list_sort({_tokens('text')}), 'string_agg', ' ') AS tokens FROM documents")
def sf1(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id", F.sort_array(T.search_tokens(F.col("text"))).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n"), F.when(F.size("t") > 0, F.array_join("t", " ")).alias("tokens"))


@query("sf3_vector_cosine", "SELECT e.vec_id, round(CAST(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS DOUBLE), 6) AS cosine FROM embeddings e, embeddings q WHERE q.vec_id = 0")
def sf3(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of every vector with the first one, in doubles; 0 where a norm is 0."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    q = e.where("vec_id = 0").select(F.col("v").alias("q"))  # one row
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with("v", "q", lambda a, b: F.coalesce(a * b, F.lit(0.0))))
    norm = lambda c: F.sqrt(total(F.transform(c, lambda x: x * x)))
    scale = norm("v") * norm("q")
    return e.join(F.broadcast(q), F.lit(True)).select("vec_id", F.round(F.when(scale > 0, dot / scale).otherwise(0.0), 6).alias("cosine"))


@query("sf7_repo_paths", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(trim('./' || replace(split_part(url, '://', 2), '.', '\') || '//x '), '\', '/'), '^\./', ''), '^/', ''), '/+', '/', 'g') AS path FROM pages")
def sf7(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("./"), F.expr(r"replace(split_part(url, '://', 2), '.', '\\')"), F.lit("//x "))
    return table(spark, d, "pages").select("page_id", T.repo_path(raw).alias("path"))


_RAW_SQL = r"SELECT page_id, '/./' || replace(split_part(url, '://', 2), '.', '\') || '//x/./y///z' AS raw FROM pages"


@query("sf7_other_paths", rf"SELECT page_id, regexp_replace(regexp_replace(replace(raw, '\', '/'), '^\./', ''), '/+', '/', 'g') AS graph, replace(ltrim(replace(replace(trim(raw), '\', '/'), './', ''), '/'), '//', '/') AS structural FROM ({_RAW_SQL})")
def sf7_others(spark: SparkSession, d: str) -> DataFrame:
    """The other two forms of paths: the graph's and the structural scorer's."""
    raw = F.concat(F.lit("/./"), F.expr(r"replace(split_part(url, '://', 2), '.', '\\')"), F.lit("//x/./y///z"))
    return table(spark, d, "pages").select("page_id", T.graph_path(raw).alias("graph"), T.structural_path(raw).alias("structural"))


@query("sf37_weights", "SELECT l_orderkey, l_linenumber, least(1.0, greatest(0.0, CAST(CASE WHEN l_linenumber = 3 THEN 0.25 ELSE l_discount * 20 - 0.5 END AS DOUBLE))) AS weight FROM lineitem")
def sf37(spark: SparkSession, d: str) -> DataFrame:
    """Weights within [0, 1]; those that are no number take the default."""
    raw = F.when(F.col("l_linenumber") == 3, F.when(F.col("l_orderkey") % 2 == 0, float("nan")).otherwise(float("inf"))).otherwise(F.col("l_discount").cast("double") * 20 - 0.5)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.clean_weight(raw, 0.25).alias("weight"))


@query("tk11_bounded_ints", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 20 WHEN 1 THEN least(100, greatest(1, p_size - 10)) WHEN 2 THEN least(100, greatest(1, p_partkey)) ELSE 1 END AS n FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)")
def tk11(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of requests as texts, within 1 and 100, 20 where they are none."""
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, F.concat("p_name", F.lit(" x"))).when(k % 4 == 1, F.concat((F.col("p_size") - 10).cast("string"), F.lit(".9"))).when(k % 4 == 2, k.cast("string")).otherwise("-3.5")
    return table(spark, d, "part").select("p_partkey", T.bounded_int(text, 20, 1, 100).alias("n"))


@query("sf8_ancestors", "WITH p AS (SELECT page_id, split_part(split_part(url, '://', 2), '?', 1) AS p FROM pages), d AS (SELECT page_id, p, string_split(p, '/') AS parts FROM p) SELECT page_id, CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '' END AS dir, CASE WHEN len(parts) > 1 THEN array_to_string(list_transform(range(len(parts) - 1, 0, -1), lambda n: array_to_string(parts[1:n], '/')), ' ') ELSE '' END AS chain FROM d")
def sf8(spark: SparkSession, d: str) -> DataFrame:
    p = F.expr("split_part(split_part(url, '://', 2), '?', 1)")
    return table(spark, d, "pages").select("page_id", T.directory(p).alias("dir"), F.array_join(T.ancestors(p), " ").alias("chain"))


@query("sf9_modules", "SELECT CASE WHEN contains(p, '/') THEN split_part(p, '/', 1) ELSE '(root)' END AS module, count(*) AS n FROM (SELECT CASE WHEN page_id % 5 = 0 THEN 'main.ts' ELSE split_part(url, '://', 2) END AS p FROM pages) GROUP BY 1")
def sf9(spark: SparkSession, d: str) -> DataFrame:
    p = F.expr("if(page_id % 5 = 0, 'main.ts', split_part(url, '://', 2))")
    return table(spark, d, "pages").groupBy(T.module_of(p).alias("module")).agg(F.count("*").alias("n"))


@query("sf10_path_hints", r"SELECT page_id, array_to_string(h[1:8], ' ') AS hints FROM (SELECT page_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS h FROM (SELECT page_id, list_filter(list_transform(string_split_regex(lower(url || ' see ' || url || ' a.b it ./x'), '\s+'), lambda t: regexp_replace(t, '[^a-z0-9_./-]', '', 'g')), lambda t: (contains(t, '/') OR contains(t, '.')) AND length(t) >= 3) AS w FROM pages))")
def sf10(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.col("url"), F.lit(" see "), F.col("url"), F.lit(" a.b it ./x"))
    return table(spark, d, "pages").select("page_id", F.array_join(T.path_hints(said), " ").alias("hints"))


@query("sf12_unit_inputs", f"SELECT id, sha256({_TITLE}) AS title, sha256({_INPUT}) AS input FROM units")
def sf12(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d)
    return u.select("id", F.sha2(node_title(u["path"], u["text"]), 256).alias("title"), F.sha2(lexical_input(u["path"], u["text"]), 256).alias("input"))


@query("jn1_unit_dimensions", "SELECT id, path, is_pattern, label FROM units LEFT JOIN embeddings ON vec_id = id")
def jn1(spark: SparkSession, d: str) -> DataFrame:
    """Units with an attribute of a dimension, null where it has none."""
    return units(spark, d).select("id", "path", "is_pattern").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id", "left")


@query("tk1_diversified_top", """WITH s AS (SELECT id, path, length(text) % 1000 + id / 100000 AS score FROM units), p AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, id DESC) AS r FROM s),
a AS (SELECT id FROM p WHERE r = 1 AND path IN ('src1/fr/f1.txt', 'src2/en/f0.txt', 'src3/en/f2.txt') ORDER BY score DESC, id DESC LIMIT 4), c AS (SELECT p.*, CASE WHEN a.id IS NOT NULL THEN 0 END AS anchored FROM p LEFT JOIN a USING (id)),
o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY anchored NULLS LAST, score DESC, id DESC) AS taken FROM c), h AS (SELECT *, CAST(coalesce(anchored, CASE WHEN taken <= 1 THEN 1 ELSE 2 END) AS INTEGER) AS phase FROM o)
SELECT id, path, phase, CAST(row_number() OVER (ORDER BY phase, score DESC, id DESC) AS INTEGER) AS place FROM h ORDER BY phase, score DESC, id DESC LIMIT 12""")
def tk1(spark: SparkSession, d: str) -> DataFrame:
    """The twelve best units by a score, one of a path before others, with changed paths in front."""
    scored = units(spark, d).select("id", "path", (F.length("text") % 1000 + F.col("id") / 100000).alias("score"))
    return diversified_top(scored, 12, 1, ["src1/fr/f1.txt", "src2/en/f0.txt", "src3/en/f2.txt"]).select("id", "path", "phase", "place")
