"""Graph building and joins on intervals and names (JN6 to JN11, AG15 to AG17, CP6, CP7's set-based form, SF18, SF19).

Interval joins are equi-joins on the file and a bin of its lines, with a range condition: a span stands in each bin that it
touches, a point in its own, so a file's points meet the spans nearby only. The nearest one is taken by min, which combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import deps, graph_edges, graph_nodes, table
from ..plans.traversal import FACTORS, reachable, traversal_steps
from ..registry import query

_SYMBOLS_SQL = """SELECT o_custkey AS file, o_orderkey AS symbol, o_orderkey % 200 AS first, o_orderkey % 200 + CAST(floor(o_totalprice / 10000) AS BIGINT) AS last, 's' || (o_orderkey % 6000) AS name FROM orders"""
_REFS_SQL = """SELECT l_suppkey * 3 AS file, l_linenumber * 17 + l_partkey % 100 AS line, 'app.mod.s' || (l_partkey % 500) || '()' AS raw, l_orderkey AS ref, l_partkey, l_linenumber FROM lineitem"""


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of files with their range of lines."""
    key = F.col("o_orderkey")
    first = key % 200
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("file"), key.alias("symbol"), first.alias("first"), (first + F.floor(F.col("o_totalprice") / 10000).cast("long")).alias("last"), F.expr("concat('s', o_orderkey % 6000)").alias("name")
    )


def references(spark: SparkSession, d: str) -> DataFrame:
    """Places in files that name a symbol."""
    return table(spark, d, "lineitem").select((F.col("l_suppkey") * 3).alias("file"), F.expr("l_linenumber * 17 + l_partkey % 100").alias("line"), F.expr("concat('app.mod.s', l_partkey % 500, '()')").alias("raw"), F.col("l_orderkey").alias("ref"), "l_partkey", "l_linenumber")


def reference_name(raw: str) -> Column:
    """The last segment after dots or double colons, without other than word characters (SF19)."""
    last = F.element_at(F.split(F.element_at(F.split(F.col(raw), r"\."), -1), "::"), -1)
    return F.regexp_replace(last, r"[^A-Za-z0-9_]", "")


#: Lines of a bin in interval joins.
BIN = 64


def binned(spans: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """The spans, once for each bin of lines that they touch, with `bin`."""
    return spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col(first) / BIN), F.floor(F.col(last) / BIN))))


def smallest_span(points: DataFrame, spans: DataFrame, on: str, point: str, keys: list[str]) -> DataFrame:
    """For each point the narrowest span of the same group that holds it (JN6); ties go to the smaller symbol, points outside get none."""
    inside = points.withColumn("bin", F.floor(F.col(point) / BIN)).join(binned(spans), [on, "bin"]).where(F.col(point).between(F.col("first"), F.col("last")))
    owner = F.min(F.struct((F.col("last") - F.col("first")).alias("span"), "symbol")).alias("best")
    return inside.groupBy(*keys).agg(owner).select(*keys, F.col("best.symbol").alias("owner"), F.col("best.span").alias("span"))


@query("jn6_reference_owner", f"""WITH s AS ({_SYMBOLS_SQL}), r AS (SELECT DISTINCT file, line FROM ({_REFS_SQL})),
j AS (SELECT r.file, line, symbol, last - first AS span, row_number() OVER (PARTITION BY r.file, line ORDER BY last - first, symbol) AS k FROM r JOIN s ON r.file = s.file AND line BETWEEN first AND last) SELECT file, line, symbol AS owner, span FROM j WHERE k = 1""")
def jn6(spark: SparkSession, d: str) -> DataFrame:
    places = references(spark, d).select("file", "line").distinct()
    return smallest_span(places, symbols(spark, d).select("file", "symbol", "first", "last"), "file", "line", ["file", "line"])


@query("jn7_containing_symbol", f"""WITH s AS ({_SYMBOLS_SQL}), j AS (SELECT a.file, a.symbol, b.symbol AS parent, row_number() OVER (PARTITION BY a.symbol ORDER BY b.last - b.first, b.symbol) AS k FROM s a JOIN s b ON a.file = b.file AND a.symbol <> b.symbol AND b.first <= a.first AND a.last <= b.last) SELECT file, symbol, parent FROM j WHERE k = 1""")
def jn7(spark: SparkSession, d: str) -> DataFrame:
    """The narrowest other symbol of a file that holds a symbol's whole range; equal ranges hold each other."""
    s = symbols(spark, d)
    outer = s.select("file", F.col("symbol").alias("parent"), F.col("first").alias("p_first"), F.col("last").alias("p_last"))
    held = s.withColumn("bin", F.floor(F.col("first") / BIN)).join(binned(outer, "p_first", "p_last"), ["file", "bin"]).where((F.col("symbol") != F.col("parent")) & (F.col("p_first") <= F.col("first")) & (F.col("last") <= F.col("p_last")))
    best = F.min(F.struct((F.col("p_last") - F.col("p_first")).alias("span"), "parent"))
    return held.groupBy("file", "symbol").agg(best.alias("b")).select("file", "symbol", F.col("b.parent").alias("parent"))


@query("jn8_reference_targets", f"""WITH s AS ({_SYMBOLS_SQL}), n AS (SELECT name, count(*) AS c FROM s GROUP BY name), r AS (SELECT file, line, regexp_replace(split_part(raw, '.', -1), '[^A-Za-z0-9_]', '', 'g') AS name FROM ({_REFS_SQL}))
SELECT r.file, s.file AS target_file, r.name, count(*) AS refs FROM r JOIN n USING (name) JOIN s ON s.name = r.name WHERE c <= 3 AND r.file <> s.file GROUP BY ALL""")
def jn8(spark: SparkSession, d: str) -> DataFrame:
    """Names resolved to symbols of other files; a name with more than three targets is left out."""
    s = symbols(spark, d)
    few = s.groupBy("name").agg(F.count("*").alias("c")).where("c <= 3").select("name")
    targets = s.join(few, "name").select("name", F.col("file").alias("target_file"))
    named = references(spark, d).select("file", reference_name("raw").alias("name"))
    return named.join(targets, "name").where("file != target_file").groupBy("file", "target_file", "name").agg(F.count("*").alias("refs"))


@query("jn9_import_candidates", """WITH p AS (SELECT DISTINCT 'src/m' || (l_partkey % 12) || '/f' || (l_partkey % 97) || CASE WHEN l_partkey % 2 = 0 THEN '.ts' ELSE '/index.ts' END AS path FROM lineitem),
s AS (SELECT ps_id, unnest(list_transform(range(4), lambda i: {'pos': i, 'path': base || ['.ts', '.tsx', '/index.ts', '/index.js'][i + 1]})) AS c FROM (SELECT p_partkey AS ps_id, 'src/m' || (p_partkey % 12) || '/f' || (p_partkey % 120) AS base FROM part))
SELECT ps_id AS spec, arg_min(p.path, c.pos) AS resolved FROM s JOIN p ON p.path = c.path GROUP BY ps_id""")
def jn9(spark: SparkSession, d: str) -> DataFrame:
    """An import goes to the first of its candidate paths that exists."""
    k = F.col("l_partkey")
    paths = table(spark, d, "lineitem").select(F.concat(F.lit("src/m"), k % 12, F.lit("/f"), k % 97, F.when(k % 2 == 0, ".ts").otherwise("/index.ts")).alias("path")).distinct()
    base = F.concat(F.lit("src/m"), F.col("p_partkey") % 12, F.lit("/f"), F.col("p_partkey") % 120)
    ends = F.transform(F.array(*map(F.lit, [".ts", ".tsx", "/index.ts", "/index.js"])), lambda e: F.concat(base, e))
    tried = table(spark, d, "part").select(F.col("p_partkey").alias("spec"), F.posexplode(ends).alias("pos", "path"))
    return tried.join(paths, "path").groupBy("spec").agg(F.min_by("path", "pos").alias("resolved"))


@query("jn10_induced_edges", "SELECT from_id, to_id, count(*) AS n FROM deps WHERE from_id % 3 = 0 AND to_id IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0) GROUP BY ALL")
def jn10(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose ends are both among the nodes: two semi-joins."""
    nodes = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("from_id"))
    held = deps(spark, d).join(nodes, "from_id", "left_semi").join(nodes.withColumnRenamed("from_id", "to_id"), "to_id", "left_semi")
    return held.groupBy("from_id", "to_id").agg(F.count("*").alias("n"))


@query("jn11_stale_rows", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn11(spark: SparkSession, d: str) -> DataFrame:
    """Indexed rows that are no longer kept."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


def weighted_edges(raw: DataFrame, examples: int = 5) -> DataFrame:
    """Edges by (from_id, to_id, type) with their weight and the first distinct examples; self-loops go (AG16)."""
    first = raw.where("from_id != to_id").groupBy("from_id", "to_id", "type", "example").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    # examples are distinct here; a group's list holds each once
    ordered = F.array_sort(F.collect_list(F.struct("pos", "example")))
    return first.groupBy("from_id", "to_id", "type").agg(F.sum("n").alias("weight"), F.array_join(F.slice(ordered, 1, examples)["example"], ",").alias("examples"))


_EDGES_SQL = """e AS (SELECT from_id, to_id, type, example, count(*) AS n, min(pos) AS pos FROM deps WHERE from_id <> to_id GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY from_id, to_id, type ORDER BY pos, example) AS r FROM e),
w AS (SELECT from_id, to_id, type, CAST(sum(n) AS BIGINT) AS weight, string_agg(example, ',' ORDER BY r) FILTER (WHERE r <= 5) AS examples FROM k GROUP BY ALL)"""


@query("ag16_weighted_edges", f"WITH {_EDGES_SQL} SELECT * FROM w")
def ag16(spark: SparkSession, d: str) -> DataFrame:
    return weighted_edges(deps(spark, d))


def promote_edges(edges: DataFrame, kind: str, direct: str, least: int = 2) -> DataFrame:
    """Edges of `kind` with at least `least` references and no direct edge become `direct` edges (AG17)."""
    strong = edges.where((F.col("type") == kind) & (F.col("weight") >= least)).select("from_id", "to_id", "weight")
    known = edges.where(F.col("type") == direct).select("from_id", "to_id")
    return strong.join(known, ["from_id", "to_id"], "left_anti").select("from_id", "to_id", F.lit(direct).alias("type"), "weight")


@query("ag17_promoted_edges", f"WITH {_EDGES_SQL} SELECT from_id, to_id, 'file_dep' AS type, weight FROM w a WHERE type = 'references_symbol' AND weight >= 2 AND NOT EXISTS (SELECT 1 FROM w b WHERE b.type = 'file_dep' AND a.from_id = b.from_id AND a.to_id = b.to_id)")
def ag17(spark: SparkSession, d: str) -> DataFrame:
    return promote_edges(weighted_edges(deps(spark, d)), "references_symbol", "file_dep")


def best_connected(nodes: DataFrame, edges: DataFrame, n: int = 300) -> DataFrame:
    """The n nodes with the highest degree: id, in_degree, out_degree (AG15). Ties go to the smaller id."""
    out = edges.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("in_degree"))
    degrees = nodes.join(out, "id", "left").join(into, "id", "left").fillna(0, ["out_degree", "in_degree"])
    return degrees.orderBy(F.desc(F.col("in_degree") + F.col("out_degree")), "id").limit(n)


@query("ag15_best_connected", f"""WITH {_EDGES_SQL}, o AS (SELECT from_id AS id, count(*) AS out_degree FROM w GROUP BY 1), i AS (SELECT to_id AS id, count(*) AS in_degree FROM w GROUP BY 1),
n AS (SELECT s_suppkey AS id, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree FROM supplier LEFT JOIN o ON o.id = s_suppkey LEFT JOIN i ON i.id = s_suppkey)
SELECT id, in_degree, out_degree FROM n ORDER BY in_degree + out_degree DESC, id LIMIT 30""")
def ag15(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return best_connected(nodes, weighted_edges(deps(spark, d)), 30).select("id", "in_degree", "out_degree")


@query("cp6_containment_edges", """WITH f AS (SELECT source, lang, source || '/' || lang || '/f' || (doc_id % 50) || '.txt' AS path FROM documents), p AS (SELECT DISTINCT source, lang, path FROM f)
SELECT 'dir_contains_dir' AS type, source AS from_key, source || '/' || lang AS to_key, count(*) AS weight FROM p GROUP BY ALL
UNION ALL SELECT 'dir_contains_file', source || '/' || lang, path, 1 FROM p UNION ALL SELECT 'module_contains', source, path, 1 FROM p""")
def cp6(spark: SparkSession, d: str) -> DataFrame:
    """Containment edges of files: each file counts for every directory step above it, so a step's weight is the files below."""
    path = F.concat_ws("/", "source", "lang", F.expr("concat('f', doc_id % 50, '.txt')"))
    files = table(spark, d, "documents").select("source", "lang", path.alias("path")).distinct()
    dir_ = F.concat_ws("/", "source", "lang")
    edge = lambda kind, a, b: F.struct(F.lit(kind).alias("type"), a.alias("from_key"), b.alias("to_key"))
    edges = F.array(edge("dir_contains_dir", F.col("source"), dir_), edge("dir_contains_file", dir_, F.col("path")), edge("module_contains", F.col("source"), F.col("path")))
    return files.select(F.explode(edges).alias("e")).groupBy("e.type", "e.from_key", "e.to_key").agg(F.count("*").alias("weight"))


@query("cp6_module_dependencies", "SELECT 'm' || (from_id % 12) AS from_module, 'm' || (to_id % 12) AS to_module, count(*) AS weight FROM deps WHERE from_id % 12 <> to_id % 12 GROUP BY ALL")
def cp6_modules(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies between modules, without those within one."""
    e = deps(spark, d).where("from_id % 12 != to_id % 12")
    return e.groupBy(F.expr("concat('m', from_id % 12)").alias("from_module"), F.expr("concat('m', to_id % 12)").alias("to_module")).agg(F.count("*").alias("weight"))


_FACTORS_SQL = ", ".join(f"('{kind}', '{way}', {share})" for (kind, way), share in FACTORS.items())
_STEPS_SQL = f"""w AS (SELECT repo, from_id AS id, to_id AS next, type, 'out' AS way, weight FROM graph_edges UNION ALL SELECT repo, to_id, from_id, type, 'in', weight FROM graph_edges),
t AS (SELECT w.*, share * least(1.28, 1 + log10(greatest(1, weight)) * 0.22) AS factor, ['file', 'symbol', 'file', 'directory', 'module'][next % 5 + 1] AS next_type FROM w JOIN (VALUES {_FACTORS_SQL}) v(type, way, share) USING (type, way)),
k AS (SELECT *, row_number() OVER (PARTITION BY repo, id, type, way, next_type ORDER BY factor DESC, next) AS r FROM t),
f AS (SELECT repo, id, next, max(factor) AS factor FROM k WHERE r <= CASE WHEN type IN ('file_dep', 'module_dep', 'symbol_imports_file', 'exports_symbol', 'references_symbol') THEN 8 WHEN type IN ('dir_contains_file', 'dir_contains_dir', 'module_contains') THEN 2 ELSE 4 END GROUP BY ALL)"""
_LEVELS_SQL = ", ".join(f"x{i} AS (SELECT repo, f.next AS id, max(score * factor) AS score, {i} AS depth FROM x{i - 1} JOIN f USING (repo, id) WHERE score * factor >= 0.07 GROUP BY ALL)" for i in (1, 2, 3))


@query("cp7_set_traversal", f"""WITH {_STEPS_SQL}, x0 AS (SELECT unnest(range(7)) AS repo, unnest(range(7)) AS id, CAST(1.0 AS DOUBLE) AS score, 0 AS depth), {_LEVELS_SQL}
SELECT repo, id, round(max(score), 9) AS score, min(depth) AS depth FROM (SELECT * FROM x0 UNION ALL SELECT * FROM x1 UNION ALL SELECT * FROM x2 UNION ALL SELECT * FROM x3) GROUP BY repo, id""")
def cp7_sets(spark: SparkSession, d: str) -> DataFrame:
    """The best score of all nodes within three steps of a seed, in every repository."""
    steps = traversal_steps(graph_edges(spark, d), graph_nodes(spark, d))
    seeds = spark.range(7).select(F.col("id").alias("repo"), "id", F.lit(1.0).alias("score"))
    return reachable(steps, seeds).select("repo", "id", F.round("score", 9).alias("score"), "depth")


@query("sf18_import_roots", r"""SELECT spec, CASE WHEN clean LIKE '.%' OR clean LIKE '/%' THEN NULL WHEN clean LIKE '@%' THEN split_part(clean, '/', 1) || '/' || split_part(clean, '/', 2) ELSE split_part(clean, '/', 1) END AS root
FROM (SELECT spec, regexp_replace(regexp_replace(spec, '[?#].*$', ''), '^node:', '') AS clean FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN '@s' || p_size || '/' || p_brand || '/x?raw' WHEN 1 THEN './' || p_name WHEN 2 THEN 'node:' || p_type ELSE p_name || '/lib#a' END AS spec FROM part))""")
def sf18(spark: SparkSession, d: str) -> DataFrame:
    """The package of an import: null for a relative one, two segments for a scoped one."""
    k = F.col("p_partkey") % 4
    spec = F.when(k == 0, F.expr("concat('@s', p_size, '/', p_brand, '/x?raw')")).when(k == 1, F.expr("concat('./', p_name)")).when(k == 2, F.expr("concat('node:', p_type)")).otherwise(F.expr("concat(p_name, '/lib#a')"))
    clean = F.regexp_replace(F.regexp_replace(F.col("spec"), "[?#].*$", ""), "^node:", "")
    root = F.when(clean.startswith(".") | clean.startswith("/"), None).when(clean.startswith("@"), F.substring_index(clean, "/", 2)).otherwise(F.substring_index(clean, "/", 1))
    return table(spark, d, "part").select(spec.alias("spec")).select("spec", root.alias("root"))


@query("sf19_reference_names", f"SELECT regexp_replace(split_part(raw, '.', -1), '[^A-Za-z0-9_]', '', 'g') AS name, count(*) AS n FROM ({_REFS_SQL}) GROUP BY 1")
def sf19(spark: SparkSession, d: str) -> DataFrame:
    return references(spark, d).groupBy(reference_name("raw").alias("name")).agg(F.count("*").alias("n"))


@query("tk8_search_matches", "SELECT p_name, CAST(sum(CASE WHEN contains(p_name, 'red') THEN 2 ELSE 1 END) AS BIGINT) AS score FROM part WHERE contains(p_name, 'r') GROUP BY p_name ORDER BY score DESC, p_name LIMIT 20")
def tk8(spark: SparkSession, d: str) -> DataFrame:
    """Search matches by score, then name; the first 20."""
    hit = table(spark, d, "part").where(F.col("p_name").contains("r"))
    scores = hit.groupBy("p_name").agg(F.sum(F.when(F.col("p_name").contains("red"), 2).otherwise(1)).alias("score"))
    return scores.orderBy(F.desc("score"), "p_name").limit(20)


@query("tk9_directory_page", "SELECT name, n, (SELECT count(DISTINCT s_name) FROM supplier) > 9 + 15 AS more FROM (SELECT s_name AS name, count(*) AS n FROM supplier GROUP BY 1) ORDER BY name LIMIT 15 OFFSET 9")
def tk9(spark: SparkSession, d: str) -> DataFrame:
    """A page of a sorted listing from its tenth entry, and whether more follow."""
    names = table(spark, d, "supplier").groupBy(F.col("s_name").alias("name")).agg(F.count("*").alias("n"))
    more = names.agg((F.count("*") > 9 + 15).alias("more"))  # one row
    return names.orderBy("name").offset(9).limit(15).join(F.broadcast(more), F.lit(True))


@query("jn2_feedback_findings", """WITH m AS (SELECT s_suppkey AS provider, s_suppkey + 500 AS comment FROM supplier WHERE s_suppkey % 2 = 0), g AS (SELECT n AS comment, 'c' || (n % 6) AS category FROM range(0, 700) t(n))
SELECT category, count(*) AS n FROM (SELECT coalesce(m.comment, f.finding_no) AS comment FROM feedback f LEFT JOIN m ON f.finding_no = m.provider) JOIN g USING (comment) GROUP BY category""")
def jn2(spark: SparkSession, d: str) -> DataFrame:
    """Feedback to findings by the mapped comment id, or by its own where none is mapped."""
    mapped = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("finding_no"), (F.col("s_suppkey") + 500).alias("mapped"))
    known = spark.range(700).select(F.col("id").alias("comment"), F.expr("concat('c', id % 6)").alias("category"))
    votes = table(spark, d, "events").select(F.col("user_id").alias("finding_no")).join(mapped, "finding_no", "left")
    return votes.select(F.coalesce("mapped", "finding_no").alias("comment")).join(known, "comment").groupBy("category").agg(F.count("*").alias("n"))


@query("jn3_feedback_by_provider", "SELECT s_nationkey, count(*) AS n FROM feedback JOIN supplier ON s_suppkey = finding_no GROUP BY s_nationkey")
def jn3(spark: SparkSession, d: str) -> DataFrame:
    """Feedback to findings by the provider's id alone."""
    votes = table(spark, d, "events").select(F.col("user_id").alias("s_suppkey"))
    return votes.join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey").groupBy("s_nationkey").agg(F.count("*").alias("n"))


@query("jn4_stale_threads", """SELECT d.doc_id, l.quality, v.label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings v ON v.vec_id = d.doc_id WHERE coalesce(l.quality, -1) < d.doc_id % 3 AND coalesce(v.label, -1) < d.doc_id % 5""")
def jn4(spark: SparkSession, d: str) -> DataFrame:
    """Threads whose output and job are older than their last change, or missing."""
    docs = table(spark, d, "documents").select("doc_id")
    joined = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "left")
    return joined.where((F.coalesce("quality", F.lit(-1)) < F.col("doc_id") % 3) & (F.coalesce("label", F.lit(-1)) < F.col("doc_id") % 5))


@query("jn5_memory_outputs", "SELECT l.doc_id, coalesce(d.source, '') AS cwd FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.doc_id % 2 = 0 WHERE l.quality = 1 ORDER BY l.doc_id DESC LIMIT 50")
def jn5(spark: SparkSession, d: str) -> DataFrame:
    """The newest outputs with their thread's folder, empty where the thread is gone."""
    newest = table(spark, d, "labels").where("quality = 1").select("doc_id").orderBy(F.desc("doc_id")).limit(50)
    docs = table(spark, d, "documents").where("doc_id % 2 = 0").select("doc_id", "source")
    return newest.join(docs, "doc_id", "left").select("doc_id", F.coalesce("source", F.lit("")).alias("cwd"))


@query("jn14_previous_run", "WITH r AS (SELECT pr_id, max(run_id) AS latest, arg_max(sha, run_id) AS sha FROM runs GROUP BY pr_id) SELECT r.pr_id, latest, max(p.run_id) AS previous FROM r LEFT JOIN runs p ON p.pr_id = r.pr_id AND p.status = 'completed' AND p.sha <> r.sha GROUP BY ALL")
def jn14(spark: SparkSession, d: str) -> DataFrame:
    """The latest run of a request, and the latest completed one of another commit."""
    from ..catalog import runs

    r = runs(spark, d)
    latest = r.groupBy("pr_id").agg(F.max("run_id").alias("latest"), F.max_by("sha", "run_id").alias("head"))
    done = r.where("status = 'completed'").groupBy("pr_id", "sha").agg(F.max("run_id").alias("run_id"))
    other = latest.join(done, "pr_id", "left").groupBy("pr_id", "latest")
    return other.agg(F.max(F.when(F.col("sha") != F.col("head"), F.col("run_id"))).alias("previous"))


@query("jn15_backfill", "SELECT c_custkey, c_nationkey, n_name, r_name, 'github' AS provider FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def jn15(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a new table from a chain of joins and a constant key. The dimensions hold fixed numbers of nations and regions."""
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return table(spark, d, "customer").join(nations, "c_nationkey").select("c_custkey", "c_nationkey", "n_name", "r_name", F.lit("github").alias("provider"))


@query("jn16_repo_overview", """WITH c AS (SELECT o_custkey, count(*) AS orders, max(o_orderkey) AS latest FROM orders GROUP BY 1), f AS (SELECT o_custkey, count(*) AS items FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT c_custkey, coalesce(orders, 0) AS orders, coalesce(items, 0) AS items, o_orderstatus AS last_status FROM customer LEFT JOIN c ON c.o_custkey = c_custkey LEFT JOIN f ON f.o_custkey = c_custkey LEFT JOIN orders o ON o.o_orderkey = latest""")
def jn16(spark: SparkSession, d: str) -> DataFrame:
    """Repositories with counts of their children and the status of the latest one; both children are counted before the join."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    per_order = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("items"))
    counts = orders.join(per_order, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum(F.coalesce("items", F.lit(0))).alias("items"), F.max_by("o_orderstatus", "o_orderkey").alias("last_status"))
    return table(spark, d, "customer").select("c_custkey").join(counts, "c_custkey", "left").fillna(0, ["orders", "items"])


@query("wn6_line_context", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT doc_id, CAST(n AS INTEGER) AS n, sha256(string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS context FROM l""")
def wn6(spark: SparkSession, d: str) -> DataFrame:
    """Each line's hash with up to three lines on either side."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    near = Window.partitionBy("doc_id").orderBy("n").rowsBetween(-3, 3)
    return lines.select("doc_id", (F.col("n") + 1).alias("n"), F.sha2(F.array_join(F.collect_list("line").over(near), "\n"), 256).alias("context"))


@query("sf34_diagram_lines", f"""WITH {_EDGES_SQL}, n AS (SELECT id FROM (SELECT from_id AS id, weight FROM w UNION ALL SELECT to_id, weight FROM w) GROUP BY id ORDER BY sum(weight) DESC, id LIMIT 18)
SELECT '  n' || from_id || ' --> n' || to_id || CASE WHEN type = 'file_dep' THEN '' ELSE ' %% refs' END AS line FROM w WHERE from_id IN (SELECT id FROM n) AND to_id IN (SELECT id FROM n) ORDER BY weight DESC, from_id, to_id, type LIMIT 24""")
def sf34(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a diagram: the 24 heaviest edges among the 18 heaviest nodes."""
    e = weighted_edges(deps(spark, d))
    ends = e.select(F.explode(F.array("from_id", "to_id")).alias("id"), "weight")
    nodes = ends.groupBy("id").agg(F.sum("weight").alias("total")).orderBy(F.desc("total"), "id").limit(18).select("id")  # 18 rows
    among = e.join(F.broadcast(nodes.withColumnRenamed("id", "from_id")), "from_id", "left_semi").join(F.broadcast(nodes.withColumnRenamed("id", "to_id")), "to_id", "left_semi")
    top = among.orderBy(F.desc("weight"), "from_id", "to_id", "type").limit(24)
    return top.select(F.concat(F.lit("  n"), "from_id", F.lit(" --> n"), "to_id", F.when(F.col("type") == "file_dep", "").otherwise(" %% refs")).alias("line"))
