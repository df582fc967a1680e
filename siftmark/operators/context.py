"""Registered queries of traversal, context fusion and text search (CP5, CP7, CP8, CP16, CP17, TK12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import findings, graph_edges, graph_nodes, table, units
from ..functions import text as T
from ..plans import bm25 as index
from ..plans.headings import heading_sections
from ..plans.stored import stored
from ..plans.traversal import best_first, fuse_context
from ..plans.retrieval import Weights
from ..registry import query
from ..sources.files import shared_folder
from .retrieval import CHANGED, _overlap, _tokens


def _traversed(spark: SparkSession, d: str) -> DataFrame:
    seeds = spark.range(7).select(F.col("id").alias("repo"), "id", F.lit(1.0).alias("score"))
    return best_first(graph_edges(spark, d), graph_nodes(spark, d), seeds)


@query("cp7_best_first")
def cp7(spark: SparkSession, d: str) -> DataFrame:
    """Traversal of every repository's graph from a seed."""
    return _traversed(spark, d).select("repo", "id", F.round("score", 9).alias("score"), "depth", F.array_join("via", "; ").alias("via"), "visited", "followed", "cut")


# Fixed values of the fusion are spelt out here once more, apart from the plan's.
@query("cp8_context_fusion", """WITH ch AS (SELECT DISTINCT repo_id AS repo, path FROM findings WHERE line = 50 AND ordinal = 7 AND starts_with(path, 'src/m1/')),
sz AS (SELECT repo, count(*) AS n, list(DISTINCT regexp_extract(path, '^(.*/)', 1)) AS dirs, CASE WHEN count(*) <= 2 THEN 20 WHEN count(*) <= 5 THEN 24 ELSE 28 END AS most FROM ch GROUP BY repo),
g0 AS (SELECT repo_id AS repo, path, max(line) / 50.0 AS graph, min(ordinal) AS depth FROM findings f WHERE category = 'bug' AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.repo = f.repo_id AND ch.path = f.path) GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY graph DESC, path) AS gr FROM g0 QUALIFY gr <= 112),
r0 AS (SELECT repo_id AS repo, path, CAST(max(line) AS DOUBLE) AS raw FROM findings f WHERE severity = 'nit' AND line < 45 AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.repo = f.repo_id AND ch.path = f.path) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY raw DESC, path) AS rr, raw / greatest(0.0001, max(raw) OVER (PARTITION BY repo)) AS share FROM r0),
h AS (SELECT repo_id AS repo, path, count(*) FILTER (WHERE status = 'open') AS open, count(*) AS historical FROM findings WHERE line < 3 GROUP BY ALL),
c0 AS (SELECT repo, path, coalesce(graph, 0) AS graph, coalesce(depth, 6) AS depth, coalesce(share, 0) AS share, coalesce(raw, 0) AS raw, gr, rr, n, most, len(list_filter(dirs, lambda x: starts_with(regexp_extract(path, '^(.*/)', 1), x) OR starts_with(x, regexp_extract(path, '^(.*/)', 1)))) > 0 AS near FROM g FULL JOIN r USING (repo, path) JOIN sz USING (repo)),
c1 AS (SELECT c0.*, CASE WHEN row_number() OVER (PARTITION BY c0.repo ORDER BY gr NULLS LAST, rr) <= 120 - n THEN least(0.2, coalesce(open, 0) * 0.04 + coalesce(historical, 0) * 0.008) ELSE 0 END AS hot FROM c0 LEFT JOIN h ON h.repo = c0.repo AND h.path = c0.path),
c2 AS (SELECT *, CASE WHEN raw <= 0 AND depth > 3 THEN NULL WHEN raw <= 0 AND graph < 0.22 AND hot < 0.04 THEN NULL WHEN raw > 0 AND graph <= 0 AND share < 0.28 AND NOT near AND hot < 0.03 THEN NULL
  ELSE graph * 0.34 + share * 0.52 + hot + CASE WHEN near THEN 0.06 ELSE 0 END + CASE WHEN graph <= 0 THEN 0 WHEN depth <= 1 THEN 0.08 WHEN depth = 2 THEN 0.04 WHEN depth = 3 THEN 0 ELSE -least(0.16, (depth - 3) * 0.06) END END AS t FROM c1),
c AS (SELECT *, CASE WHEN t >= 0.06 THEN t END AS score FROM c2),
p AS (SELECT repo, path, score, most, 1 AS part, row_number() OVER (PARTITION BY repo ORDER BY (share >= 0.55 OR near OR graph > 0) DESC, rr) AS k FROM c WHERE rr IS NOT NULL QUALIFY k <= least(most, greatest(4, most // 2))
UNION ALL SELECT repo, path, score, most, 2, row_number() OVER (PARTITION BY repo ORDER BY (depth <= 2 OR graph >= 0.5) DESC, gr) AS k FROM c WHERE gr IS NOT NULL QUALIFY k <= least(8, greatest(1, most // 4))
UNION ALL SELECT repo, path, score, most, 3, row_number() OVER (PARTITION BY repo ORDER BY score DESC, path) AS k FROM c WHERE score IS NOT NULL),
o AS (SELECT repo, path, score, most, min({'part': part, 'k': k}) AS a FROM p GROUP BY ALL)
SELECT repo, path, CAST(row_number() OVER (PARTITION BY repo ORDER BY a) AS INTEGER) AS place, ['retrieval', 'graph', 'both'][a.part] AS source, round(score, 9) AS score FROM o QUALIFY place <= most""")
def cp8(spark: SparkSession, d: str) -> DataFrame:
    """Fusion for all repositories; here scores stand for those of traversal and retrieval, so that SQL can follow."""
    f = findings(spark, d).withColumnRenamed("repo_id", "repo")
    changed = f.where("line = 50 and ordinal = 7 and startswith(path, 'src/m1/')").select("repo", "path").distinct()
    graph = f.where("category = 'bug'").select("repo", "path", (F.col("line") / 50.0).alias("score"), F.col("ordinal").alias("depth"))
    retrieved = f.where("severity = 'nit' and line < 45").select("repo", "path", F.col("line").cast("double").alias("score"))
    return fuse_context(graph, retrieved, hot_spots(f.where("line < 3")), changed).withColumn("score", F.round("score", 9))


def hot_spots(findings: DataFrame) -> DataFrame:
    """repo, path, open, historical: findings of a path, and those that are still open."""
    return findings.groupBy("repo", "path").agg(F.count(F.when(F.col("status") == "open", 1)).alias("open"), F.count("*").alias("historical"))


@query("cp8_traversal_fusion")
def cp8_traversal(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of what traversal finds from changed files with a ranking of files: CP7's output is CP8's input."""
    files = graph_nodes(spark, d).where("type = 'file'").select("repo", "id", "path")
    changed = files.where("id = 2 * repo or id = repo + 100").select("repo", "id", "path")
    seeds = changed.select("repo", "id", F.lit(1.0).alias("score"))
    found = best_first(graph_edges(spark, d), graph_nodes(spark, d), seeds).join(files, ["repo", "id"]).select("repo", "path", "score", "depth")
    retrieved = files.where("id % 11 = 3").select("repo", "path", (F.col("id") % 50 / 50).alias("score"))
    f = findings(spark, d).select((F.col("repo_id") % 7).alias("repo"), "path", "status")
    return fuse_context(found, retrieved, hot_spots(f), changed.select("repo", "path")).withColumn("score", F.round("score", 9))


def bm25(docs: DataFrame, question: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id and score of documents that share a word with the question (CP16), with k1 and b as given and words as they are, without stemming.

    Only the question's words are counted in each document, so what is shuffled is a few rows per document.
    """
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    asked = sorted({w for w in question.lower().split()})
    counted = docs.select("id", words.alias("w")).select("id", F.size("w").alias("n"), F.filter("w", lambda w: w.isin(asked)).alias("hits"))
    totals = counted.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))  # one row
    hits = counted.select("id", "n", F.explode("hits").alias("term")).groupBy("id", "n", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row per word of the question
    idf = F.ln(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return hits.join(F.broadcast(df), "term").join(F.broadcast(totals), F.lit(True)).groupBy("id").agg(F.sum(part).alias("score"))


@query("cp16_bm25_search", """WITH w AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents), t AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM w),
h AS (SELECT id, len(w) AS n, term, len(list_filter(w, lambda x: x = term)) AS tf FROM w, (VALUES ('stupid'), ('disgusting'), ('clown')) q(term) WHERE list_contains(w, term)), f AS (SELECT term, count(*) AS df FROM h GROUP BY term)
SELECT id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 9) AS score FROM h JOIN f USING (term), t GROUP BY id ORDER BY score DESC, id LIMIT 20""")
def cp16(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best documents for three words."""
    scores = bm25(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "stupid disgusting clown")
    return scores.select("id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query("cp16_indexed_search", """WITH e AS (SELECT doc_id AS id, concat_ws(' ', source, lang, CASE WHEN trim(text) <> '' THEN text END, n_chars) AS text FROM documents), w AS (SELECT id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM e), t AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM w),
h AS (SELECT id, len(w) AS n, term, len(list_filter(w, lambda x: x = term)) AS tf FROM w, (VALUES ('trash'), ('pathetic'), ('de'), ('300')) q(term) WHERE list_contains(w, term)), f AS (SELECT term, count(*) AS df FROM h GROUP BY term)
SELECT id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 9) AS score FROM h JOIN f USING (term), t GROUP BY id""")
def cp16_index(spark: SparkSession, d: str) -> DataFrame:
    """A search of the index over several fields of all documents; the SQL scans them."""
    docs = table(spark, d, "documents")
    entries = docs.select(F.col("doc_id").alias("id"), index.search_text(F.col("source"), F.col("lang"), F.col("text"), keys=F.array(F.col("n_chars").cast("string"))).alias("text"))
    path = shared_folder(spark, "bm25")
    index.write_index(entries, path, 16)
    return index.search_index(spark, path, "Trash, pathetic: de 300!").select("id", F.round("score", 9).alias("score"))


def subsequence_score(path: Column, pattern: str) -> Column:
    """Score of a pattern whose characters occur in order in a path, else null (CP17).

    Ours, as the scorer that this replaces isn't public here: 1,000 less a point for each character of the path, 100 more where the
    pattern occurs as a whole, 200 more where it does in the name.
    """
    between = "(?i)" + ".*".join("\\" + c if not c.isalnum() else c for c in pattern)
    low = F.lower(path)
    whole = F.when(F.contains(low, F.lit(pattern.lower())), 100).otherwise(0) + F.when(F.contains(F.element_at(F.split(low, "/"), -1), F.lit(pattern.lower())), 200).otherwise(0)
    return F.when(path.rlike(between), 1000 - F.length(path) + whole)


@query("cp17_fuzzy_files", "SELECT path, CAST(1000 - length(path) + CASE WHEN contains(lower(path), 's1f') THEN 100 ELSE 0 END + CASE WHEN contains(split_part(lower(path), '/', -1), 's1f') THEN 200 ELSE 0 END AS INTEGER) AS score FROM (SELECT DISTINCT path FROM units) WHERE regexp_matches(lower(path), 's.*1.*f') ORDER BY score DESC, path LIMIT 30")
def cp17(spark: SparkSession, d: str) -> DataFrame:
    found = units(spark, d).select("path").distinct().withColumn("score", subsequence_score(F.col("path"), "s1f"))
    return found.where("score is not null").orderBy(F.desc("score"), "path").limit(30)


def path_index(paths: DataFrame) -> DataFrame:
    """path and mask of distinct paths: a bit for each letter and digit that occurs in it, in lower case."""
    bits = F.expr("aggregate(array_distinct(split(regexp_replace(lower(path), '[^a-z0-9]', ''), '')), 0L, (m, c) -> if(c = '', m, m | shiftleft(1L, if(c <= '9', ascii(c) - 48, ascii(c) - 87))))")
    return paths.select("path").distinct().withColumn("mask", bits)


def _mask(pattern: str) -> int:
    return sum(1 << int(c, 36) for c in {c for c in pattern.lower() if c.isascii() and c.isalnum()})


class FileSearch:
    """A search that goes on while its pattern is typed (CP17): what a longer pattern finds is among what the shorter one found.

    The paths' masks rule most out before a pattern is tried on them. Each pattern's matches are written, so that the next one reads those alone; another pattern begins anew.
    """

    def __init__(self, paths: DataFrame):
        self.index = stored(path_index(paths), "paths")
        self.found: list[tuple[str, DataFrame]] = []

    def search(self, pattern: str) -> DataFrame:
        """path and score of all matches of a pattern (see `subsequence_score`)."""
        while self.found and not pattern.startswith(self.found[-1][0]):
            self.found.pop()
        among = self.found[-1][1] if self.found else self.index
        mask = _mask(pattern)
        likely = among.where(F.col("mask").bitwiseAND(F.lit(mask)) == mask)
        kept = stored(likely.where(subsequence_score(F.col("path"), pattern).isNotNull()), "matches")
        self.found.append((pattern, kept))
        return kept.select("path", subsequence_score(F.col("path"), pattern).alias("score"))


_TYPED = ("s", "s1", "s1f", "s2", "s2e/")
_TYPED_SQL = " UNION ALL ".join(
    f"SELECT '{p}' AS pattern, path, CAST(1000 - length(path) + CASE WHEN contains(lower(path), '{p}') THEN 100 ELSE 0 END + CASE WHEN contains(split_part(lower(path), '/', -1), '{p}') THEN 200 ELSE 0 END AS INTEGER) AS score FROM p WHERE regexp_matches(lower(path), '{'.*'.join(p)}')" for p in _TYPED
)


@query("cp17_typed_search", f"WITH p AS (SELECT DISTINCT path FROM units UNION SELECT DISTINCT path FROM findings) {_TYPED_SQL}")
def cp17_typed(spark: SparkSession, d: str) -> DataFrame:
    """All matches of a pattern after each key, one going back: from those of the pattern before."""
    search = FileSearch(units(spark, d).select("path").unionByName(findings(spark, d).select("path")))
    parts = [search.search(p).select(F.lit(p).alias("pattern"), "path", "score") for p in _TYPED]
    return reduce(DataFrame.unionByName, parts)


_CP5 = "the anthor of thenan and erly for token src1/en"
# Fixed values of the structural scorer are spelt out here once more: 0.62, 0.22, 0.16, 0.08, 0.02, 0.03.
@query("cp5_structural_scores", f"""WITH w AS (SELECT id, path, kind, unnest([split_part(text, chr(10), 1), path]) AS title, text FROM units),
t AS (SELECT id, path, kind, {_tokens('title')} AS tt, {_tokens('substr(text, 1, 10000)')} AS tx, {_tokens(f"'{_CP5}'")} AS q FROM w),
s AS (SELECT id, {_overlap('q', 'tt')} AS semantic, {_overlap('q', 'tx')} AS lexical, CASE WHEN path IN ('src1/fr/f1.txt', 'src2/en/f0.txt') THEN 0.16 WHEN regexp_replace(path, '/[^/]*$', '') IN ('src1/fr', 'src2/en') THEN 0.08 ELSE 0.0 END AS path_boost,
  CASE kind WHEN 'symbol' THEN 0.02 WHEN 'chunk' THEN 0.03 ELSE 0.0 END AS kind_boost FROM t),
b AS (SELECT id, max({{'score': semantic * 0.62 + lexical * 0.22 + path_boost + kind_boost, 'semantic': semantic}}) AS b FROM s GROUP BY id)
SELECT id, round(b.score, 9) AS score, round(b.semantic, 9) AS semantic FROM b""")
def cp5(spark: SparkSession, d: str) -> DataFrame:
    """Structural scores of units; each stands under two headings here, its first line and its path, and the better one counts."""
    headings = F.explode(F.array(F.substring_index("text", "\n", 1), F.col("path"))).alias("title")
    found = structural_scores(units(spark, d).select("id", "path", "kind", headings, "text"), _CP5, CHANGED)
    return found.select("id", F.round("score", 9).alias("score"), F.round("semantic", 9).alias("semantic"))


def structural_scores(nodes: DataFrame, question: str, changed: list[str], w: Weights = Weights()) -> DataFrame:
    """id, score, semantic, lexical: the best of an item's nodes (id, path, kind, title, text) by overlap of the question with its heading
    and its text (the scorer reads 10,000 characters of it), nearness to changed paths, and kind (CP5)."""
    asked = T.search_tokens(F.lit(question))
    dirs = sorted({p.rpartition("/")[0] for p in changed if "/" in p})
    tokens = nodes.select("id", "path", "kind", T.search_tokens(F.col("title")).alias("tt"), T.search_tokens(F.substring("text", 1, 10_000)).alias("tx"))
    near = F.when(F.col("path").isin(changed), w.changed_path).when(T.directory(F.col("path")).isin(dirs), w.same_directory).otherwise(0.0)
    kind = F.when(F.col("kind") == "symbol", w.symbol).when(F.col("kind") == "chunk", w.chunk).otherwise(0.0)
    parts = tokens.select("id", (near + kind).alias("boost"), T.overlap_score(asked, F.col("tt")).alias("semantic"), T.overlap_score(asked, F.col("tx")).alias("lexical"))
    score = F.col("semantic") * w.semantic + F.col("lexical") * w.lexical + F.col("boost")
    best = parts.groupBy("id").agg(F.max(F.struct(score.alias("score"), "semantic", "lexical")).alias("b"))
    return best.select("id", "b.*")


def _markdown(units: DataFrame) -> DataFrame:
    """Units with headings in their texts: each line whose length is a multiple of three is one, of a level by its length; every eleventh length opens or closes a fence."""
    line = F.expr("transform(split(text, '\n'), line -> if(length(line) % 11 = 0, '```', if(length(line) % 3 = 0, concat(repeat('#', length(line) % 7 + 1), ' ', line), line)))")
    return units.withColumn("text", F.array_join(line, "\n"))


_SECTIONS_SQL = r"""ml AS (SELECT id, path, kind, list_transform(string_split(text, chr(10)), lambda l: CASE WHEN length(l) % 11 = 0 THEN '```' WHEN length(l) % 3 = 0 THEN repeat('#', length(l) % 7 + 1) || ' ' || l ELSE l END) AS ls FROM units),
mx AS (SELECT id, path, kind, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM ml),
mf AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS fences FROM mx),
mh AS (SELECT *, CASE WHEN fences % 2 = 0 AND regexp_matches(line, '^#{1,6}[ 	]+[^ 	
]') THEN length(regexp_extract(line, '^(#{1,6})[ 	]+', 1)) END AS level FROM mf),
mn AS (SELECT *, count(level) OVER (PARTITION BY id ORDER BY n) AS node FROM mh),
sc AS (SELECT id, any_value(path) AS path, any_value(kind) AS kind, node, CAST(max(level) AS INTEGER) AS level, trim(regexp_replace(max(line) FILTER (WHERE level IS NOT NULL), '^#{1,6}[ 	]+', '')) AS title, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE level IS NULL), '') AS text FROM mn WHERE node > 0 GROUP BY id, node),
se AS (SELECT *, (SELECT max(p.node) FROM sc p WHERE p.id = sc.id AND p.node < sc.node AND p.level < sc.level) AS parent FROM sc)"""


@query("cp5_heading_tree", f"WITH {_SECTIONS_SQL} SELECT id, node, level, title, parent, text FROM se")
def cp5_tree(spark: SparkSession, d: str) -> DataFrame:
    """Sections of whole texts, and the tree of their headings."""
    return heading_sections(_markdown(units(spark, d).select("id", "text")))


@query("cp5_section_scores", f"""WITH {_SECTIONS_SQL}, t AS (SELECT id, path, kind, {_tokens('title')} AS tt, {_tokens('substr(text, 1, 10000)')} AS tx, {_tokens(f"'{_CP5}'")} AS q FROM se),
s AS (SELECT id, {_overlap('q', 'tt')} AS semantic, {_overlap('q', 'tx')} AS lexical, CASE WHEN path IN ('src1/fr/f1.txt', 'src2/en/f0.txt') THEN 0.16 WHEN regexp_replace(path, '/[^/]*$', '') IN ('src1/fr', 'src2/en') THEN 0.08 ELSE 0.0 END AS path_boost,
  CASE kind WHEN 'symbol' THEN 0.02 WHEN 'chunk' THEN 0.03 ELSE 0.0 END AS kind_boost FROM t)
SELECT id, round(max(semantic * 0.62 + lexical * 0.22 + path_boost + kind_boost), 9) AS score FROM s GROUP BY id""")
def cp5_sections(spark: SparkSession, d: str) -> DataFrame:
    """Structural scores of units by their best section, from the tree of headings."""
    u = units(spark, d).select("id", "path", "kind", "text")
    nodes = heading_sections(_markdown(u)).join(u.select("id", "path", "kind"), "id")
    return structural_scores(nodes, _CP5, CHANGED).select("id", F.round("score", 9).alias("score"))


@query("tk12_matching_files", "SELECT doc_id FROM documents WHERE regexp_matches(text, 'stup[a-z]d|clown') ORDER BY doc_id DESC LIMIT 2000")
def tk12(spark: SparkSession, d: str) -> DataFrame:
    """Files whose content matches a pattern, newest first."""
    return table(spark, d, "documents").where(F.col("text").rlike("stup[a-z]d|clown")).select("doc_id").orderBy(F.desc("doc_id")).limit(2000)
