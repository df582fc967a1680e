"""Bindings of the domain's relations to the tables of the data folder.

The domain (units, runs, findings, feedback, logs, graph edges) has no tables of its own here,
so each relation is derived from an analogous one. `VIEWS` has the same derivations for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Edge types of the code graph that a traversal follows.
EDGE_TYPES = ["file_dep", "file_dep_inferred", "references_symbol", "contains_symbol", "class_contains_symbol", "symbol_contains_symbol", "symbol_imports_file", "exports_symbol", "dir_contains_file", "dir_contains_dir", "module_contains", "module_dep"]
NODE_TYPES = ["file", "symbol", "file", "directory", "module"]
CATEGORIES = ["security", "bug", "performance", "testing", "maintainability", "style"]



def _source_path(c: str) -> str:
    """SQL of the path of source file number `c`, in DuckDB and Spark alike."""
    end = f"CASE {c} % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '/index.ts' ELSE '.py' END"
    return f"CASE WHEN {c} % 40 = 0 THEN concat('f', {c}, '.ts') ELSE concat('m', {c} % 7, '/p', {c} % 3, '/f', {c}, {end}) END"


_TARGET = "(l_suppkey * 15 + l_linenumber % 2 * 5 + o_custkey % 5)"
_STEM = f"concat('m', {_TARGET} % 7, '/p', {_TARGET} % 3, '/f', {_TARGET})"
_NEAR = f"concat('p', {_TARGET} % 3, '/f', {_TARGET})"
#: What a source file imports, in the ways of its language.
_SPEC = f"""CASE WHEN o_custkey % 4 = 3 THEN CASE l_partkey % 4 WHEN 0 THEN replace({_STEM}, '/', '.') WHEN 1 THEN concat('..', replace({_NEAR}, '/', '.')) WHEN 2 THEN concat('.f', {_TARGET}) ELSE concat('pkg', {_TARGET} % 20, '.sub') END
        ELSE CASE l_partkey % 9 WHEN 0 THEN {_STEM} WHEN 1 THEN concat('@/', {_STEM}, '.js') WHEN 2 THEN concat('../', {_NEAR}) WHEN 3 THEN concat('./f', {_TARGET}) WHEN 4 THEN concat('@scope', {_TARGET} % 5, '/pkg/deep')
        WHEN 5 THEN concat('lib', {_TARGET} % 20, '/x?raw') WHEN 6 THEN 'node:fs' WHEN 7 THEN concat('../../', {_STEM}, '.tsx') ELSE concat('~/', {_STEM}, '/index.ts') END END"""
_KIND = "CASE o_orderpriority WHEN '1-URGENT' THEN 'class_declaration' WHEN '2-HIGH' THEN 'interface_declaration' ELSE 'function_declaration' END"
_NAME = "CASE l_returnflag WHEN 'R' THEN {spec} WHEN 'A' THEN concat('mod::s', {own}) ELSE concat('app.s', {other}, '()') END"

#: The tables' schemas are fixed; nothing is inferred from file contents beyond Parquet's own.
VIEWS = {
    "units": """SELECT doc_id AS id, source || '/' || lang || '/f' || (doc_id % 3) || '.txt' AS path, source || '/' || lang AS dir,
        CASE doc_id % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'symbol' ELSE 'chunk' END AS kind, doc_id % 11 = 0 AS is_pattern, lang, source, text FROM documents""",
    "runs": """SELECT o_orderkey AS run_id, o_custkey % 40 AS repo_id, o_custkey AS pr_id,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
        CAST(floor(o_totalprice) AS BIGINT) AS latency_ms, o_orderkey % 997 AS sha FROM orders""",
    "findings": """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS finding_id, l_orderkey AS run_id, l_suppkey % 20 AS repo_id,
        'src/m' || (l_partkey % 12) || '/f' || (l_partkey % 97) || '.ts' AS path, CAST(l_quantity AS INTEGER) AS line,
        CASE l_returnflag WHEN 'A' THEN 'blocking' WHEN 'N' THEN 'important' ELSE 'nit' END AS severity,
        CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'fixed' END AS status,
        CASE l_suppkey % 6 WHEN 0 THEN 'security' WHEN 1 THEN 'bug' WHEN 2 THEN 'performance' WHEN 3 THEN 'testing' WHEN 4 THEN 'maintainability' ELSE 'style' END AS category,
        'Check  Value #' || (l_partkey % 40) || ' in loop' AS title, CASE WHEN l_partkey % 3 = 0 THEN 'r' || (l_partkey % 5) END AS rule_id,
        l_linenumber AS ordinal FROM lineitem""",
    "feedback": """SELECT event_id AS feedback_id, user_id AS finding_no, CASE WHEN event_type IN ('click', 'view', 'error') THEN 'reaction' ELSE 'reply' END AS type,
        CASE event_type WHEN 'click' THEN 'thumbs_up' WHEN 'view' THEN 'heart' WHEN 'error' THEN 'thumbs_down' END AS sentiment,
        CASE WHEN event_type = 'purchase' THEN 'resolved' END AS action, CAST(epoch_us(ts) AS BIGINT) AS at_us FROM events""",
    "logs": """SELECT event_id AS id, CAST(epoch_us(ts) AS BIGINT) // 1000000 AS ts, (CAST(epoch_us(ts) AS BIGINT) % 1000000) * 1000 AS ts_nanos,
        CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'view' THEN 'DEBUG' ELSE 'INFO' END AS level, event_type AS target, props AS message,
        CASE WHEN user_id % 7 <> 0 THEN user_id END AS thread_id, 'p' || (user_id % 5) AS process_uuid,
        CAST(strlen(props) + strlen(event_type) + 8 AS BIGINT) AS bytes FROM events""",
    "graph_edges": f"""SELECT l_orderkey % 7 AS repo, l_suppkey AS from_id, l_partkey % 300 AS to_id, {EDGE_TYPES}[(l_partkey + l_linenumber) % 12 + 1] AS type, count(*) AS weight
        FROM lineitem WHERE l_suppkey <> l_partkey % 300 GROUP BY ALL""",
    "code_files": f"SELECT c_custkey % 5 AS repo, c_custkey AS file, {_source_path('c_custkey')} AS path FROM customer",
    "code_symbols": f"""SELECT o_custkey % 5 AS repo, {_source_path('o_custkey')} AS path, o_orderkey AS symbol, concat('s', o_orderkey // 8) AS name, {_KIND} AS kind, o_orderkey % 200 + 1 AS first,
        o_orderkey % 200 + 1 + CAST(floor(o_totalprice / 10000) AS BIGINT) AS last FROM orders""",
    "code_refs": f"""SELECT o_custkey % 5 AS repo, {_source_path('o_custkey')} AS path, l_orderkey * 10 + l_linenumber AS ref, CASE l_returnflag WHEN 'R' THEN 'import' WHEN 'A' THEN 'export' ELSE 'identifier' END AS kind,
        {_NAME.format(spec=_SPEC, own='(l_orderkey // 8)', other='((l_orderkey + l_partkey % 96) // 8)')} AS name, o_orderkey % 200 + l_linenumber * 3 AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "deps": """SELECT l_suppkey AS from_id, l_partkey % 100 AS to_id, CASE WHEN l_returnflag = 'R' THEN 'file_dep' ELSE 'references_symbol' END AS type,
        l_orderkey || ':' || l_linenumber AS example, l_orderkey * 10 + l_linenumber AS pos FROM lineitem""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval units: a path per source, language and remainder of the id."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.expr("concat(source, '/', lang, '/f', doc_id % 3, '.txt')").alias("path"),
        F.concat_ws("/", "source", "lang").alias("dir"),
        F.expr("element_at(array('file', 'symbol', 'chunk'), cast(doc_id % 3 as int) + 1)").alias("kind"),
        (F.col("doc_id") % 11 == 0).alias("is_pattern"),
        "lang",
        "source",
        "text",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review runs."""
    status = F.create_map(F.lit("F"), F.lit("completed"), F.lit("O"), F.lit("running"), F.lit("P"), F.lit("failed"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        (F.col("o_custkey") % 40).alias("repo_id"),
        F.col("o_custkey").alias("pr_id"),
        status[F.col("o_orderstatus")].alias("status"),
        F.floor("o_totalprice").cast("long").alias("latency_ms"),
        (F.col("o_orderkey") % 997).alias("sha"),
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review findings of runs."""
    severity = F.create_map(F.lit("A"), F.lit("blocking"), F.lit("N"), F.lit("important"), F.lit("R"), F.lit("nit"))
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("l_suppkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("finding_id"),
        F.col("l_orderkey").alias("run_id"),
        (F.col("l_suppkey") % 20).alias("repo_id"),
        F.expr("concat('src/m', l_partkey % 12, '/f', l_partkey % 97, '.ts')").alias("path"),
        F.col("l_quantity").cast("int").alias("line"),
        severity[F.col("l_returnflag")].alias("severity"),
        F.when(F.col("l_linestatus") == "O", "open").otherwise("fixed").alias("status"),
        category.alias("category"),
        F.expr("concat('Check  Value #', l_partkey % 40, ' in loop')").alias("title"),
        F.expr("if(l_partkey % 3 = 0, concat('r', l_partkey % 5), null)").alias("rule_id"),
        F.col("l_linenumber").alias("ordinal"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reactions and replies to findings."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("feedback_id"),
        F.col("user_id").alias("finding_no"),
        F.when(kind.isin("click", "view", "error"), "reaction").otherwise("reply").alias("type"),
        F.when(kind == "click", "thumbs_up").when(kind == "view", "heart").when(kind == "error", "thumbs_down").alias("sentiment"),
        F.when(kind == "purchase", "resolved").alias("action"),
        F.expr("unix_micros(cast(ts as timestamp))").alias("at_us"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows with a split timestamp and a byte cost."""
    micros = F.expr("unix_micros(cast(ts as timestamp))")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("ts"),
        (micros % 1000000 * 1000).alias("ts_nanos"),
        F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "DEBUG").otherwise("INFO").alias("level"),
        F.col("event_type").alias("target"),
        F.col("props").alias("message"),
        F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("thread_id"),
        F.expr("concat('p', user_id % 5)").alias("process_uuid"),
        (F.octet_length("props") + F.octet_length("event_type") + 8).cast("long").alias("bytes"),
    )


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges of each repository's code graph, with the number of places that give them."""
    kind = F.element_at(F.array(*map(F.lit, EDGE_TYPES)), ((F.col("l_partkey") + F.col("l_linenumber")) % 12 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").where("l_suppkey != l_partkey % 300")
    return rows.groupBy((F.col("l_orderkey") % 7).alias("repo"), F.col("l_suppkey").alias("from_id"), (F.col("l_partkey") % 300).alias("to_id"), kind.alias("type")).agg(F.count("*").alias("weight"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes at the ends of `graph_edges`: repo, id, type, path."""
    ends = graph_edges(spark, sf_dir).select("repo", F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    kind = F.element_at(F.array(*map(F.lit, NODE_TYPES)), (F.col("id") % 5 + 1).cast("int"))
    return ends.select("repo", "id", kind.alias("type"), F.expr("concat('src/m', id % 12, '/f', id, '.ts')").alias("path"))


def deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw dependencies between graph nodes, one row for each place."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("from_id"),
        (F.col("l_partkey") % 100).alias("to_id"),
        F.when(F.col("l_returnflag") == "R", "file_dep").otherwise("references_symbol").alias("type"),
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("example"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files of repositories: repo, file, path."""
    return table(spark, sf_dir, "customer").select(F.expr("c_custkey % 5").alias("repo"), F.col("c_custkey").alias("file"), F.expr(_source_path("c_custkey")).alias("path"))


def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of source files with their kind and lines: repo, path, symbol, name, kind, first, last."""
    first = F.col("o_orderkey") % 200 + 1
    return table(spark, sf_dir, "orders").select(
        F.expr("o_custkey % 5").alias("repo"),
        F.expr(_source_path("o_custkey")).alias("path"),
        F.col("o_orderkey").alias("symbol"),
        F.expr("concat('s', o_orderkey div 8)").alias("name"),
        F.expr(_KIND).alias("kind"),
        first.alias("first"),
        (first + F.floor(F.col("o_totalprice") / 10000).cast("long")).alias("last"),
    )


def code_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports, exports and names used in source files: repo, path, ref, kind, name, line."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderkey", "o_custkey"), "l_orderkey")
    return rows.select(
        F.expr("o_custkey % 5").alias("repo"),
        F.expr(_source_path("o_custkey")).alias("path"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref"),
        F.expr("CASE l_returnflag WHEN 'R' THEN 'import' WHEN 'A' THEN 'export' ELSE 'identifier' END").alias("kind"),
        F.expr(_NAME.format(spec=_SPEC, own="(l_orderkey div 8)", other="((l_orderkey + l_partkey % 96) div 8)")).alias("name"),
        (F.col("o_orderkey") % 200 + F.col("l_linenumber") * 3).alias("line"),
    )
