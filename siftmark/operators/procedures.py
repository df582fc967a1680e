"""Registered queries of the stateful text procedures; they have goldens in the tests instead of SQL, but where SQL can say the same."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import table
from ..functions.procedures import diff_lines, exploded, find_json, find_lines, middle_cut, python_symbols, statements, text_chunks
from ..registry import query

_INT, _STRING = (pa.int32(), "int"), (pa.string(), "string")


@query("sf15_text_chunks")
def sf15(spark: SparkSession, d: str) -> DataFrame:
    out = text_chunks(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return out.select("id", "index", "first_line", "last_line", F.sha2("chunk", 256).alias("chunk"))


@query("sf16_statements", """WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
w AS (SELECT id, CAST(n AS INTEGER) AS line, regexp_extract(lower(l), '[a-z]+') AS word FROM l)
SELECT id, CASE n WHEN 0 THEN 'import' WHEN 1 THEN 'export' WHEN 2 THEN 'import' END AS kind, CASE n WHEN 0 THEN './' || word WHEN 1 THEN word WHEN 2 THEN 'std::' || word END AS name, line FROM (SELECT *, line % 4 AS n FROM w) WHERE n < 3 AND word <> ''""")
def sf16(spark: SparkSession, d: str) -> DataFrame:
    """Imports and exports of source files that are made of whole documents: the first word of each line, as one of four statements."""
    # a dotted capital I is one letter in lower case, as the SQL has it, not two
    word = lambda l: F.regexp_extract(F.lower(F.replace(l, F.lit("İ"), F.lit("i"))), "[a-z]+", 0)
    code = lambda l, i: F.element_at(F.array(F.concat(F.lit("import a from './"), word(l), F.lit("'")), F.concat(F.lit("export const "), word(l), F.lit(" = 1")), F.concat(F.lit("use std::"), word(l)), F.concat(F.lit("let "), word(l))), ((i + 1) % 4 + 1).cast("int"))
    blank = lambda l, i: F.when(word(l) == "", "").otherwise(code(l, i))
    source = F.array_join(F.transform(F.split("text", "\n"), blank), "\n")
    return exploded(table(spark, d, "documents").select(F.col("doc_id").alias("id"), source.alias("text")), "id", "text", statements, [("kind", *_STRING), ("name", *_STRING), ("line", *_INT)])


@query("sf17_python_symbols")
def sf17(spark: SparkSession, d: str) -> DataFrame:
    source = F.concat(F.lit("class C"), "page_id", F.lit(":\n    def f"), "page_id", F.lit("(self):\n        return 1\n"))
    fields = [("kind", *_STRING), ("name", *_STRING), ("first_line", *_INT), ("last_line", *_INT)]
    return exploded(table(spark, d, "pages").select("page_id", source.alias("text")), "page_id", "text", python_symbols, fields)


@query("sf21_diff_index", """WITH d AS (SELECT doc_id AS id, doc_id % 30 + 1 AS start, 'src/' || source || '.ts' AS path, list_transform(string_split_regex(text, '[\\n.]+'), lambda x: ['+', '-', ' '][length(x) % 3 + 1] || 'x' || x) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT id, start, path, sha256(array_to_string(ls, chr(10))) AS hunk, unnest(ls) AS l, generate_subscripts(ls, 1) AS n FROM d),
g AS (SELECT *, l[1] AS s, sum(CASE WHEN l[1] <> '+' THEN 1 ELSE 0 END) OVER w AS lefts, sum(CASE WHEN l[1] <> '-' THEN 1 ELSE 0 END) OVER w AS rights FROM l WINDOW w AS (PARTITION BY id ORDER BY n))
SELECT id, path, 'LEFT' AS side, CAST(lefts AS INTEGER) AS line, hunk FROM g WHERE s <> '+' UNION ALL SELECT id, path, 'RIGHT', CAST(start + rights - 1 AS INTEGER), hunk FROM g WHERE s <> '-'""")
def sf21(spark: SparkSession, d: str) -> DataFrame:
    """Lines of diffs that are made of whole documents: each sentence is an added, deleted or unchanged line by its length."""
    docs = table(spark, d, "documents").where("text is not null")
    body = F.transform(F.split("text", "[\n.]+"), lambda x: F.concat(F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(" ")), (F.length(x) % 3 + 1).cast("int")), F.lit("x"), x))
    patch = F.concat(F.lit("--- a/x\n+++ b/src/"), "source", F.lit(".ts\n@@ -1,3 +"), (F.col("doc_id") % 30 + 1).cast("string"), F.lit(",4 @@\n"), F.array_join(body, "\n"))
    return exploded(docs.select(F.col("doc_id").alias("id"), patch.alias("patch")), "id", "patch", diff_lines, [("path", *_STRING), ("side", *_STRING), ("line", *_INT), ("hunk", *_STRING)])


@query("sf29_middle_cut")
def sf29(spark: SparkSession, d: str) -> DataFrame:
    """All documents, whatever their characters: SQL has no cut at bytes that keeps characters whole."""
    return exploded(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", lambda x: [(middle_cut(x, 120),)], [("cut", *_STRING)])


@query("sf32_line_search", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(n AS INTEGER) AS n, CAST(min(n) OVER (PARTITION BY doc_id, l) - 1 AS INTEGER) AS place FROM l""")
def sf32(spark: SparkSession, d: str) -> DataFrame:
    """Where each line of a document stands first."""

    def places(x: str) -> list[tuple]:
        lines = x.split("\n")
        known: dict[str, int | None] = {}
        for line in lines:
            if line not in known:
                known[line] = find_lines(lines, [line])
        return [(i + 1, known[line]) for i, line in enumerate(lines)]

    return exploded(table(spark, d, "documents").where("text is not null").select("doc_id", "text"), "doc_id", "text", places, [("n", *_INT), ("place", *_INT)])


@query("sc13_noisy_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def sc13(spark: SparkSession, d: str) -> DataFrame:
    """An object with a key k, found in an answer with text around it."""
    said = F.concat(F.lit("Sure! Here {is} it: {\"a\": [1, "), "props", F.lit("]} done"))
    found = lambda x: [((find_json(x, {"k"}) or {}).get("k"),)]
    return exploded(table(spark, d, "events").select("event_id", said.alias("text")), "event_id", "text", found, [("k", pa.int64(), "long")])
