"""Predicates, text rules and set operations (FP4 to FP7, FP10 to FP14, SC2 to SC4, SC8, SC12, SF5, SF13, SF22, SF26 to SF28, SF30, SF31, SF33, SF35, SF36, SO1 to SO6, AG11, TK2, CP9, CP10, CP15, CP18, ST12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import table, units
from ..functions import text as T
from ..registry import query
from .ranking import top_per


def glob_pattern(glob: str) -> str:
    """A regular expression for a file glob: ** crosses directories, * and ? don't. It is anchored at both ends."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + glob[i] if not glob[i].isalnum() and glob[i] not in "_/-" else glob[i]), i + 1
    return f"^(?:{out})$"


def any_glob(x: Column, globs: list[str]) -> Column:
    return reduce(Column.__or__, [x.rlike("(?i)" + glob_pattern(g)) for g in globs], F.lit(False))


def should_trigger(trigger: Column, labels: Column, branch: Column, author: Column, text: Column, config: dict) -> Column:
    """Whether a request is reviewed (FP4): by trigger, labels, branch, author and keywords; what is not configured lets through."""
    ok = F.lit(True)
    if config.get("manual_only"):
        ok &= trigger.isin("manual", "comment")
    if not config.get("on_push", True):
        ok &= ~trigger.isin("synchronize", "push")
    for name, hit in (("labels", lambda gs: F.exists(labels, lambda x: any_glob(x, gs))), ("branches", lambda gs: any_glob(branch, gs)), ("authors", lambda gs: any_glob(author, gs)), ("keywords", lambda ks: reduce(Column.__or__, [F.contains(F.lower(text), F.lit(k.lower())) for k in ks]))):
        rule = config.get(name, {})
        if rule.get("include"):
            ok &= hit(rule["include"])
        if rule.get("exclude"):
            ok &= ~hit(rule["exclude"])
    return ok


@query("fp4_trigger_gate", r"""SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND (regexp_matches(lower(o_orderpriority), '^[^/]*high$') OR regexp_matches('p' || o_custkey % 9, '^p[13]$')) AND regexp_matches('rel/' || (o_custkey % 20) || '/x', '^rel/(?:.*/)?x$')
AND NOT regexp_matches('rel/' || (o_custkey % 20) || '/x', '^rel/1[^/]/x$') AND contains(lower('Order ' || o_orderkey), '7') AND NOT contains(lower('Order ' || o_orderkey), '77')""")
def fp4(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    config = {"on_push": False, "labels": {"include": ["*HIGH", "p1", "p3"]}, "branches": {"include": ["rel/**/x"], "exclude": ["rel/1?/x"]}, "keywords": {"include": ["7"], "exclude": ["77"]}}
    labels = F.array(F.col("o_orderpriority"), F.expr("concat('p', o_custkey % 9)"))
    trigger = F.when(F.col("o_orderstatus") == "P", "push").otherwise("opened")
    return o.where(should_trigger(trigger, labels, F.expr("concat('rel/', o_custkey % 20, '/x')"), F.lit(""), F.expr("concat('Order ', o_orderkey)"), config)).select("o_orderkey")


def comment_trigger(x: Column, tokens: list[str]) -> Column:
    """review for a slash token, mention for another one, else null; review wins (FP5)."""
    lower = F.lower(x)
    hit = lambda some: reduce(Column.__or__, [F.contains(lower, F.lit(t.lower())) for t in some], F.lit(False))
    return F.when(hit([t for t in tokens if t.startswith("/")]), "review").when(hit([t for t in tokens if not t.startswith("/")]), "mention")


@query("fp5_comment_triggers", "SELECT doc_id, CASE WHEN contains(lower(text), 'the of') THEN 'review' WHEN contains(lower(text), '@bot') OR contains(lower(text), ' an ') THEN 'mention' END AS kind FROM documents")
def fp5(spark: SparkSession, d: str) -> DataFrame:
    text = F.regexp_replace(F.col("text"), "(?i)the of", "/review")
    return table(spark, d, "documents").select("doc_id", comment_trigger(text, ["/review", "@bot", " An "]).alias("kind"))


def mention_task(x: Column, mention: str) -> Column:
    """What follows `<mention> do:`, trimmed; null without it (FP6)."""
    quoted = "".join("\\" + c if not c.isalnum() else c for c in mention)
    return F.nullif(F.btrim(F.regexp_extract(x, rf"(?is){quoted}\s*[,:-]?\s*do\s*:\s*(.+)$", 1), F.lit(" \t\n\r\f\x0b")), F.lit(""))


@query("fp6_mention_tasks", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN nullif(regexp_replace(text, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g'), '') END AS task FROM documents")
def fp6(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("hi @Bot, DO :  "), "text")).otherwise(F.concat(F.lit("@other do: "), "text"))
    return table(spark, d, "documents").select("doc_id", mention_task(said, "@bot").alias("task"))


def under(path: Column, dirs: list[str]) -> Column:
    """Whether a path is one of the directories, or below one (FP7)."""
    return reduce(Column.__or__, [(path == x) | path.startswith(x + "/") for x in dirs], F.lit(False))


@query("fp7_excluded_dirs", "SELECT id, path FROM units WHERE NOT (path = 'src1' OR starts_with(path, 'src1/') OR path = 'src2/en' OR starts_with(path, 'src2/en/'))")
def fp7(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d)
    return u.where(~under(u["path"], ["src1", "src2/en"])).select("id", "path")


def is_resolution(x: Column) -> Column:
    """Whether a reply says that a finding is fixed, and doesn't say that it isn't (FP10)."""
    # The words and their negations.
    lower = F.lower(x)
    return lower.rlike(r"\b(fixed|resolved|done)\b") & ~lower.rlike(r"\b(not|isn['’]?t|wasn['’]?t)\s+(?:yet\s+)?(fixed|resolved|done)\b")


@query("fp10_resolution_replies", r"""WITH r AS (SELECT p_partkey, ['Fixed in ', 'not yet done: ', 'this isn''t resolved ', 'Done. ', 'donezo ', 'was not good, fixed '][p_partkey % 6 + 1] || p_name AS body FROM part)
SELECT p_partkey, regexp_matches(lower(body), '\b(fixed|resolved|done)\b') AND NOT regexp_matches(lower(body), '\b(not|isn[''’]?t|wasn[''’]?t)\s+(?:yet\s+)?(fixed|resolved|done)\b') AS resolved FROM r""")
def fp10(spark: SparkSession, d: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ["Fixed in ", "not yet done: ", "this isn't resolved ", "Done. ", "donezo ", "was not good, fixed "])), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", is_resolution(F.concat(said, "p_name")).alias("resolved"))


def plain_login(x: Column) -> Column:
    """A login in lower case without the bot suffix (FP11)."""
    return F.regexp_replace(F.lower(F.trim(x)), r"\[bot\]$", "")


@query("fp11_self_comments", r"SELECT c_custkey, regexp_replace(lower(trim(' ' || c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '[Bot]' ELSE '' END || ' ')), '\[bot\]$', '') AS login, c_mktsegment = 'MACHINERY' AS own FROM customer")
def fp11(spark: SparkSession, d: str) -> DataFrame:
    """Logins without case and suffix, and whether they are the bot's own."""
    login = plain_login(F.concat(F.lit(" "), "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "[Bot]").otherwise(""), F.lit(" ")))
    return table(spark, d, "customer").select("c_custkey", login.alias("login"), (login == plain_login(F.lit("Machinery[bot]"))).alias("own"))


@query("fp12_search_findings", "SELECT p_partkey FROM part WHERE contains(lower(p_type), 'eco') OR contains(lower(p_name), 'eco') ORDER BY p_partkey DESC LIMIT 100")
def fp12(spark: SparkSession, d: str) -> DataFrame:
    """The newest hundred whose category or title contains a word, whatever its case."""
    hit = F.contains(F.lower("p_type"), F.lit("eco")) | F.contains(F.lower("p_name"), F.lit("eco"))
    return table(spark, d, "part").where(hit).select("p_partkey").orderBy(F.desc("p_partkey")).limit(100)


@query("fp13_open_of_request", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linestatus = 'O' AND l_orderkey BETWEEN 100 AND 140")
def fp13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_linestatus = 'O' and l_orderkey between 100 and 140").select("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")


@query("fp14_protected_keys", "SELECT p_partkey, lower(k) IN ('security','injection','authz','xss','sql injection') OR regexp_matches(lower(k), '^(security|injection|authz|xss|sql injection):') AS protected FROM (SELECT p_partkey, ['Security', 'security:' || p_brand, 'XSS', 'style', 'sql injection', 'securityx', 'authz:'][p_partkey % 7 + 1] AS k FROM part)")
def fp14(spark: SparkSession, d: str) -> DataFrame:
    k = F.element_at(F.array(F.lit("Security"), F.concat(F.lit("security:"), "p_brand"), *map(F.lit, ["XSS", "style", "sql injection", "securityx", "authz:"])), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", T.is_protected(k).alias("protected"))


@query("ag11_weights", """WITH c AS (SELECT p_partkey AS id, p_partkey % 11 AS a, p_size % 7 AS i, p_partkey % 3 AS p, p_size % 4 AS n FROM part)
SELECT id, round(greatest(-1.0, least(1.0, CASE WHEN a + i > 0 AND p + n > 0 THEN (a - i) / (a + i + 1) * 0.6 + (p - n) / (p + n + 1) * 0.4 WHEN a + i > 0 THEN (a - i) / (a + i + 1) ELSE (p - n) / (p + n + 1) END)), 9) AS weight FROM c""")
def ag11(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(k.alias("id"), F.round(T.weight(k % 11, s % 7, k % 3, s % 4), 9).alias("weight"))


# Languages by extension; files that are admitted by extension or name.
LANGUAGES = {"ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go", "rs": "rust"}
TEXT_NAMES = ["dockerfile", "makefile", "readme", "license"]


def language_of(path: Column) -> Column:
    """The language of a path: known by its extension, else the extension, else text (SC4)."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))[ext], F.nullif(ext, F.lit("")), F.lit("text"))


_FILES_SQL = "SELECT p_partkey AS id, p_brand || '/' || p_name || ['.ts', '.PY', '', '.rs', '.bin', '.tar.gz', '/README'][p_partkey % 7 + 1] AS path FROM part"


def _files(spark: SparkSession, d: str) -> DataFrame:
    ends = F.array(*map(F.lit, [".ts", ".PY", "", ".rs", ".bin", ".tar.gz", "/README"]))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit("/"), "p_name", F.element_at(ends, (F.col("p_partkey") % 7 + 1).cast("int"))).alias("path"))


@query("sc4_languages", f"""WITH f AS ({_FILES_SQL}), e AS (SELECT id, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS e FROM f)
SELECT id, CASE e WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN '' THEN 'text' ELSE e END AS language FROM e""")
def sc4(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("id", language_of(F.col("path")).alias("language"))


def is_text(text: Column, language: Column) -> Column:
    """Whether content counts as text (SC2): not empty, and of a known language or 92 % printable in its first 4,096 characters."""
    head = F.substring(text, 1, 4096)
    printable = F.length(F.regexp_replace(head, r"[^\x20-\x7E\t\n\r]+", "")) / F.length(head)
    return (F.length(text) > 0) & (language.isin(list(LANGUAGES.values())) | (printable >= 0.92))


@query("sc2_text_admission", r"SELECT doc_id, length(text) > 0 AND (lang = 'de' OR length(regexp_replace(substr(text, 1, 4096), '[^\x20-\x7E\t\n\r]+', '', 'g')) / length(substr(text, 1, 4096)) >= 0.92) AS admitted FROM documents")
def sc2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", is_text(F.col("text"), F.when(F.col("lang") == "de", "python").otherwise("text")).alias("admitted"))


@query("sc3_size_cap", "SELECT doc_id FROM documents WHERE strlen(text) <= 20000 AND instr(text, chr(0)) = 0")
def sc3(spark: SparkSession, d: str) -> DataFrame:
    """Files within a size cap (here 20,000 bytes) and without NUL bytes."""
    return table(spark, d, "documents").where((F.octet_length("text") <= 20000) & (F.instr("text", "\x00") == 0)).select("doc_id")


@query("sc8_scoped_config", """WITH c AS (SELECT CASE WHEN r_regionkey = 0 THEN '' ELSE 'src' || r_regionkey END AS dir, r_regionkey * 10 AS cap, CASE WHEN r_regionkey % 2 = 0 THEN r_name END AS tone FROM region UNION ALL SELECT 'src1/en', NULL, 'short'),
u AS (SELECT id, path, source, dir AS d FROM units), j AS (SELECT u.id, c.dir, c.cap, c.tone, length(c.dir) AS depth FROM u JOIN c ON c.dir = '' OR c.dir = u.source OR c.dir = u.d)
SELECT id, CAST(arg_max(cap, depth) FILTER (WHERE cap IS NOT NULL) AS BIGINT) AS cap, arg_max(tone, depth) FILTER (WHERE tone IS NOT NULL) AS tone FROM j GROUP BY id""")
def sc8(spark: SparkSession, d: str) -> DataFrame:
    """Settings of each path from its directories' configurations: key by key, the deepest wins."""
    region = table(spark, d, "region")
    key = F.col("r_regionkey").cast("long")
    configs = region.select(F.when(key == 0, "").otherwise(F.concat(F.lit("src"), key)).alias("dir"), (key * 10).alias("cap"), F.when(key % 2 == 0, F.col("r_name")).alias("tone"))
    configs = configs.unionByName(region.limit(1).select(F.lit("src1/en").alias("dir"), F.lit(None).cast("long").alias("cap"), F.lit("short").alias("tone")))
    u = units(spark, d).select("id", F.explode(F.concat(T.ancestors(F.col("path")), F.array(F.lit("")))).alias("dir"))
    joined = u.join(configs, "dir").withColumn("depth", F.length("dir"))
    deepest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("depth"))).alias(c)
    return joined.groupBy("id").agg(deepest("cap"), deepest("tone"))


@query("sc12_change_merge", """WITH a AS (SELECT 'f' || p_partkey AS path, ['M', 'A', 'D'][p_partkey % 3 + 1] AS status FROM part WHERE p_partkey % 4 <> 0), b AS (SELECT regexp_replace('{old => f' || p_partkey || '}', '^\\{.* => (.*)\\}$', '\\1') AS path, CASE WHEN p_size % 9 = 0 THEN '-' ELSE CAST(p_size AS VARCHAR) END AS added FROM part WHERE p_partkey % 5 <> 0)
SELECT coalesce(a.path, b.path) AS path, coalesce(status, 'M') AS status, TRY_CAST(added AS BIGINT) AS additions FROM a FULL JOIN b ON a.path = b.path""")
def sc12(spark: SparkSession, d: str) -> DataFrame:
    """Changed files from two listings: rename syntax resolved, a dash means no count."""
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    a = part.where(k % 4 != 0).select(F.concat(F.lit("f"), k).alias("path"), F.element_at(F.array(F.lit("M"), F.lit("A"), F.lit("D")), (k % 3 + 1).cast("int")).alias("status"))
    b = part.where(k % 5 != 0).select(F.regexp_replace(F.concat(F.lit("{old => f"), k, F.lit("}")), r"^\{.* => (.*)\}$", "$1").alias("path"), F.when(F.col("p_size") % 9 == 0, "-").otherwise(F.col("p_size").cast("string")).alias("added"))
    return a.join(b, "path", "full").select("path", F.coalesce("status", F.lit("M")).alias("status"), F.expr("try_cast(added as bigint)").alias("additions"))


@query("sf5_proximity", "SELECT l_linenumber, CAST(l_quantity AS INTEGER) AS q, CAST(CASE WHEN l_quantity <= 2 THEN 1.0 WHEN l_quantity <= 6 THEN 0.9 WHEN l_quantity <= 12 THEN 0.75 WHEN l_quantity <= 25 THEN 0.55 ELSE 0.3 END AS DOUBLE) AS score, count(*) AS n FROM lineitem GROUP BY ALL")
def sf5(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    return table(spark, d, "lineitem").groupBy("l_linenumber", q.alias("q"), T.line_proximity(q).alias("score")).agg(F.count("*").alias("n"))


@query("sf13_hashes", "SELECT doc_id, sha1(text) AS content, sha256(source || '|' || lang || '|' || n_chars) AS fingerprint FROM documents")
def sf13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha1("text").alias("content"), F.sha2(F.concat_ws("|", "source", "lang", "n_chars"), 256).alias("fingerprint"))


@query("sf14_semantic_keys", "SELECT p_partkey, p_brand || '|bug|' || trim(regexp_replace(lower('The ' || p_name || ': ' || p_type || '!'), '[^a-z0-9]+', ' ', 'g')) AS key FROM part")
def sf14(spark: SparkSession, d: str) -> DataFrame:
    title = F.expr("concat('The ', p_name, ': ', p_type, '!')")
    return table(spark, d, "part").select("p_partkey", T.semantic_key(F.col("p_brand"), F.lit("bug"), title).alias("key"))


@query("sf22_churn_risk", "SELECT o_orderpriority, CASE WHEN o_custkey % 400 >= 250 THEN 'high' WHEN o_custkey % 400 >= 80 THEN 'medium' ELSE 'low' END AS risk, count(*) AS n FROM orders GROUP BY ALL")
def sf22(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority", T.churn_risk(F.col("o_custkey") % 400).alias("risk")).agg(F.count("*").alias("n"))


def directive(x: Column) -> Column:
    """The standing instruction in a comment, or null (SF26): its first unquoted line, long enough, with a directive word, and no question."""
    # What is cut off in front, and the words that make a directive.
    first = F.coalesce(F.try_element_at(F.filter(F.transform(F.split(x, "\n"), lambda t: F.trim(t)), lambda t: (F.length(t) > 0) & ~F.startswith(t, F.lit(">"))), F.lit(1)), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(first, r"^@\S+\s*", ""), r"(?i)^remember\s*:?\s*", ""), r"(?i)^note\s*:?\s*", "")
    flat = F.trim(F.regexp_replace(bare, r"\s+", " "))
    cut = F.when(F.length(flat) > 220, F.concat(F.rtrim(F.substring(flat, 1, 219)), F.lit("."))).otherwise(flat)
    says = cut.rlike(r"(?i)(^|\b)(don't|do not|never|avoid|prefer|always|please avoid|please don't)\b") & ~cut.rlike(r"\?\s*$") & (F.size(F.filter(F.split(cut, " "), lambda w: w != "")) >= 4)
    return F.when((F.length(flat) >= 12) & says, cut)


@query("sf26_directives", r"""WITH c AS (SELECT p_partkey, ['> quoted' || chr(10) || '@bot remember: always use ' || p_name, 'Note: never call ' || p_type || '  in loops', 'can we avoid ' || p_name || ' here?', 'looks good to me ' || p_name, 'avoid it', 'prefer ' || repeat(p_name || ' ', 40)][p_partkey % 6 + 1] AS body FROM part),
l AS (SELECT p_partkey, coalesce(list_filter(list_transform(string_split(body, chr(10)), lambda t: trim(t)), lambda t: length(t) > 0 AND NOT starts_with(t, '>'))[1], '') AS f FROM c),
b AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(f, '^@\S+\s*', ''), '^remember\s*:?\s*', '', 'i'), '^note\s*:?\s*', '', 'i'), '\s+', ' ', 'g')) AS flat FROM l),
k AS (SELECT *, CASE WHEN length(flat) > 220 THEN rtrim(substr(flat, 1, 219)) || '.' ELSE flat END AS cut FROM b)
SELECT p_partkey, CASE WHEN length(flat) >= 12 AND regexp_matches(cut, '(^|\b)(don''t|do not|never|avoid|prefer|always|please avoid|please don''t)\b', 'i') AND NOT regexp_matches(cut, '\?\s*$') AND len(list_filter(string_split(cut, ' '), lambda w: w <> '')) >= 4 THEN cut END AS instruction FROM k""")
def sf26(spark: SparkSession, d: str) -> DataFrame:
    bodies = ["concat('> quoted\\n@bot remember: always use ', p_name)", "concat('Note: never call ', p_type, '  in loops')", "concat('can we avoid ', p_name, ' here?')", "concat('looks good to me ', p_name)", "'avoid it'", "concat('prefer ', repeat(concat(p_name, ' '), 40))"]
    body = F.element_at(F.array(*map(F.expr, bodies)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", directive(body).alias("instruction"))


@query("sf27_rule_ids", "SELECT p_partkey, 'memory-' || substr(sha1(p_name || ' ' || p_type), 1, 12) AS rule FROM part")
def sf27(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("memory-"), F.substring(F.sha1(F.concat_ws(" ", "p_name", "p_type")), 1, 12)).alias("rule"))


@query("sf28_approximate_tokens", "SELECT doc_id, CAST((strlen(text) + 3) // 4 AS BIGINT) AS tokens FROM documents")
def sf28(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.approximate_tokens(F.col("text")).alias("tokens"))


@query("sf30_redaction", r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || ' bearer abcdefghij0123456789 sk-abcdefghijklmnopqrstuvwx', 'sk-[A-Za-z0-9]{20,}', '[REDACTED_SECRET]', 'g'), '\bAKIA[0-9A-Z]{16}\b', '[REDACTED_SECRET]', 'g'), '(?i)\bBearer\s+[A-Za-z0-9._\-]{16,}\b', 'Bearer [REDACTED_SECRET]', 'g'), '(?i)\b(api[_-]?key|token|secret|password)\b(\s*[:=]\s*)(["'']?)[^\s"'']{8,}', '\1\2\3[REDACTED_SECRET]', 'g')) AS redacted FROM documents WHERE regexp_matches(text, '^[\x00-\x7f]*$')""")
def sf30(spark: SparkSession, d: str) -> DataFrame:
    """Texts without secrets, as hashes. Only ASCII texts: word borders beside other letters differ between the engines' patterns."""
    said = F.concat("text", F.lit(" bearer abcdefghij0123456789 sk-abcdefghijklmnopqrstuvwx"))
    return table(spark, d, "documents").where(F.col("text").rlike(r"^[\x00-\x7f]*$")).select("doc_id", F.sha2(T.redact(said), 256).alias("redacted"))


@query("sf31_metric_tags", r"SELECT page_id, nullif(trim(regexp_replace(url, '[^A-Za-z0-9._/-]+', '_', 'g'), '_'), '') AS tag, len(regexp_extract_all(html, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}')) AS uuids FROM pages")
def sf31(spark: SparkSession, d: str) -> DataFrame:
    """Values made safe as metric tags, and the number of UUIDs in a text."""
    tag = F.expr("nullif(trim(BOTH '_' FROM regexp_replace(url, '[^A-Za-z0-9._/-]+', '_')), '')")
    return table(spark, d, "pages").select("page_id", tag.alias("tag"), F.regexp_count("html", F.lit("[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")).cast("long").alias("uuids"))


def job_token(x: Column, most: int) -> Column:
    """A value as part of a job id (SF33)."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[^a-zA-Z0-9_-]+", "_"), "_+", "_"), "^_+|_+$", ""), 1, most)


@query("sf33_job_ids", r"SELECT p_partkey, 'index_' || p_partkey || '_' || substr(sha1('pattern:' || p_name || ':HEAD'), 1, 12) || '_' || substr(regexp_replace(regexp_replace(regexp_replace('#' || p_brand || '  ' || p_name || '!', '[^a-zA-Z0-9_-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 12) || CASE WHEN p_size % 2 = 0 THEN '_force' ELSE '_normal' END AS job FROM part")
def sf33(spark: SparkSession, d: str) -> DataFrame:
    scope = F.substring(F.sha1(F.expr("concat('pattern:', p_name, ':HEAD')")), 1, 12)
    mode = F.when(F.col("p_size") % 2 == 0, "force").otherwise("normal")
    return table(spark, d, "part").select("p_partkey", F.concat_ws("_", F.lit("index"), "p_partkey", scope, job_token(F.expr("concat('#', p_brand, '  ', p_name, '!')"), 12), mode).alias("job"))


@query("sf35_windowed_read", "SELECT doc_id, CAST(n AS INTEGER) AS n, 'L' || n || ': ' || substr(line, 1, 500) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE n >= 2 AND n < 7")
def sf35(spark: SparkSession, d: str) -> DataFrame:
    """Lines 2 to 6 of each file, numbered, cut to 500 characters."""
    part = F.slice(F.split("text", "\n"), 2, 5)
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(part).alias("n", "line"))
    return lines.select("doc_id", (F.col("n") + 2).alias("n"), F.expr("concat('L', n + 2, ': ', substring(line, 1, 500))").alias("line"))


@query("sf36_tuning_step", """WITH r AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS p, count(*) FILTER (WHERE event_type = 'error') AS n FROM events GROUP BY user_id), t AS (SELECT user_id, p, n, n / greatest(1, p + n) AS neg FROM r)
SELECT user_id, round(CAST(greatest(0.0, least(1.0, 0.62 + CASE WHEN neg > 0.5 THEN 0.04 WHEN neg < 0.3 THEN -0.02 ELSE 0 END)) AS DOUBLE), 2) AS semantic, round(CAST(greatest(0.0, least(1.0, 0.22 + CASE WHEN neg > 0.5 THEN -0.02 ELSE 0.01 END)) AS DOUBLE), 2) AS lexical FROM t""")
def sf36(spark: SparkSession, d: str) -> DataFrame:
    """A step of the retrieval weights by the share of disagreeing feedback, kept in [0, 1] and rounded."""
    r = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("p"), F.count_if(F.col("event_type") == "error").alias("n"))
    neg = F.col("n") / F.greatest(F.lit(1), F.col("p") + F.col("n"))
    clamp = lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 2)
    return r.select("user_id", clamp(0.62 + F.when(neg > 0.5, 0.04).when(neg < 0.3, -0.02).otherwise(0.0)).alias("semantic"), clamp(0.22 + F.when(neg > 0.5, -0.02).otherwise(0.01)).alias("lexical"))


def ordered_union(lists: list[DataFrame], key: str, pos: str, n: int) -> DataFrame:
    """The first n distinct keys of ranked lists, in list order, then by place (SO1)."""
    parts = [df.select(key, F.struct(F.lit(i).alias("list"), F.col(pos).alias("pos")).alias("at")) for i, df in enumerate(lists)]
    best = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.min("at").alias("at"))
    return best.orderBy("at", key).limit(n).select(key, F.col("at.list").alias("list"), F.col("at.pos").alias("pos"))


@query("so1_ordered_union", """WITH a AS (SELECT 'k' || (p_partkey % 50) AS k, 0 AS list, min(p_partkey) AS pos FROM part WHERE p_size > 30 GROUP BY 1), b AS (SELECT 'k' || (p_partkey % 90) AS k, 1, min(p_size) FROM part GROUP BY 1),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b), m AS (SELECT k, min({'list': list, 'pos': pos}) AS w FROM u GROUP BY k) SELECT k, CAST(w.list AS INTEGER) AS list, CAST(w.pos AS BIGINT) AS pos FROM m ORDER BY w, k LIMIT 70""")
def so1(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    a = part.where("p_size > 30").groupBy(F.expr("concat('k', p_partkey % 50)").alias("k")).agg(F.min("p_partkey").alias("pos"))
    b = part.groupBy(F.expr("concat('k', p_partkey % 90)").alias("k")).agg(F.min("p_size").cast("long").alias("pos"))
    return ordered_union([a, b], "k", "pos", 70)


@query("so2_rule_union", "SELECT coalesce(a.id, b.id) AS id, coalesce(a.title, b.title) AS title FROM (SELECT DISTINCT 'r' || n_nationkey AS id, n_name AS title FROM nation) a FULL JOIN (SELECT DISTINCT 'r' || (r_regionkey * 9) AS id, r_name AS title FROM region) b ON a.id = b.id")
def so2(spark: SparkSession, d: str) -> DataFrame:
    """Rules of two sources by id; the base wins."""
    base = table(spark, d, "nation").select(F.expr("concat('r', n_nationkey)").alias("id"), F.col("n_name").alias("title"), F.lit(0).alias("source"))
    more = table(spark, d, "region").select(F.expr("concat('r', r_regionkey * 9)").alias("id"), F.col("r_name").alias("title"), F.lit(1).alias("source"))
    return base.unionByName(more).groupBy("id").agg(F.min_by("title", "source").alias("title"))


@query("so3_token_sets", "WITH t AS (SELECT doc_id, list_distinct(string_split(text, ' ')) AS t FROM documents), b AS (SELECT t AS b FROM t WHERE doc_id = 1) SELECT doc_id, CAST(len(list_intersect(t, b)) AS BIGINT) AS common, CAST(len(list_distinct(list_concat(t, b))) AS BIGINT) AS together FROM t, b")
def so3(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the intersection and union of each document's words with the second document's."""
    t = table(spark, d, "documents").select("doc_id", F.array_distinct(F.split("text", " ")).alias("t"))
    b = t.where("doc_id = 1").select(F.col("t").alias("b"))  # one row
    return t.join(F.broadcast(b), F.lit(True)).select("doc_id", F.size(F.array_intersect("t", "b")).cast("long").alias("common"), F.size(F.array_union("t", "b")).cast("long").alias("together"))


@query("so4_distinct_concerns", "SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:3], ';') AS concerns FROM (SELECT p_partkey, list_filter([trim(p_name), trim(p_brand || ' '), trim(' ' || p_name || ' '), p_type], lambda x: x <> '') AS l FROM part)")
def so4(spark: SparkSession, d: str) -> DataFrame:
    """Distinct trimmed concerns of two sides, three at most."""
    said = F.transform(F.array(F.col("p_name"), F.concat("p_brand", F.lit(" ")), F.concat(F.lit(" "), "p_name", F.lit(" ")), F.col("p_type")), lambda x: F.trim(x))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.slice(F.array_distinct(F.filter(said, lambda x: x != "")), 1, 3), ";").alias("concerns"))


@query("so5_cross_file", "WITH f AS (SELECT l_orderkey, list_distinct(list(l_partkey)) AS p, list(DISTINCT l_partkey) FILTER (WHERE l_linenumber = 1) AS c FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN c IS NULL THEN 0 ELSE len(list_filter(p, lambda x: NOT list_contains(c, x))) END AS cross_file FROM f")
def so5(spark: SparkSession, d: str) -> DataFrame:
    """Paths with findings that aren't among the changed ones; none where nothing is known to be changed."""
    f = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("p"), F.collect_set(F.when(F.col("l_linenumber") == 1, F.col("l_partkey"))).alias("c"))
    return f.select("l_orderkey", F.when(F.size("c") == 0, 0).otherwise(F.size(F.array_except("p", "c"))).cast("long").alias("cross_file"))


@query("so6_emission_dedupe", "SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY ALL")
def so6(spark: SparkSession, d: str) -> DataFrame:
    """The first emission of each key. The cache that this replaces forgot all keys at 4,096; that isn't reproduced."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))


@query("cp9_query_text", "WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda t: length(t) % 3 = 0) AS l FROM documents) SELECT doc_id, sha256(substr(array_to_string(l[1:140], chr(10)), 1, 6000)) AS query FROM l")
def cp9(spark: SparkSession, d: str) -> DataFrame:
    """A query assembled from 140 lines of a diff at most, and 6,000 characters."""
    lines = F.filter(F.split("text", "\n"), lambda t: F.length(t) % 3 == 0)
    return table(spark, d, "documents").select("doc_id", F.sha2(F.substring(F.array_join(F.slice(lines, 1, 140), "\n"), 1, 6000), 256).alias("query"))


@query("cp10_focus_hints", """WITH h AS (SELECT 0 AS list, 'High risk: ' || p_brand AS hint, min(p_partkey) AS pos FROM part WHERE p_size > 45 GROUP BY 2 UNION ALL SELECT 1, 'Hotspot: ' || p_type, min(p_partkey) FROM part GROUP BY 2),
m AS (SELECT hint, min({'list': list, 'pos': pos}) AS w FROM h GROUP BY hint) SELECT hint, CAST(w.list AS INTEGER) AS list, CAST(w.pos AS BIGINT) AS pos FROM m ORDER BY w, hint LIMIT 14""")
def cp10(spark: SparkSession, d: str) -> DataFrame:
    """Fourteen distinct hints: risky files first, hotspots after them."""
    part = table(spark, d, "part")
    risky = part.where("p_size > 45").groupBy(F.expr("concat('High risk: ', p_brand)").alias("hint")).agg(F.min("p_partkey").alias("pos"))
    hot = part.groupBy(F.expr("concat('Hotspot: ', p_type)").alias("hint")).agg(F.min("p_partkey").alias("pos"))
    return ordered_union([risky, hot], "hint", "pos", 14)


@query("cp15_change_set", """WITH n AS (SELECT doc_id AS path, sha1(text) AS h FROM documents WHERE doc_id % 10 <> 3), o AS (SELECT doc_id AS path, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE sha1(text) END AS h FROM documents WHERE doc_id % 6 <> 5)
SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'insert' WHEN n.path IS NULL THEN 'prune' ELSE 'replace' END AS action FROM n FULL JOIN o ON n.path = o.path WHERE n.h IS DISTINCT FROM o.h""")
def cp15(spark: SparkSession, d: str) -> DataFrame:
    """What an incremental index run does: files with an unchanged hash are skipped, gone ones are pruned."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha1("text").alias("h"))
    new = docs.where("path % 10 != 3")
    old = docs.where("path % 6 != 5").select("path", F.when(F.col("path") % 4 == 0, "old").otherwise(F.col("h")).alias("o"))
    joined = new.join(old, "path", "full").where(~F.col("h").eqNullSafe(F.col("o")))
    return joined.select("path", F.when(F.col("o").isNull(), "insert").when(F.col("h").isNull(), "prune").otherwise("replace").alias("action"))


@query("cp18_consolidation", "SELECT source, CAST(count(*) AS BIGINT) AS n, string_agg(doc_id || ':' || n_chars, ',' ORDER BY doc_id DESC) AS merged FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents) WHERE r <= 5 GROUP BY source")
def cp18(spark: SparkSession, d: str) -> DataFrame:
    """The five newest memories of each group, merged into one text; the others are pruned."""
    newest = top_per(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("doc_id")], 5)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "n_chars"))), lambda x: F.concat_ws(":", x["doc_id"], x["n_chars"]))
    return newest.groupBy("source").agg(F.count("*").alias("n"), F.array_join(lines, ",").alias("merged"))


@query("st12_replace_events", "SELECT user_id % 10 AS run, event_type, count(*) AS n FROM events WHERE NOT (user_id % 10 IN (1, 2) AND event_type IN ('click', 'view')) GROUP BY ALL UNION ALL SELECT o_custkey % 10, 'click', count(*) FROM orders WHERE o_custkey % 10 IN (1, 2) GROUP BY 1")
def st12(spark: SparkSession, d: str) -> DataFrame:
    """Events of runs that are analysed again replace the earlier ones of the same kinds."""
    events = table(spark, d, "events").select((F.col("user_id") % 10).alias("run"), "event_type")
    new = table(spark, d, "orders").where("o_custkey % 10 in (1, 2)").select((F.col("o_custkey") % 10).alias("run"), F.lit("click").alias("event_type"))
    again = new.select("run", F.explode(F.array(F.lit("click"), F.lit("view"))).alias("event_type")).distinct()
    return events.join(again, ["run", "event_type"], "left_anti").unionByName(new).groupBy("run", "event_type").agg(F.count("*").alias("n"))


@query("cp11_run_quality", """WITH f AS (SELECT l_orderkey AS run, list(DISTINCT l_partkey % 30 ORDER BY l_partkey % 30) AS findings, list(DISTINCT l_suppkey % 30) AS related, list(DISTINCT l_linenumber) AS changed, list(DISTINCT l_partkey % 7 + 10) AS retrieved FROM lineitem GROUP BY 1),
c AS (SELECT run, related, retrieved, list_filter(findings, lambda x: NOT list_contains(changed, x)) AS crossing FROM f)
SELECT run, len(crossing) AS cross_file, round(CASE WHEN len(crossing) > 0 THEN len(list_filter(crossing, lambda x: list_contains(related, x))) / len(crossing) END, 6) AS recall,
round(CASE WHEN len(related) > 0 THEN len(list_filter(related, lambda x: list_contains(crossing, x) OR list_contains(retrieved, x))) / len(related) END, 6) AS supported_precision FROM c""")
def cp11(spark: SparkSession, d: str) -> DataFrame:
    """Recall of cross-file findings by related files, and the share of related files that anything supports; null without samples."""
    distinct = lambda x, name: F.collect_set(F.expr(x)).alias(name)
    f = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(distinct("l_partkey % 30", "findings"), distinct("l_suppkey % 30", "related"), distinct("cast(l_linenumber as bigint)", "changed"), distinct("l_partkey % 7 + 10", "retrieved"))
    c = f.withColumn("crossing", F.array_except("findings", "changed"))
    share = lambda hits, of: F.round(F.when(F.size(of) > 0, F.size(hits) / F.size(of)), 6)
    return c.select("run", F.size("crossing").cast("long").alias("cross_file"), share(F.array_intersect("crossing", "related"), "crossing").alias("recall"), share(F.array_intersect("related", F.array_union("crossing", "retrieved")), "related").alias("supported_precision"))


# Thresholds of the quality gate.
GATES = {"runs": 8, "recall_samples": 3, "recall": 0.55, "precision_samples": 8, "precision": 0.45, "ms": {"small": 700, "medium": 1200, "large": 2000}, "nodes": {"small": 900, "medium": 1800, "large": 2600}}
# The most files of a small and of a medium repository.
SIZES = {"small": 300, "medium": 1500}


def size_bucket(files: Column) -> Column:
    return F.when(files <= SIZES["small"], "small").when(files <= SIZES["medium"], "medium").otherwise("large")


def quality_gate(summary: DataFrame, gates: dict = GATES) -> DataFrame:
    """Add `failures`, the gates that a summary of runs misses (CP12). Too few runs or samples hide what they would measure.

    Shares are shown with three digits, halves up. `summary` has runs, recall_samples, recall, precision_samples, precision, and per size p95_ms_* and p95_nodes_*: null where no run is of that size.
    """
    c = F.col
    fail = lambda when, name, value, limit, word: F.when(when, F.concat_ws("", F.lit(name + "="), value, F.lit(f" {word} {limit}")))
    share = lambda name, shown: F.coalesce(
        fail(c(f"{name}_samples") < gates[f"{name}_samples"], f"{name}SampleCount", c(f"{name}_samples"), gates[f"{name}_samples"], "below"),
        fail(c(name) < gates[name], shown, F.format_string("%.3f", F.round(c(name), 3)), f"{gates[name]:.3f}", "below"),
    )
    high = [fail(c(f"p95_{of}_{b}") > limit, f"{shown}.{b}", c(f"p95_{of}_{b}"), limit, "above") for of, shown in (("ms", "p95TraversalMs"), ("nodes", "p95VisitedNodes")) for b, limit in gates[of].items()]
    few = fail(c("runs") < gates["runs"], "runCount", c("runs"), gates["runs"], "below")
    all_ = F.filter(F.array(share("recall", "avgCrossFileRecall"), share("precision", "avgSupportedPrecision"), *high), lambda x: x.isNotNull())
    return summary.withColumn("failures", F.array_join(F.when(c("runs") < gates["runs"], F.array(few)).otherwise(all_), "; "))


# Fixed values of the gate are spelt out here once more, apart from GATES.
_P95_SQL = ", ".join(f"coalesce(quantile_disc({of}, 0.95) FILTER (WHERE b = '{b}' AND {of} > 0), 0) AS {of}_{b}" for of in ("ms", "nodes") for b in ("small", "medium", "large"))
_HIGH_SQL = ", ".join(
    f"CASE WHEN {of}_{b} > {limit} THEN '{shown}.{b}=' || {of}_{b} || ' above {limit}' END"
    for of, shown, limits in (("ms", "p95TraversalMs", (700, 1200, 2000)), ("nodes", "p95VisitedNodes", (900, 1800, 2600)))
    for b, limit in zip(("small", "medium", "large"), limits, strict=True)
)


@query("cp12_quality_gate", f"""WITH r AS (SELECT pr_id % 400 AS repo, CASE WHEN pr_id % 400 * 8 <= 300 THEN 'small' WHEN pr_id % 400 * 8 <= 1500 THEN 'medium' ELSE 'large' END AS b, latency_ms % 2300 AS ms, run_id % 3000 AS nodes, CASE WHEN status = 'completed' THEN run_id % 10 END AS recall,
CASE WHEN status <> 'failed' THEN run_id % 9 END AS prec FROM runs),
s AS (SELECT repo, count(*) AS runs, count(recall) AS nr, coalesce(avg(recall) / 10, 0) AS recall, count(prec) AS np, coalesce(avg(prec) / 10, 0) AS prec, {_P95_SQL} FROM r GROUP BY repo)
SELECT repo, CASE WHEN runs < 8 THEN 'runCount=' || runs || ' below 8' ELSE array_to_string(list_filter([CASE WHEN nr < 3 THEN 'recallSampleCount=' || nr || ' below 3' WHEN recall < 0.55 THEN 'avgCrossFileRecall=' || printf('%.3f', round(recall, 3)) || ' below 0.550' END,
CASE WHEN np < 8 THEN 'precisionSampleCount=' || np || ' below 8' WHEN prec < 0.45 THEN 'avgSupportedPrecision=' || printf('%.3f', round(prec, 3)) || ' below 0.450' END, {_HIGH_SQL}], lambda x: x IS NOT NULL), '; ') END AS failures FROM s""")
def cp12(spark: SparkSession, d: str) -> DataFrame:
    from ..catalog import runs
    from .analytics import nearest_rank

    # eight times a repository's number stands for its files, so that all three sizes occur
    r = runs(spark, d).select(
        (F.col("pr_id") % 400).alias("repo"), size_bucket(F.col("pr_id") % 400 * 8).alias("b"), (F.col("latency_ms") % 2300).alias("ms"), (F.col("run_id") % 3000).alias("nodes"),
        F.when(F.col("status") == "completed", F.col("run_id") % 10).alias("recall"), F.when(F.col("status") != "failed", F.col("run_id") % 9).alias("precision"),
    )
    p95 = [F.coalesce(nearest_rank(f"if(b = '{b}' and {of} > 0, {of}, null)", 95).cast("long"), F.lit(0)).alias(f"p95_{of}_{b}") for of in ("ms", "nodes") for b in ("small", "medium", "large")]
    shares = [x for name in ("recall", "precision") for x in (F.count(name).alias(f"{name}_samples"), F.coalesce(F.avg(name) / 10, F.lit(0.0)).alias(name))]
    return quality_gate(r.groupBy("repo").agg(F.count("*").alias("runs"), *shares, *p95)).select("repo", "failures")


@query("ag_window_share", "SELECT source, lang, n, round(n / sum(n) OVER (PARTITION BY source), 6) AS share FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)")
def language_share(spark: SparkSession, d: str) -> DataFrame:
    """Each language's share of its repository (dashboard, beside AG2)."""
    n = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))
