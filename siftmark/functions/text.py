"""Column functions on text, paths and scores; all are built from Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in retrieval, and in the titles of findings.
STOPWORDS = ["a", "an", "the", "and", "or", "to", "of", "in", "on", "for", "is", "are", "be", "from", "by", "with", "this", "that", "it", "as"]
NOISE = ["the", "and", "for", "with", "from", "that", "this", "have", "has", "into", "when", "where", "should", "could", "would", "runs", "run"]


def search_tokens(x: Column) -> Column:
    """Distinct lower-case tokens of two or more characters, without stopwords (SF1)."""
    parts = F.filter(F.split(F.lower(x), r"[^a-z0-9_./-]+"), lambda t: (F.length(t) >= 2) & ~t.isin(STOPWORDS))
    return F.array_distinct(parts)


def title_tokens(x: Column) -> Column:
    """Distinct alphanumeric tokens of three or more characters, without noise words (SF4)."""
    parts = F.filter(F.split(F.lower(x), r"[^a-z0-9]+"), lambda t: (F.length(t) >= 3) & ~t.isin(NOISE))
    return F.array_distinct(parts)


def overlap_score(a: Column, b: Column) -> Column:
    """Common tokens over the root of both sizes; 0 where either is empty (SF2)."""
    both = F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a) * F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Common tokens over all tokens; 0 where either is empty (SF4, SO3)."""
    both = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both).otherwise(0.0)


def line_proximity(distance: Column) -> Column:
    """Steps of nearness of two lines (SF5)."""
    return F.when(distance <= 2, 1.0).when(distance <= 6, 0.9).when(distance <= 12, 0.75).when(distance <= 25, 0.55).otherwise(0.3)


def repo_path(x: Column) -> Column:
    """A path with forward slashes, without a leading ./ or /, and without doubled slashes (SF7)."""
    slashed = F.regexp_replace(F.trim(x), r"\\", "/")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(slashed, r"^\./", ""), "^/", ""), "/+", "/")


def graph_path(x: Column) -> Column:
    """A path as the graph has it: a leading slash stays (SF7, second form)."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\\", "/"), r"^\./", ""), "/+", "/")


def structural_path(x: Column) -> Column:
    """A path as the structural scorer has it: every ./ goes, leading slashes go, doubled slashes are replaced once (SF7, third form)."""
    plain = F.replace(F.replace(F.trim(x), F.lit("\\"), F.lit("/")), F.lit("./"), F.lit(""))
    return F.replace(F.ltrim(plain, F.lit("/")), F.lit("//"), F.lit("/"))


def clean_weight(x: Column, other: float) -> Column:
    """A weight in [0, 1]: null and non-finite values give the default, negative ones 0 (SF37)."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))).otherwise(float(other))


def bounded_int(x: Column, other: int, least: int, most: int) -> Column:
    """A text's number within bounds, without its fraction; what is no finite number gives the default (TK11)."""
    n = x.try_cast("double")
    finite = n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
    whole = F.when(n < 0, F.ceil(n)).otherwise(F.floor(n))
    return F.when(finite, F.least(F.lit(most), F.greatest(F.lit(least), whole))).otherwise(other).cast("long")


def directory(path: Column) -> Column:
    """What stands before the last slash; empty if there is none (SF8)."""
    return F.regexp_replace(F.when(F.instr(path, "/") > 0, path).otherwise(""), "/[^/]*$", "")


def ancestors(path: Column) -> Column:
    """Directories of a path from the nearest up; empty for a bare name (SF8)."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    return F.when(depth > 0, F.transform(F.sequence(depth, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def module_of(path: Column) -> Column:
    """The top-level directory, or (root) (SF9)."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise("(root)")


def path_hints(x: Column) -> Column:
    """The first eight distinct words of a query that look like paths (SF10)."""
    words = F.transform(F.split(F.lower(x), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9_./-]", ""))
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.contains(w, F.lit("/")) | F.contains(w, F.lit("."))) & (F.length(w) >= 3))), 1, 8)


def plain_title(x: Column) -> Column:
    """A title in lower case, with one space for every run of other characters (SF14)."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def semantic_key(path: Column, category: Column, title: Column) -> Column:
    """Key of a finding that survives rewording of punctuation (SF14)."""
    return F.concat_ws("|", path, category, plain_title(title))


def churn_risk(lines: Column) -> Column:
    """Risk of a change by its size (SF22)."""
    return F.when(lines >= 250, "high").when(lines >= 80, "medium").otherwise("low")


def approximate_tokens(x: Column) -> Column:
    """A quarter of the bytes, rounded up (SF28)."""
    return F.floor((F.octet_length(x) + 3) / 4).cast("long")


def redact(x: Column) -> Column:
    """Texts without keys, tokens and assigned secrets (SF30)."""
    # Patterns in their order of use.
    x = F.regexp_replace(x, r"sk-[A-Za-z0-9]{20,}", "[REDACTED_SECRET]")
    x = F.regexp_replace(x, r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED_SECRET]")
    x = F.regexp_replace(x, r"(?i)\bBearer\s+[A-Za-z0-9._\-]{16,}\b", "Bearer [REDACTED_SECRET]")
    return F.regexp_replace(x, r"""(?i)\b(api[_-]?key|token|secret|password)\b(\s*[:=]\s*)(["']?)[^\s"']{8,}""", "$1$2$3[REDACTED_SECRET]")


def weight(addressed: Column, ignored: Column, positive: Column, negative: Column) -> Column:
    """Learned weight of a category or rule in [-1, 1] (AG11)."""
    outcomes, reactions = addressed + ignored, positive + negative
    outcome = (addressed - ignored) / (outcomes + 1)
    reaction = (positive - negative) / (reactions + 1)
    blend = F.when((outcomes > 0) & (reactions > 0), outcome * 0.6 + reaction * 0.4).when(outcomes > 0, outcome).otherwise(reaction)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), blend))


# Categories whose weight never falls below 0.
PROTECTED = ["security", "injection", "authz", "xss", "sql injection"]


def is_protected(key: Column) -> Column:
    """Whether a key is a protected category, or a rule of one (FP14)."""
    lower = F.lower(key)
    return F.exists(F.array(*map(F.lit, PROTECTED)), lambda p: (lower == p) | F.startswith(lower, F.concat(p, F.lit(":"))))


# Parts of a comment's priority.
SEVERITY = {"blocking": 100.0, "important": 65.0, "nit": 25.0}
CONFIDENCE = {"high": 1.0, "medium": 0.7, "low": 0.35}
CATEGORY = {"security": 25.0, "bug": 20.0, "performance": 15.0, "testing": 12.0, "maintainability": 8.0, "style": 2.0}


def looked_up(values: dict[str, float], key: Column, other: float | None = None) -> Column:
    pairs = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return F.coalesce(pairs[key], F.lit(other)) if other is not None else pairs[key]


def rounded(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)
