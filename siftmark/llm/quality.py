"""Operator 8: quality rules by distribution divergence.

Native: DataFrame and SQL functions only. A document's histograms of character
classes and of common words are compared with references of its language by the
Jensen-Shannon distance (base 2, 0 to 1). A distance over its threshold rejects the document;
texts that are too short for a histogram are not judged by it.
All of it is within one row: no shuffle, and no row depends on another.

The references are a model: `fit_references` makes them of a bounded sample of labelled
documents. Those below were fitted so.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Common words by language.
COMMON = {
    "en": "the of and to a in is that it for was on with as by be this are at from".split(),
    "de": "der die und in den von zu das mit sich des auf ein für ist im dem nicht eine als".split(),
    "fr": "de la le et les des en un du une que pour est dans qui par sur pas au avec".split(),
    "es": "de la que el en y los se las del un por con no una su para al es lo".split(),
}
#: Shares of character classes by language: lower-case vowels, other lower-case letters, upper-case letters, white space,
#: punctuation, symbols, anything else but digits (numbers say little about prose). From `fit_references`.
CLASSES = {
    "en": (0.3085, 0.4873, 0.0138, 0.1667, 0.0237, 0.0, 0.0),
    "de": (0.3351, 0.4756, 0.0128, 0.1547, 0.0218, 0.0, 0.0),
    "fr": (0.482, 0.3133, 0.014, 0.1668, 0.0239, 0.0, 0.0),
    "es": (0.4083, 0.3934, 0.0135, 0.1618, 0.023, 0.0, 0.0),
}
#: Shares of the common words in all words, in their order. From `fit_references`.
WORDS = {
    "en": (0.0632, 0.0364, 0.0266, 0.0199, 0.0155, 0.014, 0.0116, 0.0104, 0.0094, 0.0086, 0.008, 0.0072, 0.0067, 0.0059, 0.0056, 0.0055, 0.0055, 0.0052, 0.0045, 0.0044),
    "de": (0.0622, 0.0366, 0.0263, 0.02, 0.0162, 0.0136, 0.0111, 0.0109, 0.0094, 0.0084, 0.0079, 0.0072, 0.005, 0.0066, 0.006, 0.0056, 0.0056, 0.0054, 0.0049, 0.0042),
    "fr": (0.0625, 0.0378, 0.0253, 0.0208, 0.0164, 0.014, 0.0125, 0.0108, 0.0091, 0.008, 0.0077, 0.0074, 0.0071, 0.0058, 0.0057, 0.0052, 0.0051, 0.0049, 0.0047, 0.0046),
    "es": (0.0622, 0.0364, 0.0255, 0.0199, 0.0163, 0.0137, 0.0116, 0.0102, 0.0095, 0.0092, 0.0081, 0.0077, 0.0067, 0.0066, 0.0057, 0.0057, 0.0056, 0.0049, 0.0049, 0.0043),
}
#: The largest distances of a document that is kept, and the characters and words below which a histogram is not judged.
CLASS_DISTANCE, MIN_CHARS = 0.13, 200
WORD_DISTANCE, MIN_WORDS = 0.3, 100
#: Most documents of a language that references are fitted on.
FITTED = 1000

_BLANKS = "\t\n\x0b\x0c\r "
_ENDS = ".,;:!?#*$%&"


def class_table() -> tuple[str, str]:
    """Characters up to U+017F and the digit of their class: 0 to 5 in the order of CLASSES, 9 for digits. Others stay as they are."""
    known = {}
    for c in map(chr, range(9, 0x180)):
        kind = unicodedata.category(c)
        if c in _BLANKS:
            known[c] = "3"
        elif c in ".,;:!?()\"'-":
            known[c] = "4"
        elif c in "#*$%&|<>":
            known[c] = "5"
        elif "0" <= c <= "9":
            known[c] = "9"
        elif kind == "Lu":
            known[c] = "2"
        elif kind == "Ll":
            known[c] = "0" if unicodedata.normalize("NFD", c)[0] in "aeiouyæœø" else "1"
        elif c < "\x7f":
            known[c] = "8"
    return "".join(known), "".join(known.values())


def _replaced(x: Column, chars: str) -> Column:
    for c in chars:
        x = F.replace(x, F.lit(c), F.lit(" "))
    return x


def _count(x: str, kind: str) -> str:
    """How often the character `kind` is in `x`, by bytes."""
    return f"(octet_length({x}) - octet_length(replace({x}, '{kind}', '')))"


def _by_language(values: dict, kind: T.DataType) -> Column:
    """A literal map of language to a list."""
    return F.create_map(*(x for lang, own in values.items() for x in (F.lit(lang), F.array(*(F.lit(v) for v in own)).cast(T.ArrayType(kind)))))


def js_distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two arrays of shares, base 2; null if one is null."""
    half = lambda x, m: f"if({x} > 0, {x} * log2({x} / {m}), 0D)"
    m = "((x + y) / 2)"
    known = f"{p} is not null and {q} is not null"
    return F.expr(f"if({known}, sqrt(greatest(0D, aggregate(zip_with({p}, {q}, (x, y) -> ({half('x', m)} + {half('y', m)}) / 2), 0D, (s, x) -> s + x))), null)")


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add `_text`, `_plain` (blanks as spaces), `_classes` and the counts of the base rules: word_chars, n_words, n_symbols, n_dup_lines, n_repeat_words.

    Words are runs of other than ASCII white space. Three-word windows are compared by a 64-bit hash.
    """
    out = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns({"_plain": _replaced(F.col("_text"), _BLANKS[:-1]), "_classes": F.translate("_text", *class_table())})
    out = out.withColumn("_words", F.expr("array_remove(split(_plain, ' '), '')"))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != ""))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    out = out.withColumn("_windows", F.expr("if(n_words < 3, array(), transform(slice(_words, 1, greatest(size(_words) - 2, 0)), (w, i) -> xxhash64(w, _words[i + 1], _words[i + 2])))"))
    # windows sorted by hash: those equal to a neighbour, by place; each covers the words up to the next one's, three at most
    repeated = """transform(array(sort_array(transform(_windows, (h, i) -> struct(h, i)))), s ->
        array_sort(transform(filter(transform(s, (x, k) -> struct(x.i AS i, (k > 0 AND s[k - 1].h = x.h) OR (k < size(s) - 1 AND s[k + 1].h = x.h) AS twice)), x -> x.twice), x -> x.i)))[0]"""
    covered = f"aggregate(transform(array({repeated}), p -> transform(p, (x, k) -> if(k < size(p) - 1, least(3, p[k + 1] - x), 3)))[0], 0, (s, x) -> s + x)"
    return out.withColumns({
        "word_chars": F.expr(f"length(_text) - {_count('_classes', '3')}").cast("long"),
        "n_symbols": F.expr(_count("_classes", "5")).cast("long"),
        "n_dup_lines": F.expr("size(_lines) - size(array_distinct(_lines))").cast("long"),
        "n_repeat_words": F.expr(f"if(size(array_distinct(_windows)) = size(_windows), 0, {covered})").cast("long"),
    })


def _histograms(df: DataFrame, lang: str) -> DataFrame:
    """Add to `text_counts`: `_judged` (characters but digits), `_counts` of the classes, `_hits` of the language's common words (null for other languages)."""
    out = df.withColumn("_judged", F.expr(f"length(_text) - {_count('_classes', '9')}"))
    out = out.withColumn("_counts", F.expr(f"array({', '.join(_count('_classes', str(k)) for k in range(6))})"))
    out = out.withColumn("_counts", F.expr("array_append(_counts, _judged - aggregate(_counts, 0, (s, x) -> s + x))"))
    # every word between two spaces of its own
    spaced = F.concat(F.lit("  "), F.replace(_replaced(F.lower("_plain"), _ENDS), F.lit(" "), F.lit("  ")), F.lit("  "))
    out = out.withColumn("_spaced", spaced).withColumn("_common", _by_language({k: [f" {w} " for w in v] for k, v in COMMON.items()}, T.StringType())[F.col(lang)])
    return out.withColumn("_hits", F.expr("transform(_common, c -> (octet_length(_spaced) - octet_length(replace(_spaced, c, ''))) div octet_length(c))"))


def fit_references(df: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", most: int = FITTED) -> tuple[dict, dict]:
    """CLASSES and WORDS of the languages in COMMON: shares over all characters and words of good documents, of each language
    the `most` with the smallest hash of their id. A language without documents has no reference. Null texts are empty, null languages left out."""
    rank = F.row_number().over(Window.partitionBy(lang).orderBy(F.xxhash64(id), id))
    sample = df.where(F.col(lang).isin(*COMMON)).select(text, lang, rank.alias("_rank")).where(F.col("_rank") <= most)
    counted = _histograms(text_counts(sample, text), lang).select(lang, "n_words", "_judged", "_counts", "_hits")
    sums = counted.groupBy(lang).agg(F.sum("_judged"), F.sum("n_words"), *(F.sum(F.col("_counts")[k]) for k in range(7)), *(F.sum(F.col("_hits")[k]) for k in range(len(COMMON["en"]))))
    classes, words = {}, {}
    for key, judged, n, *rest in sorted(map(tuple, sums.collect())):
        classes[key] = tuple(round(x / judged, 4) for x in rest[:7])
        words[key] = tuple(round(x / n, 4) for x in rest[7:])
    return classes, words


def judge_quality(df: DataFrame, text: str = "text", lang: str = "lang", references: tuple[dict, dict] = (CLASSES, WORDS)) -> DataFrame:
    """All columns of `df` with word_chars, n_words, n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance, base_failed and kept.

    The new names replace columns of the same name. A null or empty text has no words and fails the
    base rules. A distance is null where its text is too short, or where a null or other language has no reference: then
    it doesn't reject. Repeated rows get equal verdicts, an empty table gives no rows.
    """
    new = ["word_chars", "n_words", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept"]
    kept = [c for c in df.columns if c not in new]
    # the row's own columns travel as one value, so that names can't clash
    out = _histograms(text_counts(df.select(F.struct(*kept).alias("own"), F.col(text).alias("text"), F.col(lang).alias("lang")), "text"), "lang")
    classes, words = ({k: shares(v) for k, v in x.items()} for x, shares in zip(references, (whole_shares, with_rest), strict=True))
    out = out.withColumns({
        "_shares": F.expr("transform(_counts, x -> coalesce(try_divide(greatest(x, 0), _judged), 0D))"),
        "_word_shares": F.expr("transform(array_append(_hits, greatest(0, n_words - aggregate(_hits, 0L, (s, x) -> s + x))), x -> coalesce(try_divide(x, n_words), 0D))"),
        "_class_reference": _by_language(classes, T.DoubleType())[F.col("lang")],
        "_word_reference": _by_language(words, T.DoubleType())[F.col("lang")],
    })
    out = out.withColumns({
        "class_distance": F.when(F.col("_judged") >= MIN_CHARS, js_distance("_shares", "_class_reference")),
        "word_distance": F.when(F.col("n_words") >= MIN_WORDS, js_distance("_word_shares", "_word_reference")),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })
    far = (F.coalesce("class_distance", F.lit(0.0)) > CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > WORD_DISTANCE)
    return out.withColumn("kept", ~F.col("base_failed") & ~far).select(*(F.col("own")[c].alias(c) for c in kept), *new)


def whole_shares(shares: tuple[float, ...]) -> list[float]:
    """Shares that add up to one."""
    return [round(x / sum(shares), 6) for x in shares]


def with_rest(shares: tuple[float, ...]) -> list[float]:
    """Shares of words, and that of all others."""
    return [*shares, round(1 - sum(shares), 6)]


def drop_rejected(df: DataFrame, text: str = "text", lang: str = "lang", references: tuple[dict, dict] = (CLASSES, WORDS)) -> DataFrame:
    """The rows of `df` that `judge_quality` keeps, with the columns of `df`.

    A verdict gives one or no row by explode(): a filter on it would be pushed down through all
    steps of the verdict, and each step's expression copied into the next.
    """
    judged = judge_quality(df, text, lang, references)
    return judged.select(*df.columns, F.explode(F.expr("if(kept, array(true), cast(array() as array<boolean>))"))).drop("col")


def op8_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base rules and the verdict of every document; see `judge_quality`."""
    out = judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
