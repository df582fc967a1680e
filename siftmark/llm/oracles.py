"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from .clustering import OP12_SQL
from .quality import CLASS_DISTANCE, CLASSES, COMMON, MIN_CHARS, MIN_WORDS, WORD_DISTANCE, WORDS, class_table, whole_shares, with_rest
from .topk import OP3_SQL
from .trie import OP13_SQL

_HARD = "<|im_end|><|im_start|>assistant ok"

OP1_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{_HARD}'), (-1, 1, 'assistant', '{_HARD}'))),
c AS (SELECT *, regexp_matches(text, '<\\+\|') OR contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') AS conflict, len(regexp_extract_all(text, '<\\*\|')) AS stuffed FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  bool_or(conflict) AS escaped, CAST(sum(24 + length(role) + length(text)) AS BIGINT) AS plain, CAST(sum(stuffed) AS BIGINT) AS stuffed FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, plain + CASE WHEN escaped THEN stuffed ELSE 0 END AS formatted_chars, escaped FROM g
"""

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
x AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n FROM d),
s AS (SELECT *, CASE WHEN pos <= n - 34 THEN string_agg(word, ' ') OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) END AS win FROM x),
c AS (SELECT win FROM s WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
m AS (SELECT s.*, CASE WHEN c.win IS NOT NULL THEN 1 ELSE 0 END AS dup FROM s LEFT JOIN c ON s.win = c.win),
g AS (SELECT *, max(dup) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM m),
k AS (SELECT r, count(*) AS n, CAST(sum(gone) AS BIGINT) AS removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0), '') AS kept FROM g GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""


def _map(values: dict) -> str:
    rows = ", ".join(f"'{k}': [{', '.join(repr(x) if isinstance(x, str) else f'CAST({x:.6f} AS DOUBLE)' for x in v)}]" for k, v in values.items())
    return f"MAP {{{rows}}}"


def _distance(p: str, q: str) -> str:
    half = "CASE WHEN z[{0}] > 0 THEN z[{0}] * log2(z[{0}] / ((z[1] + z[2]) / 2)) ELSE 0 END"
    return f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: ({half.format(1)} + {half.format(2)}) / 2))))"


_CLASS_REFS = _map({k: whole_shares(v) for k, v in CLASSES.items()})
_WORD_REFS = _map({k: with_rest(v) for k, v in WORDS.items()})
_COMMON = _map({k: [f" {w} " for w in v] for k, v in COMMON.items()})
_FROM, _TO = (x.replace("'", "''") for x in class_table())

OP8_SQL = rf"""
WITH d AS (SELECT doc_id, lang, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
x AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n FROM d),
s AS (SELECT r, pos, CASE WHEN pos <= n - 2 THEN string_agg(word, ' ') OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) END AS win FROM x),
m AS (SELECT *, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY r, win) > 1 THEN 1 ELSE 0 END AS dup FROM s),
g AS (SELECT r, max(dup) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS again FROM m),
k AS (SELECT r, CAST(sum(again) AS BIGINT) AS n_repeat_words FROM g GROUP BY r),
l AS (SELECT *, translate(t, '{_FROM}', '{_TO}') AS kinds, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '{_WORD}')) AS lines,
  '  ' || replace(regexp_replace(lower(t), '[\x09-\x0D.,;:!?#*$%&]', ' ', 'g'), ' ', '  ') || '  ' AS spaced, {_COMMON}[lang] AS common FROM d),
c AS (SELECT *, list_transform([0, 1, 2, 3, 4, 5, 9], lambda y: strlen(kinds) - strlen(replace(kinds, CAST(y AS VARCHAR), ''))) AS n_kinds,
  list_transform(common, lambda y: (strlen(spaced) - strlen(replace(spaced, y, ''))) // strlen(y)) AS hits FROM l),
f AS (SELECT *, n_kinds[4] AS space, n_kinds[6] AS n_symbols, length(t) - n_kinds[7] AS judged FROM c),
h AS (SELECT *, list_transform(list_concat(n_kinds[1:6], [judged - list_sum(n_kinds[1:6])]), lambda y: greatest(y, 0) / judged) AS p,
  list_transform(list_concat(hits, [greatest(0, len(w) - list_sum(hits))]), lambda y: y / len(w)) AS q FROM f),
z AS (SELECT h.*, coalesce(n_repeat_words, 0) AS n_repeat_words, CASE WHEN judged >= {MIN_CHARS} AND common IS NOT NULL THEN {_distance('p', f'{_CLASS_REFS}[lang]')} END AS cd,
  CASE WHEN len(w) >= {MIN_WORDS} AND common IS NOT NULL THEN {_distance('q', f'{_WORD_REFS}[lang]')} END AS wd FROM h LEFT JOIN k USING (r)),
o AS (SELECT *, len(w) < 50 OR 100 * n_repeat_words > 50 * len(w) AS base_failed FROM z)
SELECT doc_id, len(w) AS n_words, length(t) - space AS word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(cd, 0) <= {CLASS_DISTANCE} AND coalesce(wd, 0) <= {WORD_DISTANCE} AS kept FROM o
"""

ORACLE_SQL = {"op1_chat_round_trip": OP1_SQL, "op2_relative_lempel_ziv": OP2_SQL, "op3_norm_buckets": OP3_SQL, "op8_divergence_rules": OP8_SQL, "op12_weighted_lloyd": OP12_SQL, "op13_prefix_trie": OP13_SQL}
