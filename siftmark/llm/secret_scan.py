"""Operator 6: secret scans by pattern and by dictionary-primed zstandard novelty.

Base patterns find assignments, access key ids and hexadecimal strings. Besides,
each long string near a sensitive word is a candidate: it is compressed after
its surroundings, by a compressor that is primed with identifiers: those that code is
made of anywhere, and those that occur near sensitive words in the table itself. A string that adds
almost as many bytes as random characters of its alphabet would can't be put together from code,
prose or names nearby, and is reported.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from math import log2
from random import Random

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import slices

# Patterns of the base kinds, in their order; the shortest lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16}")
KINDS = ("assign", "access", "hex", "novel")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

_WORDS = "passw|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|authorization|bearer|signature|AKIA"
# what one of these words holds at least, in lower case
_STEMS = ("passw", "passphrase", "secret", "token", "key", "credential", "authorization", "bearer", "signature", "akia")
SENSITIVE = re.compile(_WORDS, re.ASCII | re.IGNORECASE)
#: Candidates are parts of such runs, with MIN_NOVEL characters or more.
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
MIN_NOVEL = 16
# Names that code is made of, joined to one dictionary.
IDENTIFIERS = (
    "abstract access account address algorithm allocate application argument array assert async attribute authorization await background base64 "
    "boolean buffer button callback certificate character checksum class client collection column command component config configuration "
    "connection const constructor container context controller counter create credential current database datetime default define delete "
    "description destination develop dictionary directory document domain double element encode endpoint entity enumerate environment "
    "error event example exception execute export extends factory field filename filter final float folder format function generate "
    "getElementById global handler hash header height hostname identifier implements import index initialize input insert instance integer "
    "interface internal iterator javascript keyboard label lambda language length library listener localhost location manager master memory "
    "message metadata method middleware migration module namespace network number object operator option package parameter parent parse password "
    "path pattern payload permission pipeline pointer port prefix private process production profile property protected protocol provider public "
    "query queue random receiver record reference register release remote render repository request resource response result return "
    "schema scope script secret section select sequence serialize server service session settings signature socket source staging static status "
    "storage stream string struct subscription suffix switch system table target template test thread timeout timestamp token transaction "
    "transform type undefined update upload url user username uuid validate value variable vector version virtual void widget window worker "
    "https://www.example.com/api/v1/ http://localhost:8080/ 127.0.0.1 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 2024-01-01T00:00:00"
)
#: Characters before a candidate in which a sensitive word counts, and characters of context.
NEAR, CONTEXT = 48, 512
#: Least marginal bytes, as a share of what random characters of the same alphabet need: the compressor knows how often names have
#: each letter, so random letters cost it more than that; over long strings it learns their own shares, and comes down to 1.
NOVEL, NOVEL_MORE, NOVEL_LENGTH = 1.0, 0.15, 64
#: Ordinary text beside every candidate, so that a short document gives the compressor something to go by.
ORDINARY = "This is how to set up the service: read the manual, choose good values, keep them where only you can find them, and ask somebody before you change them.\n"
#: Most identifiers of the table that prime the compressor; they are counted over all rows.
IDENTIFIERS_KEPT = 4096


def _alphabet_bytes(found: str) -> float:
    """Bytes a character of a random string with the kinds of characters that `found` has."""
    kinds = set(found)
    letters = {c for c in kinds if c.isalpha()}
    size = 10 * any(c.isdigit() for c in kinds) + len(kinds & set("+/_=.-"))
    for first, last in (("A", "Z"), ("a", "z")):
        own = {c for c in letters if first <= c <= last}
        size += (6 if max(own) <= chr(ord(first) + 5) else 26) if own else 0
    return log2(max(size, 2)) / 8


def _samples(identifiers: str) -> list[bytes]:
    """Names as code writes them, to train a dictionary on: the same for the same identifiers."""
    names, r = identifiers.split(), Random(6)
    out = []
    for _ in range(2000):
        a, b, c, d, e, f, g, h, i, j, k, m = r.choices(names, k=12)
        x, y, z = r.randrange(10), r.randrange(1, 13), r.randrange(1, 29)
        out.append(f"{a}_{b} {c}{d.capitalize()} {e}.{f} {g}-{h} {i.upper()}_{j.upper()} /{k}/{m} 202{x}-{y:02}-{z:02} v{x}.{y}.{z}\n".encode())
    return out


class Novelty:
    """Marginal compressed bytes of strings, after a dictionary and their context."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        import zstandard

        trained = zstandard.train_dictionary(1 << 15, _samples(identifiers))
        self.compress = zstandard.ZstdCompressor(level=9, dict_data=trained, write_content_size=False, write_dict_id=False).compress

    def share(self, text: str, start: int, end: int) -> float:
        """Bytes that a string adds, as a share of those of a random one."""
        before, found, after = text[max(0, start - CONTEXT) : start], text[start:end], text[end : end + CONTEXT]
        found = found.lower() if found.isupper() else found  # in capitals throughout, case says nothing
        around = f"{ORDINARY}{before}\n{after}\n".encode(errors="surrogatepass")
        return (len(self.compress(around + found.encode())) - len(self.compress(around))) / (len(found) * _alphabet_bytes(found))

    def is_novel(self, text: str, start: int, end: int) -> bool:
        found = text[start:end]
        return any(map(str.isalpha, found)) and self.share(text, start, end) >= NOVEL + NOVEL_MORE * min(1, NOVEL_LENGTH / len(found))


@lru_cache(maxsize=4)
def _novelty(identifiers: str) -> Novelty:
    return Novelty(identifiers)


def corpus_identifiers(df: DataFrame, text: str = "text", most: int = IDENTIFIERS_KEPT) -> str:
    """The dictionary: IDENTIFIERS, then the `most` most frequent names of 4 to 15 letters or underscores near sensitive words, counted over
    all rows. Candidates are longer, so that no secret gets into it whole, however often its document is copied. Rarer names come first:
    the compressor reaches what is near the end at less cost. No rows give IDENTIFIERS alone.
    """
    near = F.expr(f"regexp_extract_all({'`' + text + '`'}, '(?i)(?:{_WORDS})[^\\\\n]{{0,{NEAR * 2}}}', 0)")
    some = F.expr(" or ".join(f"contains(_low, '{x}')" for x in _STEMS))
    names = df.select(F.col(text), F.lower(text).alias("_low")).where(some).select(F.explode(near).alias("near")).select(F.explode(F.expr("regexp_extract_all(near, '(?<![A-Za-z_])[A-Za-z_]{4,15}(?![A-Za-z_])', 0)")).alias("name"))
    # `most` names at the most come to the driver
    kept = names.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "name").limit(most).collect()
    return " ".join([IDENTIFIERS, *(r["name"] for r in reversed(kept))])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, ordered."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    at = 0
    while m := LONG_HEX.search(text, at):  # the first long run: it begins where its run begins
        at = HEX.match(text, m.start()).end()
        found.append((m.start(), 2, at))
    return sorted(found)


def candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, run) of the strings that are judged: what stands between the sensitive words of a run of key characters, where
    a sensitive word ends at most NEAR characters before. Strings of one run have its start in common. One pass over the text."""
    words = [(m.start(), m.end()) for m in SENSITIVE.finditer(text)]
    i = 0
    for run in RUN.finditer(text) if words else ():
        at, end = run.span()
        while i < len(words) and words[i][1] <= at:
            i += 1
        near, j = i > 0 and at - words[i - 1][1] <= NEAR, i
        while True:
            inside = j < len(words) and words[j][0] < end
            a, b = at, words[j][0] if inside else end
            if near:
                found = text[a:b]
                a, b = b - len(found.lstrip("=._-")), a + len(found.rstrip("."))
                if b - a >= MIN_NOVEL:
                    yield a, b, run.start()
            if not inside:
                break
            at, near, j = words[j][1], True, j + 1


def _disjoint(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int], list[int]]:
    """Starts and ends of what ordered spans cover together, and the characters covered before each."""
    starts: list[int] = []
    ends: list[int] = []
    for a, _, b in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends, [0, *accumulate(b - a for a, b in zip(starts, ends, strict=True))]


def novel_spans(text: str, base: list[tuple[int, int, int]], identifiers: str = IDENTIFIERS) -> list[tuple[int, int, int]]:
    """(start, kind, end) of incompressible strings near a sensitive word of which base spans cover less than half.

    Two of them that only a sensitive word parts are one: a long key can hold such a word by chance.
    """
    found: list[tuple[int, int, int]] = []
    starts, ends, before = _disjoint(base)
    last, judge = None, None

    def below(x: int) -> int:
        """Characters before `x` that base spans cover."""
        i = bisect_right(starts, x) - 1
        return before[i] + min(x, ends[i]) - starts[i] if i >= 0 else 0

    for a, b, run in candidates(text):
        covered = below(b) - below(a)
        judge = judge or _novelty(identifiers)
        if 2 * covered >= b - a or not judge.is_novel(text, a, b):
            continue
        if found and last == run and SENSITIVE.fullmatch(text, found[-1][2], a):
            a = found.pop()[0]
        found.append((a, 3, b))
        last = run
    return found


def scan_secrets(df: DataFrame, text: str = "text", columns: tuple[str, ...] = ("doc_id",), identifiers: str | None = None) -> DataFrame:
    """`columns` and `spans` (array of kind, start, end: code points, end exclusive; by start, then kind) of every whole text.

    `identifiers` primes the compressor; by default they are those of the table (`corpus_identifiers`, a first pass). A null or empty text has no spans. Each row is scanned by itself, so repeated rows have equal
    spans and no rows give none. Other columns of `df` are dropped, so names can't clash.
    """

    known = corpus_identifiers(df, text) if identifiers is None else identifiers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            for rows in slices(batch, "_text"):
                out = []
                for x in rows.column("_text").to_pylist():
                    base = base_spans(x or "")
                    out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(base + novel_spans(x or "", base, known))])
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), pa.array(out, pa.list_(kind))], [*columns, "spans"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return df.select(*columns, F.col(text).alias("_text")).mapInArrow(run, f"{schema}, spans array<struct<kind:string,start:int,end:int>>")


def mask_secrets(df: DataFrame, text: str = "text", mark: str = "<secret>", identifiers: str | None = None) -> DataFrame:
    """All columns of `df`, with every span of its texts replaced by `mark`; overlapping spans are replaced as one.

    `identifiers` as in `scan_secrets`. A null text stays null, an empty one empty; repeated rows are masked alike; no rows give none.
    """
    names, known = df.columns, corpus_identifiers(df, text) if identifiers is None else identifiers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, text):
                out = []
                for x in rows.column(text).to_pylist():
                    base = base_spans(x or "")
                    parts, at = [], 0
                    for a, _, b in sorted(base + novel_spans(x or "", base, known)):
                        if a >= at:
                            parts += [x[at:a], mark]
                        at = max(at, b)
                    out.append(x if x is None else "".join([*parts, x[at:]]))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else rows.column(c) for c in names], names)

    return df.mapInArrow(run, df.schema)


def op6_zstd_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans and counts of the secrets of every document, each by its row; a null or empty text has none. No rows give none."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.expr(f"size(filter(spans, s -> s.kind = '{kind}'))").cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")
    return found.select(
        "doc_id",
        *map(count, KINDS[:3]),
        F.sha2(joined("filter(spans, s -> s.kind != 'novel')"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        count("novel"),
    )
