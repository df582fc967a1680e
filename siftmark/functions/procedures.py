"""Text procedures that carry state from line to line, as Arrow-batched functions (SF15, SF16, SF21, SF29, SF32, SC13).

Each row is handled by itself in batches of its partition; nothing is shuffled.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, id: str, text: str, rows_of: Callable[[str], list[tuple]], fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """`id` with the fields of every row that `rows_of` makes of a text; a null text is empty."""
    names = [id, *(f[0] for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *row) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in rows_of(x or "")]
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            types = [batch.schema.field(0).type, *(f[1] for f in fields)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = f"{id} {df.schema[id].dataType.simpleString()}, " + ", ".join(f"{n} {s}" for n, _, s in fields)
    return df.select(F.col(id), F.col(text)).mapInArrow(run, schema)


def chunks(text: str, most: int = 1800, overlap: int = 220, count: int = 20) -> list[tuple[int, int, int, str]]:
    """(index, first line, last line, text) of chunks within a budget of characters that overlap by whole lines (SF15).

    A line over the budget is cut into pieces that overlap by characters. The last allowed chunk takes what is left, up to twice
    the budget. Blank text has no chunks.
    """
    most = max(300, most)
    overlap, count = max(0, min(most - 50, overlap)), max(1, count)
    text = text.replace("\r\n", "\n")
    if not text.strip():
        return []
    lines = text.split("\n")
    if len(text) <= most:
        return [(0, 1, len(lines), text)]
    out: list[tuple[int, int, int, str]] = []
    at = 0
    while at < len(lines):
        first = at
        if len(lines[at]) + 1 > most:
            piece, rest = lines[at][:most], lines[at][most - overlap :]
            taken = [piece]
            if rest:
                lines[at] = rest
            else:
                at += 1
        else:
            size = 0
            while at < len(lines) and size + len(lines[at]) + 1 <= most:
                size += len(lines[at]) + 1
                at += 1
            taken = lines[first:at]
        out.append((len(out), first + 1, first + len(taken), "\n".join(taken)))
        if len(out) == count:
            if at < len(lines):
                i, a, _, body = out[-1]
                out[-1] = (i, a, len(lines), (body + "\n" + "\n".join(lines[at:]))[: 2 * most])
            break
        if at < len(lines) and overlap and len(taken) > 1:
            back = size = 0
            while back < len(taken) - 1 and size < overlap:
                back += 1
                size += len(taken[-back]) + 1
            at = max(first, at - back)
    return out


def text_chunks(df: DataFrame, id: str = "id", text: str = "text", most: int = 1800, overlap: int = 220, count: int = 20) -> DataFrame:
    fields = [("index", pa.int32(), "int"), ("first_line", pa.int32(), "int"), ("last_line", pa.int32(), "int"), ("chunk", pa.string(), "string")]
    return exploded(df, id, text, lambda x: chunks(x, most, overlap, count), fields)


# Import and export statements by language; the first group is the name.
STATEMENTS = {
    "import": [r"""\bimport\s++(?!import\b)(?:[^'"\n;]+?\s+from\s+)?['"]([^'"\n]+)['"]""", r"""\brequire\(\s*['"]([^'"\n]+)['"]\s*\)""", r"(?m)^\s*from\s+([\w.]+)\s+import\b", r"(?m)^\s*import\s+([\w.]+)\s*$", r"(?m)^\s*use\s+([\w:]+)"],
    "export": [r"(?m)(?:^|(?<=[;{}/]))\s*export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|interface|type|enum)\s+(\w+)", r"(?m)^\s*pub\s+(?:fn|struct|enum|trait)\s+(\w+)"],
}


def statements(text: str) -> list[tuple[str, str, int]]:
    """(kind, name, line) of imports and exports, by pattern (SF16). A statement's line is that of its first word, whatever blank lines stand before it."""
    found = [(m.end() - len(m[0].lstrip()), kind, m[1]) for kind, patterns in STATEMENTS.items() for p in patterns for m in re.finditer(p, text)]
    return [(kind, name, text.count("\n", 0, at) + 1) for at, kind, name in sorted(found)]


def python_symbols(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, name, first line, last line) of a Python text's functions and classes (SF17 for one language); none if it doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
    return [(kinds[type(n)], n.name, n.lineno, n.end_lineno) for n in ast.walk(tree) if type(n) in kinds]


def diff_lines(patch: str) -> list[tuple[str, str, int, str]]:
    """(path, side, line, hunk hash) of every line that a unified diff shows on either side (SF21)."""
    out: list[tuple[str, str, int, str]] = []
    path = ""
    for block in re.split(r"(?m)^(?=\+\+\+ |@@ )", patch):
        if block.startswith("+++ "):
            path = re.sub(r"^[ab]/", "", block.split("\n", 1)[0][4:].strip())
        elif m := re.match(r"@@\s+-(\d+)(?:,\d+)?\s+\+(\d+)(?:,\d+)?\s+@@", block):
            body = [x for x in block.split("\n")[1:] if x[:1] in ("+", "-", " ") and not re.match(r"(---|diff|index) ", x)]
            digest = hashlib.sha256("\n".join(body).encode()).hexdigest()
            left, right = int(m[1]), int(m[2])
            for x in body:
                if x[0] != "+":
                    out.append((path, "LEFT", left, digest))
                    left += 1
                if x[0] != "-":
                    out.append((path, "RIGHT", right, digest))
                    right += 1
    return out


def middle_cut(text: str, most: int) -> str:
    """A text within `most` UTF-8 bytes on either end together, with a mark for what is left out of its middle (SF29)."""
    raw = text.encode()
    if len(raw) <= most:
        return text
    head = raw[: most // 2].decode(errors="ignore")
    tail = raw[len(raw) - (most - most // 2) :].lstrip(bytes(range(0x80, 0xC0))).decode()
    return f"{head}…{len(text) - len(head) - len(tail)} chars truncated…{tail}"


# Typographic characters and what they stand for when lines are compared.
PLAIN = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "‐": "-", "‑": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", "　": " "})


def find_lines(lines: list[str], pattern: list[str], start: int = 0) -> int | None:
    """Where a run of lines stands at or after `start`: as it is, then without trailing blanks, without blanks around, in plain characters (SF32)."""
    if not pattern:
        return start
    for form in (str, str.rstrip, str.strip, lambda x: x.strip().translate(PLAIN)):
        wanted, there = [form(x) for x in pattern], [form(x) for x in lines]
        for i in range(start, len(lines) - len(pattern) + 1):
            if there[i : i + len(pattern)] == wanted:
                return i
    return None


def json_values(text: str) -> Iterator[object]:
    """Values of a noisy text, most likely first: all of it, fenced blocks, then each balanced block (SC13)."""
    yield from filter(None, map(_parsed, [text.strip(), *re.findall(r"```(?:json)?\s*\n(.*?)```", text, re.DOTALL)]))
    decoder = json.JSONDecoder()
    at = 0
    while (m := re.compile(r"[{\[]").search(text, at)) is not None:
        try:
            value, at = decoder.raw_decode(text, m.start())
            yield value
        except ValueError:
            at = m.start() + 1


def _parsed(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        return None


def find_json(text: str, keys: set[str]) -> dict | None:
    """The first object that has the keys, breadth first within each value of a noisy text."""
    for value in json_values(text):
        level = [value]
        while level:
            for x in level:
                if isinstance(x, dict) and keys <= x.keys():
                    return x
            level = [y for x in level for y in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else [])]
    return None
