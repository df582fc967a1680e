"""Token ids of whole texts, and BPE by per-prefix dynamic programming (operator 7).

Texts in Latin letters are cut into the vocabulary's words, whose ids are looked
up, or made where a word is met for the first time. Other texts are left to the
library's own normalizer and pattern.

Operator 7 encodes a word by one pass over its prefixes. An Aho-Corasick
automaton over the vocabulary gives every token that is a suffix of the prefix;
of these exactly one ends the prefix's encoding: the one compatible with the
last token of what stands before it. The ids are read off the back-pointers.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHUNKS = re.compile(r"[^ \t-\r]+")

# The vocabularies' word patterns, written out for texts that _PLAIN finds no fault with: Latin letters
# and ASCII white space only, no special tokens.
_PLAIN = re.compile(r"[^\t-\r -~\xa1-\xffŒœ]|<\|")
_L, _N = "A-Za-z\xaa\xb5\xbaÀ-ÖØ-öø-ÿŒœ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LOWER_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+", re.ASCII)
_SPACED_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+", re.ASCII)

#: Entries of a lookup table (about 200 bytes each) at which it starts anew, and the longest word that it holds.
ENTRIES = 700_000
LONGEST = 48


def _byte_characters() -> list[str]:
    """Byte-level vocabularies' character of every byte: visible ones stand for themselves, others follow from U+0100 on."""
    rest = iter(range(256, 512))
    return [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else chr(next(rest)) for b in range(256)]


BYTES = _byte_characters()


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordTable:
    """Values of words, computed by `encode` for those not met yet."""

    def __init__(self, encode: Callable[[list[str]], Iterable], entries: int = ENTRIES):
        self.encode, self.known, self.entries = encode, {}, entries

    def values(self, words: list[str]) -> list:
        known = self.known
        missing = [*set(words).difference(known)]
        if missing:
            known.update(zip(missing, self.encode(missing), strict=True))
        out = [*map(known.__getitem__, words)]
        if len(known) > self.entries:
            known.clear()
        elif missing:
            for w in missing:
                if len(w) > LONGEST:
                    del known[w]
        return out


def by_words(texts: list[str], words_of: Callable[[str], list[str]], table: WordTable, joined: Callable[[list], object], other: Callable[[str], object]) -> list:
    """`joined` values of each text's words, looked up for some texts at a time; `other` of texts that aren't plain."""
    out: list = []
    group: list[list[str] | None] = []
    words: list[str] = []

    def flush() -> None:
        values, at = table.values(words), 0
        for own in group:
            out.append(joined(values[at : at + len(own)]))
            at += len(own)
        group.clear()
        words.clear()

    for text in texts:
        if _PLAIN.search(text):
            flush()
            out.append(other(text))
            continue
        group.append(own := words_of(text))
        words += own
        if len(words) > 2000:
            flush()
    flush()
    return out


class IdBytes:
    """Ids of texts as little-endian unsigned 32-bit integers, as the tokenizers library gives them."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.lowers = json.loads(self.tokenizer.to_str())["normalizer"] is not None
        self.table = WordTable(self._plain)

    def _plain(self, words: list[str]) -> list[bytes]:
        """Ids of words of the pattern, which need no normalizer or cutting: straight from the library's model."""
        merge = self.tokenizer.model.tokenize
        shown = [w if w.isascii() and w.isalpha() else "".join(map(BYTES.__getitem__, w.encode())) for w in words]
        return [array("I", [x.id for x in merge(w)]).tobytes() for w in shown]

    def _encoded(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def __call__(self, texts: list[str]) -> list[bytes]:
        words_of = (lambda x: _LOWER_WORDS.findall(x.lower())) if self.lowers else _SPACED_WORDS.findall
        return by_words(texts, words_of, self.table, b"".join, lambda x: self._encoded([x])[0])


@lru_cache(maxsize=4)
def id_bytes(path: str) -> IdBytes:
    return IdBytes(path)


class PrefixEncoder:
    """Byte-pair encoding of a vocabulary with word ends, by dynamic programming over prefixes."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        spec = json.loads(self.tokenizer.to_str())
        model = spec["model"]
        if model["end_of_word_suffix"] is None or model["dropout"] or model["ignore_merges"] or model["byte_fallback"]:
            raise ValueError("a plain BPE vocabulary with a word-end suffix is needed")
        self.suffix = model["end_of_word_suffix"]
        self.strings = {i: s for s, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.is_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        vocab = model["vocab"]
        #: rank of the merge of two ids; of an id, the two that it is merged from and the rank
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        again = set()
        for r, (x, y) in enumerate(model["merges"]):
            a, b = vocab[x], vocab[y]
            whole = vocab[x.removesuffix(self.suffix) + y if not x.endswith(self.suffix) else x + y]
            self.rank.setdefault((a, b), r)
            if whole in self.parts:
                again.add(whole)
            else:
                self.parts[whole] = (a, b, r)
        if again or any(r <= self.parts[t][2] for (a, b), r in self.rank.items() for t in (a, b) if t in self.parts):
            raise ValueError("merges must be in the order in which their parts come up, one for each token")
        self.automaton = ahocorasick.Automaton()
        for s, i in vocab.items():
            self.automaton.add_word(t := self._symbols(s), (i, len(t)))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.words = WordTable(lambda ws: map(self.word, ws), ENTRIES // 4)
        self.chunks = WordTable(lambda cs: map(self._shown, map(self._ids, cs)), ENTRIES // 8)
        self.plain = WordTable(lambda ws: map(self._shown, map(self._plain_ids, ws)), ENTRIES)

    def _symbols(self, token: str) -> str:
        """A token's characters; the one before the word end is moved to a plane of its own."""
        if not token.endswith(self.suffix):
            return token
        bare = token.removesuffix(self.suffix)
        return bare[:-1] + chr(0x10000 + ord(bare[-1]))

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """What stands at the token's right (1) or left (0) edge in the course of its merges, each with the rank that ends it."""
        out: list[tuple[int, float]] = [(token, float("inf"))]
        while token in self.parts:
            rank = self.parts[token][2]
            token = self.parts[token][side]
            out.append((token, rank))
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart: no merge over their border comes before the merges that make them.

        Of equal ranks the leftmost goes first.
        """
        known = self.fits.get((left, right))
        if known is None:
            heads = self._edge(right, 0)
            known = True
            for x, ends_x in self._edge(left, 1):
                for y, ends_y in heads:
                    r = self.rank.get((x, y))
                    if r is not None and r < ends_x and r <= ends_y:
                        known = False
            if len(self.fits) > 4 * ENTRIES:
                self.fits.clear()
            self.fits[left, right] = known
        return known

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one word in the vocabulary's byte characters."""
        symbols = word[:-1] + chr(0x10000 + ord(word[-1]))
        last: list[tuple[int, int] | None] = [None] * (len(symbols) + 1)
        compatible = self.compatible
        for end, match in self.automaton.iter(symbols):
            if last[end + 1] is None:
                start = end + 1 - match[1]
                if not start or ((before := last[start]) is not None and compatible(before[0], match[0])):
                    last[end + 1] = match
        out, at = [], len(symbols)
        while at:
            token, length = last[at]
            out.append(token)
            at -= length
        return tuple(reversed(out))

    def _ids(self, chunk: str) -> Iterator[int]:
        at = 0
        for m in [*self.is_special.finditer(chunk), None]:
            piece = self.tokenizer.normalizer.normalize_str(chunk[at : m.start() if m else None])
            words = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)] if piece else []
            for ids in self.words.values(words):
                yield from ids
            if m:
                yield self.special[m[0]]
                at = m.end()

    def _plain_ids(self, word: str) -> tuple[int, ...]:
        """Ids of a word of `_LOWER_WORDS`, in lower case."""
        return self.word(word if word.isascii() else "".join(map(BYTES.__getitem__, word.encode())))

    def _shown(self, ids: Iterable[int]) -> tuple[bytes, str]:
        ids = [*ids]
        return array("i", ids).tobytes(), " ".join(map(self.strings.__getitem__, ids))

    def __call__(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids as 32-bit integers, and the decoded text (without a decoder: tokens joined by one space)."""

        def joined(pairs: list[tuple[bytes, str]]) -> tuple[bytes, str]:
            return b"".join([x[0] for x in pairs]), " ".join([x[1] for x in pairs if x[0]])

        words_of = lambda x: _LOWER_WORDS.findall(x.lower())
        return by_words(texts, words_of, self.plain, joined, lambda x: joined(self.chunks.values(_CHUNKS.findall(x))))


@lru_cache(maxsize=2)
def prefix_encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def prefix_encode(df: DataFrame, path: str, text: str = "text", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`columns`, `ids` (array<int>) and `decoded` of every whole text.

    A null or empty text has no ids and decodes to ''. Repeated rows are encoded one by
    one, no rows give none. Rows stay where they are; memory is bounded by a batch of
    rows and the lookup tables. Other columns of `df` are dropped, so names can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = prefix_encoder(path)
        for batch in batches:
            for part in slices(batch, "_text"):
                shown = encode([x or "" for x in part.column("_text").to_pylist()])
                sizes = np.array([len(x) // 4 for x, _ in shown], np.int64)
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.frombuffer(b"".join([x for x, _ in shown]), np.int32)))
                kept = [part.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*kept, ids, pa.array([x for _, x in shown], pa.string())], [*columns, "ids", "decoded"])

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)
    return df.select(*columns, F.col(text).alias("_text")).mapInArrow(run, f"{schema}, ids array<int>, decoded string")


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `most` bytes of `column`; a longer row stands alone."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if len(sizes) > at:
        yield batch.slice(at)


def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and digests of every document's ids, and of the text that they give back; see `prefix_encode`."""
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = prefix_encode(documents, public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
