"""Words and rolling word hashes of whole Arrow batches, as numpy arrays.

A word is a run of bytes other than 0x20 and 0x09-0x0D, so splitting works on
UTF-8 bytes without decoding. Hashes are 64 bits: bytes within a word form a
polynomial, the result is mixed, and windows of words are polynomials of the
mixed words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.RandomState(20240229).randint(1, 2**62, (2, 256), dtype=np.int64).astype(np.uint64) | np.uint64(1)
_BYTES[:, _SPACE] = 0
_BASES = np.array([0x9E3779B97F4A7C15, 0xA24BAED4963EE407], np.uint64)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some documents: byte bounds, hashes and the first word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        space = _SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before, after = np.empty(len(data), bool), np.empty(len(data), bool)
        before[:1], after[-1:] = True, True
        before[1:], after[:-1] = space[:-1], space[1:]
        self.starts = np.flatnonzero(~space & (before | edge[:-1]))
        self.ends = np.flatnonzero(~space & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, kind: int = 0) -> np.ndarray:
        """A hash of each word; the two kinds (0 and 1) are independent of one another."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        sizes = np.diff(np.append(self.starts, len(self.data)))
        place = np.arange(self.starts[0], len(self.data)) - np.repeat(self.starts, sizes)
        longest = int((self.ends - self.starts).max())
        power = _powers(_BASES[kind], longest + 1)
        parts = _BYTES[kind][self.data[self.starts[0] :]] * power[np.minimum(place, longest)]
        total = np.add.reduceat(parts, self.starts - self.starts[0])
        return mix(total + (self.ends - self.starts).astype(np.uint64))


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class RangeHashes:
    """Hashes of any ranges of words, from running sums of a polynomial of the mixed word hashes."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes) + 1
        power = np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, _WORD_BASE, np.uint64)))
        self.back = np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, np.uint64(_inverse(int(_WORD_BASE))), np.uint64)))
        self.sums = np.append(np.uint64(0), np.add.accumulate(hashes * power[:-1]))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - start).astype(np.uint64)
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + mix(size))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (first, end, bytes, offsets) of about `most` bytes; a null text is empty; a longer text stands alone."""
    texts = batch.column(column)
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
