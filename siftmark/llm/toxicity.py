"""Operator 11: toxicity by a bidirectional gated recurrent network with attention pooling.

A text's words (lower case, punctuation apart) are read in overlapping windows. A word enters the
network as a vector of its own and as the mean of its character n-grams' vectors, so that
words that were never met are read by their parts. Two gated recurrent layers pass over a window in both directions,
attention pools their states, and a logistic unit gives the window's score. A text's score comes from its highest
window and the mean of all, weighed on labelled texts that the network wasn't fitted on: one odd window of a long text isn't enough.

The network is fitted in numpy, by one task, on a bounded sample of labelled texts; all texts are then scored whole, by all tasks.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .wordhash import Words, mix, pieces

#: Words of a window, and words from one window's start to the next.
WIDTH, STRIDE = 24, 16
#: Size of a word's and of its characters' vector, and of a direction's state.
EMBED, HIDDEN = 8, 12
#: Lengths in bytes of character n-grams; a word has a mark before and behind it.
GRAMS = (3, 4, 5, 6)
#: Bounds of the sample: labelled texts of each class, windows of each, spread over the whole text, and bytes of a word there.
TOXIC_TEXTS, CLEAN_TEXTS, TEXT_WINDOWS, WORD_BYTES = 1200, 2400, 16, 64
#: Most words and n-grams with a vector, the fewest sampled texts that each has to occur in, and how many standard deviations its share of
#: toxic texts has to be away from that of all: hundreds of thousands are looked at, so some are far by chance.
WORDS_KEPT, GRAMS_KEPT, TEXTS_EACH, SURE = 20_000, 30_000, 3, 4.0
#: Windows of a step, steps on all windows, steps on chosen ones, and every how many texts one is kept for calibration.
BATCH, FIRST_STEPS, MORE_STEPS, HELD = 128, 250, 350, 5
#: Least score of a text that is predicted toxic.
THRESHOLD = 0.7

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 0x20
_BYTES = np.random.RandomState(11).randint(1, 2**62, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def grams_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word (its number) and hash of every character n-gram of some words."""
    size = ends - starts + 2
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    word = np.repeat(np.arange(len(size)), size)
    raw = data[np.clip(starts[word] + place - 1, 0, max(len(data) - 1, 0))] if len(word) else np.zeros(0, np.uint8)
    raw = np.where(place == 0, 1, np.where(place == size[word] - 1, 2, raw))
    code, left = _BYTES[raw], size[word] - place
    words, found, total, power = [], [], np.zeros(len(raw), np.uint64), np.ones(1, np.uint64)
    for n in range(1, GRAMS[-1] + 1):
        total[: max(len(raw) - n + 1, 0)] += code[n - 1 :] * power
        power *= _BASE
        if n in GRAMS:
            inside = left >= n
            words.append(word[inside])
            found.append(mix(total[inside] + np.uint64(n)))
    return np.concatenate(words), np.concatenate(found)


def _rows(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places in a sorted vocabulary; its length where a hash isn't in it."""
    out = np.full(len(hashes), len(vocabulary))
    first = np.zeros(1 << 18, bool)  # by the first bits, most hashes aren't
    first[(vocabulary >> np.uint64(46)).astype(np.int64)] = True
    maybe = np.flatnonzero(first[(hashes >> np.uint64(46)).astype(np.int64)])
    at = np.searchsorted(vocabulary, hashes[maybe])
    same = vocabulary[np.minimum(at, len(vocabulary) - 1)] == hashes[maybe] if len(maybe) else np.zeros(0, bool)
    out[maybe[same]] = at[same]
    return out


def window_starts(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and first word of the windows that cover texts whose words begin at `first`: one each STRIDE words, the last at the text's end.

    A text of under WIDTH words is one short window, a text without words none.
    """
    size = np.diff(first)
    count = np.where(size > WIDTH, -(-(size - WIDTH) // STRIDE) + 1, (size > 0).astype(np.int64))
    text = np.repeat(np.arange(len(size)), count)
    number = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return text, first[:-1][text] + np.minimum(number * STRIDE, np.maximum(size - WIDTH, 0)[text])


def _probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _pooled(highest: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """What a text's score is made of: its highest logit, the logit of its mean probability, and 1."""
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.stack([highest, np.log(mean / (1 - mean)), np.ones(len(highest))], 1)


class Network:
    """Vocabularies, parameters and calibration."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.parts)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Network:
        with np.load(io.BytesIO(data)) as found:
            return cls({k: found[k] for k in found.files})

    def inputs(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The input vector of each of some words; a word without any known part is a row of zeros."""
        p = self.parts
        out = np.zeros((len(hashes), 2 * EMBED), np.float32)
        out[:, :EMBED] = np.vstack([p["word"], np.zeros((1, EMBED), np.float32)])[_rows(p["words"], hashes)]
        word, gram = grams_of(data, starts, ends)
        row = _rows(p["grams"], gram)
        known = row < len(p["grams"])
        word, row = word[known], row[known]
        count = np.bincount(word, minlength=len(hashes))
        np.add.at(out[:, EMBED:], word, p["gram"][row])
        out[:, EMBED:] /= np.maximum(count, 1)[:, None]
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows. `x`: rows of the projected inputs by step, window and gate (both directions); `mask`: steps with a word."""
        p, (steps, n) = self.parts, mask.shape
        states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
        full = bool(mask.all())
        for side in (0, 1):
            u, h = p["state"][side], np.zeros((n, HIDDEN), np.float32)
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                given, back = x[t, :, side * 3 * HIDDEN : (side + 1) * 3 * HIDDEN], h @ u
                gates = given[:, : 2 * HIDDEN] + back[:, : 2 * HIDDEN]
                gates *= 0.5
                np.tanh(gates, gates)
                gates *= 0.5
                gates += 0.5
                update, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
                new = reset * back[:, 2 * HIDDEN :]
                new += given[:, 2 * HIDDEN :]
                np.tanh(new, new)
                if keep is not None:
                    keep.append((side, t, h, update, reset, new, back[:, 2 * HIDDEN :]))
                step = 1 - update
                if not full:
                    step *= mask[t][:, None]
                step *= new - h
                h = h + step
                states[t, :, side * HIDDEN : (side + 1) * HIDDEN] = h
        weight = np.where(mask > 0, states @ p["look"], -1e9)
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if keep is not None:
            keep.append((states, weight, pooled))
        return pooled @ p["out"] + p["bias"][0]

    def windows(self, inputs: np.ndarray, which: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Logits of windows of words (`which`: rows of `inputs`, by window and step)."""
        projected = inputs @ self.parts["given"] + self.parts["base"]
        out = np.empty(len(which), np.float32)
        for at in range(0, len(which), 768):
            some = slice(at, at + 768)
            out[some] = self.forward(projected[which[some].T], mask[some].T.astype(np.float32))
        return out

    def score(self, highest: np.ndarray, mean: np.ndarray) -> np.ndarray:
        """Texts' scores, from their highest window's logit and their windows' mean probability."""
        return _probability(_pooled(highest, mean) @ self.parts["calibration"])

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The score of each text; one without words is a window of one unknown word."""
        data = _PLAIN[data]
        words = Words(data, offsets)
        best = np.full(len(offsets) - 1, self.windows(np.zeros((1, 2 * EMBED), np.float32), np.zeros((1, 1), np.int64), np.ones((1, 1), bool))[0], np.float64)
        mean = _probability(best)
        if len(words):
            hashes, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
            inputs = self.inputs(hashes, data, words.starts[first], words.ends[first])
            text, start = window_starts(words.first)
            known = np.append(0, np.cumsum(inputs.any(1)[which]))
            nothing = self.windows(np.zeros((1, 2 * EMBED), np.float32), np.zeros((1, WIDTH), np.int64), np.ones((1, WIDTH), bool))[0]
            filled = np.diff(words.first) > 0
            best[filled], mean[filled] = -np.inf, 0
            count = np.maximum(np.bincount(text, minlength=len(best)), 1)
            for at in range(0, len(start), 1 << 15):
                some = slice(at, at + (1 << 15))
                place = start[some, None] + np.arange(WIDTH)
                mask = place < words.first[1:][text[some]][:, None]
                # whole windows of unknown words all have the same logit
                read = ~mask[:, -1] | (known[np.minimum(place[:, -1] + 1, len(which))] > known[start[some]])
                logits = np.full(len(place), nothing, np.float64)
                logits[read] = self.windows(inputs, which[np.minimum(place[read], len(which) - 1)], mask[read])
                np.maximum.at(best, text[some], logits)
                mean += np.bincount(text[some], weights=_probability(logits), minlength=len(best)) / count
        return self.score(best, mean)


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.n, self.moments = rate, 0, {}

    def step(self, parts: dict[str, np.ndarray], slopes: dict[str, np.ndarray]) -> None:
        self.n += 1
        for name, g in slopes.items():
            m, v = self.moments.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            parts[name] -= (self.rate * (m / (1 - 0.9**self.n)) / (np.sqrt(v / (1 - 0.999**self.n)) + 1e-8)).astype(np.float32)


class _Fit:
    """The sample's words by number, their parts in the vocabularies, and one step of gradient descent."""

    def __init__(self, windows: list[list[bytes]], toxic: np.ndarray, decay: float = 1e-4):
        """`windows`: each text's windows, words joined by spaces."""
        raw = b"\n".join(w for text in windows for w in text)
        data = np.frombuffer(raw, np.uint8)
        size = [len(w) + 1 for text in windows for w in text]
        words = Words(data, np.append(0, np.minimum(np.cumsum(size), len(data))))
        self.text = np.repeat(np.arange(len(windows)), np.array([len(t) for t in windows], np.int64))
        self.toxic, self.decay = toxic, decay
        hashes, first, number = np.unique(words.hashes(), return_index=True, return_inverse=True)
        place = words.first[:-1, None] + np.arange(WIDTH)
        self.mask = place < words.first[1:, None]
        self.which = number[np.minimum(place, max(len(number) - 1, 0))] if len(number) else np.zeros(place.shape, np.int64)
        filled = self.mask.any(1)
        self.text, self.mask, self.which = self.text[filled], self.mask[filled], self.which[filled]
        starts, ends = words.starts[first], words.ends[first]
        of, gram = grams_of(data, starts, ends)
        texts_of = np.repeat(self.text, self.mask.sum(1))
        seen = np.unique(texts_of * max(len(hashes), 1) + self.which[self.mask])
        text, word = seen // max(len(hashes), 1), seen % max(len(hashes), 1)
        r = np.random.RandomState(0)
        self.r = r
        words_kept, word_start = self._vocabulary(hashes[word], text, WORDS_KEPT)
        order = np.argsort(of, kind="stable")
        of, gram = of[order], gram[order]
        edge = np.searchsorted(of, np.arange(len(hashes) + 1))
        runs = (edge[1:] - edge[:-1])[word]
        at = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(edge[word], runs)
        grams_kept, gram_start = self._vocabulary(gram[at], np.repeat(text, runs), GRAMS_KEPT)
        small = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
        parts = {
            "words": words_kept, "grams": grams_kept, "word": word_start, "gram": gram_start, "given": small(2 * EMBED, 6 * HIDDEN), "base": np.zeros(6 * HIDDEN, np.float32),
            "state": small(2, HIDDEN, 3 * HIDDEN), "look": np.zeros(2 * HIDDEN, np.float32), "out": small(1, 2 * HIDDEN)[0] * 0.1, "bias": np.zeros(1, np.float32), "calibration": np.array([1.0, 0.0, 0.0]),
        }
        self.net = Network(parts)
        self.word_row = _rows(words_kept, hashes)
        row = _rows(grams_kept, gram)
        known = row < len(grams_kept)
        self.gram_of, self.gram_row = of[known], row[known]
        self.gram_edge = np.searchsorted(self.gram_of, np.arange(len(hashes) + 1))
        self.gram_count = np.maximum(np.diff(self.gram_edge), 1).astype(np.float32)
        self.adam = _Adam(0.01)

    def _vocabulary(self, hashes: np.ndarray, text: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The parts that tell most about the label, sorted, and their first vectors: the log odds of a label, less their error."""
        pairs = np.unique(np.stack([hashes, text.astype(np.uint64)]), axis=1) if len(hashes) < 1000 else None
        if pairs is None:
            order = np.lexsort((text, hashes))
            h, t = hashes[order], text[order]
            new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))
            h, t = h[new], t[new]
        else:
            h, t = pairs[0], pairs[1].astype(np.int64)
        kept, number, texts = np.unique(h, return_inverse=True, return_counts=True)
        hits = np.bincount(number, weights=self.toxic[t], minlength=len(kept))
        rest, bad, good = texts - hits, self.toxic.sum(), len(self.toxic) - self.toxic.sum()
        odds = np.log((hits + 0.5) / (bad + 1)) - np.log((rest + 0.5) / (good + 1))
        drawn = np.sign(odds) * np.maximum(0, np.abs(odds) - np.sqrt(1 / (hits + 0.5) + 1 / (rest + 0.5)))
        # likelihood ratio of two shares against one
        part = lambda n, of: n * np.log(np.maximum(n, 1e-9) * len(self.toxic) / np.maximum(of, 1e-9))
        ratio = part(hits, texts * bad) + part(rest, texts * good) + part(bad - hits, (len(self.toxic) - texts) * bad) + part(good - rest, (len(self.toxic) - texts) * good)
        some = np.flatnonzero((texts >= TEXTS_EACH) & (2 * ratio >= SURE * SURE))
        some = np.sort(some[np.argsort(-ratio[some], kind="stable")[:most]])
        start = np.zeros((len(some), EMBED), np.float32)
        start[:, 0] = drawn[some]
        return kept[some], start

    def inputs(self, numbers: np.ndarray) -> np.ndarray:
        p = self.net.parts
        out = np.zeros((len(numbers), 2 * EMBED), np.float32)
        out[:, :EMBED] = np.vstack([p["word"], np.zeros((1, EMBED), np.float32)])[self.word_row[numbers]]
        at, of = self._grams(numbers)
        np.add.at(out[:, EMBED:], of, p["gram"][self.gram_row[at]])
        out[:, EMBED:] /= self.gram_count[numbers][:, None]
        return out

    def _grams(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        runs = self.gram_edge[numbers + 1] - self.gram_edge[numbers]
        of = np.repeat(np.arange(len(numbers)), runs)
        return np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(self.gram_edge[numbers], runs), of

    def logits(self, some: np.ndarray) -> np.ndarray:
        """Of the windows `some`."""
        numbers, which = np.unique(self.which[some], return_inverse=True)
        return self.net.windows(self.inputs(numbers), which.reshape(len(some), -1), self.mask[some])

    def step(self, some: np.ndarray) -> None:
        p, label = self.net.parts, self.toxic[self.text[some]].astype(np.float32)
        numbers, which = np.unique(self.which[some], return_inverse=True)
        which, mask = which.reshape(len(some), -1).T, self.mask[some].T.astype(np.float32)
        given = self.inputs(numbers)
        kept: list = []
        logit = self.net.forward((given @ p["given"] + p["base"])[which], mask, kept)
        states, weight, pooled = kept.pop()
        off = ((_probability(logit) - label) / len(some)).astype(np.float32)
        slopes = {"out": pooled.T @ off, "bias": off.sum(keepdims=True)}
        d_pooled = off[:, None] * p["out"]
        by_step = np.einsum("tnh,nh->tn", states, d_pooled)
        d_weight = weight * (by_step - (weight * by_step).sum(0))
        slopes["look"] = np.einsum("tnh,tn->h", states, d_weight)
        d_states = weight[:, :, None] * d_pooled + d_weight[:, :, None] * p["look"]
        d_x, d_u = np.zeros((*mask.shape, 6 * HIDDEN), np.float32), np.zeros_like(p["state"])
        for side in (1, 0):
            d_h = np.zeros((len(some), HIDDEN), np.float32)
            for own, t, h, update, reset, new, back in reversed([k for k in kept if k[0] == side]):
                d_h = d_h + d_states[t, :, side * HIDDEN : (side + 1) * HIDDEN]
                m = mask[t][:, None]
                d_new = d_h * (1 - update) * m * (1 - new * new)
                d_update = -d_h * (new - h) * m * update * (1 - update)
                d_reset = d_new * back * reset * (1 - reset)
                d_back = np.concatenate([d_update, d_reset, d_new * reset], 1)
                d_x[t, :, side * 3 * HIDDEN : (side + 1) * 3 * HIDDEN] = np.concatenate([d_update, d_reset, d_new], 1)
                d_u[own] += h.T @ d_back
                d_h = d_h * (1 - (1 - update) * m) + d_back @ p["state"][side].T
        flat = np.zeros((len(numbers), 6 * HIDDEN), np.float32)
        np.add.at(flat, which.reshape(-1), d_x.reshape(-1, 6 * HIDDEN))
        slopes |= {"state": d_u, "base": flat.sum(0), "given": given.T @ flat}
        d_in = flat @ p["given"].T
        rows = self.word_row[numbers]
        d_word, d_gram = self.decay * p["word"], self.decay * p["gram"]
        known = rows < len(p["words"])
        np.add.at(d_word, rows[known], d_in[known, :EMBED])
        at, of = self._grams(numbers)
        np.add.at(d_gram, self.gram_row[at], (d_in[:, EMBED:] / self.gram_count[numbers][:, None])[of])
        self.adam.step(p, slopes | {"word": d_word, "gram": d_gram})


def _calibrated(pooled: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve through texts' pooled windows; targets stay off 0 and 1 by the number of texts, and both classes weigh the same."""
    n = toxic.sum()
    target = np.where(toxic > 0, (n + 1) / (n + 2), 1 / (len(toxic) - n + 2))
    scale = np.append(np.maximum(np.abs(pooled[:, :2]).max(0), 1e-6), 1)
    x, w = pooled / scale, np.zeros(3)
    share = np.where(toxic > 0, 0.5 / max(n, 1), 0.5 / max(len(toxic) - n, 1)) * len(toxic)
    for _ in range(50):
        p = _probability(x @ w)
        w = w - np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), x.T @ (share * (p - target)) + 1e-2 * w)
    return w / scale


def fit_network(windows: list[list[bytes]], toxic: np.ndarray) -> Network:
    """A network fitted on texts, each given by windows of words; every HELD-th text of a class is kept for the calibration.

    Steps begin with windows of all texts under their text's label. Then toxic texts go on with the windows that the network
    finds worst in them, as the others may hold nothing toxic, and clean ones with all of theirs, the worst more often.
    Without texts of both classes every score is their label's (0 without any).
    """
    held = np.zeros(len(toxic), bool)
    for label in (0, 1):
        held[np.flatnonzero(toxic == label)[HELD - 1 :: HELD]] = True
    if not 0 < toxic.sum() < len(toxic) or not any(windows):
        fit = _Fit([[b"-"]], np.zeros(1, np.int64))
        fit.net.parts["calibration"] = np.array([0.0, 0.0, 30.0 if len(toxic) and toxic.all() else -30.0])
        return fit.net
    fit = _Fit(windows, toxic)
    own, bad = ~held[fit.text], toxic[fit.text] > 0
    good, worst = np.flatnonzero(own & ~bad), np.flatnonzero(own & bad)
    hard = good
    if len(good) and len(worst):
        for round_ in range(FIRST_STEPS + MORE_STEPS):
            if round_ >= FIRST_STEPS and (round_ - FIRST_STEPS) % 100 == 0:
                logits = fit.logits(np.arange(len(fit.text)))
                order = np.lexsort((-logits, fit.text))
                rank = np.empty(len(order), np.int64)
                head = np.searchsorted(fit.text[order], fit.text[order])
                rank[order] = np.arange(len(order)) - head
                worst = np.flatnonzero(own & bad & (rank < 2))
                hard = good[np.argsort(-logits[good], kind="stable")[: max(len(good) // 20, 64)]]
            if round_ == (FIRST_STEPS + MORE_STEPS) * 3 // 4:
                fit.adam.rate *= 0.3
            quarter = BATCH // 4
            fit.step(np.concatenate([fit.r.choice(worst, 2 * quarter), fit.r.choice(good, quarter), fit.r.choice(hard, quarter)]))
    logits = fit.logits(np.arange(len(fit.text))).astype(np.float64)
    best = np.full(len(toxic), -np.inf)
    np.maximum.at(best, fit.text, logits)
    judge = held & np.isfinite(best)
    if min((toxic[judge] > 0).sum(), (toxic[judge] == 0).sum()) < 3:
        judge = np.isfinite(best)
    mean = np.bincount(fit.text, weights=_probability(logits), minlength=len(toxic)) / np.maximum(np.bincount(fit.text, minlength=len(toxic)), 1)
    fit.net.parts["calibration"] = _calibrated(_pooled(best[judge], mean[judge]), toxic[judge].astype(np.float64))
    return fit.net


def _remainder(id: str):
    return F.crc32(F.col(id).cast("string").cast("binary")) % 3


def _sampled(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str) -> DataFrame:
    """place, toxic and windows (words joined by spaces, windows by lines) of the labelled texts that the network is fitted on: bounded, one row for each id."""
    known = labels.where(F.col(label).isNotNull() & (_remainder(id) != 1)).groupBy(F.col(id).cast("long").alias("key")).agg((F.max(F.col(label).cast("int")) > 0).cast("int").alias("toxic"))
    known = known.withColumn("place", F.xxhash64("key", F.lit(11)))
    parts = [known.where(F.col("toxic") == c).orderBy("place", "key").limit(n) for c, n in ((1, TOXIC_TEXTS), (0, CLEAN_TEXTS))]
    # TOXIC_TEXTS + CLEAN_TEXTS rows at most
    some = docs.select(F.col(id).cast("long").alias("key"), F.lower(text).alias("_text")).join(F.broadcast(parts[0].unionByName(parts[1])), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, data, offsets in pieces(batch, "_text"):
                data = _PLAIN[data]
                words = Words(data, offsets)
                text, start = window_starts(words.first)
                raw = data.tobytes()
                for i in range(len(offsets) - 1):
                    own = start[np.searchsorted(text, i) : np.searchsorted(text, i, "right")]
                    own = own[np.unique(np.linspace(0, len(own) - 1, min(TEXT_WINDOWS, len(own))).astype(np.int64))] if len(own) else own
                    last = int(words.first[i + 1])
                    spans = [zip(words.starts[a : min(a + WIDTH, last)].tolist(), words.ends[a : min(a + WIDTH, last)].tolist(), strict=True) for a in own.tolist()]
                    out.append(b"\n".join(b" ".join(raw[x : min(y, x + WORD_BYTES)] for x, y in s) for s in spans))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("place"), batch.column("toxic"), pa.array(out, pa.binary())], ["key", "place", "toxic", "windows"])

    found = some.select("key", "place", "toxic", "_text").mapInArrow(run, "key long, place long, toxic int, windows binary")
    return found.groupBy("key").agg(F.first("place").alias("place"), F.first("toxic").alias("toxic"), F.min("windows").alias("windows"))


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> bytes:
    """A network fitted on labelled texts of `docs`, packed.

    Labels count only where crc32 of the id as text, modulo 3, isn't 1; of several labels of an id the highest does, of several texts one. A null id or label is left out.
    At most TOXIC_TEXTS and CLEAN_TEXTS texts, those with the smallest hashes of their ids, meet in one task; a few megabytes come to the driver. The same rows give the same network.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("place", "key", "toxic", "windows")), strict=True)))
        net = fit_network([[w for w in r[3].split(b"\n") if w] for r in rows], np.array([r[2] for r in rows], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([net.packed()], pa.binary())], ["packed"])

    fitted = _sampled(docs, labels, id, text, label).repartition(1).mapInArrow(run, "packed binary").collect()
    return fitted[0]["packed"] if fitted else fit_network([], np.zeros(0, np.int64)).packed()


def score_texts(df: DataFrame, packed: bytes, text: str = "text", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`columns` and score (0 to 1) of every row's whole text, by its highest window.

    A null, empty or blank text gets the score of one unknown word. Repeated rows get equal scores; no rows give none. Other columns of `df` are dropped, and score replaces a column of that name.
    """
    kept = [c for c in columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.unpacked(packed)
        for batch in batches:
            for at, end, data, offsets in pieces(batch, "_text"):
                own = batch.column("own").slice(at, end - at)
                yield pa.RecordBatch.from_arrays([own, pa.array(net.texts(data, offsets), pa.float64())], ["own", "score"])

    rows = df.select(F.struct(*(kept or [F.lit(None).alias("none")])).alias("own"), F.lower(text).alias("_text"))
    out = rows.mapInArrow(run, f"own {rows.schema['own'].dataType.simpleString()}, score double")
    return out.select(*(F.col("own")[c].alias(c) for c in kept), "score")


def op11_gated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by a network fitted on the labels that aren't held out; see `train` and `score_texts`. A null doc_id isn't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_texts(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", F.coalesce(_remainder("doc_id") == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
