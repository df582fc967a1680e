"""Toxicity: slopes against differences, held-out accuracy, windows, nulls, empty and long texts, ties, empty tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmark.llm import toxicity
from siftmark.llm.toxicity import Network, fit_network, grams_of, op11_gated_toxicity, score_texts, train, window_starts

BAD = ["idiot", "scum", "moron"]


def prose(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choice(["an", "re", "ti", "on", "le", "sh"]) for _ in range(r.choice([1, 2, 3]))) for _ in range(n)]


def text(r: random.Random, bad: bool, n: int) -> str:
    words = prose(r, n)
    for _ in range(max(1, n // 30) if bad else 0):
        # words with one beginning, most of them met once only
        words[r.randrange(n)] = r.choice([*BAD, "zok" + "".join(prose(r, 2))])
    return " ".join(words).capitalize() + "."


def sample(n: int, seed: int = 1) -> list[tuple[int, str, int]]:
    r = random.Random(seed)
    return [(i, text(r, i % 4 == 0, r.choice([12, 40, 90, 300])), int(i % 4 == 0)) for i in range(n)]


@pytest.fixture(scope="module")
def network(spark) -> bytes:
    rows = sample(900)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 0), (None, 1), (3, None), (99999, 1)], "doc_id long, toxic int")
    return train(docs, labels)


def test_held_out_texts(spark, network):
    r = random.Random(77)
    rows = [(i, text(r, i % 2 == 0, r.choice([15, 60, 2000])), i % 2 == 0) for i in range(400)]
    found = {x["doc_id"]: x["score"] for x in score_texts(spark.createDataFrame(rows, "doc_id long, text string, bad boolean"), network).collect()}
    right = [(found[i] >= toxicity.THRESHOLD) == bad for i, _, bad in rows]
    assert sum(right) / len(right) >= 0.97


def test_whole_text_counts(spark, network):
    """What is at the end of a very long text counts as much as what is at its beginning."""
    r = random.Random(5)
    clean, bad = " ".join(prose(r, 4000)), " ".join(text(r, True, 30) for _ in range(60))
    rows = [(1, clean), (2, f"{clean} {bad}"), (3, f"{bad} {clean}"), (4, f"{clean} {bad} {clean}")]
    found = dict(map(tuple, score_texts(spark.createDataFrame(rows, "doc_id long, text string"), network).collect()))
    assert found[1] < 0.3 and min(found[2], found[3], found[4]) >= toxicity.THRESHOLD


def test_odd_texts(spark, network):
    rows = [(None, None, 1), (1, "", 1), (1, " \n\t ", 1), (2, "idiot", 1), (2, "idiot", 1), (3, "q" * 300_000, 1), (4, "İ ΑΣ 😀 !!! ...", 1)]
    out = score_texts(spark.createDataFrame(rows, "doc_id long, text string, score int"), network)
    assert out.columns == ["doc_id", "score"]
    found = out.collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (None, 1)}) == 1
    assert len({r["score"] for r in found if r["doc_id"] == 2}) == 1
    assert score_texts(spark.createDataFrame([], "doc_id long, text string"), network).collect() == []


def test_same_rows_same_network(spark, network):
    rows = sample(900)
    docs = spark.createDataFrame([(i, t) for i, t, _ in reversed(rows)], "doc_id long, text string").repartition(7)
    again = train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert all(np.array_equal(a, b) for a, b in zip(Network.unpacked(network).parts.values(), Network.unpacked(again).parts.values(), strict=True))


def test_labels_held_out_are_never_read(spark):
    """Other labels of the held-out rows, and no others, give the same network."""
    rows = sample(120)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    a, b = (train(docs, spark.createDataFrame([(i, 1 - y if held(i) and turn else y) for i, _, y in rows], "doc_id long, toxic int")) for turn in (False, True))
    assert a == b


def test_without_labels(spark):
    a, b = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    docs = spark.createDataFrame([(a, "a b"), (b, None)], "doc_id long, text string")
    for labels, score in (([], 0), ([(a, 0), (b, 0)], 0), ([(a, 1), (b, 1)], 1)):
        found = score_texts(docs, train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
        assert [round(r["score"]) for r in found] == [score, score]


def test_windows_cover_every_word():
    first = np.array([0, 0, 1, 24, 49, 49 + 1000])
    text, start = window_starts(first)
    assert 0 not in text
    for i in range(1, 5):
        covered = {w for s in start[text == i].tolist() for w in range(s, min(s + toxicity.WIDTH, first[i + 1]))}
        assert covered == set(range(first[i], first[i + 1]))
    assert (np.diff(start[text == 4]) <= toxicity.STRIDE).all()


def test_grams():
    data = np.frombuffer(b"abcab xy", np.uint8)
    word, gram = grams_of(data, np.array([0, 6]), np.array([5, 8]))
    assert [int((word == w).sum()) for w in (0, 1)] == [5 + 4 + 3 + 2, 2 + 1]
    assert len(set(gram.tolist())) == len(gram)
    again = grams_of(np.frombuffer(b"-xy abcab", np.uint8), np.array([1, 4]), np.array([3, 9]))
    assert sorted(gram[word == 0].tolist()) == sorted(again[1][again[0] == 1].tolist())


def test_slopes_are_differences(monkeypatch):
    rows = sample(300)
    monkeypatch.setattr(toxicity, "SURE", 1)
    fit = toxicity._Fit([[t.lower().encode()] for _, t, _ in rows if len(t.split()) < 25], np.array([y for _, t, y in rows if len(t.split()) < 25]), decay=0)
    parts = fit.net.parts
    r = np.random.RandomState(0)
    for name in ("word", "gram", "look", "base"):
        parts[name] += r.standard_normal(parts[name].shape).astype(np.float32) * 0.3
    for name in ("word", "gram", "given", "state", "look", "out", "bias", "base"):
        parts[name] = parts[name].astype(np.float64)
    some, slopes = np.arange(len(fit.text)), {}
    monkeypatch.setattr(fit.adam, "step", lambda _, s: slopes.update(s))
    fit.step(some)
    label = fit.toxic[fit.text].astype(np.float64)

    def loss() -> float:
        numbers, which = np.unique(fit.which, return_inverse=True)
        x = (fit.inputs(numbers) @ parts["given"] + parts["base"])[which.reshape(fit.which.shape).T]
        z = fit.net.forward(x.astype(np.float64), fit.mask.T.astype(np.float64)).astype(np.float64)
        return float(np.mean(np.logaddexp(0, z) - label * z))

    for name, slope in slopes.items():
        at = np.unravel_index(int(np.abs(slope).argmax()), slope.shape)
        old, near = parts[name][at], []
        for d in (1e-2, -1e-2):
            parts[name][at] = old + d
            near.append(loss())
        parts[name][at] = old
        assert (near[0] - near[1]) / 2e-2 == pytest.approx(float(slope[at]), rel=0.05, abs=1e-4), name


def test_one_class_or_nothing():
    assert fit_network([[b"a b"], [b"c"]], np.array([1, 1])).texts(np.frombuffer(b"a", np.uint8), np.array([0, 1]))[0] > 0.99
    assert fit_network([[], []], np.array([1, 0])).texts(np.frombuffer(b"a", np.uint8), np.array([0, 1]))[0] < 0.01


def test_query_on_whole_table(spark):
    """The query's held-out documents at sf0.1: recall and precision of what is predicted."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = op11_gated_toxicity(spark, folder).cache()
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert out.count() == docs.count()
    assert out.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1) != F.col("held_out")).count() == 0
    found = out.join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in found}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) >= 0.85
    assert n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) <= 0.015
    out.unpersist()
