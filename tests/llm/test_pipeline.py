"""The pipeline's stages on a small table, and the registered queries' names."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (None, "x y", "en", "s", 3)], docs.schema)
    docs = docs.unionByName(odd)
    out = [("documents", docs.cache())]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, stage(spark, out[-1][1], SF).cache()))
    return dict(out)


def test_quality_keeps_what_the_operator_keeps(stages):
    from siftmark.llm.quality import judge_quality

    want = Counter(r.doc_id for r in judge_quality(stages["documents"]).where("kept").collect())
    assert Counter(r.doc_id for r in stages["quality"].collect()) == want and 0 < len(want)


def test_one_of_each_class_stays(stages):
    texts = stages["near_dedup"].collect()
    assert len({" ".join(r.text.split()) for r in texts}) == len(texts)
    assert {r.doc_id for r in texts} <= {r.doc_id for r in stages["quality"].collect()}


def test_no_window_repeats(stages):
    before = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text) for r in stages["near_dedup"].collect()}
    seen = Counter(tuple(w[i : i + 35]) for w in before.values() for i in range(len(w) - 34))
    after = {r.doc_id: r for r in stages["substring_dedup"].collect()}
    assert after.keys() == before.keys()
    for i, w in before.items():
        gone = {k for a in range(len(w) - 34) if seen[tuple(w[a : a + 35])] > 1 for k in range(a, a + 35)}
        assert after[i].text.split() == [x for k, x in enumerate(w) if k not in gone] and after[i].n_chars == len(after[i].text)


def test_secrets_are_masked(stages):
    from siftmark.llm.secret_scan import base_spans

    assert not any(base_spans(r.text) for r in stages["secrets"].collect())


def test_everything_is_packed(stages):
    placed = stages["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= 2048 for r in placed)
    assert {r.doc_id for r in stages["packing"].collect()} == {r.doc_id for r in stages["secrets"].collect()}


WORDS = r"[^\x20\x09-\x0D]+"


def brute_quality(text, lang):
    """The verdict of one text, counted character by character."""
    from siftmark.llm import quality

    w = re.findall(WORDS, text)
    windows = Counter(zip(w, w[1:], w[2:]))
    repeats = len({j for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)})
    if len(w) < 50 or 100 * repeats > 50 * len(w):
        return False
    if lang not in quality.CLASSES:
        return True
    table = dict(zip(*quality.class_table(), strict=True))
    kinds = Counter(table.get(c, "other") for c in text)
    judged = len(text) - kinds["9"]
    counts = [kinds[str(k)] for k in range(6)]
    plain = re.sub(r"[.,;:!?#*$%&]", " ", text.lower())
    spoken = Counter(re.findall(WORDS, plain))
    hits = [spoken[c] for c in quality.COMMON[lang]]

    def distance(p, q):
        p, q = np.array(p, float), np.array(q, float)
        m = (p + q) / 2
        half = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
        return math.sqrt((half(p) + half(q)) / 2)

    far = judged >= 200 and distance([x / judged for x in [*counts, judged - sum(counts)]], quality.whole_shares(quality.CLASSES[lang])) > quality.CLASS_DISTANCE
    return not far and not (len(w) >= 100 and distance([x / len(w) for x in [*hits, len(w) - sum(hits)]], quality.with_rest(quality.WORDS[lang])) > quality.WORD_DISTANCE)


def brute_classes(docs):
    """The smallest id of each class: all pairs are aligned."""
    from siftmark.llm import near

    number = {w: i + 1 for i, w in enumerate(sorted({w for _, t in docs for w in re.findall(WORDS, t)}))}
    arrays = [np.array([number[w] for w in re.findall(WORDS, t)], np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _, t in docs]
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if near.similar(arrays[i], arrays[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [d for i, d in enumerate(docs) if root(i) == i]


def brute_cut(docs):
    """Texts as kept words, without those of windows that start twice."""
    words = [re.findall(WORDS, t) for _, t in docs]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (doc, _), w in zip(docs, words, strict=True):
        gone = {k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        out.append((doc, [x for k, x in enumerate(w) if k not in gone]))
    return out


def test_pipeline_against_brute_force(spark):
    """run() on the whole smallest table: which documents stay, what is left of them, and that it is packed token by token."""
    import public_tokenizers

    from siftmark.llm import secret_scan, tokens

    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "", r.lang) for r in table.collect())
    clean = [(d, t) for d, t, lang in rows if brute_quality(t, lang)]
    kept = brute_cut(brute_classes(clean))
    assert 0 < len(kept) < len(clean) < len(rows)
    docs = table
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF).cache()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {d: re.findall(WORDS, t) for d, t in texts.items()} == dict(kept)
    names = secret_scan.corpus_identifiers(docs)
    masked = {}
    for d, t in texts.items():
        hidden = np.zeros(len(t) + 1, bool)
        for a, _, b in (base := secret_scan.base_spans(t)) + secret_scan.novel_spans(t, base, names):
            hidden[a:b] = True
        masked[d] = re.sub("\0+", "<secret>", "".join("\0" if h else c for c, h in zip(t, hidden, strict=False)))
    t = tokens.load_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for d, text in masked.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 2048):
            want[d, at // 2048, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) <= -(-sum(r.length for r in got) // 2048) * 1.02 + 1


def test_repeated_rows_and_more_columns(spark):
    """Each stage takes rows that repeat and columns with clashing names."""
    found = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and n_chars between 400 and 3000").collect())
    clean = brute_classes([(d, t) for d, t in found if brute_quality(t, "en")])[:6]
    rows = [(d, t, "en", "s", 1, "x", "y") for d, t in clean]
    rows += rows[:3] + [(None, None, None, None, None, None, None), (-7, "", "en", "s", 0, "x", "y"), (-8, "q" * 3000, "en", "s", 1, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, kept string")
    counts = {name: stage(spark, docs, SF).count() for name, stage in corpus_pipeline.STAGES}
    assert counts["quality"] == 9 and counts["near_dedup"] == 8 and counts["substring_dedup"] == counts["secrets"] == 12 and counts["packing"] == 12


def test_columns(stages):
    assert all(stages[name].columns == corpus_pipeline.COLUMNS for name, _ in corpus_pipeline.STAGES[:-1])


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_registered():
    import __spark_entry__

    names = [k for k in __spark_entry__.queries() if re.match(r"op\d+_|pipeline", k)]
    assert sorted(int(k[2:].split("_")[0]) for k in names if k != "pipeline") == list(range(1, 14)) and "pipeline" in names
