"""The ten operators against brute force on a small fixture: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib
import math
import random
import re
import string
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmark.llm import chat, components, idfiles, near, packing, quality, secret_scan, sharding, substrings, tokens, topk
from siftmark.llm.components import connected_components
from siftmark.llm.idfiles import ids_crc32, read_ids, write_ids
from siftmark.llm.ordering import number_rows
from siftmark.llm.scratch import shared_path

P = pytest.importorskip("public_tokenizers")
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, row string, item string, block string"
WORDS = r"[^\x20\x09-\x0D]+"


def texts() -> list[str | None]:
    r = random.Random(4)
    prose = lambda n: " ".join(r.choice(["the", "of", "and", "oredat", "thnter", "re", "ingeser", "whst", "Élan", "é.", "x1"]) + r.choice(["", "", "a", "bl", "ou"]) for _ in range(n))
    base, passage = prose(300), prose(60)
    near_copy = base.split()
    near_copy[50], near_copy[150] = "changed", "words"
    return [
        None, "", " \n\t ", "one", "a b c d", base, base, base, " ".join(near_copy), prose(80) + "\n" + passage + " tail", passage + "\n" + prose(90), "start " + passage,
        "word " * 120, prose(4000), "İstanbul ΑΣ  x y <|endoftext|> 😀\x1c don't 1²3", "q" * 3000, prose(200), prose(34), prose(35),
    ]


@pytest.fixture(scope="module")
def rows():
    return [(5 if i in (6, 7) else i, t, "r", "i", "b") for i, t in enumerate(texts())] + [(None, "one", "r", "i", "b")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


# 1: chat formatting

HARD = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<|im_start|>", "a\nb", "", None, "<|", "<\\\\|x", "\\n", "é😀"]


def test_chat_round_trip(spark):
    turns = [(c, t, role, text) for c in range(3) for t, (role, text) in enumerate((["user", "assistant", "sys\n\\tem", None][(i + c) % 4], x) for i, x in enumerate(HARD))]
    turns += [(None, 1, "user", "no id"), (7, None, "assistant", "x"), (7, 1, "user", "same"), (7, 1, "user", "same")]
    df = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, source string")
    want = defaultdict(list)
    for c, t, role, text in turns:
        want[c].append((-1 if t is None else t, role or "", text or ""))
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert got.keys() == want.keys()
    for c, r in got.items():
        assert [(t.role, t.text) for t in r.turns] == [x[1:] for x in sorted(want[c])]
        for t in r.turns:  # the mask's place in the output holds the escaped text
            shown = r.formatted[t.start : t.start + t.length]
            assert re.sub(r"<\\(\\*)\|", r"<\1|", shown) == t.text if r.escaped else shown == t.text
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(r.turns)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_op1_query(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "assistant", "<|im_end|>")], "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op1_chat_round_trip(spark, str(tmp_path)).collect()}
    hard = HARD[0]
    assert got[-1].turns_sha256 == sha(f"user\n{hard}\nassistant\n{hard}\n") and got[-1].loss_sha256 == sha(hard) and got[-1].loss_chars == len(hard)
    assert got[1].turns_sha256 == sha("user\nhi\nassistant\n\nassistant\n<|im_end|>\n") and got[1].loss_sha256 == sha("<|im_end|>") and got[1].n_turns == 3


def test_chat_of_many_turns(spark):
    """Mask places of a long conversation, and in time that grows with its length."""
    df = spark.range(12_000).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn <|', id) AS text")
    start = time.time()
    got = chat.format_conversations(df).first()
    assert time.time() - start < 30
    assert all(got.formatted[t.start : t.start + t.length] == t.text == f"turn <|{i}" and t.trained == bool(i % 2) for i, t in enumerate(got.turns)) and len(got.turns) == 12_000


# 2: substring dedup


def brute_repeats(rows, width):
    words = [re.findall(WORDS, r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = True
        out.append((len(w), int(gone.sum()), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def test_substrings(docs, rows, none):
    got = sorted((r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(docs, 35).collect())
    assert got == sorted(brute_repeats(rows, 35))
    assert substrings.dedup_substrings(none).count() == 0


def test_substrings_random(spark):
    r = random.Random(9)
    parts = [[f"w{r.randrange(9)}" for _ in range(r.randrange(5, 60))] for _ in range(12)]
    rows = [(i, " ".join(x for p in r.choices(parts, k=r.randrange(1, 5)) for x in p)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (12, 35):
        got = sorted((x.n_words, x.n_removed, x.kept_sha256) for x in substrings.dedup_substrings(df, width).collect())
        assert got == sorted(brute_repeats(rows, width))


def test_the_parse_decides(spark, docs, rows):
    """Nothing is removed but by factors, and short first hashes change nothing."""
    found = substrings.find_matches(docs, 35)
    assert sum(x.n_removed for x in substrings.drop_factors(found, 35).collect()) > 0
    assert all(x.n_removed == 0 for x in substrings.drop_factors(found, 35, lambda *_: []).collect())
    short = substrings.drop_factors(substrings.find_matches(docs, 35, bits=3), 35)
    assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in short.collect()) == sorted(brute_repeats(rows, 35))


def test_parse():
    block = lambda first, last, row, at: {"first": first, "last": last, "source_row": row, "source_first": at}
    # two blocks of one source and a checked window make one factor; another source and a gap begin new ones
    assert substrings.parse([block(10, 14, 7, 110), block(0, 9, 7, 100), block(16, 20, 8, 0)], [15, 40], 35) == [(0, 50), (16, 39), (40, 35)]
    assert substrings.parse([], [], 35) == []


def test_substrings_keep_white_space(spark):
    passage = " ".join(f"p{i}" for i in range(150))
    df = spark.createDataFrame([(1, f"a\n\nb  {passage} c\td"), (2, f"{passage}\nend")], "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.n_factors) for r in substrings.dedup_substrings(df).collect()}
    assert got == {1: ("a\n\nb  c\td", 1), 2: ("end", 1)}


# 3: exact top-k


def test_top_products(spark):
    r = np.random.RandomState(3)
    vectors = [list(map(float, v)) for v in r.randn(300, 6) * (1 + np.arange(300)[:, None] % 7)] + [[0.0] * 6] * 3 + [[1.0] * 6] * 4
    rows = [(i, v, 1) for i, v in enumerate(vectors)] + [(400, None, 1), (450, [1.0, None] * 3, 1), (500, [float("nan")] * 6, 1), (550, [float("inf")] * 6, 1), (None, [2.0] * 6, 1), (600, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    usable = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all()]
    want = set()
    for q, v in usable:
        if q is not None and q % 50 == 0:
            scores = sorted(((-int(v @ u), c if c is not None else 2**63 - 1) for c, u in usable if c != q and len(u) == len(v)))[:5]
            want |= {(q, k + 1, c if c < 2**63 - 1 else None, -s) for k, (s, c) in enumerate(scores)}
    got = [tuple(x) for x in topk.top_products(df, "id % 50 = 0").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert topk.top_products(df.limit(0), "id % 50 = 0").count() == 0


def test_norms_prune_blocks(spark):
    """Skewed lengths, ties and an outlier: most blocks are never read, and the result is that of brute force."""
    r = np.random.RandomState(8)
    vectors = r.randn(4000, 8) * (np.arange(1, 4001)[:, None] ** -0.7) * 50
    vectors[17] = 3e4
    vectors[100:120] = vectors[100]
    vectors[2000:2005] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
    v = np.floor(256 * vectors).astype(np.int64)
    want = set()
    for q in range(0, 4000, 50):
        s = v @ v[q]
        order = [c for c in np.lexsort((np.arange(4000), -s)) if c != q][:5]
        want |= {(q, k + 1, int(c), int(s[c])) for k, c in enumerate(order)}
    assert {tuple(x) for x in topk.top_products(df, "id % 50 = 0", block=64, seeds=128).collect()} == want
    rows = topk._usable(df, "vec_id", "embedding", 256).cache()
    blocks, queries = topk.dealt_vectors(rows, "id % 50 = 0", 64, 128)
    cells = lambda need, seeds: topk._cells(queries.withColumns({"bound": F.lit(0), "need": need}), blocks, seeds)
    first, rest = (cells(F.lit(0.0), s)[0].count() for s in (True, False))
    assert 0 < first < rest
    # what the fifth best of the queries' scores leaves over
    kth = {q: s for q, k, _, s in want if k == 5}
    need = F.create_map(*(F.lit(x) for q, s in kth.items() for x in (q, max(0.0, s / max(1e-9, float(np.sqrt((v[q].astype(float) ** 2).sum()))))))) [F.col("id")]
    left, vectors_read = cells(need, False)
    assert left.count() < 0.5 * rest and vectors_read.count() < 0.5 * 4000 * queries.select("cell").distinct().count()


def test_too_long_vectors(spark):
    df = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e200, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too long"):
        topk.top_products(df, "id % 50 = 0").collect()


@pytest.mark.parametrize("bound", [5.0, 40.0, 120.0, 200.0])
def test_pruning_loses_nothing(bound):
    r = np.random.RandomState(1)
    vectors = (r.randn(500, 5) * 5).astype(np.int64)
    block = topk.Block(np.arange(500), np.arange(500), vectors)
    for q in (r.randn(20, 5) * 5).astype(np.int64):
        for start in (0, 100):
            places = np.arange(500)[block.candidates(q, float(np.sqrt((q**2).sum())), bound, start)]
            assert {x for x in np.flatnonzero(block.vectors @ q >= bound) if x >= start} <= set(places) and all(places >= start)


# 4: sharding


def test_shards(spark, docs, rows, none):
    got = sharding.feistel_shards(docs, ["doc_id", "text"], 4).collect()
    assert len(got) == len(rows) and sorted(r.place for r in got) == list(range(len(rows)))
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    distinct = spark.range(1000).withColumnRenamed("id", "doc_id")
    again = [{r.doc_id: (r.shard, r.slot) for r in sharding.feistel_shards(distinct.repartition(n), ["doc_id"], 7).collect()} for n in (2, 5)]
    assert again[0] == again[1] and len(set(again[0].values())) == 1000
    assert sharding.feistel_shards(none, ["doc_id"], 4).count() == 0 and sharding.feistel_shards(distinct.limit(1), ["doc_id"], 4).count() == 1


def test_op4_query(spark, tmp_path):
    """The query against a Feistel network in Python over all rows, with the hash taken from Spark."""
    rows = [(i, None if i == 5 else "é" * (i % 7) + f" text {i % 9}", "en") for i in range(203)]
    spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in sharding.op4_feistel_sharding(spark, str(tmp_path)).collect()}
    assert list(got[0].asDict())[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and len(got) == 203
    n = 203
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    known = {}
    for width in (a, b):
        pairs = spark.range(width).crossJoin(spark.range(sharding.ROUNDS).toDF("k")).selectExpr("id", "cast(k as int) AS k", "xxhash64(id, cast(k as int), 7L) AS h").collect()
        known |= {(x.id, x.k): x.h for x in pairs}
    walk = lambda x: x if x < n else walk(network(x))

    def network(x):
        l, r = divmod(x, b)
        for k in range(sharding.ROUNDS):
            l, r = ((l + known[r, k] % a) % a, r) if k % 2 == 0 else (l, (r + known[l, k] % b) % b)
        return l * b + r

    for i, text, _ in rows:
        raw = (text or "").encode()
        place = walk(network(i))  # ids are the row numbers here
        r = got[i]
        assert (r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", place % 40, place // 40, None)


def test_own_columns_stay(spark):
    """Columns with names that the operators use inside come back as they were."""
    names = ["doc_id", "text", "lang", "own", "part", "at", "tie", "key0", "weight", "_part", "_tie", "_at", "_weight", "_n0", "_w0", "_text", "_words", "_plain", "_lines", "_judged", "_counts", "kept_"]
    rows = [(i, f"text {i} " * 60, "en", *(f"{c}{i}" for c in names[3:])) for i in range(5)] + [(None, None, None, *names[3:])]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in names))
    for out in (sharding.feistel_shards(df, ["doc_id"], 3), quality.judge_quality(df), number_rows(df, ["_tie", "part"], F.length("_text"))):
        assert sorted(map(tuple, out.select(*names).collect()), key=repr) == sorted(rows, key=repr)
    assert quality.drop_rejected(df).columns == names


def test_number_rows(spark):
    df = spark.createDataFrame([(3, 5), (1, 7), (None, 1), (3, 2)], "k int, w int").repartition(3)
    from pyspark.sql import functions as F

    got = sorted((r.row_no, r.k, r.weight_before) for r in number_rows(df, ["k", "w"], F.col("w")).collect())
    assert got == [(0, None, 0), (1, 1, 1), (2, 3, 8), (3, 3, 10)]


# 5: near duplicates


def test_near_duplicates(docs, rows, none):
    got = near.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by_text = defaultdict(set)
    of = {r[0]: tuple(re.findall(WORDS, r[1] or "")) for r in rows}
    for r in got:
        by_text[of[r.doc_id]].add(r.class_id)
    assert all(len(v) == 1 for v in by_text.values())
    classes = {r.doc_id: r.class_id for r in got}
    assert classes[8] == classes[5] == 5 and classes[3] is None  # the copy of text 3 has a null id, which comes first
    assert classes[13] == 13 and classes[16] == 16
    assert near.near_duplicates(none).count() == 0
    assert near.drop_near_duplicates(docs).columns == docs.columns


def test_near_duplicates_find_all_links(spark):
    r = random.Random(7)
    rows = []
    for f in range(40):
        base = [f"v{r.randrange(400)}" for _ in range(r.randrange(30, 250))]
        for _ in range(r.randrange(1, 5)):
            copy = list(base)
            for _ in range(int(len(copy) * r.choice([0, 0.01, 0.03, 0.06]))):
                copy[r.randrange(len(copy))] = f"e{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    got = {x.doc_id: x.class_id for x in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ids = {w: i + 1 for i, w in enumerate({w for _, t in rows for w in t.split()})}
    arrays = [np.array([ids[w] for w in t.split()], np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if near.similar(arrays[i], arrays[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i in range(len(rows))}


def substituted(r, words, places):
    out = list(words)
    for i in places:
        out[i] = f"e{r.randrange(10**9)}"
    return out


def test_near_duplicates_of_a_hub(spark):
    """Copies that are like the original only: each is tied to it, however many there are."""
    r = random.Random(11)
    base = [f"v{r.randrange(10**6)}" for _ in range(200)]
    rows = [(0, " ".join(base))] + [(i, " ".join(substituted(r, base, r.sample(range(200), 30)))) for i in range(1, 301)]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.class_id for x in got} == {0}


def test_near_duplicates_close_to_the_threshold(spark):
    """Pairs of 5 to 30 words as far apart as is allowed, all of them; longer ones at 0.80 to 0.85, at random places."""
    r = random.Random(12)
    rows, short = [], 0
    for size in [*range(5, 31)] * 4 + [50, 100, 200, 400] * 30:
        base = [f"v{r.randrange(10**6)}" for _ in range(size)]
        short += size <= 30
        edits = size // 5 if size <= 30 else int(size * r.uniform(0.15, 0.2))
        places = [(i + 1) * size // (edits + 1) for i in range(edits)] if size <= 30 else r.sample(range(size), edits)
        copy = substituted(r, base, places)
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy if size % 2 else copy[:places[0]] + copy[places[0] + 1 :]))]
    got = {x.doc_id: x.class_id for x in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    found = [got[i] == got[i + 1] == i for i in range(0, len(rows), 2)]
    assert all(found[:short])
    assert sum(found[short:]) >= 119


def test_near_duplicates_with_even_edits(spark):
    """Recall where edits are spread evenly, so that the fewest k-mers are in common: similarities 0.80 to 0.85, all pairs known."""
    r = random.Random(13)
    rows = []
    for size in [60, 100, 200, 400] * 50:
        base = [f"v{r.randrange(10**6)}" for _ in range(size)]
        edits = int(size * r.uniform(0.15, 0.2))
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(substituted(r, base, [(2 * i + 1) * size // (2 * edits) for i in range(edits)])))]
    got = {x.doc_id: x.class_id for x in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert sum(got[i] == got[i + 1] == i for i in range(0, len(rows), 2)) >= 0.95 * len(rows) / 2
    assert all(got[i] == i for i in range(0, len(rows), 2))


@pytest.mark.parametrize("blocks", [1, 3])
def test_pairs_of_a_bucket(spark, monkeypatch, blocks):
    """All pairs of different classes, whether a bucket is one cell or several."""
    monkeypatch.setattr(near, "BLOCK", -(-40 // blocks))
    monkeypatch.setattr(near, "PAIRS", 50)
    r = np.random.RandomState(2)
    minima = [bytes(((r.rand(near.BINS) < 0.1) + 1).astype(np.uint8).tolist()) for _ in range(40)]
    # the first half of the texts have the same sketch 3, which is bucket 5's, and then bucket 6's; the others have none
    prints = [np.array([0, 0, 0, 5, 6] + [0] * (near.SKETCHES - 5), np.uint32).tobytes() if i < 20 else None for i in range(40)]
    texts = spark.createDataFrame([(i, 100 + i % 3, m, p) for i, (m, p) in enumerate(zip(minima, prints, strict=True))], "text long, words long, minima binary, prints binary")
    members = spark.createDataFrame([(b, i) for b in (5, 6) for i in range(40)], "bucket long, text long")
    tied = spark.createDataFrame([(i, i % 7) for i in range(40)], "node long, component long")
    apart = near._apart(members, texts, tied)
    assert apart.select("cell").distinct().count() == 2 * blocks * (blocks + 1) // 2
    got = {(x.a, x.b) for x in near._met(apart, 0.8, False).collect()}
    x, y = (np.array(v, np.uint32) for v in ([[0, 7, 8], [0, 7, 8], [0, 0, 0], [1, 7, 9]], [[0, 7, 8], [0, 1, 8], [0, 0, 0], [2, 7, 9]]))
    assert [near._here(x, y, b << 40 | b).tolist() for b in (7, 8)] == [[True, False, True, True], [False, True, True, False]]
    assert got == {(a, b) for a in range(40) for b in range(a + 1, 40) if a % 7 != b % 7}
    best = {(x.a, x.b) for x in near._met(apart, 0.8, True).collect()}
    agree = lambda a, b: sum(x == y for x, y in zip(minima[a], minima[b], strict=True))
    highest = {i: max(agree(i, j) for j in range(40) if i % 7 != j % 7) for i in range(40)}
    assert all(any(i in x and agree(*x) == highest[i] for x in best) for i in range(40))
    assert best <= got and {x for p in best for x in p} == set(range(40))


def test_near_duplicates_among_reordered_templates(spark):
    """Texts that put the same blocks in another order are no copies, but share their words; a copy of one of them with 12 % of its words replaced is found all the same."""
    r = random.Random(21)
    blocks = [[f"w{b}_{i}" for i in range(20)] for b in range(12)]
    rows = []
    for i in range(60):
        words = [w for b in r.sample(blocks, 12) for w in b]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(substituted(r, words, r.sample(range(240), 28))))]
    got = {x.doc_id: x.class_id for x in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i] == got[2 * i + 1] == 2 * i for i in range(60))


def test_near_duplicates_in_a_crowd(spark):
    """Copies of copies with many words in common: every class that a comparison of all pairs gives, but for one pair in fifty."""
    r = random.Random(22)
    base = [f"v{r.randrange(300)}" for _ in range(120)]
    texts = [base]
    for _ in range(179):
        texts.append(substituted(r, r.choice(texts), r.sample(range(120), r.randrange(8, 40))))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {x.doc_id: x.class_id for x in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    ids = {w: i + 1 for i, w in enumerate({w for t in texts for w in t})}
    arrays = [np.array([ids[w] for w in t], np.uint64) * np.uint64(0x9E3779B97F4A7C15) for t in texts]
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if near.similar(arrays[i], arrays[j])]
    assert len(alike) > 100
    assert sum(got[i] == got[j] for i, j in alike) >= 0.98 * len(alike)
    parts = {}
    for i, c in got.items():
        parts.setdefault(c, []).append(i)
    linked = {frozenset(p) for p in alike}
    for own in parts.values():  # nothing else is put together
        seen, open_ = {own[0]}, [own[0]]
        while open_:
            x = open_.pop()
            more = {y for y in own if y not in seen and frozenset((x, y)) in linked}
            seen |= more
            open_ += more
        assert seen == set(own)


@pytest.mark.parametrize("words", [12, 60, 400, 3000])
def test_bins_keep_pairs_at_the_threshold(words):
    """Of pairs with the least words in common that similar ones can have, the bins rule one in a hundred out at most; of those at similarity 0.6 they rule most out."""
    r = np.random.RandomState(words)
    kept = {0.2: 0, 0.4: 0}
    for edits in kept:
        pairs = [r.randint(1, 2**62, (1, words)).astype(np.uint64) for _ in range(100)]
        for a in pairs:
            b = a.copy()
            b[0, r.choice(words, int(words * edits), replace=False)] = r.randint(1, 2**62, int(words * edits))
            codes = []
            for x in (a[0], b[0]):
                w = type("W", (), {"first": np.array([0, words])})()
                codes.append(near._word_minima(w, x, np.array([True]))[1])
            _, fit = near._agree(*codes, np.array([words]), np.array([words]), 0.8)
            kept[edits] += int(fit[0])
    assert kept[0.2] >= 99 and kept[0.4] <= 40


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_alignment():
    r = random.Random(3)
    for _ in range(200):
        a = [r.randrange(r.choice([3, 30])) for _ in range(r.randrange(1, 40))]
        b = [x for x in a if r.random() > 0.1]
        b.insert(r.randrange(len(b) + 1), 99)
        x, y = (np.array(v, np.uint64) * np.uint64(0x9E3779B97F4A7C15) for v in (a, b))
        band = int(0.2 * max(len(a), len(b)) + 1e-9)
        assert near.similar(x, y) == (distance(a, b) <= band)
        for wide in (0, 1, band, len(a)):
            assert near._banded_distance(x, y, wide) == min(distance(a, b), wide + 1)


def test_alignment_of_long_texts():
    """Ten thousand words within seconds, and words of every frequency."""
    r = random.Random(5)
    base = [r.randrange(4) if r.random() < 0.5 else r.randrange(10**6) for _ in range(10_000)]
    edited = [x if r.random() > 0.15 else 10**7 + r.randrange(10**6) for x in base]
    x, y, z = (np.array(v, np.uint64) * np.uint64(0x9E3779B97F4A7C15) for v in (base, edited, base[3000:] + base[:3000]))
    start = time.time()
    changed = sum(p != q for p, q in zip(base, edited, strict=True))
    assert near._banded_distance(x, y, 2000) == changed and near.similar(x, y) and not near.similar(x, z)
    assert time.time() - start < 10



@pytest.mark.parametrize("local", [10, 10**6])
def test_components(spark, local):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 100), (7, 7), (60, 61)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), local=local).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 50: 50, 100: 50, 60: 60, 61: 60}
    assert connected_components(spark.createDataFrame([], "a long, b long"), local=local).count() == 0


def test_components_of_one_large_star(spark):
    """The edges of one node are dealt over tasks."""
    edges = spark.createDataFrame([(i, 0) for i in range(1, 4001)], "u long, v long")
    sizes = [r["count"] for r in components._dealt(edges, 4000, 100).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 800
    got = connected_components(edges, "u", "v", local=500).collect()
    assert len(got) == 4001 and {r.component for r in got} == {0}


# 6: secret scans


def test_base_spans():
    text = "token = short, PassWord: 'abcdefghijkl' AKIA" + "B" * 14 + " AKIAB " + "0123456789abcdef" * 2 + " api_key=secret=abcdefghijklm é secret : x"
    want = [(m.start(), 0, m.end()) for m in secret_scan.ASSIGN.finditer(text) if len(m[2]) >= 12]
    want += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    want += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    assert secret_scan.base_spans(text) == sorted(want) and len(want) == 4
    assert secret_scan.base_spans("ſecret=abcdefghijklmn") == [] and secret_scan.base_spans("") == []


ALPHABETS = {"base64": string.ascii_letters + string.digits + "+/", "capital hex": "0123456789ABCDEF", "small and digits": string.ascii_lowercase + string.digits, "letters": string.ascii_letters, "capitals": string.ascii_uppercase}


@pytest.mark.parametrize("kind", ALPHABETS)
def test_novel_strings(kind):
    code = "def connect(host, port):\n    return Session(host, port)\n"
    r = random.Random(1)
    for n in (24, 48, 200, 1000, 5000, 100_000):
        key = "".join(r.choice(ALPHABETS[kind]) for _ in range(n))
        before = f"{code}# private_key follows -> "
        text = f"{before}{key}. Then\n{code}"
        found = [(a, b) for a, _, b in secret_scan.novel_spans(text, secret_scan.base_spans(text))]
        assert found == [(len(before), len(before) + n)], n
        assert secret_scan.novel_spans(f"{code} unrelated {key}", []) == []


def test_names_are_not_novel():
    for name in ("authentication_token_manager1", "com.example.service.impl.UserAccountManagerFactory", "XMLHttpRequestEventTargetListener", "KUBERNETES_SERVICE_ACCOUNT_NAMESPACE", "www.example.com/docs/reference/configuration.html", "1234567890123456", "misunderstandings"):
        assert secret_scan.novel_spans(f"def connect(host, port):\n    return Session(host)\n# the token of {name} and so on", []) == []


def test_scan_is_linear():
    start = time.time()
    for text in ("token" * 20_000, "token " * 20_000, "token=a1b2c3d4e5f6g7h8i9 " * 20_000, "tokenA1b2C3d4E5f6G7h8I9 " * 2_000):
        secret_scan.novel_spans(text, secret_scan.base_spans(text))
    assert time.time() - start < 10
    start = time.time()
    assert secret_scan.novel_spans("token" * 20_000, []) == [] and time.time() - start < 1
    # a megabyte of base spans under one long assignment
    text = "token=" + ("secret" + "0" * 16 + "g") * 40_000
    start = time.time()
    assert secret_scan.novel_spans(text, secret_scan.base_spans(text)) == [] and time.time() - start < 3


def test_half_covered_strings():
    """Strings near a sensitive word are left to base spans that cover half of them or more, whatever overlaps."""
    r = random.Random(8)
    for _ in range(200):
        spans = sorted((a, r.randrange(3), a + r.randrange(1, 30)) for a in (r.randrange(150) for _ in range(r.randrange(6))))
        starts, ends, before = secret_scan._disjoint(spans)
        covered = {x for a, _, b in spans for x in range(a, b)}
        assert {x for a, b in zip(starts, ends, strict=True) for x in range(a, b)} == covered
        assert before == [len([x for x in covered if x < a]) for a in starts] + [len(covered)]


def test_a_key_that_holds_a_sensitive_word_is_one():
    key = "Zq8Rt2Lw9XcVb4Nm7Kp1Js6Hd3Gf5"
    text = f"bearer {key}akia{key[::-1]} end"
    assert secret_scan.novel_spans(text, []) == [(7, 3, 7 + 2 * len(key) + 4)]


def test_op6_query(spark, tmp_path):
    """Base columns against a brute-force scan that tries every start of every text."""
    r = random.Random(3)
    parts = ["token=", "api_key: ", "PassWd'=\"", "AKIA", "0123456789abcdef", "Zq8Rt2Lw9XcVb4Nm7Kp1Js6", "bearer ", "é", " ", "\n", "deadbeef", "secret", "AKIAABCDEFGHIJKLMN", "word"]
    rows = [(i, "".join(r.choices(parts, k=r.randrange(12)))) for i in range(150)] + [(900, None), (901, ""), (902, "token=abcdefghijkl"), (902, "token=abcdefghijkl")]
    spark.createDataFrame([(*x, "en", 1) for x in rows], "doc_id long, text string, lang string, spans int").write.parquet(str(tmp_path / "documents.parquet"))

    def brute(text):
        out = []
        for kind, (pattern, flags, least) in enumerate([(secret_scan.ASSIGN.pattern, re.ASCII | re.IGNORECASE, lambda m: len(m[2]) >= 12), (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 18), (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 16)]):
            at = 0
            while at < len(text):
                m = re.compile(pattern, flags).match(text, at)
                if m and least(m):
                    out.append((at, kind, m.end()))
                at = m.end() if m else at + 1
        return sorted(out)

    def line(doc, text):
        spans = brute(text or "")
        n = Counter(k for _, k, _ in spans)
        return doc, n[0], n[1], n[2], sha(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans))

    got = secret_scan.op6_zstd_novelty(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"]
    got = got.collect()
    assert Counter((x.doc_id, x.n_assign, x.n_access, x.n_hex, x.base_sha256) for x in got) == Counter(line(*x) for x in rows)
    assert sum(x.n_novel for x in got) > 0 and all(x.spans.count("novel:") == x.n_novel for x in got)


def test_scan_and_mask(spark, docs, none):
    df = spark.createDataFrame([(1, "x token=abcdefghijkl1 y", "s"), (2, None, "s"), (3, "", "s"), (1, "x token=abcdefghijkl1 y", "s")], "doc_id long, text string, spans string")
    got = secret_scan.scan_secrets(df).collect()
    assert [[(s.kind, s.start, s.end) for s in r.spans] for r in sorted(got, key=lambda r: r.doc_id)] == [[("assign", 2, 21)], [("assign", 2, 21)], [], []]
    masked = secret_scan.mask_secrets(df)
    assert masked.columns == df.columns and sorted(("-" if r.text is None else r.text) for r in masked.collect()) == ["", "-", "x <secret> y", "x <secret> y"]
    assert secret_scan.scan_secrets(none).count() == 0 and secret_scan.scan_secrets(docs).count() == docs.count()


def test_long_secrets_are_whole(spark):
    r = random.Random(6)
    key = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(10_000))
    df = spark.createDataFrame([(1, f"private_key follows: {key} end")], "doc_id long, text string")
    assert [(s.kind, s.start, s.end) for s in secret_scan.scan_secrets(df).first().spans if s.kind == "novel"] == [("novel", 21, 10_021)]
    assert secret_scan.mask_secrets(df).first().text == "private_key follows: <secret> end"


# 7, 9, 10: tokens


def test_prefix_bpe(docs, rows, none):
    t = tokens.load_tokenizer(WORD)
    want = sorted((t.encode(r[1] or "", add_special_tokens=False).ids, t.decode(t.encode(r[1] or "", add_special_tokens=False).ids, skip_special_tokens=False)) for r in rows)
    assert sorted((list(r.ids), r.decoded) for r in tokens.prefix_encode(docs, WORD).collect()) == want
    assert tokens.prefix_encode(none, WORD).count() == 0


def test_encoders_equal_the_library():
    r = random.Random(8)
    some = ["".join(r.choice("aB eéÀ.\n!1'²½ªµß\tsS÷× œ\xad<|ΣσİΑ😀ll've") for _ in range(200)) for _ in range(300)] + [x or "" for x in texts()]
    for path in (WORD, BYTE):
        t = tokens.load_tokenizer(path)
        want = [x.ids for x in t.encode_batch(some, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in tokens.id_bytes(path)(some)] == want
        if path == WORD:
            assert [np.frombuffer(a, np.int32).tolist() for a, _ in tokens.prefix_encoder(path)(some)] == want


def test_token_queries(spark, tmp_path, rows):
    """The three queries' columns and digests, by the library over whole texts."""
    ids = [(r[0], r[1] or "") for r in rows if r[0] is not None]
    ids = [(i, t) for i, (_, t) in enumerate(ids)]
    spark.createDataFrame([(i, t, 1) for i, t in ids], "doc_id long, text string, start int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    word, byte = tokens.load_tokenizer(WORD), tokens.load_tokenizer(BYTE)
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    plain = {i: word.encode(t, add_special_tokens=False).ids for i, t in ids}
    got = {r.doc_id: tuple(r)[1:4] for r in tokens.op7_prefix_bpe(spark, str(tmp_path)).collect()}
    assert got == {i: (len(x), sha(" ".join(map(str, x))), sha(word.decode(x, skip_special_tokens=False))) for i, x in plain.items()}
    at, want = 0, {}
    for i, t in ids:
        x = [*byte.encode(t, add_special_tokens=False).ids, 0]
        want[i] = (at, len(x), crc(x))
        at += len(x)
    assert {r.doc_id: tuple(r)[1:4] for r in idfiles.op9_orc_ids(spark, str(tmp_path)).collect()} == want
    pieces = {(i, k // 2048, k, len(x[k : k + 2048]), crc(x[k : k + 2048])) for i, v in plain.items() for x in ([*v, 0],) for k in range(0, len(x), 2048)}
    packed = packing.op10_residual_packing(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed} == pieces and len(packed) == len(pieces)
    check_bins([(r.sequence_id, r.offset, r.length) for r in packed], 2048)


def test_lookup_starts_anew():
    table = tokens.WordTable(lambda ws: [w.upper() for w in ws], entries=3)
    for _ in range(3):
        assert table.values(["a", "b", "c", "d", "a", "x" * 99]) == ["A", "B", "C", "D", "A", "X" * 99]


def test_id_files(spark, docs, rows, none):
    t = tokens.load_tokenizer(BYTE)
    path = shared_path(spark, "test-ids")
    write_ids(docs, path, BYTE, 0)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in ids_crc32(read_ids(spark, path)).collect()]
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    at, seen = 0, Counter()
    for doc, start, n, crc in got:
        assert start == at
        at += n
        seen[doc, n, crc] += 1
    ids = [[*t.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows]
    assert seen == Counter((r[0], len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, i in zip(rows, ids, strict=True))
    assert {r.doc_id for r in read_ids(spark, path, [5, 13]).collect()} == {5, 13}
    empty = shared_path(spark, "test-none")
    write_ids(none, empty, BYTE, 0)
    assert read_ids(spark, empty).count() == 0


def test_id_files_split_equal_ids(spark):
    df = spark.range(0, 4000, 1, 4).selectExpr("if(id % 4 = 0, id, 7L) AS doc_id", "concat('text ', id) AS text")
    path = shared_path(spark, "test-hot")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    write_ids(df, path, BYTE, 0)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = spark.read.orc(path).where("doc_id = 7").groupBy("part").count().collect()
    assert len(parts) > 1 and sum(p["count"] for p in parts) == 3000
    rows = sorted((r.start, r.n_tokens, r.doc_id) for r in read_ids(spark, path).collect())
    assert [r[2] for r in rows] == sorted(r[2] for r in rows) and all(a[0] + a[1] == b[0] for a, b in zip(rows, rows[1:], strict=False))


def test_id_files_have_indexes(spark):
    """Row indexes and Bloom filters are in the stripes, and a look-up by id reads a part of the rows."""
    path = shared_path(spark, "test-index")
    df = spark.range(0, 200_000, 2).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    write_ids(df.coalesce(1), path, BYTE, 0)
    jvm = spark._jvm
    file = next(f for f in spark.read.orc(path).inputFiles() if f.endswith(".orc"))
    orc = jvm.org.apache.orc.OrcFile
    reader = orc.createReader(jvm.org.apache.hadoop.fs.Path(file), orc.readerOptions(spark._jsc.hadoopConfiguration()))
    stripe = reader.getStripes()[0]
    kinds = {str(x.getKind()) for x in reader.rows().readStripeFooter(stripe).getStreamsList()}
    assert "ROW_INDEX" in kinds and any(k.startswith("BLOOM_FILTER") for k in kinds)

    def read(ids):
        found = spark.read.orc(path).where(F.col("doc_id").isin(ids)).select("doc_id")
        rows = found.collect()
        leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head()
        return len(rows), leaf.metrics().apply("numOutputRows").value()

    total = spark.read.orc(path).count()
    assert total == 100_000
    for ids, hits in (([200], 1), ([201], 0), ([100_001, 150_001], 0)):
        n, scanned = read(ids)
        assert n == hits and scanned <= total // 4


def test_packing(docs, rows, none):
    t = tokens.load_tokenizer(WORD)
    got = packing.pack_documents(docs, 64, WORD, 0).collect()
    want = Counter()
    for doc, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            want[doc, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    check_bins([(r.sequence_id, r.offset, r.length) for r in got], 64)
    assert packing.pack_documents(none, 64, WORD, 0).count() == 0


def check_bins(placed, capacity):
    bins = defaultdict(list)
    for b, at, n in placed:
        bins[b].append((at, n))
    for items in bins.values():
        at = 0
        for start, n in sorted(items):
            assert start == at
            at += n
        assert at <= capacity
    return len(bins)


def test_rounds_join_underfull_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    r = random.Random(5)
    lengths = [r.choice([100, 37, 61, r.randrange(1, 100)]) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    got = packing.pack_pieces(df, 100).collect()
    n = check_bins([(x.sequence_id, x.offset, x.length) for x in got], 100)
    assert len(got) == 600 and n <= 1.05 * (sum(lengths) / 100) + 2


def test_ids_of_sequences_never_meet(spark):
    """A full piece of a late partition, and bins of every round and of very many groups."""
    df = spark.createDataFrame([(1 << 56, 2048), (1, 100), (2, 200), (packing.first_item(70_000), 2048)], "item long, length long")
    got = packing.pack_pieces(df, 2048).collect()
    check_bins([(r.sequence_id, r.offset, r.length) for r in got], 2048)
    assert len({r.sequence_id for r in got}) == 3
    some = [int(x) for level in (1, 2, 63, 1023) for group in (0, 1, (1 << 21) - 1, 1 << 21, 1 << 33) for x in packing.bin_ids(level, group, np.array([0, 1, (1 << 18) - 1]))]
    assert len(set(some)) == len(some) and max(some) < 0 and min(some) > -(1 << 63)
    assert 0 <= packing.first_item(1 << 22) < 1 << 63
    with pytest.raises(ValueError):
        packing.bin_ids(1, 0, np.array([1 << 18]))


def test_best_fit():
    bins, offsets, fills = packing.best_fit([6, 5, 4, 4, 1], 10)
    assert bins == [0, 1, 0, 1, 1] and offsets == [0, 0, 6, 5, 9] and fills == [10, 10]


# 8: quality rules


def brute_counts(text):
    w = re.findall(WORDS, text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(WORDS, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, docs, rows, none):
    more = [(100, "a b c a b c\na\na\n \n \nb", None, None, None), (101, "# $ x\n" * 60, None, None, None), (102, "a b a b a", None, None, None)]
    df = docs.unionByName(spark.createDataFrame(more, DOCS))
    from pyspark.sql import functions as F

    judged = quality.judge_quality(df.withColumns({"lang": F.lit("en"), "kept": F.lit("x")}))
    got = Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judged.collect())
    want = Counter()
    for r in [*rows, *more]:
        n, chars, symbols, lines, repeats = brute_counts(r[1] or "")
        want[n, chars, symbols, lines, repeats, n < 50 or 100 * repeats > 50 * n] += 1
    assert got == want
    assert quality.judge_quality(none.withColumn("lang", F.lit(None).cast("string"))).count() == 0


def prose_like(lang, n, seed=2, common=True):
    """Words with the language's shares of common words and of character classes."""
    r = random.Random(seed)
    parts = {"en": ["the", "an", "or", "in", "er", "ed", "re", "ti", "on", "sh", "nd"], "fr": ["ai", "eu", "tion", "é", "ou", "re", "la", "que", "ment", "s", "tr"]}[lang]
    made = lambda: "".join(r.choice(parts) for _ in range(3))
    shares = quality.WORDS[lang]
    return " ".join(r.choices(quality.COMMON[lang], shares)[0] if common and r.random() < sum(shares) else made() + r.choice(["", "", "", "", "."]) for _ in range(n))


def test_quality_verdicts(spark):
    clean = prose_like("en", 150)
    rows = [(1, clean, "en"), (2, clean.upper(), "en"), (3, "#$% ".join(clean.split()), "en"), (4, clean, None), (5, clean, "xx"), (6, None, "en"), (7, "thy " + " ".join(f"zq{i}x" for i in range(200)), "en")]
    # a list of keywords: letters as in prose, no common words
    rows += [(8, prose_like("en", 150, common=False), "en"), (9, prose_like("fr", 200), "fr"), (10, prose_like("fr", 200, 3), "en"), (11, "", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.kept, r.class_distance, r.word_distance) for r in quality.judge_quality(df).collect()}
    assert got[1][0] and got[9][0] and not got[2][0] and not got[3][0] and not got[6][0] and not got[10][0] and not got[11][0]
    assert not got[8][0] and got[8][1] < quality.CLASS_DISTANCE and got[8][2] > quality.WORD_DISTANCE
    assert got[4] == got[5] == (True, None, None)
    assert {r.doc_id for r in quality.drop_rejected(df).collect()} == {i for i, x in got.items() if x[0]}


def test_quality_references_are_fitted(spark):
    """What is stored is what the fit gives on the labelled documents, to within the sample."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    classes, words = quality.fit_references(docs.join(labels.where("quality = 1"), "doc_id", "left_semi"))
    assert classes.keys() == quality.CLASSES.keys() and words.keys() == quality.WORDS.keys()
    for lang in classes:
        assert np.abs(np.array(classes[lang]) - quality.CLASSES[lang]).max() < 0.02
        assert np.abs(np.array(words[lang]) - quality.WORDS[lang]).max() < 0.015
    assert quality.fit_references(docs.limit(0)) == ({}, {})


def test_js_distance(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.9, 0.1], [0.5, 0.5])], "p array<double>, q array<double>")
    p, q = np.array([0.9, 0.1]), np.array([0.5, 0.5])
    m = (p + q) / 2
    want = np.sqrt(((p * np.log2(p / m)).sum() + (q * np.log2(q / m)).sum()) / 2)
    assert [r[0] for r in df.select(quality.js_distance("p", "q")).collect()] == pytest.approx([1, 0, want])
