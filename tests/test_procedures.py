"""Goldens of text procedures, traversal, streams and sinks."""

import pytest
from pyspark.sql import functions as F

from conftest import SF
from siftmark.functions import procedures as P
from siftmark.functions import text as T
from siftmark.operators.graph import promote_edges
from siftmark.operators.review import changed_lines, match_in_order, publishable, sharing_pairs
from siftmark.operators.scalars import glob_pattern
from siftmark.plans.retrieval import bounded_int, clean_weight, diversified_top
from siftmark.plans.traversal import Limits, best_first, fuse_context
from siftmark.sources.files import append_metrics, export_events, read_config, seeded, walk, write_bundle
from siftmark.streaming.logs import event_stream, log_sink, open_items, windowed_counts


def test_chunks_overlap_and_cover():
    text = "\n".join(f"line {i} content" for i in range(1, 121))
    found = P.chunks(text, 240, 48, 20)
    assert len(found) > 1 and found[0][1] == 1 and found[-1][2] == 120
    assert all(b[1] <= a[2] for a, b in zip(found, found[1:]))


def test_chunks_short_long_and_blank():
    assert P.chunks("a\nb\nc", 400, 40, 6) == [(0, 1, 3, "a\nb\nc")]
    found = P.chunks("x" * 1200, 240, 40, 20)
    assert len(found) > 1 and all(len(c[3]) <= 300 for c in found)
    assert P.chunks(" \n ") == [] and P.chunks("") == []


def test_chunk_count_takes_the_rest():
    found = P.chunks("\n".join("w" * 50 for _ in range(100)), 300, 0, 2)
    assert len(found) == 2 and found[1][2] == 100 and len(found[1][3]) <= 600


@pytest.mark.parametrize(
    "patch, want",
    [
        ("--- a/src/a.ts\n+++ b/src/a.ts\n@@ -1,3 +1,4 @@\n a\n-b\n+c\n+d\n e", {("src/a.ts", 2), ("src/a.ts", 3)}),
        ("--- a/x.ts\n+++ b/x.ts\n@@ -10,3 +10,0 @@\n-a\n-b\n-c", {("x.ts", 10), ("x.ts", 11), ("x.ts", 12)}),
        ("+++ /dev/null\n@@ -1 +1 @@\n-a", set()),
        ("", set()),
    ],
)
def test_changed_lines(spark, patch, want):
    got = changed_lines(spark.createDataFrame([(1, patch)], "id int, patch string")).collect()
    assert {(r.path, r.line) for r in got} == want


def test_diff_lines_have_both_sides():
    found = P.diff_lines("--- a/b/lib/u.ts\n+++ b/b/lib/u.ts\n@@ -5,2 +7,2 @@\n a\n-b\n+c")
    assert [(p, s, n) for p, s, n, _ in found] == [("b/lib/u.ts", "LEFT", 5), ("b/lib/u.ts", "RIGHT", 7), ("b/lib/u.ts", "LEFT", 6), ("b/lib/u.ts", "RIGHT", 8)]


def test_statements_have_the_line_of_their_first_word():
    text = "\n\nuse std::io\nlet import\n\nimport a from './a'\n \n  import os\n\nuse std::export\nlet b\nlet export\n\nlet c; export const d = 1\nimport {e}\n  from './e'\n\n  pub fn f"
    assert P.statements(text) == [("import", "std::io", 3), ("import", "./a", 6), ("import", "os", 8), ("import", "std::export", 10), ("export", "d", 14), ("import", "./e", 15), ("export", "f", 18)]


def test_statements_query_with_blank_lines_and_keywords(spark, tmp_path):
    """Lines whose first words are the statements' own keywords, and blank ones between, in every order; and every character beside letters."""
    import duckdb

    from siftmark.queries import ORACLE_SQL, QUERIES

    words = ["import", "export", "let", "from", "use", "", "  ", "Const x"]
    texts = ["\n".join(words[(i // 8**k) % 8] for k in range(4)) + "\n" + "\n".join(words[(i * 7 + k * k) % 8] for k in range(9)) for i in range(0, 4096, 3)]
    texts += ["\n".join(f"ab{chr(c)}cd" for c in range(at, at + 256) if c != 10 and not 0xD800 <= c < 0xE000) for at in range(1, 0x2FFFF, 256)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    mine = QUERIES["sf16_statements"](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(mine.columns)} FROM ({ORACLE_SQL['sf16_statements']})").fetchall()
    assert sorted(map(tuple, mine.collect())) == sorted(want) and len(want) > 10000


def test_middle_cut_keeps_whole_characters():
    assert P.middle_cut("short", 10) == "short"
    cut = P.middle_cut("é" * 50, 21)
    assert cut.startswith("é" * 5) and cut.endswith("é" * 5) and "40 chars" in cut


def test_find_lines():
    assert P.find_lines(["a", "b ", " c"], ["b", "c"]) == 1
    assert P.find_lines(["say “hi”"], ['say "hi"']) == 0
    assert P.find_lines(["a"], ["z"]) is None and P.find_lines(["a"], []) == 0


def test_find_json():
    assert P.find_json('noise {bad} ```json\n{"x": {"k": 2}}\n``` end', {"k"}) == {"k": 2}
    assert P.find_json("no json", {"k"}) is None


def test_python_symbols():
    assert ("function", "f", 1, 2) in P.python_symbols("def f():\n    pass") and P.python_symbols("def (") == []


def test_weight_rules(spark):
    rows = spark.createDataFrame([(10, 2, 0, 0), (5, 1, 3, 0), (0, 0, 0, 0), (0, 0, 0, 4)], "a int, i int, p int, n int")
    got = [r[0] for r in rows.select(T.weight(F.col("a"), F.col("i"), F.col("p"), F.col("n"))).collect()]
    assert got == pytest.approx([8 / 13, 0.6 * 4 / 7 + 0.4 * 3 / 4, 0, -0.8])


def test_clean_weight():
    assert [clean_weight(x, 0.5) for x in (None, float("nan"), -1.0, 0.0, 0.3, 7.0)] == [0.5, 0.5, 0, 0, 0.3, 1]


def test_bounded_int():
    assert [bounded_int(x, 20, 1, 100) for x in ("7", 7.9, "x", None, float("inf"), -3, 1000)] == [7, 7, 20, 20, 20, 1, 100]


def top(spark, rows, k, cap, changed=None):
    df = spark.createDataFrame(rows, "id long, path string, score double")
    return [r.id for r in diversified_top(df, k, cap, changed).orderBy("place").collect()]


def test_top_fills_from_overflow(spark):
    rows = [(i, "a.ts", 101.0 - i) for i in range(1, 6)] + [(i, "b.ts", 101.0 - i) for i in range(6, 9)]
    assert top(spark, rows, 6, 2) == [1, 2, 6, 7, 3, 4]


def test_top_anchors_changed_paths(spark):
    rows = [(1, "core/a", 100.0), (2, "core/b", 99.0), (3, "changed/target", 40.0), (4, "core/c", 98.0), (5, "core/d", 97.0)]
    assert top(spark, rows, 4, 1, ["changed/target"]) == [3, 1, 2, 4]


def test_blank_paths_have_no_cap(spark):
    assert top(spark, [(i, None, float(i)) for i in range(1, 7)], 5, 1) == [6, 5, 4, 3, 2]


EDGE = "repo long, from_id long, to_id long, type string, weight long"


def traversal(spark, edges, kinds=None, limits=Limits()):
    ids = {x for e in edges for x in e[:2]}
    nodes = spark.createDataFrame([(1, i, (kinds or {}).get(i, "file")) for i in ids], "repo long, id long, type string")
    found = best_first(spark.createDataFrame([(1, *e) for e in edges], EDGE), nodes, spark.createDataFrame([(1, 1, 1.0)], "repo long, id long, score double"), limits)
    return {r.id: r for r in found.collect()}


def test_best_first_factors_by_type_and_direction(spark):
    got = traversal(spark, [(1, 2, "file_dep", 1), (3, 1, "file_dep", 10), (2, 4, "references_symbol", 100), (5, 1, "dir_contains_file", 1), (1, 6, "unknown", 1)])
    # out 0.74; in 0.88 * (1 + 0.22); then out 0.82 with the boost at its most of 1.28
    assert {i: (round(r.score, 6), r.depth) for i, r in got.items()} == {1: (1.0, 0), 2: (0.74, 1), 3: (round(0.88 * 1.22, 6), 1), 4: (round(0.74 * 0.82 * 1.28, 6), 2)}
    assert got[4].via == ["1 --file_dep--> 2", "2 --references_symbol--> 4"] and got[1].via == []
    assert got[1].visited == 4 and traversal(spark, [(1, 2, "file_dep", 1), (2, 3, "file_dep", 1)], limits=Limits(nodes=1)).keys() == {1, 2}


def test_best_first_fan_out_and_budget(spark):
    # eight edges of a strong type from a node, two of a directory's; files go before symbols, as their rank is higher
    star = [(1, i, "file_dep", 1) for i in range(10, 22)] + [(1, i, "dir_contains_file", 1) for i in range(30, 35)]
    got = traversal(spark, star, {i: "symbol" for i in range(10, 16)})
    assert {i for i in got if 10 <= i < 22} == {*range(16, 22), 10, 11} and {i for i in got if i >= 30} == {30, 31}
    # the budget of a type: 120 * max(0.5, 100 / 2400), 80 at least
    assert Limits(nodes=100).budget("dir_contains_dir") == 80 and Limits().budget("file_dep") == 953
    chain = [(i, i * 10 + k, "contains_symbol", 1000) for i in (1, *range(10, 14), *range(100, 140)) for k in range(4)]
    got = traversal(spark, chain, limits=Limits(nodes=20))
    assert max(r.followed for r in got.values()) == 80


def test_fusion(spark):
    """A request with one changed file; scores and places worked out by hand."""
    schema = "repo long, path string, score double, depth int"
    graph = spark.createDataFrame([(1, "a/near.ts", 0.8, 1), (1, "b/two.ts", 0.3, 2), (1, "b/deep.ts", 0.9, 4), (1, "b/weak.ts", 0.2, 1), (1, "a/changed.ts", 1.0, 0)], schema)
    retrieved = spark.createDataFrame([(1, "c/best.ts", 2.0), (1, "b/two.ts", 1.0), (1, "c/low.ts", 0.4)], "repo long, path string, score double")
    hot = spark.createDataFrame([(1, "b/two.ts", 1, 5), (1, "c/low.ts", 0, 1)], "repo long, path string, open long, historical long")
    changed = spark.createDataFrame([(1, "a/changed.ts")], "repo long, path string")
    got = fuse_context(graph, retrieved, hot, changed).orderBy("place").collect()
    # retrieval 2.0 is the most: shares 1, 0.5, 0.2; the last isn't near, nor hot, nor in the graph, so it has no score of its own
    want = [("c/best.ts", "retrieval", 0.52), ("b/two.ts", "retrieval", 0.3 * 0.34 + 0.5 * 0.52 + 0.04 + 0.04 + 0.04), ("c/low.ts", "retrieval", None), ("b/deep.ts", "graph", None), ("a/near.ts", "graph", 0.8 * 0.34 + 0.06 + 0.08), ("b/weak.ts", "graph", None)]
    assert [(r.path, r.source) for r in got] == [w[:2] for w in want] and [r.place for r in got] == list(range(1, 7))
    assert [r.score for r in got] == [None if w[2] is None else pytest.approx(w[2]) for w in want]


def test_fusion_reads_the_traversal(spark):
    """CP8 on CP7's output: what traversal doesn't find can't come from the graph."""
    from siftmark.catalog import graph_edges, graph_nodes
    from siftmark.queries import QUERIES

    files = graph_nodes(spark, SF).where("type = 'file'")
    changed = {(r.repo, r.path) for r in files.where("id = 2 * repo or id = repo + 100").collect()}
    seeds = files.where("id = 2 * repo or id = repo + 100").select("repo", "id", F.lit(1.0).alias("score"))
    reached = {(r.repo, r.path) for r in best_first(graph_edges(spark, SF), graph_nodes(spark, SF), seeds).join(files, ["repo", "id"]).collect()}
    got = QUERIES["cp8_traversal_fusion"](spark, SF).collect()
    assert got and all((r.repo, r.path) in reached for r in got if r.source == "graph") and any(r.source == "graph" for r in got)
    assert not {(r.repo, r.path) for r in got} & changed


MATCH = "request long, path string, id long, ordinal long, line long, hunk long, category string, key string, title_key string, side string, severity string, tt array<string>, bt array<string>"


def test_matching_consumes_old_findings(spark):
    row = lambda id, line, hunk, key, title_key, tt, category="bug": (1, "a.ts", id, id, line, hunk, category, key, title_key, "RIGHT", "nit", tt, [])
    new = [row(1, 10, 0, "x", "n", ["one"]), row(2, 11, 0, "y", "n", ["two"]), row(3, 12, 0, "z", "n", ["three", "four"]), row(4, 13, 9, "w", "same", ["five"]), row(5, 14, 0, "v", "n", ["six"]), row(6, 10, 0, "x", "n", ["one"])]
    old = [row(70, 10, 0, "x", "o", ["one"]), row(80, 30, 0, "q", "o", ["other"]), row(90, 500, 4, "r", "o", ["three", "four"]), row(95, 900, 7, "s", "same", ["seven"])]
    got = {r.id: (r.matched, r.step) for r in match_in_order(spark.createDataFrame(new, MATCH), spark.createDataFrame(old, MATCH)).collect()}
    # exact; nearest of the hunk; alike by title at any distance; same title; nothing left; exact keys don't ask whether they were taken
    assert got == {1: (70, 1), 2: (80, 2), 3: (90, 3), 4: (95, 4), 5: (None, None), 6: (70, 1)}


def test_exact_keys_prefer_open_findings(spark):
    row = lambda id, key, *status: (1, "a.ts", id, id, 10 * id, id, "bug", key, f"t{id}", "RIGHT", "nit", [], [], *status)
    new = spark.createDataFrame([row(1, "x"), row(2, "y"), row(3, "z")], MATCH)
    old = [row(70, "x", "fixed"), row(71, "x", "open"), row(72, "x", "open"), row(73, "x", "fixed"), row(80, "y", "fixed"), row(81, "y", "obsolete")]
    got = {r.id: (r.matched, r.step) for r in match_in_order(new, spark.createDataFrame(old, MATCH + ", status string")).collect()}
    # the first that is open; the last where none is
    assert got == {1: (71, 1), 2: (81, 1), 3: (None, None)}


def test_new_rows_are_kept_in_order(spark):
    import random

    from siftmark.operators.review import kept_in_order

    r = random.Random(9)
    new = [(r.choice(["a", "b", "hot", "hot", None]), r.choice([None, *range(120)]), i) for i in range(400)]
    base = [(r.choice(["a", "b"]), r.randrange(120)) for _ in range(6)] + [("a", None), (None, 3)]
    got = sorted(x.ordinal for x in kept_in_order(spark.createDataFrame(new, "key string, line long, ordinal long"), spark.createDataFrame(base, "key string, line long")).collect())
    held: dict = {}
    for key, line in base:
        held.setdefault(key, []).append(line)
    want = []
    for key, line, i in new:
        if key is not None and line is not None and all(x is None or abs(x - line) > 8 for x in held.get(key, [])):
            held.setdefault(key, []).append(line)
            want.append(i)
    assert got == want and len(want) > 10
    # two lines after a base row, and 36 after it
    one = kept_in_order(spark.createDataFrame([("k", 12, 1), ("k", 46, 2)], "key string, line long, ordinal long"), spark.createDataFrame([("k", 10)], "key string, line long"))
    assert [x.ordinal for x in one.collect()] == [2]
    assert kept_in_order(spark.createDataFrame([], "key string, line long, ordinal long"), spark.createDataFrame([], "key string, line long")).collect() == []


def test_settled_findings(spark):
    from siftmark.operators.review import settled_findings

    row = lambda id, path, sha, title="t": (1, str(id), path, "bug", title, sha)
    open_ = spark.createDataFrame([row(1, "a", 1), row(2, "gone", 1), row(3, "a", 5), row(4, "a", None), row(5, "a", 1, "Seen again!"), row(6, "a", 1), row(7, "b", 1)], "repo_id long, finding_id string, path string, category string, title string, sha long")
    df = lambda schema, *x: spark.createDataFrame(list(x), schema)
    parts = df("finding_id string", ("6",), ("6",)), df("repo_id long, key string", (1, "a|bug|seen again")), df("repo_id long, head long", (1, 5)), df("repo_id long, path string", (1, "a"), (1, "a"), (1, "b"))
    got = {r.finding_id: r.status for r in settled_findings(open_, *parts).collect()}
    assert got == {"1": "fixed", "2": "obsolete", "4": "fixed", "7": "fixed"}
    assert {r.finding_id for r in settled_findings(open_, *parts, changed=df("repo_id long, path string", (1, "b"))).collect()} == {"7"}


def test_rare_tokens_find_all_likely_pairs(spark):
    import random

    r = random.Random(4)
    sets = [sorted({f"t{int(r.random() ** 2 * 30)}" for _ in range(r.randrange(1, 9))}) for _ in range(150)]
    df = spark.createDataFrame([(i, i % 2, s) for i, s in enumerate(sets)], "id long, g int, tt array<string>")
    got = {(x.id, x.o_id) for x in sharing_pairs(df, df.select(F.col("id").alias("o_id"), "g", "tt"), ["g"], "tt", 0.34).collect()}
    like = {(i, j) for i in range(150) for j in range(150) if i % 2 == j % 2 and len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]}) >= 0.34}
    assert like <= got and len(got) < 0.9 * 2 * 75 * 75


def test_best_matches_meet_by_kinds(spark):
    """The same as all pairs give, with nulls and repeated ids; findings that are all alike ask for a row or two each, not for one another."""
    import random
    from pathlib import Path

    from siftmark.operators.review import best_matches

    r = random.Random(9)
    words = ["cold", "bolt", "hot", "gear", "ring", "old"]
    some = lambda n: r.sample(words, r.randrange(1, n))
    rows = [(r.randrange(400), r.choice(["a", "b", None]), r.choice("xy"), r.choice(["L", "R", None]), r.choice(["nit", "bug"]), r.choice([None, *range(0, 90, 3)]), r.choice([some(4), some(4), some(3), [], None]), r.choice([some(4), [], None])) for _ in range(420)]
    rows += [(1000 + i, "same", "x", "R", "nit", i % 40, ["bolt", "cold", "ring"], ["bolt", "cold"]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, path string, category string, side string, severity string, line long, tt array<string>, bt array<string>")
    jaccard = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) if a and b else 0.0
    want = {}
    for n in rows:
        for o in rows:
            if o[0] < n[0] and n[1] is not None and o[1:3] == n[1:3]:
                title, far = jaccard(n[6], o[6]), n[5] is None or o[5] is None
                dist = None if far else abs(n[5] - o[5])
                if title >= 0.5 or (title >= 0.34 and not far and dist <= 8):
                    near = 0.3 if far else 1.0 if dist <= 2 else 0.9 if dist <= 6 else 0.75 if dist <= 12 else 0.55 if dist <= 25 else 0.3
                    same = lambda i: 1.0 if n[i] is not None and n[i] == o[i] else 0.7  # noqa: B023,E731
                    score = round(title * 0.64 + jaccard(n[7], o[7]) * 0.16 + near * 0.14 + same(3) * 0.04 + same(4) * 0.02, 9)
                    if score >= 0.5:
                        want[n[0]] = max(want.get(n[0], (0, 0)), (score, -o[0]))
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = {*shared.glob("siftmark-asked-*")}
    got = {x["id"]: (x["score"], -x["old_id"]) for x in best_matches(df).collect()}
    assert got == want and len(got) > 690
    [asked] = {*shared.glob("siftmark-asked-*")} - before
    assert spark.read.parquet(str(asked)).where("id >= 1000").count() < 2 * 600


def test_middle_cut_query(spark):
    from siftmark.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["sf29_middle_cut"](spark, SF).collect():
        raw = (texts[r.doc_id] or "").encode()
        if len(raw) <= 120:
            assert r.cut == (texts[r.doc_id] or "")
            continue
        head, tail = r.cut.split("…")[0].encode(), r.cut.split("…")[-1].encode()
        assert raw.startswith(head) and raw.endswith(tail) and 57 <= len(head) <= 60 and 57 <= len(tail) <= 60


def test_direct_edges_are_not_promoted(spark):
    edges = spark.createDataFrame([(11, 22, "file_dep", 1), (11, 22, "references_symbol", 5), (22, 11, "references_symbol", 2), (1, 2, "references_symbol", 1)], "from_id long, to_id long, type string, weight long")
    assert [(r.from_id, r.to_id) for r in promote_edges(edges, "references_symbol", "file_dep").collect()] == [(22, 11)]


def test_publish_cap_stops_later_summaries(spark):
    schema = "id long, ordinal long, path string, side string, line long, title string, body string, evidence string, severity string, confidence string, category string, patch string, comment_type string, in_diff boolean"
    rows = [(i, i, "a.ts", "RIGHT", i, f"t{i}", "b", "e", "important", "high", "bug", None, kind, True) for i, kind in ((1, "inline"), (2, "summary"), (3, "inline"), (4, "inline"), (5, "summary"))]
    got = {r.id for r in publishable(spark.createDataFrame(rows, schema), "low", 2, "^$", []).collect()}
    assert got == {1, 2, 3}


def test_globs(spark):
    import re

    assert re.match(glob_pattern("src/**/*.ts"), "src/a/b/c.ts") and re.match(glob_pattern("src/**/*.ts"), "src/c.ts")
    assert not re.match(glob_pattern("*.ts"), "a/b.ts") and re.match(glob_pattern("a?.t+"), "ab.t+")


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.read.parquet(f"{SF}/events.parquet")
    rows.repartition(3).write.parquet(str(source))
    log_sink(event_stream(spark, str(source), 1), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == rows.count() and written.select("batch").distinct().count() == 3
    counts = windowed_counts(event_stream(spark, str(source), 3)).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "check3")).trigger(availableNow=True).start()
    counts.awaitTermination()
    assert spark.table("hours").agg(F.sum("n")).first()[0] == rows.count()
    q = open_items(event_stream(spark, str(source), 3)).writeStream.format("memory").queryName("open_items").option("checkpointLocation", str(tmp_path / "check2")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.begin_id, r.end_id) for r in spark.table("open_items").collect()}
    from siftmark.queries import QUERIES

    want = {(r.begin_id, r.end_id) for r in QUERIES["st9_lifecycle_pairs"](spark, SF).where("end_id is not null").collect()}
    assert got == want


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 'a,"b"'), (1, "c")], "created int, payload string")
    export_events(df, str(tmp_path / "csv"))
    back = spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv"))
    assert {r.payload for r in back.collect()} == {'a,"b"', "c"}
    for _ in range(2):
        append_metrics(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 4
    write_bundle({"patch": df.select("payload"), "rows": df}, str(tmp_path / "bundle"))
    assert walk(spark, str(tmp_path / "bundle")).where("path like '%part-%'").count() >= 2
    assert seeded(df.limit(0), df).count() == 2 and seeded(df.limit(1), df).count() == 1


def test_read_config(spark, tmp_path):
    for name, text in (("a", '{"cap": 3, "x": 1}'), ("b", 'here: {"cap": 4}'), ("c", "nothing")):
        (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "d.json").write_text("# as lines\ncap: 5\nother: x\n")
    from pyspark.sql.types import IntegerType, StructField, StructType

    got = {r.file[-6]: (r.cap, r.warning) for r in read_config(spark, str(tmp_path), StructType([StructField("cap", IntegerType())])).collect()}
    assert got == {"a": (3, "unknown keys: x"), "b": (4, "repaired"), "c": (None, "no configuration found"), "d": (5, "read as lines")}


def test_heading_sections(spark):
    from siftmark.plans.headings import heading_sections

    text = "intro\n# One\na\n### Deep\n```\n# not one\n```\nb\n## Two #\n#no blank\n####### seven\n# \n###### Six\n# Last"
    docs = spark.createDataFrame([(1, text), (2, "no headings\n #indented"), (3, None), (4, ""), (5, "# x\n# x")], "id long, text string")
    got = {(r["id"], r["node"]): (r["level"], r["title"], r["parent"], r["text"]) for r in heading_sections(docs).collect()}
    assert got == {
        (1, 1): (1, "One", None, "a"), (1, 2): (3, "Deep", 1, "```\n# not one\n```\nb"), (1, 3): (2, "Two #", 1, "#no blank\n####### seven\n# "), (1, 4): (6, "Six", 3, ""), (1, 5): (1, "Last", None, ""),
        (5, 1): (1, "x", None, ""), (5, 2): (1, "x", None, ""),
    }
    assert heading_sections(spark.createDataFrame([], "id long, text string")).collect() == []


def test_index_of_words(spark, tmp_path):
    """The index gives what a scan gives, and a search reads the buckets of its words alone."""
    from siftmark.operators.context import bm25
    from siftmark.plans.bm25 import search_index, search_text, write_index

    texts = ["a b b c", "b", "", None, "c c c d", "É b-b", "x " * 5000 + "b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    write_index(docs, f"file://{tmp_path}/i", 8)
    for question in ("b", "B, é! zz", "c d x", "", "?", "zz"):
        got = {r["id"]: round(r["score"], 9) for r in search_index(spark, f"file://{tmp_path}/i", question).collect()}
        scan = {r["id"]: round(r["score"], 9) for r in bm25(docs.fillna(""), question.replace(",", "").replace("!", "").replace("?", "")).collect()} if question.strip("?") else {}
        assert got == scan
    plan = search_index(spark, f"file://{tmp_path}/i", "b")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    write_index(docs.where("false"), f"file://{tmp_path}/none")
    assert search_index(spark, f"file://{tmp_path}/none", "b").collect() == []
    row = spark.createDataFrame([("n", " ", None, ["k1", "k2"])], "a string, b string, c string, k array<string>")
    assert row.select(search_text(F.col("a"), F.col("b"), F.col("c"), keys=F.col("k"))).first()[0] == "n k1 k2"


def test_typed_search(spark):
    from siftmark.operators.context import FileSearch, subsequence_score

    paths = spark.createDataFrame([(x,) for x in ("src/a1.ts", "src/B1f.ts", "x/s1/f", "", "s", "Src/É1.ts", None, "src/a1.ts", "s-1_f")], "path string")
    search = FileSearch(paths)
    for pattern in ("s", "s1", "s1f", "s1", "x", "é", "_f", "s-1"):
        want = {(r["path"], r["score"]) for r in paths.select("path", subsequence_score(F.col("path"), pattern).alias("score")).where("score is not null").collect()}
        assert {(r["path"], r["score"]) for r in search.search(pattern).collect()} == want
    assert [p for p, _ in search.found] == ["s-1"]
