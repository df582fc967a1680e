"""Building a code graph from parsed files (CP6): every edge type from files, symbols and references, each stage from the ones before.

Relations, all with `repo`: files (path), symbols (path, symbol, name, kind, first, last) and refs (path, ref, kind, name, line; kind is import, export or
anything else). Nodes are known by keys: a file's path, `dir:` and `module:` and `external:` names, and path, name, line and number of a symbol.
A raw edge is a place that gives it: repo, type, from_key, to_key, example, pos (its order); `aggregated` sums them up.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .stored import discard, stored

# Edge types, kinds of symbols that count as classes, endings that an import may leave out (by the importing file's own), and endings that stand for one another.
EDGE_TYPES = (
    "dir_contains_dir", "dir_contains_file", "module_contains", "contains_symbol", "class_contains_symbol", "symbol_contains_symbol", "file_dep", "symbol_imports_file",
    "module_dep", "external_dep", "symbol_external_dep", "exports_symbol", "references_symbol", "file_dep_inferred",
)
#: What the ends of an edge are, by its type.
ENDS = {
    "dir_contains_dir": ("directory", "directory"), "dir_contains_file": ("directory", "file"), "module_contains": ("module", "file"), "contains_symbol": ("file", "symbol"),
    "class_contains_symbol": ("symbol", "symbol"), "symbol_contains_symbol": ("symbol", "symbol"), "file_dep": ("file", "file"), "symbol_imports_file": ("symbol", "file"), "module_dep": ("module", "module"),
    "external_dep": ("file", "external"), "symbol_external_dep": ("symbol", "external"), "exports_symbol": ("file", "symbol"), "references_symbol": ("symbol", "symbol"), "file_dep_inferred": ("file", "file"),
}
CLASS_KINDS = ("class_declaration", "class_definition", "struct_item", "interface_declaration")
ENDINGS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".json"]
OTHER_ENDINGS = {".py": [".py"], ".go": [".go"], ".rs": [".rs"]}
ALIKE = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"]
MOST_EXPORTS, MOST_TARGETS, EXAMPLES, PROMOTED_FROM = 5, 3, 5, 2

#: Lines of a bin in interval joins.
BIN = 64


def _edges(rows: DataFrame, kind: str | Column, a: Column | str, b: Column | str, example: Column | None = None, pos: Column | str | None = None) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    pos = F.lit(0).cast("long") if pos is None else F.col(pos) if isinstance(pos, str) else pos
    return rows.select("repo", kind.alias("type"), (F.col(a) if isinstance(a, str) else a).alias("from_key"), (F.col(b) if isinstance(b, str) else b).alias("to_key"), (example if example is not None else F.lit(None).cast("string")).alias("example"), pos.alias("pos"))


def directory_chain(path: Column) -> Column:
    """Directories of a path from the repository's own, `.`, down."""
    return F.concat(F.array(F.lit(".")), F.reverse(T.ancestors(path)))


def symbol_key(prefix: str = "") -> Column:
    return F.concat_ws(":", *(F.col(f"{prefix}{c}").cast("string") for c in ("path", "name", "first", "symbol")))


def reference_name(x: Column) -> Column:
    """The last part of a dotted or `::` name, without other characters than those of words and $; a name that ends in a separator counts as a whole."""
    for sep in (".", "::"):
        last = F.element_at(F.split(x, sep.replace(".", r"\.")), -1)
        x = F.when(last == "", x).otherwise(last)
    return F.regexp_replace(x, r"[^A-Za-z0-9_$]", "")


def containment(files: DataFrame) -> dict[str, DataFrame]:
    """Directories in directories and files in directories and modules. Each file counts for every step of its chain."""
    chain = files.select("repo", "path", directory_chain(F.col("path")).alias("chain"))
    steps = chain.select("repo", F.explode(F.arrays_zip(F.slice("chain", F.lit(1), F.size("chain") - 1).alias("a"), F.slice("chain", F.lit(2), F.size("chain")).alias("b"))).alias("s"))
    in_dir = F.concat(F.lit("dir:"), F.element_at("chain", -1))
    return {
        "dir_contains_dir": _edges(steps, "dir_contains_dir", F.concat(F.lit("dir:"), F.col("s.a")), F.concat(F.lit("dir:"), F.col("s.b"))),
        "dir_contains_file": _edges(chain, "dir_contains_file", in_dir, "path"),
        "module_contains": _edges(files, "module_contains", F.concat(F.lit("module:"), T.module_of(F.col("path"))), "path"),
    }


def _binned(spans: DataFrame, first: str, last: str) -> DataFrame:
    return spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col(first) / BIN), F.floor(F.col(last) / BIN))))


def nested(symbols: DataFrame) -> DataFrame:
    """Raw edges from the narrowest other symbol of a file that holds a symbol's lines; equal ranges hold each other, ties go to the smaller symbol (JN7)."""
    outer = symbols.select("repo", "path", F.col("symbol").alias("o_symbol"), F.col("first").alias("o_first"), F.col("last").alias("o_last"), F.col("kind").alias("o_kind"), symbol_key().alias("o_key"))
    inner = symbols.select("repo", "path", "symbol", "first", "last", symbol_key().alias("key"), F.floor(F.col("first") / BIN).alias("bin"))
    held = inner.join(_binned(outer, "o_first", "o_last"), ["repo", "path", "bin"]).where((F.col("symbol") != F.col("o_symbol")) & (F.col("o_first") <= F.col("first")) & (F.col("last") <= F.col("o_last")))
    best = held.groupBy("repo", "key").agg(F.min(F.struct((F.col("o_last") - F.col("o_first")).alias("span"), "o_symbol", "o_key", "o_kind")).alias("b"))
    kind = F.when(F.col("b.o_kind").isin(*CLASS_KINDS), "class_contains_symbol").otherwise("symbol_contains_symbol")
    return _edges(best, kind, "b.o_key", "key")


def owned(refs: DataFrame, symbols: DataFrame, how: str = "left") -> DataFrame:
    """`refs` with owner, the key of the narrowest symbol around their line (JN6), null where there is none (or without these rows, if `how` is inner). Each place is looked up once."""
    places = refs.select("repo", "path", "line").distinct().withColumn("bin", F.floor(F.col("line") / BIN))
    spans = _binned(symbols.select("repo", "path", "symbol", "first", "last", symbol_key().alias("key")), "first", "last")
    inside = places.join(spans, ["repo", "path", "bin"]).where(F.col("line").between(F.col("first"), F.col("last")))
    best = inside.groupBy("repo", "path", "line").agg(F.min(F.struct((F.col("last") - F.col("first")).alias("span"), "symbol", "key")).alias("b"))
    return refs.join(best.select("repo", "path", "line", F.col("b.key").alias("owner")), ["repo", "path", "line"], how)


def _ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def _joined(path: Column, at_root: bool = False) -> Column:
    """A path without `.` and without `..` where a directory stands before it; at the root `..` is kept, or goes if `at_root`."""
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(".."))
    above = lambda acc, x: F.when((x == "..") & F.lit(at_root), acc).otherwise(F.concat(acc, F.array(x)))
    step = lambda acc, x: F.when(x.isin("", "."), acc).when((x == "..") & (last(acc) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(above(acc, x))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def clean_spec(spec: Column) -> Column:
    """An import without its quotes and what follows `?` or `#`."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(spec), "^[\"']|[\"']$", ""), "[?#].*$", ""))


def import_base(directory: Column, spec: Column, ending: Column, at_root: bool = False) -> Column:
    """The path that a clean import stands for, before endings are tried; null for one of the runtime's own.

    An import that leads out of the repository stands for no file of it (as `path.posix.join` has it), or, if `at_root`, goes on from the repository's root.
    Doubled slashes, as `../x` gives them in a Python file, are made one; those of a Python import stay, if `at_root`, and no file answers.
    """
    dots = F.length(F.regexp_extract(spec, r"^(\.+)", 1))
    names = F.replace(F.substr(spec, dots + 1), F.lit("."), F.lit("/"))
    anchor = F.array_join(F.slice(F.split(directory, "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split(directory, "/")) - dots + 1)), "/")
    joined = F.concat_ws("/", anchor, names)
    python = F.when(dots > 0, F.ltrim(joined, F.lit("/")) if at_root else T.graph_path(_joined(joined))).otherwise(names if at_root else T.graph_path(names))
    other = F.when(spec.startswith("./") | spec.startswith("../"), _joined(F.concat_ws("/", directory, spec), at_root)).when(spec.startswith("@/") | spec.startswith("~/"), F.substring(spec, 3, 1 << 30)).when(spec.startswith("/"), F.substring(spec, 2, 1 << 30)).otherwise(spec)
    return F.when(~spec.startswith("node:") & (spec != ""), F.when(ending == ".py", python).otherwise(T.graph_path(other)))


def import_candidates(base: str, ending: str, own: str, stem: str) -> Column:
    """The paths that an import may mean, in the order they are tried (JN9), from columns: its base, the importing file's ending, and the base's own ending and what stands before it."""
    none = F.array().cast("array<string>")
    alike = F.when(F.col(own).isin(*ALIKE), F.transform(F.array(*map(F.lit, ALIKE)), lambda e: F.concat(F.col(stem), e))).otherwise(none)
    index = F.when(F.col(ending) == ".py", "/__init__").otherwise("/index")
    with_ends = lambda ends: F.when(F.col(own).isin(*ends), none).otherwise(F.flatten(F.transform(F.array(*map(F.lit, ends)), lambda e: F.array(F.concat(F.col(base), e), F.concat(F.col(base), index, e)))))
    open_ = reduce(lambda out, e: out.when(F.col(ending) == e, with_ends(OTHER_ENDINGS[e])), OTHER_ENDINGS, F.when(F.lit(False), none)).otherwise(with_ends(ENDINGS))
    return F.array_distinct(F.concat(F.array(base), alike, open_))


def external_package(spec: Column, ending: Column) -> Column:
    """The package of a clean import that no file answers to; null for a relative one (SF18)."""
    inside = spec.startswith(".") | spec.startswith("/") | spec.startswith("@/") | spec.startswith("~/") | (spec == "")
    root = F.when(ending == ".py", F.substring_index(spec, ".", 1)).when(spec.startswith("@"), F.substring_index(spec, "/", 2)).otherwise(F.substring_index(spec, "/", 1))
    return F.when(~inside & (root != ""), root)


def resolved_imports(imports: DataFrame, files: DataFrame, at_root: bool = False) -> DataFrame:
    """`imports` with target, the file that an import means, or package. An import that many files of a directory have in common is looked up once."""
    ending, spec = _ending(F.col("path")), clean_spec(F.col("name"))
    known = imports.withColumns({"_dir": T.directory(F.col("path")), "_ending": F.when(ending.isin(*OTHER_ENDINGS), ending).otherwise(""), "_spec": spec})
    key = ["repo", "_dir", "_ending", "_spec"]
    asked = known.select(*key).distinct().withColumn("_base", import_base(F.col("_dir"), F.col("_spec"), F.col("_ending"), at_root)).where("_base != ''")
    asked = asked.withColumn("_own", _ending(F.col("_base"))).withColumn("_stem", F.substr("_base", F.lit(1), F.length("_base") - F.length("_own")))
    tried = asked.select(*key, F.posexplode(import_candidates("_base", "_ending", "_own", "_stem")).alias("_pos", "target"))
    found = tried.join(files.select("repo", F.col("path").alias("target")), ["repo", "target"]).groupBy(*key).agg(F.min_by("target", "_pos").alias("target"))
    return known.join(found, key, "left").withColumn("package", F.when(F.col("target").isNull(), external_package(F.col("_spec"), F.col("_ending")))).drop("_dir", "_ending", "_spec")


def import_edges(imports: DataFrame) -> dict[str, DataFrame]:
    """Raw edges of resolved imports (path, owner, name, ref, target, package)."""
    inside, outside, package = imports.where("target is not null"), imports.where("package is not null"), F.concat(F.lit("external:"), F.col("package"))
    module = lambda c: F.concat(F.lit("module:"), T.module_of(F.col(c)))
    return {
        "file_dep": _edges(inside, "file_dep", "path", "target", F.col("name"), "ref"),
        "symbol_imports_file": _edges(inside.where("owner is not null"), "symbol_imports_file", "owner", "target", F.col("name"), "ref"),
        "module_dep": _edges(inside, "module_dep", module("path"), module("target"), F.concat_ws(" -> ", "path", "target"), "ref"),
        "external_dep": _edges(outside, "external_dep", "path", package, F.col("name"), "ref"),
        "symbol_external_dep": _edges(outside.where("owner is not null"), "symbol_external_dep", "owner", package, F.col("name"), "ref"),
    }


def export_edges(exports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Raw edges from files to the first symbols of their own that have an exported name."""
    first = Window.partitionBy("repo", "path", "short").orderBy("symbol")
    named = symbols.select("repo", "path", "symbol", reference_name(F.col("name")).alias("short"), symbol_key().alias("key")).where("short != ''")
    few = named.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= MOST_EXPORTS)
    met = exports.withColumn("short", reference_name(F.trim("name"))).join(few, ["repo", "path", "short"])
    return _edges(met, "exports_symbol", "path", "key", F.col("short"), "ref")


def named_pairs(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """Names used inside a symbol that at most MOST_TARGETS symbols of the repository have, with those in other files (JN8): short, key, to_path are added."""
    named = symbols.select("repo", F.col("path").alias("to_path"), reference_name(F.col("name")).alias("short"), symbol_key().alias("key")).where("short != ''")
    few = named.groupBy("repo", "short").agg(F.count("*").alias("_n")).where(F.col("_n") <= MOST_TARGETS).select("repo", "short")
    targets = named.join(few, ["repo", "short"])
    return names.where("owner is not null").withColumn("short", reference_name(F.trim("name"))).join(targets, ["repo", "short"]).where("to_path != path")


def name_edges(names: DataFrame, symbols: DataFrame) -> dict[str, DataFrame]:
    """Raw edges of names used inside a symbol, between symbols and between their files."""
    met = named_pairs(names, symbols)
    return {
        "references_symbol": _edges(met, "references_symbol", "owner", "key", F.col("short"), "ref"),
        "file_dep_inferred": _edges(met, "file_dep_inferred", "path", "to_path", F.concat(F.col("short"), F.lit("@L"), F.col("line")), "ref"),
    }


def of_files(rows: DataFrame, files: DataFrame, strays: bool = False) -> DataFrame:
    """Those of `rows` (repo, path) that belong to one of the files; all, if `strays`."""
    return rows if strays else rows.join(files.select("repo", "path"), ["repo", "path"], "left_semi")


def raw_edges(files: DataFrame, symbols: DataFrame, refs: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df, at_root: bool = False, strays: bool = False) -> dict[str, DataFrame]:
    """Raw edges of every type. Only symbols and references of the given files count, or all, if `strays`. `keep` gets what several types are made of, to write it where all are asked for.

    `at_root` is `import_base`'s.
    """
    paths = files.select("repo", "path")
    symbols, refs = (of_files(x, paths, strays) for x in (symbols, refs))
    symbols = keep(symbols, "symbols")
    refs = keep(owned(refs.withColumn("kind", F.lower(F.coalesce("kind", F.lit("")))), symbols), "refs")
    inner = keep(nested(symbols), "nested")
    out = containment(paths) | {"contains_symbol": _edges(symbols, "contains_symbol", "path", symbol_key())}
    out |= {k: inner.where(F.col("type") == k) for k in ("class_contains_symbol", "symbol_contains_symbol")}
    out |= import_edges(keep(resolved_imports(refs.where("kind = 'import'"), paths, at_root), "imports"))
    out |= {"exports_symbol": export_edges(refs.where("kind = 'export'"), symbols)}
    return out | name_edges(refs.where("kind not in ('import', 'export')"), symbols)


def aggregated(raw: DataFrame) -> DataFrame:
    """repo, type, from_key, to_key, weight, examples: edges with the number of places and the first EXAMPLES different examples; self-loops go (AG16).

    Places with one example are summed up before the shuffle; a window numbers an edge's examples, so no group collects more than it keeps.
    """
    edge = ["repo", "type", "from_key", "to_key"]
    summed = raw.where("from_key != to_key").groupBy(*edge, "example").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    numbered = summed.withColumn("_k", F.row_number().over(Window.partitionBy(*edge).orderBy(F.isnull("example"), "pos", "example")))
    kept = F.when((F.col("_k") <= EXAMPLES) & F.col("example").isNotNull(), F.struct("_k", "example"))
    return numbered.groupBy(*edge).agg(F.sum("n").alias("weight"), F.array_sort(F.collect_list(kept))["example"].alias("examples"))


def promoted(inferred: DataFrame, direct: DataFrame) -> DataFrame:
    """file_dep edges for inferred ones of weight PROMOTED_FROM or more that no direct one stands beside (AG17)."""
    strong = inferred.where((F.col("type") == "file_dep_inferred") & (F.col("weight") >= PROMOTED_FROM))
    known = direct.where("type = 'file_dep'").select("repo", "from_key", "to_key")
    return strong.join(known, ["repo", "from_key", "to_key"], "left_anti").select("repo", F.lit("file_dep").alias("type"), "from_key", "to_key", "weight", F.array().cast("array<string>").alias("examples"))


def graph_of(files: DataFrame, symbols: DataFrame, refs: DataFrame, at_root: bool = False, strays: bool = False) -> DataFrame:
    """All edges of the graph, promoted ones (`inferred`) included. What several types are made of is written once, and so are the edges before promotion."""
    edges = stored(aggregated(reduce(DataFrame.unionByName, raw_edges(files, symbols, refs, stored, at_root, strays).values())), "drafts")
    return edges.withColumn("inferred", F.lit(False)).unionByName(promoted(edges, edges).withColumn("inferred", F.lit(True)))


def counted(raw: DataFrame) -> DataFrame:
    """repo, type, from_key, to_key, weight: as `aggregated`, without examples, so that an edge's places are one row before the shuffle."""
    return raw.where("from_key != to_key").groupBy("repo", "type", "from_key", "to_key").agg(F.count("*").alias("weight"))


def file_edges(files: DataFrame, symbols: DataFrame, refs: DataFrame, at_root: bool = False, strays: bool = False) -> dict[str, DataFrame]:
    """repo, type, from_key, to_key: raw edges between files, direct and inferred ones, without looking up what they don't need: owners of imports, examples."""
    paths = files.select("repo", "path").distinct()
    symbols, refs = (of_files(x, paths, strays) for x in (symbols, refs))
    kind = F.lower(F.coalesce("kind", F.lit("")))
    inside = resolved_imports(refs.where(kind == "import").select("repo", "path", "name"), paths, at_root).where("target is not null")
    met = named_pairs(owned(refs.where(~kind.isin("import", "export")).select("repo", "path", "name", "line"), symbols, "inner"), symbols)
    return {"file_dep": _pairs(inside, ("file_dep", "path", "target")), "file_dep_inferred": _pairs(met, ("file_dep_inferred", "path", "to_path"))}


def _pairs(rows: DataFrame, *edges: tuple[str, Column | str, Column | str]) -> DataFrame:
    """repo, type, from_key, to_key: edges of several types (type, from, to) from each row, without those that lack an end."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    each = F.array(*(F.struct(F.lit(kind).alias("type"), col(a).alias("from_key"), col(b).alias("to_key")) for kind, a, b in edges))
    return rows.select("repo", F.explode(each).alias("e")).select("repo", "e.*").where("from_key is not null and to_key is not null")


def followed_graph(files: DataFrame, symbols: DataFrame, refs: DataFrame, at_root: bool = False, strays: bool = False) -> DataFrame:
    """repo, type, from_key, to_key, weight, from_type, to_type: the edges of `graph_of` that a traversal follows (all but those to packages), without examples.

    References are read three times, each kind by itself; only imports that mean a file and names that mean symbols are looked up for their owners. Edges are written once;
    what they are made of goes when they are. The type of a file's end is null if the file isn't listed (with `strays`).
    """
    paths = files.select("repo", "path").distinct()
    symbols, refs = (of_files(x, paths, strays) for x in (symbols, refs))
    kind = F.lower(F.coalesce("kind", F.lit("")))
    inside = stored(resolved_imports(refs.where(kind == "import").select("repo", "path", "name", "line"), paths, at_root).where("target is not null").select("repo", "path", "line", "target"), "imports")
    module = lambda c: F.concat(F.lit("module:"), T.module_of(F.col(c)))
    met = named_pairs(owned(refs.where(~kind.isin("import", "export")).select("repo", "path", "name", "line"), symbols, "inner"), symbols)
    raw = [
        *containment(files).values(),
        _edges(symbols, "contains_symbol", "path", symbol_key()),
        nested(symbols),
        export_edges(refs.where(kind == "export"), symbols),
        _pairs(inside, ("file_dep", "path", "target"), ("module_dep", module("path"), module("target"))),
        _pairs(owned(inside, symbols, "inner"), ("symbol_imports_file", "owner", "target")),
        _pairs(met, ("references_symbol", "owner", "key"), ("file_dep_inferred", "path", "to_path")),
    ]
    drafts = stored(counted(reduce(DataFrame.unionByName, (df.select("repo", "type", "from_key", "to_key") for df in raw))), "drafts")
    discard(inside)
    columns = ["repo", "type", "from_key", "to_key", "weight"]
    edges = drafts.unionByName(stored(promoted(drafts, drafts).select(columns), "promoted"))
    return typed_ends(edges, paths, strays)


def typed_ends(edges: DataFrame, files: DataFrame, strays: bool = False) -> DataFrame:
    """`edges` with from_type and to_type, by their own type; null for files that aren't among `files`, if `strays` says that there may be some."""
    kinds = lambda i: F.create_map(*(F.lit(x) for k, ends in ENDS.items() for x in (k, ends[i])))[F.col("type")]
    typed = edges.withColumns({"from_type": kinds(0), "to_type": kinds(1)})
    if not strays:
        return typed
    ends = typed.select("repo", F.explode(F.filter(F.array(F.struct(F.col("from_type").alias("t"), F.col("from_key").alias("key")), F.struct(F.col("to_type").alias("t"), F.col("to_key").alias("key"))), lambda e: e["t"] == "file")["key"]).alias("key"))
    # few, as a rule: written, so that its size is known
    unknown = stored(ends.distinct().join(files.select("repo", F.col("path").alias("key")), ["repo", "key"], "left_anti"), "strays")
    for end in ("from", "to"):
        typed = typed.join(unknown.select("repo", F.col("key").alias(f"{end}_key"), F.lit(True).alias(f"_{end}")), ["repo", f"{end}_key"], "left")
    return typed.select("repo", "type", "from_key", "to_key", "weight", *(F.when(F.col(f"_{end}").isNull() | (F.col(f"{end}_type") != "file"), F.col(f"{end}_type")).alias(f"{end}_type") for end in ("from", "to")))


def nodes_of(files: DataFrame, symbols: DataFrame, edges: DataFrame, strays: bool = False) -> DataFrame:
    """repo, key, type, path, symbol, first, last: files and symbols (of other files, too, if `strays`), and the directories, modules and packages that edges name."""
    others = [k for k, ends in ENDS.items() if {*ends} - {"file", "symbol"}]
    named = edges.where(F.col("type").isin(others)).select("repo", F.explode(F.array("from_key", "to_key")).alias("key")).distinct()
    kind = F.when(F.col("key").startswith("dir:"), "directory").when(F.col("key").startswith("module:"), "module").when(F.col("key").startswith("external:"), "external")
    rest = named.withColumn("type", kind).where("type is not null")
    none = {"path": F.lit(None).cast("string"), "symbol": F.lit(None).cast("long"), "first": F.lit(None).cast("long"), "last": F.lit(None).cast("long")}
    own = files.select("repo", F.col("path").alias("key"), F.lit("file").alias("type"), "path").withColumns({k: none[k] for k in ("symbol", "first", "last")})
    inside = of_files(symbols, files, strays).select("repo", symbol_key().alias("key"), F.lit("symbol").alias("type"), "path", "symbol", "first", "last")
    return own.unionByName(inside).unionByName(rest.withColumns(none))


def review_seeds(changed: DataFrame, lines: DataFrame, nodes: DataFrame, edges: DataFrame, excluded: list[str] = []) -> DataFrame:
    """repo, key, kind: where a review's traversal begins (CP7).

    `changed` has repo, path; `lines` repo, path, line (SF20's output). Changed files that the graph has and no excluded prefix holds are seeds;
    so are their symbols around changed lines, or a file's first two if there are none; their directories, up to the repository's own; and the modules that contain them.
    Symbols without a proper range of lines are none.
    """
    out = reduce(lambda x, p: x | (F.col("path") == p) | F.col("path").startswith(f"{p}/"), [p for p in excluded if p], F.lit(False))
    files = nodes.where("type = 'file'").join(changed.select("repo", T.graph_path(F.col("path")).alias("path")).distinct(), ["repo", "path"], "left_semi").where(~out).select("repo", "path", "key").distinct()
    held = nodes.where("type = 'symbol' and first > 0 and last >= first").join(files.select("repo", "path"), ["repo", "path"], "left_semi").select("repo", "path", "key", "symbol", "first", "last")
    points = lines.select("repo", T.graph_path(F.col("path")).alias("path"), "line").distinct().withColumn("bin", F.floor(F.col("line") / BIN))
    touched = _binned(held, "first", "last").join(points, ["repo", "path", "bin"]).where(F.col("line").between(F.col("first"), F.col("last"))).select("repo", "path", "key").distinct()
    rest = held.join(touched.select("repo", "path").distinct(), ["repo", "path"], "left_anti")
    first = rest.withColumn("_n", F.row_number().over(Window.partitionBy("repo", "path").orderBy("first", "symbol"))).where("_n <= 2")
    chain = files.select("repo", F.explode(directory_chain(F.col("path"))).alias("dir")).select("repo", F.concat(F.lit("dir:"), F.col("dir")).alias("key")).distinct()
    dirs = nodes.where("type = 'directory'").join(chain, ["repo", "key"], "left_semi")
    modules = edges.where("type = 'module_contains'").join(files.select("repo", F.col("key").alias("to_key")), ["repo", "to_key"], "left_semi").select("repo", F.col("from_key").alias("key")).distinct()
    parts = (("file", files), ("symbol", touched), ("symbol", first), ("directory", dirs), ("module", modules))
    return reduce(DataFrame.unionByName, (df.select("repo", "key", F.lit(kind).alias("kind")) for kind, df in parts))


def link_candidates(found: DataFrame, changed: DataFrame, nodes: DataFrame, edges: DataFrame, related: int = 28) -> DataFrame:
    """repo, from_path, to_path, type, score: dependencies around the changed and the best found files (CP8).

    `found` has repo, key, score of every node that a traversal reached. An edge counts if one of its ends is changed or among the best 3 `related` (24 at least) files,
    and if either was reached or is changed; its score is that of both ends and a share of its weight. Of equal edges (a promoted one beside another) the best counts.
    """
    files = nodes.where("type = 'file'").select("repo", "key", "path")
    ends = changed.select("repo", "path").distinct().withColumn("changed", F.lit(True))
    scored = files.join(found.select("repo", "key", "score"), ["repo", "key"], "left").join(ends, ["repo", "path"], "left").fillna({"score": 0.0, "changed": False})
    order = Window.partitionBy("repo").orderBy(F.desc("score"), "path")
    best = scored.where("score > 0 and not changed").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(related * 3, 24)).select("repo", "key")
    around = best.unionByName(scored.where("changed").select("repo", "key"))
    deps = edges.where("type in ('file_dep', 'file_dep_inferred')").select("repo", "type", "from_key", "to_key", "weight")
    near = deps.join(around.withColumnRenamed("key", "from_key"), ["repo", "from_key"], "left_semi").unionByName(deps.join(around.withColumnRenamed("key", "to_key"), ["repo", "to_key"], "left_semi").select(deps.columns)).distinct()
    for end in ("from", "to"):
        near = near.join(scored.select("repo", F.col("key").alias(f"{end}_key"), F.col("path").alias(f"{end}_path"), F.col("score").alias(f"{end}_score"), F.col("changed").alias(f"{end}_changed")), ["repo", f"{end}_key"])
    kept = near.where("from_score > 0 or to_score > 0 or from_changed or to_changed")
    score = F.col("from_score") + F.col("to_score") + F.greatest(F.lit(1.0), F.col("weight").cast("double")) * 0.05 + F.when(F.col("type") == "file_dep", 0.05).otherwise(0.0)
    return kept.groupBy("repo", "from_path", "to_path", "type").agg(F.max(score).alias("score"))


def included_links(links: DataFrame, included: DataFrame, most: int = 110) -> DataFrame:
    """The best `most` links of a repository with both ends among the included files (repo, path), in order (CP8)."""
    for end in ("from_path", "to_path"):
        links = links.join(included.select("repo", F.col("path").alias(end)).distinct(), ["repo", end], "left_semi")
    order = Window.partitionBy("repo").orderBy(F.desc("score"), "from_path", "to_path", "type")
    return links.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("repo", "from_path", "to_path", "type", "score", "place")
