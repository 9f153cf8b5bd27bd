"""The dependency graph of a source tree: node and edge tables from extracted symbols, references and includes.

Everything is a join on names or paths. The order in which a sequential build would meet files and references is
kept as columns (node_ord, edge_ord), from which first occurrences are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.functions.exprs import base_name, module_of, reference_name, simple_name, suffixes
from codeatlas.functions.tables import dealt, settle, sided
from codeatlas.operators.graph import dedup_edges, degrees, look_up, merge_symbols, name_index, resolve_includes, valid_edges
from codeatlas.operators.traverse import induced, subgraph
from codeatlas.sources import build_script

#: The kinds looked up for each kind of reference, one after the other; enums are looked up as classes.
LADDERS = {"calls": ["function", "class"], "inherits": ["class"], "uses": ["class", "variable", "function"], "refs": ["macro", "variable"]}
#: The kind of an unresolved name's external node.
OUTSIDE = {"calls": "function", "inherits": "class", "uses": "class", "refs": "macro"}
EXTERNAL_MODULE = "<external>"


def reference_hits(refs: DataFrame, symbols: DataFrame, most_hits: int = 3, few: bool = False) -> DataFrame:
    """refs with n_hits and hits (file, sym_ord, id of each occurrence, up to most_hits), by their kind's ladder.

    few: whether refs are a part of a tree's, so that only the names they ask for are worth an index.
    """
    known = symbols.select(F.struct("file", "sym_ord", "id").alias("occ_id"), F.when(F.col("kind") == "enum", "class").otherwise(F.col("kind")).alias("kind"), "qualified", F.col("name").alias("simple"))
    asked = refs.select(F.col("kind").alias("ladder"), F.col("name").alias("raw"), reference_name(F.col("name")).alias("name")).distinct()
    keys = asked.select(F.explode(F.array("name", simple_name(F.col("name")))).alias("key")).distinct() if few else None
    found = look_up(asked.select("name", "ladder").distinct(), name_index(known, most_hits, keys), LADDERS, most_hits)
    by_raw = settle(asked.join(found, ["name", "ladder"]).select(F.col("raw").alias("name"), F.col("ladder").alias("kind"), "tier", "n_hits", "hits"), "hits")
    return dealt(refs, by_raw, ["name", "kind"], "left")


def reference_edges(resolved: DataFrame, precision: DataFrame) -> DataFrame:
    """src, dst, kind, precision, file, line, ord, external, name, missing: one edge for each hit, those of the same file first.

    Unresolved names, and names with more occurrences than are listed, lead to one external node each.
    """
    by_function = (F.col("kind") == "uses") & (F.floor(F.col("tier") / 2) == 2)
    kind = F.when(by_function, "refs").otherwise(F.col("kind")).alias("kind")
    ranked = F.transform("hits", lambda h: F.struct((h["file"] != F.col("file")).alias("away"), h["file"].alias("file"), h["sym_ord"].alias("sym_ord"), h["id"].alias("id")))
    hits = resolved.where(F.col("hits").isNotNull()).select("from_id", kind, "name", "file", "line", "ref_ord", F.posexplode(F.array_sort(ranked)).alias("place", "h"))
    inner = hits.select(F.col("from_id").alias("src"), F.col("h.id").alias("dst"), "kind", "file", "line", "ref_ord", "place", F.lit(False).alias("external"), "name", F.lit(False).alias("missing"))
    inner = inner.join(precision.select(F.col("id").alias("dst"), "precision"), "dst", "left")
    sought = F.element_at(F.create_map(*[F.lit(x) for kv in OUTSIDE.items() for x in kv]), F.col("kind"))
    crowd = F.col("n_hits") > 0
    outer = resolved.where(F.col("hits").isNull()).select(
        F.col("from_id").alias("src"), F.concat(F.lit("ext:"), F.when(crowd, "function").otherwise(sought), F.lit(":"), "name").alias("dst"), kind,
        "file", "line", "ref_ord", F.lit(0).alias("place"), F.lit(True).alias("external"), "name", F.coalesce(F.col("n_hits") == 0, F.lit(True)).alias("missing"), F.lit("approx").alias("precision"),
    )
    order = F.struct(F.lit(1).alias("stage"), "file", F.col("ref_ord").alias("n"), F.col("place").cast("long").alias("place"))
    return inner.unionByName(outer).select("src", "dst", "kind", "precision", "file", "line", order.alias("ord"), "external", "name", "missing")


def include_edges(includes: DataFrame, files: DataFrame, search: list[str]) -> DataFrame:
    """src, dst, kind, precision, file, line, ord, external, name, missing of every include."""
    named = settle(includes.withColumn("inc_id", F.struct("file", "ord")), "includes")
    found = resolve_includes(named.select("inc_id", "file", "target"), files, search)
    met = named.join(found, "inc_id")
    outside = F.col("resolved").isNull()
    return met.select(
        F.concat(F.lit("file:"), "file").alias("src"), F.when(outside, F.concat(F.lit("ext:file:"), "target")).otherwise(F.concat(F.lit("file:"), "resolved")).alias("dst"),
        F.lit("includes").alias("kind"), F.coalesce("precision", F.lit("approx")).alias("precision"), "file", "line",
        F.struct(F.lit(0).alias("stage"), "file", F.col("ord").cast("long").alias("n"), F.lit(0).cast("long").alias("place")).alias("ord"), outside.alias("external"), F.col("target").alias("name"), F.lit(False).alias("missing"),
    )


def target_graph(rows: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes of targets, nodes of the libraries that no target here is, and the edges to sources and libraries.

    rows: those of build_script.targets. Of several definitions of a target the last gives its place, and each its
    edges. Libraries from outside are nodes even where other externals aren't asked for: a link is a fact of the build.
    """
    rows = settle(rows, "scripts")
    defined = build_script.definitions(rows)
    listed = settle(build_script.listed_sources(rows), "listed")
    sizes = listed.groupBy("target", "file", "line").agg(F.count("*").alias("n"))
    last = defined.join(sizes, ["target", "file", "line"], "left").groupBy("target").agg(F.max(F.struct("file", "line", "kind", "n")).alias("d"))
    detail = F.concat("d.kind", F.when(F.col("d.n") > 0, F.concat(F.lit(", "), F.col("d.n").cast("string"), F.lit(" sources"))).otherwise(""))
    none = [F.lit(None).cast("string").alias("api_header"), F.lit(None).cast("int").alias("api_line")]
    nodes = last.select(
        F.concat(F.lit("target:"), "target").alias("id"), F.lit("target").alias("kind"), F.col("target").alias("name"), "d.file", F.col("d.line").cast("int").alias("line"), F.lit(0).alias("column"), F.lit(False).alias("declaration"),
        F.lit(0).alias("body_lines"), detail.alias("detail"), F.lit("exact").alias("precision"), *none,
    )
    place = lambda n, k: F.struct(F.lit(2).alias("stage"), "file", (F.col("line") * (1 << 20) + n).cast("long").alias("n"), k.cast("long").alias("place")).alias("ord")
    common = [F.lit("links").alias("kind"), F.lit("exact").alias("precision"), "file", F.col("line").cast("int").alias("line")]
    met = build_script.target_sources(listed.select("target", "listed"), files)
    tails = met.select("target", "source", F.explode(suffixes(F.col("source"))).alias("listed"))
    to_files = listed.join(tails, ["target", "listed"]).select(F.concat(F.lit("target:"), "target").alias("src"), F.concat(F.lit("file:"), "source").alias("dst"), *common, place(F.lit(0), F.xxhash64("source")), F.lit(False).alias("external"), F.col("source").alias("name"), F.lit(False).alias("missing"))
    linked = settle(build_script.linked_libraries(rows), "linked")
    ends = build_script.target_links(linked, defined.select(F.col("target").alias("name")), ["file", "line", "place", "library"])
    to_libraries = ends.select(F.concat(F.lit("target:"), "target").alias("src"), "dst", *common, place(F.lit(1), F.xxhash64("place", "library")), F.col("external"), F.col("library").alias("name"), F.lit(False).alias("missing"))
    outside = ends.where("external").select("dst", "library").distinct().select(
        F.col("dst").alias("id"), F.lit("target").alias("kind"), F.col("library").alias("name"), F.lit("").alias("file"), F.lit(0).alias("line"), F.lit(0).alias("column"), F.lit(False).alias("declaration"), F.lit(0).alias("body_lines"),
        F.lit("linked by a build script").alias("detail"), F.lit("exact").alias("precision"), *none,
    )
    return nodes, outside, to_files.unionByName(to_libraries)


def wide_edges(files: DataFrame, symbols: DataFrame, refs: DataFrame, includes: DataFrame, search: list[str] | None = None, most_hits: int = 3, few: bool = False) -> DataFrame:
    """Every edge that includes and references give, externals too, before equal ones are merged.

    files (path) and symbols are those of the whole tree; refs and includes may be of a part of it (few).
    """
    resolved = settle(reference_hits(refs, symbols, most_hits, few), "resolved")
    known = symbols
    if few:
        known = symbols.join(sided(settle(resolved.select(F.explode("hits.id").alias("id")).distinct(), "ids")), "id", "left_semi")
    return include_edges(includes, files, search or []).unionByName(reference_edges(resolved, merge_symbols(known)))


def assembled(files: DataFrame, symbols: DataFrame, wide: DataFrame, *, include_external: bool = False, targets: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and one row of counts, from files (path), symbols, edges as wide_edges gives them, and target_graph's nodes."""
    file_nodes = files.select(
        F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("kind"), F.col("path").alias("name"), F.col("path").alias("file"), F.lit(1).alias("line"), F.lit(0).alias("column"),
        F.lit(False).alias("declaration"), F.lit(0).alias("body_lines"), F.lit("").alias("detail"), F.lit("approx").alias("precision"), F.lit(None).cast("string").alias("api_header"), F.lit(None).cast("int").alias("api_line"),
    )
    inner = file_nodes.unionByName(merge_symbols(symbols))
    if targets:
        inner = inner.unionByName(targets[0])
    inner = inner.withColumn("module", module_of(F.col("file"))).withColumn("external", F.lit(False))
    asked = F.col("external") & (F.col("kind") != "links")
    outer = wide.where(asked).select(F.col("dst").alias("id"), F.regexp_extract("dst", "^ext:([a-z]+):", 1).alias("kind"), "name").distinct()
    outer = outer.select(
        "id", "kind", "name", F.lit("").alias("file"), F.lit(0).alias("line"), F.lit(0).alias("column"), F.lit(False).alias("declaration"), F.lit(0).alias("body_lines"), F.lit("").alias("detail"),
        F.lit("approx").alias("precision"), F.lit(None).cast("string").alias("api_header"), F.lit(None).cast("int").alias("api_line"), F.lit(EXTERNAL_MODULE).alias("module"), F.lit(True).alias("external"),
    )
    nodes = inner.unionByName(outer) if include_external else inner
    if targets:
        nodes = nodes.unionByName(targets[1].withColumn("module", F.lit(EXTERNAL_MODULE)).withColumn("external", F.lit(True)))
    nodes = settle(nodes, "nodes")
    kept = wide if include_external else wide.where(~asked)
    edges = settle(valid_edges(dedup_edges(kept.select("src", "dst", "kind", "precision", "file", "line", "ord")), nodes), "edges")
    nodes = nodes.join(degrees(edges), "id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("in_degree", "out_degree")})
    found = F.col("kind") == "includes"
    counts = wide.agg(
        F.count_if(found & ~F.col("external") & (F.col("precision") == "exact")).alias("exact_includes"),
        F.count_if(found & ~F.col("external") & (F.col("precision") == "approx")).alias("approx_includes"),
        F.count_if("missing").alias("unresolved_refs"),
    )
    return nodes, edges.withColumnRenamed("ord", "edge_ord"), counts


def build(files: DataFrame, symbols: DataFrame, refs: DataFrame, includes: DataFrame, *, search: list[str] | None = None, include_external: bool = False, most_hits: int = 3, scripts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and one row of counts (exact and approximate includes, unresolved references).

    files: path. The other tables are those of extract, scripts those of build_script.targets. External nodes and the
    edges to them only if asked for, but for the libraries that targets link.
    """
    wide, targets = wide_edges(files, symbols, refs, includes, search, most_hits), None
    if scripts is not None:
        *targets, links = target_graph(scripts, files)
        wide = wide.unionByName(links)
    return assembled(files, symbols, settle(wide, "edges"), include_external=include_external, targets=targets)


def enclosing_function(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """point_id, id: the last function at or above each point in its file, else the last other symbol, else the file.

    Ties go to the later node. points: point_id, file, line; symbols: id, kind, file, line, node_ord. One sort a
    file; the last function and the last other symbol are carried down together.
    """
    s = symbols.select("file", "line", F.lit(0).alias("side"), "node_ord", F.when(F.col("kind") == "function", F.col("id")).alias("fn"), F.when(F.col("kind") != "function", F.col("id")).alias("other"), F.lit(None).cast(points.schema["point_id"].dataType).alias("point_id"))
    p = points.select("file", "line", F.lit(1).alias("side"), F.lit(None).cast(symbols.schema["node_ord"].dataType).alias("node_ord"), F.lit(None).cast(symbols.schema["id"].dataType).alias("fn"), F.lit(None).cast(symbols.schema["id"].dataType).alias("other"), "point_id")
    down = Window.partitionBy("file").orderBy("line", "side", "node_ord").rowsBetween(Window.unboundedPreceding, 0)
    carried = s.unionByName(p).withColumns({c: F.last(c, ignorenulls=True).over(down) for c in ("fn", "other")})
    return carried.where("side = 1").select("point_id", F.coalesce(F.col("fn").cast("string"), F.col("other").cast("string"), F.concat(F.lit("file:"), F.col("file").cast("string"))).alias("id"))


def containment(symbols: DataFrame) -> DataFrame:
    """file, symbol, ord: which file nodes hold which symbols, for traversals."""
    return symbols.groupBy(F.concat(F.lit("file:"), "file").alias("file"), F.col("id").alias("symbol")).agg(F.min("sym_ord").alias("ord"))


def contained(symbols: DataFrame) -> DataFrame:
    """containment with an order of the kind that a build's edges have, before all of them."""
    return containment(symbols).select("file", "symbol", F.struct(F.lit(-1).alias("stage"), F.col("file").alias("file"), F.col("ord").cast("long").alias("n"), F.lit(0).cast("long").alias("place")).alias("ord"))


def neighbours(edges: DataFrame, nodes: DataFrame, focus: str, direction: str = "both", most: int = 200, held: DataFrame | None = None) -> DataFrame:
    """id, name, kind: the other end of every edge of the subgraph of depth 1, focus and its own file left out, in edge order.

    Of an edge between two neighbours the other end is its source. held: what files contain, as `contained` gives it.
    """
    ordered = edges.withColumnRenamed("edge_ord", "ord").select("src", "dst", "kind", "line", "ord")
    visited, _ = subgraph(ordered, focus, 1, direction, 1 << 40, held)
    inner = induced(edges, settle(visited, "near"))
    own = nodes.where(F.col("id") == focus).select(F.concat(F.lit("file:"), "file").alias("id"))
    other = F.when(F.col("src") == focus, F.col("dst")).otherwise(F.col("src"))
    first = inner.groupBy(other.alias("id")).agg(F.min("edge_ord").alias("edge_ord")).where(F.col("id") != focus).join(own, "id", "left_anti")
    return first.join(nodes.select("id", "name", "kind"), "id").orderBy("edge_ord", "id").limit(most).select("id", "name", "kind")


def highlighted(edges: DataFrame, focus: str) -> DataFrame:
    """id of focus and of every node an edge joins to it."""
    touching = edges.where((F.col("src") == focus) | (F.col("dst") == focus))
    return touching.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def of_kinds(edges: DataFrame, kinds: list[str] | None) -> DataFrame:
    """Edges of the enabled kinds; all if none are named."""
    return edges.where(F.col("kind").isin(*kinds)) if kinds else edges


def start_label(node_id: Column) -> Column:
    """A node id as a route's start shows it: without `func:` or `ext:<kind>:`."""
    return F.regexp_replace(node_id, "^(?:func:|ext:[^:]*:)", "")


def id_payload(node_id: Column) -> Column:
    """What follows the kind in an id."""
    return F.regexp_replace(node_id, "^(?:ext:[^:]*|[^:]*):", "")


def edge_key(src: Column, dst: Column, kind: Column) -> Column:
    return F.concat_ws("|", src, dst, kind)


def display_name(node_id: Column) -> Column:
    return F.when(node_id.startswith("file:"), base_name(node_id)).otherwise(simple_name(id_payload(node_id)))
