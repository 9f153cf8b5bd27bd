"""Building and summarising node and edge tables: merging, deduplication, degrees, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.functions.tables import dealt, settle, sided


def dedup_edges(edges: DataFrame, order: str = "ord") -> DataFrame:
    """The first edge of each (src, dst, kind) in order, with its other columns. Combines before the shuffle."""
    rest = [c for c in edges.columns if c not in ("src", "dst", "kind")]
    first = edges.groupBy("src", "dst", "kind").agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("e"))
    return first.select("src", "dst", "kind", *[F.col(f"e.{c}").alias(c) for c in rest])


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, in_degree, out_degree. One aggregation over both ends; nodes without edges come from `nodes`."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    if nodes is not None:
        ends = ends.unionByName(nodes.select("id", F.lit(0).alias("o"), F.lit(0).alias("i")))
    return ends.groupBy("id").agg(F.sum("i").cast("long").alias("in_degree"), F.sum("o").cast("long").alias("out_degree"))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist and differ."""
    ids = nodes.select("id")
    real = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    return real.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def kind_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count("*").alias("n_edges"), F.countDistinct("src", "dst").alias("n_distinct"))


def stats_row(nodes: DataFrame, edges: DataFrame, compile_db: bool = False) -> DataFrame:
    """One row: counts of files, symbols and edges, maps of counts by kind, exact and approximate nodes, overall precision."""
    as_map = lambda df, k, name: df.groupBy(k).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, "count")))).alias(name))
    totals = nodes.agg(
        F.count_if((F.col("kind") == "file") & ~F.col("external")).alias("file_count"), F.count_if(~F.col("kind").isin("file", "target")).alias("symbol_count"), F.count_if("external").alias("external_count"),
        F.count_if(F.col("precision") == "exact").alias("exact_nodes"), F.count_if(F.col("precision") != "exact").alias("approx_nodes"),
    )
    return (
        totals.crossJoin(edges.agg(F.count("*").alias("edge_count")))  # one row each
        .crossJoin(as_map(nodes, "kind", "node_kind_counts"))
        .crossJoin(as_map(edges, "kind", "edge_kind_counts"))
        .withColumn("precision", F.lit("partial" if compile_db else "approx"))
    )


def merge_symbols(occurrences: DataFrame) -> DataFrame:
    """One node an id from its occurrences, ordered by (file, sym_ord): the first definition places it.

    In: id, kind, name, file, sym_ord, line, column, signature, declaration, body_lines, precision, public.
    """
    at = F.struct("file", "sym_ord")
    first = lambda c, cond: F.min_by(c, F.when(cond, at) if cond is not None else at)
    place = F.struct("file", "line", "column")
    defined, public = ~F.col("declaration"), F.col("public")
    merged = occurrences.groupBy("id").agg(
        first(F.struct("kind", "name"), None).alias("n"),
        first(place, defined).alias("d"),
        first(place, None).alias("o"),
        F.bool_and("declaration").alias("declaration"),
        F.max("body_lines").alias("body_lines"),
        first(F.struct("file", "line"), public).alias("api"),
        first(F.col("signature"), F.col("signature") != "").alias("detail"),
        F.max_by("precision", at).alias("precision"),
    )
    where = F.coalesce("d", "o")
    return merged.select(
        "id", "n.kind", "n.name", where["file"].alias("file"), where["line"].alias("line"), where["column"].alias("column"), "declaration", "body_lines",
        F.coalesce("detail", F.lit("")).alias("detail"), "precision", F.col("api.file").alias("api_header"), F.col("api.line").alias("api_line"),
    )


def top_modules(files: DataFrame, most: int) -> DataFrame:
    """module, n_files: the largest modules, then by name."""
    return files.groupBy("module").agg(F.count("*").alias("n_files")).orderBy(F.desc("n_files"), "module").limit(most)


def architecture(files: DataFrame, edges: DataFrame, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """Top modules, and src, dst, weight between different ones. files: id, module; edges: src, dst of files."""
    top = F.broadcast(settle(top_modules(files, most), "modules"))  # at most `most` rows
    home = files.select("id", "module").join(top.select("module"), "module")
    a = edges.join(home.select(F.col("id").alias("src"), F.col("module").alias("m1")), "src")
    b = a.join(home.select(F.col("id").alias("dst"), F.col("module").alias("m2")), "dst").where("m1 <> m2")
    return top, b.groupBy(F.col("m1").alias("src"), F.col("m2").alias("dst")).agg(F.count("*").alias("weight"))


def cluster_key(module: Column, file: Column) -> Column:
    """A node's group: its module; without one, or in the root, the first part of its file's path, else `.`."""
    head = F.substring_index(F.coalesce(file, F.lit("")), "/", 1)
    return F.when(~F.coalesce(module, F.lit("")).isin("", "."), module).when(head != "", head).otherwise(".")


def cluster(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (id, kind, n_members, detail, precision) and the first edge between each two of them by kind.

    Externals stay themselves. A group's kind is target if its first node is one, else file, and its precision the
    first node's. nodes: id, module, external; file, kind, precision and node_ord if there are; edges: src, dst, kind, ord.
    """
    given = lambda c, other: F.col(c) if c in nodes.columns else other
    group = F.when(F.col("external"), F.col("id").cast("string")).otherwise(F.concat(F.lit("dir:"), cluster_key(F.col("module"), given("file", F.lit("")))))
    home = nodes.select("id", group.alias("g"), given("kind", F.lit("file")).alias("kind"), given("precision", F.lit("approx")).alias("precision"), given("node_ord", F.col("id")).alias("node_ord"))
    first = F.min(F.struct("node_ord", "kind", "precision")).alias("f")
    groups = home.groupBy(F.col("g").alias("id")).agg(F.count("*").alias("n_members"), first)
    groups = groups.select("id", F.when(F.col("f.kind") == "target", "target").otherwise("file").alias("kind"), "n_members", F.concat(F.col("n_members").cast("string"), F.lit(" nodes")).alias("detail"), "f.precision")
    a = edges.join(home.select(F.col("id").alias("src"), F.col("g").alias("g1")), "src")
    b = a.join(home.select(F.col("id").alias("dst"), F.col("g").alias("g2")), "dst").where("g1 <> g2")
    return groups, dedup_edges(b.select(F.col("g1").alias("src"), F.col("g2").alias("dst"), "kind", "ord"))


#: Nodes above which a view is shown in groups.
CLUSTER_ABOVE = 400


def level_of_detail(nodes: DataFrame, edges: DataFrame, grouped: bool = False) -> tuple[DataFrame, DataFrame]:
    """The view as it is, or in groups if asked for or if it has more than CLUSTER_ABOVE nodes."""
    return cluster(nodes, edges) if grouped or nodes.limit(CLUSTER_ABOVE + 1).count() > CLUSTER_ABOVE else (nodes, edges)


def merge_graphs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; where keys meet, right wins."""
    both = left.withColumn("_r", F.lit(0)).unionByName(right.withColumn("_r", F.lit(1)))
    rest = [c for c in left.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_r").alias("x")).select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])


def without_external(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    inner = nodes.where(~F.col("external"))
    return inner, valid_edges(edges, inner)


#: Kinds that are known by their simple name only.
SIMPLE_ONLY = ("variable", "macro")


def name_index(symbols: DataFrame, most: int, keys: DataFrame | None = None) -> DataFrame:
    """key, how (0 whole name, 1 simple name), kind, n, first: how many symbols answer to a name, and the first `most` of them.

    symbols: occ_id, kind, qualified, simple, one row an occurrence; keys (key): only these, if given. Counts combine before their shuffle, and of a
    name no task sends more than its first `most` occurrences, so a name of a third of all symbols is a few rows.
    """
    names = F.array(F.struct(F.lit(0).alias("how"), F.col("qualified").alias("key")), F.struct(F.lit(1).alias("how"), F.col("simple").alias("key")))
    both = symbols.select("occ_id", "kind", F.explode(names).alias("k")).select("k.key", "k.how", "kind", "occ_id").where(F.col("key").isNotNull() & ((F.col("how") == 1) | ~F.col("kind").isin(*SIMPLE_ONLY)))
    if keys is not None:
        both = both.join(sided(settle(keys, "keys")), "key", "left_semi")
    on = ["key", "how", "kind"]
    counts = both.groupBy(*on).agg(F.count("*").alias("n"))
    heads = both.withColumn("r", F.row_number().over(Window.partitionBy(*on).orderBy("occ_id"))).where(F.col("r") <= most)
    return counts.join(heads.groupBy(*on).agg(F.array_sort(F.collect_set("occ_id")).alias("first")), on)


def look_up(names: DataFrame, index: DataFrame, ladders: dict[str, list[str]], most_hits: int) -> DataFrame:
    """name, ladder, tier, n_hits, hits of the names (name, ladder) that any step of their ladder knows.

    Each name asks once for each step: a join of names with single rows of the index, none with the occurrences.
    """
    step = lambda k, how, kind: F.struct(F.lit(2 * k + how).alias("tier"), F.lit(how).alias("how"), F.lit(kind).alias("kind"))
    steps = None
    for ladder, kinds in ladders.items():
        mine = F.array(*[step(k, how, kind) for k, kind in enumerate(kinds) for how in (0, 1) if how or kind not in SIMPLE_ONLY])
        steps = F.when(F.col("ladder") == ladder, mine) if steps is None else steps.when(F.col("ladder") == ladder, mine)
    asked = names.select("name", "ladder", F.explode(steps).alias("s")).select("name", "ladder", "s.tier", "s.how", "s.kind", F.when(F.col("s.how") == 0, F.col("name")).otherwise(F.substring_index("name", "::", -1)).alias("key"))
    met = dealt(asked, settle(index, "names"), ["key", "how", "kind"])
    best = met.groupBy("name", "ladder").agg(F.min_by(F.struct("tier", "n", "first"), "tier").alias("b"))
    return best.select("name", "ladder", "b.tier", F.col("b.n").alias("n_hits"), F.when(F.col("b.n") <= most_hits, F.col("b.first")).alias("hits"))


def resolve_references(refs: DataFrame, symbols: DataFrame, ladder: list[str], most_hits: int = 3) -> DataFrame:
    """ref_id, name, tier, n_hits, hits for every reference, by exact name, then by simple name, kind by kind.

    refs: ref_id, name; symbols: occ_id, kind, qualified, simple (one row an occurrence). The first tier with any
    occurrence decides. Above most_hits occurrences the reference counts as one external, with no hits listed.
    Names are looked up once each, in an index of names.
    """
    names = refs.select("name").distinct().withColumn("ladder", F.lit(""))
    found = settle(look_up(names, name_index(symbols, most_hits), {"": ladder}, most_hits).drop("ladder"), "found")
    return dealt(refs, found, ["name"], "left").select("ref_id", "name", F.coalesce("tier", F.lit(-1)).alias("tier"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "hits")


def externals(resolved: DataFrame, most_hits: int = 3, kind: str = "function") -> DataFrame:
    """Nodes for what isn't defined here: unresolved names, and names with too many candidates."""
    outside = resolved.where((F.col("n_hits") == 0) | (F.col("n_hits") > most_hits))
    simple = F.when(F.col("n_hits") == 0, F.col("name")).otherwise(F.substring_index("name", "::", -1))
    return outside.select(F.concat(F.lit(f"ext:{kind}:"), simple).alias("id"), simple.alias("name")).distinct()


def resolve_includes(includes: DataFrame, files: DataFrame, search: list[str]) -> DataFrame:
    """inc_id, resolved, precision for every include row (inc_id, file, target), by the first rule that fits.

    1 beside the including file; 2 in a search path, in order; 3 the one file, or the first by name, that ends
    in the target; 4 the only file of that base name; 1 and 2 are exact, 3 and 4 approximate.
    """
    from codeatlas.functions.exprs import ascii_lower, base_name, dir_name, join_path, normalize_path, suffixes

    t = includes.withColumn("t", normalize_path(F.col("target")))
    known = files.select(F.col("path").alias("cand"))
    places = F.array(join_path(dir_name(F.col("file")), F.col("t")), *[join_path(F.lit(p), F.col("t")) for p in search])
    tried = t.where("t <> ''").select("inc_id", F.posexplode(places).alias("rank", "cand")).withColumn("cand", normalize_path(F.col("cand")))
    exact = tried.join(known, "cand").groupBy("inc_id").agg(F.min_by("cand", "rank").alias("exact"))
    lone = files.groupBy(ascii_lower(base_name(F.col("path"))).alias("base")).agg(F.count("*").alias("n"), F.min("path").alias("only")).where("n = 1").select("base", "only")
    # every tail of a path is a key of its own, of which the first path is kept, so no name meets all files of a base name
    wanted = sided(settle(t.select("t").where("t <> ''").distinct(), "targets"))
    tails = files.select("path", F.explode(suffixes(F.col("path"))).alias("t")).join(wanted, "t", "left_semi").groupBy("t").agg(F.min("path").alias("tail"))
    out = t.join(exact, "inc_id", "left").join(tails, "t", "left").withColumn("base", ascii_lower(base_name(F.col("t")))).join(lone, "base", "left")
    near = F.coalesce("tail", "only")
    return out.select("inc_id", F.coalesce("exact", near).alias("resolved"), F.when(F.col("exact").isNotNull(), "exact").when(near.isNotNull(), "approx").alias("precision"))


def innermost_at(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """point_id, id: the last symbol at or above each point in its file; ties go to the later node.

    An as-of join in one window: symbols and points of a file in line order, the last symbol carried down.
    points: point_id, file, line; symbols: id, file, line, node_ord.
    """
    s = symbols.select("file", "line", F.lit(0).alias("side"), "node_ord", F.col("id").alias("sym"), F.lit(None).cast(points.schema["point_id"].dataType).alias("point_id"))
    p = points.select("file", "line", F.lit(1).alias("side"), F.lit(None).cast(symbols.schema["node_ord"].dataType).alias("node_ord"), F.lit(None).cast(symbols.schema["id"].dataType).alias("sym"), "point_id")
    down = Window.partitionBy("file").orderBy("line", "side", "node_ord").rowsBetween(Window.unboundedPreceding, 0)
    carried = s.unionByName(p).withColumn("id", F.last("sym", ignorenulls=True).over(down))
    return carried.where("side = 1").select("point_id", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("file:"), F.col("file").cast("string"))).alias("id"))


def dependents(edges: DataFrame, files: DataFrame, target: str) -> DataFrame:
    """The files with an edge of any kind into target."""
    into = edges.where(F.col("dst") == target).select(F.col("src").alias("id")).distinct()
    return into.join(files.select("id"), "id", "left_semi").orderBy("id")


def same_name_candidates(functions: DataFrame, most: int = 20) -> DataFrame:
    """id, total, candidates (the first `most` others of the simple name), by (file, line, id).

    functions: id, simple, file, line. Counts come from a sum by name. Lists hold the first `most` + 1 of a name: no task
    sends more of them, and the functions of a name that many share are dealt over tasks to meet the one list.
    """
    order = Window.partitionBy("simple").orderBy("file", "line", "id")
    heads = functions.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most + 1)
    lists = heads.groupBy("simple").agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("head"))
    counts = functions.groupBy("simple").agg((F.count("*") - 1).alias("total"))
    met = dealt(functions, settle(counts.join(lists, "simple"), "heads"), ["simple"])
    others = F.slice(F.filter(F.transform("head", lambda h: h["id"]), lambda i: i != F.col("id")), 1, most)
    return met.select("id", "total", others.alias("candidates"), (F.col("total") > 0).alias("ambiguous"))
