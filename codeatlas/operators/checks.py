"""Architecture checks: leaks of the public surface, and cycles between directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.functions.exprs import is_header, is_public
from codeatlas.functions.tables import dealt, drop_table, settle, sided


def dir_arcs(edges: DataFrame) -> DataFrame:
    """src, dst, n, file, line for each pair of different modules; a header's edge represents it if there is one.

    edges: m1, m2, file, line, ord, header (boolean).
    """
    across = edges.where("m1 <> m2")
    first = F.min_by(F.struct("file", "line"), F.struct(~F.col("header"), F.col("ord")))
    return across.groupBy(F.col("m1").alias("src"), F.col("m2").alias("dst")).agg(F.count("*").alias("n"), first.alias("f")).select("src", "dst", "n", "f.file", "f.line")


def strong_components(arcs: DataFrame) -> DataFrame:
    """node, component (its least node) of every node that lies on a cycle with another.

    Arcs that lie on no cycle are trimmed: those from a node that nothing leads to, and those to one that leads nowhere.
    Nodes with one arc in and one out are contracted: their chain becomes one arc between its ends, which pointer
    jumping finds in as many rounds as the chain's length has bits. In what is left, every node takes the least label
    that reaches it and the least that it reaches; where the two are one label, its component is found, and only arcs
    between nodes of equal labels stay for the next round. Labels are hashes, so the order of names plays no part.
    """
    spark = arcs.sparkSession
    kind = arcs.schema["src"].dataType.simpleString()
    live = settle(arcs.select("src", "dst").where("src <> dst").distinct(), "live")
    chains: list[DataFrame] = []
    parts: list[DataFrame] = []
    n = live.count()
    while n:
        trimmed, left = _trimmed(live, n)
        contracted, loops, links = _contracted(trimmed) if left else (trimmed, None, None)
        if links is not None:
            chains.append(links)
            parts.append(loops)
            live, n = contracted, contracted.count()
            continue
        live, n = trimmed, left
        if not n:
            break
        found, live = _coloured(live)
        parts.append(found)
        n = live.count()
    named = spark.createDataFrame([], f"node {kind}, rep {kind}")
    for part in parts:
        named = named.unionByName(part)
    named = settle(named, "reps")
    # chains of later rounds first: their nodes are ends of the chains before
    for links in reversed(chains):
        same = lambda end: named.select(F.col("node").alias(end), F.col("rep").alias(f"{end}_rep"))  # noqa: E731, B023
        met = links.join(same("first"), "first", "left").join(same("last"), "last", "left")
        # a chain from a node back to itself makes it one component, which may have had no other
        closed = F.col("first") == F.col("last")
        on_cycle = met.where(closed | (F.col("first_rep") == F.col("last_rep"))).withColumn("rep", F.coalesce("first_rep", "first"))
        heads = on_cycle.where(F.col("first_rep").isNull()).select(F.col("first").alias("node"), "rep").distinct()
        named = settle(named.unionByName(on_cycle.select("node", "rep")).unionByName(heads), "reps")
    least = named.groupBy("rep").agg(F.min("node").alias("component"))
    return settle(dealt(named, settle(least, "least"), ["rep"]).select("node", "component"), "components")


def _trimmed(live: DataFrame, n: int) -> tuple[DataFrame, int]:
    """live (of n arcs) without arcs that can't lie on a cycle, as long as that takes a twentieth of them at a time."""
    while n:
        ends = lambda a, b: live.select(F.col(a).alias(b)).distinct()  # noqa: E731, B023
        kept = settle(live.join(ends("dst", "src"), "src", "left_semi").join(ends("src", "dst"), "dst", "left_semi").select("src", "dst"), "live")
        left = kept.count()
        live, gone, n = kept, n - left, left
        if gone * 20 <= left:
            break
    return live, n


def _contracted(live: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """live with chains as single arcs, (node, rep) of chains that are whole cycles, and (node, first, last) of the others.

    The last is None if there is no chain.
    """
    out = live.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.first("dst").alias("next"))
    into = live.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.first("src").alias("prev"))
    links = settle(out.join(into, "node").where("n_out = 1 and n_in = 1").select("node", "next", "prev", F.col("node").alias("rep")), "chain")
    n = links.count()
    if not n:
        return live, links.select("node", "rep"), None
    nodes = links.select("node")
    # next and prev jump ahead while they are chain nodes too; of a cycle of chain nodes the least name is the rep
    state = links
    for _ in range(n.bit_length() + 1):
        ahead = state.select(F.col("node").alias("next"), F.col("next").alias("next2"), F.col("rep").alias("rep2"))
        behind = state.select(F.col("node").alias("prev"), F.col("prev").alias("prev2"))
        met = state.join(ahead, "next", "left").join(behind, "prev", "left")
        state = settle(met.select("node", F.coalesce("next2", "next").alias("next"), F.coalesce("prev2", "prev").alias("prev"), F.least("rep", F.coalesce("rep2", "rep")).alias("rep"), F.coalesce(F.col("next2").isNotNull() | F.col("prev2").isNotNull(), F.lit(False)).alias("moving")), "chain")
        if not state.where("moving").limit(1).count():
            break
        state = state.drop("moving")
    state = settle(state.select("node", "next", "prev", "rep"), "chain")
    inner = nodes.withColumnRenamed("node", "next")
    cycles = state.join(inner, "next", "left_semi").select("node", "rep")
    ends = settle(state.join(inner, "next", "left_anti").select("node", F.col("prev").alias("first"), F.col("next").alias("last")), "ends")
    rest = live.join(nodes.withColumnRenamed("node", "src"), "src", "left_anti").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_anti")
    short = ends.select(F.col("first").alias("src"), F.col("last").alias("dst")).where("src <> dst").distinct()
    return settle(rest.select("src", "dst").unionByName(short).distinct(), "live"), settle(cycles, "cycles"), ends


def _coloured(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, rep) of the components that the least labels find, and the arcs left for the next round."""
    nodes = live.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    label = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("node"))
    state = settle(nodes.select("node", label.alias("f"), label.alias("b")), "labels")
    # along an arc the forward label goes to its end, the backward one to its start
    both = live.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.lit(True).alias("ahead")).unionByName(live.select(F.col("dst").alias("node"), F.col("src").alias("to"), F.lit(False).alias("ahead")))
    while True:
        sent = both.join(state, "node").groupBy(F.col("to").alias("node")).agg(F.min(F.when(F.col("ahead"), F.col("f"))).alias("f2"), F.min(F.when(~F.col("ahead"), F.col("b"))).alias("b2"))
        new = settle(state.join(sent, "node", "left").select("node", F.least("f", "f2").alias("f"), F.least("b", "b2").alias("b"), ((F.col("f2") < F.col("f")) | (F.col("b2") < F.col("b"))).alias("moved")), "labels")
        drop_table(state)
        state = new
        if not new.where("moved").limit(1).count():
            break
    found = settle(state.where("f = b").select("node", F.col("f.node").alias("rep")), "found")
    # a component lies within one pair of labels
    open_ = state.where("f <> b").select("node", F.struct("f", "b").alias("pair"))
    met = live.join(open_.select(F.col("node").alias("src"), F.col("pair").alias("p1")), "src").join(open_.select(F.col("node").alias("dst"), F.col("pair").alias("p2")), "dst")
    return found, settle(met.where("p1 = p2").select("src", "dst"), "live")


def dir_cycles(arcs: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """component, dirs, edge_count, file, line of each cycle of two directories or more."""
    parts = sided(settle(parts if parts is not None else strong_components(arcs), "parts"))
    inner = arcs.join(parts.select(F.col("node").alias("src"), "component"), "src").join(parts.select(F.col("node").alias("dst"), F.col("component").alias("c2")), "dst").where("component = c2")
    sums = inner.groupBy("component").agg(F.sum("n").alias("edge_count"), F.min(F.struct("file", "line")).alias("f"))
    dirs = parts.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("dirs"))
    return sums.join(dirs, "component").select("component", "dirs", "edge_count", "f.file", "f.line")


def public_leaks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """from_file, from_line, to_file: public files that include or use what is not public; the first edge of each.

    nodes: id, kind, file, external; edges: src, dst, kind, line, ord.
    """
    inner = nodes.where(~F.col("external"))
    a = inner.where((F.col("kind") == "file") & is_public(F.col("file"))).select(F.col("id").alias("src"), F.col("file").alias("from_file"))
    b = inner.where((F.col("file") != "") & ~is_public(F.col("file"))).select(F.col("id").alias("dst"), F.col("file").alias("to_file"))
    met = edges.where(F.col("kind").isin("includes", "uses")).join(a, "src").join(b, "dst").where("from_file <> to_file")
    return met.groupBy("from_file", "to_file").agg(F.min_by("line", "ord").alias("from_line"))


def violations(nodes: DataFrame, edges: DataFrame, most: int | None = 500) -> DataFrame:
    """kind, from_file, from_line, to_file, dirs, edge_count, total: both checks, the first `most` in order.

    None for `most` gives them all, in no order.

    nodes: id, kind, file, module, external; edges: src, dst, kind, file, line, ord.
    """
    leaks = public_leaks(nodes, edges).select(F.lit("public-api-leak").alias("kind"), "from_file", "from_line", "to_file", F.array().cast("array<string>").alias("dirs"), F.lit(0).cast("long").alias("edge_count"))
    home = nodes.where((F.col("kind") == "file") & ~F.col("external")).select("id", "module")
    including = edges.where("kind = 'includes'").join(home.select(F.col("id").alias("src"), F.col("module").alias("m1")), "src").join(home.select(F.col("id").alias("dst"), F.col("module").alias("m2")), "dst")
    arcs = settle(dir_arcs(including.select("m1", "m2", "file", "line", "ord", is_header(F.col("file")).alias("header"))), "arcs")
    cycles = dir_cycles(arcs).select(F.lit("directory-cycle").alias("kind"), F.col("file").alias("from_file"), F.col("line").alias("from_line"), F.lit("").alias("to_file"), "dirs", "edge_count")
    both = settle(leaks.unionByName(cycles), "violations")
    counted = both.crossJoin(both.agg(F.count("*").alias("total")))
    return counted if most is None else counted.orderBy("kind", "from_file", "from_line", "to_file").limit(most)


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count("*").alias("shown"), F.max("total").alias("total"))


def diagnostics(found: DataFrame) -> DataFrame:
    """file, line, code, severity, message: what an editor shows for each violation."""
    text = F.when(F.col("kind") == "directory-cycle", F.concat(F.lit("directories depend on each other: "), F.array_join("dirs", " <-> "))).otherwise(F.concat(F.lit("public file depends on internal "), F.col("to_file")))
    return found.select(F.col("from_file").alias("file"), F.col("from_line").alias("line"), F.concat(F.lit("codeatlas."), F.col("kind")).alias("code"), F.lit("warning").alias("severity"), text.alias("message"))


def callers_callees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, callers, callees over calls between nodes that aren't external."""
    from codeatlas.operators.graph import degrees, valid_edges

    inner = nodes.where(~F.col("external"))
    calls = valid_edges(edges.where("kind = 'calls'"), inner)
    d = degrees(calls, inner)
    return d.select("id", F.col("in_degree").alias("callers"), F.col("out_degree").alias("callees"))


def entry_candidates(nodes: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """rank, id, tier, callers, callees, total: where reading can start, best first.

    Tiers: 0 a program's entry, 1 public and calling, 2 public, 3 never called but calling.
    nodes: id, kind, name, file, line, external, declaration, body_lines, api_header.
    """
    from codeatlas.functions.exprs import is_entry_name

    met = nodes.where((F.col("kind") == "function") & ~F.col("external") & ~F.col("declaration") & (F.col("body_lines") > 0)).join(callers_callees(nodes, edges), "id")
    public = F.coalesce(F.col("api_header"), F.lit("")) != ""
    tier = F.when(is_entry_name(F.col("name")), 0).when(public & (F.col("callees") > 0), 1).when(public, 2).when((F.col("callers") == 0) & (F.col("callees") > 0), 3)
    ranked = met.withColumn("tier", tier).where(F.col("tier").isNotNull())
    order = ["tier", F.desc("callees"), "callers", "file", "line", "name", "id"]
    top = ranked.orderBy(*order).limit(most)  # then the window sees the top rows only
    total = ranked.agg(F.count("*").alias("total"))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).crossJoin(total).select("rank", "id", "tier", "callers", "callees", "total")


def entry_point(nodes: DataFrame) -> DataFrame:
    """id of the first function with an entry's name that is defined here, else of any such function."""
    from codeatlas.functions.exprs import is_entry_name

    named = nodes.where((F.col("kind") == "function") & is_entry_name(F.col("name")))
    fallback = F.col("external") | F.col("declaration")
    return named.agg(F.min_by("id", F.struct(fallback.alias("f"), F.col("node_ord"))).alias("id")).where(F.col("id").isNotNull())
