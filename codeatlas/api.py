"""The engine's questions as functions: a source tree becomes a graph, and each question a table or lines of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.functions.tables import settle
from codeatlas.operators import build, checks, extract, graph, traverse, views
from codeatlas.sources import build_script, source_tree


@dataclass
class Atlas:
    """The tables of one scanned tree."""

    nodes: DataFrame
    edges: DataFrame
    symbols: DataFrame
    counts: DataFrame
    root: str = ""
    database: str | None = None
    warnings: tuple[str, ...] = ()

    def expand(self, focus: str, depth: int = 2, direction: str = "both", max_nodes: int = 800) -> tuple[DataFrame, DataFrame, bool]:
        """nodes, edges (with the degrees of the whole graph) and whether max_nodes cut the search. A file needs no `file:`."""
        if not self.nodes.where(F.col("id") == focus).limit(1).count():
            focus = f"file:{focus}"
        edges = self.edges.select("src", "dst", "kind", "line", F.col("edge_ord").alias("ord"))
        visited, cut = traverse.subgraph(edges, focus, depth, direction, max_nodes, build.contained(self.symbols))
        visited = settle(visited, "visited")
        return self.nodes.join(visited.select(F.col("node").alias("id")), "id", "left_semi"), traverse.induced(self.edges, visited), cut

    def architecture(self, most: int = 200) -> tuple[DataFrame, DataFrame]:
        """The largest modules, and how many includes lead from one to another."""
        files = self.nodes.where("kind = 'file' and not external")
        return graph.architecture(files, self.edges.where("kind = 'includes'"), most)

    def violations(self, most: int = 500) -> DataFrame:
        return checks.violations(self.nodes, self.edges.withColumnRenamed("edge_ord", "ord"), most)

    def entries(self, most: int = 50) -> DataFrame:
        return checks.entry_candidates(self.nodes, self.edges, most)

    def dependents(self, path: str) -> DataFrame:
        return graph.dependents(self.edges, self.nodes.where("kind = 'file'"), f"file:{path}")

    def expanded(self, nodes: DataFrame, edges: DataFrame, focus: str, direction: str = "both", max_nodes: int = 800) -> tuple[DataFrame, DataFrame]:
        """A view (nodes, edges) with what stands around one more of its nodes; rows of the new part win."""
        more, between, _ = self.expand(focus, 1, direction, max_nodes)
        return graph.merge_graphs(nodes, more, ["id"]).select(*nodes.columns), graph.merge_graphs(edges, between, ["src", "dst", "kind"]).select(*edges.columns)

    def node_at(self, path: str, line: int) -> DataFrame:
        """The node's columns of the last symbol at or above a line of a file, else of the file."""
        point = self.nodes.sparkSession.createDataFrame([(1, path, line)], "point_id long, file string, line int")
        here = self.nodes.where((F.col("file") == path) & ~F.col("kind").isin("file", "target")).select("id", "file", "line", F.struct("line", "column", "id").alias("node_ord"))
        return graph.innermost_at(point, here).join(self.nodes, "id").drop("point_id")

    def symbol_graph(self, path: str, line: int, depth: int = 2, direction: str = "both", max_nodes: int = 800) -> tuple[DataFrame, DataFrame, bool]:
        """expand around the symbol at a place; nothing where there is no such file."""
        row = self.node_at(path, line).select("id").first()
        if row is None:
            return self.nodes.limit(0), self.edges.limit(0), False
        return self.expand(row.id, depth, direction, max_nodes)

    def neighbours(self, focus: str, direction: str = "both", most: int = 200) -> DataFrame:
        return build.neighbours(self.edges, self.nodes, focus, direction, most, build.contained(self.symbols))

    def route(self, start: str | None = None, *, depth_first: bool = False, max_depth: int = 6, max_steps: int = 200, kinds: list[str] | None = None, project_only: bool = True, overrides: DataFrame | None = None, skip_trivial: bool = False, trivial_lines: int = 3, by_file: bool = False) -> DataFrame:
        """step, parent, depth, skipped, new_file, id and the node's columns. Without a start the entry point; without that an error.

        overrides (src, name, pick): the node to follow instead where src leads to that name. skip_trivial leaves out
        short functions that lead nowhere else; by_file then keeps the first step in each file.
        """
        if start is None:
            row = checks.entry_point(self.nodes.withColumn("node_ord", F.struct("file", "line", "id"))).first()
            if row is None:
                raise ValueError("no entry point: choose a start among entries()")
            start = row.id
        names = self.nodes.select(F.col("id").alias("dst"), "name", "external")
        allowed = settle(build.of_kinds(self.edges, kinds or ["calls"]).join(names, "dst"), "allowed")
        calls = allowed.where("not external") if project_only else allowed
        if overrides is not None:
            calls = settle(traverse.overridden(calls.select("src", "dst", "name", "line"), overrides), "calls")
        walk = traverse.route_depth_first if depth_first else traverse.route
        steps = walk(calls, start, max_depth, max_steps).withColumnRenamed("node", "id")
        steps = settle(steps.join(self.nodes.select("id", "name", "file", "body_lines"), "id"), "steps")
        steps = traverse.with_new_file(steps)
        if skip_trivial:
            dropped = traverse.trivial_steps(steps, allowed, trivial_lines)
            steps = settle(traverse.fold(steps, dropped), "folded")
        else:
            steps = steps.withColumn("skipped", F.array().cast("array<string>"))
        if by_file:
            steps = settle(traverse.fold(steps, steps.where(~F.col("new_file")).select("step", "name"), keep_names=False), "folded")
        return steps.select("step", "parent", "depth", "skipped", "new_file", "id").join(self.nodes, "id")

    def stats(self) -> DataFrame:
        """One row: counts of nodes, edges and files by kind and precision, of what wasn't resolved or read, and the compile database."""
        return graph.stats_row(self.nodes, self.edges, self.database is not None).crossJoin(self.counts).withColumns({"root": F.lit(self.root), "compile_commands_found": F.lit(self.database is not None), "compile_commands_path": F.lit(self.database or ""), "warnings": F.array(*[F.lit(w) for w in self.warnings]).cast("array<string>")})  # one row each

    def export(self, form: str = "json", focus: str | None = None, depth: int = 3, max_nodes: int = 2000) -> DataFrame:
        """part, ord, line of a subgraph around focus, or of the modules: as json, dot or mermaid."""
        if focus is None:
            modules, arcs = self.architecture(max_nodes)
            nodes = modules.select(F.concat(F.lit("dir:"), "module").alias("id"), F.lit("file").alias("kind"), F.col("module").alias("name"), F.lit(False).alias("external"))
            edges = arcs.select(F.concat(F.lit("dir:"), "src").alias("src"), F.concat(F.lit("dir:"), "dst").alias("dst"), F.lit("includes").alias("kind"), F.lit("approx").alias("precision"))
        else:
            nodes, edges, _ = self.expand(focus, depth, "both", max_nodes)
        nodes = views.numbered_nodes(nodes.withColumn("node_ord", F.col("id"))).drop("node_ord").withColumnRenamed("place", "node_ord")
        edges = edges.drop("edge_ord").withColumn("node_ord", F.concat_ws("|", "src", "dst", "kind"))
        edges = views.numbered_nodes(edges).drop("node_ord").withColumnRenamed("place", "edge_ord")
        if form == "dot":
            return views.to_dot(nodes, edges)
        return views.to_mermaid(nodes, edges) if form == "mermaid" else views.to_json(nodes, edges, named=True)


def scan(spark: SparkSession, root: str, *, kinds: extract.Kinds = extract.Kinds(), search: list[str] | None = None, include_external: bool = False, **listing) -> Atlas:
    """Reads a source tree and builds its graph. Include paths come from `search`, else from the tree's compile database."""
    files = settle(source_tree.list_files(spark, root, **listing), "files")
    listed = settle(source_tree.list_paths(spark, root), "paths")
    found = source_tree.find_compile_db(listed).first()
    warnings, entries = [], 0
    if found is not None:
        flags = settle(source_tree.read_compile_db(spark, f"{root}/{found.path}", root), "flags")
        entries = flags.select("entry").distinct().count()
        if search is None:
            paths = [[r.value for r in source_tree.ordered_union(flags, f).collect()] for f in ("include", "system")]  # a handful of folders
            search = paths[0] + paths[1]
    else:
        warnings += [f"{r.dir or '.'} was configured, but holds no compile database" for r in source_tree.stale_builds(listed).orderBy("dir").limit(20).collect()]
    scripts = build_script.targets(source_tree.list_files(spark, root, include=build_script.SCRIPTS, exclude=build_script.PASSED_OVER)) if kinds.links else None
    symbols, refs, includes = extract.extract(files, kinds)
    nodes, edges, counts = build.build(files, symbols, refs, includes, search=search, include_external=include_external, scripts=scripts)
    skipped = files.agg(F.count_if("skipped").alias("skipped_files"), F.lit(entries).cast("long").alias("compile_command_entries"))
    return Atlas(settle(nodes, "nodes"), settle(edges, "edges"), symbols, settle(counts.crossJoin(skipped), "counts"), root, found.path if found else None, tuple(warnings))  # one row each
