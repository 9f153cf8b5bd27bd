"""Views for reading: paging, tables, search, swimlanes, and text exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.functions.exprs import ellipsis_right, xml_escape
from codeatlas.functions.tables import settle

#: Characters that a Mermaid label can't hold.
MERMAID_MARKS = "\"()<>[]#{}|;\\"


def layer_page(steps: DataFrame, shown: int = 0, page: int = 15) -> DataFrame:
    """step, depth, place, hidden: the first rows of each layer, and how many more it has. steps: step, depth."""
    order = Window.partitionBy("depth").orderBy("step")
    most = max(page, shown)
    placed = steps.withColumn("place", F.row_number().over(order))
    sizes = steps.groupBy("depth").agg(F.count("*").alias("n"))
    kept = placed.where(F.col("place") <= most).join(sizes, "depth")
    return kept.select("step", "depth", "place", F.greatest(F.col("n") - most, F.lit(0)).cast("long").alias("hidden"))


def layer_summary(steps: DataFrame) -> DataFrame:
    """depth, n_steps, n_files, n_ambiguous. steps: depth, file, ambiguous."""
    return steps.groupBy("depth").agg(F.count("*").alias("n_steps"), F.countDistinct("file").alias("n_files"), F.count_if("ambiguous").alias("n_ambiguous"))


def table_view(nodes: DataFrame, most: int | None = None) -> DataFrame:
    """Nodes by total degree, then by node order."""
    out = nodes.withColumn("degree", F.col("in_degree") + F.col("out_degree")).orderBy(F.desc("degree"), "node_ord")
    return out.limit(most) if most else out


def search(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose name or file holds the text, whatever its case."""
    t = F.lower(F.lit(text))
    return nodes.where(F.contains(F.lower("name"), t) | F.contains(F.lower("file"), t))


def search_tree(tree: DataFrame, text: str, depth: int = 4) -> DataFrame:
    """Rows of a tree (id, parent, name, file) that match, and all their ancestors, up to `depth` levels."""
    kept = search(tree, text).select("id", "parent")
    level = kept
    for _ in range(depth - 1):
        level = tree.join(level.select(F.col("parent").alias("id")).distinct(), "id", "left_semi").select("id", "parent")
        kept = kept.union(level)
    return tree.join(kept.select("id").distinct(), "id", "left_semi")


#: Words by which a line of diagnostics is shown as a warning.
ALARMS = "error|failed|failure|cannot|unable|异常|失败|错误"


def severity(line: Column, own: str = r"\[codeatlas\]") -> Column:
    """warn for a line that holds one of ALARMS, in any case, or the engine's own mark; debug for others, null for blank ones."""
    return F.when(F.trim(line) == "", None).when(line.rlike(f"(?i){own}|{ALARMS}"), "warn").otherwise("debug")


def route_tree(steps: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """kind (step or candidate), step, parent, place, id, expandable, is_current: the rows of a route shown as a tree.

    steps: step, parent, id, name, ambiguous. candidates: step, rank, id. A step's children follow in order; an
    ambiguous step has its candidates below it, the current one first.
    """
    kids = steps.groupBy(F.col("parent").alias("step")).agg(F.count("*").alias("n"))
    shown = steps.join(kids, "step", "left")
    place = F.row_number().over(Window.partitionBy("parent").orderBy("step"))
    rows = shown.select(F.lit("step").alias("kind"), "step", "parent", place.cast("long").alias("place"), "id", ((F.coalesce("n", F.lit(0)) > 0) | F.col("ambiguous")).alias("expandable"), F.lit(False).alias("is_current"))
    if candidates is None:
        return rows
    current = steps.where("ambiguous").select(F.lit("candidate").alias("kind"), "step", F.col("step").alias("parent"), F.lit(0).cast("long").alias("place"), "id", F.lit(False).alias("expandable"), F.lit(True).alias("is_current"))
    others = candidates.join(steps.where("ambiguous").select("step"), "step", "left_semi").select(F.lit("candidate").alias("kind"), "step", F.col("step").alias("parent"), F.col("rank").cast("long").alias("place"), "id", F.lit(False).alias("expandable"), F.lit(False).alias("is_current"))
    return rows.unionByName(current).unionByName(others)


#: The keys of a route's step in JSON, with their columns.
STEP_KEYS = {"order": "step", "parent": "parent", "depth": "depth", "newFile": "new_file", "ambiguous": "ambiguous", "id": "id", "kind": "kind", "name": "name", "file": "file", "line": "line", "column": "column", "module": "module", "detail": "detail", "external": "external", "precision": "precision", "bodyLines": "body_lines", "candidateTotal": "candidate_total", "apiHeader": "api_header", "apiLine": "api_line", "skipped": "skipped", "candidates": "candidates"}


def route_json(steps: DataFrame) -> DataFrame:
    """part, ord, line: one JSON object a step, with the keys of STEP_KEYS for which there are columns."""
    return steps.select(F.lit(1).alias("part"), F.col("step").cast("long").alias("ord"), _json(steps, STEP_KEYS, "step").alias("line"))


def graph_svg(points: DataFrame, edges: DataFrame, radius: float = 6.0) -> DataFrame:
    """part, ord, line: an SVG of a laid-out graph; approximate edges dashed. points: id, name, x, y, node_ord."""
    at = points.select("id", "x", "y")
    ends = edges.join(at.select(F.col("id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1")), "src").join(at.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2")), "dst")
    dash = F.when(F.col("precision") == "approx", ' stroke-dasharray="4 3"').otherwise("")
    lines = ends.select(F.lit(1).alias("part"), F.col("edge_ord").cast("long").alias("ord"), F.format_string('<line x1="%.1f" y1="%.1f" x2="%.1f" y2="%.1f"%s/>', "x1", "y1", "x2", "y2", dash).alias("line"))
    dots = points.select(F.lit(2).alias("part"), F.col("node_ord").cast("long").alias("ord"), F.format_string('<circle cx="%.1f" cy="%.1f" r="%.1f"/><text x="%.1f" y="%.1f">%s</text>', "x", "y", F.lit(radius), F.col("x") + radius + 2, F.col("y") + 4.0, xml_escape(F.col("name"))).alias("line"))
    return _lines(points.sparkSession, [(0, 0, '<svg xmlns="http://www.w3.org/2000/svg">'), (3, 0, "</svg>")]).unionByName(lines).unionByName(dots)


def kinds_present(nodes: DataFrame, legend: list[str]) -> DataFrame:
    spark = nodes.sparkSession
    return spark.createDataFrame([(k, i) for i, k in enumerate(legend)], "kind string, place int").join(nodes.select("kind").distinct(), "kind", "left_semi")


def swimlane(steps: DataFrame, most: int = 400, char: float = 7.2, pad: float = 24.0, least: float = 56.0, gap: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """lanes (file, lane), cells (step, lane, x, width), arrows (parent, step, cross_file, x1, x2).

    steps: step, parent, file, label. The first `most` steps are laid out; lanes by first entry, columns by step.
    """
    kept = steps.where(F.col("step") <= most)
    lanes = kept.groupBy("file").agg(F.min("step").alias("first")).withColumn("lane", F.row_number().over(Window.orderBy("first")) - 1)
    width = F.greatest(F.lit(least), F.length("label") * char + pad)
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)  # `most` rows
    cells = kept.withColumn("width", width).withColumn("x", F.coalesce(F.sum(F.col("width") + gap).over(upto), F.lit(0.0)))
    cells = cells.join(lanes.select("file", "lane"), "file")
    a = cells.select(F.col("step").alias("parent"), F.col("x").alias("px"), F.col("width").alias("pw"), F.col("file").alias("pf"))
    arrows = cells.join(a, "parent").select("parent", "step", (F.col("file") != F.col("pf")).alias("cross_file"), (F.col("px") + F.col("pw")).alias("x1"), F.col("x").alias("x2"))
    return lanes.select("file", "lane"), cells.select("step", "lane", "x", "width"), arrows


def swimlane_svg(steps: DataFrame, row: float = 56.0) -> DataFrame:
    """part, ord, line: a self-contained SVG of the swimlane's first steps, one element a row.

    Arrows within a lane or to the next one are straight, farther ones curved.
    """
    lanes, cells, arrows = swimlane(steps)
    labelled = cells.join(steps.select("step", "label"), "step")
    boxes = labelled.select(F.lit(3).alias("part"), F.col("step").cast("long").alias("ord"), F.format_string('<g><rect x="%.1f" y="%.1f" width="%.1f" height="32" rx="4"/><text x="%.1f" y="%.1f">%s</text></g>', "x", F.col("lane") * row, "width", F.col("x") + 8.0, F.col("lane") * row + 20.0, xml_escape(ellipsis_right(F.col("label"), 60))).alias("line"))
    y = cells.select(F.col("step").alias("k"), F.col("lane").alias("l"), (F.col("lane") * row + 16.0).alias("y"))
    ends = arrows.join(y.select(F.col("k").alias("parent"), F.col("l").alias("l1"), F.col("y").alias("y1")), "parent").join(y.select(F.col("k").alias("step"), F.col("l").alias("l2"), F.col("y").alias("y2")), "step")
    style, mid = F.when(F.col("cross_file"), "cross").otherwise("same"), (F.col("x1") + F.col("x2")) / 2
    straight = F.format_string('<path class="%s" d="M%.1f %.1f L%.1f %.1f"/>', style, "x1", "y1", "x2", "y2")
    curved = F.format_string('<path class="%s" d="M%.1f %.1f C%.1f %.1f %.1f %.1f %.1f %.1f"/>', style, "x1", "y1", mid, "y1", mid, "y2", "x2", "y2")
    paths = ends.select(F.lit(2).alias("part"), F.col("step").cast("long").alias("ord"), F.when(F.abs(F.col("l1") - F.col("l2")) > 1, curved).otherwise(straight).alias("line"))
    names = lanes.select(F.lit(1).alias("part"), F.col("lane").cast("long").alias("ord"), F.format_string('<text class="lane" x="0" y="%.1f">%s</text>', F.col("lane") * row - 4.0, xml_escape(F.col("file").cast("string"))).alias("line"))
    return _lines(steps.sparkSession, [(0, 0, '<svg xmlns="http://www.w3.org/2000/svg">'), (4, 0, "</svg>")]).unionByName(names).unionByName(paths).unionByName(boxes)


def grid(nodes: DataFrame, width: float, height: float) -> DataFrame:
    """id, x, y on a grid of about the given proportions, by node order."""
    n = nodes.count()
    cols = max(1, -(-int((n * width / height) ** 0.5 * 1_000_000) // 1_000_000))
    return numbered_nodes(nodes).select("id", (F.col("place") % cols).alias("x"), F.floor(F.col("place") / cols).alias("y"))


#: Buckets into which a pass of ranked_values cuts what is left of each range.
BUCKETS = 1024


def ranked_values(points: DataFrame, wanted: list[tuple[str, int]]) -> list:
    """The values at ranks (from 0) of the ordered values of columns that aren't null; wanted: (column, rank).

    A pass counts all ranges in equal buckets at once and keeps of each the one that holds its rank, from that bucket's
    least to its greatest value, until these are one: nothing is sorted, and a pass sends a few rows a task.
    """
    ends = points.agg(*[f(F.col(c).cast("double")).alias(f"{n}{k}") for k, (c, _) in enumerate(wanted) for f, n in ((F.min, "a"), (F.max, "b"))]).first()
    ranges = [[ends[f"a{k}"], ends[f"b{k}"], rank] for k, (_, rank) in enumerate(wanted)]
    while any(a is not None and a < b for a, b, _ in ranges):
        each = []
        for k, (c, _) in enumerate(wanted):
            a, b, _ = ranges[k]
            if a is not None and a < b:
                v = F.col(c).cast("double")
                place = F.least(F.floor((v - a) / (b - a) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
                each.append(F.when(v.between(a, b), F.struct(F.lit(k).alias("k"), place.alias("place"), v.alias("v"))))
        rows = points.select(F.explode(F.array(*each)).alias("x")).where("x is not null").groupBy("x.k", "x.place").agg(F.count("*").alias("n"), F.min("x.v").alias("a"), F.max("x.v").alias("b"))
        found: dict[int, list] = {}
        for r in rows.collect():  # BUCKETS rows a range
            found.setdefault(r.k, []).append((r.place, r.n, r.a, r.b))
        for k, buckets in found.items():
            left = ranges[k][2]
            for _, n, a, b in sorted(buckets):
                if left < n:
                    ranges[k] = [a, b, left]
                    break
                left -= n
    return [a for a, _, _ in ranges]


def trimmed_bounds(points: DataFrame, share: float = 0.02) -> DataFrame:
    """x0, x1, y0, y1 without the outer share of points on each axis, when there are ten or more. Nulls are no points."""
    counts = points.agg(F.count("x").alias("x"), F.count("y").alias("y")).first()
    cut = {c: int(share * counts[c]) if counts[c] >= 10 else 0 for c in ("x", "y")}
    values = ranked_values(points, [(c, r) for c in ("x", "y") for r in (cut[c], max(counts[c] - 1 - cut[c], 0))])
    return points.sparkSession.createDataFrame([tuple(values)], "x0 double, x1 double, y0 double, y1 double")


def _quoted(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def _lines(spark, fixed: list[tuple[int, int, str]]) -> DataFrame:
    return spark.createDataFrame(fixed, "part int, ord long, line string")


def to_dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """part, ord, line: the graph as DOT, one line a row; external nodes dashed, approximate edges dotted, quotes escaped.

    nodes: id, name, external, node_ord; edges: src, dst, kind, precision, edge_ord. The text is the lines in the
    order of (part, ord): `assembled` joins those of a bounded graph, larger ones are written sorted.
    """
    n = nodes.select(F.lit(1).alias("part"), F.col("node_ord").cast("long").alias("ord"), F.concat(F.lit('  "'), _quoted(F.col("id")), F.lit('" [label="'), _quoted(F.col("name")), F.lit('"'), F.when(F.col("external"), ", style=dashed").otherwise(""), F.lit("];")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.col("edge_ord").cast("long").alias("ord"), F.concat(F.lit('  "'), _quoted(F.col("src")), F.lit('" -> "'), _quoted(F.col("dst")), F.lit('" [label="'), F.col("kind"), F.lit('"'), F.when(F.col("precision") == "approx", ", style=dotted").otherwise(""), F.lit("];")).alias("line"))
    return _lines(nodes.sparkSession, [(0, 0, "digraph G {"), (0, 1, "  rankdir=LR;"), (3, 0, "}")]).unionByName(n).unionByName(e)


def numbered_nodes(nodes: DataFrame) -> DataFrame:
    """nodes with place, from 0, by node_ord: numbered within ranges of the order, whose sizes are summed first."""
    spread = nodes.repartitionByRange("node_ord").withColumn("range", F.spark_partition_id())
    spread = settle(spread, "ranges")
    sizes = spread.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = Window.partitionBy("range").orderBy("node_ord")
    return spread.join(F.broadcast(before), "range").withColumn("place", F.col("before") + F.row_number().over(own) - 1).drop("range", "before")  # one row a range


def to_mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """part, ord, line: the graph as Mermaid, nodes aliased n0, n1, ... by node order; marks in labels become _."""
    alias = settle(numbered_nodes(nodes).withColumn("k", F.concat(F.lit("n"), F.col("place").cast("string"))), "aliases")
    label = F.translate("name", MERMAID_MARKS, "_" * len(MERMAID_MARKS))
    n = alias.select(F.lit(1).alias("part"), F.col("node_ord").cast("long").alias("ord"), F.concat(F.lit("  "), "k", F.lit('["'), label, F.lit('"]')).alias("line"))
    e = edges.join(alias.select(F.col("id").alias("src"), F.col("k").alias("a")), "src").join(alias.select(F.col("id").alias("dst"), F.col("k").alias("b")), "dst")
    e = e.select(F.lit(2).alias("part"), F.col("edge_ord").cast("long").alias("ord"), F.concat(F.lit("  "), "a", F.lit(" -->|"), "kind", F.lit("| "), "b").alias("line"))
    return _lines(nodes.sparkSession, [(0, 0, "graph LR")]).unionByName(n).unionByName(e)


#: The keys of a node and of an edge in JSON, with their columns.
NODE_KEYS = {"id": "id", "kind": "kind", "name": "name", "file": "file", "line": "line", "column": "column", "module": "module", "detail": "detail", "precision": "precision", "external": "external", "declaration": "declaration", "bodyLines": "body_lines", "apiHeader": "api_header", "apiLine": "api_line", "inDegree": "in_degree", "outDegree": "out_degree"}
EDGE_KEYS = {"from": "src", "to": "dst", "kind": "kind", "precision": "precision", "file": "file", "line": "line"}


def _json(df: DataFrame, keys: dict[str, str] | None, order: str) -> Column:
    """A row as JSON; null columns are left out."""
    keys = {k: c for k, c in keys.items() if c in df.columns} if keys else {c: c for c in df.columns if c != order}
    return F.to_json(F.struct(*[F.col(c).alias(k) for k, c in keys.items()]))


def to_json(nodes: DataFrame, edges: DataFrame, *, named: bool = False) -> DataFrame:
    """part (1 nodes, 2 edges), ord, line: one JSON object a row, of all columns but the orders.

    named: with the keys of NODE_KEYS and EDGE_KEYS instead, as far as there are columns for them.
    """
    n = nodes.select(F.lit(1).alias("part"), F.col("node_ord").cast("long").alias("ord"), _json(nodes, NODE_KEYS if named else None, "node_ord").alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.col("edge_ord").cast("long").alias("ord"), _json(edges, EDGE_KEYS if named else None, "edge_ord").alias("line"))
    return n.unionByName(e)


def assembled(lines: DataFrame, most: int = 20_000) -> str:
    """The text of at most `most` lines; more raise an error: write them with write_lines instead."""
    rows = lines.orderBy("part", "ord").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} lines: write them with write_lines")
    return "\n".join(r.line for r in rows) + "\n"


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files whose names and lines follow the order of the lines."""
    lines.repartitionByRange("part", "ord").sortWithinPartitions("part", "ord").select("line").write.text(path)
