"""Bounded traversals, a level at a time, in the exact order of a queue.

The queue is a column: every visited node has a position, and a level's nodes take theirs from the position of
the node that found them and the order in which it looks at its neighbours. Levels are written to the shared
folder. Positions are numbered by sums over the frontier, never by sorting a level in one task, and a node of very many
neighbours is dealt over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.functions.tables import LOOKUP_BYTES, LOOKUP_ROWS, dealt, drop_table, running_before, settle, sided, width


def adjacency(edges: DataFrame, direction: str = "both", contains: DataFrame | None = None) -> DataFrame:
    """node, next, rank: containment first, then edges out, then edges in, each by edge order.

    contains (file, symbol): a file leads to its symbols in any direction, a symbol to its file unless downstream.
    """
    parts = []
    if contains is not None:
        parts.append(contains.select(F.col("file").alias("node"), F.col("symbol").alias("next"), F.struct(F.lit(0).alias("g"), F.col("ord").alias("o")).alias("rank")))
        if direction in ("both", "upstream"):
            parts.append(contains.select(F.col("symbol").alias("node"), F.col("file").alias("next"), F.struct(F.lit(0).alias("g"), F.col("ord").alias("o")).alias("rank")))
    if direction in ("both", "downstream"):
        parts.append(edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.struct(F.lit(1).alias("g"), F.col("ord").alias("o")).alias("rank")))
    if direction in ("both", "upstream"):
        parts.append(edges.select(F.col("dst").alias("node"), F.col("src").alias("next"), F.struct(F.lit(2).alias("g"), F.col("ord").alias("o")).alias("rank")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def next_level(frontier: DataFrame, adj: DataFrame, visited: DataFrame, small: bool) -> DataFrame:
    """next, pos (of the finder), rank, node (the finder): each new node by its first finder.

    small: whether frontier and visited are proven small, and can be sent to every task; else hubs are dealt.
    """
    met = adj.join(F.broadcast(frontier), "node") if small else dealt(adj, frontier, ["node"])
    first = met.select("next", F.struct("pos", "rank", "node").alias("by")).groupBy("next").agg(F.min("by").alias("by"))
    seen = visited.select(F.col("node").alias("next"))
    fresh = first.join(F.broadcast(seen) if small else seen, "next", "left_anti")
    return fresh.select("next", "by.pos", "by.rank", "by.node")


def numbered(found: DataFrame, base: int, small: bool) -> DataFrame:
    """found with its place in the queue from base + 1, and before, how many rows earlier finders have.

    Each finder's rows are ordered in their own window; of a finder one number is summed in order.
    """
    sums = running_before(found.groupBy("pos").agg(F.count("*").alias("n")), "pos", "n", "before", small).select("pos", "before")
    own = Window.partitionBy("pos").orderBy("rank", "next")
    met = found.join(F.broadcast(sums), "pos") if small else found.join(sums, "pos")
    return met.withColumn("place", F.lit(base) + F.col("before") + F.row_number().over(own))


class Queue:
    """What a walk has visited (node, pos, depth, parent), level by level, and how much that is."""

    def __init__(self, edges: DataFrame, start, first: int) -> None:
        kind = edges.schema["src"].dataType.simpleString()
        self.visited = self.frontier = edges.sparkSession.createDataFrame([(start, first, 0, 0)], f"node {kind}, pos long, depth int, parent long")
        self.n, self.bytes = 1, 64

    def level(self, adj: DataFrame, depth: int, base: int, most: int, whole: bool) -> bool:
        """Visits what the last level finds, in the queue's order; whether that is anything.

        At most `most` nodes are visited; whole: a finder that comes while there are fewer adds all it finds.
        """
        small = self.n <= LOOKUP_ROWS and self.bytes <= LOOKUP_BYTES
        found = settle(next_level(self.frontier.select("node", "pos"), adj, self.visited, small), "found")
        placed = numbered(found, base, small)
        kept = placed.where(F.lit(self.n) + F.col("before") < most if whole else F.col("place") - base + self.n <= most)
        rows = settle(kept.select(F.col("next").alias("node"), F.col("place").cast("long").alias("pos"), F.lit(depth).alias("depth"), F.col("pos").alias("parent")))
        n, size = rows.agg(F.count("*"), F.coalesce(F.sum(width(rows)), F.lit(0))).first()
        drop_table(found)
        if n:
            self.visited, self.frontier = self.visited.unionByName(rows), rows
            self.n, self.bytes = self.n + n, self.bytes + size
        return n > 0


def subgraph(edges: DataFrame, focus, depth: int = 2, direction: str = "both", max_nodes: int = 800, contains: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """node, pos, depth of the nodes a queue visits from focus, and whether max_nodes cut it.

    A node is looked at only while fewer than max_nodes are visited, and then adds all its neighbours.
    """
    adj = adjacency(edges, direction, contains)
    queue = Queue(edges, focus, 0)
    for level in range(1, depth + 1):
        if queue.n >= max_nodes or not queue.level(adj, level, queue.n - 1, max_nodes, True):
            break
    return queue.visited.select("node", "pos", "depth"), queue.n >= max_nodes


def induced(edges: DataFrame, visited: DataFrame) -> DataFrame:
    """The edges whose ends are both visited."""
    ids = sided(visited.select(F.col("node")))
    return edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")


def children_of(edges: DataFrame) -> DataFrame:
    """node, next, rank: call sites in reading order, by line, then name, then id."""
    name = F.col("name") if "name" in edges.columns else F.col("dst").cast("string")
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.struct(F.col("line").alias("l"), name.alias("n"), F.col("dst").alias("d")).alias("rank"))


def route(edges: DataFrame, start, max_depth: int = 6, max_steps: int = 200) -> DataFrame:
    """step, parent, depth, node: a reading route in breadth, steps numbered from 1, the start's parent 0."""
    max_depth, max_steps = min(max(max_depth, 0), 64), min(max(max_steps, 1), 100_000)
    adj = children_of(edges)
    queue = Queue(edges, start, 1)
    for level in range(1, max_depth + 1):
        if queue.n >= max_steps or not queue.level(adj, level, queue.n, max_steps, False):
            break
    return queue.visited.select(F.col("pos").alias("step"), "parent", "depth", "node")


#: Nodes whose children a depth-first walk asks for at once.
BATCH = 256


def route_depth_first(edges: DataFrame, start, max_depth: int = 6, max_steps: int = 200) -> DataFrame:
    """The route in depth: a node is claimed when its turn comes, and not again even if it came at the limit.

    The order is sequential by nature, so the driver keeps the stack, and Spark is asked for the children of the
    BATCH nodes next on it. A walk claims at most max_steps nodes, so of each node no more than its first max_steps
    children are ever read; the graph itself is never gathered.
    """
    max_depth, max_steps = min(max(max_depth, 0), 64), min(max(max_steps, 1), 100_000)
    spark, kind = edges.sparkSession, edges.schema["src"].dataType.simpleString()
    adj = settle(children_of(edges).where("node <> next"), "children")
    own = Window.partitionBy("node").orderBy("rank")
    known: dict = {}

    def fetch(nodes: list) -> None:
        asked = F.broadcast(spark.createDataFrame([(n,) for n in nodes], f"node {kind}"))  # BATCH rows
        rows = adj.join(asked, "node", "left_semi").withColumn("r", F.row_number().over(own)).where(F.col("r") <= max_steps)
        known.update((n, []) for n in nodes)
        for row in rows.orderBy("node", "r").select("node", "next").toLocalIterator():
            known[row["node"]].append(row["next"])

    stack, seen, out = [(start, 0, 0)], set(), []
    while stack and len(out) < max_steps:
        node, parent, depth = stack.pop()
        if node in seen:
            continue
        seen.add(node)
        out.append((len(out) + 1, parent, depth, node))
        if depth < max_depth:
            if node not in known:
                ahead = dict.fromkeys(n for n, _, d in reversed(stack[-4 * BATCH :]) if d < max_depth and n not in known and n not in seen)
                fetch([node, *list(ahead)[: BATCH - 1]])
            stack += [(k, len(out), depth + 1) for k in reversed(known[node])]
    return spark.createDataFrame(out, f"step long, parent long, depth int, node {kind}")


def fold(steps: DataFrame, dropped: DataFrame, keep_names: bool = True) -> DataFrame:
    """steps without the dropped ones, re-parented to the nearest kept ancestor and renumbered.

    dropped (step, name); skipped lists, by reading order, the names dropped below each kept step. Ancestors are
    found by pointer jumping: each round doubles the distance, so depth 64 takes six.
    """
    marked = steps.join(sided(dropped.select("step", F.col("name").alias("gone"))), "step", "left")
    up = settle(marked.select("step", F.col("parent").alias("anchor"), F.col("gone").isNotNull().alias("drop")), "anchors")
    for _ in range(7):
        over = sided(up.select(F.col("step").alias("anchor"), F.col("anchor").alias("above"), F.col("drop").alias("via")))
        up = settle(up.join(over, "anchor", "left").select("step", F.when(F.coalesce("via", F.lit(False)), F.col("above")).otherwise(F.col("anchor")).alias("anchor"), "drop"), "anchors")
    joined = marked.join(up.drop("drop"), "step")
    lists = joined.where(F.col("gone").isNotNull()).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("step", "gone"))).alias("s")).select(F.col("anchor").alias("step"), F.transform("s", lambda x: x["gone"]).alias("skipped"))
    kept = joined.where(F.col("gone").isNull())
    kept = kept.join(lists, "step", "left") if keep_names else kept
    order = kept.select("step").withColumn("new", F.row_number().over(Window.orderBy("step")).cast("long"))  # max_steps rows at most
    above = order.select(F.col("step").alias("anchor"), F.col("new").alias("new_parent"))
    out = kept.join(order, "step").join(above, "anchor", "left")
    rest = [c for c in steps.columns if c not in ("step", "parent")]
    names = [F.coalesce("skipped", F.array().cast("array<string>")).alias("skipped")] if keep_names else []
    return out.select(F.col("new").alias("step"), F.coalesce("new_parent", F.lit(0)).cast("long").alias("parent"), *rest, *names)


def trivial_steps(steps: DataFrame, edges: DataFrame, most_lines: int = 3) -> DataFrame:
    """step, name of the steps to skip: not the start, with a body of 1 to most_lines lines, and one edge out at most.

    steps: step, parent, id, name, body_lines; edges: src, dst of the allowed kinds, to nodes outside too.
    """
    out = edges.join(sided(settle(steps.select(F.col("id").alias("src")).distinct(), "ids")), "src", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
    met = steps.where((F.col("parent") != 0) & F.col("body_lines").between(1, most_lines)).join(out, "id", "left")
    return met.where(F.coalesce("n_out", F.lit(0)) <= 1).select("step", "name")


def with_new_file(steps: DataFrame) -> DataFrame:
    """steps (step, file) with new_file: whether this is the first step in its file."""
    first = steps.groupBy("file").agg(F.min("step").alias("first"))
    return steps.join(first, "file").withColumn("new_file", F.col("step") == F.col("first")).drop("first")


def frontier(steps: DataFrame, edges: DataFrame, file_of: DataFrame) -> DataFrame:
    """One row: the distinct children no step reached, and their files. file_of: node, file."""
    seen = sided(settle(steps.select("node"), "seen"))
    kids = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).join(seen, "node", "left_semi").select(F.col("next").alias("node")).distinct()
    left = kids.join(seen, "node", "left_anti").join(file_of, "node", "left")
    return left.agg(F.count("*").alias("frontier_nodes"), F.countDistinct("file").alias("frontier_files"))


def overridden(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """edges with children of (src, name) replaced by the chosen id; children that become equal collapse to one.

    edges: src, dst, name, line; chosen: src, name, pick.
    """
    swapped = edges.join(sided(chosen), ["src", "name"], "left").withColumn("dst", F.coalesce("pick", "dst")).drop("pick")
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    first = swapped.groupBy("src", "dst").agg(F.min(F.struct("line", *[c for c in rest if c != "line"])).alias("e"))
    return first.select("src", "dst", *[F.col(f"e.{c}").alias(c) for c in rest])
