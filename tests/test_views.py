import json

from pyspark.sql import functions as F

from codeatlas.operators import graph, traverse, views


def test_bounds_and_grid(spark):
    points = spark.createDataFrame([(float(i * i), float(-i)) for i in range(100)], "x double, y double")
    assert tuple(views.trimmed_bounds(points).first()) == (4.0, 9409.0, -97.0, -2.0)
    assert tuple(views.trimmed_bounds(points.limit(3)).first()) == (0.0, 4.0, -2.0, 0.0)
    nodes = spark.createDataFrame([(f"n{i}", i) for i in range(10)], "id string, node_ord long")
    placed = {r.id: (r.x, r.y) for r in views.grid(nodes, 2.0, 1.0).collect()}
    assert placed["n0"] == (0, 0) and placed["n5"] == (0, 1) and len(set(placed.values())) == 10


def test_search_keeps_ancestors(spark):
    tree = spark.createDataFrame([("r", None, "root", ""), ("a", "r", "left", ""), ("b", "r", "right", ""), ("c", "b", "Deep", "x.c")], "id string, parent string, name string, file string")
    assert {r.id for r in views.search_tree(tree, "deep").collect()} == {"r", "b", "c"}
    assert views.search_tree(tree, "none").count() == 0
    assert [r.kind for r in views.kinds_present(spark.createDataFrame([("file",), ("class",)], "kind string"), ["function", "class", "file"]).orderBy("place").collect()] == ["class", "file"]


def test_severity(spark):
    lines = ["failed to open x", "Warning: x", "TERRORS", "[codeatlas] phase 2", "加载失败", "CANNOT", "all fine", "unable", "  "]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, s string").select("i", views.severity(F.col("s")).alias("v")).orderBy("i")
    assert [r.v for r in rows.collect()] == ["warn", "debug", "warn", "warn", "warn", "warn", "debug", "warn", None]


def test_route_as_tree_and_json(spark):
    steps = spark.createDataFrame([(1, 0, 0, "func:a", "a", False), (2, 1, 1, "func:b", "b", True), (3, 1, 1, "func:c", "c", False)], "step long, parent long, depth int, id string, name string, ambiguous boolean")
    others = spark.createDataFrame([(2, 1, "func:x::b"), (3, 1, "func:y::c")], "step long, rank long, id string")
    got = [(r.kind, r.parent, r.place, r.id, r.expandable, r.is_current) for r in views.route_tree(steps, others).orderBy("parent", "kind", "place").collect()]
    assert got == [("step", 0, 1, "func:a", True, False), ("step", 1, 1, "func:b", True, False), ("step", 1, 2, "func:c", False, False), ("candidate", 2, 0, "func:b", False, True), ("candidate", 2, 1, "func:x::b", False, False)]
    first = json.loads(views.route_json(steps).orderBy("ord").first().line)
    assert first == {"order": 1, "parent": 0, "depth": 0, "ambiguous": False, "id": "func:a", "name": "a"}


def test_text_exports(spark):
    nodes = spark.createDataFrame([("a", 'x"<1>', False, 5), ("b", "y\\", True, 9)], "id string, name string, external boolean, node_ord long")
    edges = spark.createDataFrame([("a", "b", "calls", "approx", 1)], "src string, dst string, kind string, precision string, edge_ord long")
    assert views.assembled(views.to_dot(nodes, edges)) == 'digraph G {\n  rankdir=LR;\n  "a" [label="x\\"<1>"];\n  "b" [label="y\\\\", style=dashed];\n  "a" -> "b" [label="calls", style=dotted];\n}\n'
    assert views.assembled(views.to_mermaid(nodes, edges)) == 'graph LR\n  n0["x__1_"]\n  n1["y_"]\n  n0 -->|calls| n1\n'
    lines = views.assembled(views.to_json(nodes, edges, named=True)).splitlines()
    assert json.loads(lines[0]) == {"id": "a", "name": 'x"<1>', "external": False} and json.loads(lines[2]) == {"from": "a", "to": "b", "kind": "calls", "precision": "approx"}
    points = nodes.select("id", "name", F.col("node_ord").cast("double").alias("x"), F.lit(1.0).alias("y"), "node_ord")
    svg = views.assembled(views.graph_svg(points, edges))
    assert svg.startswith("<svg") and "stroke-dasharray" in svg and "&lt;1&gt;" in svg and svg.endswith("</svg>\n")


def test_groups_and_stats(spark):
    nodes = spark.createDataFrame([("a", "target", "lib/x", False, "exact", 1), ("b", "file", "lib", False, "approx", 2), ("c", "file", ".", False, "approx", 3), ("e", "function", "", True, "approx", 4)], "id string, kind string, module string, external boolean, precision string, node_ord long")
    edges = spark.createDataFrame([("a", "b", "calls", 1), ("b", "c", "calls", 2), ("a", "c", "calls", 3), ("c", "e", "calls", 4)], "src string, dst string, kind string, ord long")
    groups, arcs = graph.cluster(nodes, edges)
    assert {tuple(r) for r in groups.collect()} == {("dir:lib/x", "target", 1, "1 nodes", "exact"), ("dir:lib", "file", 1, "1 nodes", "approx"), ("dir:.", "file", 1, "1 nodes", "approx"), ("e", "file", 1, "1 nodes", "approx")}
    assert {(r.src, r.dst, r.ord) for r in arcs.collect()} == {("dir:lib/x", "dir:lib", 1), ("dir:lib", "dir:.", 2), ("dir:lib/x", "dir:.", 3), ("dir:.", "e", 4)}
    rooted = nodes.withColumn("file", F.when(F.col("id") == "c", "main/a.c").when(F.col("id") == "a", "").otherwise("x.c")).withColumn("module", F.when(F.col("id") == "b", "lib").otherwise("."))
    assert {r.id: r.n_members for r in graph.cluster(rooted, edges)[0].collect()} == {"dir:main": 1, "dir:lib": 1, "dir:.": 1, "e": 1}
    assert graph.level_of_detail(nodes, edges)[0].count() == 4 and graph.level_of_detail(nodes, edges, True)[0].count() == 4
    row = graph.stats_row(nodes, edges).first()
    assert (row.file_count, row.symbol_count, row.edge_count, row.exact_nodes, row.precision) == (2, 1, 4, 1, "approx") and row.node_kind_counts == {"file": 2, "function": 1, "target": 1}


def test_a_long_depth_first_walk_asks_in_batches(spark, monkeypatch):
    monkeypatch.setattr(traverse, "BATCH", 3)
    edges = spark.createDataFrame([(0, k, "calls", k, k) for k in range(1, 9)] + [(k, k + 10, "calls", k, k) for k in range(1, 9)], "src long, dst long, kind string, line long, ord long")
    got = [r.node for r in traverse.route_depth_first(edges, 0, 2, 100).orderBy("step").collect()]
    assert got == [0] + [n for k in range(1, 9) for n in (k, k + 10)]


def test_bounds_are_the_values_at_exact_ranks(spark, monkeypatch):
    import random

    monkeypatch.setattr(views, "BUCKETS", 8)
    rng = random.Random(9)
    rows = [(rng.choice([0.0, 1.0, 1e9, -5.5]) if k % 2 else rng.gauss(0, 1), None if k % 10 == 0 else float(k)) for k in range(300)] + [(7.0, 1e300), (7.0, -1e300)]
    got = tuple(views.trimmed_bounds(spark.createDataFrame(rows, "x double, y double")).first())
    xs, ys = sorted(r[0] for r in rows), sorted(r[1] for r in rows if r[1] is not None)
    assert got == (xs[6], xs[-7], ys[5], ys[-6])
    few = spark.createDataFrame(rows[1:6], "x double, y double")
    assert tuple(views.trimmed_bounds(few).first()) == (min(r[0] for r in rows[1:6]), max(r[0] for r in rows[1:6]), 1.0, 5.0)
    assert tuple(views.trimmed_bounds(few.limit(0)).first()) == (None,) * 4
