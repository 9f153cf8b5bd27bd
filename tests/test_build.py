import pytest

from codeatlas.operators import build, extract, traverse
from codeatlas.operators.graph import name_index, resolve_references
from codeatlas.sources import build_script

FILES = [
    ("app/start.cpp", '#include "tool.h"\n#include <missing.h>\n#define SIZE 3\nint main() {\n  helper(SIZE);\n  crowd();\n  gone();\n  return 0;\n}\n'),
    ("app/tool.h", "class Tool : public Base {\n  Part part_;\n};\nint helper(int n);\n"),
    ("lib/tool.cpp", '#include "tool.h"\nint helper(int n) {\n  return n;\n}\n'),
    *[(f"lib/c{k}.cpp", f"void crowd() {{\n  int n{k};\n}}\n") for k in range(4)],
    ("lib/base.h", "class Base {\n  int n;\n};\nclass Part {\n};\n"),
]


@pytest.fixture(scope="module")
def graph(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    symbols, refs, includes = extract.extract(files)
    return [df.cache() for df in (symbols, *build.build(files, symbols, refs, includes, include_external=True))]


def test_edges(graph):
    _, _, edges, _ = graph
    got = {(e.src, e.dst, e.kind, e.precision) for e in edges.collect()}
    assert got == {
        ("file:app/start.cpp", "file:app/tool.h", "includes", "exact"), ("file:lib/tool.cpp", "file:app/tool.h", "includes", "approx"), ("file:app/start.cpp", "ext:file:missing.h", "includes", "approx"),
        ("func:main", "func:helper", "calls", "approx"), ("func:main", "ext:function:crowd", "calls", "approx"), ("func:main", "ext:function:gone", "calls", "approx"),
        ("class:Tool", "class:Base", "inherits", "approx"), ("class:Tool", "class:Part", "uses", "approx"), ("file:app/start.cpp", "macro:SIZE", "refs", "approx"),
    }


def test_nodes_and_counts(graph):
    _, nodes, _, counts = graph
    by = {n.id: n for n in nodes.collect()}
    assert by["func:helper"].file == "lib/tool.cpp" and not by["func:helper"].declaration and by["func:helper"].body_lines == 3
    assert by["ext:function:gone"].module == "<external>" and by["ext:function:gone"].external
    assert (by["func:main"].out_degree, by["func:helper"].in_degree) == (3, 1)
    assert tuple(counts.first()) == (1, 1, 1)


def test_file_edges_and_subgraph(graph, spark):
    symbols, nodes, edges, _ = graph
    e = edges.withColumnRenamed("edge_ord", "ord").select("src", "dst", "kind", "line", "ord")
    held = build.containment(symbols).selectExpr("file", "symbol", "struct(0 as stage, file as file, ord as n, 0L as place) as ord")
    visited, cut = traverse.subgraph(e, "file:app/start.cpp", 2, "downstream", 100, held)
    names = {r.node for r in visited.collect()}
    assert {"file:app/tool.h", "func:main", "macro:SIZE", "class:Tool", "func:helper"} <= names and "file:lib/tool.cpp" not in names and not cut
    assert [r.id for r in build.neighbours(edges, nodes, "func:main", "downstream").collect()] == ["func:helper", "ext:function:crowd", "ext:function:gone"]
    # around: containment, and edges among the neighbours, whose other end is their source
    near = [r.id for r in build.neighbours(edges, nodes, "func:main", "both", held=build.contained(symbols)).collect()]
    assert set(near) == {"func:helper", "ext:function:crowd", "ext:function:gone"}
    of_file = {r.id for r in build.neighbours(edges, nodes, "file:app/tool.h", "both", held=build.contained(symbols)).collect()}
    assert {"file:app/start.cpp", "file:lib/tool.cpp", "class:Tool"} >= of_file >= {"file:app/start.cpp", "file:lib/tool.cpp"}
    assert build.neighbours(edges, nodes, "func:main", "downstream", most=1).count() == 1
    assert {n.name for n in nodes.where("kind = 'file' and not external").collect()} == {path for path, _ in FILES}
    assert {r.id for r in build.highlighted(edges, "class:Tool").collect()} == {"class:Tool", "class:Base", "class:Part"}


def test_same_file_comes_first(spark):
    symbols = spark.createDataFrame([("func:a::f", "function", "a::f", "f", "a.c", 1), ("func:b::f", "function", "b::f", "f", "b.c", 1)], "id string, kind string, qualified string, name string, file string, sym_ord long")
    refs = spark.createDataFrame([("func:x", "f", "calls", "b.c", 4, 0)], "from_id string, name string, kind string, file string, line int, ref_ord long")
    hits = build.reference_edges(build.reference_hits(refs, symbols), symbols.selectExpr("id", "'approx' as precision")).orderBy("ord").collect()
    assert [h.dst for h in hits] == ["func:b::f", "func:a::f"]


def test_enclosing_function(spark):
    symbols = spark.createDataFrame([("func:f", "function", "a", 3, 0), ("class:C", "class", "a", 5, 1), ("var:v", "variable", "b", 2, 2)], "id string, kind string, file string, line int, node_ord long")
    points = spark.createDataFrame([(1, "a", 9), (2, "a", 4), (3, "a", 1), (4, "b", 2), (5, "c", 1)], "point_id long, file string, line int")
    got = {r.point_id: r.id for r in build.enclosing_function(points, symbols).collect()}
    assert got == {1: "func:f", 2: "func:f", 3: "file:a", 4: "var:v", 5: "file:c"}


def test_labels(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(build.start_label(F.lit("ext:function:go")).alias("a"), build.id_payload(F.lit("file:x/y.h")).alias("b"), build.display_name(F.lit("func:n::go")).alias("c"), build.edge_key(F.lit("a"), F.lit("b"), F.lit("calls")).alias("d")).first()
    assert tuple(row) == ("go", "x/y.h", "go", "a|b|calls")


def test_a_name_that_many_share_is_looked_up_once(spark):
    n = 3000
    known = spark.range(n).selectExpr("id as occ_id", "'function' as kind", "concat('ns', id, '::get') as qualified", "'get' as simple")
    refs = spark.range(n).selectExpr("id as ref_id", "concat('other', id, '::get') as name").unionByName(spark.createDataFrame([(n, "ns7::get"), (n + 1, "none")], "ref_id long, name string"))
    got = {r.ref_id: r for r in resolve_references(refs, known, ["function"]).collect()}
    assert len(got) == n + 2 and all(got[i].n_hits == n and got[i].hits is None and got[i].tier == 1 for i in range(n))
    assert (got[n].n_hits, got[n].hits, got[n].tier) == (1, [7], 0) and got[n + 1].n_hits == 0
    index = {(r.key, r.how): (r.n, r.first) for r in name_index(known, 3).where("key = 'get' or key = 'ns5::get'").collect()}
    assert index == {("get", 1): (n, [0, 1, 2]), ("ns5::get", 0): (1, [5])}


def test_hot_keys_are_dealt_alike(spark, monkeypatch):
    from codeatlas.functions import tables

    rows = spark.range(500).selectExpr("id", "case when id % 3 = 0 then 'hot' when id = 1 then null else concat('k', id % 50) end as k", "id as x")
    keyed = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("away", 4)], "k string, v int")
    want = {how: sorted(map(tuple, rows.join(keyed, ["k"], how).collect()), key=str) for how in ("inner", "left", "left_semi", "left_anti")}
    monkeypatch.setattr(tables, "is_small", lambda df: False)
    for hot in (100, 1000):
        monkeypatch.setattr(tables, "HOT_ROWS", hot)
        for how, rows_ in want.items():
            assert sorted(map(tuple, tables.dealt(rows, keyed, ["k"], how).collect()), key=str) == rows_


SCRIPTS = [
    ("CMakeLists.txt", "add_library(core STATIC lib/tool.cpp lib/base.h)\nfind_package(Zed)\ntarget_link_libraries(core PRIVATE zlib core zlib)\ntarget_link_libraries(app core)\n"),
    ("app/CMakeLists.txt", "add_executable(app start.cpp ../lib/c0.cpp ${MORE})\ntarget_link_libraries(app PUBLIC core m)\n"),
]


def test_targets_and_links(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    rows = build_script.targets(spark.createDataFrame(SCRIPTS, "path string, content string"))
    nodes, edges, counts = build.build(files, *extract.extract(files), scripts=rows)
    links = {(e.src, e.dst, e.precision, e.file, e.line) for e in edges.where("kind = 'links'").collect()}
    assert links == {
        ("target:core", "file:lib/tool.cpp", "exact", "CMakeLists.txt", 1), ("target:core", "file:lib/base.h", "exact", "CMakeLists.txt", 1), ("target:core", "ext:target:zlib", "exact", "CMakeLists.txt", 1),
        ("target:app", "file:app/start.cpp", "exact", "app/CMakeLists.txt", 1), ("target:app", "file:lib/c0.cpp", "exact", "app/CMakeLists.txt", 1), ("target:app", "target:core", "exact", "app/CMakeLists.txt", 1), ("target:app", "ext:target:m", "exact", "app/CMakeLists.txt", 1),
    }
    by = {n.id: n for n in nodes.collect()}
    assert (by["target:app"].detail, by["target:app"].module, by["target:core"].module, by["target:core"].precision) == ("executable, 2 sources", "app", ".", "exact")
    assert by["ext:target:zlib"].external and by["ext:target:zlib"].module == "<external>" and "ext:function:gone" not in by
    assert by["target:core"].in_degree == 1 and by["file:lib/base.h"].in_degree == 1
