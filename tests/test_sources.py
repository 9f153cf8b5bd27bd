import json

import pytest

from codeatlas import api
from codeatlas.operators import extract, views
from codeatlas.sources import build_script, source_tree
from codeatlas.streaming import incremental


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("some tree")
    files = {
        "src/a.cpp": '#include "deep/b.h"\nint main() {\n  go();\n  return 0;\n}\n', "inc dir/deep/b.h": "void go();\n", "src/go.cpp": "void go() {\n  int a;\n  int b;\n}\n", "src/notes.txt": "no", "node_modules/x.c": "int x;\n",
        "src/größe.cpp": "int wide;\n", "big.c": "/" * 5000, "old/CMakeCache.txt": "", "out/compile_commands.json": json.dumps([{"directory": str(root), "file": "src/a.cpp", "command": 'cc "-Iinc dir" -DX=1 -c src/a.cpp'}, {"directory": str(root), "file": "src/go.cpp", "arguments": ["cc", "-isystem", "sys", "-I", "inc dir"]}]),
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def test_listing(spark, tree):
    rows = {r.path: r for r in source_tree.list_files(spark, tree, max_bytes=4000).collect()}
    assert set(rows) == {"src/a.cpp", "inc dir/deep/b.h", "src/go.cpp", "src/größe.cpp", "big.c"}
    assert rows["big.c"].skipped and rows["big.c"].content is None and rows["src/a.cpp"].size == 55
    assert rows["inc dir/deep/b.h"].header and rows["src/a.cpp"].source and rows["src/a.cpp"].module == "src"
    assert [r.path for r in source_tree.list_files(spark, tree, max_files=2).collect()] == ["big.c", "inc dir/deep/b.h"]
    counts = {r.module: (r.n_files, r.n_lines) for r in source_tree.line_counts(source_tree.list_files(spark, tree)).collect()}
    assert counts["src"] == (3, 10) and counts["."] == (1, 1)


def test_a_walk_opens_no_excluded_folder_and_reads_no_large_file(spark, tmp_path):
    (tmp_path / "src" / "deep" / "er").mkdir(parents=True), (tmp_path / "src" / "deep" / "er" / "a.c").write_text("int a;\n"), (tmp_path / "src" / "empty.c").write_text("")
    with (tmp_path / "huge.c").open("wb") as f:
        f.truncate(3 << 30)  # 3 GiB that take no space
    (tmp_path / "node_modules" / "x").mkdir(parents=True), (tmp_path / "node_modules" / "x" / "b.c").write_text("int b;\n")
    (tmp_path / "link").symlink_to(tmp_path / "src"), (tmp_path / "src" / "odd name%20+.h").write_bytes(b"int \xff;")
    (tmp_path / "node_modules").chmod(0)  # opening it would fail for anyone but root, whose walk is seen by its rows alone
    try:
        rows = {r.path: r for r in source_tree.list_files(spark, str(tmp_path)).collect()}
        every = {r.path for r in source_tree.walk(spark, str(tmp_path), ["**/node_modules/**"]).collect()}
    finally:
        (tmp_path / "node_modules").chmod(0o755)
    assert set(rows) == every == {"src/deep/er/a.c", "src/empty.c", "huge.c", "src/odd name%20+.h"}
    assert (rows["huge.c"].size, rows["huge.c"].skipped, rows["huge.c"].content) == (3 << 30, True, None)
    assert (rows["src/empty.c"].content, rows["src/empty.c"].size) == ("", 0) and rows["src/empty.c"].mtime_ms > 0
    assert rows["src/odd name%20+.h"].content.startswith("int ") and rows["src/deep/er/a.c"].content == "int a;\n"
    assert {r.path for r in source_tree.walk(spark, f"file://{tmp_path}/src", []).collect()} == {"deep/er/a.c", "empty.c", "odd name%20+.h"}
    assert source_tree.list_files(spark, str(tmp_path / "none")).count() == 0


def test_compile_database(spark, tree):
    listed = source_tree.list_paths(spark, tree)
    assert source_tree.find_compile_db(listed).first().path == "out/compile_commands.json"
    assert [r.dir for r in source_tree.stale_builds(listed).collect()] == ["old"]
    assert source_tree.is_stale(listed, None, 1 << 60) and not source_tree.is_stale(listed, "out/compile_commands.json", 1 << 60) and source_tree.is_stale(listed, "out/compile_commands.json", 0)
    flags = source_tree.read_compile_db(spark, f"{tree}/out/compile_commands.json", tree)
    assert [r.value for r in source_tree.ordered_union(flags, "include").collect()] == ["inc dir"]
    assert [(r.file, r.value) for r in flags.where("flag = 'define'").collect()] == [("src/a.cpp", "X=1")]


def test_a_tree_becomes_a_graph(spark, tree):
    atlas = api.scan(spark, tree)
    got = {(e.src, e.dst, e.kind, e.precision) for e in atlas.edges.collect()}
    assert got == {("file:src/a.cpp", "file:inc dir/deep/b.h", "includes", "exact"), ("func:main", "func:go", "calls", "approx")}
    assert [r.id for r in atlas.route().orderBy("step").collect()] == ["func:main", "func:go"]
    assert [r.id for r in atlas.dependents("inc dir/deep/b.h").collect()] == ["file:src/a.cpp"]
    assert views.assembled(atlas.export("mermaid", "func:main", 1)).startswith("graph LR\n")
    row = atlas.stats().first()
    assert (row.file_count, row.compile_commands_found, row.compile_commands_path, row.compile_command_entries, row.skipped_files, row.warnings) == (5, True, "out/compile_commands.json", 2, 0, [])
    assert atlas.node_at("src/a.cpp", 4).first().id == "func:main" and atlas.node_at("src/a.cpp", 1).first().id == "file:src/a.cpp"
    nodes, edges, _ = atlas.symbol_graph("src/a.cpp", 3, 1, "downstream")
    assert {r.id for r in nodes.collect()} == {"func:main", "func:go"} and edges.count() == 1
    assert atlas.symbol_graph("none.c", 1)[0].count() == 0
    nodes, edges = atlas.expanded(nodes, edges, "func:go")
    assert {r.id for r in nodes.collect()} >= {"func:main", "func:go", "file:src/go.cpp"}


def test_compile_databases_are_looked_for_in_order(spark):
    find = lambda *paths: (source_tree.find_compile_db(spark.createDataFrame([(p,) for p in paths], "path string")).first() or [None])[0]
    db = "compile_commands.json"
    assert find(f"build/Debug/{db}", f"build/Release/{db}") == f"build/Release/{db}"
    assert find(f"build/debug/{db}", f"build/Debug/{db}", f"a/{db}") == f"build/Debug/{db}"
    assert find(f"build/Debug/{db}", f"cmake-build-release/{db}", f"out/{db}") == f"out/{db}"
    assert find(f"z/y/x/w/{db}") == f"z/y/x/w/{db}" and find(f"z/y/x/w/v/{db}") is None and find(f"_deps/{db}") is None


def test_routes_skip_trivial_steps_follow_overrides_and_keep_files_first_steps(spark, tmp_path):
    long = "  a;\n  b;\n  c;\n  d;\n"
    files = {
        "CMakeLists.txt": "add_executable(app a.cpp)\ntarget_link_libraries(app m)\n",
        "a.cpp": f"int main() {{\n{long}  get();\n  work();\n  tiny();\n}}\nint get() {{\n  return deep();\n}}\n", "b.cpp": f"int deep() {{\n{long}  more();\n}}\nint more() {{\n{long}}}\nint work() {{\n{long}}}\n",
        "c.cpp": "int tiny() {\n  far();\n  away();\n}\nint far() { return 1; }\nint away() { return 2; }\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    atlas = api.scan(spark, str(tmp_path))
    assert {(e.src, e.dst) for e in atlas.edges.where("kind = 'links'").collect()} == {("target:app", "file:a.cpp"), ("target:app", "ext:target:m")}
    rows = lambda **o: [(r.step, r.parent, r.id.split(":")[1], r.skipped) for r in atlas.route("func:main", **o).orderBy("step").collect()]
    assert [r[:3] for r in rows()] == [(1, 0, "main"), (2, 1, "get"), (3, 1, "work"), (4, 1, "tiny"), (5, 2, "deep"), (6, 4, "far"), (7, 4, "away"), (8, 5, "more")]
    # get leads to deep alone; far and away are short; tiny is not short
    assert rows(skip_trivial=True) == [(1, 0, "main", ["get"]), (2, 1, "work", []), (3, 1, "tiny", ["far", "away"]), (4, 1, "deep", []), (5, 4, "more", [])]
    assert [r[:3] for r in rows(by_file=True)] == [(1, 0, "main"), (2, 1, "work"), (3, 1, "tiny")]
    picks = spark.createDataFrame([("func:main", "get", "func:more")], "src string, name string, pick string")
    assert [r[2] for r in rows(overrides=picks, max_depth=1)] == ["main", "more", "work", "tiny"]
    assert api.scan(spark, str(tmp_path), kinds=extract.Kinds(links=False)).edges.where("kind = 'links'").count() == 0


def test_build_scripts(spark):
    text = 'add_library(core STATIC a.c "b c.c")\nadd_executable(app main.c ${MORE})\ntarget_link_libraries(app PRIVATE core m core $<X>)\nlink_libraries(app z)\nfind_package(Zed REQUIRED)\n# add_library(no x.c)\n'
    rows = build_script.parse(text)
    assert [r[:3] for r in rows] == [
        ("core", "kind", "library"), ("core", "source", "a.c"), ("core", "source", "b c.c"), ("app", "kind", "executable"), ("app", "source", "main.c"),
        ("app", "link", "core"), ("app", "link", "m"), ("app", "link", "z"), ("", "package", "Zed"),
    ]
    files = spark.createDataFrame([("x/CMakeLists.txt", text), ("a.txt", text), ("y/CMakeLists.txt", None)], "path string, content string")
    assert build_script.targets(files).count() == len(rows)


def test_snapshots(spark):
    old = spark.createDataFrame([("a", 1, 10, "f1"), ("b", 2, 20, "f1"), ("c", 3, 30, "f0")], "file string, mtime_ms long, size long, fingerprint string")
    now = spark.createDataFrame([("a", 1, 10), ("b", 2, 21), ("d", 1, 1)], "file string, mtime_ms long, size long")
    assert [r.file for r in incremental.reusable(old, now, "f1").collect()] == ["a"]
    got = {r.id: r.change for r in incremental.changes(old.withColumnRenamed("file", "id"), now.withColumnRenamed("file", "id"), ["mtime_ms", "size"]).collect()}
    assert got == {"b": "changed", "c": "removed", "d": "added"}


def test_a_stream_keeps_the_latest_files(spark, tmp_path):
    schema = "file string, ts timestamp, content string"
    source, seen = str(tmp_path / "in"), []
    spark.createDataFrame([("a", "2024-01-01 00:00:00", "one"), ("b", "2024-01-01 00:00:01", "two")], "file string, ts string, content string").selectExpr("file", "cast(ts as timestamp) as ts", "content").write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    run = lambda: incremental.follow(stream, str(tmp_path / "state"), lambda df: seen.append({r.file: r.content for r in df.collect()}), str(tmp_path / "check"))
    query = run()
    query.processAllAvailable()
    spark.createDataFrame([("a", "2024-01-02 00:00:00", "new"), ("b", "2024-01-02 00:00:00", None)], "file string, ts string, content string").selectExpr("file", "cast(ts as timestamp) as ts", "content").write.mode("append").parquet(source)
    query.processAllAvailable()
    query.stop()
    assert seen[0] == {"a": "one", "b": "two"} and seen[-1] == {"a": "new"}
