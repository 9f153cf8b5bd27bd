"""A live graph against full builds, bucket by bucket."""

import pytest
from pyspark.sql import functions as F

from codeatlas.operators import build, extract
from codeatlas.streaming import live

FILES = {
    "app/main.cpp": '#include "tool.h"\nint main() {\n  helper(SIZE);\n  gone();\n  return 0;\n}\n', "lib/tool.h": "int helper(int n);\nclass Base {\n  int n;\n};\n", "lib/tool.cpp": '#include "tool.h"\nint helper(int n) {\n  return n;\n}\n',
    "lib/more.cpp": "class More : public Base {\n  Part part_;\n};\nvoid other() {\n  helper(2);\n}\n", "lib/none.cpp": "int alone;\n",
}


def batch(spark, day, **files):
    rows = [(name.replace("__", "/").replace("_dot_", "."), f"2024-01-{day:02} 00:00:00", text) for name, text in files.items()]
    return spark.createDataFrame(rows, "file string, ts string, content string").withColumn("ts", F.col("ts").cast("timestamp"))


def full(spark, files, search=()):
    df = spark.createDataFrame(sorted(files.items()), "path string, content string")
    return build.build(df, *extract.extract(df), include_external=True, search=list(search))


def same(got, want):
    for a, b in zip(got, want, strict=True):
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(b.columns)).collect()))


def test_batches_touch_their_buckets_and_equal_a_full_build(spark, tmp_path):
    graph = live.LiveGraph(spark, str(tmp_path / "live"), buckets=64)
    first = spark.createDataFrame([(f, "2024-01-01 00:00:00", t) for f, t in FILES.items()], "file string, ts string, content string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert len(graph.update(first)["facts"]) > 1
    same(graph.graph(True), full(spark, FILES))
    # helper gains a parameter's name alone: its own file is all that changes
    now = FILES | {"lib/tool.cpp": '#include "tool.h"\nint helper(int many) {\n  return many;\n}\n'}
    change = batch(spark, 2, lib__tool_dot_cpp=now["lib/tool.cpp"])
    done = graph.update(change)
    assert len(done["facts"]) == len(done["edges"]) == 1
    assert graph.update(change) == {"facts": [], "edges": []} and graph.update(batch(spark, 1, lib__tool_dot_cpp="int late;\n")) == {"facts": [], "edges": []}
    same(graph.graph(True), full(spark, now))
    # a new definition, a new header of another name's end, and a file that goes
    now |= {"lib/none.cpp": "void gone() {\n}\n"}
    del now["lib/tool.h"]
    done = graph.update(batch(spark, 3, lib__none_dot_cpp=now["lib/none.cpp"], lib__tool_dot_h=None))
    assert len(done["facts"]) == 2 and len(done["edges"]) > 2
    same(graph.graph(True), full(spark, now))
    # other include paths are another generation
    now |= {"inc/tool.h": "int helper(int n);\n"}
    graph.update(batch(spark, 4, inc__tool_dot_h=now["inc/tool.h"]))
    assert graph.generation() == (0, []) and graph.rescan(["inc"]) == 1 and graph.generation() == (1, ["inc"]) and graph.rescan(["inc"]) == 1
    same(graph.graph(True), full(spark, now, ["inc"]))
    assert graph._names("edges-") == ["edges-1"] and graph._names("pending-") == []


def test_a_batch_that_failed_half_way_is_finished(spark, tmp_path, monkeypatch):
    graph = live.LiveGraph(spark, str(tmp_path / "live"), buckets=8)
    graph.update(batch(spark, 1, a_dot_c="void one() {\n  two();\n}\n"))
    relink = live.LiveGraph._relink

    def fail(*_):
        raise OSError("lost")

    change = batch(spark, 2, b_dot_c="void two() {\n}\n")
    monkeypatch.setattr(live.LiveGraph, "_relink", fail)
    with pytest.raises(OSError):
        graph.update(change)
    monkeypatch.setattr(live.LiveGraph, "_relink", relink)
    assert graph.update(change)["edges"]
    same(graph.graph(True), full(spark, {"a.c": "void one() {\n  two();\n}\n", "b.c": "void two() {\n}\n"}))


def test_streams_of_files_and_databases(spark, tmp_path):
    graph = live.LiveGraph(spark, str(tmp_path / "live"), buckets=4)
    files, dbs = str(tmp_path / "files"), str(tmp_path / "dbs")
    batch(spark, 1, a_dot_c='#include "x.h"\n', inc__x_dot_h="int x;\n", other__x_dot_h="int x;\n").write.parquet(files)
    query = live.follow_files(spark.readStream.schema("file string, ts timestamp, content string").parquet(files), graph, str(tmp_path / "c1"))
    query.processAllAvailable(), query.stop()
    path = lambda: [e.dst for e in graph.graph()[1].where("kind = 'includes'").collect()]
    assert path() == ["file:inc/x.h"]
    for k, (ts, where) in enumerate([("2024-01-01 00:00:00", "none"), ("2024-01-01 00:00:00.5", "other"), ("2024-01-01 00:01:00", "late")]):
        spark.createDataFrame([("db", ts, [where])], "path string, ts string, search array<string>").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{dbs}/{k}")
    stream = spark.readStream.schema("path string, ts timestamp, search array<string>").option("recursiveFileLookup", True).parquet(dbs)
    query = live.follow_database(stream, graph, str(tmp_path / "c2"))
    query.processAllAvailable(), query.stop()
    # the first two are one change, and the last is not quiet yet
    assert graph.generation() == (1, ["other"]) and path() == ["file:other/x.h"]
