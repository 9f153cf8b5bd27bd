"""Graphs derived from the star-schema tables, on which the registered queries run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeatlas.functions.tables import table


def lead_in_order(rows: DataFrame, order: list[str], bucket: Column, value: str) -> DataFrame:
    """rows with `next`: the value of the following row in the global order.

    Each bucket is ordered in its own window; only the first value of every bucket takes part in a global one.
    """
    rows = rows.withColumn("_b", bucket)
    inside = rows.withColumn("next", F.lead(value).over(Window.partitionBy("_b").orderBy(*order)))
    firsts = rows.groupBy("_b").agg(F.min_by(value, F.struct(*order)).alias("f"))
    after = firsts.select("_b", F.lead("f").over(Window.orderBy("_b")).alias("after"))
    return inside.join(after, "_b").withColumn("next", F.coalesce("next", "after")).drop("_b", "after")


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H: src, dst, kind, line, ord, value. Each event leads from its user to the next event's."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    led = lead_in_order(events, ["ts", "event_id"], F.date_trunc("hour", F.col("ts")), "user_id")
    out = led.select(F.col("user_id").alias("src"), F.col("next").alias("dst"), F.col("event_type").alias("kind"), F.col("event_id").alias("line"), F.col("event_id").alias("ord"), "value")
    return out.where(F.col("dst").isNotNull() & (F.col("dst") != F.col("src")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: one edge for each pair of users that some hop joins, whatever its kind."""
    h = hops(spark, sf_dir)
    return h.groupBy("src", "dst").agg(F.min("line").alias("line")).select("src", "dst", F.lit("calls").alias("kind"), "line", F.col("line").alias("ord"))


def busiest(edges: DataFrame) -> int:
    """The node with most edges out, the least id of equals."""
    return edges.groupBy("src").count().orderBy(F.desc("count"), "src").first()["src"]


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S: one occurrence of a symbol for each part."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat_ws("::", "p_brand", "p_name").alias("id"), F.lit("function").alias("kind"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("sym_ord"), F.col("p_size").cast("long").alias("line"), (F.col("p_partkey") % 7).alias("column"),
        F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")).alias("signature"), (F.col("p_size") % 2 == 0).alias("declaration"), F.col("p_size").cast("long").alias("body_lines"), F.when(F.col("p_size") % 5 == 0, "exact").otherwise("approx").alias("precision"), (F.col("p_size") % 4 == 0).alias("public"),
    )


def references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """R and the symbols it refers to, one for each part."""
    part = table(spark, sf_dir, "part")
    small = part.select(F.col("p_partkey").alias("occ_id"), F.lit("function").alias("kind"), F.concat_ws("::", "p_brand", "p_name").alias("qualified"), F.col("p_name").alias("simple"))
    name = F.when(F.col("l_orderkey") % 7 == 0, "zz::nope").when(F.col("l_orderkey") % 5 == 0, F.concat(F.lit("bogus::"), "p_name")).otherwise(F.concat_ws("::", "p_brand", "p_name"))
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("ref_id"), name.alias("name")).distinct()
    return rows, small


def supply(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """F: nodes (id, kind) and foreign-key edges (src, dst, kind), ids `kind:key`."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda k, c: F.concat(F.lit(k + ":"), F.col(c).cast("string"))
    nodes = t("customer").select(key("customer", "c_custkey").alias("id"), F.lit("customer").alias("kind"))
    nodes = nodes.union(t("nation").select(key("nation", "n_nationkey"), F.lit("nation"))).union(t("region").select(key("region", "r_regionkey"), F.lit("region"))).union(t("supplier").select(key("supplier", "s_suppkey"), F.lit("supplier")))
    edges = t("customer").select(key("customer", "c_custkey").alias("src"), key("nation", "c_nationkey").alias("dst"), F.lit("lives").alias("kind"))
    edges = edges.union(t("supplier").select(key("supplier", "s_suppkey"), key("nation", "s_nationkey"), F.lit("lives"))).union(t("nation").select(key("nation", "n_nationkey"), key("region", "n_regionkey"), F.lit("within")))
    return nodes, edges.union(t("orders").select(key("order", "o_orderkey"), key("customer", "o_custkey"), F.lit("placed")))


def includes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Include rows and files: brands are folders, part names are headers in the first of their brands."""
    p = table(spark, sf_dir, "part")
    named = lambda brand: F.concat(F.translate(brand, "#", "_"), F.lit("/"), F.translate("p_name", " ", "_"), F.lit(".h"))
    path = named("p_brand")
    files = p.groupBy("p_name").agg(F.min("p_brand").alias("brand")).select(named("brand").alias("path"))
    target = (
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.translate("p_name", " ", "_"), F.lit(".h")))
        .when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("../"), path))
        .when(F.col("p_partkey") % 5 == 2, F.concat(F.lit("./x/../"), F.translate("p_name", " ", "_"), F.lit(".h")))
        .when(F.col("p_partkey") % 5 == 3, path)
        .otherwise(F.concat(F.lit("none/"), F.translate("p_name", " ", "_"), F.lit(".hpp")))
    )
    home = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.translate("p_brand", "#", "_"), F.lit("/all.cpp"))).otherwise(F.lit("app/main.cpp"))
    return p.select(F.col("p_partkey").alias("inc_id"), home.alias("file"), target.alias("target")), files


def file_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users as files of 40 modules; edges of H1 as includes; modules 0 to 9 are public."""
    edges = pairs(spark, sf_dir).select("src", "dst", F.lit("includes").alias("kind"), "line", "ord")
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    module = F.when(F.col("id") % 40 < 10, F.concat(F.lit("include/m"), (F.col("id") % 40).cast("string"))).otherwise(F.concat(F.lit("src/m"), (F.col("id") % 40).cast("string")))
    nodes = users.select("id", F.lit("file").alias("kind"), F.concat(module, F.lit("/u"), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, ".h").otherwise(".cpp")).alias("file"), module.alias("module"), F.lit(False).alias("external"))
    return nodes, edges.join(nodes.select(F.col("id").alias("src"), "file"), "src")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files made of `part`: fifty parts a file, each part a function that calls the next part's.

    Every function takes five lines after the five lines at the top of its file.
    """
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.floor(F.col("p_partkey") / 50).alias("f"), F.col("p_size").alias("z"))
    number = lambda c: c.cast("long").cast("string")
    callee = F.when(F.col("z") % 10 == 0, F.concat(F.lit("gone_"), number(F.col("z")))).otherwise(F.concat(F.lit("part_"), number(F.col("k") + 1)))
    body = F.concat(F.lit("int part_"), number(F.col("k")), F.lit("(int x) {\n  /* old_call(x); */ log(\"no_call(x)\");\n  "), callee, F.lit("(x);\n  return LIMIT;\n}\n"))
    files = p.groupBy("f").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", body.alias("b")))), lambda x: x["b"]), "").alias("body"))  # fifty rows a file
    head = F.concat(F.lit("// generated\n#include \"f"), number(F.col("f") + 1), F.lit(".cpp\"\n#include <vector>\n#define LIMIT 9\n\n"))
    return files.select(F.concat(F.lit("gen/f"), number(F.col("f")), F.lit(".cpp")).alias("path"), F.concat(head, "body").alias("content"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers made of `supplier`: one a nation, with a class and an enum a supplier in its namespace, and variables below.

    A class takes seven lines after the first line of its file, and its enum one more.
    """
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("f"))
    number = lambda c: c.cast("long").cast("string")
    k = number(F.col("k"))
    block = F.concat(
        F.lit("class Supp_"), k, F.lit(" : public Base_"), number(F.col("k") % 3), F.lit(", private util::Mixin<Supp_"), k, F.lit("> {\n public:\n  int get_"), k, F.lit("() const;\n private:\n  Kind_"), number(F.col("k") % 5),
        F.lit(" kind_;\n  std::vector<Item_"), number(F.col("k") % 4), F.lit("> items_;\n};\nenum class Enum_"), k, F.lit(" { none };\n"),
    )
    each = p.select("f", F.struct("k", block.alias("b"), F.concat(F.lit("int total_"), k, F.lit(" = 1;\n")).alias("v")).alias("x"))
    files = each.groupBy("f").agg(F.array_sort(F.collect_list("x")).alias("all"))  # the suppliers of a nation, as source text
    text = lambda c: F.array_join(F.transform("all", lambda x: x[c]), "")
    return files.select(F.concat(F.lit("gen/n"), number(F.col("f")), F.lit(".h")).alias("path"), F.concat(F.lit("namespace n"), number(F.col("f")), F.lit(" {\n"), text("b"), F.lit("}\n"), text("v")).alias("content"))


def scripts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows of build scripts, one a region, whose nations are targets that list their suppliers and link the region and the nation before; and files."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/CMakeLists.txt")).alias("file"), F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("region"))
    name = F.concat(F.lit("t"), F.col("k").cast("string"))
    line = (F.col("k") * 10 + 1).cast("long")
    rows = n.select(name.alias("target"), F.lit("kind").alias("relation"), F.when(F.col("k") % 2 == 0, "library").otherwise("executable").alias("value"), line.alias("line"), "file")
    rows = rows.unionByName(n.select(name.alias("target"), F.lit("link").alias("relation"), F.explode(F.array("region", F.concat(F.lit("t"), (F.col("k") - 1).cast("string")))).alias("value"), (line + 5).alias("line"), "file"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("k"))
    source = F.concat(F.lit("../src/s"), F.col("s").cast("string"), F.lit(".c"))
    rows = rows.unionByName(s.join(n, "k").select(name.alias("target"), F.lit("source").alias("relation"), source.alias("value"), line.alias("line"), "file"))
    return rows, s.where("s % 3 > 0").select(F.concat(F.when(F.col("s") % 3 == 1, "src/s").otherwise("old/src/s"), F.col("s").cast("string"), F.lit(".c")).alias("path"))
