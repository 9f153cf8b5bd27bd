"""The registered queries of the graph engine, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.functions import exprs
from codeatlas.functions.tables import settle, table
from codeatlas.operators import build, checks, extract, graph, traverse, views
from codeatlas.plans import bench_graphs as g

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

H = """hops AS (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, event_type AS kind, event_id AS line, value FROM events),
h AS (SELECT * FROM hops WHERE dst IS NOT NULL AND dst <> src)"""
H1 = H + ", h1 AS (SELECT src, dst, min(line) AS line FROM h GROUP BY ALL)"
START = "(SELECT src FROM h1 GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"
FILES = """, u AS (SELECT DISTINCT user_id AS id FROM events), f AS (SELECT id, (CASE WHEN id % 40 < 10 THEN 'include/m' ELSE 'src/m' END) || (id % 40)::VARCHAR AS module FROM u),
fn AS (SELECT id, module, module || '/u' || id::VARCHAR || CASE WHEN id % 2 = 0 THEN '.h' ELSE '.cpp' END AS file FROM f)"""
ARCS = H1 + FILES + """, e AS (SELECT h1.*, a.module AS m1, b.module AS m2, a.file, b.file AS to_file FROM h1 JOIN fn a ON a.id = src JOIN fn b ON b.id = dst),
arcs AS (SELECT m1 AS src, m2 AS dst, count(*) AS n, arg_min(struct_pack(file := file, line := line), (CASE WHEN file LIKE '%.h' THEN 0 ELSE 1 END)::BIGINT * 1000000000000 + line) AS r FROM e WHERE m1 <> m2 GROUP BY ALL)"""
REACH = ", reach(a, b) AS (SELECT src, dst FROM arcs UNION SELECT reach.a, arcs.dst FROM reach JOIN arcs ON reach.b = arcs.src), scc AS (SELECT r.a AS node, least(min(r.b), r.a) AS component FROM reach r JOIN reach q ON r.a = q.b AND r.b = q.a WHERE r.a <> r.b GROUP BY r.a)"
SUPPLY = """fnodes AS (SELECT 'customer:' || c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'region' FROM region UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier' FROM supplier),
fedges AS (SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst, 'lives' AS kind FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'lives' FROM supplier
UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'within' FROM nation UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'placed' FROM orders)"""
REFS = """s AS (SELECT p_partkey AS occ_id, p_brand || '::' || p_name AS qualified, p_name AS simple FROM part),
r AS (SELECT DISTINCT l_suppkey AS ref_id, CASE WHEN l_orderkey % 7 = 0 THEN 'zz::nope' WHEN l_orderkey % 5 = 0 THEN 'bogus::' || p_name ELSE p_brand || '::' || p_name END AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT n.name, occ_id, 0 AS tier FROM (SELECT DISTINCT name FROM r) n JOIN s ON s.qualified = n.name UNION ALL SELECT n.name, occ_id, 1 FROM (SELECT DISTINCT name FROM r) n JOIN s ON s.simple = split_part(n.name, '::', -1)),
b AS (SELECT name, tier, count(*) AS n_hits, CASE WHEN count(*) <= 3 THEN list(DISTINCT occ_id ORDER BY occ_id) END AS hits FROM m GROUP BY name, tier QUALIFY row_number() OVER (PARTITION BY name ORDER BY tier) = 1),
res AS (SELECT ref_id, r.name, coalesce(tier, -1) AS tier, coalesce(n_hits, 0) AS n_hits, array_to_string(hits, ',') AS hits FROM r LEFT JOIN b ON r.name = b.name)"""


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def routed(levels: int) -> str:
    """CTEs l0 to l<levels> of the breadth-first route over h1, and `steps`."""
    out = f", l0 AS (SELECT 1::BIGINT AS step, 0::BIGINT AS parent, 0 AS depth, {START} AS node)"
    for k in range(1, levels + 1):
        before = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(k))
        out += f""", l{k} AS (SELECT (SELECT count(*) FROM ({before})) + row_number() OVER (ORDER BY parent, line, node) AS step, parent, {k} AS depth, node
        FROM (SELECT dst AS node, step AS parent, line FROM l{k - 1} JOIN h1 ON src = node WHERE dst NOT IN (SELECT node FROM ({before})) QUALIFY row_number() OVER (PARTITION BY dst ORDER BY step, line) = 1))"""
    return out + ", steps AS (" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(levels + 1)) + ")"


@query(f"WITH {H} SELECT src, dst, kind, min(line) AS line FROM h GROUP BY ALL")
def edge_dedup_first(spark, d):
    return graph.dedup_edges(g.hops(spark, d).drop("value")).select("src", "dst", "kind", "line")


@query(f"WITH {H}, e AS (SELECT DISTINCT src, dst, kind FROM h) SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY id")
def node_degrees(spark, d):
    return graph.degrees(graph.dedup_edges(g.hops(spark, d).drop("value")))


@query(f"WITH {H1}, ends AS (SELECT user_id AS id, 0 AS i, 0 AS o FROM events UNION ALL SELECT src, 0, 1 FROM h1 UNION ALL SELECT dst, 1, 0 FROM h1) SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM ends GROUP BY id")
def view_degrees(spark, d):
    return graph.degrees(g.pairs(spark, d), table(spark, d, "events").select(F.col("user_id").alias("id")).distinct())


@query(f"WITH {H} SELECT kind, count(*) AS n_edges, count(DISTINCT (src, dst)) AS n_distinct FROM h GROUP BY kind")
def stats_kind_counts(spark, d):
    return graph.kind_counts(g.hops(spark, d))


@query(f"WITH {H1}{FILES} SELECT module, count(*) AS n_files FROM fn GROUP BY module ORDER BY n_files DESC, module LIMIT 12")
def architecture_top_dirs(spark, d):
    return graph.top_modules(g.file_graph(spark, d)[0], 12)


@query(f"WITH {ARCS}, t AS (SELECT module FROM fn GROUP BY module ORDER BY count(*) DESC, module LIMIT 30) SELECT m1 AS src, m2 AS dst, count(*) AS weight FROM e WHERE m1 <> m2 AND m1 IN (FROM t) AND m2 IN (FROM t) GROUP BY ALL")
def architecture_edges(spark, d):
    return graph.architecture(*g.file_graph(spark, d), most=30)[1]


@query(f"WITH {H1}{FILES}, k AS (SELECT id, 'dir:' || module AS grp FROM fn) SELECT a.grp AS src, b.grp AS dst, min(line) AS ord FROM h1 JOIN k a ON a.id = src JOIN k b ON b.id = dst WHERE a.grp <> b.grp GROUP BY ALL")
def cluster_by_module(spark, d):
    return graph.cluster(g.file_graph(spark, d)[0], g.pairs(spark, d))[1].select("src", "dst", "ord")


@query("""WITH o AS (SELECT p_brand || '::' || p_name AS id, p_name AS name, p_brand AS file, p_partkey AS k, p_size AS z, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS sig FROM part)
SELECT id, 'function' AS kind, arg_min(name, k) AS name, arg_min(file, k) AS file, coalesce(arg_min(z, k) FILTER (z % 2 = 1), arg_min(z, k))::BIGINT AS line, coalesce(arg_min(k, k) FILTER (z % 2 = 1), min(k)) % 7 AS "column",
bool_and(z % 2 = 0) AS declaration, max(z)::BIGINT AS body_lines, coalesce(arg_min(sig, k) FILTER (sig <> ''), '') AS detail, arg_max(CASE WHEN z % 5 = 0 THEN 'exact' ELSE 'approx' END, k) AS precision,
arg_min(file, k) FILTER (z % 4 = 0) AS api_header, coalesce(arg_min(z, k) FILTER (z % 4 = 0), -1)::BIGINT AS api_line FROM o GROUP BY id""")
def symbol_merge(spark, d):
    return graph.merge_symbols(g.symbols(spark, d)).withColumn("api_line", F.coalesce("api_line", F.lit(-1)))


def _resolved(spark, d):
    refs, known = g.references(spark, d)
    return graph.resolve_references(refs, known, ["function"])


@query(f"WITH {REFS} SELECT * FROM res")
def ref_resolution(spark, d):
    return _resolved(spark, d).withColumn("hits", F.array_join("hits", ","))


@query(f"WITH {REFS} SELECT name, count(*) AS n_refs FROM res WHERE n_hits = 0 GROUP BY name")
def unresolved_refs(spark, d):
    return _resolved(spark, d).where("n_hits = 0").groupBy("name").agg(F.count("*").alias("n_refs"))


@query(f"WITH {REFS}, x AS (SELECT CASE WHEN n_hits = 0 THEN name ELSE split_part(name, '::', -1) END AS name FROM res WHERE n_hits = 0 OR n_hits > 3) SELECT DISTINCT 'ext:function:' || name AS id, name FROM x")
def external_nodes(spark, d):
    return graph.externals(_resolved(spark, d))


@query("""WITH p AS (SELECT *, replace(p_brand, '#', '_') AS dir, replace(p_name, ' ', '_') AS base FROM part), f AS (SELECT replace(min(p_brand), '#', '_') || '/' || base || '.h' AS path, lower(base || '.h') AS base FROM p GROUP BY p_name, base),
i AS (SELECT p_partkey AS inc_id, CASE WHEN p_partkey % 2 = 0 THEN dir ELSE 'app' END AS home, CASE p_partkey % 5 WHEN 0 THEN base || '.h' WHEN 1 THEN '../' || dir || '/' || base || '.h' WHEN 2 THEN base || '.h' WHEN 3 THEN dir || '/' || base || '.h' ELSE 'none/' || base || '.hpp' END AS t FROM p),
j AS (SELECT inc_id, t, CASE WHEN t LIKE '../%' THEN substr(t, 4) ELSE home || '/' || t END AS c1, 'Brand_11/' || t AS c2 FROM i),
x AS (SELECT inc_id, t, CASE WHEN c1 IN (SELECT path FROM f) THEN c1 WHEN t LIKE '../%' AND substr(t, 4) IN (SELECT path FROM f) THEN substr(t, 4) WHEN c2 IN (SELECT path FROM f) THEN c2 END AS exact FROM j),
tails AS (SELECT t, min(path) AS tail FROM (SELECT DISTINCT t FROM i) JOIN f ON f.path = t OR f.path LIKE '%/' || replace(t, '_', '\\_') ESCAPE '\\' GROUP BY t), lone AS (SELECT base, min(path) AS only_path FROM f GROUP BY base HAVING count(*) = 1)
SELECT inc_id, coalesce(exact, tail, only_path) AS resolved, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN coalesce(tail, only_path) IS NOT NULL THEN 'approx' END AS precision FROM x LEFT JOIN tails USING (t) LEFT JOIN lone ON lone.base = lower(split_part(x.t, '/', -1))""")
def include_resolution(spark, d):
    return graph.resolve_includes(*g.includes(spark, d), search=["Brand_11"])


@query(f"WITH {SUPPLY} SELECT src, dst, kind FROM fedges WHERE src IN (SELECT id FROM fnodes) AND dst IN (SELECT id FROM fnodes) AND src <> dst")
def referential_integrity(spark, d):
    nodes, edges = g.supply(spark, d)
    return graph.valid_edges(edges, nodes).select("src", "dst", "kind")


@query("SELECT p_name AS target, p_brand || '/' || p_name || '.c' AS source FROM part GROUP BY ALL")
def target_sources(spark, d):
    from codeatlas.sources.build_script import target_sources as match

    p = table(spark, d, "part")
    files = p.select(F.concat(F.col("p_brand"), F.lit("/"), F.col("p_name"), F.lit(".c")).alias("path")).distinct()
    named = p.select(F.col("p_name").alias("target"), F.concat(F.col("p_name"), F.lit(".c")).alias("listed")).distinct()
    return match(named, files)


@query("SELECT s_name AS target, CASE WHEN n_name = 'NATION_1' OR n_nationkey % 2 = 0 THEN 'target:' || n_name ELSE 'ext:target:' || n_name END AS dst, (n_nationkey % 2 = 1 AND n_name <> 'NATION_1') AS external FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def target_links(spark, d):
    from codeatlas.sources.build_script import target_links as link

    n = table(spark, d, "nation")
    links = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("target"), F.col("n_name").alias("library"))
    return link(links, n.where("n_nationkey % 2 = 0 or n_name = 'NATION_1'").select(F.col("n_name").alias("name")))


def _points(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), "role")
    named = F.concat_ws(":", F.col("file").cast("string"), F.col("line").cast("string"))
    points = c.select(named.alias("point_id"), "file", "line")
    return points, c.where("role = 'user'").select(named.alias("id"), "file", "line", F.col("line").alias("node_ord"))


@query("""WITH p AS (SELECT DISTINCT conv_id, turn, role FROM conversations) SELECT a.conv_id || ':' || a.turn AS point_id, coalesce(a.conv_id || ':' || max(b.turn), 'file:' || a.conv_id) AS id
FROM p a LEFT JOIN p b ON a.conv_id = b.conv_id AND b.turn <= a.turn AND b.role = 'user' GROUP BY a.conv_id, a.turn""")
def node_at_cursor(spark, d):
    points, syms = _points(spark, d)
    return graph.innermost_at(points.distinct(), syms.distinct())


@query("""WITH p AS (SELECT DISTINCT conv_id, turn FROM conversations), n AS (SELECT DISTINCT conv_id, turn, role FROM conversations)
SELECT a.conv_id || ':' || a.turn AS point_id, coalesce('func:' || a.conv_id || ':' || max(b.turn) FILTER (role = 'user'), 'class:' || a.conv_id || ':' || max(b.turn) FILTER (role <> 'user'), 'file:' || a.conv_id) AS id
FROM p a LEFT JOIN n b ON a.conv_id = b.conv_id AND b.turn <= a.turn GROUP BY a.conv_id, a.turn""")
def enclosing_function(spark, d):
    points = _points(spark, d)[0].distinct()
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), F.when(F.col("role") == "user", "function").otherwise("class").alias("kind")).distinct()
    named = F.concat_ws(":", F.when(F.col("kind") == "function", "func").otherwise("class"), F.col("file").cast("string"), F.col("line").cast("string"))
    return build.enclosing_function(points, c.select(named.alias("id"), "kind", "file", "line", F.col("line").alias("node_ord")))


SOURCES = """p AS (SELECT p_partkey AS k, floor(p_partkey / 50)::BIGINT AS f, p_size AS z, 'gen/f' || floor(p_partkey / 50)::BIGINT || '.cpp' AS file FROM part),
src AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY k) - 1 AS i, CASE WHEN z % 10 = 0 THEN 'gone_' || z ELSE 'part_' || (k + 1) END AS callee FROM p)"""


@query(f"""WITH {SOURCES} SELECT 'func:part_' || k AS id, 'function' AS kind, file, (6 + 5 * i)::INT AS line, FALSE AS declaration, 5 AS body_lines, 'int part_' || k || '(int x)' AS signature FROM src
UNION ALL SELECT DISTINCT 'macro:LIMIT', 'macro', file, 1, FALSE, 0, '' FROM src""")
def symbols_scan(spark, d):
    return extract.Parsed(g.sources(spark, d)).symbols.select("id", "kind", "file", "line", "declaration", "body_lines", "signature")


@query(f"""WITH {SOURCES} SELECT 'func:part_' || k AS from_id, callee AS name, 'calls' AS kind, file, (8 + 5 * i)::INT AS line FROM src UNION ALL SELECT 'func:part_' || k, 'log', 'calls', file, (7 + 5 * i)::INT FROM src
UNION ALL SELECT DISTINCT 'file:' || file, 'LIMIT', 'refs', file, 9 FROM src""")
def calls_scan(spark, d):
    return extract.Parsed(g.sources(spark, d)).refs.select("from_id", "name", "kind", "file", "line")


@query(f"WITH {SOURCES} SELECT DISTINCT file, 'f' || (f + 1) || '.cpp' AS target, 2 AS line FROM src UNION ALL SELECT DISTINCT file, 'vector', 3 FROM src")
def includes_scan(spark, d):
    return extract.Parsed(g.sources(spark, d)).includes.select("file", "target", "line")


_STATS = H1 + """, n AS (SELECT DISTINCT user_id, CASE user_id % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'function' ELSE 'class' END AS kind, user_id % 5 = 0 AS external, CASE WHEN user_id % 2 = 0 THEN 'exact' ELSE 'approx' END AS precision FROM events)"""
HEADERS = """h AS (SELECT s_suppkey AS k, s_nationkey AS f, 'gen/n' || s_nationkey || '.h' AS file, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS m FROM supplier)"""


@query(f"""WITH {HEADERS} SELECT 'class:n' || f || '::Supp_' || k AS id, 'class' AS kind, file, (2 + 8 * i)::INT AS line, FALSE AS declaration, 'class Supp_' || k || ' @ ' || file AS signature FROM h
UNION ALL SELECT 'enum:n' || f || '::Enum_' || k, 'enum', file, (9 + 8 * i)::INT, FALSE, 'enum Enum_' || k FROM h UNION ALL SELECT 'func:n' || f || '::Supp_' || k || '::get_' || k, 'function', file, (4 + 8 * i)::INT, TRUE, 'int get_' || k || '()' FROM h
UNION ALL SELECT 'var:total_' || k, 'variable', file, (3 + 8 * m + i)::INT, FALSE, 'int total_' || k || '=;' FROM h""")
def types_scan(spark, d):
    """Classes in namespaces, enums, members and variables of generated headers."""
    return extract.Parsed(g.headers(spark, d)).symbols.select("id", "kind", "file", "line", "declaration", "signature")


@query(f"""WITH {HEADERS}, r AS (SELECT 'class:n' || f || '::Supp_' || k AS from_id, * FROM h) SELECT from_id, 'Base_' || (k % 3) AS name, 'inherits' AS kind, file, (2 + 8 * i)::INT AS line FROM r UNION ALL SELECT from_id, 'Kind_' || (k % 5), 'uses', file, (6 + 8 * i)::INT FROM r
UNION ALL SELECT from_id, 'Item_' || (k % 4), 'uses', file, (7 + 8 * i)::INT FROM r""")
def type_refs_scan(spark, d):
    """Bases (a type that names itself last is none) and the types of members."""
    return extract.Parsed(g.headers(spark, d), extract.Kinds(calls=False, symbols=False)).refs.select("from_id", "name", "kind", "file", "line")


@query("""WITH t AS (SELECT n_nationkey AS k, 'target:t' || n_nationkey AS src, 'r' || n_regionkey || '/CMakeLists.txt' AS file, (n_nationkey * 10 + 1)::INT AS line, n_regionkey AS r FROM nation),
b AS (SELECT a.*, p.k IS NOT NULL AND (p.file, p.line) < (a.file, a.line + 5) AS known FROM t a LEFT JOIN t p ON p.k = a.k - 1)
SELECT src, 'ext:target:region' || r AS dst, file, line, TRUE AS external FROM t UNION ALL SELECT src, CASE WHEN k > 0 THEN 'target:t' || (k - 1) ELSE 'ext:target:t-1' END, file, line, k = 0 FROM t
UNION ALL SELECT src, 'file:' || CASE WHEN s_suppkey % 3 = 1 THEN 'src/s' ELSE 'old/src/s' END || s_suppkey || '.c', file, line, FALSE FROM t JOIN supplier ON s_nationkey = k WHERE s_suppkey % 3 > 0""")
def link_edges(spark, d):
    """Targets of build scripts with their sources, wherever these lie, and what they link."""
    return build.target_graph(*g.scripts(spark, d))[2].select("src", "dst", "file", "line", "external")


@query(f"""WITH RECURSIVE {ARCS}{REACH}, c AS (SELECT s.component, min(struct_pack(f := r.file, l := r.line)) AS r, sum(n)::BIGINT AS n FROM arcs JOIN scc s ON s.node = src JOIN scc t ON t.node = dst AND s.component = t.component GROUP BY s.component),
v AS (SELECT 'public-api-leak' AS kind, file AS from_file, min(line) AS from_line, to_file, '' AS dirs, 0::BIGINT AS edge_count FROM e WHERE file LIKE 'include/%' AND to_file NOT LIKE 'include/%' GROUP BY file, to_file
UNION ALL SELECT 'directory-cycle', r.f, r.l, '', (SELECT string_agg(node, ',' ORDER BY node) FROM scc WHERE scc.component = c.component), n FROM c)
SELECT *, (SELECT count(*) FROM v) AS total FROM v ORDER BY kind, from_file, from_line, to_file LIMIT 60""")
def violations_rows(spark, d):
    return checks.violations(*g.file_graph(spark, d), most=60).withColumn("dirs", F.array_join("dirs", ","))


@query(f"WITH {_STATS} SELECT count(*) FILTER (kind = 'file' AND NOT external) AS file_count, count(*) FILTER (kind <> 'file') AS symbol_count, count(*) FILTER (external) AS external_count, count(*) FILTER (precision = 'exact') AS exact_nodes, count(*) FILTER (precision <> 'exact') AS approx_nodes, (SELECT count(*) FROM h1) AS edge_count, 'partial' AS precision, (SELECT string_agg(kind || ':' || c, ',' ORDER BY kind) FROM (SELECT kind, count(*) AS c FROM n GROUP BY kind)) AS kinds FROM n")
def stats_full(spark, d):
    """All counts of a graph's nodes and edges in one row."""
    edges = g.pairs(spark, d)
    ids = table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    i = F.col("id")
    nodes = ids.select("id", F.when(i % 3 == 0, "file").when(i % 3 == 1, "function").otherwise("class").alias("kind"), (i % 5 == 0).alias("external"), F.when(i % 2 == 0, "exact").otherwise("approx").alias("precision"))
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("node_kind_counts")), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    return graph.stats_row(nodes, edges, True).select("file_count", "symbol_count", "external_count", "exact_nodes", "approx_nodes", "edge_count", "precision", kinds.alias("kinds"))


@query(f"""WITH {SOURCES}, e AS (SELECT DISTINCT 'file:' || file AS src, CASE WHEN f + 1 IN (SELECT f FROM p) THEN 'file:gen/f' || (f + 1) || '.cpp' ELSE 'ext:file:f' || (f + 1) || '.cpp' END AS dst, 'includes' AS kind, CASE WHEN f + 1 IN (SELECT f FROM p) THEN 'exact' ELSE 'approx' END AS precision, 2 AS line FROM src
UNION ALL SELECT DISTINCT 'file:' || file, 'ext:file:vector', 'includes', 'approx', 3 FROM src UNION ALL SELECT 'func:part_' || k, CASE WHEN z % 10 <> 0 AND k + 1 IN (SELECT k FROM p) THEN 'func:' || callee ELSE 'ext:function:' || callee END, 'calls', 'approx', (8 + 5 * i)::INT FROM src
UNION ALL SELECT 'func:part_' || k, 'ext:function:log', 'calls', 'approx', (7 + 5 * i)::INT FROM src UNION ALL SELECT DISTINCT 'file:' || file, CASE WHEN (SELECT count(DISTINCT f) FROM p) > 3 THEN 'ext:function:LIMIT' ELSE 'macro:LIMIT' END, 'refs', 'approx', 9 FROM src)
SELECT * FROM e""")
def graph_build(spark, d):
    files = settle(g.sources(spark, d), "sources")
    return build.build(files, *extract.extract(files), include_external=True)[1].select("src", "dst", "kind", "precision", "line")


@query(f"""WITH {SOURCES}, c AS (SELECT 'file:' || file AS file, 'func:part_' || k AS sym, k AS ord FROM src), e AS (SELECT 'func:part_' || k AS src, 'func:' || callee AS dst FROM src WHERE z % 10 <> 0 AND k + 1 IN (SELECT k FROM p)),
one AS (SELECT sym AS node FROM c WHERE file = 'file:gen/f1.cpp'), two AS (SELECT dst AS node FROM e JOIN one ON node = src UNION SELECT file FROM c JOIN one ON node = sym UNION SELECT src FROM e JOIN one ON node = dst)
SELECT 'file:gen/f1.cpp' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two WHERE node NOT IN (FROM one) AND node <> 'file:gen/f1.cpp'""")
def containment_subgraph(spark, d):
    """The functions of one file, and what calls join to them."""
    files = settle(g.sources(spark, d), "sources")
    symbols, refs, includes = extract.extract(files)
    nodes, edges, _ = build.build(files, symbols, refs, includes)
    calls = edges.where("kind = 'calls'").select("src", "dst", "kind", "line", F.col("edge_ord").alias("ord"))
    held = build.containment(symbols.where("kind = 'function'")).select("file", "symbol", F.struct(F.lit(0).alias("stage"), F.col("file").alias("file"), F.col("ord").alias("n"), F.lit(0).cast("long").alias("place")).alias("ord"))
    return traverse.subgraph(calls, "file:gen/f1.cpp", 2, "both", 1 << 40, held)[0].select("node", "depth")


@query(f"WITH {SUPPLY} SELECT DISTINCT src AS id FROM fedges WHERE dst = 'nation:7' AND src IN (SELECT id FROM fnodes)")
def dependents(spark, d):
    nodes, edges = g.supply(spark, d)
    return graph.dependents(edges, nodes, "nation:7")


@query(f"WITH {H} SELECT src, dst, kind, coalesce(max(line) FILTER (value > 100), max(line)) AS line FROM h GROUP BY ALL")
def graph_merge(spark, d):
    h = g.hops(spark, d)
    last = lambda cond: h.where(cond).groupBy("src", "dst", "kind").agg(F.max("line").alias("line"))
    return graph.merge_graphs(last("value <= 100 or value is null"), last("value > 100"), ["src", "dst", "kind"])


def _bfs(direction: str) -> str:
    step = {"downstream": "SELECT src AS a, dst AS b FROM h1", "upstream": "SELECT dst AS a, src AS b FROM h1", "both": "SELECT src AS a, dst AS b FROM h1 UNION SELECT dst, src FROM h1"}[direction]
    return f"WITH RECURSIVE {H1}, adj AS ({step}), bfs(node, depth) AS (SELECT {START}, 0 UNION SELECT b, depth + 1 FROM bfs JOIN adj ON a = node WHERE depth < 3) SELECT node, min(depth) AS depth FROM bfs GROUP BY node"


def _subgraph(spark, d, direction, most=1 << 40):
    edges = settle(g.pairs(spark, d), "edges")
    return edges, *traverse.subgraph(edges, g.busiest(edges), 3, direction, most)


@query(_bfs("both"))
def subgraph_both(spark, d):
    return _subgraph(spark, d, "both")[1].select("node", "depth")


@query(_bfs("upstream"))
def subgraph_up(spark, d):
    return _subgraph(spark, d, "upstream")[1].select("node", "depth")


@query(_bfs("downstream"))
def subgraph_down(spark, d):
    return _subgraph(spark, d, "downstream")[1].select("node", "depth")


@query(_bfs("downstream").replace("SELECT node, min(depth) AS depth FROM bfs GROUP BY node", "SELECT src, dst, line FROM h1 WHERE src IN (SELECT node FROM bfs) AND dst IN (SELECT node FROM bfs)"))
def subgraph_edges(spark, d):
    edges, visited, _ = _subgraph(spark, d, "downstream")
    return traverse.induced(edges, visited).select("src", "dst", "line")


def _queued(levels: int, most: int) -> str:
    """CTEs of a queue's levels over `adj` (node, next, g, o): each new node by its first finder, while fewer than most are visited."""
    out = f", v0 AS (SELECT {START} AS node, 0::BIGINT AS pos, 0 AS depth)"
    for k in range(1, levels + 1):
        before = " UNION ALL ".join(f"SELECT * FROM v{i}" for i in range(k))
        out += f""", f{k} AS (SELECT next, arg_min({{'pos': pos, 'g': g, 'o': o}}, {{'pos': pos, 'g': g, 'o': o}}) AS fst FROM v{k - 1} JOIN adj USING (node) WHERE next NOT IN (SELECT node FROM ({before})) GROUP BY next),
        c{k} AS (SELECT fst.pos AS pos, sum(count(*)) OVER (ORDER BY fst.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f{k} GROUP BY fst.pos),
        v{k} AS (SELECT next AS node, (SELECT count(*) FROM ({before})) - 1 + row_number() OVER (ORDER BY fst.pos, fst.g, fst.o, next) AS pos, {k} AS depth FROM f{k} JOIN c{k} ON c{k}.pos = fst.pos WHERE (SELECT count(*) FROM ({before})) + coalesce(before, 0) < {most})"""
    return out + ", visited AS (" + " UNION ALL ".join(f"SELECT * FROM v{i}" for i in range(levels + 1)) + ")"


@query(f"WITH {H1}, adj AS (SELECT src AS node, dst AS next, 1 AS g, line AS o FROM h1 UNION ALL SELECT dst, src, 2, line FROM h1){_queued(3, 20)} SELECT node, pos, depth, (SELECT count(*) FROM visited) >= 20 AS truncated FROM visited")
def subgraph_truncated(spark, d):
    _, visited, cut = _subgraph(spark, d, "both", 20)
    return visited.withColumn("truncated", F.lit(cut))


@query(f"WITH {REFS}, e AS (SELECT ref_id::VARCHAR AS src, name AS dst FROM res WHERE n_hits BETWEEN 1 AND 3) SELECT src, dst FROM e")
def filter_external(spark, d):
    res = _resolved(spark, d)
    ends = res.select(F.col("name").alias("id"), (~F.col("n_hits").between(1, 3)).alias("external")).distinct()
    nodes = ends.union(res.select(F.col("ref_id").cast("string"), F.lit(False)).distinct())
    return graph.without_external(nodes, res.select(F.col("ref_id").cast("string").alias("src"), F.col("name").alias("dst")))[1].select("src", "dst")


def _functions(spark, d):
    edges = graph.dedup_edges(g.hops(spark, d).withColumn("kind", F.lit("calls")).drop("value"))
    users = table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    nodes = users.select("id", F.lit("function").alias("kind"), F.when(F.col("id") % 50 == 3, "main").otherwise(F.concat(F.lit("f"), F.col("id").cast("string"))).alias("name"), (F.col("id") % 9).cast("string").alias("file"), F.col("id").alias("line"), (F.col("id") % 11 == 0).alias("external"),
        (F.col("id") % 13 == 0).alias("declaration"), (F.col("id") % 6).alias("body_lines"), F.when(F.col("id") % 4 == 0, "include/x.h").alias("api_header"), F.col("id").alias("node_ord"))
    return nodes, edges


_CALLS = H + """, u AS (SELECT DISTINCT user_id AS id FROM events), c AS (SELECT DISTINCT src, dst FROM h WHERE src % 11 <> 0 AND dst % 11 <> 0),
cc AS (SELECT id, (SELECT count(*) FROM c WHERE dst = id) AS callers, (SELECT count(*) FROM c WHERE src = id) AS callees FROM u WHERE id % 11 <> 0)"""


@query(f"WITH {_CALLS} SELECT id, callers, callees FROM cc")
def callers_callees(spark, d):
    return checks.callers_callees(*_functions(spark, d))


@query(f"""WITH {_CALLS}, t AS (SELECT *, CASE WHEN id % 50 = 3 THEN 0 WHEN id % 4 = 0 AND callees > 0 THEN 1 WHEN id % 4 = 0 THEN 2 WHEN callers = 0 AND callees > 0 THEN 3 END AS tier FROM cc WHERE id % 13 <> 0 AND id % 6 > 0),
q AS (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY tier, callees DESC, callers, (id % 9)::VARCHAR, id) AS rank FROM t WHERE tier IS NOT NULL) SELECT rank::INT AS rank, id, tier, callers, callees, total FROM q WHERE rank <= 20""")
def entry_candidates(spark, d):
    return checks.entry_candidates(*_functions(spark, d), most=20)


@query("SELECT coalesce(min(user_id) FILTER (user_id % 11 <> 0 AND user_id % 13 <> 0), min(user_id)) AS id FROM events WHERE user_id % 50 = 3 HAVING count(*) > 0")
def entry_point(spark, d):
    return checks.entry_point(_functions(spark, d)[0])


@query("""WITH f AS (SELECT p_partkey AS id, p_name AS simple, p_brand AS file, p_size AS line FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY simple ORDER BY file, line, id) AS r, count(*) OVER (PARTITION BY simple) - 1 AS total FROM f)
SELECT a.id, any_value(a.total) AS total, coalesce(string_agg(b.id::VARCHAR, ',' ORDER BY b.r) FILTER (b.r <= CASE WHEN a.r <= 20 THEN 21 ELSE 20 END AND b.id <> a.id), '') AS candidates, any_value(a.total) > 0 AS ambiguous FROM r a LEFT JOIN r b ON a.simple = b.simple AND b.r <= 21 GROUP BY a.id""")
def same_name_candidates(spark, d):
    f = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("simple"), F.col("p_brand").alias("file"), F.col("p_size").alias("line"))
    return graph.same_name_candidates(f).withColumn("candidates", F.array_join("candidates", ","))


def walked(kids: str, start: str, depth: int, most: int) -> str:
    """A depth-first walk as recursion over (n, stack, seen, the claimed step). kids: node, next, r."""
    return f"""kids AS ({kids}), lists AS (SELECT node, list({{'node': next, 'r': r}} ORDER BY r DESC) AS k FROM kids GROUP BY node),
walk(n, stack, seen, step, parent, depth, node) AS (
  SELECT 0::BIGINT, [{{'node': {start}, 'parent': 0::BIGINT, 'depth': 0}}], []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::INT, NULL::BIGINT
  UNION ALL
  SELECT CASE WHEN fresh THEN n + 1 ELSE n END, list_concat(rest, CASE WHEN fresh AND top.depth < {depth} AND k IS NOT NULL THEN list_transform(k, lambda x: {{'node': x.node, 'parent': n + 1, 'depth': top.depth + 1}}) ELSE [] END),
         CASE WHEN fresh THEN list_append(seen, top.node) ELSE seen END, CASE WHEN fresh THEN n + 1 END, top.parent, top.depth, top.node
  FROM (SELECT n, stack[len(stack)] AS top, stack[1:len(stack) - 1] AS rest, seen, NOT list_contains(seen, stack[len(stack)].node) AS fresh FROM walk WHERE len(stack) > 0 AND n < {most}) w LEFT JOIN lists ON lists.node = w.top.node)
SELECT step, parent, depth, node FROM walk WHERE step IS NOT NULL"""


def _route(spark, d, depth=3):
    edges = settle(g.pairs(spark, d), "edges")
    return edges, traverse.route(edges, g.busiest(edges), depth, 100_000)


@query(f"WITH {H1}{routed(3)} SELECT step, parent, depth, node FROM steps")
def route_bfs(spark, d):
    return _route(spark, d)[1]


@query(f"WITH {H1}{routed(3)} SELECT step, node % 12 AS file, step = min(step) OVER (PARTITION BY node % 12) AS new_file FROM steps")
def route_new_file(spark, d):
    return traverse.with_new_file(_route(spark, d)[1].withColumn("file", F.col("node") % 12)).select("step", "file", "new_file")


@query(f"WITH {H1}{routed(3)} SELECT depth, count(*) AS n_steps, count(DISTINCT node % 12) AS n_files, count(*) FILTER (node % 3 = 0) AS n_ambiguous FROM steps GROUP BY depth")
def route_layers(spark, d):
    return views.layer_summary(_route(spark, d)[1].select("depth", (F.col("node") % 12).alias("file"), (F.col("node") % 3 == 0).alias("ambiguous")))


@query(f"WITH {H1}{routed(2)}, x AS (SELECT DISTINCT dst FROM h1 WHERE src IN (SELECT node FROM steps) AND dst NOT IN (SELECT node FROM steps)) SELECT count(*) AS frontier_nodes, count(DISTINCT dst % 12) AS frontier_files FROM x")
def route_frontier(spark, d):
    edges, steps = _route(spark, d, 2)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return traverse.frontier(steps, edges, ends.withColumn("file", F.col("node") % 12))


_FOLD = """, k AS (SELECT *, NOT ({drop}) AS keep FROM steps), a(step, top) AS (SELECT step, parent FROM k UNION ALL SELECT a.step, k.parent FROM a JOIN k ON a.top = k.step WHERE NOT k.keep), n AS (SELECT step, top AS anchor FROM a WHERE top = 0 OR top IN (SELECT step FROM k WHERE keep)),
o AS (SELECT step, row_number() OVER (ORDER BY step) AS new FROM k WHERE keep)"""


@query(f"WITH RECURSIVE {H1}{routed(3)}{_FOLD.format(drop='parent <> 0 AND node % 5 BETWEEN 1 AND 3 AND (SELECT count(*) FROM h1 WHERE src = node) <= 60')}" + """
SELECT o.new AS step, coalesce(p.new, 0) AS parent, depth, node, coalesce((SELECT string_agg(x.node::VARCHAR, ',' ORDER BY x.step) FROM n y JOIN k x ON x.step = y.step WHERE NOT x.keep AND y.anchor = k.step), '') AS skipped FROM k JOIN o ON o.step = k.step JOIN n ON n.step = k.step LEFT JOIN o p ON p.step = n.anchor""")
def route_fold_trivial(spark, d):
    edges, steps = _route(spark, d)
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
    trivial = steps.join(out, "node", "left").where((F.col("parent") != 0) & (F.col("node") % 5).between(1, 3) & (F.coalesce("n", F.lit(0)) <= 60))
    return traverse.fold(steps, trivial.select("step", F.col("node").cast("string").alias("name"))).withColumn("skipped", F.array_join("skipped", ","))


@query(f"WITH RECURSIVE {H1}{routed(3)}{_FOLD.format(drop='step <> (SELECT min(s.step) FROM steps s WHERE s.node % 12 = steps.node % 12)')} SELECT o.new AS step, coalesce(p.new, 0) AS parent, depth, node FROM k JOIN o ON o.step = k.step JOIN n ON n.step = k.step LEFT JOIN o p ON p.step = n.anchor")
def route_group_by_file(spark, d):
    steps = traverse.with_new_file(_route(spark, d)[1].withColumn("file", F.col("node") % 12))
    return traverse.fold(steps, steps.where(~F.col("new_file")).select("step", F.lit("").alias("name")), keep_names=False).select("step", "parent", "depth", "node")


@query(f"WITH {H1}, p AS (SELECT src, dst % 4 AS name, min(dst) AS pick FROM h1 WHERE src % 2 = 0 GROUP BY ALL) SELECT h1.src, coalesce(pick, dst) AS dst, min(line) AS line FROM h1 LEFT JOIN p ON p.src = h1.src AND p.name = dst % 4 GROUP BY ALL")
def route_override(spark, d):
    e = g.pairs(spark, d).select("src", "dst", (F.col("dst") % 4).alias("name"), "line")
    return traverse.overridden(e, e.where("src % 2 = 0").groupBy("src", "name").agg(F.min("dst").alias("pick"))).select("src", "dst", "line")


@query(f"WITH RECURSIVE {H1}, " + walked("SELECT src AS node, dst AS next, row_number() OVER (PARTITION BY src ORDER BY line, dst::VARCHAR, dst) AS r FROM h1", START, 4, 200))
def route_dfs(spark, d):
    edges = settle(g.pairs(spark, d), "edges")
    return traverse.route_depth_first(edges, g.busiest(edges), 4, 200)


@query(f"WITH RECURSIVE {H1}, " + walked(f"SELECT node, next, row_number() OVER (PARTITION BY node ORDER BY line, next::VARCHAR, next) AS r FROM (SELECT src AS node, dst AS next, line FROM h1 UNION ALL SELECT dst, src, line + {1 << 40} FROM h1)", START, 3, 100_000))
def spanning_tree(spark, d):
    e = settle(g.pairs(spark, d), "edges")
    both = e.select("src", "dst", "line", "ord").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("line") + (1 << 40)).alias("line"), "ord"))
    return traverse.route_depth_first(both, g.busiest(e), 3, 100_000)


def _arcs(spark, d):
    nodes, edges = g.file_graph(spark, d)
    home = nodes.select("id", "module")
    e = edges.join(home.select(F.col("id").alias("src"), F.col("module").alias("m1")), "src").join(home.select(F.col("id").alias("dst"), F.col("module").alias("m2")), "dst")
    return settle(checks.dir_arcs(e.withColumn("header", exprs.is_header(F.col("file")))), "arcs")


@query(f"WITH {ARCS} SELECT src, dst, n, r.file AS file, r.line AS line FROM arcs")
def dir_arcs(spark, d):
    return _arcs(spark, d)


@query(f"WITH RECURSIVE {ARCS}{REACH} SELECT node, component FROM scc")
def scc_components(spark, d):
    return checks.strong_components(_arcs(spark, d))


@query(f"WITH RECURSIVE {ARCS}{REACH}, dirs AS (SELECT component, string_agg(node, ',' ORDER BY node) AS dirs FROM scc GROUP BY component) SELECT s.component, any_value(dirs) AS dirs, sum(n)::BIGINT AS edge_count, min(r.file) AS file FROM arcs JOIN scc s ON s.node = src JOIN scc t ON t.node = dst AND s.component = t.component JOIN dirs ON dirs.component = s.component GROUP BY s.component")
def dir_cycles(spark, d):
    return checks.dir_cycles(_arcs(spark, d)).select("component", F.array_join("dirs", ",").alias("dirs"), "edge_count", "file")


@query(f"WITH {ARCS} SELECT file AS from_file, to_file, min(line) AS from_line FROM e WHERE file LIKE 'include/%' AND to_file NOT LIKE 'include/%' GROUP BY ALL")
def api_leaks(spark, d):
    return checks.public_leaks(*g.file_graph(spark, d))


@query(f"WITH RECURSIVE {ARCS}{REACH}, v AS (SELECT DISTINCT 'public-api-leak' AS kind, file, to_file FROM e WHERE file LIKE 'include/%' AND to_file NOT LIKE 'include/%' UNION ALL SELECT DISTINCT 'directory-cycle', component, '' FROM scc) SELECT kind, count(*) AS shown, (SELECT count(*) FROM v) AS total FROM v GROUP BY kind")
def violations_summary(spark, d):
    return checks.summary(checks.violations(*g.file_graph(spark, d), most=None))


@query(f"WITH {H1}{routed(3)}, p AS (SELECT step, depth, row_number() OVER (PARTITION BY depth ORDER BY step)::INT AS place, count(*) OVER (PARTITION BY depth) AS n FROM steps) SELECT step, depth, place, greatest(n - 3, 0) AS hidden FROM p WHERE place <= 3")
def layer_page(spark, d):
    return views.layer_page(_route(spark, d)[1].select("step", "depth"), page=3)


@query(f"WITH {H1}, x AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM h1 UNION ALL SELECT dst FROM h1) GROUP BY id) SELECT id, degree FROM x ORDER BY degree DESC, id LIMIT 25")
def table_view(spark, d):
    return views.table_view(graph.degrees(g.pairs(spark, d)).withColumn("node_ord", F.col("id")), 25).select("id", "degree")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_name ILIKE '%r#00%' OR s_name ILIKE '%7%'")
def search_nodes(spark, d):
    n = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("").alias("file"))
    return views.search(n, "R#00").union(views.search(n, "7")).distinct().select("id", "name")


@query(f"WITH {H1}{routed(3)}, l AS (SELECT node % 12 AS file, dense_rank() OVER (ORDER BY min(step))::INT - 1 AS lane FROM steps GROUP BY node % 12), w AS (SELECT step, node % 12 AS file, greatest(56.0, length('step ' || node) * 7.2 + 24.0)::DOUBLE AS width FROM steps) SELECT step, lane, round(coalesce(sum(width) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 3) AS x, round(width, 3) AS width FROM w JOIN l USING (file)")
def swimlane_layout(spark, d):
    s = _route(spark, d)[1].select("step", "parent", (F.col("node") % 12).alias("file"), F.concat(F.lit("step "), F.col("node").cast("string")).alias("label"))
    return views.swimlane(s, 100_000)[1].select("step", "lane", F.round("x", 3).alias("x"), F.round("width", 3).alias("width"))


def _drawn(spark, d):
    e = settle(g.pairs(spark, d), "edges")
    edges = e.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "kind", F.when(F.col("line") % 2 == 0, "exact").otherwise("approx").alias("precision"), F.col("ord").alias("edge_ord"))
    ids = e.select(F.explode(F.array("src", "dst")).alias("i")).distinct()
    nodes = ids.select(F.col("i").cast("string").alias("id"), F.concat(F.lit('u"'), F.col("i").cast("string"), F.lit("\\;")).alias("name"), (F.col("i") % 7 == 0).alias("external"), F.col("i").alias("node_ord"))
    return nodes, edges


_DRAWN = H1 + ", n AS (SELECT src AS i FROM h1 UNION SELECT dst FROM h1), k AS (SELECT i, 'n' || (row_number() OVER (ORDER BY i) - 1) AS a FROM n)"


@query(f"""WITH {_DRAWN} SELECT 0 AS part, 0::BIGINT AS ord, 'digraph G {{' AS line UNION ALL SELECT 0, 1, '  rankdir=LR;'
UNION ALL SELECT 1, i, '  "' || i || '" [label="u\\"' || i || '\\\\;"' || CASE WHEN i % 7 = 0 THEN ', style=dashed' ELSE '' END || '];' FROM n
UNION ALL SELECT 2, line, '  "' || src || '" -> "' || dst || '" [label="calls"' || CASE WHEN line % 2 = 1 THEN ', style=dotted' ELSE '' END || '];' FROM h1 UNION ALL SELECT 3, 0, '}}'""")
def export_dot(spark, d):
    return views.to_dot(*_drawn(spark, d))


@query(f"""WITH {_DRAWN} SELECT 0 AS part, 0::BIGINT AS ord, 'graph LR' AS line UNION ALL SELECT 1, i, '  ' || a || '["u_' || i || '__"]' FROM k
UNION ALL SELECT 2, line, '  ' || x.a || ' -->|calls| ' || y.a FROM h1 JOIN k x ON x.i = src JOIN k y ON y.i = dst""")
def export_mermaid(spark, d):
    return views.to_mermaid(*_drawn(spark, d))


@query(f"""WITH {_DRAWN} SELECT 1 AS part, i AS ord, '{{"id":"' || i || '","name":"u\\"' || i || '\\\\;","external":' || (i % 7 = 0)::VARCHAR || '}}' AS line FROM n
UNION ALL SELECT 2, line, '{{"src":"' || src || '","dst":"' || dst || '","kind":"calls","precision":"' || CASE WHEN line % 2 = 0 THEN 'exact' ELSE 'approx' END || '"}}' FROM h1""")
def export_json(spark, d):
    return views.to_json(*_drawn(spark, d))


_CELLS = """, l AS (SELECT node % 12 AS file, dense_rank() OVER (ORDER BY min(step))::INT - 1 AS lane FROM steps GROUP BY node % 12), s AS (SELECT step, parent, node % 12 AS file, 'step ' || node AS label, greatest(56.0, length('step ' || node) * 7.2 + 24.0)::DOUBLE AS w FROM steps WHERE step <= 400),
c AS (SELECT s.*, lane, coalesce(sum(w) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS x FROM s JOIN l USING (file))"""


@query(f"""WITH {H1}{routed(3)}{_CELLS} SELECT 0 AS part, 0::BIGINT AS ord, '<svg xmlns="http://www.w3.org/2000/svg">' AS line UNION ALL SELECT 1, lane, printf('<text class="lane" x="0" y="%.1f">', lane * 56.0 - 4.0) || file || '</text>' FROM l
UNION ALL SELECT 2, c.step, printf('<path class="%s" d="M%.1f %.1f L%.1f %.1f"/>', CASE WHEN c.file <> p.file THEN 'cross' ELSE 'same' END, p.x + p.w, p.lane * 56.0 + 16.0, c.x, c.lane * 56.0 + 16.0) FROM c JOIN c p ON p.step = c.parent WHERE c.file = p.file OR abs(c.lane - p.lane) = 1
UNION ALL SELECT 2, c.step, printf('<path class="cross" d="M%.1f %.1f C%.1f %.1f %.1f %.1f %.1f %.1f"/>', p.x + p.w, p.lane * 56.0 + 16.0, (p.x + p.w + c.x) / 2, p.lane * 56.0 + 16.0, (p.x + p.w + c.x) / 2, c.lane * 56.0 + 16.0, c.x, c.lane * 56.0 + 16.0) FROM c JOIN c p ON p.step = c.parent WHERE abs(c.lane - p.lane) > 1
UNION ALL SELECT 3, step, printf('<g><rect x="%.1f" y="%.1f" width="%.1f" height="32" rx="4"/><text x="%.1f" y="%.1f">%s</text></g>', x, lane * 56.0, w, x + 8.0, lane * 56.0 + 20.0, label) FROM c UNION ALL SELECT 4, 0, '</svg>'""")
def swimlane_svg(spark, d):
    s = _route(spark, d)[1].select("step", "parent", (F.col("node") % 12).alias("file"), F.concat(F.lit("step "), F.col("node").cast("string")).alias("label"))
    return views.swimlane_svg(s)


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)
SELECT page_id, CASE WHEN path NOT LIKE '%/%' THEN '' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS dir, split_part(path, '/', -1) AS base, lower(regexp_extract(split_part(path, '/', -1), '(\\.[^.]*)$', 1)) AS ext, split_part(path, '/', 1) AS module FROM p""")
def path_exprs(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    p = table(spark, d, "pages").select("page_id", path.alias("path"))
    c = F.col("path")
    return p.select("page_id", exprs.dir_name(c).alias("dir"), exprs.base_name(c).alias("base"), exprs.extension_of(c).alias("ext"), F.substring_index(c, "/", 1).alias("module"))


@query("SELECT page_id FROM pages WHERE regexp_matches(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '^(?:.*/)?(?:en|de)/[^/]*.*$')")
def glob_match(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, d, "pages").where(exprs.glob_match(path, ["**/{en,de}/**"])).select("page_id")


@query("SELECT regexp_extract(url, '://([^/]+)', 1) AS module, count(*) AS n_files FROM pages GROUP BY 1")
def url_modules(spark, d):
    return graph.top_modules(table(spark, d, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("module")), 1 << 30)


@query("SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS token FROM documents) GROUP BY token")
def token_scan(spark, d):
    t = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_\\x{80}-\\x{10FFFF}])([A-Z][A-Z0-9_]+)', 1)) AS name FROM documents")
def allcaps_refs(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?:^|[^A-Za-z0-9_\x{80}-\x{10FFFF}])([A-Z][A-Z0-9_]+)"), F.lit(1)))).alias("name")).distinct()


@query("SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS target FROM pages")
def include_scan(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("target"))


@query("WITH o AS (SELECT o_custkey AS id, count(*) AS size FROM orders GROUP BY o_custkey), n AS (SELECT user_id AS id, count(*) AS size FROM events GROUP BY user_id) SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.size <> n.size")
def changed_files(spark, d):
    """The customers of `orders` as the snapshot before, the users of `events` as the one after."""
    from codeatlas.streaming.incremental import changes

    sizes = lambda name, key: table(spark, d, name).groupBy(F.col(key).alias("id")).agg(F.count("*").alias("size"))
    return changes(sizes("orders", "o_custkey"), sizes("events", "user_id"), ["size"])


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def alive_diff(spark, d):
    """Ids of the snapshot before (`documents`) that the one after (`labels`) no longer has."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id")).join(table(spark, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 600 SECONDS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
SELECT user_id AS id, burst::BIGINT AS burst, count(*) AS n_changes, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS last_id FROM s GROUP BY ALL""")
def debounce_sessions(spark, d):
    from codeatlas.streaming.incremental import bursts

    e = table(spark, d, "events").select(F.col("user_id").alias("id"), "ts", "event_id")
    return bursts(e, 600.0)
