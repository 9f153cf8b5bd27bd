"""Checks against small models of the rules, on generated graphs."""

import random
from collections import defaultdict

import pytest

from codeatlas.operators import checks
from codeatlas.plans import catalog

NODES = "id string, kind string, file string, module string, external boolean"
EDGES = "src string, dst string, kind string, file string, line long, ord long"
FOLDERS = ["include/w", "src/io", "src/net", "tools", "api"]


def generated(seed, n=18, m=34):
    rng = random.Random(seed)
    names = [f"{rng.choice(FOLDERS)}/u{i}{rng.choice(['.h', '.cc'])}" for i in range(n)]
    arcs = [(rng.choice(names), rng.choice(names), rng.choice(["includes", "includes", "uses"]), rng.randrange(1, 90)) for _ in range(m)]
    return names, [a for a in arcs if a[0] != a[1]]


def frames(spark, names, arcs):
    nodes = [(f, "file", f, f.rsplit("/", 1)[0], False) for f in names]
    rows = [(a, b, kind, a, line, k) for k, (a, b, kind, line) in enumerate(arcs)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(rows, EDGES)


def closed(pairs):
    reach = defaultdict(set)
    for a, b in pairs:
        reach[a].add(b)
    for k in list(reach):
        for a in list(reach):
            if k in reach[a]:
                reach[a] |= reach[k]
    return reach


def model(arcs):
    public = lambda f: f.split("/")[0] in ("include", "inc", "public", "api")
    leaks = {}
    for a, b, _, line in arcs:
        if public(a) and not public(b):
            leaks.setdefault((a, b), line)
    between = defaultdict(list)
    for k, (a, b, kind, line) in enumerate(arcs):
        x, y = a.rsplit("/", 1)[0], b.rsplit("/", 1)[0]
        if kind == "includes" and x != y:
            between[x, y].append((not a.endswith(".h"), k, a, line))
    reach = closed(between)
    cycles = {}
    for x in list(reach):
        group = tuple(sorted({y for y in reach[x] if x in reach[y]} | {x}))
        if len(group) > 1:
            inner = [v for (p, q), v in between.items() if p in group and q in group]
            cycles[group] = (sum(map(len, inner)), min(min(v)[2:] for v in inner))
    return leaks, cycles


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_violations_follow_the_rules(spark, seed):
    names, arcs = generated(seed)
    leaks, cycles = model(arcs)
    rows = checks.violations(*frames(spark, names, arcs)).collect()
    assert {(r.from_file, r.to_file): r.from_line for r in rows if r.kind == "public-api-leak"} == leaks
    assert {tuple(r.dirs): (r.edge_count, (r.from_file, r.from_line)) for r in rows if r.kind == "directory-cycle"} == cycles
    assert [r.kind for r in rows] == sorted(r.kind for r in rows) and all(r.total == len(rows) for r in rows)


def test_a_limit_keeps_the_total(spark):
    names, arcs = generated(5, 30, 80)
    every = checks.violations(*frames(spark, names, arcs)).collect()
    few = checks.violations(*frames(spark, names, arcs), most=2).collect()
    assert few == every[:2] and few[0].total == len(every) > 2
    shown = {r.kind: (r.shown, r.total) for r in checks.summary(spark.createDataFrame(every)).collect()}
    assert sum(n for n, _ in shown.values()) == len(every)
    notes = checks.diagnostics(spark.createDataFrame(every)).collect()
    assert len(notes) == len(every) and all(r.severity == "warning" and r.code.startswith("codeatlas.") for r in notes)


def test_clean_graphs_have_nothing_to_report(spark):
    names = [f"{d}/only.h" for d in FOLDERS]
    assert checks.violations(*frames(spark, names, [(names[1], names[2], "includes", 1), (names[2], names[3], "includes", 1)])).collect() == []
    assert checks.violations(*frames(spark, names, [])).collect() == []


@pytest.mark.parametrize("seed", [6, 7])
def test_strong_components(spark, seed):
    rng = random.Random(seed)
    arcs = {(rng.randrange(14), rng.randrange(14)) for _ in range(18)}
    arcs = {(a, b) for a, b in arcs if a != b}
    reach = closed(arcs)
    want = {a: min({b for b in reach[a] if a in reach[b]} | {a}) for a in list(reach) if any(b != a and a in reach[b] for b in reach[a])}
    got = checks.strong_components(spark.createDataFrame(sorted(arcs), "src long, dst long")).collect()
    assert {r.node: r.component for r in got} == want


def components_of(arcs):
    """Tarjan's components of more than one node, by an explicit stack: node -> least node."""
    out, index, low, on, stack, found = defaultdict(list), {}, {}, set(), [], {}
    for a, b in arcs:
        out[a].append(b)
    for root in sorted({x for arc in arcs for x in arc}):
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root), on.add(root)
        while work:
            node, kids = work[-1]
            for k in kids:
                if k not in index:
                    index[k] = low[k] = len(index)
                    stack.append(k), on.add(k)
                    work.append((k, iter(out[k])))
                    break
                if k in on:
                    low[node] = min(low[node], index[k])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(stack.pop())
                        on.discard(group[-1])
                    if len(group) > 1:
                        found.update((g, min(group)) for g in group)
    return found


def chain(*nodes):
    return list(zip(nodes, nodes[1:]))


SHAPES = {
    "two": [(1, 2), (2, 1)],
    "ring": chain(*range(20), 0),
    "rings and a bridge": chain(*range(9), 0) + [(4, 20)] + chain(20, 21, 22, 20),
    "a loop at a node of nothing else": [(90, 50)] + chain(50, 51, 52, 53, 50) + [(50, 91)],
    "two loops at one node": chain(5, 1, 2, 5) + chain(5, 3, 4, 5),
    "loops on a chain": chain(*range(40)) + chain(7, 60, 7) + chain(30, 61, 62, 12),
    "nothing": chain(*range(30)) + chain(3, 40, 41, 9),
    "itself": [(1, 1), (2, 3)],
}


@pytest.mark.parametrize("name", SHAPES)
def test_components_of_shapes(spark, name):
    got = checks.strong_components(spark.createDataFrame(SHAPES[name], "src long, dst long")).collect()
    assert {r.node: r.component for r in got} == components_of([a for a in SHAPES[name] if a[0] != a[1]])


@pytest.mark.parametrize(("seed", "n", "m"), [(11, 60, 75), (12, 200, 260)])
def test_components_of_sparse_graphs(spark, seed, n, m):
    rng = random.Random(seed)
    arcs = sorted({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)})
    got = checks.strong_components(spark.createDataFrame(arcs, "src string, dst string")).collect()
    want = components_of([a for a in arcs if a[0] != a[1]])
    assert {r.node: r.component for r in got} == want and want


def test_a_chain_of_folders_takes_tens_of_jobs(spark):
    arcs = [(f"d{k:04}", f"d{k + 1:04}") for k in range(1000)] + [("x", "d0500"), ("d0600", "y"), ("y", "x")]
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        got = {r.node for r in checks.strong_components(spark.createDataFrame(arcs, "src string, dst string")).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {f"d{k:04}" for k in range(500, 601)} | {"x", "y"} and jobs < 250


def test_the_summary_counts_past_any_page(spark, tmp_path):
    # events go to and fro between 275 public users and 400 others: 110,000 pairs of files
    pair = "cast(id / 2 as long)"
    user = f"if(id % 2 = 0, 40 * cast({pair} / 400 as long), 40 * ({pair} % 400) + 10)"
    events = spark.range(220_000).selectExpr("id as event_id", "timestamp_seconds(id) as ts", f"{user} as user_id", "'e' as event_type", "1.0D as value")
    events.write.parquet(f"{tmp_path}/events.parquet")
    rows = catalog.QUERIES["violations_summary"](spark, str(tmp_path)).collect()
    assert {r.kind: (r.shown, r.total) for r in rows} == {"public-api-leak": (110_000, 110_001), "directory-cycle": (1, 110_001)}
