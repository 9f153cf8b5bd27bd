"""Traversals against sequential models of the queue and the stack."""

import random
from collections import deque

import pytest

from codeatlas.functions import tables
from codeatlas.operators import traverse


def graph(seed, n=14, m=30):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), k) for k in range(m)]


def frame(spark, edges):
    return spark.createDataFrame([(a, b, "calls", k, k) for a, b, k in edges if a != b], "src long, dst long, kind string, line long, ord long")


def queue_model(edges, start, depth, direction, most):
    out, into = {}, {}
    for a, b, _ in edges:
        if a != b:
            out.setdefault(a, []).append(b)
            into.setdefault(b, []).append(a)
    seen, order, work = {start: 0}, [start], deque([start])
    while work:
        if len(order) >= most:
            break
        node = work.popleft()
        if seen[node] >= depth:
            continue
        near = (out.get(node, []) if direction != "upstream" else []) + (into.get(node, []) if direction != "downstream" else [])
        for x in near:
            if x not in seen:
                seen[x] = seen[node] + 1
                order.append(x)
                work.append(x)
    return [(x, i, seen[x]) for i, x in enumerate(order)], len(order) >= most


@pytest.mark.parametrize(("seed", "direction", "most"), [(1, "both", 1000), (2, "downstream", 5), (3, "upstream", 1000), (4, "both", 7)])
def test_subgraph_follows_the_queue(spark, seed, direction, most):
    edges = graph(seed)
    want, cut = queue_model(edges, 0, 3, direction, most)
    got, truncated = traverse.subgraph(frame(spark, edges), 0, 3, direction, most)
    assert sorted((r.node, r.pos, r.depth) for r in got.collect()) == sorted(want)
    assert truncated == cut


def route_model(edges, start, depth, most, deep):
    kids = {}
    for a, b, k in sorted(edges, key=lambda e: (e[2], str(e[1]))):
        if a != b:
            kids.setdefault(a, []).append(b)
    work, seen, out = deque([(start, 0, 0)]), set(), []
    while work and len(out) < most:
        node, parent, d = work.pop() if deep else work.popleft()
        if node in seen:
            continue
        seen.add(node)
        out.append((len(out) + 1, parent, d, node))
        if d < depth:
            near = [(x, len(out), d + 1) for x in kids.get(node, [])]
            work.extend(reversed(near) if deep else near)
    return out


@pytest.mark.parametrize(("seed", "depth", "most"), [(5, 3, 1000), (6, 4, 6), (7, 1, 1000)])
def test_routes_follow_queue_and_stack(spark, seed, depth, most):
    edges = graph(seed)
    df = frame(spark, edges)
    wide = traverse.route(df, 0, depth, most)
    assert sorted(map(tuple, wide.collect())) == route_model(edges, 0, depth, most, False)
    deep = traverse.route_depth_first(df, 0, depth, most)
    assert sorted(map(tuple, deep.collect())) == route_model(edges, 0, depth, most, True)


@pytest.mark.parametrize("direction", ["both", "downstream"])
def test_large_levels_are_numbered_in_ranges_and_hubs_dealt(spark, direction, monkeypatch):
    edges = graph(8, 40, 60) + [(0, k, 100 + k) for k in range(1, 30)]
    df = frame(spark, edges)
    monkeypatch.setattr(traverse, "LOOKUP_ROWS", 0)
    monkeypatch.setattr(tables, "is_small", lambda df: False)
    monkeypatch.setattr(tables, "HOT_ROWS", 10)
    got, _ = traverse.subgraph(df, 0, 3, direction, 1000)
    assert sorted((r.node, r.pos, r.depth) for r in got.collect()) == sorted(queue_model(edges, 0, 3, direction, 1000)[0])
    assert sorted(map(tuple, traverse.route(df, 0, 3, 25).collect())) == route_model(edges, 0, 3, 25, False)


def test_running_sums_by_range(spark):
    rows = spark.createDataFrame([(k * 7 % 101, k) for k in range(101)], "pos long, n long")
    want = {k * 7 % 101: sum(j for j in range(101) if j * 7 % 101 < k * 7 % 101) for k in range(101)}
    for small in (True, False):
        assert {r.pos: r.b for r in tables.running_before(rows, "pos", "n", "b", small).collect()} == want
    assert tables.running_before(rows.limit(0), "pos", "n", "b").count() == 0


def test_fold_moves_children_to_the_nearest_kept_step(spark):
    steps = spark.createDataFrame([(1, 0, 0, 10), (2, 1, 1, 11), (3, 2, 2, 12), (4, 3, 3, 13), (5, 1, 1, 14)], "step long, parent long, depth int, node long")
    dropped = spark.createDataFrame([(2, "b"), (3, "c")], "step long, name string")
    got = {r.node: (r.step, r.parent, r.skipped) for r in traverse.fold(steps, dropped).collect()}
    assert got == {10: (1, 0, ["b", "c"]), 13: (2, 1, []), 14: (3, 1, [])}
