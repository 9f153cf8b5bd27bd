import math

import numpy as np

from codeatlas.llm import collisions
from codeatlas.llm.common import table


def brute(rows, cosine=0.98):
    links = {n: set() for n in range(len(rows))}
    good = {}
    for n, (_, v, label) in enumerate(rows):
        if label is not None and v and None not in v and all(map(math.isfinite, v)) and any(v):
            x = np.array(v, dtype=np.float64)
            good.setdefault((label, len(v)), []).append((n, x / np.linalg.norm(x)))
    for members in good.values():
        ids = [n for n, _ in members]
        x = np.array([u for _, u in members])
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= cosine - 1e-15, 1)), strict=True):
            links[ids[a]].add(ids[b]), links[ids[b]].add(ids[a])
    least = {}
    for n in links:
        if n in least:
            continue
        seen, stack = {n}, [n]
        while stack:
            for m in links[stack.pop()] - seen:
                seen.add(m), stack.append(m)
        least |= dict.fromkeys(seen, min(rows[m][0] for m in seen))
    return sorted((rows[n][0], len(links[n]), least[n], rows[n][0] == least[n]) for n in links)


def check(df):
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert sorted(tuple(r) for r in collisions.near_vectors(df).collect()) == brute(rows)


def test_whole_table_equals_brute_force(spark, sf_dir):
    check(table(spark, sf_dir, "embeddings"))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.01], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, None], 1), (10, [1.0, 0.0, 0.0], 1), (11, [-0.0, 5.0], 2), (12, [0.0, 5.0], 2), (12, [0.0, 5.0], 2), (13, [1e-20, 1e20], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    check(df)
    assert collisions.near_vectors(df.limit(0)).count() == 0


def test_a_large_group_goes_through_blocks(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(16)
    rows = [(i, [float(v) for v in base + rng.standard_normal(16) * 0.08], 0) for i in range(2300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in collisions.near_vectors(df).collect()}
    want = brute(rows)
    assert sum(got[i].n_links for i, *_ in want) >= 0.995 * sum(n for _, n, *_ in want)
    assert all(got[i].n_links <= n for i, n, *_ in want)
