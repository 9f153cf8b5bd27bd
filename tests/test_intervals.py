"""What stands around a point, against a stack, on generated brackets."""

import random

import pytest
from pyspark.sql import functions as F

from codeatlas.operators.intervals import chains, innermost


def generated(seed, n):
    """Properly nested intervals of n brackets, closed ones alone."""
    rng, stack, found = random.Random(seed), [], []
    for i in range(n):
        if stack and rng.random() < 0.5:
            found.append((stack.pop(), i))
        elif rng.random() < 0.6:
            stack.append(i)
    return found


def around(found, at):
    return sorted(a for a, b in found if a < at < b)


@pytest.mark.parametrize("seed", [1, 2])
def test_innermost_and_chains(spark, seed):
    files = {f"f{k}": generated(10 * seed + k, 60) for k in range(4)} | {"deep": [(i, 200 - i) for i in range(90)], "flat": [(2 * i, 2 * i + 1) for i in range(30)], "none": []}
    rows = spark.createDataFrame([(p, a, b, f"{p}:{a}") for p, found in files.items() for a, b in found], "path string, open int, close int, name string")
    points = spark.createDataFrame([(p, at, p * 2) for p in files for at in range(-1, 202)], "path string, at int, inside string")
    got = {(r.path, r["at"]): (r.x, r.n, r.inside) for r in innermost(points, rows, "at", "x", "n").collect()}
    assert len(got) == len(files) * 203
    for (p, at), (x, n, kept) in got.items():
        want = around(files[p], at)
        assert x == (want[-1] if want else None) and n == len(want) and kept == p * 2
    seen = {(r.path, r.open): r.chain for r in chains(rows, F.struct("open", "name")).collect()}
    assert len(seen) == rows.count()
    for (p, at), chain in seen.items():
        assert [c.open for c in chain] == [*around(files[p], at), at] and all(c.name == f"{p}:{c.open}" for c in chain)


def test_several_values_of_one_interval(spark):
    rows = spark.createDataFrame([("a", 1, 9, "x"), ("a", 1, 9, "y"), ("a", 2, 4, "z")], "path string, open int, close int, name string")
    assert {r.open: r.chain for r in chains(rows, F.col("name")).collect()} == {1: ["x", "y"], 2: ["x", "y", "z"]}
    assert chains(rows.limit(0), F.col("name")).count() == 0
