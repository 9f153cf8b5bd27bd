"""Connected components by alternating large and small stars, on ids alone.

Edges stay distributed; each round is two aggregations and two joins whose result is written to the shared
folder. Sums and minima combine before their shuffles, so a hub costs its own edges once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise

#: Edges for each task of a round, so that few edges don't become many small tasks and files.
EDGES_A_TASK = 50_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("s")).first()
    return tuple(row)


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """u, v edges of any orderable id -> (node, root): the least id each linked node can reach; roots have no row of their own."""
    edges = materialise(_small(edges.select("u", "v").where("u <> v")), "edges")
    state = _state(edges)
    for _ in range(most):
        # stars never have more edges than there were, so the last count bounds what a round handles
        tasks = 1 + state[0] // EDGES_A_TASK
        after = materialise(_small(_large(edges).coalesce(tasks)).coalesce(tasks), "edges")
        new = _state(after)
        drop_table(edges)
        edges = after
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def rooted(labels: DataFrame) -> DataFrame:
    """labels (node, root) with a row for each root too, which `components` leaves out."""
    return labels.select("node", "root").union(labels.select(F.col("root").alias("node"), "root").distinct())


def extended(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node, root) of components that further edges (u, v) join, from their labels before.

    Only the roots that the new edges connect take part in the search; the other labels are looked up once.
    """
    if labels is None:
        return components(edges)
    named = lambda end: labels.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
    met = edges.join(named("u"), "u", "left").join(named("v"), "v", "left")
    between = materialise(met.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")).where("u <> v").distinct(), "between")
    moved = components(between).select(F.col("node").alias("root"), F.col("root").alias("least"))
    old = labels.join(moved, "root", "left").select("node", F.coalesce("least", "root").alias("root"))
    # what moved had no label of its own: it was a root or stood alone
    fresh = moved.select(F.col("root").alias("node"), F.col("least").alias("root"))
    return materialise(old.unionByName(fresh), "labels")
