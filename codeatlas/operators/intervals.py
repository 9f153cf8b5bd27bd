"""Nested intervals of a file: what stands around a point, found by one ordered sweep.

An interval is (path, open, close); those of a table are properly nested or apart, as matching braces are. The sweep
counts how many are open at each point. At one level intervals follow one another, so the innermost around a point is
the last that opened at the point's own level: two running windows over points and ends, no join of one with the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.functions.tables import settle


def innermost(points: DataFrame, intervals: DataFrame, at: str, name: str = "inside", level: str | None = None, parts: int | None = None) -> DataFrame:
    """points with `name`: where the innermost interval opens that has `at` strictly inside, null outside all of them.

    points: path, `at` and whatever else; intervals: path, open, close. level: a name for the count of intervals around.
    parts: how many the sweep is dealt over by path, if Spark shall not choose it.
    """
    ends = intervals.select("path", "open", "close").distinct()
    rest = [c for c in points.columns if c != "path"]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    none = F.lit(None).cast(points.select(row.alias("r")).schema["r"].dataType)
    here, side, step, held, now = "_at", "_side", "_step", "_row", "_level"
    # at one place what closes comes first, then points, then what opens
    events = points.select("path", F.col(at).cast("long").alias(here), F.lit(1).alias(side), F.lit(0).alias(step), row.alias(held))
    events = events.unionByName(ends.select("path", F.col("close").cast("long").alias(here), F.lit(0).alias(side), F.lit(-1).alias(step), none.alias(held)))
    events = events.unionByName(ends.select("path", F.col("open").cast("long").alias(here), F.lit(2).alias(side), F.lit(1).alias(step), none.alias(held)))
    events = events.repartition(parts, "path") if parts else events
    so_far = Window.partitionBy("path").orderBy(here, side).rowsBetween(Window.unboundedPreceding, 0)
    counted = events.withColumn(now, F.sum(step).over(so_far))
    same = Window.partitionBy("path", now).orderBy(here, side).rowsBetween(Window.unboundedPreceding, 0)
    opened = counted.withColumn(name, F.last(F.when(F.col(side) == 2, F.col(here)), ignorenulls=True).over(same))
    extra = [F.col(now).cast("int").alias(level)] if level else []
    return opened.where(F.col(side) == 1).select("path", *[F.col(f"{held}.`{c}`").alias(c) for c in rest], F.col(name).cast("int").alias(name), *extra)


def chains(intervals: DataFrame, value: Column, parts: int | None = None) -> DataFrame:
    """path, open, chain: the values of each interval and of all around it, as one array.

    Intervals point to the next one around them; each round doubles how far an interval sees, so a depth of d takes
    log d rounds over the intervals alone.
    """
    own = intervals.groupBy("path", "open", "close").agg(F.array_sort(F.collect_list(value)).alias("chain"))
    state = settle(innermost(own.withColumn("at", F.col("open")), own, "at", "up", "around", parts), "chains")
    depth = state.agg(F.max("around")).first()[0] or 0
    none = F.array().cast(state.schema["chain"].dataType)
    for _ in range(depth.bit_length()):
        state = state.repartition(parts, "path") if parts else state
        above = state.select("path", F.col("open").alias("up"), F.col("up").alias("next"), F.col("chain").alias("more"))
        met = state.join(above, ["path", "up"], "left")
        state = settle(met.select("path", "open", F.col("next").alias("up"), F.concat(F.coalesce("more", none), "chain").alias("chain")), "chains")
    return state.select("path", "open", "chain")
