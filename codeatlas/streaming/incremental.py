"""Incremental rebuilds: differences of snapshots, debounced changes, and a streaming update path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, compared: list[str]) -> DataFrame:
    """id, change: added, removed, or changed where any compared column differs. One shuffle on id."""
    a = old.select("id", F.struct(*compared).alias("old"))
    b = new.select("id", F.struct(*compared).alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return a.join(b, "id", "full").select("id", kind.alias("change")).where("change is not null")


def reusable(cached: DataFrame, current: DataFrame, fingerprint: str) -> DataFrame:
    """Rows of the cached analysis that hold: same fingerprint, and a current file of equal mtime and size."""
    same = cached.where(F.col("fingerprint") == fingerprint)
    return same.join(current.select("file", "mtime_ms", "size"), ["file", "mtime_ms", "size"], "left_semi")


def bursts(events: DataFrame, quiet_seconds: float) -> DataFrame:
    """id, burst, n_changes, last_id: changes of one id closer together than the quiet time are one burst."""
    order = Window.partitionBy("id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    near = micros - F.lag(micros).over(order) < quiet_seconds * 1e6
    marked = events.withColumn("burst", F.sum(F.when(near, 0).otherwise(1)).over(order))
    return marked.groupBy("id", "burst").agg(F.count("*").alias("n_changes"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"))


def debounced(stream: DataFrame, quiet: str = "400 milliseconds", late: str = "10 seconds") -> DataFrame:
    """A stream of file, ts, content -> one row a burst with its last content, when the burst has gone quiet."""
    last = F.max_by(F.struct("ts", "content"), "ts").alias("last")
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", quiet).alias("w"), "file").agg(F.count("*").alias("n_changes"), last).select("file", "n_changes", "last.ts", "last.content")


def follow(stream: DataFrame, state_path: str, rebuild: Callable[[DataFrame], None], checkpoint: str):
    """Keeps the latest content of every file as a table and calls rebuild with it after each batch.

    A null content deletes the file. The state is written anew and swapped by number, so a batch that is run
    again after a failure gives the same table.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        latest = batch.groupBy("file").agg(F.max_by(F.struct("ts", "content"), "ts").alias("x")).select("file", "x.ts", "x.content")
        if number:
            before = spark.read.parquet(f"{state_path}/v{number - 1}")
            latest = before.join(latest, "file", "left_anti").unionByName(latest)
        latest.where(F.col("content").isNotNull()).write.mode("overwrite").parquet(f"{state_path}/v{number}")
        rebuild(spark.read.parquet(f"{state_path}/v{number}"))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
