"""Mixing sources to target weights by hash-threshold histograms.

Each row gets a 48-bit hash of its id. A source's budget asks for whole repeats of all its rows plus a
remainder; the rows whose hash lies below a threshold supply the remainder. The threshold is found by summing
sizes over (source, 12 hash bits), walking to the bucket in which the budget ends, and refining that bucket
alone by the next 12 bits. Rows are never sorted; every shuffle carries partial sums.

Null sources form a source of their own, ordered last. Null or empty texts have size 0 and take 0. Rows with
one id share a hash, so they are taken or left together. An empty table gives an empty result; a corpus of
size 0 has targets of 0. `take` keeps all columns of its input. Only the table of sources, one row each, is ordered
in a single task, and of histogram rows one source and prefix at a time (4096 at most).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, free_name, materialise, sided

LEVELS, BITS = 4, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def id_hash(key: Column) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def targets(sizes: DataFrame, max_repeats: int = 3, cycle: int = 3) -> DataFrame:
    """(skey, source, source_size) -> the same with target: shares by weight 1..cycle, capped and reshared.

    One row per source passes through the window; the fixed point of resharing is min(cap, level * weight).
    """
    cap = (F.col("source_size") * max_repeats).cast("double")
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", ((F.row_number().over(by_source) - 1) % cycle + 1).cast("double"))
    filled = Window.orderBy(F.col("full_at"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        ranked.withColumn("cap", cap)
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
        .withColumn("stop", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything))
    )
    target = F.when(F.col("stop").isNull() | (F.col("full_at") < F.col("stop.full_at")), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("stop.level") * F.col("weight"))
    )
    return levels.select("skey", "source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """rows (skey, size, h), budgets (skey, remain) -> (skey, cut): rows with h < cut supply the remainder."""
    open_ = budgets.select("skey", F.col("remain").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = rows.join(open_, "skey").where(F.shiftright("h", shift + BITS) == F.col("prefix"))
        histogram = inside.groupBy("skey", "left", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("sum_size"))
        upto = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        walked = histogram.withColumn("upto", F.sum("sum_size").over(upto)).where(F.col("upto") > F.col("left"))
        edge = walked.groupBy("skey").agg(F.min(F.struct("bucket", "left", "upto", "sum_size")).alias("e"))
        if level + 1 < LEVELS:
            open_ = edge.select("skey", (F.col("e.left") - F.col("e.upto") + F.col("e.sum_size")).alias("left"), F.col("e.bucket").alias("prefix"))
    nearer = 2 * F.col("e.left") >= 2 * F.col("e.upto") - F.col("e.sum_size")
    return edge.select("skey", (F.col("e.bucket") + F.when(nearer, 1).otherwise(0)).alias("cut"))


def _keyed(docs: DataFrame, doc_id: str, text: str, source: str) -> list[Column]:
    return [
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")).alias("_skey"),
        word_count(F.col(text)).alias("_size"),
        id_hash(F.col(doc_id)).alias("_h"),
    ]


def budget(rows: DataFrame, max_repeats: int, cycle: int) -> DataFrame:
    """rows (_skey, source, _size, _h) -> _skey, source_size, target, whole, cut: one row a source."""
    rows = rows.select(F.col("_skey").alias("skey"), "source", F.col("_size").alias("size"), F.col("_h").alias("h"))
    sizes = rows.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    plan = materialise(targets(sizes, max_repeats, cycle).withColumn("whole", whole).withColumn("remain", F.col("target") - F.col("whole") * F.col("source_size")), "mixplan")
    cuts = thresholds(rows.select("skey", "size", "h"), plan.where("remain > 0"))
    chosen = plan.join(cuts, "skey", "left").select(F.col("skey").alias("_skey"), "source_size", "target", "whole", F.coalesce("cut", F.lit(0)).alias("cut"))
    return sided(materialise(chosen, "mixcut"))


def _repeats() -> Column:
    return F.col("whole") + F.when(F.col("_h") < F.col("cut"), 1).otherwise(0)


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", max_repeats: int = 3, cycle: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken and repeats for every row."""
    rows = materialise(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), *_keyed(docs, doc_id, text, source)), "mix")
    joined = rows.join(budget(rows, max_repeats, cycle), "_skey")
    return joined.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * _repeats()).cast("long").alias("taken"), _repeats().cast("int").alias("repeats"))


def take(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", max_repeats: int = 3, cycle: int = 3) -> DataFrame:
    """docs with every row as often as the mix takes it; copy_no counts a row's copies from 1.

    If docs has a column copy_no, the new one is called _copy_no.
    """
    keys = _keyed(docs, doc_id, text, source)
    rows = materialise(docs.select(F.col(source).alias("source"), *keys), "mix")
    skey, h, whole, cut, copy_no = (free_name(c, docs.columns) for c in ("skey", "h", "whole", "cut", "copy_no"))
    plan = budget(rows, max_repeats, cycle).select(F.col("_skey").alias(skey), F.col("whole").alias(whole), F.col("cut").alias(cut))
    joined = docs.select("*", keys[0].alias(skey), keys[2].alias(h)).join(plan, skey)
    repeats = (F.col(whole) + F.when(F.col(h) < F.col(cut), 1).otherwise(0)).cast("int")
    return joined.where(repeats > 0).select(*[f"`{c}`" for c in docs.columns], F.explode(F.sequence(F.lit(1), repeats)).alias(copy_no))


#: The same result by sorting: what the thresholds find, from running sums over each source's hash order.
ORACLE_SQL = """
WITH r AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM r GROUP BY source
), c AS (
  SELECT *, (source_size * 3)::DOUBLE AS cap, (source_size * 3)::DOUBLE / weight AS full_at FROM s
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM c)::DOUBLE - coalesce(sum(cap) OVER w, 0))
            / ((SELECT sum(weight) FROM c) - coalesce(sum(weight) OVER w, 0)) AS level
  FROM c WINDOW w AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT full_at AS stop_at, level AS stop_level FROM l WHERE level <= full_at ORDER BY full_at, level LIMIT 1
), t AS (
  SELECT source, source_size,
         CASE WHEN stop_at IS NULL OR full_at < stop_at THEN cap ELSE least(cap, stop_level * weight) END AS target
  FROM l LEFT JOIN f ON true
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS whole FROM t
), g AS (
  SELECT r.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS remain,
         sum(size) OVER (PARTITION BY r.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY r.source, h) AS own
  FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN remain > 0 AND (upto <= remain OR (upto - own <= remain AND 2 * (remain - (upto - own)) >= own)) THEN 1 ELSE 0 END))::BIGINT AS taken,
       (whole + CASE WHEN remain > 0 AND (upto <= remain OR (upto - own <= remain AND 2 * (remain - (upto - own)) >= own)) THEN 1 ELSE 0 END)::INT AS repeats
FROM g
"""
