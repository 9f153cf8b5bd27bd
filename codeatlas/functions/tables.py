"""Tables in the shared folder, which cut the lineage of iterative plans, and joins with small or hot sides."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes up to which a look-up table is sent to every executor; beyond either its joins shuffle.
LOOKUP_ROWS, LOOKUP_BYTES = 100_000, 32 << 20
#: Parts into which a hot key is dealt where both sides of a look-up shuffle.
SALTS = 32
#: Rows of one key from which a join deals them over parts.
HOT_ROWS = 100_000
PREFIX = "codeatlas-"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor sees; one of our own only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix=PREFIX))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def settle(df: DataFrame, tag: str = "level") -> DataFrame:
    """df, written to the shared folder and read back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{PREFIX}{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a settled table that nothing will read again."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/{PREFIX}" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def width(df: DataFrame) -> Column:
    """About the bytes of a row."""
    fixed, parts = 0, []
    for field in df.schema:
        kind = field.dataType.typeName()
        name = f"`{field.name}`"
        if kind in ("string", "binary"):
            parts.append(F.coalesce(F.octet_length(name), F.lit(0)))
        elif kind in ("array", "map", "struct"):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0)))
        fixed += 8
    return sum(parts, F.lit(fixed)).cast("long")


def is_small(df: DataFrame) -> bool:
    """Whether a count of its rows and bytes proves df small enough for every executor."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(width(df)), F.lit(0))).first()
    return rows <= LOOKUP_ROWS and size <= LOOKUP_BYTES


def shuffled(df: DataFrame) -> DataFrame:
    """df, whose join shuffles both sides. Without the hint Spark broadcasts what takes few bytes of files.

    Its estimate knows neither how far the files are compressed nor how many rows explode() makes of one.
    """
    return df.hint("merge")


def sided(small: DataFrame) -> DataFrame:
    """small, broadcast if it is proven small; else its join shuffles."""
    return F.broadcast(small) if is_small(small) else shuffled(small)


def looked_up(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined with a look-up table of about one row a key; how: inner, left, left_semi or left_anti.

    A proven small table is broadcast. A larger one is repeated SALTS times and each key of rows dealt over as many
    parts, so that a key with a third of all rows is no single task's.
    """
    if is_small(small):
        return rows.join(F.broadcast(small), on, how)
    salt = free_name("salt", rows.columns, small.columns)
    # a hash of the row, not a random number, so that a task that runs again deals its rows alike
    rest = [F.col(f"`{f.name}`") for f in rows.schema if f.name not in on and f.dataType.typeName() not in ("map", "variant")]
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*rest) if rest else F.lit(0), F.lit(SALTS)).cast("int"))
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(shuffled(copies), [*on, salt], how).drop(salt)


def dealt(rows: DataFrame, keyed: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined with a table of one row a key; how: inner, left, left_semi or left_anti.

    A proven small table is broadcast. Else the keys with more than HOT_ROWS rows are counted first, and only these are
    dealt over SALTS parts, with as many copies of their rows of `keyed`; all other keys are shuffled once.
    """
    if is_small(keyed):
        return rows.join(F.broadcast(keyed), on, how)
    hot = settle(rows.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select(*on), "hot")
    if not hot.limit(1).count():
        return rows.join(shuffled(keyed), on, how)
    salt, mark = free_name("salt", rows.columns, keyed.columns), free_name("hot", rows.columns, keyed.columns)
    marked = sided(hot.withColumn(mark, F.lit(True)))
    rest = [F.col(f"`{f.name}`") for f in rows.schema if f.name not in on and f.dataType.typeName() not in ("map", "variant")]
    spread = F.pmod(F.xxhash64(*rest) if rest else F.lit(0), F.lit(SALTS)).cast("int")
    left = rows.join(marked, on, "left").withColumn(salt, F.when(F.col(mark), spread).otherwise(0)).drop(mark)
    copies = F.when(F.col(mark), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = keyed.join(marked, on, "left").withColumn(salt, F.explode(copies)).drop(mark)
    return left.join(shuffled(right), [*on, salt], how).drop(salt)


def running_before(rows: DataFrame, order: str, value: str, name: str, small: bool = False) -> DataFrame:
    """rows with `name`: the sum of value over all rows of a lesser order.

    Where small says that the rows are proven few, in one window; else within ranges of the order, whose totals, one
    number a range, are summed first.
    """
    before = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if small:
        return rows.withColumn(name, before(Window.orderBy(order)))
    part = free_name("range", rows.columns)
    spread = settle(rows.repartitionByRange(order).withColumn(part, F.spark_partition_id()), "ranges")
    total, starts = 0, []
    for r in spread.groupBy(part).agg(F.sum(value).alias("n")).orderBy(part).collect():  # one row a range
        starts.append((r[0], total))
        total += r.n
    first = rows.sparkSession.createDataFrame(starts, f"{part} int, _start long")
    own = Window.partitionBy(part).orderBy(order)
    return spread.join(F.broadcast(first), part).withColumn(name, F.col("_start") + before(own)).drop(part, "_start")


def free_name(name: str, *taken: list[str]) -> str:
    """A column name that none of the lists holds, whatever its case."""
    used = {c.lower() for columns in taken for c in columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
