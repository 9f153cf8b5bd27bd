"""A graph that follows its files: what is extracted lies in buckets by file, and a change rewrites only those it touches.

`facts` holds one row a file: its text's symbols, references and includes; deleted files leave a row without them, so
that a change that comes late or twice is known as such. `edges` holds one row a file too: every edge that starts from
its references and includes. Both are partitioned by a hash of the file. A batch extracts its own files, and then looks
up again only those files whose references ask for a name that the batch's files gained, lost or moved, or whose includes
end in the name of a file that came or went. What a batch may affect is written before anything else changes, so a
batch that failed half-way is finished by the next run of it.

Edges belong to a generation: the include paths they were found with. Another compile database gives a new generation,
written beside the old one, which is served until the new one is whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeatlas.functions.exprs import base_name, simple_name
from codeatlas.functions.tables import drop_table, settle, sided
from codeatlas.operators import build, extract

FACTS = (
    "file string, ts timestamp, content string, "
    "symbols array<struct<id:string,kind:string,name:string,qualified:string,file:string,sym_ord:bigint,line:int,column:int,signature:string,declaration:boolean,body_lines:int,precision:string,public:boolean,module:string>>, "
    "refs array<struct<from_id:string,name:string,kind:string,file:string,line:int,ref_ord:bigint>>, includes array<struct<file:string,target:string,line:int,ord:int>>, bucket int"
)
EDGES = "file string, edges array<struct<src:string,dst:string,kind:string,precision:string,file:string,line:int,ord:struct<stage:int,file:string,n:bigint,place:bigint>,external:boolean,name:string,missing:boolean>>, bucket int"


class LiveGraph:
    """The tables below `path`, which all executors see."""

    def __init__(self, spark: SparkSession, path: str, *, search: Sequence[str] = (), buckets: int = 256, kinds: extract.Kinds = extract.Kinds(), most_hits: int = 3) -> None:
        self.spark, self.path, self.buckets, self.kinds, self.most_hits = spark, path.rstrip("/"), buckets, kinds, most_hits
        self.first_search = list(search)

    # -- tables

    def _fs(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, prefix: str) -> list[str]:
        """The folders of the store that begin with prefix: a handful."""
        fs, root = self._fs("")
        return sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith(prefix)) if fs.exists(root) else []

    def _drop(self, name: str) -> None:
        fs, path = self._fs(name)
        fs.delete(path, True)

    def _read(self, name: str, schema: str) -> DataFrame:
        if name not in self._names(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("file"), F.lit(self.buckets)).cast("int"))

    def _replace(self, name: str, schema: str, rows: DataFrame) -> list[int]:
        """Puts rows (one a file) in place of their files' rows; returns the buckets that were written anew."""
        rows = settle(self._bucketed(rows), "rows")
        touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # `buckets` at most
        old = self._read(name, schema).where(F.col("bucket").isin(touched)).join(sided(rows.select("file")), "file", "left_anti")
        merged = settle(old.select(*rows.columns).unionByName(rows), "merged")
        merged.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/{name}")
        drop_table(merged), drop_table(rows)
        return touched

    def facts(self) -> DataFrame:
        return self._read("facts", FACTS)

    def files(self) -> DataFrame:
        """path, content of the files there are."""
        return self.facts().where("content is not null").select(F.col("file").alias("path"), "content")

    def symbols(self) -> DataFrame:
        return self.facts().select(F.explode("symbols").alias("s")).select("s.*")

    def generation(self) -> tuple[int, list[str]]:
        """The number of the generation that is served, and its include paths."""
        done = [int(n.split("-")[1]) for n in self._names("generation-")]
        if not done:
            return 0, self.first_search
        return max(done), list(self.spark.read.parquet(f"{self.path}/generation-{max(done)}").first().search)

    # -- changes

    def update(self, changed: DataFrame) -> dict[str, list[int]]:
        """Takes changed files (file, ts, content; null: gone). Returns the buckets of facts and of edges written anew.

        Of several changes of a file the last counts, and one that is not later than what is known counts for nothing.
        """
        held = self.facts().select("file", F.col("ts").alias("old_ts"), F.col("symbols").alias("old_symbols"), F.col("content").isNotNull().alias("was"))
        latest = changed.groupBy("file").agg(F.max_by(F.struct("ts", "content"), "ts").alias("x")).select("file", F.col("x.ts").cast("timestamp").alias("ts"), "x.content")
        fresh = settle(latest.join(held, "file", "left").where(F.col("old_ts").isNull() | (F.col("ts") > F.col("old_ts"))), "fresh")
        out: dict[str, list[int]] = {"facts": [], "edges": []}
        if fresh.limit(1).count():
            facts = settle(self._extracted(fresh.select("file", "ts", "content")), "facts")
            self._pending(fresh, facts)
            out["facts"] = self._replace("facts", FACTS, facts)
            drop_table(facts)
        pending = self._names("pending-")
        if pending:
            number, search = self.generation()
            out["edges"] = self._relink(f"edges-{number}", search, self._affected(pending))
            for name in pending:
                self._drop(name)
        drop_table(fresh)
        return out

    def _extracted(self, files: DataFrame) -> DataFrame:
        symbols, refs, includes = extract.extract(files.select(F.col("file").alias("path"), "content"), self.kinds)
        lists = lambda df, name: df.groupBy("file").agg(F.collect_list(F.struct(*df.columns)).alias(name))  # noqa: E731 - one file's rows
        return files.join(lists(symbols, "symbols"), "file", "left").join(lists(refs, "refs"), "file", "left").join(lists(includes, "includes"), "file", "left")

    def _pending(self, fresh: DataFrame, facts: DataFrame) -> None:
        """Writes what a batch may affect: kind (file, symbol or base) and key."""
        seen = lambda c: F.array_sort(F.transform(F.coalesce(c, F.array()), lambda s: F.struct(s["id"], s["kind"], s["qualified"], s["name"], s["sym_ord"])))
        met = fresh.select("file", "old_symbols", "was", (F.col("content").isNotNull()).alias("stays")).join(facts.select("file", "symbols"), "file")
        moved = met.where(seen(F.col("symbols")) != seen(F.col("old_symbols"))).select(F.explode(F.concat(F.coalesce("symbols", F.array()), F.coalesce("old_symbols", F.array()))).alias("s"))
        names = moved.select(F.lit("symbol").alias("kind"), F.explode(F.array("s.qualified", "s.name")).alias("key"))
        came = met.where(F.coalesce("was", F.lit(False)) != F.col("stays")).select(F.lit("base").alias("kind"), F.lower(base_name(F.col("file"))).alias("key"))
        own = met.select(F.lit("file").alias("kind"), F.col("file").alias("key"))
        names.unionByName(came).unionByName(own).distinct().write.parquet(f"{self.path}/pending-{uuid.uuid4().hex}")

    def _affected(self, pending: list[str]) -> DataFrame:
        """file of every file whose edges may differ."""
        keys = settle(self.spark.read.schema("kind string, key string").parquet(*[f"{self.path}/{n}" for n in pending]).distinct(), "keys")
        of = lambda kind: sided(keys.where(F.col("kind") == kind).select("key"))
        facts = self.facts()
        asked = facts.select("file", F.explode("refs.name").alias("raw")).select("file", F.explode(F.array(build.reference_name(F.col("raw")), simple_name(build.reference_name(F.col("raw"))))).alias("key"))
        targets = facts.select("file", F.explode("includes.target").alias("t")).select("file", F.lower(base_name(F.translate("t", "\\", "/"))).alias("key"))
        own = keys.where("kind = 'file'").select(F.col("key").alias("file"))
        return settle(own.union(asked.join(of("symbol"), "key", "left_semi").select("file")).union(targets.join(of("base"), "key", "left_semi").select("file")).distinct(), "affected")

    def _relink(self, name: str, search: list[str], affected: DataFrame | None) -> list[int]:
        """Finds the edges of the affected files, or of all, and puts them into the table."""
        facts = self.facts()
        part = facts if affected is None else facts.join(sided(affected), "file", "left_semi")
        rows = lambda c: part.select(F.explode(c).alias("x")).select("x.*")
        paths = facts.where("content is not null").select(F.col("file").alias("path"))
        wide = build.wide_edges(paths, self.symbols(), rows("refs"), rows("includes"), search, self.most_hits, few=affected is not None)
        cols = [f.name for f in StructType.fromDDL(EDGES)["edges"].dataType.elementType]
        found = wide.groupBy("file").agg(F.collect_list(F.struct(*cols)).alias("edges"))  # one file's edges
        files = part.select("file")
        return self._replace(name, EDGES, files.join(found, "file", "left").select("file", "edges"))

    def rescan(self, search: Sequence[str]) -> int:
        """Finds all edges anew with other include paths; the old ones are served until that is done. Returns the generation."""
        before, known = self.generation()
        if list(search) == known:
            return before
        number = before + 1
        self._drop(f"edges-{number}")  # what an earlier try left
        self._relink(f"edges-{number}", list(search), None)
        self.spark.createDataFrame([(number, list(search))], "number int, search array<string>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/generation-{number}")
        for name in [f"edges-{before}", f"generation-{before}"]:
            self._drop(name)
        return number

    # -- the graph

    def graph(self, include_external: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
        """nodes, edges and counts, equal to those of a full build of the files there are."""
        number, _ = self.generation()
        wide = self._read(f"edges-{number}", EDGES).select(F.explode("edges").alias("e")).select("e.*")
        return build.assembled(self.files().select("path"), self.symbols(), settle(wide, "edges"), include_external=include_external)


def follow_files(stream: DataFrame, live: LiveGraph, checkpoint: str):
    """Keeps a live graph up to date with a stream of file, ts, content (null: gone)."""
    return stream.writeStream.foreachBatch(lambda batch, _: live.update(batch)).option("checkpointLocation", checkpoint).start()


def follow_database(stream: DataFrame, live: LiveGraph, checkpoint: str, quiet: str = "800 milliseconds", late: str = "10 seconds"):
    """Starts another generation when the compile database has changed and then been quiet. stream: path (of it), ts, search (include paths)."""
    last = F.max_by(F.struct("ts", "search"), "ts").alias("last")
    settled = stream.withWatermark("ts", late).groupBy(F.session_window("ts", quiet).alias("w"), "path").agg(last).select("last.ts", "last.search")

    def apply(batch: DataFrame, _: int) -> None:
        row = batch.orderBy(F.desc("ts")).first()
        if row is not None:
            live.rescan(row.search)

    return settled.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
