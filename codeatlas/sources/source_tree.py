"""Source trees and compile databases as tables."""

from __future__ import annotations

import os
import re
import shlex
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.functions.exprs import EXCLUDE_GLOBS, HEADER_EXT, INCLUDE_GLOBS, SOURCE_EXT, base_name, dir_name, extension_of, glob_match, glob_to_regex, module_of, normalize_path, relative_to
from codeatlas.functions.tables import settle


#: Folders listed by a task of a level, and bytes of files read by a task.
DIRS_A_TASK, BYTES_A_TASK = 64, 64 << 20
#: Bytes of contents that are handed over at once.
HANDED = 8 << 20


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI that all executors see, and the path in it."""
    return fs.FileSystem.from_uri(root if re.match("^[a-z][a-z0-9+.-]*:", root) else os.path.abspath(root))


def _pruned(exclude: list[str]) -> re.Pattern | None:
    """Matches folders that an exclude pattern takes whole: by its head before `/**`, or by all of it."""
    heads = [g[:-3] for g in exclude if g.endswith("/**")]
    return re.compile("|".join(f"(?s:{glob_to_regex(g)})" for g in [*heads, *exclude])) if exclude else None


def walk(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """path (below root), size, mtime_ms of every file; folders that an exclude pattern takes whole are never opened.

    A level at a time: tasks list the folders that the level before found. Links are not followed.
    """
    pruned = _pruned(EXCLUDE_GLOBS if exclude is None else exclude)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _opened(root)
        local = isinstance(system, fs.LocalFileSystem)
        for batch in batches:
            rows = []
            for folder in batch.column(0).to_pylist():
                for info in system.get_file_info(fs.FileSelector(f"{top}/{folder}" if folder else top, recursive=False, allow_not_found=True)):
                    path = f"{folder}/{info.base_name}" if folder else info.base_name
                    if local and os.path.islink(info.path):
                        continue
                    if info.type == fs.FileType.Directory:
                        if not (pruned and pruned.fullmatch(path)):
                            rows.append((path, None, None))
                    elif info.type == fs.FileType.File:
                        rows.append((path, info.size, info.mtime_ns // 1_000_000))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))], names=["path", "size", "mtime_ms"])

    level, n, out = spark.createDataFrame([("",)], "dir string"), 1, None
    while n:
        found = settle(level.repartition(1 + n // DIRS_A_TASK).mapInArrow(listed, "path string, size bigint, mtime_ms bigint"), "walk")
        files = found.where("size is not null")
        out = files if out is None else out.unionByName(files)
        level = found.where("size is null").select(F.col("path").alias("dir"))
        n = level.count()
    return out


def contents(files: DataFrame, root: str) -> DataFrame:
    """files (path, size and more) with content: the text of each, read in tasks; files that went away have none.

    Bytes that are no UTF-8 become replacement characters, so that one odd file ends no scan.
    """
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cols = files.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _opened(root)
        for batch in batches:
            start, size, texts = 0, 0, []
            for i, path in enumerate(batch.column(cols.index("path")).to_pylist()):
                try:
                    with system.open_input_stream(f"{top}/{path}") as f:
                        texts.append(f.read().decode("utf-8", "replace"))
                except FileNotFoundError:
                    texts.append(None)
                size += len(texts[-1] or "")
                if size >= HANDED or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, i + 1 - start).columns, pa.array(texts, pa.string())], names=[*cols, "content"])
                    start, size, texts = i + 1, 0, []

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.repartition(1 + total // BYTES_A_TASK).mapInArrow(read, f"{kinds}, content string")


def list_paths(spark: SparkSession, root: str) -> DataFrame:
    """path (below root) and mtime_ms of every file but those of folders in which no compile database is looked for."""
    return walk(spark, root, [f"**/{d}/**" for d in DB_SKIPPED]).select("path", "mtime_ms")


def list_files(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, max_files: int | None = None, max_bytes: int = 4 << 20) -> DataFrame:
    """path (below root), size, mtime_ms, content, ext, module, source, header, skipped: the files a tree offers.

    Excluded folders are never opened. Files above max_bytes are not read: they keep a row with null content and
    skipped true. A limit takes the first paths in order.
    """
    path = F.col("path")
    exclude = EXCLUDE_GLOBS if exclude is None else exclude
    kept = walk(spark, root, exclude).where(glob_match(path, include or INCLUDE_GLOBS) & ~glob_match(path, exclude))
    if max_files:
        kept = kept.orderBy("path").limit(max_files)
    kept = settle(kept, "listed")
    fits = F.col("size") <= max_bytes
    read = contents(kept.where(fits), root).select("path", "size", "mtime_ms", "content", F.lit(False).alias("skipped"))
    rows = read.unionByName(kept.where(~fits).select("path", "size", "mtime_ms", F.lit(None).cast("string").alias("content"), F.lit(True).alias("skipped")))
    ext = extension_of(path)
    return rows.select("path", "size", "mtime_ms", "content", ext.alias("ext"), module_of(path).alias("module"), ext.isin(*SOURCE_EXT).alias("source"), ext.isin(*HEADER_EXT).alias("header"), "skipped")


#: Where a compile database is looked for first, in order.
DB_PLACES = [
    "compile_commands.json",
    "build/compile_commands.json",
    "out/compile_commands.json",
    "cmake-build-debug/compile_commands.json",
    "cmake-build-release/compile_commands.json",
    "build/Release/compile_commands.json",
    "build/Debug/compile_commands.json",
]
#: Folders that the search for a database leaves out, and the depth below which it ends.
DB_SKIPPED, DB_DEPTH = [".git", "node_modules", "_deps"], 4


def find_compile_db(listed: DataFrame) -> DataFrame:
    """path of the compile database to use, one row or none: the first of DB_PLACES, else the first path of a search.

    listed: path (below the root) of every file.
    """
    found = listed.where(F.col("path").rlike("(^|/)compile_commands[.]json$")).select("path")
    place = F.array_position(F.array(*[F.lit(p) for p in DB_PLACES]), F.col("path"))
    skipped = F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(p) for p in DB_SKIPPED]))
    ranked = found.where((place > 0) | (~skipped & (F.size(F.split("path", "/")) <= DB_DEPTH + 1)))
    return ranked.agg(F.min(F.struct(F.when(place > 0, place).otherwise(1 << 20).alias("rank"), "path")).alias("x")).select("x.path").where("path is not null")


def stale_builds(listed: DataFrame) -> DataFrame:
    """dir of every folder that was configured (CMakeCache.txt) but holds no compile database."""
    folder = lambda name: listed.where(base_name(F.col("path")) == name).select(dir_name(F.col("path")).alias("dir")).distinct()
    return folder("CMakeCache.txt").join(folder("compile_commands.json"), "dir", "left_anti")


def is_stale(listed: DataFrame, used: str | None, indexed_ms: int) -> bool:
    """Whether the compile database to use appeared, moved, or changed after the index was built. listed: path, mtime_ms."""
    row = find_compile_db(listed).join(listed.select("path", "mtime_ms"), "path").first()
    if row is None:
        return used is not None
    return row.path != used or row.mtime_ms > indexed_ms


def line_counts(files: DataFrame) -> DataFrame:
    """module, n_files, n_lines of sources and headers. files: path, content."""
    breaks = F.length("content") - F.length(F.replace("content", F.lit("\n")))
    kept = files.where(extension_of(F.col("path")).isin(*SOURCE_EXT, *HEADER_EXT) & F.col("content").isNotNull())
    return kept.groupBy(module_of(F.col("path")).alias("module")).agg(F.count("*").alias("n_files"), F.sum(breaks + F.when(F.col("content").rlike(r"[^\n]\z"), 1).otherwise(0)).cast("long").alias("n_lines"))


def read_compile_db(spark: SparkSession, path: str, root: str) -> DataFrame:
    """file, flag (include, system, define), value, entry, ord: the flags of every compile command."""
    schema = "directory string, file string, command string, arguments array<string>"
    # one array of one file: its place in the array is the entry's order
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>").alias("all"))
    db = text.select(F.posexplode("all").alias("entry", "e")).select(F.col("entry").cast("long").alias("entry"), "e.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                words = list(r.arguments) if r.arguments is not None else shlex.split(r.command or "", posix="\\" not in (r.command or ""))
                out += [(r.directory, r.file, r.entry, i, k, v) for i, (k, v) in enumerate(flags_of(words))]
            yield pd.DataFrame(out, columns=["directory", "file", "entry", "ord", "flag", "value"])

    rows = db.select("directory", "file", "entry", "command", "arguments").mapInPandas(run, "directory string, file string, entry long, ord long, flag string, value string")
    absolute = lambda c: F.when(F.col(c).rlike("^(/|[A-Za-z]:)"), F.col(c)).otherwise(F.concat("directory", F.lit("/"), c))
    below = lambda c: relative_to(normalize_path(absolute(c)), F.lit(root))
    return rows.select(below("file").alias("file"), "flag", F.when(F.col("flag") == "define", F.col("value")).otherwise(below("value")).alias("value"), "entry", "ord")


def flags_of(words: list[str]) -> Iterator[tuple[str, str]]:
    names = {"-I": "include", "/I": "include", "-isystem": "system", "--include-directory": "include", "-D": "define", "/D": "define"}
    take = None
    for w in words:
        if take:
            yield take, w
            take = None
        elif w in names:
            take = names[w]
        elif w.startswith("--include-directory="):
            yield "include", w.split("=", 1)[1]
        else:
            for k in ("-isystem", "-I", "/I", "-D", "/D"):
                if w.startswith(k) and len(w) > len(k):
                    yield names[k], w[len(k) :]
                    break


def ordered_union(flags: DataFrame, flag: str) -> DataFrame:
    """value, place of a flag's distinct values, in the order of first appearance."""
    return flags.where(F.col("flag") == flag).groupBy("value").agg(F.min(F.struct("entry", "ord")).alias("place")).orderBy("place")
