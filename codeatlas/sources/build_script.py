"""Build scripts: targets, their sources and what they link."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.functions.exprs import base_name, dir_name, join_path, normalize_path, suffixes
from codeatlas.functions.tables import settle, sided

#: Words of the commands that name no file or library.
KEYWORDS = {
    "PRIVATE", "PUBLIC", "INTERFACE", "REQUIRED", "QUIET", "STATIC", "SHARED", "MODULE", "OBJECT", "IMPORTED", "ALIAS", "EXCLUDE_FROM_ALL", "WIN32", "MACOSX_BUNDLE",
    "CONFIG", "COMPONENTS", "EXPORT", "GLOBAL", "UNKNOWN", "NO_SYSTEM_FROM_IMPORTED",
}
#: The scripts that are read, and folders in which none are looked for.
SCRIPTS = ["**/CMakeLists.txt"]
PASSED_OVER = ["**/build/**", "**/_deps/**", "**/.git/**", "**/out/**", "**/node_modules/**", "**/cmake-build-*/**"]
_COMMAND = re.compile(r"(?im)^[^#\n]*?\b(add_executable|add_library|target_link_libraries|link_libraries|find_package)\s*\(([^)]*)\)")
_WORD = re.compile(r'"([^"]*)"|([^\s"]+)')


def parse(text: str) -> list[tuple[str, str, str, int]]:
    """(target, relation, value, line) rows: relation is kind, source, link or package.

    link_libraries takes its first word as a target, like target_link_libraries; a package has no target.
    """
    text = re.sub(r"#\[\[.*?\]\]", "", text, flags=re.S)
    rows = []
    for m in _COMMAND.finditer(re.sub(r"#[^\n]*", "", text)):
        line = text.count("\n", 0, m.start(1)) + 1
        words = [a or b for a, b in _WORD.findall(m[2])]
        if not words or "${" in words[0]:
            continue
        name, rest, command = words[0], words[1:], m[1].lower()
        plain = [w for w in rest if w not in KEYWORDS and not w.startswith("$<")]
        if command == "find_package":
            rows.append(("", "package", name, line))
        elif command in ("target_link_libraries", "link_libraries"):
            rows += [(name, "link", w, line) for w in dict.fromkeys(plain) if "${" not in w]
        else:
            rows.append((name, "kind", "executable" if command == "add_executable" else "library", line))
            rows += [(name, "source", w, line) for w in plain if "${" not in w]
    return rows


def targets(files: DataFrame) -> DataFrame:
    """target, relation, value, line, file from files (path, content) named CMakeLists.txt."""
    scripts = files.where(base_name(F.col("path")) == "CMakeLists.txt").select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*r, path) for path, text in pdf.itertuples(index=False) for r in parse(text or "")]
            yield pd.DataFrame(rows, columns=["target", "relation", "value", "line", "file"])

    return scripts.mapInPandas(run, "target string, relation string, value string, line long, file string")


def definitions(rows: DataFrame) -> DataFrame:
    """target, kind, file, line of every command that defines a target. rows: those of targets."""
    return rows.where("relation = 'kind'").select("target", F.col("value").alias("kind"), "file", "line")


def listed_sources(rows: DataFrame) -> DataFrame:
    """target, file, line, listed: the sources of each definition, as paths below the root."""
    value = F.col("value")
    return rows.where("relation = 'source'").select("target", "file", "line", normalize_path(F.when(value.startswith("/"), value).otherwise(join_path(dir_name(F.col("file")), value))).alias("listed"))


def linked_libraries(rows: DataFrame) -> DataFrame:
    """target, file, line (those of the definition), library, place: what a defined target links, once each, itself left out.

    A command links what was defined before it, in the order of files and lines.
    """
    links = rows.where("relation = 'link' and target <> value").select("target", F.col("value").alias("library"), F.struct("file", "line").alias("place"))
    met = definitions(rows).select("target", "file", "line").join(links, "target").where(F.struct("file", "line") < F.col("place"))
    return met.groupBy("target", "file", "line", "library").agg(F.min("place").alias("place"))


def target_sources(listed: DataFrame, files: DataFrame) -> DataFrame:
    """target, source: every file equal to what a target lists, or ending in it. listed: target, listed.

    A file's tails are keys, so only those that some target lists are ever shuffled.
    """
    wanted = sided(settle(listed.select("listed").distinct(), "listed"))
    tails = files.select(F.col("path").alias("source"), F.explode(suffixes(F.col("path"))).alias("listed")).join(wanted, "listed", "left_semi")
    return listed.join(tails, "listed").select("target", "source").distinct()


def target_links(links: DataFrame, known: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """target, dst, external and the columns to keep: a library that is a target here, or an external one. links: target, library."""
    here = sided(settle(known.select(F.col("name").alias("library"), F.lit(True).alias("here")).distinct(), "libraries"))
    met = links.join(here, "library", "left")
    inside = F.coalesce("here", F.lit(False))
    return met.select("target", F.concat(F.when(inside, "target:").otherwise("ext:target:"), "library").alias("dst"), (~inside).alias("external"), *(keep or []))
