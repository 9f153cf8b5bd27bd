"""Column expressions on paths, names and identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text prefixes of node ids by kind.
ID_PREFIX = {"file": "file", "function": "func", "class": "class", "enum": "enum", "variable": "var", "macro": "macro", "target": "target"}
#: Extensions of sources, of headers, and of what the checks call a header.
SOURCE_EXT = (".c", ".cc", ".cpp", ".cxx", ".c++", ".inl", ".ipp", ".tcc")
HEADER_EXT = (".h", ".hh", ".hpp", ".hxx", ".h++", ".inc")
CHECK_HEADER_EXT = (".h", ".hpp", ".hh", ".hxx", ".inl")
#: Function names that start a program.
ENTRY_NAMES = ("main", "wmain", "WinMain", "wWinMain", "DllMain", "mainCRTStartup", "wmainCRTStartup")
#: Files read, and folders left out, unless told otherwise.
INCLUDE_GLOBS = ["**/*.{c,cc,cpp,cxx,h,hh,hpp,hxx,inl,ipp}"]
EXCLUDE_GLOBS = ["**/node_modules/**", "**/.git/**", "**/build/**", "**/out/**", "**/CMakeFiles/**", "**/cmake-build-*/**", "**/build-*/**", "**/.cache/**", "**/_deps/**"]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def normalize_path(c: Column) -> Column:
    """`\\` as `/`; `.` and `..` folded; a leading `/` stays, a `..` that leaves a relative path stays too."""
    path = F.translate(c, "\\", "/")
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(acc: Column, p: Column) -> Column:
        size = F.size(acc)
        climbs = (p == "..") & (size > 0) & (F.get(acc, size - 1) != "..")
        kept = F.when((p == "..") & rooted & (size == 0), acc).otherwise(F.concat(acc, F.array(p)))
        return F.when(climbs, F.slice(acc, 1, F.greatest(size - 1, F.lit(0)))).otherwise(kept)

    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(folded, "/"))


def dir_name(c: Column) -> Column:
    """What stands before the last `/`; empty without one, `/` for a child of the root."""
    cut = F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    return F.when(~c.contains("/"), "").when(cut == "", "/").otherwise(cut)


def base_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def suffixes(path: Column) -> Column:
    """A path and all its tails that begin after a `/`: a path ends in a target where the target is one of them."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def extension_of(c: Column) -> Column:
    return ascii_lower(F.regexp_extract(base_name(c), r"(\.[^.]*)$", 1))


def relative_to(path: Column, root: Column) -> Column:
    """The tail of path below root, by a test that ignores ASCII case; path itself if it isn't below."""
    prefix = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(ascii_lower(path), ascii_lower(prefix)), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)


def join_path(a: Column, b: Column) -> Column:
    return F.when(a == "", b).when(b == "", a).when(a.endswith("/"), F.concat(a, b)).otherwise(F.concat(a, F.lit("/"), b))


def module_of(path: Column) -> Column:
    d = dir_name(path)
    return F.when(d == "", ".").otherwise(d)


def simple_name(c: Column) -> Column:
    return F.substring_index(c, "::", -1)


def reference_name(c: Column) -> Column:
    """A referenced name without a destructor's tilde or a leading `::`."""
    return F.regexp_replace(F.regexp_replace(c, "~", ""), "^::", "")


def is_public(path: Column) -> Column:
    return path.rlike("^(include|inc|public|api)/")


def is_header(path: Column) -> Column:
    return path.rlike(r"[^.]\.(h|hpp|hh|hxx|inl)$")


def is_entry_name(name: Column) -> Column:
    return simple_name(name).isin(*ENTRY_NAMES)


def ellipsis_right(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def ellipsis_left(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.lit("…"), F.right(c, F.lit(most - 1)))).otherwise(c)


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def glob_to_regex(glob: str, depth: int = 0) -> str:
    """`**` any path, `**/` any number of folders, `*` within a folder, `?` any character, `{a,b}` either."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + ".", i + 1
        elif c == "{" and depth < 8 and (end := _closing(glob, i)):
            out, i = out + "(?:" + "|".join(glob_to_regex(p, depth + 1) for p in _alternatives(glob[i + 1 : end])) + ")", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return out


def _closing(text: str, at: int) -> int:
    level = 0
    for i in range(at, len(text)):
        level += (text[i] == "{") - (text[i] == "}")
        if not level:
            return i
    return 0


def _alternatives(text: str) -> list[str]:
    parts, level = [""], 0
    for c in text:
        level += (c == "{") - (c == "}")
        if c == "," and not level:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def glob_match(path: Column, globs: list[str]) -> Column:
    """Whether any glob matches the whole path; the pattern is compiled once, on the driver."""
    return path.rlike("^(?s:" + "|".join(glob_to_regex(g) for g in globs) + ")$") if globs else F.lit(False)
