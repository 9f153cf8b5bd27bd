"""Symbols, references and includes of C and C++ files, as windows and joins over a table of tokens.

A file's text becomes token rows by one pattern. Lines, depths, statements and matching braces are running sums and
neighbours within a file; definitions, bases, calls and scopes are filters and joins on single places, and what stands
around a place comes from one sweep of the file (intervals). So a file costs the sort of its tokens, not its functions
times its tokens. No row of the result depends on more than its own file, so files are dealt over parts of PART_BYTES
of text, as many as that takes: a task's sorts don't grow with the tree. A file is bounded by the reader's size limit.

In: files (path, content). Null or empty contents give no rows. Differences from a strict parser are those of a
structural one: no templates are instantiated and no `#if` is evaluated.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.functions.exprs import ID_PREFIX, is_public, module_of
from codeatlas.functions.tables import settle
from codeatlas.operators.intervals import chains, innermost

#: Words that are part of a type or a storage class, but not its name.
QUALIFIERS = ["const", "volatile", "static", "inline", "constexpr", "consteval", "constinit", "extern", "virtual", "explicit", "friend", "mutable", "register", "thread_local", "typename", "unsigned", "signed", "short", "long", "struct", "union", "enum", "auto"]
#: Words that show a statement rather than a declaration.
STATEMENTS = ["return", "if", "else", "while", "for", "switch", "case", "default", "do", "goto", "break", "continue", "throw", "new", "delete", "co_return", "co_await", "co_yield"]
#: Types of the language, which are no dependencies.
BUILTIN = ["void", "bool", "char", "char8_t", "char16_t", "char32_t", "wchar_t", "short", "int", "long", "float", "double", "unsigned", "signed", "size_t", "ssize_t", "auto"]
#: The language's keywords, which name neither functions nor types.
KEYWORDS = (
    "alignas alignof and asm auto bool break case catch char char8_t char16_t char32_t class concept const consteval constexpr constinit const_cast continue co_await co_return co_yield "
    "decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable namespace new noexcept not nullptr operator or "
    "private protected public register reinterpret_cast requires return short signed sizeof static static_assert static_cast struct switch template this thread_local throw true try typedef "
    "typeid typename union unsigned using virtual void volatile wchar_t while xor"
).split()
#: Words that may stand beside a base class.
ACCESS = ["public", "private", "protected", "virtual", *QUALIFIERS]
#: Words that begin a statement which declares no variable, or no member.
NO_VARIABLE = ["using", "typedef", "template", "namespace", "extern", "class", "struct", "enum", "union", "return", "friend"]
NO_MEMBER = ["using", "typedef", "friend", "static_assert", "template", "return"]

#: Bytes of text whose tokens one task sorts, and the least worth a task of its own. A sort takes about 50 times its text.
PART_BYTES, LEAST_BYTES = 1 << 20, 1 << 16

_LEX = "|".join(
    [
        r"(?m:^)[ \t]*+#(?:[^\n\\/\"]++|\"(?:[^\"\\\n]++|\\[\s\S])*+\"?|/\*(?s:.*?)(?:\*/|\z)|//(?:[^\n\\]++|\\[\s\S])*+|\\[\s\S]|[/\\])*+",  # a directive and the lines it goes on in
        r"//(?:[^\n\\]++|\\[\s\S])*+",
        r"/\*(?s:.*?)(?:\*/|\z)",
        r"(?:u8|[uUL])?R\"([^()\\ \n]{0,16})\((?s:.*?)(?:\)\1\"|\z)",
        r"(?:u8|[uUL])?\"(?:[^\"\\\n]++|\\[\s\S])*+\"?",
        r"(?:u8|[uUL])?'(?:[^'\\\n]++|\\[\s\S])*+'?",
        r"\.?[0-9](?:[eEpP][+-]|'?[0-9A-Za-z_.])*+",
        r"[A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_\x{80}-\x{10FFFF}]*+",
        "::",
        "->",
        r"[ \t\r\f\x0B]++",
        r"(?s:.)",
    ]
)


@dataclass(frozen=True)
class Kinds:
    """What is extracted; links: targets of build scripts and what they link. bare_calls: a call statement without a type before it counts as a declaration."""

    includes: bool = True
    calls: bool = True
    types: bool = True
    symbols: bool = True
    links: bool = True
    bare_calls: bool = False


def _over(*order, by: tuple = ("path",)):
    return Window.partitionBy(*by).orderBy(*(order or ("idx",)))


def _so_far(window):
    return window.rowsBetween(Window.unboundedPreceding, 0)


def _before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def pieces(files: DataFrame) -> DataFrame:
    """path, place, raw, line, column of every piece of a file, comments and spaces too."""
    cut = files.select("path", F.posexplode(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(_LEX), F.lit(0))).alias("place", "raw"))
    breaks = F.length("raw") - F.length(F.replace("raw", F.lit("\n")))
    w = _before(_over("place"))
    tail = F.length(F.substring_index("raw", "\n", -1))
    lined = cut.withColumn("breaks", breaks).withColumn("line", (1 + F.coalesce(F.sum("breaks").over(w), F.lit(0))).cast("int"))
    # the column counts from the last piece that holds a line break
    lined = lined.withColumn("width", F.when(F.col("breaks") > 0, tail).otherwise(F.length("raw"))).withColumn("end_line", F.col("line") + F.col("breaks"))
    same = Window.partitionBy("path", "end_line").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    column = F.when(F.col("breaks") > 0, 1).otherwise((1 + F.coalesce(F.sum("width").over(same), F.lit(0))))
    return lined.select("path", "place", "raw", "line", column.cast("int").alias("column"))


def tokens(cut: DataFrame) -> DataFrame:
    """path, idx, text, ident, line, column, depth and parens (before the token), from pieces.

    A string is one empty token `""`; comments, characters, numbers, spaces and directives are none.
    """
    raw = F.col("raw")
    text = F.when(raw.rlike("^(?:u8|[uUL])?R?\""), F.lit('""')).otherwise(raw)
    nothing = raw.rlike(r"^(?:[ \t\r\f\x0B]*#|//|/\*|\s|\.?[0-9]|(?:u8|[uUL])?')")
    rows = cut.where(~nothing).select("path", "place", text.alias("text"), raw.rlike(r"^[A-Za-z_\x{80}-\x{10FFFF}][^\"]*$").alias("ident"), "line", "column")
    rows = rows.withColumn("idx", F.row_number().over(_over("place")))
    step = lambda a, b: F.when(F.col("text") == a, 1).when(F.col("text") == b, -1).otherwise(0)
    # a closing mark stands at the depth of its opening one
    depth = lambda a, b: (F.sum(step(a, b)).over(_so_far(_over())) - F.when(F.col("text") == a, 1).otherwise(0)).cast("int")
    return rows.select("path", "idx", "text", "ident", "line", "column", depth("{", "}").alias("depth"), depth("(", ")").alias("parens"))


def directives(cut: DataFrame) -> DataFrame:
    """path, place, line, name, rest of every preprocessor line, without comments and continuations."""
    flat = F.regexp_replace(F.regexp_replace("raw", r"\\\r?\n", " "), r"/\*(?s:.*?)(?:\*/|\z)|(?<![:\"])//[^\n]*", " ")
    found = cut.where(F.col("raw").rlike(r"^[ \t]*#")).withColumn("flat", flat)
    pattern = r"^[ \t]*#[ \t]*([A-Za-z_]+)[ \t]*(.*?)\s*$"
    return found.select("path", "place", "line", F.regexp_extract("flat", pattern, 1).alias("name"), F.regexp_extract("flat", pattern, 2).alias("rest"))


def include_rows(lines: DataFrame, hops: int = 4) -> DataFrame:
    """path, target, line, ord: quoted, angled and macro includes, chased through up to `hops` defines above them."""
    target = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, r"^\"([^\"]+)\"", 1), F.lit("")), F.nullif(F.regexp_extract(c, r"^<([^>]+)>", 1), F.lit("")))
    known = lines.where("name = 'define'").select("path", F.regexp_extract("rest", r"^([A-Za-z_]\w*)(?!\()", 1).alias("macro"), F.trim(F.regexp_extract("rest", r"^[A-Za-z_]\w*[ \t]+(.*)$", 1)).alias("value"), F.col("place").alias("at"))
    asked = lines.where("name = 'include'").select("path", "place", "line", F.col("rest").alias("now"))
    for _ in range(hops):
        name = F.when(target(F.col("now")).isNull(), F.regexp_extract("now", r"^([A-Za-z_]\w*)", 1))
        met = asked.withColumn("macro", name).join(known, ["path", "macro"], "left").where(F.col("at").isNull() | (F.col("at") < F.col("place")) | F.col("macro").isNull())
        asked = met.groupBy("path", "place", "line", "now").agg(F.max_by("value", "at").alias("value")).select("path", "place", "line", F.coalesce("value", "now").alias("now"))
    found = asked.withColumn("target", target(F.col("now"))).where("target is not null")
    return found.groupBy("path", "target", "line").agg(F.min("place").alias("ord"))


def marked(toks: DataFrame) -> DataFrame:
    """tokens with their neighbours, number of name chain, statement, and the next token that ends what a declarator allows."""
    w = _over()
    text = F.col("text")
    out = toks
    for k in (1, 2, 3):
        out = out.withColumn(f"p{k}", F.lag("text", k).over(w))
    out = out.withColumn("p1_ident", F.coalesce(F.lag("ident").over(w), F.lit(False))).withColumn("n1", F.lead("text").over(w)).withColumn("n1_ident", F.coalesce(F.lead("ident").over(w), F.lit(False)))
    # runs of names joined by ::, which may hold a ~
    joined = (F.col("ident") & F.col("p1").isin("::", "~")) | ((text == "::") & F.col("p1_ident")) | ((text == "~") & (F.col("p1") == "::"))
    out = out.withColumn("chain_no", F.sum(F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).over(_so_far(w)))
    # a statement's number counts the marks before it, so a mark belongs to the statement it ends
    ends = text.isin(";", "{", "}", ":")
    out = out.withColumn("stmt", F.coalesce(F.sum(ends.cast("int")).over(_before(w)), F.lit(0)))
    here = Window.partitionBy("path", "stmt").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.sum(c.cast("int")).over(here), F.lit(0))
    out = out.withColumn("marks", count(text.isin("(", ")", "[", "]", "="))).withColumn("words", count(F.col("ident"))).withColumn("verbs", count(text.isin(*STATEMENTS)))
    allowed = F.col("ident") | text.isin(":", "->", "<", ">", ",", "*", "&", "&&", "::", "[", "]")
    back = Window.partitionBy("path").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    # read from the end, so that a running last is the next one
    body = (text == "{") & F.col("p1").isin(")", "}")
    out = out.withColumn("body", F.last(F.when(body, F.col("idx")), ignorenulls=True).over(back))
    return out.withColumn("stop", F.last(F.when(~allowed, F.struct("idx", "text")), ignorenulls=True).over(back))


def called_names(rows: DataFrame) -> DataFrame:
    """path, idx, chain, chain_at, lead: the whole name that ends right before a bracket, its first token, and the token before that."""
    runs = rows.groupBy("path", "chain_no").agg(F.max(F.struct("idx", "n1")).alias("last"), F.min(F.struct("idx", "p1")).alias("first"), F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("parts"))
    return runs.where("last.n1 = '('").select("path", F.col("last.idx").alias("idx"), F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("chain"), F.col("first.idx").alias("chain_at"), F.col("first.p1").alias("lead"))


def pairs(rows: DataFrame, opening: str, closing: str, level: str) -> DataFrame:
    """path, open, close, the lines of both, and what follows the closing one, of matching marks, from marked tokens."""
    w = Window.partitionBy("path", level).orderBy("idx")
    both = rows.where(F.col("text").isin(opening, closing)).withColumn("next", F.lead(F.struct("idx", "text", "line", "stop", "n1", "body")).over(w))
    return both.where((F.col("text") == opening) & (F.col("next.text") == closing)).select("path", F.col("idx").alias("open"), F.col("next.idx").alias("close"), F.col("next.line").alias("close_line"), F.col("next.stop").alias("close_stop"), F.col("next.n1").alias("close_n1"), F.col("next.body").alias("close_body"), F.col("line").alias("open_line"))


def blocks(rows: DataFrame, braces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Namespaces (path, name, open, close) and types (path, word, name, head, open, close, line, column, colon)."""
    back = Window.partitionBy("path").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda cond: F.last(F.when(cond, F.struct("idx", "text")), ignorenulls=True).over(back)
    seen = rows.withColumn("body", ahead(F.col("text").isin("{", ";"))).withColumn("colon", ahead(F.col("text") == ":")).withColumn("named", ahead(F.col("ident") & ~F.col("text").isin("class", "struct", "__attribute__", "alignas")))
    spaces = seen.where((F.col("text") == "namespace") & F.col("n1_ident") & (F.col("body.text") == "{") & (F.col("body.idx") <= F.col("idx") + 6))
    spaces = spaces.select("path", F.col("n1").alias("name"), F.col("body.idx").alias("open")).join(braces.select("path", "open", "close"), ["path", "open"])
    # neither a template's parameters nor the second word of `enum class` begin a type
    heads = seen.where(F.col("text").isin("class", "struct", "union", "enum") & F.col("n1_ident") & ~F.coalesce(F.col("p1").isin("<", ",", "enum"), F.lit(False)))
    heads = heads.where((F.col("body.text") == "{") & (F.col("named.idx") < F.col("body.idx")) & ~F.col("named.text").isin(*KEYWORDS))
    colon = F.when((F.col("colon.idx") > F.col("named.idx")) & (F.col("colon.idx") < F.col("body.idx")), F.col("colon.idx"))
    types = heads.select("path", F.col("text").alias("word"), F.col("named.text").alias("name"), F.col("idx").alias("head"), F.col("body.idx").alias("open"), "line", "column", colon.alias("colon"))
    return spaces, types.join(braces.select("path", "open", "close"), ["path", "open"])


def scoped(rows: DataFrame, scopes: DataFrame, names: DataFrame, at: str, parts: int | None = None) -> DataFrame:
    """rows with scope: the names of all namespaces, then of all types, around `at`, outermost first, each with ::."""
    return innermost(rows, scopes, at, "around", parts=parts).join(names.withColumnRenamed("open", "around"), ["path", "around"], "left").drop("around").withColumn("scope", F.coalesce("scope", F.lit("")))


def scope_names(scopes: DataFrame, parts: int | None = None) -> DataFrame:
    """path, open, scope of the points that scopes (path, rank, name, open, close) have directly inside."""
    found = chains(scopes, F.struct("rank", "open", "name"), parts)
    return settle(found.select("path", "open", F.array_join(F.transform(F.array_sort("chain"), lambda x: F.concat(x["name"], F.lit("::"))), "").alias("scope")), "scopes")


def rendered(rows: DataFrame, ranges: DataFrame, most: int) -> DataFrame:
    """ranges (path, key, first, last) with signature: the tokens between, with spaces where words meet, `most` characters of them.

    Every token has a character, so no more than `most` tokens of a range are looked up.
    """
    w = Window.partitionBy("path", "key").orderBy("idx")
    places = ranges.where("first <= last").select("path", "key", F.explode(F.sequence("first", F.least(F.col("last"), F.col("first") + most))).alias("idx"))
    inside = places.join(rows.select("path", "idx", "text"), ["path", "idx"])
    gap = F.coalesce(F.lag("text").over(w), F.lit("")).rlike(r"[A-Za-z0-9_>)\]]$") & F.col("text").rlike("^[A-Za-z0-9_]")
    spaced = inside.withColumn("s", F.concat(F.when(gap, " ").otherwise(""), "text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "s"))), lambda x: x["s"]), "")
    return spaced.groupBy("path", "key").agg(F.substring(joined, 1, most).alias("signature"))


def functions(rows: DataFrame, braces: DataFrame, scopes: DataFrame, names: DataFrame, types: DataFrame, kinds: Kinds, parts: int | None = None) -> DataFrame:
    """path, key, name, qualified, line, column, declaration, first, last, open, close, body_lines of every candidate."""
    parens = pairs(rows, "(", ")", "parens").drop("open_line", "close_line")
    at = rows.where("text = '('").join(parens.withColumnRenamed("open", "idx"), ["path", "idx"])
    # the first brackets of operator() are its name, and its parameters stand in the next ones
    again = ("close", "close_stop", "close_n1", "close_body")
    after = parens.select("path", (F.col("open") - 1).alias("close"), F.struct(*again).alias("again"))
    at = at.join(after, ["path", "close"], "left")
    call = (F.col("p1") == "operator") & (F.col("n1") == ")") & F.col("again").isNotNull()
    at = at.withColumn("call", F.coalesce(call, F.lit(False))).withColumns({c: F.when(F.col("call"), F.col(f"again.{c}")).otherwise(F.col(c)) for c in again})
    name = F.when(F.col("call"), "operator()").when(F.col("p2") == "operator", F.concat(F.lit("operator"), "p1")).when(F.col("p1_ident") & ~F.col("p1").isin(*KEYWORDS), F.col("p1"))
    # the chain that ends right before the bracket
    before = called_names(rows).select("path", (F.col("idx") + 1).alias("idx"), F.regexp_replace("chain", "^::", "").alias("before"), "lead")
    # a constructor's list of initialisers ends where a block begins after a bracket
    listed = (F.col("close_n1") == ":") & F.col("close_body").isNotNull()
    stop = F.when(listed, F.struct(F.col("close_body").alias("idx"), F.lit("{").alias("text"))).otherwise(F.col("close_stop"))
    at = at.join(before, ["path", "idx"])
    ok = at.withColumn("name", name).where(F.col("name").isNotNull() & stop.isNotNull() & stop["text"].isin("{", ";", "=") & (listed | (stop["idx"] <= F.col("close") + 80)))
    ok = ok.where((F.col("marks") == 0) & (F.col("verbs") == 0) & ~F.coalesce(F.col("lead").isin(".", "->"), F.lit(False)) & ~F.coalesce(F.col("p2").isin(".", "->"), F.lit(False)))
    declared = F.when(F.col("call") | (F.col("p2") == "operator"), F.col("name")).otherwise(F.col("before"))
    ok = ok.withColumn("declared", F.coalesce(declared, F.col("before")))
    owners = types.groupBy("path", F.col("open").alias("type_open")).agg(F.max_by("name", "head").alias("owner"))
    ok = innermost(ok, types, "idx", "type_open", parts=parts).join(owners, ["path", "type_open"], "left")
    twice = (F.substring_index("declared", "::", -1) == F.substring_index("declared", "::", 1)) & F.col("declared").contains("::")
    ctor = F.coalesce(F.regexp_replace("name", "^~", "") == F.col("owner"), F.lit(False)) | twice
    own_words = F.size(F.filter(F.split(F.regexp_replace("declared", "~", ""), "::"), lambda x: x != ""))
    typed = F.col("words") >= (1 if kinds.bare_calls else own_words + 1)
    ok = ok.where((typed & ~F.coalesce(listed, F.lit(False))) | ctor)
    first = rows.groupBy("path", "stmt").agg(F.min("idx").alias("first"))
    ok = scoped(ok.join(first, ["path", "stmt"]), scopes, names, "idx", parts)
    body = braces.select("path", F.col("open").alias("body_open"), F.col("close").alias("body_close"), (F.col("close_line") - F.col("open_line") + 1).alias("body_lines"))
    defined = stop["text"] == "{"
    ok = ok.withColumn("body_open", F.when(defined, stop["idx"])).join(body, ["path", "body_open"], "left")
    return ok.select("path", F.col("idx").alias("key"), "name", F.concat("scope", "declared").alias("qualified"), "line", "column", (~defined).alias("declaration"), "first", F.col("close").alias("last"), F.col("body_open").alias("open"), F.col("body_close").alias("close"), F.coalesce("body_lines", F.lit(0)).alias("body_lines"))


def merged_functions(found: DataFrame) -> DataFrame:
    """One occurrence a file and qualified name: the first one's place, and a later definition's body and signature."""
    at = F.col("key")
    defined = ~F.col("declaration")
    return found.groupBy("path", "qualified").agg(
        F.min_by(F.struct("name", "line", "column"), at).alias("f"), F.min("key").alias("key"), F.bool_and("declaration").alias("declaration"),
        F.coalesce(F.max_by("signature", F.when(defined, at)), F.min_by("signature", at)).alias("signature"), F.coalesce(F.max_by("body_lines", F.when(F.col("body_lines") > 0, at)), F.lit(0)).alias("body_lines"),
    ).select("path", "qualified", "f.name", "f.line", "f.column", "key", "declaration", "signature", "body_lines")


def base_refs(rows: DataFrame, types: DataFrame) -> DataFrame:
    """path, open, base, part of every type's bases: the last name of each part between commas outside brackets."""
    w = Window.partitionBy("path", "open").orderBy("idx")
    heads = types.where("colon is not null and colon + 1 < open").select("path", "open", F.col("name").alias("own"), F.explode(F.expr("sequence(colon + 1, open - 1)")).alias("idx"))
    inside = heads.join(rows.select("path", "idx", "text", "ident"), ["path", "idx"])
    angle = F.sum(F.when(F.col("text") == "<", 1).when(F.col("text") == ">", -1).otherwise(0)).over(_so_far(w))
    inside = inside.withColumn("angle", angle).withColumn("part", F.sum(((F.col("text") == ",") & (F.col("angle") == 0)).cast("int")).over(_so_far(w)))
    names = inside.where(F.col("ident") & ~F.col("text").isin(*ACCESS))
    return names.groupBy("path", "open", "part", "own").agg(F.max_by("text", "idx").alias("base")).where("base <> own").drop("own")


def member_types(rows: DataFrame, types: DataFrame, parts: int | None = None) -> DataFrame:
    """path, open, used, line: the type names of members without brackets, builtin types left out."""
    plain = types.where("word <> 'enum'")
    ends = F.col("text").isin(";", "{", "}") | ((F.col("text") == ":") & F.col("p1").isin("public", "private", "protected"))
    depth = rows.where("text = '{'").select("path", F.col("idx").alias("open"), (F.col("depth") + 1).alias("inner"))
    owns = plain.select("path", "open", F.col("name").alias("own")).join(depth, ["path", "open"])
    # what deeper blocks hold is no member, so only tokens directly inside a type count
    inside = innermost(rows.where("depth > 0").select("path", "idx", "text", "ident", "line", "depth", "p1"), plain, "idx", "open", parts=parts).join(owns, ["path", "open"]).where(F.col("depth") == F.col("inner"))
    w = Window.partitionBy("path", "open", "own").orderBy("idx")
    cut = inside.withColumn("no", F.coalesce(F.sum(ends.cast("int")).over(_before(w)), F.lit(0)))
    here = Window.partitionBy("path", "open", "own", "no").orderBy("idx")
    cut = cut.withColumn("after", F.coalesce(F.sum((F.col("text") == "=").cast("int")).over(_so_far(here)), F.lit(0)))
    word = F.col("ident") & (F.col("after") == 0) & ~F.col("text").isin(*QUALIFIERS)
    cut = cut.withColumn("declared", F.max(F.when(word, F.col("idx"))).over(Window.partitionBy("path", "open", "own", "no")))
    shown = (F.col("idx") < F.col("declared")) & ((F.col("ident") & ~F.col("text").isin(*QUALIFIERS)) | F.col("text").isin("::", "<", ">", ","))
    stmts = cut.groupBy("path", "open", "own", "no").agg(
        F.max((F.col("text") == "(").cast("int")).alias("called"), F.min_by("text", "idx").alias("head"), F.max_by("text", "idx").alias("mark"), F.max(F.when(F.col("idx") == F.col("declared"), F.col("line"))).alias("line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(shown, F.struct("idx", "text")))), lambda x: x["text"]), " ").alias("type"),
    )
    # the innermost argument of a template, else the last part of a qualified name
    inner = F.coalesce(F.nullif(F.regexp_extract("type", r"<([^<>]*)>?[^<]*$", 1), F.lit("")), F.regexp_replace("type", "<.*", ""))
    used = F.regexp_extract(inner, r"(\S+)\s*$", 1)
    good = stmts.where((F.col("mark") == ";") & (F.col("called") == 0) & ~F.col("head").isin(*NO_MEMBER)).withColumn("used", used)
    return good.where((F.col("used") != "") & (F.col("used") != F.col("own")) & ~F.col("used").isin(*BUILTIN)).select("path", "open", "used", "line")


def variables(rows: DataFrame) -> DataFrame:
    """path, key, name, line, column, first, last of variables declared outside all braces, in up to 24 tokens."""
    top = rows.where("depth = 0").withColumn("no", F.coalesce(F.sum(F.col("text").isin(";", "{", "}").cast("int")).over(_before(_over())), F.lit(0)))
    here = _so_far(Window.partitionBy("path", "no").orderBy("idx"))
    cut = top.withColumn("after", F.sum(F.col("text").isin("=", "[").cast("int")).over(here))
    word = F.col("ident") & (F.col("after") == 0) & ~F.col("text").isin(*QUALIFIERS)
    stmts = cut.groupBy("path", "no").agg(
        F.count("*").alias("n"), F.max((F.col("text") == "(").cast("int")).alias("called"), F.min_by("text", "idx").alias("head"), F.max_by("text", "idx").alias("mark"), F.min("idx").alias("first"), F.max("idx").alias("last"),
        F.max_by(F.struct("idx", "text", "line", "column"), F.when(word, F.col("idx"))).alias("v"),
    )
    good = stmts.where((F.col("mark") == ";") & (F.col("called") == 0) & (F.col("n") <= 25) & ~F.col("head").isin(*NO_VARIABLE) & (F.col("v.idx") > F.col("first")))
    return good.select("path", F.col("v.idx").alias("key"), F.col("v.text").alias("name"), F.col("v.line").alias("line"), F.col("v.column").alias("column"), "first", "last")


def call_refs(rows: DataFrame, bodies: DataFrame, parts: int | None = None) -> DataFrame:
    """path, owner (qualified), name, line, idx of the calls inside function bodies. bodies: path, qualified, open, close."""
    calls = rows.where(F.col("ident") & (F.col("n1") == "(") & ~F.col("text").isin(*KEYWORDS)).select("path", "idx", "line").join(called_names(rows), ["path", "idx"])
    calls = calls.withColumn("name", F.regexp_replace(F.regexp_replace("chain", "~", ""), "^::", ""))
    starts = F.col("lead").isNull() | F.col("lead").isin(";", "{", "}", ":")
    calls = calls.where(~F.col("name").startswith("std::") & ~(starts & F.col("name").rlike("^[A-Z]")))
    owners = chains(bodies, F.col("qualified"), parts)
    met = innermost(calls.select("path", "idx", "name", "line"), bodies, "idx", "open", parts=parts).join(owners, ["path", "open"])
    return met.select("path", F.explode("chain").alias("owner"), "name", "line", "idx")


def caps_refs(rows: DataFrame) -> DataFrame:
    """path, name, line, idx: every name of two characters or more without small letters, once a file."""
    caps = rows.where(F.col("ident") & F.col("text").rlike("^[^a-z]*[A-Z][^a-z]*$") & (F.length("text") >= 2))
    return caps.groupBy("path", F.col("text").alias("name")).agg(F.min(F.struct("idx", "line")).alias("f")).select("path", "name", "f.line", "f.idx")


def _id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(ID_PREFIX[kind] + ":"), key)


class Parsed:
    """What is read out of files (path, content): symbols, refs and includes, each worked out when it is first asked for.

    symbols: id, kind, name, qualified, file, sym_ord, line, column, signature, declaration, body_lines, precision,
    public, module. refs: from_id, name, kind, file, line, ref_ord. includes: file, target, line, ord. Who asks for
    includes alone never has tokens made, and who asks for symbols pays for no references.
    """

    def __init__(self, files: DataFrame, kinds: Kinds = Kinds()) -> None:
        self.files, self.kinds = files.where("content is not null"), kinds

    @cached_property
    def parts(self) -> int:
        """Over how many parts files are dealt: by PART_BYTES, but small trees over as many tasks as run at once."""
        size = self.files.agg(F.sum(F.octet_length("content"))).first()[0] or 0
        return max(1, -(-size // PART_BYTES), min(self.files.sparkSession.sparkContext.defaultParallelism, -(-size // LEAST_BYTES)))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.parts, "path")

    @cached_property
    def cut(self) -> DataFrame:
        return settle(pieces(self._dealt(self.files.select("path", "content"))), "pieces")

    @cached_property
    def lines(self) -> DataFrame:
        return directives(self.cut)

    @cached_property
    def rows(self) -> DataFrame:
        return self._dealt(settle(marked(tokens(self._dealt(self.cut))), "tokens"))

    @cached_property
    def braces(self) -> DataFrame:
        return pairs(self.rows, "{", "}", "depth")

    @cached_property
    def _blocks(self) -> tuple[DataFrame, DataFrame]:
        spaces, types = blocks(self.rows, self.braces)
        types = self._dealt(settle(types, "types"))
        plain = types.where("word <> 'enum'")
        held = spaces.select("path", F.lit(0).alias("rank"), "name", "open", "close").unionByName(plain.select("path", F.lit(1).alias("rank"), "name", "open", "close"))
        return types, self._dealt(settle(held, "scopes"))

    @property
    def types(self) -> DataFrame:
        return self._blocks[0]

    @property
    def scopes(self) -> DataFrame:
        return self._blocks[1]

    @cached_property
    def names(self) -> DataFrame:
        return self._dealt(scope_names(self.scopes, self.parts))

    @cached_property
    def named(self) -> DataFrame:
        return self._dealt(settle(scoped(self.types, self.scopes, self.names, "head", self.parts).withColumn("qualified", F.concat("scope", "name")), "named"))

    @cached_property
    def bodies(self) -> DataFrame:
        return self._dealt(settle(functions(self.rows, self.braces, self.scopes, self.names, self.types, self.kinds, self.parts), "functions"))

    @cached_property
    def symbols(self) -> DataFrame:
        occurrences = []

        def add(df: DataFrame, kind: Column, group: int, name="name", declaration: Column = F.lit(False), body: Column = F.lit(0)) -> None:
            # macros first, then types, functions and variables, each in the order of the text
            order = (F.lit(group << 40) + F.col("key")).cast("long")
            occurrences.append(df.select(kind.alias("kind"), F.col(name).alias("name"), "qualified", F.col("path").alias("file"), order.alias("sym_ord"), "line", "column", "signature", declaration.alias("declaration"), body.cast("int").alias("body_lines")))

        if self.kinds.symbols:
            macros = self.lines.where("name = 'define'").select("path", F.regexp_extract("rest", r"^([A-Za-z_]\w*)", 1).alias("name"), F.col("place").alias("key")).where("name <> ''")
            add(macros.select("path", "key", "name", F.col("name").alias("qualified"), F.lit(1).alias("line"), F.lit(0).alias("column"), F.lit("").alias("signature")), F.lit("macro"), 0)
            v = variables(self.rows)
            signed_v = scoped(v.join(rendered(self.rows, v.select("path", "key", "first", "last"), 300), ["path", "key"], "left"), self.scopes, self.names, "key", self.parts)
            add(signed_v.withColumn("qualified", F.concat("scope", "name")), F.lit("variable"), 3)
        if self.kinds.types or self.kinds.symbols:
            signature = F.when(F.col("word") == "enum", F.concat(F.lit("enum "), "name")).otherwise(F.concat("word", F.lit(" "), "name", F.lit(" @ "), "path"))
            add(self.named.select("path", F.col("head").alias("key"), "name", "qualified", "line", "column", "word", signature.alias("signature")), F.when(F.col("word") == "enum", "enum").otherwise("class"), 1)
        signed = self.bodies.join(rendered(self.rows, self.bodies.select("path", "key", "first", "last"), 400), ["path", "key"], "left")
        add(merged_functions(signed), F.lit("function"), 2, declaration=F.col("declaration"), body=F.col("body_lines"))
        symbols = occurrences[0]
        for more in occurrences[1:]:
            symbols = symbols.unionByName(more)
        prefix = F.element_at(F.create_map(*[F.lit(x) for kv in ID_PREFIX.items() for x in kv]), F.col("kind"))
        symbols = symbols.select(F.concat(prefix, F.lit(":"), "qualified").alias("id"), "*", F.lit("approx").alias("precision"), is_public(F.col("file")).alias("public"), module_of(F.col("file")).alias("module"))
        return settle(symbols, "symbols")

    @cached_property
    def refs(self) -> DataFrame:
        pending = self.files.sparkSession.createDataFrame([], "from_id string, name string, kind string, file string, line int, ref_ord long")
        for name in ("types", "calls", "symbols"):
            if getattr(self.kinds, name):
                for more in getattr(self, f"_{name}_refs")():
                    pending = pending.unionByName(more)
        return settle(pending, "refs")

    def _types_refs(self) -> list[DataFrame]:
        owner = self.named.select("path", "open", "qualified", F.col("line").alias("head_line"))
        bases = base_refs(self.rows, self.types.where("word <> 'enum'")).join(owner, ["path", "open"]).withColumn("line", F.col("head_line")).withColumn("o", F.col("open") * 64 + F.col("part"))
        members = member_types(self.rows, self.types, self.parts).join(owner, ["path", "open"])
        return [_refer(bases, 0, "inherits", _id("class", F.col("qualified")), "base", "o"), _refer(members, 1, "uses", _id("class", F.col("qualified")), "used", "line")]

    def _calls_refs(self) -> list[DataFrame]:
        return [_refer(call_refs(self.rows, self.bodies.where("close is not null"), self.parts), 2, "calls", _id("function", F.col("owner")), "name", "idx")]

    def _symbols_refs(self) -> list[DataFrame]:
        return [_refer(caps_refs(self.rows).where(~F.col("name").isin(*KEYWORDS)), 3, "refs", _id("file", F.col("path")), "name", "idx")]

    @cached_property
    def includes(self) -> DataFrame:
        found = include_rows(self.lines).select(F.col("path").alias("file"), "target", "line", "ord")
        return settle(found if self.kinds.includes else found.limit(0), "includes")


def _refer(df: DataFrame, group: int, kind: str, origin: Column, name: str, order: str) -> DataFrame:
    return df.select(origin.alias("from_id"), F.col(name).alias("name"), F.lit(kind).alias("kind"), F.col("path").alias("file"), "line", (F.lit(group << 40) + F.col(order)).cast("long").alias("ref_ord"))


def extract(files: DataFrame, kinds: Kinds = Kinds()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """symbols, refs and includes of files (path, content), as Parsed says."""
    found = Parsed(files, kinds)
    return found.symbols, found.refs, found.includes
