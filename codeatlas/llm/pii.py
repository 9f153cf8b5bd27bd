"""Personal data by bootstrapped contextual extraction, with native functions alone.

Seeds are the entities the base rules accept, and keys of a strict shape. The words beside them become lexical
patterns; patterns and the instances they surround form a graph whose two sides Spark scores in turn, an instance by
its best evidence and a pattern by the mean of its instances, shrunk towards 0. Identifier-like strings that no rule
accepts are unlabelled instances: they pull a pattern's score down if they stand in its place, and become entities
when patterns of high confidence surround them and their shape fits the kind. Secrets (keys and tokens) have no base
rule: all of them, seeds too, are found by their patterns.

Null or empty texts hold nothing. Long texts are scanned whole; the expressions are written so that no start is
retried inside a run of characters, matches become rows, and texts are redacted in pieces, hence long texts and
long lists of matches take linear time. Equal spans of several kinds are all kept. Repeated rows get equal results and count once as
evidence. An empty table gives an empty result; redact keeps extra columns, extract ignores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, is_small, looked_up, materialise, row_key, shuffled, sided

KINDS = ("email", "ip", "card", "phone")
#: A kind without base rule, listed after the others.
SECRET = "secret"

#: Fixed by the contract; possessive, and guarded so that a failed run isn't entered again from its middle.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Shapes that a kind's identifiers take outside the base rules.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+ ?(?:\[at\]|\(at\)|\{at\}| at ) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}| dot ) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ./_-][0-9]{4}){3}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.(-])(?:00[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])(?!\.[0-9])",
}
#: Shapes of keys and tokens: strict ones, whose contexts are learned, and whatever else may stand in those contexts.
KEYS = r"(?<![A-Za-z0-9_+/=.-])(?=[0-9a-f]*?[0-9])(?=[0-9a-f]*?[a-f])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![A-Za-z0-9_+/=.-])"
LOOSE_KEYS = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*?[0-9])(?=[0-9_+/=-]*?[A-Za-z])[A-Za-z0-9_+/=-]{16,}+(?![A-Za-z0-9_+/=-])"
KEY_NEEDS = "[A-Za-z_+/=-][0-9]|[0-9][A-Za-z_+/=-]"
#: A cheap test of whether a text can hold a kind at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
LOOSE_NEEDS = {"email": "(?i)at[\\])} ]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9]{4}[ ./_-][0-9]{4}", "phone": r"[0-9)][ .-][0-9]{3}"}
LEFT_CHARS, RIGHT_CHARS = 60, 30
#: Characters redacted at once.
CHARS = 1 << 10
FIELDS = "array<struct<kind:string,start:int,end:int>>"


def accepted(kind: str, value: Column) -> Column:
    """The contract's tests on a match."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def find(text: Column, rule: int, pattern: str, needs: str) -> Column:
    """Array of rule, i, skipped, value, left, right of every match: what lies between it and the one before, and the context.

    Zipped before the lambda: what a lambda names from outside is worked out anew for every element.
    """
    pieces, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    each = F.arrays_zip(values.alias("v"), F.slice(pieces, 1, F.size(values)).alias("p"), F.slice(pieces, 2, F.size(values)).alias("r"))
    match = lambda x, i: F.struct(
        F.lit(rule).alias("rule"), i.alias("i"), F.length(x["p"]).alias("skipped"), x["v"].alias("value"),
        F.right(x["p"], F.lit(LEFT_CHARS)).alias("left"), F.left(x["r"], F.lit(RIGHT_CHARS)).alias("right"),
    )
    return F.when(text.rlike(needs), F.transform(each, match)).otherwise(F.array())


#: kind, pattern, cheap test, whether the base rules' tests apply, whether its matches are seeds.
RULES = [*[(k, BASE[k], NEEDS[k], True, True) for k in KINDS], *[(k, LOOSE[k], LOOSE_NEEDS[k], False, False) for k in KINDS], (SECRET, KEYS, KEY_NEEDS, False, True), (SECRET, LOOSE_KEYS, KEY_NEEDS, False, False)]


def scan(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, row_key, matches of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(*[find(body, n, pattern, needs) for n, (_, pattern, needs, _, _) in enumerate(RULES)])
    return docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), found.alias("matches"))


def spans_of(found: DataFrame) -> DataFrame:
    """row_key, kind, start, end, value, left, right, seed, base: what scan's matches leave, once for equal rows.

    Places are running sums over a text's matches, in code points.
    """
    once = found.where(F.size("matches") > 0).select("row_key", "matches").dropDuplicates(["row_key"])
    m = once.select("row_key", F.explode("matches").alias("m")).select("row_key", "m.*")
    upto = Window.partitionBy("row_key", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = m.withColumn("end", F.sum(F.col("skipped") + F.length("value")).over(upto).cast("int"))
    rule = lambda k: F.get(F.array(*[F.lit(r[k]) for r in RULES]), F.col("rule"))
    tests = F.lit(True)
    for n, (kind, _, _, tested, _) in enumerate(RULES):
        if tested:
            tests = F.when(F.col("rule") == n, accepted(kind, F.col("value"))).otherwise(tests)
    kept = placed.where(tests)
    return kept.select("row_key", rule(0).alias("kind"), (F.col("end") - F.length("value")).alias("start"), "end", "value", "left", "right", rule(4).alias("seed"), rule(3).alias("base"))


def outside_base(spans: DataFrame) -> DataFrame:
    """The rows of spans (row_key and span fields, base) that are base or overlap no base span of their text."""
    place = [F.col("start"), F.col("end")]
    before = Window.partitionBy("row_key").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row_key").orderBy(*[F.desc(c) for c in ("start", "end")]).rowsBetween(Window.unboundedPreceding, 0)
    met = spans.withColumn("reach", F.max(F.when(F.col("base"), F.col("end"))).over(before)).withColumn("next", F.min(F.when(F.col("base"), F.col("start"))).over(after))
    clear = (F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.coalesce("next", F.lit(1 << 40)) >= F.col("end"))
    return met.where(F.col("base") | clear).drop("reach", "next")


def contexts(spans: DataFrame) -> DataFrame:
    """row_key, start, end, kind, value, seed, pattern: the patterns beside every span.

    A pattern is the last word before, the last two or three, or the words on both sides, in lower case, with digits as 0.
    """
    norm = lambda c: F.regexp_replace(F.lower(c), "[0-9]", "0")
    left = F.array_remove(F.split(norm(F.col("left")), r"\s+", -1), "")
    right = F.array_remove(F.split(norm(F.col("right")), r"\s+", -1), "")
    last, one = F.element_at("l", -1), F.get("r", F.lit(0))
    patterns = F.filter(
        F.array(
            F.when(F.size("l") >= 1, F.concat(F.lit("L1 "), last)),
            F.when(F.size("l") >= 2, F.concat(F.lit("L2 "), F.element_at("l", -2), F.lit(" "), last)),
            F.when(F.size("l") >= 3, F.concat(F.lit("L3 "), F.element_at("l", -3), F.lit(" "), F.element_at("l", -2), F.lit(" "), last)),
            F.when((F.size("l") >= 1) & (F.size("r") >= 1), F.concat(F.lit("LR "), last, F.lit(" _ "), one)),
        ),
        lambda p: p.isNotNull(),
    )
    sides = spans.withColumn("l", left).withColumn("r", right)
    return sides.select("row_key", "start", "end", "kind", "value", "seed", F.explode(patterns).alias("pattern"))


def score_graph(edges: DataFrame, rounds: int, prior: float) -> DataFrame:
    """kind, pattern, confidence, support after `rounds` of scoring both sides of the pattern-instance graph.

    edges: kind, value, seed, pattern, n. Seeds hold score 1 for their kind; other instances start at 0 and get
    the best confidence of a pattern around them. A pattern's confidence is the sum of its instances' scores over
    their number plus a prior. Sums only: a pattern that stands beside a third of all instances is one row per task.
    """
    scores = edges.select("kind", "value", "pattern", "seed", F.col("seed").cast("double").alias("score"))
    ranked = None
    for r in range(rounds):
        ranked = scores.groupBy("kind", "pattern").agg(
            (F.sum("score") / (F.count("*") + F.lit(prior))).alias("confidence"),
            F.sum(F.col("seed").cast("long")).alias("support"),
        )
        if r + 1 < rounds:
            ranked = materialise(ranked, "patterns")
            best = materialise(looked_up(scores, ranked, ["kind", "pattern"]).groupBy("kind", "value").agg(F.max("confidence").alias("best")), "instances")
            scores = looked_up(edges, best, ["kind", "value"]).select("kind", "value", "pattern", "seed", F.when(F.col("seed"), 1.0).otherwise(F.col("best")).alias("score"))
    return ranked


def discover(spans: DataFrame, *, rounds: int = 3, prior: float = 1.0, confidence: float = 0.7, support: int = 3) -> DataFrame:
    """row_key, kind, start, end of the loose candidates that patterns of high confidence surround.

    spans: exploded rows of row_key and the span fields. support: different seed values a pattern must have.
    """
    marked = materialise(contexts(spans), "contexts")
    edges = materialise(marked.groupBy("kind", "value", "pattern").agg(F.max("seed").alias("seed")), "graph")
    trusted = score_graph(edges, rounds, prior).where((F.col("confidence") >= confidence) & (F.col("support") >= support))
    asked = marked.where(~F.col("seed") | (F.col("kind") == SECRET))
    met = looked_up(asked, materialise(trusted.select("kind", "pattern"), "trusted"), ["kind", "pattern"], "left_semi")
    return met.select("row_key", "kind", "start", "end").distinct()


def _ordered(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    order = F.array(*[F.lit(k) for k in (*KINDS, SECRET)])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(order, s["kind"]).alias("b"), s["end"].alias("c"), s["kind"].alias("d")))
    return F.concat_ws(",", F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["d"], s["a"].cast("string"), s["c"].cast("string"))))


def extract(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, row_key, base and added (arrays of spans) for every row of docs."""
    found = materialise(scan(docs, doc_id, text), "matches")
    spans = materialise(outside_base(spans_of(found)), "spans")
    new = discover(spans, **options).withColumn("base", F.lit(False))
    both = spans.where("base").select("row_key", "kind", "start", "end", "base").unionByName(new)
    part = lambda flag: F.collect_list(F.when(flag, F.struct("kind", "start", "end")))
    lists = both.groupBy("row_key").agg(part(F.col("base")).alias("base"), part(~F.col("base")).alias("added"))
    none = F.array().cast(FIELDS)
    return found.select("doc_id", "row_key").join(sided(materialise(lists, "lists")), "row_key", "left").select("doc_id", "row_key", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns, from what extract returns. The counts are of base spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    slim = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rows = found.withColumn("slim", slim)
    return rows.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(_ordered(F.col("slim")), 256).alias("base_sha256"),
        _ordered(F.concat("slim", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame, found: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every found span replaced by [KIND]; spans that overlap an earlier one join it."""
    slim = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    key, fresh = free_name("row_key", docs.columns), free_name("fresh", docs.columns)
    all_spans = found.select("row_key", F.explode(F.concat(slim("base"), slim("added"))).alias("s")).select("row_key", "s.*").distinct()
    order = Window.partitionBy("row_key").orderBy("start", "end", "kind")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = all_spans.withColumn("fresh", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(order))
    whole = island.groupBy("row_key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"))
    # a text is worked in pieces of CHARS; what of an island lies in a later piece is cut out without a mark
    piece = whole.withColumn("piece", F.explode(F.sequence(F.floor(F.col("start") / CHARS), F.floor((F.col("end") - 1) / CHARS))))
    a, b = F.greatest(F.col("start") - F.col("piece") * CHARS, F.lit(0)), F.least(F.col("end") - F.col("piece") * CHARS, F.lit(CHARS))
    mark = F.when(F.col("start") >= F.col("piece") * CHARS, F.concat(F.lit("["), F.upper("kind"), F.lit("]"))).otherwise("")
    cut = F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), mark.alias("mark"))
    cuts = materialise(piece.groupBy("row_key", F.col("piece").cast("int").alias("piece")).agg(F.array_sort(F.collect_list(cut)).alias("cuts")), "cuts")
    ids = cuts.select(F.col("row_key").alias(key)).distinct()
    few = is_small(ids)
    body = F.col(f"`{text}`")
    keyed = docs.withColumn(key, row_key(doc_id, text))
    held = keyed.join(F.broadcast(ids) if few else shuffled(ids), key, "left_semi")
    pieces = held.select(F.col(key).alias("row_key"), body.alias("body")).dropDuplicates(["row_key"]).select("row_key", F.posexplode(F.regexp_extract_all("body", F.lit(f"(?s).{{1,{CHARS}}}"), F.lit(0))).alias("piece", "body"))

    def step(acc: Column, c: Column) -> Column:
        kept = F.concat(F.substring(F.col("body"), acc["at"] + 1, c["a"] - acc["at"]), c["mark"])
        return F.struct(c["b"].alias("at"), F.concat(acc["out"], kept).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("cuts", begin, step, lambda acc: F.concat(acc["out"], F.substring(F.col("body"), acc["at"] + 1, F.lit(CHARS))))
    cleaned = pieces.join(shuffled(cuts), ["row_key", "piece"], "left").select("row_key", "piece", F.coalesce(done, F.col("body")).alias("s"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("piece", "s"))), lambda x: x["s"])
    texts = cleaned.groupBy(F.col("row_key").alias(key)).agg(F.array_join(lines, "").alias(fresh))
    columns = [F.coalesce(F.col(fresh), body).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if not few:
        return keyed.join(shuffled(texts), key, "left").select(*columns)
    rest = keyed.join(F.broadcast(ids), key, "left_anti").select(*[f"`{c}`" for c in docs.columns])
    return rest.unionByName(held.join(shuffled(texts), key).select(*columns))
