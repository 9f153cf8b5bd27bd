"""Benchmark decontamination by a distributed positional inverted index, with native functions alone.

Training tokens become postings (term, document, position). Every benchmark window looks its terms up from the
rarest on: the postings of its rarest term place it, and each place must then find the next rarer terms at their
offsets, one list after the other, so that only the shortest lists are ever joined to windows. The places left are
cut from the documents' own words and compared in full. Near matches come from the same lists: the rarest terms of a
window that occur at all, each within SLOP words of its place beside the rarest. Only postings of terms that some window looks up are
stored; joins after that carry document and position in their key, so a term or passage that fills a third of the
corpus spreads over all tasks.

Null or empty texts have no words, no hits and are clean. An item of fewer than `length` words is one window;
items without words have none. Equal windows of several items are searched once. Rows that repeat an id and a
text are searched once and each get the result. Long texts are compared in parts of CHUNK places. Without items or
without documents nothing is contaminated; extra columns of either table are ignored, and keep_clean returns them. Terms as
rare as one another are taken in the order of the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, drop_table, free_name, looked_up, materialise, row_key, sided

#: Fixed by the contract: what separates words, after A-Z are lowered.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lowered.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Places of a text that are compared together.
CHUNK = 4096
#: Words by which a term of a near match may stand beside its place.
SLOP = 3


def words(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def windows(items: DataFrame, item_id: str, text: str, length: int) -> DataFrame:
    """pid, phrase, w (its words), items (ids as strings): one row per distinct window, to be stored once."""
    split = items.select(F.col(item_id).cast("string").alias("item"), words(text).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - length + 1, F.lit(1)))
    each = split.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, length))).alias("w"))
    named = each.groupBy(F.concat_ws(" ", "w").alias("phrase")).agg(F.first("w").alias("w"), F.collect_set("item").alias("items"))
    return named.withColumn("pid", F.monotonically_increasing_id())


def lookups(docs: DataFrame, phrases: DataFrame, rarest: int, partial: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pid, n, whole, list) and (term, tid): each phrase's rarest terms that occur in docs (key, text), rarest first.

    list: tid and off of each; whole: whether all terms occur. Phrases with a term that no document has are left out, unless partial.
    """
    terms = phrases.select(F.explode(F.array_distinct("w")).alias("term")).distinct()
    seen = docs.select(F.explode(F.array_distinct(words("text"))).alias("term"))
    counts = seen.join(sided(materialise(terms, "vocabulary")), "term").groupBy("term").count()
    df = materialise(counts.withColumn("tid", F.monotonically_increasing_id()), "terms")
    placed = phrases.select("pid", F.size("w").alias("n"), F.posexplode("w").alias("off", "term"))
    met = looked_up(placed, df, ["term"], "left")
    known = F.filter(F.collect_list(F.struct("count", "off", "tid")), lambda x: x["tid"].isNotNull())
    lists = met.groupBy("pid", "n").agg(known.alias("all"))  # `length` rows a phrase
    lists = lists.where(F.size("all") > 0 if partial else F.size("all") == F.col("n"))
    # a phrase of fewer terms asks for its rarest one again
    some = lists.select("pid", "n", (F.size("all") == F.col("n")).alias("whole"), F.transform(F.slice(F.array_sort("all"), 1, rarest), lambda x: F.struct(x["tid"].alias("tid"), x["off"].alias("off"))).alias("list"))
    wanted = materialise(some.withColumn("list", F.array(*[F.coalesce(F.get("list", F.lit(k)), F.get("list", F.lit(0))) for k in range(rarest)])), "lookups")
    used = wanted.select(F.explode("list.tid").alias("tid")).distinct()
    return wanted, df.join(used, "tid", "left_semi").select("term", "tid")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index (tid, key, pos) of the terms looked up, from docs (key, text)."""
    placed = docs.select("key", F.posexplode(words("text")).alias("pos", "term"))
    return materialise(looked_up(placed, materialise(terms, "wanted"), ["term"]).select("tid", "key", "pos"), "postings")


def numbered(phrases: DataFrame) -> DataFrame:
    return phrases if "pid" in phrases.columns else materialise(phrases.withColumn("pid", F.monotonically_increasing_id()), "windows")


def places(index: DataFrame, wanted: DataFrame, rarest: int) -> DataFrame:
    """key, start, n: where all the rarest terms of some phrase stand at their offsets."""
    term = lambda k, part: F.get("list", F.lit(k))[part].alias(f"{part}{k}")
    # phrases that ask for the same terms at the same offsets are one
    asked = materialise(wanted.select(term(0, "tid"), term(0, "off"), "n", *[term(k, part) for k in range(1, rarest) for part in ("tid", "off")]).distinct(), "asked")
    at = looked_up(index.withColumnRenamed("tid", "tid0"), asked, ["tid0"]).withColumn("start", F.col("pos") - F.col("off0")).where("start >= 0").drop("tid0", "off0", "pos")
    for k in range(1, rarest):
        there = index.select("key", F.col("tid").alias(f"tid{k}"), F.col("pos").alias(f"pos{k}"))
        at = at.withColumn(f"pos{k}", F.col("start") + F.col(f"off{k}")).join(there, ["key", f"tid{k}", f"pos{k}"], "left_semi").drop(f"tid{k}", f"off{k}", f"pos{k}")
    return at.distinct()


def phrase_matches(docs: DataFrame, phrases: DataFrame, rarest: int = 3, ready: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """key, start, pid, n: every exact occurrence of a phrase in docs (key, text), once for rows of one key.

    ready: lists and index of these phrases, if there are any; without, both are made and the index is dropped again.
    """
    phrases = numbered(phrases)
    if ready:
        wanted, index = ready[0].where("whole"), ready[1]
    else:
        wanted, terms = lookups(docs, phrases, rarest)
        index = postings(docs, terms)
    found = materialise(places(index, wanted, rarest), "places")
    if not ready:
        drop_table(index)
    longest = phrases.agg(F.max(F.size("w"))).first()[0] or 1
    # each part of a text brings its own places: CHUNK starts of `length` lengths at most
    part = F.floor(F.col("start") / CHUNK).cast("int").alias("part")
    asked = found.select("key", part, F.struct((F.col("start") % CHUNK).alias("at"), "n").alias("s")).groupBy("key", "part").agg(F.collect_list("s").alias("asked"))
    held = docs.join(sided(materialise(found.select("key").distinct(), "held")), "key", "left_semi")
    count = F.ceil(F.size("w") / F.lit(CHUNK)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("part"), F.slice("w", i * CHUNK + 1, CHUNK + longest - 1).alias("w")))
    parts = held.select("key", words("text").alias("w")).where(F.size("w") > 0).select("key", F.explode(cut).alias("c")).select("key", "c.part", "c.w")
    met = parts.join(asked, ["key", "part"]).select("key", "part", F.explode(F.transform("asked", lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n"), F.concat_ws(" ", F.slice("w", s["at"] + 1, s["n"])).alias("phrase")))).alias("m"))
    texts = met.select("key", (F.col("part") * CHUNK + F.col("m.at")).alias("start"), F.col("m.n").alias("n"), F.col("m.phrase").alias("phrase")).distinct()
    return looked_up(texts, phrases.select("phrase", "pid"), ["phrase"]).select("key", "start", "pid", "n")


def near_places(index: DataFrame, asks: DataFrame, rarest: int, slop: int) -> DataFrame:
    """key, aid, at: postings of an ask's rarest term beside which each other one stands within slop words of its place.

    asks: aid, t0, and t1, d1 and so on: the other terms, and how far from the first they stand. Postings lie in buckets
    of as many words as a term may take, so each place looks two up; a semi join keeps it from growing there.
    """
    reach = 2 * slop + 1
    held = index.select("key", "tid", F.floor(F.col("pos") / reach).alias("bucket"), F.col("pos").alias("there"))
    at = looked_up(index.select("key", F.col("tid").alias("t0"), F.col("pos").alias("at")), asks, ["t0"]).drop("t0")
    for k in range(1, rarest):
        place = F.col("at") + F.col(f"d{k}")
        buckets = F.array_distinct(F.array(F.floor((place - slop) / reach), F.floor((place + slop) / reach)))
        asked = at.withColumn("place", place).withColumn("bucket", F.explode(buckets)).withColumnRenamed(f"t{k}", "tid")
        a, b = asked.alias("a"), held.alias("b")
        same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "tid", "bucket")]
        at = a.join(b, [*same, F.abs(F.col("b.there") - F.col("a.place")) <= slop], "left_semi").drop("place", "bucket", "tid", f"d{k}").distinct()
    return at


def near_asks(wanted: DataFrame, rarest: int) -> DataFrame:
    """pid with t0, t1, d1 and so on: what a phrase's lists ask for. Phrases that lie over one passage mostly ask alike."""
    get = lambda k, part: F.get("list", F.lit(k))[part]
    return wanted.select("pid", get(0, "off").alias("off"), get(0, "tid").alias("t0"), *[c for k in range(1, rarest) for c in (get(k, "tid").alias(f"t{k}"), (get(k, "off") - get(0, "off")).alias(f"d{k}"))])


def near_items(index: DataFrame, wanted: DataFrame, phrases: DataFrame, rarest: int, slop: int) -> DataFrame:
    """key, near (ids of items): the items with a window that has a near match in a text."""
    each = looked_up(near_asks(wanted, rarest).drop("off"), phrases.select("pid", "items"), ["pid"]).drop("pid")
    grouped = each.groupBy(*[c for c in each.columns if c != "items"]).agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    asks = materialise(grouped.withColumn("aid", F.monotonically_increasing_id()), "asks")
    met = near_places(index, asks.drop("items"), rarest, slop).select("key", "aid").distinct()
    return looked_up(met, asks.select("aid", "items"), ["aid"]).select("key", F.explode("items").alias("item")).groupBy("key").agg(F.collect_set("item").alias("near"))


def proximity_matches(docs: DataFrame, phrases: DataFrame, slop: int = SLOP, rarest: int = 3) -> DataFrame:
    """key, pid, start: places where the rarest terms that occur at all stand within slop words of where they should.

    The rarest term places the phrase; each further list must hold a posting near it. A word that no document has
    doesn't keep the phrase from being found.
    """
    wanted, terms = lookups(docs, numbered(phrases), rarest, partial=True)
    asks = materialise(near_asks(wanted, rarest).withColumnRenamed("pid", "aid"), "asks")
    at = near_places(postings(docs, terms), asks.drop("off"), rarest, slop)
    return looked_up(at, asks.select("aid", "off"), ["aid"]).select("key", F.col("aid").alias("pid"), (F.col("at") - F.col("off")).alias("start"))


def _digest(ids: Column) -> Column:
    return F.sha2(F.concat_ws(",", F.array_sort(ids)), 256)


def contamination(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", length: int = 13, rarest: int = 3, share: int = 20, near: bool = False, slop: int = SLOP) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids), items_sha256, contaminated, row_key for every row of docs.

    near: also n_near and near_sha256, the items with near matches, exact ones among them; they contaminate nothing.
    """
    phrases = materialise(windows(items, item_id, item_text, length), "windows")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), row_key(doc_id, text).alias("key"))
    ready = None
    if near:
        wanted, terms = lookups(rows.select("key", "text"), phrases, rarest, partial=True)
        ready = wanted, postings(rows.select("key", "text"), terms)
        beside = materialise(near_items(ready[1], wanted, phrases, rarest, slop), "near")
    places_ = materialise(phrase_matches(rows.select("key", "text"), phrases, rarest, ready), "matches")
    if ready:
        drop_table(ready[1])
    spans = places_.groupBy("key", "start").agg(F.max("n").alias("n"))
    upto = Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest(F.col("start"), F.coalesce(F.max(F.col("start") + F.col("n")).over(upto), F.lit(0))))
    hits = spans.withColumn("fresh", fresh).groupBy("key").agg(F.sum("fresh").alias("n_hit"))
    met = looked_up(places_.select("key", "pid").distinct(), phrases.select("pid", "items"), ["pid"])
    named = met.select("key", F.explode("items").alias("item")).groupBy("key").agg(F.collect_set("item").alias("items"))
    marked = materialise(hits.join(named, "key"), "marked")
    counts = rows.select("doc_id", "key", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    found, more = counts.join(sided(marked), "key", "left"), []
    if near:
        found = looked_up(found, beside, ["key"], "left")
        others = F.coalesce("near", F.array().cast("array<string>"))
        more = [F.size(others).cast("long").alias("n_near"), _digest(others).alias("near_sha256")]
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.array_sort(ids).alias("items"),
        _digest(ids).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        *more,
        F.col("key").alias("row_key"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the contaminated rows."""
    key = free_name("key", docs.columns)
    bad = contamination(docs, items, doc_id=doc_id, text=text, **options).where("contaminated").select(F.col("row_key").alias(key)).distinct()
    keyed = docs.withColumn(key, row_key(doc_id, text))
    return keyed.join(sided(materialise(bad, "bad")), key, "left_anti").select(*[f"`{c}`" for c in docs.columns])


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS phrase
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), m AS (
  SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.phrase = bw.phrase
), h AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id
), bt AS (
  SELECT item, s, o, w[s + o] AS term
  FROM (SELECT item, w, s, unnest(generate_series(0, least(len(w) - s, 12))) AS o
        FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM b WHERE len(w) > 0))
), p AS (
  SELECT doc_id, pos, w[pos] AS term FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS pos FROM d)
  WHERE w[pos] IN (SELECT term FROM bt)
), f AS (
  SELECT term, count(DISTINCT doc_id) AS df FROM p GROUP BY term
), k AS (
  SELECT item, s, o, term, row_number() OVER (PARTITION BY item, s ORDER BY df, o) AS k FROM bt JOIN f USING (term)
), a AS (
  SELECT DISTINCT x.item, x.term AS t0, coalesce(y.term, x.term) AS t1, coalesce(y.o, x.o) - x.o AS d1, coalesce(z.term, x.term) AS t2, coalesce(z.o, x.o) - x.o AS d2
  FROM k x LEFT JOIN k y ON y.item = x.item AND y.s = x.s AND y.k = 2 LEFT JOIN k z ON z.item = x.item AND z.s = x.s AND z.k = 3 WHERE x.k = 1
), n1 AS (
  SELECT DISTINCT p.doc_id, p.pos, t0, t1, d1, t2, d2 FROM (SELECT DISTINCT t0, t1, d1, t2, d2 FROM a) JOIN p ON p.term = t0
  JOIN p q ON q.doc_id = p.doc_id AND q.term = t1 AND abs(q.pos - p.pos - d1) <= 3
), n2 AS (
  SELECT DISTINCT n1.doc_id, t0, t1, d1, t2, d2 FROM n1 JOIN p q ON q.doc_id = n1.doc_id AND q.term = t2 AND abs(q.pos - n1.pos - d2) <= 3
), nt AS (
  SELECT doc_id, count(DISTINCT item)::BIGINT AS n_near, string_agg(DISTINCT item, ',' ORDER BY item) AS near FROM n2 JOIN a USING (t0, t1, d1, t2, d2) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(DISTINCT item)::BIGINT AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM m GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w)) AS contaminated,
       coalesce(n_near, 0) AS n_near, sha256(coalesce(near, '')) AS near_sha256
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN nt ON d.doc_id = nt.doc_id
"""
