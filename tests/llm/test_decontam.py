import hashlib
import re

from pyspark.sql import functions as F

from codeatlas.llm import decontam
from codeatlas.llm.common import table


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, length=13):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - length + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + length]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, met = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    met |= found
        out.append((i, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def check(docs, items):
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = decontam.contamination(docs, items).drop("items", "row_key")
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_table_equals_brute_force(spark, sf_dir):
    check(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def test_odd_rows_and_short_items(spark, odd_docs):
    items = spark.createDataFrame([("a", "the cat"), ("b", "THE CAT"), ("c", None), ("d", "..."), ("e", "no such words here"), ("f", "the cat " * 9), (None, "hund und die")], "item_id string, text string")
    check(odd_docs, items.where("item_id is not null"))
    assert decontam.contamination(odd_docs.limit(0), items).count() == 0
    assert decontam.contamination(odd_docs, items.limit(0)).where("contaminated").count() == 0
    left = decontam.keep_clean(odd_docs, items)
    assert left.columns == odd_docs.columns and 5 not in [r.doc_id for r in left.collect()]


def test_proximity(spark):
    docs = spark.createDataFrame([("x", "alpha beta gamma delta"), ("y", "alpha beta odd gamma delta"), ("z", "alpha and then much later on beta gamma")], "key string, text string")
    phrases = spark.createDataFrame([("alpha beta gamma", ["alpha", "beta", "gamma"])], "phrase string, w array<string>")
    assert {r.key for r in decontam.phrase_matches(docs, phrases).collect()} == {"x"}
    assert {r.key for r in decontam.proximity_matches(docs, phrases, slop=1).collect()} == {"x", "y"}


def brute_near(docs, items, length=13, slop=3, rarest=3):
    split = {i: words(t) for i, t in docs}
    df = {}
    for w in split.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asks = []
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - length + 1)) if w else ():
            known = sorted((df[t], off, t) for off, t in enumerate(w[k : k + length]) if t in df)[:rarest]
            if known:
                asks.append((item, [(t, off - known[0][1]) for _, off, t in known]))
    out = {}
    for i, w in split.items():
        at = {}
        for pos, t in enumerate(w):
            at.setdefault(t, []).append(pos)
        near = {item for item, ask in asks if any(all(any(abs(q - p - d) <= slop for q in at.get(t, ())) for t, d in ask) for p in at.get(ask[0][0], ()))}
        out[i] = (len(near), hashlib.sha256(",".join(sorted(near)).encode()).hexdigest())
    return out


def test_near_items_equal_brute_force(spark, odd_docs):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    moved = long.replace("five six", "five odd six").replace("nine ten", "ten nine")
    texts = odd_docs.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"])
    docs = texts.unionByName(spark.createDataFrame([(900, long), (901, moved), (902, long.replace(" ", " odd odd odd ")), (903, "Two THREE"), (904, "")], "doc_id long, text string").select(F.col("doc_id").cast(texts.schema["doc_id"].dataType), "text"))
    items = [("a", long), ("b", "the cat"), ("c", None), ("d", "..."), ("e", "no such words here"), ("f", "two gone three"), ("g", "the cat " * 9)]
    got = decontam.contamination(docs, spark.createDataFrame(items, "item_id string, text string"), near=True).collect()
    want = brute_near([(r.doc_id, r.text) for r in docs.collect()], items)
    assert {r.doc_id: (r.n_near, r.near_sha256) for r in got} == want
    counts = {r.doc_id: (r.n_items, r.n_near) for r in got}
    assert counts[900][1] >= 1 and counts[901][1] > counts[901][0] == 0 and counts[902][1] < counts[901][1]
    assert all(near >= exact for exact, near in counts.values())
