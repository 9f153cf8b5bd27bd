import hashlib
import re
import time

import pytest

from codeatlas.functions import tables
from codeatlas.llm import pii
from codeatlas.llm.common import table

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    found = []
    for rank, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p[-400:]) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def same(rows, texts):
    for row, text in zip(rows, texts, strict=True):
        want = brute(text)
        assert row.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (row, want)
        assert set(filter(None, want.split(","))) <= set(row.spans.split(","))
        for kind in RULES:
            assert row[f"n_{kind}"] == want.count(kind + ":")


def test_base_equals_brute_force_on_the_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pii.digest(pii.extract(docs)).collect()
    assert len(rows) == len(texts)
    same(rows, [texts[r.doc_id] for r in rows])


def test_odd_rows(spark, odd_docs):
    pairs = odd_docs.collect()
    rows = pii.digest(pii.extract(odd_docs)).collect()
    assert len(rows) == len(pairs)
    by = {r.doc_id: r for r in rows}
    for p in pairs:
        same([by[p.doc_id]], [p.text])


@pytest.mark.parametrize("text", ["a@b.com_x@d.e", "a..b@c", "1.2.3.4.5.6.7.8", "1-2 3--4", "+1+12345678901", "+1 2 (", "12 34 5678 9012 3456 7", "x@y.z@w.v", "00000000001.0255.0.256"])
def test_corner_strings(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    same(pii.digest(pii.extract(docs)).collect(), [text])


def test_contexts_discover_what_the_base_misses(spark):
    rows = [(i, f"please call our desk at +1 (3{i}6) 555-98{i:02d} today") for i in range(10, 30)]
    rows += [(100, "please call our desk at (366) 555 0199 today"), (101, "the table shows 366 555 0199 units sold")]
    got = {r.doc_id: r for r in pii.digest(pii.extract(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[100].n_added == 1 and got[100].spans.startswith("phone:24:") and got[100].n_phone == 0
    assert got[101].n_added == 0


def test_empty_table_and_redaction(spark, odd_docs):
    assert pii.digest(pii.extract(odd_docs.limit(0))).count() == 0
    clean = pii.redact(odd_docs, pii.extract(odd_docs))
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count()
    assert "[EMAIL]" in [r.text for r in clean.collect() if r.doc_id == 1][0]


def test_long_texts_and_long_lists_take_linear_time(spark):
    many = " ".join(f"a{i}@b{i}.org" for i in range(100_000))
    texts = ["x at b" + ".c" * 20_000, many, "x at y dot com " * 20_000, "1" * 100_000, "ab1" * 50_000, "+1 (" * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    found = pii.extract(docs)
    got = {r.doc_id: r for r in pii.digest(found).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(docs, found).collect()}
    assert time.time() - began < 120
    assert got[1].n_email == 100_000 and clean[1] == " ".join(["[EMAIL]"] * 100_000)
    same([got[1]], [texts[1]])  # brute force takes the square of a run


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f'text of any kind token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and more') for i in range(12)]
    rows += [(50, 'other text token = "Zk39-qLmW8xTnB27vR" and so on'), (51, "a file named Zk39-qLmW8xTnB27vR and so on"), (52, f"the commit {hashlib.sha1(b'c').hexdigest()} was fine")]
    rows += [(60 + i, f"write to me at bob{i}@mail.example.org today please") for i in range(12)] + [(90, "write to me at bob [at] mail [dot] example [dot] org today please")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.extract(docs)
    got = {r.doc_id: r for r in pii.digest(found).collect()}
    assert all(got[i].spans == "secret:26:66" for i in range(12))
    assert got[50].spans.startswith("secret:20:") and got[51].n_spans == 0 and got[52].n_spans == 0
    assert got[90].spans.startswith("email:15:") and got[90].n_email == 0 and got[90].n_added == 1
    clean = {r.doc_id: r.text for r in pii.redact(docs, found).collect()}
    assert clean[50] == 'other text token = "[SECRET]" and so on' and clean[90] == "write to me at [EMAIL] today please"


def test_redaction_keeps_clashing_columns_and_cuts_across_pieces(spark):
    text = "é" * (pii.CHARS - 5) + " bob@mail.example.com end"
    docs = spark.createDataFrame([(1, text, "k", "c", 3)], "doc_id long, text string, row_key string, fresh string, _row_key int")
    (row,) = pii.redact(docs, pii.extract(docs)).collect()
    assert row.text == "é" * (pii.CHARS - 5) + " [EMAIL] end" and (row.row_key, row.fresh, row._row_key) == ("k", "c", 3)


def test_keys_of_any_length_are_found(spark):
    key = lambda n: (hashlib.sha512(str(n).encode()).hexdigest() * 5)[:n]
    rows = [(i, f'text token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and more') for i in range(12)]
    rows += [(n, f'text token = "{key(n)}" and more') for n in (200, 201, 640)]
    got = {r.doc_id: r.spans for r in pii.digest(pii.extract(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert all(got[n] == f"secret:14:{14 + n}" for n in (200, 201, 640))


def test_lookups_that_are_not_proven_small_are_never_broadcast(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents")
    want = sorted(map(tuple, pii.digest(pii.extract(docs)).collect()), key=str)
    monkeypatch.setattr(tables, "LOOKUP_ROWS", -1)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    assert sorted(map(tuple, pii.digest(pii.extract(docs)).collect()), key=str) == want
    plans = [store.executionsList(i, 1).head().physicalPlanDescription() for i in range(before, store.executionsCount())]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
