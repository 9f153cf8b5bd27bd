"""Fill-in-the-middle: cuts against brute force, exact round trips, and odd rows."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from codeatlas.llm import fim
from codeatlas.llm.common import table


def plain(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    name = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(name[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    before, hole, rest = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(before), len(hole), f"<S>{rest}<P>{before}<M>{hole}"
    return n, "psm", len(before), len(hole), f"<P>{before}<S>{rest}<M>{hole}"


def check(docs, **options):
    got = fim.transform(docs, **options).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((str(r.doc_id), *map(str, plain(r.doc_id, r.text, **options)), r.text or "") for r in docs.collect())
    assert sorted((str(r.doc_id), str(r.n), r.form, str(r.prefix_chars), str(r.middle_chars), r.output, r.back) for r in got) == want
    return got


def test_outputs_equal_brute_force(spark, sf_dir):
    forms = {r.form for r in check(table(spark, sf_dir, "documents"))}
    assert forms == {"psm", "spm"} or forms == {"psm", "spm", "plain"}
    check(table(spark, sf_dir, "documents"), rate=40, spm=10)


def test_digests_are_of_the_whole_output(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    for r in fim.digest(fim.transform(table(spark, sf_dir, "documents"))).collect():
        assert r.output_sha256 == hashlib.sha256(plain(r.doc_id, docs[r.doc_id])[4].encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def test_checkpoints_find_every_unit():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 63, 64, 65, 500):
        for stride, piece in ((1, 5), (4, 3), (64, 17), (7, 1 << 20)):
            text = "".join(rng.choice(list("aé😀\n\n")) for _ in range(n))
            units = re.findall(r"[^\n]*\n|[^\n]+", text)
            index = fim.Checkpoints(text.encode(), stride, piece)
            assert index.n == len(units) and len(index.at_byte) <= 1 + n // stride
            for k in range(len(units) + 1):
                before = "".join(units[:k])
                assert index.after(k) == (len(before.encode()), len(before))


def test_odd_rows(spark, odd_docs):
    more = spark.createDataFrame([(8, "a<P>b\nc"), (9, "x <M>\n"), (10, "<S>"), (11, "\n"), (12, "<\nP>\n<\nS><"), (13, "é\n" * 70000)], "doc_id long, text string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True).selectExpr("*", *[f"'v' as `{c}`" for c in ("h1", "n", "form", "output")])
    got = check(docs)
    assert {r.form for r in got if r.doc_id in (2, 3, 8, 9, 10)} == {"plain"}
    assert len({r.output for r in got if r.doc_id == 1}) == 1
    assert fim.digest(fim.transform(docs.limit(0))).count() == 0
