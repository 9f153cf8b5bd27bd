"""Ranked search against brute force, over many shards and blocks, and odd rows."""

import math
import re
from collections import Counter

import numpy as np

from codeatlas.llm import ranked
from codeatlas.llm.common import table

from brute import lowered


def plain(docs, items, most=10):
    """(item_id, rank, doc_id, score) of lists of (id, text)."""
    terms = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(t))
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, words = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if df[t]}
        scored = [(sum(v * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * size * n // words))) for t, v in w.items() if c[t]), i) for i, c, size in held]
        best = sorted((-s, i is None, i or 0) for s, i in scored if s > 0)[:most]
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(best)]
    return sorted(out, key=str)


def got(docs, items, **options):
    return sorted((tuple(r) for r in ranked.search(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_answers_equal_brute_force(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(docs, items) == want
    # shards of a few documents over several tasks, and blocks of a few items
    assert got(docs.repartition(3), items, shard_bytes=20_000, block_terms=300) == want
    assert len(want) == 10 * items.count()


def test_all_terms_are_indexed_if_the_items_have_too_many(spark, sf_dir, monkeypatch):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").limit(5)
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    monkeypatch.setattr(ranked, "is_small", lambda df: False)
    assert got(docs, items, block_terms=40) == want


def test_lists_are_packed_and_unpacked():
    rng = np.random.default_rng(6)
    values = np.concatenate([[0, 127, 128, 16383, 16384, 2**63 - 1], rng.integers(0, 1 << 40, 200)])
    assert (ranked.unpacked(ranked.packed(values)[0].tobytes()) == values).all()
    ids = np.sort(rng.integers(-(2**62), 2**62, 50))
    assert (np.cumsum(ranked.unpacked(ranked.packed(np.diff(ids, prepend=0))[0].tobytes())) == ids).all()
    assert not len(ranked.unpacked(b""))


def test_weak_lists_lose_nothing():
    rng = np.random.default_rng(7)
    for _ in range(60):
        n, most = int(rng.integers(1, 120)), int(rng.integers(1, 6))
        lists = ranked.Lists(ranked.packed(np.ones(n))[0].tobytes(), ranked.packed(np.full(n, 5))[0].tobytes(), n, 5 * n)
        rows = {f"t{k}": (np.sort(rng.choice(n, int(rng.integers(1, n + 1)), replace=False)), int(rng.integers(1, 9))) for k in range(int(rng.integers(1, 7)))}
        for t, (docs, _) in rows.items():
            lists.raw[t] = ranked.packed(np.diff(docs, prepend=0))[0].tobytes(), ranked.packed(np.ones(len(docs)))[0].tobytes()
        best = []
        ranked.search_shard(lists, [(t, w) for t, (_, w) in rows.items()], best, most)
        total = Counter()
        for docs, w in rows.values():
            for d in docs:
                total[int(d) + 1] += w * (10**9 // (1000 + 8 * 100))
        assert sorted((-s, -i) for s, _, i in best) == sorted((-s, d) for d, s in total.items())[:most]


def test_odd_rows(spark, odd_docs):
    items = [(1, "The CAT é 漢字"), (1, "the cat é 漢字"), (1, "the cat é 漢字"), (None, "hund katze"), (2, ""), (3, None), (4, "nowhere"), (5, "cat " * 9000)]
    more = spark.createDataFrame([(-5, "cat"), (-5, "cat"), (30, "cat"), (2**62, "cat"), (None, "cat"), (-(2**62), "dog cat")], "doc_id long, text string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True).selectExpr("*", *[f"'v' as `{c}`" for c in ("shard", "term", "item", "n", "score", "rank")])
    table_ = spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "'v' as term", "'w' as doc_id", "1 as item")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], items)
    assert got(docs, table_) == want and got(docs.repartition(2), table_, shard_bytes=10) == want and want
    assert ranked.search(docs.limit(0), table_).count() == 0 and ranked.search(docs, table_.limit(0)).count() == 0
