"""Quality rules: counts against brute force, the forest's verdict on held-out rows, and odd rows."""

import re
from collections import Counter

import numpy as np

from codeatlas.llm import rules
from codeatlas.llm.common import table


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def counts_of(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_counts_equal_brute_force(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    got = {r.doc_id: r for r in rules.judge(docs, labels).collect()}
    for r in docs.collect():
        assert counts_of(got[r.doc_id]) == plain(r.text)
        assert not (got[r.doc_id].base_failed and got[r.doc_id].kept)


def test_windows_and_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(rules, "PIECE", 7)
    for n in (0, 1, 7, 8, 9, 16, 60, 200):
        text = " ".join(f"w{i}é" for i in rng.integers(0, 3, n)) + "\n\n x\v\n x\v\r\n"
        counts, _ = rules.counted(text.encode())
        assert tuple(counts) == plain(text)[:5]


def test_held_out_rows(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.1")
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = rules.judge(docs, labels).where("not base_failed and held_out").join(labels, "doc_id").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.98
    assert np.mean([r.kept for r in rows if r.quality == 0]) < 0.1


def test_the_limit_spares_good_rows_and_ties_are_kept():
    rng = np.random.default_rng(5)
    good = np.column_stack([rng.normal(2, 0.1, 900), np.zeros(900)])
    bad = np.column_stack([rng.normal(2, 0.1, 100), rng.uniform(3, 4, 100)])
    x, y = np.concatenate([good, bad]), np.arange(1000) < 900
    forest = rules.calibrated(rules.grow(good, x.min(axis=0), x.max(axis=0)), x, y)
    away = forest.anomalous(x)
    assert away[y].mean() <= rules.SPARE and away[~y].mean() > 0.95
    assert not forest.anomalous(x[forest.paths(x) == forest.limit]).any()
    # a path's length is its depth and what the rows at its end would take
    one = rules.grow(good, x.min(axis=0), x.max(axis=0), trees=1)
    node, depth = 0, 0
    while one.threshold[0][node] < np.inf:
        node, depth = 2 * node + 1 + int(x[-1, one.feature[0][node]] > one.threshold[0][node]), depth + 1
    assert abs(one.paths(x[-1:])[0] - depth) < 1e-9  # no good row is near it


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, 1), (None, 0), (6, None), (1, 0)], "doc_id long, quality int")
    clash = odd_docs.selectExpr("*", *[f"'v' as `{c}`" for c in ("counts", "shares", "held_out", "_id", "_h", "_y", "kept")])
    want = sorted((str(r.doc_id), *plain(r.text)) for r in odd_docs.collect())
    for got in (rules.judge(clash, labels), rules.judge(odd_docs, labels.limit(0))):
        rows = got.collect()
        assert sorted((str(r.doc_id), *counts_of(r)) for r in rows) == want
        assert len({(r.kept, r.path_length) for r in rows if r.doc_id == 1}) == 1
    assert all(r.kept == (not r.base_failed) for r in rules.judge(odd_docs, labels.limit(0)).collect())
    assert rules.judge(odd_docs.limit(0), labels).count() == 0
    left = rules.keep_good(clash, labels)
    assert left.columns == clash.columns and all(r.counts == "v" and plain(r.text)[5] is False for r in left.collect())


def test_every_labelled_row_counts(spark):
    rng = np.random.default_rng(11)
    n = 26_000  # 20,800 outside the held-out fold
    words = np.array(["alpha", "BETA", "gamma!", "de#ta", "eps|lon", "zeta", "Eta", "THETA"])
    shares = rng.dirichlet(np.ones(8), n)
    rows = [(i, " ".join(rng.choice(words, 24, p=shares[i])) + f" {i}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, int(i % 20 > 0)) for i in range(n)], "doc_id long, quality int")
    got = {r.doc_id: r for r in rules.judge(docs, labels).collect()}
    trained = [i for i in range(n) if not got[i].held_out and not got[i].base_failed]
    assert len(trained) > 20_000
    good = [i for i in trained if i % 20]
    # the limit is the exact rank among all good rows, not among some of them
    paths = np.sort([got[i].path_length for i in good])
    limit = paths[int(rules.SPARE * len(good))]
    assert all(got[i].kept == (got[i].path_length >= limit) for i in trained)
    # and the trees are those that hold all rows
    x, y = np.array([rules.counted(rows[i][1].encode())[1] for i in trained]), np.array([i % 20 > 0 for i in trained])
    forest = rules.grow(x[y], x.min(axis=0), x.max(axis=0))
    assert np.array_equal(forest.paths(x), [got[i].path_length for i in trained])


def test_a_path_ends_at_the_first_part_with_one_row_or_none():
    rng = np.random.default_rng(7)
    x = np.round(rng.uniform(0, 3, (300, 3)), 1)
    x[:, 1] = 2.0
    x[:9] = x[0]
    asked = np.concatenate([x, rng.uniform(-1, 4, (50, 3))])
    empty = rules.splits(x.min(axis=0), x.max(axis=0), trees=5, depth=6)
    found = rules.grow(x, x.min(axis=0), x.max(axis=0), trees=5, depth=6)
    lengths = np.zeros(len(asked))
    for f, t in zip(empty.feature, empty.threshold):
        assert set(f[t < np.inf]) == {0, 2}  # a side without width is never cut
        for i, row in enumerate(asked):
            node, level, held = 0, 0, x
            while level < 6 and len(held) > 1:
                right = row[f[node]] > t[node]
                held = held[(held[:, f[node]] > t[node]) == right]
                node, level = 2 * node + 1 + int(right), level + 1
            m = len(held)
            lengths[i] += level + (2 * (np.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m if m > 1 else 0)
    assert np.allclose(found.paths(asked), lengths / 5)
    assert np.array_equal(found.counts(x).sum(axis=1), [300] * 5)


def test_an_odd_labelled_row_does_not_widen_the_box():
    most = np.log1p(100)
    for text in ("word " * 20 + "#" * 10**6, "word " * 20 + "!" * 10**6, "A A\n" * 1000, "#!" * 1000, ""):
        assert all(0 <= x <= most for x in rules.counted(text.encode())[1])
    lots, more = (rules.counted(("one two three " + "#!" * n).encode())[1] for n in (50, 60))
    assert more[0] > lots[0] and more[-1] > lots[-1]  # bounded, yet never the same
