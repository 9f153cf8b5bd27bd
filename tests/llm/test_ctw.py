import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from codeatlas.llm import ctw
from codeatlas.llm.common import table


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def learns(doc_id):
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % 7 != 2


def steps(text):
    """(context, node, bit) of every decision, with the end byte."""
    data = bytes(ctw.DEPTH) + b" ".join(re.findall(rb"[^\x20\x09-\x0d]+", low(text).encode())) + b"\0"
    for i in range(ctw.DEPTH, len(data)):
        node = 1
        for k in range(7, -1, -1):
            bit = data[i] >> k & 1
            yield data[i - ctw.DEPTH : i], node, bit
            node = 2 * node + bit


def kt(n):
    return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.log(math.pi) - math.lgamma(n[0] + n[1] + 1)


def brute(rows):
    counts = defaultdict(lambda: [0, 0])
    for i, t in rows:
        if learns(i):
            for c, node, bit in steps(t):
                for d in range(ctw.DEPTH + 1):
                    counts[c[ctw.DEPTH - d :], node][bit] += 1
    below = defaultdict(float)
    weight = {}
    for d in range(ctw.DEPTH, -1, -1):
        for (c, node), n in [x for x in counts.items() if len(x[0][0]) == d]:
            own = kt(n)
            w = own if d == ctw.DEPTH else max(own, below[c, node]) + math.log1p(math.exp(-abs(own - below[c, node]))) - math.log(2)
            weight[c, node] = 1 / (1 + math.exp(min(700, below[c, node] - own)))
            if d:
                below[c[1:], node] += w
    tokens = Counter()
    split = {}
    for n, (i, t) in enumerate(rows):
        split[n] = re.findall(r"[^\x20\x09-\x0d]+", low(t)) + [None]
        if learns(i):
            tokens.update(split[n])
    total, kinds = sum(tokens.values()), len(tokens)
    out = []
    for n, (i, t) in enumerate(rows):
        score = 0.0
        for c, node, bit in steps(t):
            sure, left, here, share = 0.0, 1.0, 0.5, 0.5
            for d in range(ctw.DEPTH + 1):
                key = c[ctw.DEPTH - d :], node
                if key not in counts:
                    break
                if d:
                    sure, left = sure + left * share * here, left * (1 - share)
                here, share = (counts[key][1] + 0.5) / (sum(counts[key]) + 1), weight[key]
            p = sure + left * here
            score += math.log10(p if bit else 1 - p)
        base = sum(math.log10((tokens[w] + 1) / (total + kinds + 1)) for w in split[n])
        out.append((i, len(split[n]), sum(tokens[w] > 0 for w in split[n]), total, base, score))
    return out


def check(docs, rows):
    want = sorted(brute(rows), key=str)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ctw.score(docs).collect()), key=str)
    assert len(want) == len(got)
    by = defaultdict(list)
    for g in got:
        by[g[0]].append(g)
    for w in want:
        g = by[w[0]][0]
        assert w[:4] == g[:4]
        assert g[4] == pytest.approx(w[4], rel=1e-9) and g[5] == pytest.approx(w[5], rel=1e-6)


def test_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").orderBy("doc_id").limit(25)
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark, odd_docs):
    small = odd_docs.where("doc_id is null or doc_id not in (5, 6, 7)")
    check(small, [(r.doc_id, r.text) for r in small.collect()])
    assert ctw.score(odd_docs.limit(0)).count() == 0
    assert ctw.score(odd_docs).count() == 9


def test_beats_the_base_on_held_out_texts(spark, sf_dir):
    rows = [r for r in ctw.score(table(spark, sf_dir.replace("0.001", "0.1"), "documents")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert all(0 < r.bits_per_byte < 9 for r in rows)


def test_blocks_don_t_depend_on_how_the_scan_is_cut(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents")
    monkeypatch.setattr(ctw, "BLOCK_ROWS", 50)
    want = {r.doc_id: r.score for r in ctw.score(docs).collect()}
    counted = ctw.count

    def recut(rows, depth):
        out = ctw.materialise(counted(rows, depth), "grams")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        return out

    monkeypatch.setattr(ctw, "count", recut)
    try:
        got = {r.doc_id: r.score for r in ctw.score(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_long_texts_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "ab cd " * 3000), (2, "ab"), (3, "Ab  cd\n" * 700), (4, None), (2, "ab")], "doc_id long, text string").selectExpr("*", *[f"'v' as `{c}`" for c in ("block", "train", "part", "key", "value", "known")])
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_blocks_hold_fewer_rows_of_longer_texts_and_long_ones_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(ctw, "LONG", 500)
    spark.createDataFrame([(i, "x" * n) for i, n in enumerate([40, 160, 100, 501] * 50)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    sizes = {}
    for r in ctw.blocks(spark.read.parquet(str(tmp_path / "t")), "doc_id", "text", 7, 2).collect():
        sizes.setdefault(r.block, []).append(len(r.text))
    assert sum(map(len, sizes.values())) == 200
    assert all(x == [501] or (501 not in x and sum(x) <= 2000) for x in sizes.values()) and [501] in sizes.values() and any(len(x) > 4 for x in sizes.values())
