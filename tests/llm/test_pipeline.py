"""Each stage of the pipeline against brute force, and whatever columns a table may bring."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline
from codeatlas.functions import tables
from codeatlas.llm import decontam, forest, mixing, pii, toxicity
from codeatlas.llm.common import table

from brute import contaminated, near_groups


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_toxicity_keeps_what_the_score_leaves(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest tables hold too few labels to learn from
    docs = table(spark, sf_dir, "documents")
    kept = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"))
    assert kept.columns == docs.columns and ids(kept) == ids(scored.where("not toxic")) and 0 < len(ids(kept)) < docs.count()


def test_near_copies_leave_the_least_of_each_group(spark, docs, sf_dir):
    rows = docs.collect()
    want = sorted(min(g) for g in near_groups({r.doc_id: r.text for r in rows}, 5, 0.8))
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert kept.columns == docs.columns and ids(kept) == want and len(want) < len(rows)


def test_contaminated_rows_go(spark, docs, sf_dir):
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    want = sorted(r.doc_id for r in docs.collect() if not contaminated(r.text, items))
    kept = corpus_pipeline.drop_contaminated(spark, docs, sf_dir)
    assert kept.columns == docs.columns and ids(kept) == want and len(want) < docs.count()


def test_personal_data_is_cut_and_nothing_else(spark, docs, sf_dir):
    spans = {r.doc_id: r.spans for r in pii.digest(pii.extract(docs)).collect()}
    got = {r.doc_id: r for r in corpus_pipeline.redact_personal_data(spark, docs, sf_dir).collect()}
    changed = 0
    for r in docs.collect():
        want, at = [], 0
        for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in filter(None, spans[r.doc_id].split(",")))), key=lambda s: (s[1], s[2], s[0])):
            if a >= at:
                want += [r.text[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        whole = "".join(want) + (r.text or "")[at:]
        assert (got[r.doc_id].text or "") == whole and got[r.doc_id].n_chars == len(whole)
        changed += bool(want)
    assert changed


def test_the_mix_comes_near_its_targets(spark, docs, sf_dir):
    plan = {r.doc_id: r for r in mixing.mix(docs).collect()}
    copies = defaultdict(int)
    words = defaultdict(int)
    for r in corpus_pipeline.mix_sources(spark, docs, sf_dir).collect():
        copies[r.doc_id] += 1
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0d]+", r.text or ""))
    sources = {r.doc_id: r.source for r in docs.collect()}
    largest = max(r.size for r in plan.values())
    assert all(copies[i] == r.repeats <= 3 for i, r in plan.items())
    assert all(abs(words[sources[i]] - r.target) <= largest for i, r in plan.items())


def test_run_is_its_stages_one_after_the_other(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "pii", "mixing"]
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy_no"] and out.count() > 0


NAMES = "key mark name same_text skey h whole cut copy_no row_key fresh _i _m _key _h _skey _size salt piece".split()


@pytest.mark.parametrize("step", ["clean", "one", "redact", "take", "toxic"])
def test_clashing_columns_keep_their_values(spark, odd_docs, step):
    df = odd_docs.drop("key").selectExpr("*", *[f"concat('{n}', cast(n_chars as string)) as `{n}`" for n in NAMES]).cache()
    items = spark.createDataFrame([("a", "the cat sat on the mat")], "item_id string, text string")
    labels = spark.createDataFrame([(1, 1), (6, 0)], "doc_id long, toxic int")
    run = {
        "clean": lambda: decontam.keep_clean(df, items), "one": lambda: forest.keep_one(df, k=5, num=80, den=100), "redact": lambda: pii.redact(df, pii.extract(df)),
        "take": lambda: mixing.take(df), "toxic": lambda: toxicity.keep_clean(df, labels),
    }
    out = run[step]()
    assert out.columns[: len(df.columns)] == df.columns
    rows = out.collect()
    assert rows and all(r[n] == (None if r.n_chars is None else f"{n}{r.n_chars}") for r in rows for n in NAMES)


def test_redaction_broadcasts_nothing_that_is_not_proven_small(spark, docs, sf_dir, monkeypatch):
    found = pii.materialise(pii.extract(docs), "found")
    want = sorted(map(tuple, pii.redact(docs, found).collect()), key=str)
    monkeypatch.setattr(tables, "LOOKUP_ROWS", -1)
    out = pii.redact(docs, found)
    assert sorted(map(tuple, out.collect()), key=str) == want != sorted(map(tuple, docs.collect()), key=str)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
