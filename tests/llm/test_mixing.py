import duckdb
import pytest

from codeatlas.llm import mixing
from codeatlas.llm.common import table


def by_sorting(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return sorted(con.sql(mixing.ORACLE_SQL.replace("\\\\", "\\")).fetchall(), key=str)


def check(docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = sorted((tuple(r) for r in mixing.mix(docs).collect()), key=str)
    want = by_sorting(rows)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and g[4:] == w[4:] and g[3] == pytest.approx(w[3])


def test_table_equals_sorting(spark, sf_dir):
    check(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def test_odd_rows(spark, odd_docs):
    check(odd_docs.select("doc_id", "text", "source"))
    assert mixing.mix(odd_docs.limit(0)).count() == 0
    taken = mixing.take(odd_docs)
    assert taken.columns == [*odd_docs.columns, "copy_no"]


def test_targets_are_met_and_capped(spark):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3] if i % 10 else "d") for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {}
    for r, (_, _, s) in zip(sorted(out, key=lambda r: r.doc_id), rows, strict=True):
        assert r.taken <= 3 * r.size
        t = by.setdefault(s, [0, r.target])
        t[0] += r.taken
    for taken, target in by.values():
        assert abs(taken - target) <= 7
    assert sum(t for _, t in by.values()) == pytest.approx(sum(r.size for r in out))
