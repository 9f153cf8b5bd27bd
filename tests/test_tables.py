import pytest

from codeatlas.functions import tables


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_what_is_not_proven_small_is_never_broadcast(spark, monkeypatch, how):
    rows = tables.settle(spark.range(400).selectExpr("id", "if(id < 200, 0, id % 50) as k"), "rows")
    keyed = tables.settle(spark.range(40).selectExpr("id as k", "id * id as v"), "keyed")
    joins = {
        "sided": lambda: rows.join(tables.sided(keyed), "k", how),
        "looked_up": lambda: tables.looked_up(rows, keyed, ["k"], how),
        "dealt": lambda: tables.dealt(rows, keyed, ["k"], how),
    }
    want = sorted(map(tuple, rows.join(keyed, "k", how).collect()), key=str)
    for limit in (100_000, 0):
        monkeypatch.setattr(tables, "LOOKUP_ROWS", limit)
        monkeypatch.setattr(tables, "HOT_ROWS", 100 if limit else 10)
        for name, join in joins.items():
            out = join()
            assert sorted(map(tuple, out.collect()), key=str) == want, name
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert ("Broadcast" in plan) == bool(limit), (name, plan)
