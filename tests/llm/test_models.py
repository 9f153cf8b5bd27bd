"""Held-out accuracy of the fitted models, and their odd rows."""

import numpy as np

from codeatlas.llm import quality, toxicity
from codeatlas.llm.common import table


def test_quality_on_held_out_rows(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.01")
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = quality.score(docs, labels)
    held = rows.join(labels, "doc_id").where("held_out").collect()
    assert rows.count() == docs.count()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in held)


def test_flat_trees_equal_walking_them():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.fit(x, y)
    for row in range(0, 400, 37):
        raw = model.start
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + (2 if x[row, f[k]] > t[k] else 1)
            raw += v[k - len(f)]
        assert abs(model.probability(x[row : row + 1])[0] - 1 / (1 + np.exp(-raw))) < 1e-9
    assert ((model.probability(x) > 0.5) == y).mean() > 0.95


def test_toxicity_on_held_out_rows(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.1")
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    scored = toxicity.score(docs, labels).withColumnRenamed("toxic", "judged")
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.judged for r in rows if r.toxic == 1]) > 0.75
    assert np.mean([r.judged for r in rows if r.toxic == 0]) < 0.05
    assert all(0 <= r.severity <= toxicity.GRADES - 1 for r in rows)


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (7, 1, None), (None, 0, 1), (6, None, 0)], "doc_id long, quality int, toxic int")
    for got in (quality.score(odd_docs, labels), toxicity.score(odd_docs, labels)):
        assert got.count() == 9
    for got in (quality.score(odd_docs, labels.limit(0)), toxicity.score(odd_docs, labels.limit(0)), quality.score(odd_docs.limit(0), labels)):
        assert got.count() in (0, 9)
    assert toxicity.keep_clean(odd_docs, labels).columns == odd_docs.columns


def test_thresholds_rise_and_share_weights():
    rng = np.random.default_rng(2)
    n = 600
    strength = rng.integers(0, 4, n)
    lists = [np.unique(np.concatenate([np.arange(10, 10 + s), rng.integers(1000, 1100, 5)])) for s in strength]
    index, first = np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    model = toxicity.fit(index, first, strength, 4)
    assert (np.diff(model.theta) > 0).all()
    severity = model.above(index, first).sum(axis=1)
    assert np.corrcoef(severity, strength)[0, 1] > 0.9


CLASH = [f"'v' as `{c}`" for c in ("held_out", "score", "predicted", "stats", "severity", "toxic", "grade", "_id", "_h", "_y", "marks")]


def test_odd_rows_have_the_values_of_their_texts(spark, odd_docs):
    labels = spark.createDataFrame([(n, n % 2, n % 2) for n in range(1, 200)] + [(1, 0, 0)], "doc_id long, quality int, toxic int")
    more = spark.createDataFrame([(n, ("good plain words here " if n % 2 else "vile ### words!! ") * (8 + n % 5)) for n in range(10, 200)], "doc_id long, text string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True)
    for run, columns in ((quality.score, ("score", "predicted")), (toxicity.score, ("severity", "p_toxic", "grade", "toxic"))):
        rows = run(docs, labels).collect()
        value = lambda r: tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns)  # noqa: E731, B023
        by = {}
        for r in rows:
            by.setdefault(r.doc_id, set()).add(value(r))
        assert len(rows) == docs.count() and len(by[1]) == 1  # repeated rows are equal
        assert by[2] == by[3]  # a null text is an empty one
        assert all(0 <= next(iter(v))[0] <= 3 for v in by.values())
        # other columns, whatever their names, and other orders of rows change nothing
        again = {(str(r.doc_id), value(r)) for r in run(docs.selectExpr("*", *CLASH).orderBy("text"), labels.selectExpr("*", "'w' as text", "'w' as _y")).collect()}
        assert again == {(str(r.doc_id), value(r)) for r in rows}
    assert toxicity.score(odd_docs.limit(0), labels).count() == quality.score(odd_docs.limit(0), labels).count() == 0
    # without labels of both kinds nothing is toxic, and quality is the share of label 1
    assert {r.toxic for r in toxicity.score(odd_docs, labels.where("toxic = 1")).collect()} == {False}
    assert {round(r.score, 6) for r in quality.score(odd_docs, labels.limit(0)).collect()} == {0.5}


def test_splits_are_the_best_of_all():
    rng = np.random.default_rng(8)
    for _ in range(20):
        n, features = 60, 3
        binned = rng.integers(0, 6, (n, features))
        g, h = rng.standard_normal(n), rng.uniform(0.1, 1, n)
        best, where = 1e-9, None
        for f in range(features):
            for cut in range(quality.BINS):
                left = binned[:, f] <= cut
                if min(left.sum(), n - left.sum()) >= quality.LEAST_ROWS:
                    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.L2)  # noqa: E731, B023
                    gain = part(left) + part(~left) - part(np.ones(n, dtype=bool))
                    if gain > best + 1e-12:
                        best, where = gain, (f, cut)
        got = quality.best_split(binned + np.arange(features) * quality.BINS, g, h, features)
        assert got == where or (got and where and got[0] == where[0] and ((binned[:, got[0]] <= got[1]) == (binned[:, where[0]] <= where[1])).all())


def test_probabilities_above_a_grade_are_shared_sums_against_thresholds():
    rng = np.random.default_rng(9)
    model = toxicity.Model(rng.standard_normal(toxicity.BUCKETS), np.array([-0.5, 0.25, 1.5]))
    lists = [rng.integers(0, toxicity.BUCKETS, k) for k in (0, 1, 7, 30)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    got = model.above(np.concatenate(lists), first)
    for row, x in zip(got, lists, strict=True):
        total = sum(float(model.weight[i]) for i in x)
        assert np.allclose(row, [1 / (1 + np.exp(-(total - t))) for t in model.theta]) and (np.diff(row) <= 0).all()


def test_fitted_weights_stand_still_where_the_likelihood_is_flat():
    """The fit's end against the likelihood itself: no step along a weight or threshold gains much."""
    rng = np.random.default_rng(10)
    n = 300
    lists = [np.unique(rng.integers(0, 40, rng.integers(1, 8))) for _ in range(n)]
    strength = rng.standard_normal(40)
    z = np.array([strength[x].sum() for x in lists])
    grade = np.digitize(z + rng.logistic(0, 0.5, n), [-1.0, 0.5])
    index, first = np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    model = toxicity.fit(index, first, grade, 3)

    def loss(weight, theta):
        out = 0.0
        for x, g in zip(lists, grade, strict=True):
            above = [1.0, *[1 / (1 + np.exp(-(weight[x].sum() - t))) for t in theta], 0.0]
            out -= (n / (2 * max(1, (grade > 0).sum())) if g else n / (2 * max(1, (grade == 0).sum()))) * np.log(max(above[g] - above[g + 1], 1e-12))
        return out + toxicity.L2 / 2 * (weight**2).sum()

    here = loss(model.weight, model.theta)
    assert here < loss(np.zeros_like(model.weight), model.theta)
    moved = []
    for k in range(40):
        for d in (-0.25, 0.25):
            other = model.weight.copy()
            other[k] += d
            moved.append(loss(other, model.theta) - here)
    assert min(moved) > -0.02 * here and np.corrcoef(model.weight[:40], strength)[0, 1] > 0.8


def test_the_ordinal_fit_holds_only_features_that_occur():
    import tracemalloc

    from codeatlas.llm import toxicity

    index, first = np.array([5, 900_000, 5, 70, 900_000, 70]), np.array([0, 2, 4, 6])
    tracemalloc.start()
    try:
        model = toxicity.fit(index, first, np.array([0, 1, 1]), 2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert set(np.flatnonzero(model.weight)) <= {5, 70, 900_000} and len(model.weight) == toxicity.BUCKETS
    assert peak < 2 * model.weight.nbytes
