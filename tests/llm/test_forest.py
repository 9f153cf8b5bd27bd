import re

from codeatlas.llm import forest
from codeatlas.llm.common import table


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, num, den):
    """doc_id -> (set size, least id reachable)."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = {}
    for n, (_, s) in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(n)
    met = {(a, b) for group in index.values() for i, a in enumerate(group) for b in group[i + 1 :]}
    for a, b in met:
        both = len(sets[a][1] & sets[b][1])
        if den * both >= num * (len(sets[a][1]) + len(sets[b][1]) - both):
            root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(sets):
        r = find(n)
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    return {(i, len(s), least[find(n)]) for n, (i, s) in enumerate(sets)}


def check(docs, k, num, den):
    want = brute([(r.doc_id, r.text) for r in docs.collect()], k, num, den)
    rows = forest.near_duplicates(docs, k=k, num=num, den=den).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows} == want
    assert len(rows) == docs.count()
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in rows)


def test_whole_table_equals_brute_force(spark, sf_dir):
    check(table(spark, sf_dir, "documents"), 3, 85, 100)


def test_odd_rows(spark, odd_docs):
    check(odd_docs, 5, 80, 100)
    assert forest.near_duplicates(odd_docs.limit(0)).count() == 0
    left = forest.keep_one(odd_docs)
    assert left.columns == odd_docs.columns
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 1, 2, 3, 4, 5, 6, 7]


def test_a_dense_region_is_joined_whole(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(n, " ".join(base[: n % 150 + 10] + [f"x{n}"] + base[n % 150 + 11 :])) for n in range(400)]
    docs = spark.createDataFrame([*rows, (1000, "short text"), (1001, "Short  text"), (1002, "short texts")], "doc_id long, text string")
    check(docs, 3, 85, 100)


def with_own_words(n, places):
    """A text of 120 words that all share, but at some places its own."""
    return [f"own{n}x{i}" if i in places else f"w{i}" for i in range(120)]


def test_copies_among_many_texts_of_one_template_are_found(spark):
    # any two texts have similarity 112 / 126, under the threshold; text and copy 113 / 125, above it
    rows = [(n, with_own_words(n, range(30, 36))) for n in range(1500)]
    copies = [(10_000 + n, [f"copy{n}" if i in (10, 60, 100) else w for i, w in enumerate(words)]) for n, words in rows[::50]]
    docs = spark.createDataFrame([(n, " ".join(words)) for n, words in rows + copies], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in forest.near_duplicates(docs, k=2, num=90, den=100).collect()}
    assert got == {n: n % 10_000 for n, _ in rows + copies}


def test_texts_near_only_an_inner_member_of_a_group_are_joined(spark):
    # the texts of the group have similarity 115 / 123; each other text 113 / 125 with one of them, 109 / 129 with the rest
    group = [(n, with_own_words(n, range(30, 33))) for n in range(700)]
    others = [(10_000 + n, [f"other{n}" if i in (10, 60, 100) else w for i, w in enumerate(words)]) for n, words in group[::20]]
    docs = spark.createDataFrame([(n, " ".join(words)) for n, words in group + others], "doc_id long, text string").repartition(4)
    got = forest.near_duplicates(docs, k=2, num=90, den=100).collect()
    assert len(got) == 735 and {r.component_id for r in got} == {0}
