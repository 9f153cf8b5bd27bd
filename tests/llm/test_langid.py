from codeatlas.llm import langid
from codeatlas.llm.common import table


def test_held_out_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir.replace("0.001", "0.01"), "documents")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert 150 < len(held) < 350
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark, odd_docs):
    rows = langid.identify(odd_docs).collect()
    assert len(rows) == 9
    by = {r.doc_id: r for r in rows}
    assert by[2].lang_pred == by[3].lang_pred == by[4].lang_pred == by[6].lang_pred == "und"
    assert by[5].lang_pred == "en" and by[2].score == 0
    assert langid.identify(odd_docs.limit(0)).count() == 0


def test_labels_of_held_out_rows_are_never_read(spark, odd_docs):
    from pyspark.sql import functions as F

    from codeatlas.llm.common import fold

    hidden = odd_docs.withColumn("lang", F.when(fold("doc_id", 4) == 2, F.lit("xx")).otherwise(F.col("lang")))
    assert [tuple(r) for r in langid.identify(hidden).collect()] == [tuple(r) for r in langid.identify(odd_docs).collect()]


def test_a_rare_language_with_one_short_row_leaves_the_others_alone(spark, sf_dir):
    from pyspark.sql import functions as F

    from codeatlas.llm.common import fold

    docs = table(spark, sf_dir.replace("0.001", "0.01"), "documents").select("doc_id", "text", "lang")
    free = [n for n in range(-1, -40, -1) if spark.range(1).select(fold(F.lit(n), 4)).first()[0] != 2][:2]
    rare = spark.createDataFrame([(free[0], "12 34 !", "aa"), (free[1], "kurz mal", "ab")], docs.schema)
    alone = {r.doc_id: tuple(r) for r in langid.identify(docs).collect()}
    got = {r.doc_id: tuple(r) for r in langid.identify(docs.union(rare)).collect()}
    assert {n: r for n, r in got.items() if n in alone} == alone


def test_long_training_texts_are_sampled_to_their_end(spark):
    text = "a" * 5000 + "b" * 5000 + "c" * 5000
    docs = spark.createDataFrame([(n, text, "en") for n in range(8)], "doc_id long, text string, lang string")
    rows = langid.sample(docs, "doc_id", "text", "lang", 4, 2)["en"]
    assert rows and all({*"abc"} <= {*r.decode()} and r.endswith(b"c") and len(r) <= langid.SAMPLE_CHARS + langid.PIECES for r in rows)


def test_a_dictionary_holds_all_texts_that_fit():
    assert langid.dictionary([b"one", b"two"]) == b"one\ntwo"
    rows = [bytes([97 + i % 26]) * 1400 for i in range(langid.SAMPLE_DOCS)]
    full = langid.dictionary(rows)
    assert len(full) == langid.DICTIONARY_BYTES and full.startswith(rows[0]) and langid.level(full) == langid.DICTIONARY_BYTES


def test_equal_sizes_take_the_first_language_and_are_rejected(spark):
    from pyspark.sql import functions as F

    from codeatlas.llm.common import fold

    learn = [r.id for r in spark.range(400).where(fold(F.col("id"), 4) != 2).collect()][:40]
    text = "these are the same words in either language and nothing tells them apart"
    docs = spark.createDataFrame([(i, text, "bb" if n % 2 else "aa") for n, i in enumerate(learn)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score, r.rejected) for r in langid.identify(docs).collect()} == {("aa", 0.5, True)}
    clash = docs.selectExpr("*", "'v' as held_out", "'v' as lang_pred", "1 as score", "2 as h")
    assert [tuple(r) for r in langid.identify(clash).collect()] == [tuple(r) for r in langid.identify(docs).collect()]
