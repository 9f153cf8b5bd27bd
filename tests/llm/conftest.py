import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and an extra column with a clashing name."""
    rows = [
        (1, "The cat sat on the mat and wrote to bob.x@mail.example.com about it", "en", "a", 1, "x"),
        (1, "The cat sat on the mat and wrote to bob.x@mail.example.com about it", "en", "a", 1, "x"),
        (2, None, "en", None, None, "x"),
        (3, "", None, "b", 0, None),
        (4, " \n\t ", "de", "b", 4, "y"),
        (5, "the cat " * 20000, "en", "c", 1, "z"),
        (None, "Der Hund und die Katze sind hier, 4111 1111 1111 1111 oder +1 (366) 555-9807.", "de", "c", 1, "z"),
        (6, "9" * 30000 + " 10.0.0.1 300.1.1.1", None, "a", 1, "z"),
        (7, "a@" * 5000 + "b.c ééé ＡＢ 漢字 😀 x@y.zz", "fr", "a", 1, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string")
