import pytest
from pyspark.sql import functions as F

from codeatlas.functions import exprs


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("path", "want"), [("a/./b/../c", "a/c"), ("/a/../../b", "/b"), ("../x", "../x"), ("a\\b\\..\\c", "a/c"), ("", ""), ("a/..", ""), ("../../x/../y", "../../y")])
def test_normalize(spark, path, want):
    assert value(spark, exprs.normalize_path(F.lit(path))) == want


@pytest.mark.parametrize(("glob", "path", "want"), [("**/*.{c,h}", "a/b.c", True), ("**/*.{c,h}", "b.h", True), ("*.c", "a/b.c", False), ("**/build/**", "x/build/y.c", True), ("a?c", "a/c", True), ("{a,{b,c}}/x", "c/x", True), ("a.b", "axb", False)])
def test_glob(spark, glob, path, want):
    assert value(spark, exprs.glob_match(F.lit(path), [glob])) is want


def test_names(spark):
    assert value(spark, exprs.dir_name(F.lit("/a"))) == "/" and value(spark, exprs.dir_name(F.lit("a"))) == ""
    assert value(spark, exprs.module_of(F.lit("a"))) == "." and value(spark, exprs.extension_of(F.lit("x/Y.CPP"))) == ".cpp"
    assert value(spark, exprs.relative_to(F.lit("/Root/a/B"), F.lit("/root"))) == "a/B"
    assert value(spark, exprs.simple_name(F.lit("a::b::c"))) == "c"
