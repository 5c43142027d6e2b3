import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def value(spark, column, data, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(d,) for d in data], schema).select(column).collect()]


def test_search_tokens(spark):
    data = ["camelCase Two-words", "HTTPServer v2", "é a", None, "...", "aBcD"]
    want = [["camel", "case", "two", "words"], ["httpserver", "v2"], ["a"], [], [], ["a", "bc", "d"]]
    assert value(spark, T.search_tokens(F.col("x")), data) == want
    assert [T.query_terms(d or "") for d in data] == want


def test_folding_rounding_and_titles(spark):
    assert value(spark, T.casefold(F.col("x")), ["Straße", "STRASSE", None]) == ["strasse", "strasse", None]
    assert value(spark, T.round_half_even(F.col("x"), 2), [2.675, 0.125, -1.5], "x double") == [2.67, 0.12, -1.5]
    assert value(spark, T.title_case("x"), ["o'neil 3d"]) == ["O'Neil 3D"]


def test_lines_and_paths(spark):
    assert value(spark, T.strip_marker(F.col("x")), ["- a", " * b ", "12. c", "-d", "+ "]) == ["a", "b", "c", "-d", "+"]
    assert value(spark, T.first_line(F.col("x")), ["\r\n  \n one \ntwo", "", None]) == ["one", None, None]
    assert value(spark, T.path_stem(F.col("x")), ["a/b.c.md", ".hidden", "x"]) == ["b.c", ".hidden", "x"]
    rows = spark.createDataFrame([("sub-x.md",), ("sub/c.md",), ("sub.md",)], "p string").orderBy(T.path_order(F.col("p"))).collect()
    assert [r.p for r in rows] == ["sub/c.md", "sub-x.md", "sub.md"]
    assert T.normal_path("./a//b/.") == "a/b" and T.normal_path("a/../b") is None and T.normal_path("/r/a", "/r") == "a"


@pytest.mark.parametrize(("glob", "yes", "no"), [
    ("src/*.py", "src/a.py", "src/b/a.py"), ("**/*.md", "a.md", "a.txt"), ("**/*.md", "x/y/a.md", "x/a.mdx"), ("a/**", "a/b/c", "ab"),
    ("f?[0-9].x", "fa1.x", "fab.x"), ("f[!a].x", "fb.x", "fa.x"), ("a.b", "a.b", "axb"),
])
def test_globs(glob, yes, no):
    import re

    assert re.match(T.glob_regex(glob), yes) and not re.match(T.glob_regex(glob), no)


def test_ages_and_excerpts(spark):
    assert value(spark, T.age_days(F.lit(86400 * 10), F.col("x")), [0, 86400 * 10 + 1, 86400 * 9], "x long") == [10, -1, 1]
    assert value(spark, T.iso_epoch(F.col("x")), ["1970-01-01T01:00:00+01:00", "nothing"]) == [0, None]
    assert value(spark, T.excerpt(F.col("x"), 7, 2), ["abcdef", "é"]) == ["abc", "é"]
    assert math.isclose(1, 1)
