"""Expressions by Spark and by row, safety, bins at their edges."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corbel.errors import ExpressionSyntaxError, MissingVariableError, UnsafeExpressionError
from corbel.functions.expressions import bin_index, bin_labels, clip, compile_expression, derive, evaluate, lookup, parse, variables, without_sentinels

EXPRESSIONS = ["a/(a+b)", "(a-b)*(a+b)", "a + b - a * b", "a/b + 1", "a + 2 * b", "-a + b", "a - -b", "a--b", "a", "1/(a/b)", "3", "+a"]


def test_spark_and_rows_agree(spark):
    values = [None, float("nan"), 0.0, 1.0, -2.5, 1e308, float("inf")]
    rows = [(a, b) for a in values for b in values]
    df = spark.createDataFrame(rows, "a double, b double")
    for fill in (None, 1.0):
        got = df.select(*[compile_expression(e, df.columns, fill).alias(f"c{i}") for i, e in enumerate(EXPRESSIONS)]).collect()
        for (a, b), r in zip(rows, got):
            for i, e in enumerate(EXPRESSIONS):
                want = evaluate(e, {"a": a, "b": b}, fill)
                assert r[i] == want or (r[i] is not None and want is not None and math.isclose(r[i], want, rel_tol=1e-12)), (e, a, b, fill, r[i], want)


@pytest.mark.parametrize("text", ["a.b", "f(a)", "a[0]", "a ** b", "a % b", "'x'", "True", "a if b else a", "lambda: a", "a < b", "[a]", "a; b", "__import__('os')"])
def test_only_arithmetic(text):
    with pytest.raises((UnsafeExpressionError, ExpressionSyntaxError)):
        parse(text)


@pytest.mark.parametrize("text", ["", "  ", "a +", None])
def test_syntax(text):
    with pytest.raises(ExpressionSyntaxError):
        parse(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_parse_never_fails_otherwise(text):
    try:
        parse(text)
    except (UnsafeExpressionError, ExpressionSyntaxError):
        pass


def test_names(spark):
    assert variables("b + a * b - c") == ["b", "a", "c"]
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    with pytest.raises(MissingVariableError):
        derive(df, {"c": "a + z"})
    for bad in ([("a", "b")], [("c", "a"), ("c", "b")]):
        with pytest.raises(ValueError, match="collide"):
            derive(df, bad)
    with pytest.raises(MissingVariableError):
        derive(df, {"c": "a", "d": "c"})  # targets do not see each other


def test_bins_at_edges(spark):
    edges = [0.0, 1.0, 2.0]
    xs = [None, float("nan"), -1e-9, 0.0, 1e-9, 1 - 1e-9, 1.0, 1 + 1e-9, 2.0, 2 + 1e-9]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    want = {"right": [None, None, None, 0, 0, 0, 0, 1, 1, None], "left": [None, None, None, 0, 0, 0, 1, 1, 1, None], "open": [None, None, 0, 1, 1, 1, 2, 2, 3, 3]}
    for closed, expected in want.items():
        for e in (edges, F.array(*[F.lit(x) for x in edges])):
            got = [r.b for r in df.select("i", bin_index(F.col("x"), e, closed).alias("b")).orderBy("i").collect()]
            assert got == expected, closed
    inf = [r.b for r in df.select("i", bin_index(F.col("x"), [None, 1.0, None], "right").alias("b")).orderBy("i").collect()]
    assert inf == [None, None, 0, 0, 0, 0, 0, 1, 1, 1]
    assert bin_labels([None, 1.0, 2.5, None]) == ["(-inf, 1.0000]", "(1.0000, 2.5000]", "(2.5000, inf)"] and bin_labels([None, None]) == ["(-inf, inf)"]


def test_helpers(spark):
    df = spark.createDataFrame([(-999, -999.0, "x"), (1, float("nan"), None), (None, 5.0, "y")], "i int, d double, s string")
    assert [tuple(r) for r in without_sentinels(df).collect()] == [(None, None, "x"), (1, None, None), (None, 5.0, "y")]
    row = df.select(clip(F.lit(9.0), 0, 5), clip(F.lit(None).cast("double"), 0, 5), lookup(F.col("s"), {"x": 1.0}), lookup(F.col("s"), {})).first()
    assert tuple(row) == (5.0, None, 1.0, None)
