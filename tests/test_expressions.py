"""User expressions against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightframe.functions import expressions
from flightframe.operators import calc

VALUES = [0.0, -0.0, 1.0, -1.0, 2.5, -2.5, 3.0, -7.0, 1e300, -1e300, 0.3, float("inf"), float("-inf"), float("nan"), 1e17]

TEXTS = [
    "a + b * 2 - 3", "a / b", "(a - a) / b", "a // b", "a % b", "a ** b", "-a ** 2", "+a - -b", "2 ** -1 * a", "sqrt(a) + abs(b)", "sin(a) * cos(b)",
    "np.tan(a)", "np.arctan2(a, b)", "np.hypot(a, b)", "np.log(a)", "np.log10(a) + np.log2(b)", "np.exp(a)", "np.floor(a) + np.ceil(b)", "np.rint(a)", "np.trunc(b)",
    "np.minimum(a, b)", "np.maximum(a, b)", "np.clip(a, -2, 2)", "np.where(a > b, a, b)", "(a < b) * 3", "(a != b) + 0", "(a == b) * 1 + (a >= b)", "((a > 0) & (b > 0)) * a", "((a > 0) | ~(b > 0)) * 2", "np.isnan(a) * 1",
    "np.sign(a)", "np.cbrt(a)", "np.square(b)", "np.arcsin(a)", "np.degrees(a) + np.radians(b)", "np.pi * a + np.e", "np.mod(a, b)", "1 / (a * 0)", "np.nan * a", "np.inf - a",
]


def test_values_are_numpys(spark):
    a, b = (x.ravel() for x in np.meshgrid(VALUES, VALUES))
    df = spark.createDataFrame(list(zip(range(len(a)), a.tolist(), b.tolist(), strict=True)), "k long, a double, b double")
    got = df.select("k", *(expressions.as_column(t, {"a": F.col("a"), "b": F.col("b")}).alias(f"v{i}") for i, t in enumerate(TEXTS))).orderBy("k").toPandas()
    with np.errstate(all="ignore"):
        for i, text in enumerate(TEXTS):
            expected = eval(text, {"np": np, "sqrt": np.sqrt, "abs": np.abs, "sin": np.sin, "cos": np.cos, "a": a, "b": b})  # noqa: S307
            fine = np.ones(len(a), bool)
            if text in ("a // b", "a % b", "np.mod(a, b)"):  # quotients of infinities, or beyond the digits of a double, have their own rules
                fine = np.isfinite(a) & np.isfinite(b) & ~((np.abs(a) > 1e16) & (b != 0))
            if "arctan2" in text:  # Spark's takes -0.0 for 0.0
                fine = ~(np.signbit(a) & (a == 0)) & ~(np.signbit(b) & (b == 0))
            if "sin(a)" in text or "np.tan(" in text:
                fine = ~(np.abs(a) > 1e299) | (np.abs(a) == np.inf)
            np.testing.assert_allclose(got[f"v{i}"].to_numpy(float)[fine], np.asarray(expected, float)[fine], rtol=1e-12, atol=1e-300, err_msg=text)


@pytest.mark.parametrize("text", ["", "a +", "a b", "import os", "a; b", "(a"])
def test_what_is_no_expression_starts_no_job(text):
    with pytest.raises(ValueError):
        calc.expression(None, text, "x")  # samples are not looked at


@pytest.mark.parametrize("text", ["c", "a.b", "a[0]", "__import__('os')", "np.load(a)", "np.linalg", "open(a)", "a if a else b", "[a]", "'a'", "sqrt(a, b)", "sqrt(x=a)", "a and b", "a < b < 1", "exp(a)", "a & b", "lambda: a", "f'{a}'", "~a", "(a > 1) & b", "not a"])
def test_only_what_is_listed_is_known(spark, text):
    with pytest.raises(ValueError, match="not known"):
        expressions.as_column(text, {"a": F.lit(1.0), "b": F.lit(2.0)})


def test_longer_names_go_first():
    assert expressions.with_places("GPS.AltMSL-GPS.Alt*GPS[1].Alt", ["GPS.Alt", "GPS.AltMSL", "GPS[1].Alt", "ATT.Roll"]) == ("series_0-series_2*series_1", ["GPS.AltMSL", "GPS[1].Alt", "GPS.Alt"])
    assert expressions.with_places("1 + 2", ["GPS.Alt"]) == ("1 + 2", [])
    assert expressions.with_places("AB.x", ["B.x", "AB.x"]) == ("series_0", ["AB.x"])  # what a longer name has taken is not looked at again


def test_expression_over_series_of_logs(spark):
    rows = [(1, s, k, k / 10, v) for s, values in (("GPS.Alt", [1.0, 0.0, 3.0]), ("GPS.AltMSL", [5.0, 6.0, float("nan")]), ("ATT.Roll", [1.0, 2.0])) for k, v in enumerate(values)]
    rows += [(2, "GPS.Alt", 0, 0.0, 4.0), (3, "IMU.x", 0, 9.0, 1.0), (3, "ZZ.y", 0, 8.0, 1.0), (4, "ZZ.y", 0, 7.0, 1.0), (4, "YY.y", 3, 6.0, 1.0)]
    df = spark.createDataFrame(rows, "log_id long, series string, seq long, t double, v double")
    got = calc.expression(df, "GPS.AltMSL / GPS.Alt", "ratio").orderBy("seq").collect()
    assert [(r.log_id, r.series, r.seq, r.t) for r in got] == [(1, "CALC.ratio", 0, 0.0), (1, "CALC.ratio", 1, 0.1), (1, "CALC.ratio", 2, 0.2)]
    assert got[0].v == 5 and got[1].v == float("inf") and np.isnan(got[2].v)
    assert [(r.seq, r.v) for r in calc.expression(df, "GPS.AltMSL + ATT.Roll", "MIX.sum").orderBy("seq").collect()] == [(0, 6.0), (1, 8.0)]  # positions that both have
    assert sorted((r.log_id, r.series, r.t, r.v) for r in calc.expression(df, "2 * np.pi", "k.tau").where("log_id > 1").collect()) == [(2, "k.tau", 0.0, 2 * np.pi), (3, "k.tau", 9.0, 2 * np.pi), (4, "k.tau", 6.0, 2 * np.pi)]
    with pytest.raises(ValueError, match="not known"):
        calc.expression(df, "GPS.Alt + GPS.Nix", "x")
