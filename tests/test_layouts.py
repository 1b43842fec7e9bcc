import math
import random

import pytest
from pyspark.sql import functions as F

from sparkhist.functions import floatbits as fb
from sparkhist.plans.layouts import (
    CustomLayout,
    ExponentialLayout,
    Layout,
    LogLinearLayout,
    LogOptimalLayout,
    LogQuadraticLayout,
)

LOGS = [LogLinearLayout, LogQuadraticLayout, LogOptimalLayout]


@pytest.mark.parametrize(
    "cls, wide, narrow, last_width",
    [
        (LogLinearLayout, 44219012, 4106, 0.057622250121310614),
        (LogQuadraticLayout, 33391320, 3106, 0.031135683241927836),
        (LogOptimalLayout, 30933622, 2877, 0.08473892129759442),
    ],
)
def test_log_layout_indices(cls, wide, narrow, last_width):
    a = cls(1e-7, 1e-6, -1e12, 1e12)
    assert (a.underflow, a.overflow) == (-wide - 1, wide)
    b = cls(1e-8, 1e-2, -1e6, 1e6)
    assert (b.underflow, b.overflow) == (-narrow - 1, narrow)
    assert 10 - b.lower_bound(b.index(10.0)) == last_width
    assert b.upper_bound(b.index(0.0)) == 9.999999999999999e-9


@pytest.mark.parametrize("x, g", [(0.25, 1022), (0.5, 1023), (1, 1024), (2, 1025), (16, 1028)])
def test_linear_growth(x, g):
    assert LogLinearLayout._growth(float(x)) == g


@pytest.mark.parametrize("x, g", [(0.25, 3063), (0.5, 3066), (1, 3069), (16, 3081)])
def test_quadratic_growth(x, g):
    assert LogQuadraticLayout._growth(float(x)) == g


def test_exponential_bins():
    positive = [2098, 4195, 8387, 16767, 33518, 67005, 133946, 267764, 535273, 1070035, 2139047]
    assert [ExponentialLayout(s).overflow - 1 for s in range(11)] == positive
    e = ExponentialLayout(0)
    values = [0.0, -0.0, fb.MIN_VALUE, fb.MIN_NORMAL, 0.5, 1.0, fb.MAX_VALUE]
    assert [e.index(v) for v in values] == [0, 0, 1, 53, 1074, 1075, 2098]
    assert [e.index(-v) for v in values[2:]] == [-1, -53, -1074, -1075, -2098]
    assert ExponentialLayout(3) is ExponentialLayout(3)


def test_exponential_boundaries_are_exact():
    for scale in (1, 3, 5):
        n = 1 << scale
        for i, b in enumerate(ExponentialLayout(scale).bounds, start=1):
            m = int(b * 2**52)
            assert m**n >= 1 << (52 * n + i) > (m - 1) ** n


def test_custom():
    c = CustomLayout(-4, -2, 0, 2, 4)
    assert [c.index(x) for x in (-5, -4, -3, -0.0, 0.0, 4, 9)] == [0, 1, 1, 2, 3, 5, 5]
    assert math.copysign(1, c.upper_bound(2)) == -1 and c.upper_bound(2) == 0
    assert CustomLayout(-0.0, 0.0).index(-0.0) == 1
    for bad in ((), (1, 1), (2, 1), (0.0, -0.0), (float("nan"),)):
        with pytest.raises(ValueError):
            CustomLayout(*bad)


@pytest.mark.parametrize("cls", LOGS)
@pytest.mark.parametrize("absolute", [1, 10, 100])
@pytest.mark.parametrize("relative", [0, 1e-3, 1e-1, 10])
def test_widths_and_bounds(cls, absolute, relative):
    layout = cls(absolute, relative, -1e6, 1e6)
    rng = random.Random(0)
    for _ in range(60):
        v = rng.uniform(-1e6, 1e6)
        i = layout.index(v)
        lo, hi = layout.lower_bound(i), layout.upper_bound(i)
        assert lo <= v <= hi
        assert layout.index(lo) == i == layout.index(hi)
        assert layout.index(fb.ordered_to_double(fb.double_to_ordered(lo) - 1)) == i - 1
        wide = (hi - lo) * (1 - 1e-6)
        assert wide <= absolute or wide <= relative * max(abs(lo), abs(hi))
    assert layout.lower_bound(layout.underflow) == -math.inf and layout.upper_bound(layout.overflow) == math.inf
    lo, hi = layout.normal_range
    assert layout.index(lo) == layout.underflow + 1 and layout.index(hi) == layout.overflow - 1


@pytest.mark.parametrize("cls", LOGS)
def test_invalid_arguments(cls):
    nan, inf = float("nan"), float("inf")
    for args in [(0, 1, 0, 1), (-1, 1, 0, 1), (1, -1, 0, 1), (1, 1, 1, 0), (1, 1, 0, inf), (1, 1, nan, 1), (1, nan, 0, 1),
                 (nan, 1, 0, 1), (1e-300, 0, 0, 1)]:
        with pytest.raises(ValueError):
            cls(*args)
    with pytest.raises(ValueError):
        cls(1, 1, 0, 1).index(nan)
    with pytest.raises(ValueError):
        ExponentialLayout(11)


def test_equality_and_text():
    assert LogLinearLayout(1, 0.1, 0, 10) == LogLinearLayout(1, 0.1, 0, 10) != LogLinearLayout(1, 0.1, 0, 1000)
    assert LogLinearLayout(1, 0.1, 0, 10) != LogQuadraticLayout(1, 0.1, 0, 10)
    assert CustomLayout(1, 2) == CustomLayout([1, 2]) and hash(CustomLayout(1, 2)) == hash(CustomLayout(1, 2))
    assert repr(LogLinearLayout(1, 0, -10, 10)).startswith("LogLinearLayout [absoluteBinWidthLimit=1.0, ")


class Rounded(Layout):
    """A user's layout without a column of its own."""

    underflow, overflow = -100, 100

    def raw_index(self, value):
        return int(value + 0.5) if value >= 0 else int(value - 0.5)


def test_columns_agree_with_functions(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, fb.MIN_VALUE, -fb.MIN_VALUE, 1e-310, fb.MIN_NORMAL, fb.MAX_VALUE, -fb.MAX_VALUE, math.inf, -math.inf]
    values += [rng.uniform(-1e7, 1e7) for _ in range(300)]
    values += [rng.choice([1, -1]) * 10 ** rng.uniform(-320, 308) for _ in range(600)]
    layouts = [
        LogLinearLayout(1e-8, 1e-2, -1e6, 1e6), LogQuadraticLayout(1e-8, 1e-2, -1e6, 1e6), LogLinearLayout(1, 0, -1000, 1000),
        LogQuadraticLayout(1, 2, 0, fb.MAX_VALUE), ExponentialLayout(0), ExponentialLayout(4), ExponentialLayout(10),
        CustomLayout(-4, -2, -0.0, 0.0, 2, 4), CustomLayout(*range(-50, 50)), Rounded(),
    ]
    for layout in layouts:
        for _ in range(25):
            i = rng.randint(max(layout.underflow + 1, -(10**6)), min(layout.overflow, 10**6))
            b = layout.lower_bound(i)
            values += [b, fb.ordered_to_double(fb.double_to_ordered(b) - 1)]
    df = spark.createDataFrame([(x,) for x in values] + [(None,)], "x double")
    cols = [layout.column("x").alias(f"i{k}") for k, layout in enumerate(layouts)]
    for row in df.select("x", *cols).collect():
        for k, layout in enumerate(layouts):
            assert row[k + 1] == (None if row.x is None else layout.index(row.x)), (layout, row.x)


def test_optimal_column_is_near(spark):
    layout = LogOptimalLayout(1e-8, 1e-2, -1e6, 1e6)
    df = spark.range(2000).select(F.exp(F.col("id") / 80.0 - 10).alias("x"))
    for row in df.select("x", layout.column("x").alias("i")).collect():
        assert abs(row.i - layout.index(row.x)) <= 1


def test_nan_fails(spark):
    df = spark.createDataFrame([(float("nan"),)], "x double")
    with pytest.raises(Exception, match="NaN"):
        df.select(CustomLayout(1).column("x")).collect()


def test_searches():
    assert fb.find_first(lambda n: n >= 7, 0, 100) == 7
    for guess in (0, 6, 7, 8, 100, -5, 500):
        assert fb.find_first(lambda n: n >= 7, 0, 100, guess) == 7
    for lo, hi in ((5, 4), (0, 3)):
        with pytest.raises(ValueError):
            fb.find_first(lambda n: n >= 7, lo, hi)
    assert fb.midpoint(-3, 0) == -2 and fb.midpoint(2**63 - 1, 2**63 - 3) == 2**63 - 2
    assert fb.clip(5, 1, 3) == 3 and fb.clip(-5, 1, 3) == 1 and fb.clip(2, 1, 3) == 2
    with pytest.raises(ValueError):
        fb.clip(5, 3, 1)
    assert fb.double_to_ordered(-0.0) < fb.double_to_ordered(0.0)
    assert fb.truncated(float("nan")) == 0 and fb.truncated(1e99) == 2**31 - 1 and fb.truncated(-2.7) == -2
