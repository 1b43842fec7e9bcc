"""Bounds of bins as expressions against the search over ordered doubles, bit by bit."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from sparkhist.operators import bins, histogram, quantiles
from sparkhist.plans import queries
from sparkhist.plans.layouts import (
    CustomLayout,
    ExponentialLayout,
    Layout,
    LogLinearLayout,
    LogOptimalLayout,
    LogQuadraticLayout,
)
from sparkhist.sources.tables import table

LAYOUTS = [
    queries.QUADRATIC, queries.LINEAR, queries.OPTIMAL, queries.SIGNED, LogLinearLayout(1e-300, 0.5, -1e308, 1e308),
    LogQuadraticLayout(3e-308, 0.3, 0, 1.7976931348623157e308), LogOptimalLayout(1, 0, -50, 50), LogLinearLayout(1, 1e-5, -1e7, 1e7),
    ExponentialLayout(0), ExponentialLayout(3), ExponentialLayout(10), CustomLayout(-1.5, -0.0, 0.0, 5e-324, 7),
]


@pytest.mark.parametrize("layout", LAYOUTS, ids=str)
def test_bounds(spark, layout):
    lo, hi = layout.underflow, layout.overflow
    rng = random.Random(1)
    near = {*range(-3, 4), *range(lo, lo + 4), *range(hi - 3, hi + 1)}
    if isinstance(layout, ExponentialLayout):
        near |= {s * (layout.first_bits + k) for s in (1, -1) for k in range(-3, 4)}
    wanted = sorted({i for i in near if lo <= i <= hi} | {rng.randint(lo, hi) for _ in range(120)})
    lower, upper = bins.bounds_columns(layout, "i")
    df = spark.createDataFrame([(i,) for i in wanted], "i int").coalesce(4)
    bits = lambda x: struct.pack(">d", x)
    # Logarithms of the JVM and of Python may differ in the last bit, and so do bounds found by either.
    close = lambda x, y: bits(x) == bits(y) or isinstance(layout, LogOptimalLayout) and abs(x - y) <= 1e-12 * abs(y)
    for r in df.select("i", lower.alias("lo"), upper.alias("hi")).collect():
        assert close(r.lo, layout.lower_bound(r.i)), (r, layout.lower_bound(r.i))
        assert close(r.hi, layout.upper_bound(r.i)), (r, layout.upper_bound(r.i))


def test_flagship_runs_no_python_and_filters_before_bounds(spark, sf):
    plan = queries.flagship(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") <= 2


def test_many_quantiles_equal_single_ones(spark, sf):
    by = [queries.FLAG]
    v = bins.bins_view(histogram.record(table(spark, sf, "lineitem"), queries.PRICE, queries.QUADRATIC, by), queries.QUADRATIC, by)
    ps = [i / 20 for i in range(21)]
    for alpha, beta in ((0.4, 0.4), (1.0, 1.0), (0.0, 0.0)):
        many = {(r[0], r.p): r.value for r in quantiles.quantiles(v, ps, by, alpha, beta).collect()}
        assert len(many) == 3 * len(ps)
        plain = {
            (r[0], r.p): r.value
            for r in quantiles.quantiles(
                v, ps, by, position=lambda p, n: F.least(F.greatest(alpha - 1 + p * (n - beta - alpha + 1), F.lit(0.0)), n - 1.0)
            ).collect()
        }
        assert many.keys() == plain.keys() and all(abs(many[k] - plain[k]) <= 1e-9 * abs(many[k]) for k in many)


def test_quantiles_beyond_the_ends_and_ranks_too_high(spark, sf):
    by = [queries.FLAG]
    v = bins.bins_view(histogram.record(table(spark, sf, "lineitem"), queries.PRICE, queries.CUSTOM, by), queries.CUSTOM, by)
    found = {(r[0], r.p): r.value for r in quantiles.quantiles(v, [-1.0, 0.0, 1.0, 2.5], by).collect()}
    for flag in "ANR":
        assert found[flag, -1.0] == found[flag, 0.0] and found[flag, 2.5] == found[flag, 1.0]
    with pytest.raises(ValueError):
        quantiles.quantiles(v, [float("nan")], by)
    n = max(r.total_count for r in v.collect())
    assert bins.bin_by_rank(v.where(F.col("total_count") == n), [n - 1], by).count() == 1
    with pytest.raises(Exception, match="fewer values"):
        bins.bin_by_rank(v, [0, n], by).collect()


class Squares(Layout):
    """A layout of one's own, without SQL."""

    underflow, overflow = -1, 100

    def raw_index(self, value: float) -> int:
        return int(max(0.0, value) ** 0.5)

    def _key(self) -> tuple:
        return ()


def test_layout_without_sql(spark):
    h = histogram.record(spark.range(200).withColumn("x", F.col("id").cast("double")), "x", Squares())
    got = {r.bin_index: (r.lower_bound, r.upper_bound, r.bin_count) for r in bins.bins_view(h, Squares()).collect()}
    assert got[3][0] == 9.0 and 15.9 < got[3][1] < 16 and got[3][2] == 7
