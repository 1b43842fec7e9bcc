import math
import random

import pytest
from pyspark.sql import functions as F

from sparkhist.functions.estimators import array_quantile, estimate, interpolate, quantile_of
from sparkhist.operators import bins, histogram, quantiles
from sparkhist.plans.layouts import CustomLayout, Layout, LogLinearLayout, LogQuadraticLayout


class Rounded(Layout):
    """Integers as bins, within a range."""

    def __init__(self, underflow, overflow):
        self.underflow, self.overflow = underflow, overflow

    def raw_index(self, value):
        return int(value + 0.5) if value >= 0 else int(value - 0.5)

    def raw_sql(self, x):
        return f"(double(floor(abs({x}) + 0.5D)) * signum({x}))"

    def _key(self):
        return self.underflow, self.overflow


def recorded(spark, values, layout, **how):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    return histogram.record(df, "x", layout, **how)


def view(spark, values, layout):
    return bins.bins_view(recorded(spark, values, layout), layout)


def test_signed_zeros(spark):
    for values in ([0.0, -0.0], [-0.0, 0.0]):
        s = histogram.summary(recorded(spark, values, CustomLayout(-1, 1)), CustomLayout(-1, 1)).first()
        assert math.copysign(1, s.min_value) == -1 and math.copysign(1, s.max_value) == 1


def test_weights(spark):
    df = spark.createDataFrame([(1.0, 3), (1.5, 0), (float("nan"), 0), (2.0, 1), (None, 5), (3.0, None)], "x double, w long")
    got = {r.bin_index: r.bin_count for r in histogram.record(df, "x", CustomLayout(0, 2), weight="w").collect()}
    assert got == {1: 3, 2: 1}
    with pytest.raises(Exception, match="negative"):
        histogram.record(df.withColumn("w", F.lit(-1)), "x", CustomLayout(0), weight="w").collect()
    big = spark.createDataFrame([(1.0, 2**63 - 1), (1.0, 1)], "x double, w long")
    with pytest.raises(Exception, match="OVERFLOW"):
        histogram.record(big, "x", CustomLayout(0), weight="w").collect()


def test_empty(spark):
    s = histogram.summary(recorded(spark, [], CustomLayout(0)), CustomLayout(0)).first()
    assert (s.total_count, s.min_value, s.max_value, s.is_empty) == (0, math.inf, -math.inf, True)
    assert bins.first_last(recorded(spark, [], CustomLayout(0))).count() == 0


def test_infinities(spark):
    got = {r.bin_index: r.bin_count for r in recorded(spark, [math.inf, -math.inf, 5], Rounded(-2, 7)).collect()}
    assert got == {7: 1, -2: 1, 5: 1}


def values_at(v, ranks, kind="uniform"):
    return [r.value for r in sorted(quantiles.value_at_rank(v, ranks, estimator=kind).collect(), key=lambda r: r.rank)]


def test_sentinel_bins(spark):
    v = view(spark, [1000, 1000, -1000, -1000], Rounded(-1, 0))
    assert values_at(v, [0, 1, 2, 3]) == pytest.approx([-1000, -1001 / 3, 333, 1000], abs=2)
    q = {r.p: r.value for r in quantiles.quantiles(view(spark, [1000, -1000], Rounded(-1, 0)), [0, 0.5, 1]).collect()}
    assert q == {0: -1000, 0.5: 0, 1: 1000}


def test_values_by_rank(spark):
    values = [-math.inf, -2, -2, -2, -1, -1, -1, -1, 0, 1, 1, 1, 2, 2]
    v = view(spark, values, Rounded(-2, 2))
    want = {4: -1.3749999999999998, 5: -1.125, 6: -0.8749999999999998, 7: -0.625, 8: 0, 9: 0.6666666666666665,
            10: 0.9999999999999998, 12: 1.6666666666666667, 13: 2}
    got = dict(zip(sorted(want), values_at(v, sorted(want))))
    assert got == pytest.approx(want, abs=1e-12)


def test_bins_by_rank(spark):
    v = view(spark, [-101] * 3 + [-53] * 2 + [3] * 4 + [106], Rounded(-100, 100))
    got = {r.rank: (r.bin_index, r.less_count, r.bin_count, r.greater_count) for r in bins.bin_by_rank(v, range(10)).collect()}
    for rank in range(10):
        i, less, n, more = next(x for x in [(-100, 0, 3, 7), (-53, 3, 2, 5), (3, 5, 4, 1), (100, 9, 1, 0)] if rank < x[1] + x[2])
        assert got[rank] == (i, less, n, more)
    with pytest.raises(ValueError):
        bins.bin_by_rank(v, [-1])
    with pytest.raises(Exception, match="fewer values"):
        bins.bin_by_rank(v, [10]).collect()


def test_consistency(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 30) for _ in range(500)]
    layout = LogLinearLayout(1, 0.1, -50, 50)
    rows = view(spark, values, layout).orderBy("bin_index").collect()
    less = 0
    for r in rows:
        assert r.less_count == less and r.less_count + r.bin_count + r.greater_count == 500
        inside = [x for x in values if layout.index(x) == r.bin_index]
        assert len(inside) == r.bin_count
        assert r.lower_bound <= min(inside) <= max(inside) <= r.upper_bound
        assert r.is_first == (less == 0) and r.is_last == (r.greater_count == 0)
        less += r.bin_count
    assert less == 500


def test_merge_is_union(spark):
    rng = random.Random(2)
    a, b = ([rng.uniform(-10, 10) for _ in range(200)] for _ in range(2))
    layout = LogQuadraticLayout(0.1, 0.05, -8, 8)
    merged = histogram.merge(recorded(spark, a, layout), recorded(spark, b, layout))
    assert histogram.equal(merged, recorded(spark, a + b, layout)).first().equal_bins
    assert not histogram.equal(merged, recorded(spark, a, layout)).first().equal_bins


@pytest.mark.parametrize("kind", ["uniform", "lower", "upper", "midpoint"])
def test_rebin_records_every_estimate(spark, kind):
    rng = random.Random(4)
    values = [rng.gauss(0, 10) for _ in range(120)]
    v = view(spark, values, CustomLayout(-20, -10, 0, 10, 20))
    target = CustomLayout(-15, -5, 5, 15)
    again = recorded(spark, values_at(v, range(120), kind), target)
    assert histogram.equal(histogram.rebin(v, target, estimator=kind), again).first().equal_bins


def test_ascending_sequence(spark):
    layout = LogLinearLayout(1, 0.1, -50, 50)
    f = lambda i: i * 0.37 - 60
    got = histogram.ascending_sequence(spark, f, 400, layout)
    assert histogram.equal(got, recorded(spark, [f(i) for i in range(400)], layout)).first().equal_bins
    assert histogram.ascending_sequence(spark, f, 0, layout).count() == 0
    huge = histogram.ascending_sequence(spark, lambda i: float(i >> 60), 2**62, CustomLayout(1, 2))
    assert {r.bin_index: r.bin_count for r in huge.collect()} == {0: 2**60, 1: 2**60, 2: 2**61}
    with pytest.raises(ValueError):
        histogram.ascending_sequence(spark, f, -1, layout)


def test_dense_and_access(spark):
    layout = Rounded(-3, 3)
    h = recorded(spark, [-9, 0, 0, 2], layout)
    assert [r.bin_count for r in histogram.dense(h, layout).orderBy("bin_index").collect()] == [0, 0, 2, 0, 1]
    for index, n in ((0, 2), (1, 0), (-99, 1), (99, 0)):
        assert bins.count_at(h, index, layout).first().bin_count == n
    f = bins.first_last(h).first()
    assert (f.first_bin, f.first_count, f.last_bin, f.last_count) == (-3, 1, 2, 1)
    assert [(r.previous_bin, r.next_bin) for r in bins.ascending(bins.neighbours(h)).collect()] == [(None, 0), (-3, 2), (0, None)]
    assert [r.bin_index for r in bins.descending(h).collect()] == [2, 0, -3]
    assert bins.count_below(h, 2.0, layout).first().below_count == 3


def test_pack(spark):
    h = recorded(spark, [1, 1, 5], CustomLayout(0, 3))
    p = histogram.pack(h).first().hist
    assert (p.total_count, p.min, p.max, [tuple(b) for b in p.bins]) == (3, 1, 5, [(1, 2), (2, 1)])
    assert {r.bin_index: r.bin_count for r in histogram.unpack(histogram.pack(h)).collect()} == {1: 2, 2: 1}


def test_footprint_and_mode(spark):
    layout = LogQuadraticLayout(1e-8, 1e-2, -1e6, 1e6)
    f = histogram.footprint(recorded(spark, [], layout), layout).first()
    assert (f.static_bytes, f.preprocessed_bytes, f.dynamic_bytes) == (49772, 72, 82)
    for n, m in ((0, 0), (1, 0), (2, 1), (4, 2), (16, 3), (256, 4)):
        assert histogram.mode(recorded(spark, [1.0] * n, layout), layout).first().counter_mode == m


def test_finalised(spark):
    f = histogram.Finalised(view(spark, [1], CustomLayout(0)), CustomLayout(0))
    assert not f.is_mutable
    with pytest.raises(TypeError):
        f.add(1.0)


def test_rendering(spark):
    v = view(spark, [1, 1, 5], CustomLayout(0, 3))
    lines = [r.line for r in bins.print_stars(v).orderBy("bin_index").collect()]
    assert [x.split(": ")[1] for x in lines] == ["**", "***"]
    text = histogram.render(recorded(spark, [1, 1, 5], CustomLayout(0, 3)), CustomLayout(0, 3)).first().text
    assert "totalCount=3, min=1.0, max=5.0, counts={1: 2, 2: 1}]" in text
    assert bins.describe(v).orderBy("bin_index").first().text.startswith("Bin [binIndex=1, lowerBound=1.0")


def test_uniform_estimates():
    assert [estimate("uniform", 10 + k, 10, 5, 3, 8, False, False) for k in range(5)] == [3.5, 4.5, 5.5, 6.5, 7.5]
    first = [estimate("uniform", k, 0, 5, 3, 8, True, False) for k in range(5)]
    assert first == pytest.approx([3 + 2 * k / 9 * 5 for k in range(5)], abs=1e-12)
    last = [estimate("uniform", 10 + k, 10, 5, 3, 8, False, True) for k in range(5)]
    assert last == pytest.approx([3 + (2 * k + 1) / 9 * 5 for k in range(5)], abs=1e-12)
    assert [estimate("uniform", k, 0, 5, 3, 8, True, True) for k in (1, 2, 3)] == [4.25, 5.5, 6.75]


def test_quantiles_of_arrays(spark):
    a = sorted([6, 47, 49, 15, 42, 41, 7, 39, 43, 40, 36])
    assert [quantile_of(p, lambda i: float(a[i]), 11) for p in (0.25, 0.5, 0.75)] == [19.200000000000003, 40, 42.8]
    for ab in (0.4, 0.5):
        assert [quantile_of(p, lambda i: [3.0, 5.0][i], 2, ab, ab) for p in (0, 0.25, 0.5, 0.75, 1)] == pytest.approx([3, 3, 4, 5, 5])
    for alpha in (0, 0.3, 1):
        for beta in (0, 0.7, 1):
            assert quantile_of(0.5, float, 20, alpha, beta) == pytest.approx(9.5 + (alpha - beta) / 2)
    assert math.isnan(quantile_of(0.5, float, 0)) and quantile_of(0.1, float, 1) == 0
    with pytest.raises(ValueError):
        quantile_of(0.5, float, 3, 1.5)
    df = spark.createDataFrame([([float(x) for x in a],), ([],), ([2.0],)], "a array<double>")
    got = [r[0] for r in df.select(array_quantile(F.col("a"), 0.25)).collect()]
    assert got[0] == 19.200000000000003 and math.isnan(got[1]) and got[2] == 2


def test_interpolation():
    assert interpolate(0, 1, 5, 2, 7) == 5 and interpolate(9, 1, 5, 2, 7) == 7 and interpolate(1.5, 1, 5, 2, 7) == 6
    assert interpolate(1.5, 2, 7, 1, 5) == 6 and interpolate(3, 3, 1, 3, 2) == 1.5
    assert interpolate(0.5, 0, -math.inf, 1, math.inf) != interpolate(0.5, 0, 0, 1, 1)


def test_user_estimators(spark):
    v = view(spark, [1, 2, 5, 9], CustomLayout(0, 3))
    mine = lambda rank: F.col("lower_bound") * 0 + 4
    assert values_at(v, [1, 2], mine) == [4, 4]
    nearest = lambda p, n: F.floor(p * (n - 1))
    got = quantiles.quantiles(v, [0.0, 1.0], position=nearest).orderBy("p").collect()
    assert [r.value for r in got] == [1, 9]
    beyond = quantiles.quantiles(v, [-0.5, 1.5]).orderBy("p").collect()
    assert [(r.p, r.value) for r in beyond] == [(-0.5, 1), (1.5, 9)]
    with pytest.raises(ValueError):
        quantiles.quantiles(v, [0.5], alpha=1.5)
