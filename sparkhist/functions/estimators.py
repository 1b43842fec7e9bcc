"""Interpolation, value estimators and quantile positions, for numbers and columns."""

from __future__ import annotations

import math
from collections.abc import Callable
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkhist.functions.floatbits import double_to_ordered


class Estimate(str, Enum):
    """Where in its bin a value is taken to lie."""

    UNIFORM = "uniform"
    LOWER_BOUND = "lower"
    UPPER_BOUND = "upper"
    MID_POINT = "midpoint"


def interpolate(x: float, x1: float, y1: float, x2: float, y2: float) -> float:
    """Linear between (x1, y1) and (x2, y2), constant outside, symmetric and monotone."""
    if y1 == y2 and double_to_ordered(y1) == double_to_ordered(y2):
        return y1
    if x <= x1 < x2 or x >= x1 > x2:
        return y1
    if x <= x2 < x1 or x >= x2 > x1:
        return y2
    if x1 != x2 and math.isfinite(y1) and math.isfinite(y2):
        from_1 = y1 + (y2 - y1) * ((x - x1) / (x2 - x1))
        from_2 = y2 + (y2 - y1) * ((x - x2) / (x2 - x1))
        y = from_1 * 0.5 + from_2 * 0.5
    else:
        y = y1 * 0.5 + y2 * 0.5
    if y != y:
        return y
    return min(max(y, min(y1, y2)), max(y1, y2))


def interpolate_col(x: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """`interpolate` as an expression, operation by operation the same."""
    inf = F.lit(float("inf"))
    span = F.when(x1 != x2, x2 - x1)  # null instead of dividing by zero
    from_1 = y1 + (y2 - y1) * ((x - x1) / span)
    from_2 = y2 + (y2 - y1) * ((x - x2) / span)
    finite = (F.abs(y1) < inf) & (F.abs(y2) < inf)
    y = F.when((x1 != x2) & finite, from_1 * 0.5 + from_2 * 0.5).otherwise(y1 * 0.5 + y2 * 0.5)
    clamped = F.when(F.isnan(y), y).otherwise(F.least(F.greatest(y, F.least(y1, y2)), F.greatest(y1, y2)))
    return (
        F.when((y1 == y2) & (y1.cast("string") == y2.cast("string")), y1)
        .when(((x <= x1) & (x1 < x2)) | ((x >= x1) & (x1 > x2)), y1)
        .when(((x <= x2) & (x2 < x1)) | ((x >= x2) & (x2 > x1)), y2)
        .otherwise(clamped)
    )


def interpolate_sql(x: str, x1: str, y1: str, x2: str, y2: str) -> str:
    """`interpolate_col` as text, of doubles named or spelled in SQL; one call to build instead of a hundred.

    What is used often is bound once, which keeps plans and generated code small.
    """
    span = "nullif(_i.x2 - _i.x1, 0D)"
    from_1 = f"(_i.y1 + (_i.y2 - _i.y1) * ((_i.x - _i.x1) / {span}))"
    from_2 = f"(_i.y2 + (_i.y2 - _i.y1) * ((_i.x - _i.x2) / {span}))"
    inf = "double('Infinity')"
    y = (
        f"CASE WHEN _i.x1 != _i.x2 AND abs(_i.y1) < {inf} AND abs(_i.y2) < {inf} THEN {from_1} * 0.5D + {from_2} * 0.5D "
        "ELSE _i.y1 * 0.5D + _i.y2 * 0.5D END"
    )
    clamped = "IF(isnan(_iy), _iy, least(greatest(_iy, least(_i.y1, _i.y2)), greatest(_i.y1, _i.y2)))"
    chosen = (
        "CASE WHEN _i.y1 = _i.y2 AND string(_i.y1) = string(_i.y2) THEN _i.y1 "
        "WHEN (_i.x <= _i.x1 AND _i.x1 < _i.x2) OR (_i.x >= _i.x1 AND _i.x1 > _i.x2) THEN _i.y1 "
        "WHEN (_i.x <= _i.x2 AND _i.x2 < _i.x1) OR (_i.x >= _i.x2 AND _i.x2 > _i.x1) THEN _i.y2 "
        f"ELSE get(transform(array({y}), _iy -> {clamped}), 0) END"
    )
    given = f"named_struct('x', {x}, 'x1', {x1}, 'y1', {y1}, 'x2', {x2}, 'y2', {y2})"
    return f"get(transform(array({given}), _i -> {chosen}), 0)"


def estimate(
    kind: Estimate | str, rank: int, less: int, count: int, lower: float, upper: float, first: bool, last: bool
) -> float:
    """The value of `rank` within a bin [lower, upper] that holds `count` values after `less` others."""
    kind = Estimate(kind)
    if kind is Estimate.LOWER_BOUND:
        return lower
    if kind is Estimate.UPPER_BOUND:
        return upper
    if kind is Estimate.MID_POINT:
        return max(lower, min(upper, (lower + upper) * 0.5))
    k = rank - less
    return interpolate(
        float(k - (count - k - 1)), float(-count + (1 if first else 0)), lower, float(count - (1 if last else 0)), upper
    )


#: A user's own estimator gets the bins-view columns by name and the rank.
Estimator = Callable[[Column], Column]


def estimate_col(kind: Estimate | str | Estimator, rank: str) -> Column:
    """`estimate` over the columns of a bins view and a rank column; ranks 0 and n - 1 are the exact extremes."""
    extreme = f"CASE WHEN {rank} = 0 THEN min_value WHEN {rank} = total_count - 1 THEN max_value"
    if callable(kind) and not isinstance(kind, str):
        return F.coalesce(F.expr(extreme + " END"), kind(F.col(rank)))
    if Estimate(kind) is Estimate.LOWER_BOUND:
        value = "lower_bound"
    elif Estimate(kind) is Estimate.UPPER_BOUND:
        value = "upper_bound"
    elif Estimate(kind) is Estimate.MID_POINT:
        value = "greatest(lower_bound, least(upper_bound, (lower_bound + upper_bound) * 0.5D))"
    else:
        k = f"({rank} - less_count)"
        value = interpolate_sql(
            f"double({k} - (bin_count - {k} - 1))", "double(-bin_count + int(is_first))", "lower_bound",
            "double(bin_count - int(is_last))", "upper_bound",
        )
    return F.expr(f"{extreme} ELSE {value} END")


def check_positions(alpha: float, beta: float) -> None:
    if not (0 <= alpha <= 1 and 0 <= beta <= 1):
        raise ValueError("plotting positions must lie between 0 and 1")


def quantile_of(p: float, values: Callable[[int], float], n: int, alpha: float = 0.4, beta: float = 0.4) -> float:
    """The quantile of n ascending values given by rank; NaN if there are none, p clamped to [0, 1]."""
    check_positions(alpha, beta)
    if n == 0:
        return float("nan")
    if n == 1:
        return values(0)
    z = interpolate(p, 0.0, alpha - 1, 1.0, n - beta)
    if not z > 0:
        return values(0)
    if z >= n - 1:
        return values(n - 1)
    i = int(z)
    f = z - i
    return values(i) if f == 0 else interpolate(f, 0.0, values(i), 1.0, values(i + 1))


def position_col(p: Column, n: Column, alpha: float = 0.4, beta: float = 0.4) -> Column:
    """The fractional rank of quantile p among n values, limited to [0, n - 1]."""
    check_positions(alpha, beta)
    n = n.cast("double")
    z = interpolate_col(p, F.lit(0.0), F.lit(alpha - 1.0), F.lit(1.0), n - F.lit(float(beta)))
    return F.least(F.greatest(z, F.lit(0.0)), n - 1)


def position_sql(p: str, n: str, alpha: float = 0.4, beta: float = 0.4) -> str:
    """`position_col` as text."""
    check_positions(alpha, beta)
    z = interpolate_sql(p, "0D", f"double('{alpha - 1.0!r}')", "1D", f"(double({n}) - double('{float(beta)!r}'))")
    return f"least(greatest({z}, 0D), double({n}) - 1)"


def array_quantile(values: Column, p: float, alpha: float = 0.4, beta: float = 0.4) -> Column:
    """The exact quantile of an array column sorted ascending; NaN if it is empty."""
    n = F.size(values)
    z = position_col(F.lit(float(p)), n, alpha, beta)
    i = F.floor(z).cast("int")
    v1 = F.get(values, i)
    v2 = F.coalesce(F.get(values, i + 1), v1)
    inner = interpolate_col(z - i, F.lit(0.0), v1, F.lit(1.0), v2)
    return F.when(n == 0, F.lit(float("nan"))).when(n == 1, F.get(values, F.lit(0))).otherwise(
        F.when(z == i, v1).otherwise(inner)
    )
