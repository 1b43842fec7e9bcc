"""Values at ranks and quantiles from a bins view."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkhist.functions import floatbits as fb
from sparkhist.functions.estimators import (
    Estimate,
    Estimator,
    check_positions,
    estimate_col,
    interpolate_sql,
    position_sql,
)
from sparkhist.operators.bins import bin_by_rank


def value_at_rank(
    bins: DataFrame, ranks: Sequence[int], keys: Sequence[str] = (), estimator: Estimate | str | Estimator = Estimate.UNIFORM
) -> DataFrame:
    """keys, rank, value: the estimated value of each rank; exact for the first and the last."""
    found = bin_by_rank(bins, ranks, keys)
    return found.select(*keys, "rank", estimate_col(estimator, "rank").alias("value"))


def quantiles(
    bins: DataFrame,
    ps: Sequence[float],
    keys: Sequence[str] = (),
    alpha: float = 0.4,
    beta: float = 0.4,
    estimator: Estimate | str | Estimator = Estimate.UNIFORM,
    position: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """keys, p, value: quantiles by plotting positions (alpha, beta), interpolated between two ranks.

    No join: each bin answers for the ranks it holds, and one aggregation
    over bins brings the two ranks of a quantile together.  Bins that hold
    none are dropped first, by the straight line that positions follow.
    `position` may replace the plotting positions by a function of
    (p, total_count).  p below 0 and above 1 count as 0 and 1; ValueError for
    NaN.
    """
    if any(p != p for p in ps):
        raise ValueError("NaN is no quantile")
    check_positions(alpha, beta)
    p_array = F.array(*(F.lit(float(p)) for p in ps)).cast("array<double>")
    clamped = "least(greatest(p, 0D), 1D)"
    if position:
        z, rows = position(F.expr(clamped), F.col("total_count")), bins.withColumn("p", F.explode(p_array))
    else:
        z = F.expr(position_sql(clamped, "total_count", alpha, beta))
        # The exact position differs by rounding only, which the slack exceeds.
        line = f"least(greatest({alpha - 1.0!r}D + {clamped} * (total_count - {float(beta)!r}D - {alpha - 1.0!r}D), 0D), total_count - 1D)"
        slack = "(1D + 1e-9D * total_count)"
        near = f"p -> {line} >= less_count - 1D - {slack} AND {line} < less_count + bin_count + {slack}"
        rows = bins.withColumn("_ps", F.expr(f"filter(array({', '.join(fb.sql(float(p)) for p in ps)}), {near})"))
        rows = rows.where("size(_ps) > 0").withColumn("p", F.explode("_ps"))
    rows = rows.withColumn("_z", z).withColumn("_r", F.expr("explode(array(bigint(floor(_z)), bigint(floor(_z)) + 1))"))
    rows = rows.where("less_count <= _r AND _r < less_count + bin_count")
    value = estimate_col(estimator, "_r")
    found = rows.groupBy(*keys, "p").agg(
        F.expr("first(_z) AS _z"), F.min_by(value, "_r").alias("_v1"), F.max_by(value, "_r").alias("_v2")
    )
    inner = interpolate_sql("(_z - floor(_z))", "0D", "_v1", "1D", "_v2")
    return found.select(*keys, "p", F.expr(f"CASE WHEN _z = floor(_z) THEN _v1 ELSE {inner} END").alias("value"))


def pivot_quantiles(found: DataFrame, ps: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """One row per key with a column for each quantile: p50 for 0.5 and so on."""
    cols = [
        F.max(F.when(F.col("p") == float(p), F.col("value"))).alias("p" + f"{100 * p:g}".replace(".", "_")) for p in ps
    ]
    return found.groupBy(*keys).agg(*cols)


def exact_quantiles(
    df: DataFrame, value: str, ps: Sequence[float], keys: Sequence[str] = (), alpha: float = 0.4, beta: float = 0.4
) -> DataFrame:
    """keys, p, value: quantiles of the values themselves, by plotting positions, without a histogram.

    Values are ranked within their key by a sort that spills; only the two of
    each quantile go on.  Nulls are skipped.
    """
    check_positions(alpha, beta)
    by = Window.partitionBy(*keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    rows = rows.withColumns(
        {"_r": F.row_number().over(by.orderBy("_v")).cast("long") - 1, "total_count": F.count(F.lit(1)).over(by)}
    )
    clamped = "least(greatest(p, 0D), 1D)"
    line = f"least(greatest({alpha - 1.0!r}D + {clamped} * (total_count - {float(beta)!r}D - {alpha - 1.0!r}D), 0D), total_count - 1D)"
    near = f"p -> abs({line} - _r) <= 2D + 1e-9D * total_count"
    rows = rows.withColumn("_ps", F.expr(f"filter(array({', '.join(fb.sql(float(p)) for p in ps)}), {near})"))
    rows = rows.where("size(_ps) > 0").withColumn("p", F.explode("_ps"))
    rows = rows.withColumn("_z", F.expr(position_sql(clamped, "total_count", alpha, beta)))
    rows = rows.where("_r = bigint(floor(_z)) OR _r = bigint(floor(_z)) + 1")
    found = rows.groupBy(*keys, "p").agg(
        F.expr("first(_z) AS _z"), F.expr("min_by(_v, _r) AS _v1"), F.expr("max_by(_v, _r) AS _v2")
    )
    inner = interpolate_sql("(_z - floor(_z))", "0D", "_v1", "1D", "_v2")
    return found.select(*keys, "p", F.expr(f"CASE WHEN _z = floor(_z) THEN _v1 ELSE {inner} END").alias("value"))
