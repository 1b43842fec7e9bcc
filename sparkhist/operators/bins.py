"""The bins view: bounds, cumulative counts and flags of every non-empty bin."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkhist.plans.layouts import Layout


def bounds_columns(layout: Layout, index: str) -> tuple[Column, Column]:
    """Lower and upper bound of the layout's bin: expressions, or for layouts without SQL a function of Arrow batches."""
    native = layout.bounds_sql(index)
    if native is not None:
        return F.expr(native[0]), F.expr(native[1])

    @F.pandas_udf("lower double, upper double")
    def bounds(i: pd.Series) -> pd.DataFrame:
        known = {k: (layout.lower_bound(int(k)), layout.upper_bound(int(k))) for k in i.unique()}
        return pd.DataFrame([known[k] for k in i], columns=["lower", "upper"])

    both = bounds(F.col(index))
    return both["lower"], both["upper"]


def bins_view(hist: DataFrame, layout: Layout, keys: Sequence[str] = ()) -> DataFrame:
    """keys, bin_index, bin_count, less_count, greater_count, bounds, width, flags and the key's totals.

    Windows run over bins, never over values.  A filter on counts is applied
    before bounds are worked out, so asking for few bins costs little.
    """
    by = Window.partitionBy(*keys)
    up = by.orderBy("bin_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = by.orderBy("bin_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = hist.select(
        *keys,
        "bin_index",
        "bin_count",
        (F.sum("bin_count").over(up) - F.col("bin_count")).alias("less_count"),
        F.sum("bin_count").over(whole).alias("total_count"),
        F.first("bin_min").over(whole).alias("min_value"),
        F.last("bin_max").over(whole).alias("max_value"),
    )
    lower, upper = bounds_columns(layout, "bin_index")
    v = v.withColumns({
        "lower_bound": F.greatest("min_value", lower), "upper_bound": F.least("max_value", upper),
        "greater_count": F.expr("total_count - less_count - bin_count"),
    })
    return v.select(
        *keys, "bin_index", "bin_count", "less_count", "greater_count", "lower_bound", "upper_bound",
        F.when(F.col("upper_bound") == F.col("lower_bound"), F.lit(0.0))
        .otherwise(F.col("upper_bound") - F.col("lower_bound")).alias("width"),
        (F.col("bin_index") == layout.underflow).alias("is_underflow"),
        (F.col("bin_index") == layout.overflow).alias("is_overflow"),
        (F.col("less_count") == 0).alias("is_first"),
        (F.col("greater_count") == 0).alias("is_last"),
        "total_count", "min_value", "max_value",
    )


def first_last(hist: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """first_bin, first_count, last_bin, last_count per key; no row for an empty histogram."""
    out = hist.groupBy(*keys).agg(
        F.min("bin_index").alias("first_bin"),
        F.min_by("bin_count", "bin_index").alias("first_count"),
        F.max("bin_index").alias("last_bin"),
        F.max_by("bin_count", "bin_index").alias("last_count"),
    )
    return out.where(F.col("first_bin").isNotNull())


def neighbours(hist: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each non-empty bin with the next and the previous one."""
    w = Window.partitionBy(*keys).orderBy("bin_index")
    return hist.select(
        *keys, "bin_index", "bin_count",
        F.lead("bin_index").over(w).alias("next_bin"), F.lag("bin_index").over(w).alias("previous_bin"),
    )


def ascending(hist: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return hist.orderBy(*keys, "bin_index")


def descending(hist: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return hist.orderBy(*keys, F.col("bin_index").desc())


def top_bins(hist: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """The n highest non-empty bins of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col("bin_index").desc())
    return hist.select(*keys, "bin_index", "bin_count", F.row_number().over(w).alias("place")).where(F.col("place") <= n)


def count_at(hist: DataFrame, index: int, layout: Layout, keys: Sequence[str] = ()) -> DataFrame:
    """bin_count of one bin per key, 0 if empty; indices beyond the range mean under- or overflow."""
    i = min(max(index, layout.underflow), layout.overflow)
    at = F.coalesce(F.sum(F.when(F.col("bin_index") == i, F.col("bin_count"))), F.lit(0))
    return hist.groupBy(*keys).agg(at.alias("bin_count"))


def count_below(hist: DataFrame, value: float, layout: Layout, keys: Sequence[str] = ()) -> DataFrame:
    """below_count: values in lower bins than that of `value`; share: their part of all."""
    below = F.coalesce(F.sum(F.when(F.col("bin_index") < layout.index(value), F.col("bin_count"))), F.lit(0))
    return hist.groupBy(*keys).agg(below.alias("below_count"), (below / F.sum("bin_count")).alias("share"))


def bin_by_rank(bins: DataFrame, ranks: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """The bin that holds each rank: a filter on cumulative counts, no join.

    A rank below 0, or from a key's total_count on, is an error.
    """
    if any(r < 0 for r in ranks):
        raise ValueError("ranks start at 0")
    if not ranks:
        raise ValueError("ranks are missing")
    high = f"total_count <= {max(ranks)}L"
    held = F.filter(
        F.array(*(F.lit(int(x)).cast("long") for x in ranks)),
        lambda r: (F.col("less_count") <= r) & (r < F.col("less_count") + F.col("bin_count")),
    )
    # The first bin answers for a rank that no bin holds.
    few = bins.where((F.size(held) > 0) | (F.col("is_first") & F.expr(high)))
    few = few.where(F.expr(f"NOT ({high}) OR raise_error('there are fewer values than a rank asks for') IS NOT NULL"))
    return few.withColumn("rank", F.explode(held))


def describe(bins: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """text: one line per bin with all it knows."""
    fields = [
        ("binIndex", "bin_index"), ("lowerBound", "lower_bound"), ("upperBound", "upper_bound"), ("binCount", "bin_count"),
        ("lessCount", "less_count"), ("greaterCount", "greater_count"), ("isUnderflowBin", "is_underflow"),
        ("isOverflowBin", "is_overflow"),
    ]
    text = [F.concat(F.lit(f"{name}="), F.col(c).cast("string")) for name, c in fields]
    return bins.select(*keys, "bin_index", F.concat(F.lit("Bin ["), F.concat_ws(", ", *text), F.lit("]")).alias("text"))


def print_bins(bins: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """line: bounds and count of each bin."""
    return bins.select(
        *keys, "bin_index", F.format_string("%24.17E - %24.17E : %19d", "lower_bound", "upper_bound", "bin_count").alias("line")
    )


def print_stars(bins: DataFrame, keys: Sequence[str] = (), most: int = 1_000_000) -> DataFrame:
    """line: bounds of each bin and a star for every value up to it; an error beyond `most` stars."""
    n = F.col("less_count") + F.col("bin_count")
    n = F.when(n > most, F.raise_error(F.lit(f"a line of more than {most} stars")).cast("int")).otherwise(n.cast("int"))
    return bins.select(
        *keys, "bin_index",
        F.concat(F.format_string("%24.17E - %24.17E : ", "lower_bound", "upper_bound"), F.repeat(F.lit("*"), n)).alias("line"),
    )
