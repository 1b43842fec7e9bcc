"""Recording, merging, re-binning and packing histograms as relations.

The long form of a histogram, one per key, is

    keys..., bin_index INT, bin_count BIGINT, bin_min DOUBLE, bin_max DOUBLE

with a row per non-empty bin.  Recording is one aggregation whose partial
results combine before the shuffle, so what is shuffled grows with the bins,
not with the values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkhist.functions import floatbits as fb
from sparkhist.functions.estimators import Estimate, estimate
from sparkhist.plans.layouts import Layout

LONG_MAX = 2**63 - 1
BIN_COLUMNS = ["bin_index", "bin_count", "bin_min", "bin_max"]
PACKED = "struct<total_count:bigint,min:double,max:double,bins:array<struct<bin_index:int,bin_count:bigint>>>"


def least_of(x: str) -> Column:
    """The minimum of a double column, -0.0 if that is among zeros: Spark's own keeps any of the two.

    The sign comes from a product, as the optimizer takes 0.0 and -0.0 for one constant.
    """
    sign = f"CASE WHEN bool_or({x} = 0D AND string({x}) = '-0.0') THEN -1D ELSE 1D END"
    return F.expr(f"CASE WHEN min({x}) = 0D THEN abs(min({x})) * {sign} ELSE min({x}) END")


def most_of(x: str) -> Column:
    """The maximum, 0.0 if that is among zeros."""
    sign = f"CASE WHEN bool_or({x} = 0D AND string({x}) != '-0.0') THEN 1D ELSE -1D END"
    return F.expr(f"CASE WHEN max({x}) = 0D THEN abs(max({x})) * {sign} ELSE max({x}) END")


def binned_as(x: str, signed_zeros: bool) -> str:
    """What a layout bins for the column: -0.0 by its sign, or else as the 0.0 it equals."""
    return x if signed_zeros else f"({x} + 0D)"


def record(
    df: DataFrame,
    value: str | Column,
    layout: Layout,
    keys: Sequence[str] = (),
    weight: str | Column | None = None,
    signed_zeros: bool = True,
) -> DataFrame:
    """The histogram of `value` for each key, in long form.

    `weight` counts each row that often; weight 0 is no row at all, not even
    for NaN.  Null values and weights are skipped.  A NaN or a negative
    weight fails the query, as does a count beyond 63 bits.  Without
    `signed_zeros`, -0.0 goes into the bin of 0.0; least and greatest values
    keep its sign.
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*keys, x.alias("_x"), *([] if weight is None else [_weight(weight).alias("_w")]))
    rows = rows.where("_x IS NOT NULL" if weight is None else "_x IS NOT NULL AND _w > 0")
    return rows.groupBy(*keys, layout.column(binned_as("_x", signed_zeros)).alias("bin_index")).agg(
        F.expr("count(1)" if weight is None else "sum(_w)").alias("bin_count"),
        least_of("_x").alias("bin_min"),
        most_of("_x").alias("bin_max"),
    )


def _weight(weight: str | Column) -> Column:
    w = (F.col(weight) if isinstance(weight, str) else weight).cast("long")
    return F.when(w < 0, F.raise_error(F.lit("a count can't be negative")).cast("long")).otherwise(w)


def empty(spark: SparkSession, keys: str = "") -> DataFrame:
    """A long form without rows; `keys` is a DDL string of key columns."""
    schema = (keys + ", " if keys else "") + "bin_index int, bin_count long, bin_min double, bin_max double"
    return spark.createDataFrame([], schema)


def merge(*histograms: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Histograms of one layout added up, exactly; with fewer keys than they have, a rollup."""
    if not histograms:
        raise ValueError("there is nothing to merge")
    cols = [*keys, *BIN_COLUMNS]
    both = histograms[0].select(*cols)
    for h in histograms[1:]:
        both = both.unionByName(h.select(*cols))
    return both.groupBy(*keys, "bin_index").agg(
        F.sum("bin_count").alias("bin_count"),
        least_of("bin_min").alias("bin_min"),
        most_of("bin_max").alias("bin_max"),
    )


def summary(hist: DataFrame, layout: Layout, keys: Sequence[str] = ()) -> DataFrame:
    """total_count, min_value, max_value, underflow_count, overflow_count, is_empty per key.

    Without keys an empty histogram gives a row: no values, least infinity,
    greatest -infinity.
    """
    at = lambda i: F.coalesce(F.sum(F.when(F.col("bin_index") == i, F.col("bin_count"))), F.lit(0)).cast("long")
    return hist.groupBy(*keys).agg(
        F.coalesce(F.sum("bin_count"), F.lit(0)).alias("total_count"),
        F.coalesce(F.min_by("bin_min", "bin_index"), F.lit(fb.INF)).alias("min_value"),
        F.coalesce(F.max_by("bin_max", "bin_index"), F.lit(-fb.INF)).alias("max_value"),
        at(layout.underflow).alias("underflow_count"),
        at(layout.overflow).alias("overflow_count"),
        (F.count("*") == 0).alias("is_empty"),
    )


def dense(hist: DataFrame, layout: Layout, keys: Sequence[str] = ()) -> DataFrame:
    """A row for every bin between underflow and overflow, zeros included."""
    first, last = layout.underflow + 1, layout.overflow - 1
    if first > last:
        return hist.where(F.lit(False)).select(*keys, "bin_index", "bin_count")
    if keys:
        groups = hist.select(*keys).distinct()
        grid = groups.withColumn("bin_index", F.explode(F.sequence(F.lit(first), F.lit(last))))
    else:
        grid = hist.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("bin_index"))
    on = [*keys, "bin_index"]
    h = hist.select(*(F.col(k).alias(f"_h{i}") for i, k in enumerate(on)), F.col("bin_count").alias("_n"))
    match = [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(on)]
    joined = grid.join(h, match, "left")
    return joined.select(*on, F.coalesce("_n", F.lit(0)).alias("bin_count"))


def pack(hist: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One struct per key (see PACKED): totals and the sorted non-empty bins."""
    bins = F.array_sort(F.collect_list(F.struct("bin_index", "bin_count")))
    return hist.groupBy(*keys).agg(
        F.struct(
            F.coalesce(F.sum("bin_count"), F.lit(0)).alias("total_count"),
            F.coalesce(F.min_by("bin_min", "bin_index"), F.lit(fb.INF)).alias("min"),
            F.coalesce(F.max_by("bin_max", "bin_index"), F.lit(-fb.INF)).alias("max"),
            bins.alias("bins"),
        ).alias("hist")
    )


def unpack(packed: DataFrame, keys: Sequence[str] = (), column: str = "hist") -> DataFrame:
    """Long form of packed histograms; inner bins don't know their own extremes (null)."""
    h = F.col(column)
    rows = packed.select(*keys, h["min"].alias("_lo"), h["max"].alias("_hi"), F.size(h["bins"]).alias("_n"), F.posexplode(h["bins"]))
    return rows.select(
        *keys,
        F.col("col.bin_index").alias("bin_index"),
        F.col("col.bin_count").alias("bin_count"),
        F.when(F.col("pos") == 0, F.col("_lo")).alias("bin_min"),
        F.when(F.col("pos") == F.col("_n") - 1, F.col("_hi")).alias("bin_max"),
    )


def equal(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per key of either side: equal_bins, whether both have the same counts and extremes, bit by bit."""
    pa_, pb = pack(a, keys), pack(b, keys)
    left = pa_.select(*(F.col(k).alias(f"_a{i}") for i, k in enumerate(keys)), F.col("hist").alias("a"))
    right = pb.select(*(F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)), F.col("hist").alias("b"))
    text = lambda c: F.concat_ws("|", F.col(f"{c}.min").cast("string"), F.col(f"{c}.max").cast("string"))
    same = F.col("a").isNotNull() & F.col("b").isNotNull()
    same = same & (F.col("a.bins").eqNullSafe(F.col("b.bins"))) & (text("a") == text("b"))
    on = [F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}")) for i in range(len(keys))] or [F.lit(True)]
    joined = left.join(right, on, "full_outer") if keys else left.join(right, how="cross")  # one row each
    return joined.select(
        *(F.coalesce(f"_a{i}", f"_b{i}").alias(k) for i, k in enumerate(keys)),
        F.coalesce(same, F.lit(False)).alias("equal_bins"),
    )


def runs(value: Callable[[int], float], start: int, stop: int, layout: Layout) -> Iterator[tuple[int, int, float, float]]:
    """(bin_index, count, least, greatest) of value(start..stop-1), which must ascend.

    Gallops to the end of each run, so the cost follows the bins.
    """
    while start < stop:
        i = layout.index(value(start))
        end = start
        if start < stop - 1:
            if layout.index(value(stop - 1)) == i:
                end = stop - 1
            else:
                end = fb.find_first(lambda r: layout.index(value(r)) > i, start + 1, stop - 1, start + 1) - 1
        yield i, end - start + 1, value(start), value(end)
        start = end + 1


def ascending_sequence(
    spark: SparkSession, value: Callable[[int], float], length: int, layout: Layout, parts: int | None = None
) -> DataFrame:
    """The histogram of value(0) .. value(length - 1), in time that follows the bins.

    Tasks take `parts` ranges of ranks each, whose bins are added up where
    they meet; the driver sees none of them.
    """
    if length < 0:
        raise ValueError("a length can't be negative")
    if length > LONG_MAX:
        raise OverflowError("too many values")
    parts = max(1, min(length, parts or spark.sparkContext.defaultParallelism))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int64(), pa.float64(), pa.float64()]
        for b in batches:
            for n in b.column("id").to_pylist():
                found = runs(value, n * length // parts, (n + 1) * length // parts, layout)
                while some := list(islice(found, 1 << 14)):
                    arrays = [pa.array(c, t) for c, t in zip(zip(*some), types)]
                    yield pa.RecordBatch.from_arrays(arrays, names=BIN_COLUMNS)

    schema = "bin_index int, bin_count long, bin_min double, bin_max double"
    return merge(spark.range(0, parts, 1, parts).mapInArrow(count, schema))


def rebin(
    bins: DataFrame, target: Layout, keys: Sequence[str] = (), estimator: Estimate | str = Estimate.UNIFORM
) -> DataFrame:
    """A histogram in another layout: every value, as estimated from `bins`, recorded anew.

    `bins` is a bins view.  Each source bin is split at the target's
    boundaries by a galloping search over its ranks, not by expanding them;
    least and greatest value stay exact.
    """
    kind = Estimate(estimator)
    cols = ["bin_count", "less_count", "lower_bound", "upper_bound", "is_first", "is_last", "total_count", "min_value", "max_value"]
    src = bins.select(*keys, *cols)
    schema = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keys)
    schema += (", " if keys else "") + "bin_index int, bin_count long, bin_min double, bin_max double"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.select(cols).to_pylist()
            take, out = [], []
            for at, r in enumerate(rows):
                n, less, count = r["total_count"], r["less_count"], r["bin_count"]

                def value(rank: int, r: dict = r, n: int = n, less: int = less, count: int = count) -> float:
                    if rank == 0:
                        return r["min_value"]
                    if rank == n - 1:
                        return r["max_value"]
                    return estimate(kind, rank, less, count, r["lower_bound"], r["upper_bound"], r["is_first"], r["is_last"])

                for run in runs(value, less, less + count, target):
                    take.append(at)
                    out.append(run)
            picked = b.select(list(keys)).take(pa.array(take, pa.int64())).columns if keys else []
            types = [pa.int32(), pa.int64(), pa.float64(), pa.float64()]
            arrays = [*picked, *(pa.array([o[i] for o in out], t) for i, t in enumerate(types))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *BIN_COLUMNS])

    return merge(src.mapInArrow(split, schema), keys=keys)


def mode(hist: DataFrame, layout: Layout, keys: Sequence[str] = ()) -> DataFrame:
    """counter_mode per key: log2 of the bits that the widest regular counter needs, 0 to 6."""
    regular = (F.col("bin_index") > layout.underflow) & (F.col("bin_index") < layout.overflow)
    top = F.coalesce(F.bit_or(F.when(regular, F.col("bin_count"))), F.lit(0).cast("long"))
    rule = F.lit(0)
    for m, bits in enumerate((1, 2, 4, 8, 16, 32), start=1):
        rule = F.when(F.col("_top") >= 2**bits, F.lit(m)).otherwise(rule) if bits < 63 else rule
    return hist.groupBy(*keys).agg(top.alias("_top")).select(*keys, rule.cast("int").alias("counter_mode"))


def footprint(hist: DataFrame, layout: Layout, keys: Sequence[str] = ()) -> DataFrame:
    """Bytes that in-memory forms of each histogram would take, by an arithmetic model.

    static_bytes: one 8-byte counter per bin; preprocessed_bytes: 12 per
    non-empty bin; dynamic_bytes: bit-packed counters over the occupied range
    (what an implementation that grows on the way would need at least).
    """
    size = layout.overflow - layout.underflow - 1
    regular = (F.col("bin_index") > layout.underflow) & (F.col("bin_index") < layout.overflow)
    idx = F.when(regular, F.col("bin_index"))
    agg = hist.groupBy(*keys).agg(
        F.coalesce(F.max(idx) - F.min(idx) + 1, F.lit(0)).alias("_span"),
        F.coalesce(F.bit_or(F.when(regular, F.col("bin_count"))), F.lit(0).cast("long")).alias("_top"),
        F.count(idx).alias("_n"),
    )
    bits = F.lit(1)
    for b in (1, 2, 4, 8, 16, 32):
        bits = F.when(F.col("_top") >= 2**b, F.lit(2 * b)).otherwise(bits)
    words = F.ceil(F.col("_span") * bits / F.lit(64))
    return agg.select(
        *keys,
        F.lit(16 + 40 + 20 + 8 * size).cast("long").alias("static_bytes"),
        (F.lit(16 + 56) + F.lit(12) * F.col("_n")).cast("long").alias("preprocessed_bytes"),
        (F.lit(16 + 40 + 26) + F.lit(8) * words).cast("long").alias("dynamic_bytes"),
    )


def render(hist: DataFrame, layout: Layout, keys: Sequence[str] = ()) -> DataFrame:
    """text per key: totals and all counts on one line."""
    p = pack(hist, keys)
    pair = lambda b: F.concat(b["bin_index"].cast("string"), F.lit(": "), b["bin_count"].cast("string"))
    at = lambda i: F.coalesce(
        F.get(F.filter(F.col("hist.bins"), lambda b: b["bin_index"] == i), F.lit(0))["bin_count"], F.lit(0)
    ).cast("string")
    text = F.concat(
        F.lit(f"Histogram [layout={layout!r}, underFlowCount="), at(layout.underflow),
        F.lit(", overFlowCount="), at(layout.overflow), F.lit(", totalCount="), F.col("hist.total_count").cast("string"),
        F.lit(", min="), F.col("hist.min").cast("string"), F.lit(", max="), F.col("hist.max").cast("string"),
        F.lit(", counts={"), F.array_join(F.transform("hist.bins", pair), ", "), F.lit("}]"),
    )
    return p.select(*keys, text.alias("text"))


class Finalised:
    """A histogram that refuses further values: its bins view, made once."""

    def __init__(self, bins: DataFrame, layout: Layout, keys: Sequence[str] = ()):
        self.bins, self.layout, self.keys = bins, layout, tuple(keys)

    is_mutable = False

    def add(self, *_: object) -> None:
        raise TypeError("a finalised histogram can't be changed")
