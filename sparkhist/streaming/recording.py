"""Recording histograms of a stream by time window.

Bin rows add up, so late batches and restarts need no more than a merge.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkhist.functions import floatbits as fb
from sparkhist.operators.histogram import _weight, binned_as, least_of, merge, most_of
from sparkhist.plans.layouts import Layout


def record_windows(
    df: DataFrame,
    time: str,
    value: str,
    layout: Layout,
    duration: str,
    slide: str | None = None,
    late: str | None = None,
    keys: Sequence[str] = (),
    weight: str | None = None,
    session: bool = False,
    signed_zeros: bool = True,
) -> DataFrame:
    """Long form per window (window_start, window_end) and key, of a stream or a table.

    `late` is the watermark's delay; `session` makes `duration` the gap that
    ends a session, and all bins share the sessions of their key.  Values are
    binned before they are grouped, in sessions too: those of a table by a
    sort of each key's rows, those of a stream in a state of bins, for which
    `late` is needed.  `signed_zeros` as in `record`.
    """
    t = F.col(time).cast("timestamp")
    cols = [t.alias("_t"), *keys, F.col(value).cast("double").alias("_x")]
    rows = df.select(*cols, *([_weight(weight).alias("_w")] if weight else [])).where(F.col("_x").isNotNull())
    if weight:
        rows = rows.where("_w > 0")
    if late:
        rows = rows.withWatermark("_t", late)
    index = layout.column(binned_as("_x", signed_zeros)).alias("bin_index")
    n = F.sum("_w") if weight else F.count(F.lit(1))
    totals = [n.alias("bin_count"), least_of("_x").alias("bin_min"), most_of("_x").alias("bin_max")]
    names = ["window_start", "window_end", *keys, "bin_index", "bin_count", "bin_min", "bin_max"]
    if session:
        binned = rows.where("_t IS NOT NULL").withColumn("bin_index", index)
        if df.isStreaming:
            return _stream_sessions(binned, duration, keys, bool(weight)).select(*names)
        by = Window.partitionBy(*keys).orderBy("_t")
        gap = F.expr(f"INTERVAL {duration}")
        opens = F.coalesce((F.col("_t") >= F.lag("_t").over(by) + gap).cast("long"), F.lit(0))
        numbered = binned.withColumn("_opens", opens)
        numbered = numbered.withColumn("_s", F.sum("_opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        whole = Window.partitionBy(*keys, "_s")
        ends = numbered.withColumns(
            {"window_start": F.min("_t").over(whole), "window_end": F.max("_t").over(whole) + gap}
        )
        return ends.groupBy("window_start", "window_end", *keys, "bin_index").agg(*totals).select(*names)
    w = F.window("_t", duration, slide) if slide else F.window("_t", duration)
    out = rows.groupBy(w.alias("w"), *keys, index).agg(*totals)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *names[2:])


def add_to_sessions(
    sessions: list[tuple[int, int, dict[int, list]]], times: list[int], rows: list[tuple[int, int, float]], gap: int
) -> list[tuple[int, int, dict[int, list]]]:
    """Sessions (first, last, bins) after some (bin, count, value) at `times`; those less than `gap` apart join."""
    new = [(t, t, {i: [n, x, x]}) for t, (i, n, x) in zip(times, rows)]
    out: list[tuple[int, int, dict[int, list]]] = []
    for first, last, bins in sorted(sessions + new, key=lambda s: s[:2]):
        if out and first < out[-1][1] + gap:
            start, end, into = out[-1]
            for i, (n, lo, hi) in bins.items():
                had = into.get(i)
                into[i] = [n, lo, hi] if had is None else [had[0] + n, _least(had[1], lo), -_least(-had[2], -hi)]
            out[-1] = (start, max(end, last), into)
        else:
            out.append((first, last, {i: list(b) for i, b in bins.items()}))
    return out


def _least(a: float, b: float) -> float:
    return a if fb.double_to_ordered(a) <= fb.double_to_ordered(b) else b


def _stream_sessions(binned: DataFrame, duration: str, keys: Sequence[str], weighted: bool) -> DataFrame:
    """Bins of each session once the watermark has passed its end; the state holds bins, not values."""
    gap = int(pd.Timedelta(duration).value // 1000)
    micros = F.unix_micros("_t").alias("_us")
    src = binned.select("_t", micros, *keys, "bin_index", "_x", (F.col("_w") if weighted else F.lit(1).cast("long")).alias("_w"))
    kinds = [(k, src.schema[k].dataType.simpleString()) for k in keys]
    shape = ", ".join(f"`{k}` {t}" for k, t in kinds)
    shape += (", " if keys else "") + "_a long, _b long, bin_index int, bin_count long, bin_min double, bin_max double"
    held = "first array<long>, last array<long>, owner array<int>, bin array<int>, n array<long>, lo array<double>, hi array<double>"

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        sessions: list[tuple[int, int, dict[int, list]]] = []
        if state.exists:
            first, last, owner, *bins = state.get
            sessions = [(a, b, {}) for a, b in zip(first, last)]
            for o, i, *b in zip(owner, *bins):
                sessions[o][2][i] = b
        if not state.hasTimedOut:
            for f in frames:
                rows = list(zip(f["bin_index"].tolist(), f["_w"].tolist(), f["_x"].tolist()))
                sessions = add_to_sessions(sessions, f["_us"].tolist(), rows, gap)
        passed = state.getCurrentWatermarkMs() * 1000
        done = [s for s in sessions if s[1] + gap <= passed]
        open_ = [s for s in sessions if s[1] + gap > passed]
        if open_:
            flat = [(o, i, *b) for o, s in enumerate(open_) for i, b in s[2].items()]
            state.update(([s[0] for s in open_], [s[1] for s in open_], *([r[c] for r in flat] for c in range(5))))
            state.setTimeoutTimestamp(max(min(s[1] for s in open_) + gap, passed + 1000) // 1000 + 1)
        elif state.exists:
            state.remove()
        out = [(*(key if keys else ()), a, b + gap, i, *c) for a, b, bins in done for i, c in bins.items()]
        yield pd.DataFrame(out, columns=[*keys, "_a", "_b", "bin_index", "bin_count", "bin_min", "bin_max"])

    grouped = src.groupBy(*(keys or [F.lit(0)]))
    found = grouped.applyInPandasWithState(advance, shape, held, "append", "EventTimeTimeout")
    return found.withColumns({"window_start": F.timestamp_micros("_a"), "window_end": F.timestamp_micros("_b")})


def append_sink(path: str):
    """A foreachBatch function that keeps each batch's bins once, however often it is retried."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_sink(spark, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """The merged long form of all batches that `append_sink` wrote from append-mode output."""
    return merge(spark.read.parquet(path), keys=["window_start", "window_end", *keys])
