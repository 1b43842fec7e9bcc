"""Pieces of DuckDB SQL that state independently what the expressions compute."""

from __future__ import annotations

import math
from collections.abc import Iterable

from sparkhist.plans.layouts import CustomLayout, ExponentialLayout, LogLinearLayout, LogOptimalLayout, LogQuadraticLayout


def num(x: float) -> str:
    """A double literal; a plain one would be a decimal."""
    return f"CAST('{x!r}' AS DOUBLE)"


def binned(layout, source: str, value: str, keep: str = "") -> str:
    """A query over `source` with the columns `keep`, x (the value) and bin_index."""
    extra = keep + ", " if keep else ""
    src = f"SELECT {extra}CAST({value} AS DOUBLE) AS x FROM {source}"
    if isinstance(layout, CustomLayout):
        idx = " + ".join(f"(CASE WHEN x >= {num(b)} THEN 1 ELSE 0 END)" for b in layout.boundaries)
        return f"SELECT {extra}x, CAST({idx} AS INTEGER) AS bin_index FROM ({src})"
    limit, sub, scale, offset = (num(v) for v in (layout.limit, layout.sub, layout.scale, layout.offset))
    if isinstance(layout, LogOptimalLayout):
        g = f"(ln(w) - {num(math.log(5e-324))})"
    elif isinstance(layout, LogQuadraticLayout):
        g = "((m - 1) * (5 - m) + 3 * (e + 1023))"
    else:
        assert isinstance(layout, LogLinearLayout)
        g = "(m + (e + 1023))"
    return f"""SELECT {extra}x, CAST(greatest(least(CASE WHEN x < 0 THEN -i - 1 ELSE i END, {layout.overflow}), {layout.underflow}) AS INTEGER) AS bin_index
      FROM (SELECT *, CASE WHEN u >= {limit} THEN floor({scale} * {g} + {offset}) ELSE floor({sub} * u) END AS i
      FROM (SELECT *, w / pow(2.0, e) AS m
      FROM (SELECT *, CASE WHEN pow(2.0, e1 + 1) <= w THEN e1 + 1 ELSE e1 END AS e
      FROM (SELECT *, CASE WHEN pow(2.0, e0) > w THEN e0 - 1 ELSE e0 END AS e1
      FROM (SELECT *, floor(log2(w)) AS e0
      FROM (SELECT *, greatest(u, {limit}) AS w
      FROM (SELECT *, abs(x) AS u FROM ({src}))))))))"""


def exponential(layout: ExponentialLayout, source: str, value: str, keep: str) -> str:
    """`binned` of exponential buckets, for all finite values."""
    n, bounds = 1 << layout.scale, layout.bounds
    k = "len(list_filter([" + ", ".join(num(b) for b in bounds) + "], lambda b: b <= m))" if bounds else "0"
    least = num(layout.first_bits * 5e-324)
    return f"""SELECT {keep}, x, CAST(CASE WHEN x < 0 THEN -i ELSE i END AS INTEGER) AS bin_index FROM (SELECT *,
      CASE WHEN u < {least} THEN floor(u / {num(5e-324)}) ELSE (e + 1023 - CASE WHEN tiny THEN 60 ELSE 0 END) * {n} + {k} + {layout.shift} END AS i
      FROM (SELECT *, w / pow(2.0, e) AS m
      FROM (SELECT *, CASE WHEN pow(2.0, e1 + 1) <= w THEN e1 + 1 ELSE e1 END AS e
      FROM (SELECT *, CASE WHEN pow(2.0, e0) > w THEN e0 - 1 ELSE e0 END AS e1
      FROM (SELECT *, floor(log2(w)) AS e0
      FROM (SELECT *, CASE WHEN tiny THEN v * pow(2.0, 60) ELSE v END AS w
      FROM (SELECT *, v < {num(2.2250738585072014e-308)} AS tiny
      FROM (SELECT *, greatest(u, {least}) AS v
      FROM (SELECT *, abs(x) AS u FROM (SELECT {keep}, CAST({value} AS DOUBLE) AS x FROM {source}))))))))))"""


def interpolated(x: str, x1: str, y1: str, x2: str, y2: str) -> str:
    r = (
        f"(({y1}) + (({y2}) - ({y1})) * ((({x}) - ({x1})) / (({x2}) - ({x1})))) * 0.5 + "
        f"(({y2}) + (({y2}) - ({y1})) * ((({x}) - ({x2})) / (({x2}) - ({x1})))) * 0.5"
    )
    return (
        f"(CASE WHEN ({y1}) = ({y2}) THEN ({y1}) WHEN (({x}) <= ({x1}) AND ({x1}) < ({x2})) THEN ({y1}) "
        f"WHEN (({x}) >= ({x2}) AND ({x1}) < ({x2})) THEN ({y2}) "
        f"ELSE least(greatest({r}, least({y1}, {y2})), greatest({y1}, {y2})) END)"
    )


def bounds_values(layout, indices: Iterable[int] | None = None, name: str = "b") -> str:
    """(bin_index, lo, hi) of bins, found by search on the driver and written out."""
    rows = [
        f"({i}, {num(layout.lower_bound(i))}, {num(layout.upper_bound(i))})"
        for i in (range(layout.underflow, layout.overflow + 1) if indices is None else indices)
    ]
    return f"(VALUES {', '.join(rows)}) AS {name}(bin_index, lo, hi)"


def view(layout, source: str, value: str, key: str, indices: Iterable[int] | None = None) -> str:
    """The bins view of a layout as a query; `indices`: the bins there may be, if not all."""
    rows = exponential(layout, source, value, key) if isinstance(layout, ExponentialLayout) else binned(layout, source, value, key)
    return f"""SELECT {key}, v.bin_index, bin_count, less_count, total_count - less_count - bin_count AS greater_count,
      greatest(min_value, lo) AS lower_bound, least(max_value, hi) AS upper_bound,
      least(max_value, hi) - greatest(min_value, lo) AS width,
      v.bin_index = {layout.underflow} AS is_underflow, v.bin_index = {layout.overflow} AS is_overflow,
      less_count = 0 AS is_first, total_count - less_count - bin_count = 0 AS is_last, total_count, min_value, max_value
      FROM (SELECT {key}, bin_index, bin_count,
        CAST(sum(bin_count) OVER (PARTITION BY {key} ORDER BY bin_index) AS BIGINT) - bin_count AS less_count,
        CAST(sum(bin_count) OVER (PARTITION BY {key}) AS BIGINT) AS total_count,
        min(lo) OVER (PARTITION BY {key}) AS min_value, max(hi) OVER (PARTITION BY {key}) AS max_value
        FROM (SELECT {key}, bin_index, count(*) AS bin_count, min(x) AS lo, max(x) AS hi
          FROM ({rows}) GROUP BY {key}, bin_index)) v
      JOIN {bounds_values(layout, indices)} ON v.bin_index = b.bin_index"""


def scientific(x: str) -> str:
    """A number of 1 or more, or 0, with 17 digits after the point: its shortest digits, then zeros; 24 wide."""
    text = f"CAST({x} AS VARCHAR)"
    whole = f"split_part({text}, '.', 1)"
    digits = f"rtrim({whole} || split_part({text}, '.', 2), '0')"
    e = f"(length({whole}) - 1)"
    number = f"left({digits}, 1) || '.' || rpad(substr({digits}, 2), 17, '0') || 'E+' || lpad(CAST({e} AS VARCHAR), 2, '0')"
    return f"lpad(CASE WHEN {x} = 0 THEN '0.' || repeat('0', 17) || 'E+00' ELSE {number} END, 24, ' ')"


def estimated(kind: str, rank: str) -> str:
    """The estimate of a rank over the columns of `view`."""
    if kind == "lower":
        e = "lower_bound"
    elif kind == "upper":
        e = "upper_bound"
    elif kind == "midpoint":
        e = "greatest(lower_bound, least(upper_bound, (lower_bound + upper_bound) * 0.5))"
    else:
        k = f"({rank} - less_count)"
        e = interpolated(
            f"CAST({k} - (bin_count - {k} - 1) AS DOUBLE)", "CAST(-bin_count + CAST(is_first AS INTEGER) AS DOUBLE)",
            "lower_bound", "CAST(bin_count - CAST(is_last AS INTEGER) AS DOUBLE)", "upper_bound",
        )
    return f"(CASE WHEN {rank} = 0 THEN min_value WHEN {rank} = total_count - 1 THEN max_value ELSE {e} END)"


def quantile(view_sql: str, key: str, ps: list[float], alpha: float, beta: float, kind: str = "uniform") -> str:
    """key, p, value rounded to 6 digits."""
    z = interpolated("p", "0.0", num(alpha - 1), "1.0", f"CAST(n AS DOUBLE) - {num(beta)}")
    return f"""WITH v AS ({view_sql}),
    g AS (SELECT {key}, max(total_count) AS n FROM v GROUP BY {key}),
    q AS (SELECT *, least(greatest({z}, 0.0), CAST(n - 1 AS DOUBLE)) AS z
          FROM g CROSS JOIN (SELECT unnest([{", ".join(num(p) for p in ps)}]) AS p)),
    r AS (SELECT *, CAST(floor(z) AS BIGINT) AS i FROM q),
    a AS (SELECT r.{key}, p, z, i, {estimated(kind, "i")} AS v1 FROM r JOIN v ON r.{key} = v.{key}
          AND less_count <= i AND i < less_count + bin_count),
    c AS (SELECT r.{key}, p, {estimated(kind, "(i + 1)")} AS v2 FROM r JOIN v ON r.{key} = v.{key}
          AND less_count <= i + 1 AND i + 1 < less_count + bin_count)
    SELECT a.{key}, a.p, round(CASE WHEN z = i THEN v1 ELSE
      {interpolated("(z - i)", "0.0", "v1", "1.0", "coalesce(v2, v1)")} END, 6) AS value
    FROM a LEFT JOIN c ON a.{key} = c.{key} AND a.p = c.p"""
