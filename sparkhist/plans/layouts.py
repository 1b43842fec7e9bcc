"""Layouts: monotone maps from doubles to bin indices, as Python functions and as columns.

A layout has an underflow and an overflow index; values beyond its range fall
into those two bins.  Its parameters are worked out on the driver and enter a
plan as literals, so mapping is plain arithmetic inside generated code.
"""

from __future__ import annotations

import math
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkhist.functions import floatbits as fb

#: Octaves above the limit up to which exponents are found by comparisons.
MOST_OCTAVES = 48
_LOWEST, _HIGHEST = fb.double_to_ordered(-fb.INF), fb.double_to_ordered(fb.INF)


class Layout:
    """Subclasses give `underflow`, `overflow`, `raw_index` and `raw_sql`.

    A user's own layout may leave `raw_sql` out; `raw_indices` then runs on
    Arrow batches.  It may give `bounds_sql` too.
    """

    underflow: int
    overflow: int

    def raw_index(self, value: float) -> int:
        """The bin of a number before clamping; monotone."""
        raise NotImplementedError

    def raw_indices(self, values: np.ndarray) -> np.ndarray:
        """Bins of an array of finite doubles, clamped later; a layout without `raw_sql` should compute it on the whole array."""
        different, where = np.unique(values, return_inverse=True)
        return np.array([self.index(v) for v in different.tolist()], np.int64)[where]

    def raw_sql(self, x: str) -> str | None:
        """SQL for the bin of a finite double, as a double; it may exceed the range."""
        return None

    def index(self, value: float) -> int:
        """The bin of a number, within [underflow, overflow]; ValueError for NaN."""
        if value != value:
            raise ValueError("NaN has no bin")
        if math.isinf(value):
            return self.overflow if value > 0 else self.underflow
        return min(max(self.raw_index(value), self.underflow), self.overflow)

    def column(self, name: str) -> Column:
        """`index` of a double column; NaN fails the query, null stays null.

        Arithmetic instead of conditions, for which repeated parts would be
        evaluated again and again; and text, which takes one call to build.
        """
        checks = (
            f"coalesce(int(assert_true(NOT isnan({name}), \"NaN can't be recorded\")), 0) "
            f"+ CASE WHEN {name} IS NULL THEN CAST(NULL AS INT) ELSE 0 END"  # least and greatest skip nulls
        )
        top, lo, hi = fb.sql(fb.MAX_VALUE), fb.sql(float(self.underflow)), fb.sql(float(self.overflow))
        finite = f"least(greatest({name}, -{top}), {top})"
        infinite = f"double(abs({name}) = double('Infinity')) * signum({name}) * 1e18D"
        raw = self.raw_sql(finite)
        if raw is not None:
            return F.expr(f"int(least(greatest({raw} + {infinite}, {lo}), {hi})) + {checks}")
        i = _python_index(self)(F.expr(finite)).cast("double") + F.expr(infinite)
        return F.least(F.greatest(i, F.expr(lo)), F.expr(hi)).cast("int") + F.expr(checks)

    def seed(self, i: int) -> float | None:
        """A guess of the lower bound of bin i, if there is a cheap one."""
        return None

    def lower_bound(self, i: int) -> float:
        """The smallest double of bin i; -inf from the underflow bin down."""
        if i <= self.underflow:
            return -fb.INF
        i = min(i, self.overflow)
        guess = self.seed(i)
        at = None if guess is None or guess != guess else fb.double_to_ordered(guess)
        return fb.ordered_to_double(
            fb.find_first(lambda n: self.index(fb.ordered_to_double(n)) >= i, _LOWEST, _HIGHEST, at)
        )

    def upper_bound(self, i: int) -> float:
        """The largest double of bin i; inf from the overflow bin up."""
        if i >= self.overflow:
            return fb.INF
        return fb.ordered_to_double(fb.double_to_ordered(self.lower_bound(max(i, self.underflow) + 1)) - 1)

    def bounds_sql(self, i: str) -> tuple[str, str] | None:
        """SQL for the lower and upper bound of the bin in column `i`, if the layout has such."""
        return None

    @property
    def normal_range(self) -> tuple[float, float]:
        """Bounds of all bins but underflow and overflow."""
        return self.lower_bound(self.underflow + 1), self.upper_bound(self.overflow - 1)

    def _key(self) -> tuple:
        raise NotImplementedError

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self._key() == other._key()

    def __hash__(self) -> int:
        return hash((type(self).__name__, self._key()))


def _python_index(layout: Layout):
    @F.pandas_udf("int")
    def index(x: pd.Series) -> pd.Series:
        out = pd.Series(pd.NA, x.index, "Int32")
        known = x.notna()
        if known.any():
            raw = np.asarray(layout.raw_indices(x[known].to_numpy(float)), np.int64)
            out[known] = np.clip(raw, layout.underflow, layout.overflow)
        return out

    return index


class _MirroredLayout(Layout):
    """A layout whose bins below zero mirror those above.

    Subclasses give `seed_sql`.  `zero` is the bin that mirrors bin 0: -1
    where 0.0 and -0.0 have bins of their own, 0 where they share one.
    """

    zero = -1

    def seed_sql(self, k: str) -> str:
        """SQL for a double near the smallest number of bin k > 0, within a millionth of it."""
        raise NotImplementedError

    def _first_sql(self, k: str) -> str:
        """SQL for the smallest number u >= 0 whose bin is at least k; exact.

        Bisects from both sides of the seed until no double lies between.
        """
        top, tiny = fb.sql(fb.MAX_VALUE), fb.sql(fb.MIN_VALUE)
        start = (
            f"named_struct('a', greatest(s * {fb.sql(1 - 2.0**-20)} - {tiny}, 0D), "
            f"'b', least(s * {fb.sql(1 + 2.0**-20)} + {tiny}, {top}))"
        )
        start = f"get(transform(array({self.seed_sql('k')}), s -> {start}), 0)"
        step = f"IF({self.raw_sql('m')} >= k, named_struct('a', t.a, 'b', m), named_struct('a', m, 'b', t.b))"
        step = f"get(transform(array(t.a + (t.b - t.a) * 0.5D), m -> {step}), 0)"
        found = f"aggregate(sequence(1, 36), {start}, (t, j) -> {step}, t -> t.b)"
        most = fb.sql(float(self.raw_index(fb.MAX_VALUE)))
        first = f"CASE WHEN k <= 0D THEN 0D WHEN k > {most} THEN double('Infinity') ELSE {found} END"
        return f"get(transform(array({k}), k -> {first}), 0)"

    def bounds_sql(self, i: str) -> tuple[str, str]:
        k = f"double(CASE WHEN {i} < 0 THEN {self.zero} - {i} ELSE {i} END)"
        first = self._first_sql(k)
        # The double before a positive one; what of the two rounds to the number itself is the larger.
        last = f"least(u * {fb.sql(1 - 2.0**-53)}, u - {fb.sql(fb.MIN_VALUE)}, {fb.sql(fb.MAX_VALUE)})"
        last = f"get(transform(array({self._first_sql(k + ' + 1D')}), u -> {last}), 0)"
        below = f"{i} < {1 + self.zero}"  # bin 0 reaches from -0.0 on where it mirrors itself
        lower = f"CASE WHEN {i} <= {self.underflow} THEN double('-Infinity') WHEN {below} THEN -({last}) ELSE {first} END"
        upper = f"CASE WHEN {i} >= {self.overflow} THEN double('Infinity') WHEN {i} < 0 THEN -({first}) ELSE {last} END"
        return lower, upper


class _LogLayout(_MirroredLayout):
    """Bins of constant width near zero and of constant relative width beyond."""

    def __init__(self, abs_width: float, rel_width: float, lo: float, hi: float):
        lo, hi, a, r = float(lo), float(hi), float(abs_width), float(rel_width)
        if not (math.isfinite(lo) and math.isfinite(hi) and hi >= lo):
            raise ValueError("the range must be finite and not empty")
        if not fb.MIN_NORMAL <= a <= fb.MAX_VALUE:
            raise ValueError("the absolute bin width limit must be a normal positive number")
        if not 0 <= r <= fb.MAX_VALUE:
            raise ValueError("the relative bin width limit must be finite and not negative")
        self.abs_width, self.rel_width = a, r
        self.first = fb.truncated(math.ceil(1 / r)) if r and 1 / r < fb.INT_MAX else fb.INT_MAX
        self.sub = 1 / a
        # A scale without relative limit never applies: its part starts beyond all numbers.
        self.scale = self._factor(r) if r else fb.INF
        self.limit = self._normal_limit()
        self.offset = self._offset()
        first, last = self.raw_index(lo), self.raw_index(hi)
        if first <= fb.INT_MIN or last >= fb.INT_MAX or (last + 1) - (first - 1) - 1 > fb.INT_MAX:
            raise ValueError("the range has too many bins")
        self.underflow, self.overflow = first - 1, last + 1

    @staticmethod
    def _factor(rel: float) -> float:
        return 1 / math.log1p(rel)

    @staticmethod
    def _growth(u: float) -> float:
        raise NotImplementedError

    @staticmethod
    def _growth_sql(u: str) -> str:
        raise NotImplementedError

    @staticmethod
    def _parts_sql(m: str, e: str) -> str | None:
        """`_growth` from mantissa and exponent, where it is made of these."""
        return None

    @staticmethod
    def _shrink(g: float) -> float:
        """The inverse of `_growth`, near enough to seed a search."""
        raise NotImplementedError

    @staticmethod
    def _shrink_sql(g: str) -> str:
        raise NotImplementedError

    def _normal_limit(self) -> float:
        n = fb.find_first(
            lambda b: fb.truncated(self.sub * fb.ordered_to_double(b)) >= self.first,
            0,
            _HIGHEST,
            fb.double_to_ordered(min(self.first / self.sub, fb.MAX_VALUE)),
        )
        return fb.ordered_to_double(n)

    def _offset(self) -> float:
        if math.isinf(self.limit) or math.isinf(self.scale):
            return 0.0
        g = self.scale * self._growth(self.limit)
        n = fb.find_first(
            lambda b: fb.truncated(g + fb.ordered_to_double(b)) >= self.first,
            _LOWEST,
            _HIGHEST,
            fb.double_to_ordered(self.first - g),
        )
        return fb.ordered_to_double(n)

    def raw_index(self, value: float) -> int:
        u = abs(value)
        if u >= self.limit:
            i = fb.truncated(self.scale * self._growth(u) + self.offset)
        else:
            i = fb.truncated(self.sub * u)
        return ~i if fb.is_negative(value) else i

    def _wide_sql(self, u: str) -> str:
        """`_growth` of u, which the limit and, where it is certain to lie in an outermost bin, a power of two bound.

        Over few octaves the exponent is a sum of comparisons, which costs a
        fraction of logarithm and powers.
        """
        least = max(self.limit, fb.MIN_NORMAL)
        first = math.frexp(least)[1] - 1
        last = math.frexp(max(map(abs, self._range)))[1]
        if self._parts_sql("m", "e") is None or not 0 < last - first <= MOST_OCTAVES or last > 1023:
            return self._growth_sql(f"greatest({u}, {fb.sql(least)})")
        big = f"least(greatest({u}, {fb.sql(least)}), {fb.sql(math.ldexp(1.0, last))})"
        octave = "(" + " + ".join(f"int({big} >= {fb.sql(math.ldexp(1.0, k))})" for k in range(first + 1, last + 1)) + ")"
        scales = ", ".join(fb.sql(math.ldexp(1.0, -k)) for k in range(first, last + 1))
        return self._parts_sql(f"({big} * get(array({scales}), {octave}))", f"double({octave} + {first})")

    @cached_property
    def _range(self) -> tuple[float, float]:
        return self.upper_bound(self.underflow), self.lower_bound(self.overflow)

    def raw_sql(self, x: str) -> str:
        u, limit = f"abs({x})", fb.sql(self.limit)
        i = f"double(floor({fb.sql(self.sub)} * least({u}, {limit})))"
        if not (math.isinf(self.limit) or math.isinf(self.scale)):
            wide = f"double(floor({fb.sql(self.scale)} * {self._wide_sql(u)} + {fb.sql(self.offset)}))"
            start = fb.sql(float(fb.truncated(self.scale * self._growth(self.limit) + self.offset)))
            # Below the limit the second part is the limit's bin; from it on the first adds nothing.
            i = f"({wide} + least({i} - {start}, 0D))"
        sign = f"double({fb.negative(x)})"
        return f"(least({i}, {fb.sql(float(fb.INT_MAX))}) * (1D - {sign} * 2D) - {sign})"

    def seed(self, i: int) -> float:
        if i < 0:
            return -self.seed(-i)
        if i < self.first or math.isinf(self.scale):
            return min(i / self.sub, fb.MAX_VALUE)
        try:
            return self._shrink((i - self.offset) / self.scale)
        except (OverflowError, ValueError):
            return fb.MAX_VALUE

    def seed_sql(self, k: str) -> str:
        near = f"least({k} / {fb.sql(self.sub)}, {fb.sql(fb.MAX_VALUE)})"
        if math.isinf(self.scale):
            return near
        far = self._shrink_sql(f"(({k} - {fb.sql(self.offset)}) / {fb.sql(self.scale)})")
        return f"IF({k} < {fb.sql(float(self.first))}, {near}, {far})"

    def _key(self) -> tuple:
        return self.abs_width, self.rel_width, self.underflow, self.overflow

    def __repr__(self) -> str:
        return (
            f"{type(self).__name__} [absoluteBinWidthLimit={self.abs_width}, relativeBinWidthLimit={self.rel_width}, "
            f"underflowBinIndex={self.underflow}, overflowBinIndex={self.overflow}]"
        )

    @classmethod
    def restore(cls, abs_width: float, rel_width: float, underflow: int, overflow: int) -> _LogLayout:
        """A layout from its stored parameters, without its range."""
        out = cls(abs_width, rel_width, 0.0, 0.0)
        if not underflow < overflow:
            raise ValueError("the overflow bin must lie above the underflow bin")
        out.underflow, out.overflow = underflow, overflow
        return out


class LogLinearLayout(_LogLayout):
    """Relative widths by linear pieces: fast, up to 44 % more bins than necessary."""

    @staticmethod
    def _growth(u: float) -> float:
        m, e = fb.parts(u)
        return m + e

    @staticmethod
    def _growth_sql(u: str) -> str:
        e = fb.exponent(u)
        return LogLinearLayout._parts_sql(f"{u} / power(2D, {e})", e)

    @staticmethod
    def _parts_sql(m: str, e: str) -> str:
        return f"({m} + ({e} + 1023D))"

    @staticmethod
    def _shrink(g: float) -> float:
        e = math.floor(g) - 1
        return math.ldexp(g - e, e - 1023)

    @staticmethod
    def _shrink_sql(g: str) -> str:
        return f"({g} - floor({g}) + 1D) * power(2D, floor({g}) - 1024D)"


class LogQuadraticLayout(_LogLayout):
    """Relative widths by quadratic pieces: about 8 % more bins than necessary."""

    @staticmethod
    def _factor(rel: float) -> float:
        return 0.25 / math.log1p(rel)

    @staticmethod
    def _growth(u: float) -> float:
        m, e = fb.parts(u)
        return (m - 1.0) * (5.0 - m) + 3.0 * e

    @staticmethod
    def _growth_sql(u: str) -> str:
        e = fb.exponent(u)
        return LogQuadraticLayout._parts_sql(f"({u} / power(2D, {e}))", e)

    @staticmethod
    def _parts_sql(m: str, e: str) -> str:
        return f"(({m} - 1D) * (5D - {m}) + 3D * ({e} + 1023D))"

    @staticmethod
    def _shrink(g: float) -> float:
        e = math.floor(g / 3)
        return math.ldexp(3 - math.sqrt(max(0.0, 3 * e + 4 - g)), e - 1023)

    @staticmethod
    def _shrink_sql(g: str) -> str:
        e = f"floor({g} / 3D)"
        return f"(3D - sqrt(greatest(0D, 3D * {e} + 4D - {g}))) * power(2D, {e} - 1023D)"


class LogOptimalLayout(_LogLayout):
    """Relative widths by logarithm: the fewest bins; depends on the platform's log in the last bit."""

    @staticmethod
    def _growth(u: float) -> float:
        return math.log(u) - math.log(fb.MIN_VALUE)

    @staticmethod
    def _growth_sql(u: str) -> str:
        return f"(ln({u}) - {fb.sql(math.log(fb.MIN_VALUE))})"

    @staticmethod
    def _shrink(g: float) -> float:
        return math.exp(g + math.log(fb.MIN_VALUE))

    @staticmethod
    def _shrink_sql(g: str) -> str:
        return f"exp({g} + {fb.sql(math.log(fb.MIN_VALUE))})"


def exponential_boundaries(scale: int) -> list[float]:
    """Mantissas in (1, 2) at which the 2^scale buckets of an octave begin, exactly rounded up."""
    n = 1 << scale
    out = []
    for i in range(1, n):
        v = 1 << (52 * n + i)
        for _ in range(scale):
            v = math.isqrt(v)
        out.append((v + 1) / 4503599627370496.0)
    return out


class ExponentialLayout(_MirroredLayout):
    """Exponential buckets of base 2^(2^-scale), scale 0 to 10; shared instances."""

    zero = 0

    def __new__(cls, scale: int):
        return _exponential(scale)

    @staticmethod
    def _make(scale: int) -> ExponentialLayout:
        if not (isinstance(scale, int) and 0 <= scale <= 10):
            raise ValueError("the scale must lie between 0 and 10")
        self = object.__new__(ExponentialLayout)
        self.scale = scale
        self.bounds = exponential_boundaries(scale)
        self.shift, self.first_bits = 0, 0
        n = 1
        while self._plain(n * fb.MIN_VALUE) != self._plain((n + 1) * fb.MIN_VALUE):
            n += 1
        self.first_bits = n
        self.shift = n - self._plain(n * fb.MIN_VALUE)
        self.overflow = self.raw_index(fb.MAX_VALUE) + 1
        self.underflow = -self.overflow
        return self

    def __reduce__(self):
        return ExponentialLayout, (self.scale,)

    def _plain(self, u: float) -> int:
        from bisect import bisect_right

        m, e = math.frexp(u)
        return ((e - 1 + 1023) << self.scale) + bisect_right(self.bounds, m * 2)

    def raw_index(self, value: float) -> int:
        u = abs(value)
        if u < self.first_bits * fb.MIN_VALUE:
            i = int(u / fb.MIN_VALUE)
        elif math.isinf(u):
            i = self.overflow
        else:
            i = self._plain(u) + self.shift
        return -i if fb.is_negative(value) else i

    def raw_sql(self, x: str) -> str:
        u, least, n = f"abs({x})", fb.sql(self.first_bits * fb.MIN_VALUE), 1 << self.scale
        big = f"greatest({u}, {least})"
        tiny = f"double({big} < {fb.sql(fb.MIN_NORMAL)})"
        v = f"({big} * (1D + {tiny} * {fb.sql(2.0**60 - 1)}))"  # subnormal numbers made normal, exactly
        e = fb.exponent(v)
        m = f"({v} / power(2D, {e}))"
        k = "0D"
        if n > 1:
            # The logarithm guesses the bucket; the exact boundaries beside it decide.
            edges = f"array({', '.join(map(fb.sql, [1.0, *self.bounds, 2.0]))})"
            g = f"int(least(greatest(floor(log2({m}) * {n}D), 0L), {n - 1}L))"
            k = f"({g} - double(get({edges}, {g}) > {m}) + double(get({edges}, {g} + 1) <= {m}))"
        i = f"(({e} + 1023D - {tiny} * 60D) * {n}D + {k} + {fb.sql(float(self.shift))})"
        below = f"double(least(floor(least({u}, {least}) / {fb.sql(fb.MIN_VALUE)}) - {self.first_bits}L, 0L))"
        return f"(({i} + {below}) * (1D - double({fb.negative(x)}) * 2D))"

    def seed(self, i: int) -> float:
        a = abs(i)
        if a < self.first_bits:
            u = a * fb.MIN_VALUE
        else:
            e, k = (a - self.shift) >> self.scale, (a - self.shift) & ((1 << self.scale) - 1)
            try:
                u = math.ldexp(self.bounds[k - 1] if k else 1.0, e - 1023)
            except OverflowError:
                u = fb.INF
        return u if i > 0 else -u

    def seed_sql(self, k: str) -> str:
        j = f"(bigint({k}) - {self.shift}L)"
        edges = f"array({', '.join(map(fb.sql, [1.0, *self.bounds]))})"
        far = f"get({edges}, int({j} & {(1 << self.scale) - 1}L)) * power(2D, shiftright({j}, {self.scale}) - 1023D)"
        return f"IF({k} < {fb.sql(float(self.first_bits))}, {k} * {fb.sql(fb.MIN_VALUE)}, {far})"

    def _key(self) -> tuple:
        return (self.scale,)

    def __repr__(self) -> str:
        return f"{type(self).__name__} [scale={self.scale}]"


@lru_cache(maxsize=None)
def _exponential(scale: int) -> ExponentialLayout:
    return ExponentialLayout._make(scale)


class CustomLayout(Layout):
    """Bins between given boundaries: one below the first, one from the last on."""

    def __init__(self, *boundaries: float):
        if len(boundaries) == 1 and isinstance(boundaries[0], (list, tuple)):
            boundaries = tuple(boundaries[0])
        b = tuple(float(x) for x in boundaries)
        if not b:
            raise ValueError("boundaries are missing")
        order = [fb.double_to_ordered(x) for x in b]
        if any(x != x for x in b) or any(p >= q for p, q in zip(order, order[1:])):
            raise ValueError("boundaries must ascend strictly")
        self.boundaries = b
        self._order = order
        self.underflow, self.overflow = 0, len(b)

    def raw_index(self, value: float) -> int:
        from bisect import bisect_right

        return bisect_right(self._order, fb.double_to_ordered(value))

    def index(self, value: float) -> int:
        if value != value:
            raise ValueError("NaN has no bin")
        return self.raw_index(value)

    def raw_sql(self, x: str) -> str:
        b = self.boundaries
        if len(b) <= 64:
            i = " + ".join(f"double({x} >= {fb.sql(v)})" for v in b)
        else:
            i = f"double(size(filter(array({', '.join(map(fb.sql, b))}), v -> v <= {x})))"
        if any(v == 0 and not fb.is_negative(v) for v in b):
            i += f" - double({x} = 0D AND string({x}) = '-0.0')"
        return f"({i})"

    def lower_bound(self, i: int) -> float:
        return -fb.INF if i <= 0 else self.boundaries[min(i, len(self.boundaries)) - 1]

    def upper_bound(self, i: int) -> float:
        if i >= len(self.boundaries):
            return fb.INF
        return fb.ordered_to_double(self._order[max(i, 0)] - 1)

    def bounds_sql(self, i: str) -> tuple[str, str]:
        b = ", ".join(map(fb.sql, [-fb.INF, *self.boundaries]))
        e = ", ".join(fb.sql(self.upper_bound(n)) for n in range(len(self.boundaries) + 1))
        at = f"least(greatest({i}, 0), {len(self.boundaries)})"
        return f"get(array({b}), {at})", f"get(array({e}), {at})"

    @cached_property
    def _frozen(self) -> tuple:
        return tuple(self._order)

    def _key(self) -> tuple:
        return self._frozen

    def __repr__(self) -> str:
        return f"{type(self).__name__} [sortedBinBoundaries={list(self.boundaries)}]"
