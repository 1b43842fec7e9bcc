"""Doubles as ordered integers, monotone searches, and exponent/mantissa columns."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable

INT_MAX = 2**31 - 1
INT_MIN = -(2**31)
MIN_NORMAL = 2.2250738585072014e-308
MIN_VALUE = 5e-324
MAX_VALUE = 1.7976931348623157e308
INF = float("inf")


def double_to_ordered(x: float) -> int:
    """An integer that sorts like the double, with -0.0 just below 0.0."""
    bits = struct.unpack(">q", struct.pack(">d", x))[0]
    return bits if bits >= 0 else bits ^ 0x7FFFFFFFFFFFFFFF


def ordered_to_double(n: int) -> float:
    bits = n if n >= 0 else n ^ 0x7FFFFFFFFFFFFFFF
    return struct.unpack(">d", struct.pack(">q", bits))[0]


def is_negative(x: float) -> bool:
    """By the sign bit, so true for -0.0."""
    return math.copysign(1.0, x) < 0


def midpoint(a: int, b: int) -> int:
    """The mean of two integers, rounded down."""
    return (a + b) // 2


def clip(x: int, lo: int, hi: int) -> int:
    """`x` limited to [lo, hi]; ValueError if it lies outside an empty range."""
    if lo <= x <= hi:
        return x
    if lo > hi:
        raise ValueError("the lower limit exceeds the upper one")
    return lo if x < lo else hi


def find_first(test: Callable[[int], bool], lo: int, hi: int, guess: int | None = None) -> int:
    """The smallest n in [lo, hi] for which the monotone `test` holds.

    From `guess` the search gallops outwards before it bisects.  ValueError
    if the range is empty or the test fails at its end.
    """
    if lo > hi:
        raise ValueError("the range is empty")
    if guess is not None:
        guess = min(max(guess, lo), hi)
        step = 1
        if test(guess):
            hi = guess
            while hi > lo and test(max(lo, hi - step)):
                hi = max(lo, hi - step)
                step *= 2
            lo = max(lo, hi - step)
        else:
            lo = guess
            while lo < hi and not test(min(hi, lo + step)):
                lo = min(hi, lo + step)
                step *= 2
            hi = min(hi, lo + step)
    if not test(hi):
        raise ValueError("the test holds nowhere in the range")
    while lo < hi:
        mid = midpoint(lo, hi)
        if test(mid):
            hi = mid
        else:
            lo = mid + 1
    return hi


def truncated(x: float) -> int:
    """A double as a 32-bit integer: toward zero, saturating, NaN as 0."""
    if x != x:
        return 0
    if x >= INT_MAX:
        return INT_MAX
    if x <= INT_MIN:
        return INT_MIN
    return int(x)


def parts(u: float) -> tuple[float, int]:
    """(mantissa in [1, 2), biased exponent) as in the bits of a non-negative double."""
    bits = struct.unpack(">q", struct.pack(">d", u))[0]
    return 1.0 + (bits & 0xFFFFFFFFFFFFF) / 4503599627370496.0, bits >> 52


def sql(x: float) -> str:
    """A double in Spark SQL."""
    return f"double('{x!r}')"


def exponent(u: str) -> str:
    """floor(log2(u)) of a normal finite positive double, in SQL; exact where log2 isn't.

    Without conditions, so that generated code evaluates each repeated part once.
    """
    e = f"double(floor(log2({u})))"
    return f"({e} - double(power(2D, {e}) > {u}) + double(power(2D, {e} + 1D) <= {u}))"


def negative(x: str) -> str:
    """The sign bit of a double, in SQL."""
    return f"({x} < 0D OR ({x} = 0D AND string({x}) = '-0.0'))"
