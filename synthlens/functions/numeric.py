"""Numeric column expressions shared by the operators.

All of these are plain Catalyst expressions, so they stay inside
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite_or_null(c: Column) -> Column:
    """NaN and +/-infinity become NULL; NaN must not travel (it is the
    largest value in Spark and poisons max/avg)."""
    return F.when(F.isnan(c) | (c == F.lit(INF)) | (c == F.lit(-INF)), F.lit(None)).otherwise(c)


def to_double(c: Column) -> Column:
    """Lenient numeric read: text or number to DOUBLE, bad text to NULL,
    non-finite to NULL."""
    return finite_or_null(c.try_cast("double"))


def ratio(num: Column, den: Column) -> Column:
    """Division with NULL for a zero denominator (ANSI-safe)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_or_zero(num: Column, den: Column) -> Column:
    """Division where a zero denominator yields 0.0 (metric convention)."""
    return F.coalesce(ratio(num, den), F.lit(0.0))


def hist_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based fixed-width bin of ``x`` in [lo, hi] with the last bin closed.

    Equal to the edge-corrected rule of ``numpy.histogram``: a first guess
    from the scaled offset, then one step down if ``x`` lies below the left
    edge of the guess, one step up if it reaches the right edge (never past
    the last bin). Edges are ``k * ((hi - lo) / bins) + lo``, the last edge
    is ``hi`` itself.
    """
    width = (hi - lo) / F.lit(float(bins))
    fl = F.floor((x - lo) / (hi - lo) * F.lit(float(bins))).cast("int")
    # min(bins - 1, fl) without least(), which would skip a NULL (constant range)
    b0 = fl - (fl >= bins).cast("int")
    left = b0.cast("double") * width + lo
    right = F.when(b0 + 1 == bins, hi).otherwise((b0 + 1).cast("double") * width + lo)
    down = F.when(x < left, 1).otherwise(0)
    up = F.when((b0 < bins - 1) & (x >= right), 1).otherwise(0)
    return (b0 - down + up).cast("int")


def bin_edge(k: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Left edge of bin ``k`` (``hi`` for k == bins)."""
    return F.when(k == bins, hi).otherwise(k.cast("double") * ((hi - lo) / F.lit(float(bins))) + lo)


def md5_unit(key: Column, part: int = 0) -> Column:
    """A uniform draw in (0, 1) from 32 bits of ``md5(key)``.

    ``part`` picks which 8 hex digits are used; the same text gives the same
    draw on any partitioning, any engine.
    """
    h = F.substring(F.md5(key), 1 + 8 * part, 8)
    return (F.conv(h, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def md5_normal(key: Column) -> Column:
    """Standard normal draw by Box-Muller on two 32-bit parts of md5(key)."""
    u1 = md5_unit(key, 0)
    u2 = md5_unit(key, 1)
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def greatest_of(cols) -> Column:
    """``greatest`` of one or more columns."""
    cols = list(cols)
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def minmax_100(x: Column, lo: Column, hi: Column) -> Column:
    """Scale to 0-100 by a given range; a constant range divides by 1."""
    denom = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    return F.lit(100.0) * (x - lo) / denom


def round_binary(c: Column, places: int) -> Column:
    """Round half away from zero on the binary value: ``round(c * 10^p) /
    10^p``. Spark's ``round`` works on the decimal text of a double, which
    differs at exact decimal ties; this form gives the same double as C
    ``round``-based engines."""
    m = F.lit(float(10 ** places))
    return F.round(c * m, 0) / m
