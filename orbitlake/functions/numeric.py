"""Scalar building blocks, all plain Column expressions (whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_even(value: Column, digits: int) -> Column:
    """Round half to even at ``digits`` decimals, in double arithmetic."""
    scale = float(10 ** digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def round_js(value: Column) -> Column:
    """Round halves upwards (towards plus infinity) to an INT."""
    return F.floor(value + F.lit(0.5)).cast("int")


def clip(value: Column, low: float, high: float | None) -> Column:
    """Limit to [low, high]; NULL stays NULL."""
    floored = F.greatest(value, F.lit(float(low)))
    bounded = floored if high is None else F.least(floored, F.lit(float(high)))
    return F.when(value.isNotNull(), bounded)


def finite(value: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def number(text: Column) -> Column:
    """Text to a finite double, NULL when it is not a number."""
    return finite(F.trim(text).try_cast("double"))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def smoothstep(edge0: float | Column, edge1: float | Column, value: Column) -> Column:
    lo = edge0 if isinstance(edge0, Column) else F.lit(float(edge0))
    hi = edge1 if isinstance(edge1, Column) else F.lit(float(edge1))
    t = clip((value - lo) / (hi - lo), 0.0, 1.0)
    return t * t * (F.lit(3.0) - F.lit(2.0) * t)


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r.cast("int"), g.cast("int"), b.cast("int"))


def cloud_class(percent: Column) -> Column:
    """Traffic-light class of a scene's cloud cover; a missing figure counts as clear."""
    value = F.coalesce(percent, F.lit(0.0))
    return F.when(value < 10, "clear").when(value < 30, "some").otherwise("cloudy")


def micros(when: Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ read as UTC."""
    return F.unix_micros(when.cast("timestamp"))
