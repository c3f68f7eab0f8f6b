"""Guarded ratios, percentages and rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def safe_ratio(numerator: Column, denominator: Column, empty: float | None = 0.0) -> Column:
    """``numerator / denominator``, or `empty` where the denominator is zero or either side is null."""
    ratio = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return ratio if empty is None else F.coalesce(ratio, F.lit(float(empty)))


def percent(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    return safe_ratio(part, whole, empty) * 100


def shortfall_percent(part: Column, whole: Column) -> Column:
    """Share of `whole` that did not become `part`; negative when `part` is larger, 0 when `whole` is 0."""
    return F.when(whole > 0, (1 - safe_ratio(part, whole, None)) * 100).otherwise(F.lit(0.0))


def percent_change(current: Column, previous: Column) -> Column:
    """Relative change in percent; 0 unless `previous` is positive."""
    change = safe_ratio(current.cast("double") - previous.cast("double"), previous, None) * 100
    return F.when(previous > 0, change).otherwise(F.lit(0.0))


def round_exact(value: Column, digits: int, ties: str = "even") -> Column:
    """Round the double's exact binary value, as Python's ``round`` and C's ``printf`` do.

    Spark's ``round`` works on the shortest decimal text instead, so it gives 2.68 for 2.675, which is
    stored slightly below the tie. Only a scaled value that looks like a tie needs more care: the
    rounding error of the scaling, found by splitting the value into two halves that scale exactly,
    tells on which side it lies.  ``ties="away"`` moves true ties away from zero, the display rule of
    browsers.
    """
    return _round_exact(value.cast("double"), float(10 ** digits), ties)


def _round_exact(value: Column, scale: float, ties: str) -> Column:
    scaled = value * scale
    high = value * 134217729.0 - (value * 134217729.0 - value)   # 2**27 + 1
    error = (high * scale - scaled) + (value - high) * scale
    down, up = F.floor(scaled).cast("double"), F.ceil(scaled).cast("double")
    tie = F.rint(scaled) if ties == "even" else F.when(value < 0, down).otherwise(up)
    rounded = (
        F.when(scaled - down != 0.5, F.rint(scaled))
        .when(error > 0, up)
        .when(error < 0, down)
        .otherwise(tie)
    )
    # Beyond 2**52 a double has no fraction left to round.
    return F.when(F.abs(scaled) < 4503599627370496.0, rounded / scale).otherwise(value)
