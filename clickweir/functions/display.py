"""Text for people: local times, amounts, percentages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .ratios import round_exact

# The dashboard's zone and the place shown with long labels.
ZONE = "America/New_York"
PLACE = "Charlotte, NC"


def local_time(ts: Column, zone: str = ZONE) -> Column:
    """Naive UTC time to local time."""
    return F.from_utc_timestamp(ts.cast("timestamp"), zone)


def clock_label(ts: Column, zone: str = ZONE) -> Column:
    return F.concat(F.date_format(local_time(ts, zone), "h:mm:ss a"), F.lit(" ET"))


def clock_label_with_place(ts: Column, zone: str = ZONE, place: str = PLACE) -> Column:
    return F.concat(F.date_format(local_time(ts, zone), "hh:mm:ss a"), F.lit(f" ET ({place})"))


def date_time_label(ts: Column, zone: str = ZONE) -> Column:
    return F.concat(F.date_format(local_time(ts, zone), "MMM d, hh:mm a"), F.lit(" ET"))


def chart_label(ts: Column, zone: str = ZONE) -> Column:
    return F.date_format(local_time(ts, zone), "h:mm a")


def daylight_label(ts: Column, zone: str = ZONE) -> Column:
    """EDT while the zone is four hours behind UTC, else EST."""
    behind = F.unix_timestamp(ts.cast("timestamp")) - F.unix_timestamp(local_time(ts, zone))
    return F.when(behind == 4 * 3600, F.lit("EDT")).otherwise(F.lit("EST"))


def zone_label(ts: Column, zone: str = ZONE, place: str = PLACE) -> Column:
    """Abbreviation, its long name and the place."""
    short = daylight_label(ts, zone)
    season = F.when(short == "EDT", F.lit("Daylight")).otherwise(F.lit("Standard"))
    return F.concat(short, F.lit(" (Eastern "), season, F.lit(f" Time) - {place}"))


def thousands(value: Column) -> Column:
    return F.format_number(F.coalesce(value, F.lit(0)).cast("bigint"), 0)


def currency(value: Column) -> Column:
    """Whole dollars with thousands separators, the sign before the dollar."""
    whole = round_exact(F.coalesce(value.cast("double"), F.lit(0.0)), 0, ties="away").cast("bigint")
    return F.concat(F.when(whole < 0, F.lit("-$")).otherwise(F.lit("$")), F.format_number(F.abs(whole), 0))


def signed_percent(value: Column) -> Column:
    number = F.coalesce(value.cast("double"), F.lit(0.0))
    return F.concat(
        F.when(number >= 0, F.lit("+")).otherwise(F.lit("")),
        F.format_string("%.1f%%", round_exact(number, 1, ties="away")),
    )


def fixed(value: Column, digits: int, signed: bool = False) -> Column:
    """Text with a fixed number of decimals, rounded on the exact value with ties to even."""
    return F.format_string(f"%{'+' if signed else ''}.{digits}f", round_exact(value, digits))


def place_label(city: Column, country: Column) -> Column:
    return F.concat_ws(", ", city, country)
