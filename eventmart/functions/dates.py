"""Calendar expressions. Timestamps are zone-less and hold UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Forms of a day, rewritten to year-month-day before they are read.
_DAYS = [
    (r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?!\d)", "$1-$2-$3"),
    (r"^(\d{4})(\d{2})(\d{2})(?=$|\s)", "$1-$2-$3"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})(?!\d)", "$3-$1-$2"),
    (r"^([A-Z][a-z]{2})[a-z]*\.? (\d{1,2}),? (\d{4})(?!\d)", "$3-$1-$2"),
    (r"^(\d{1,2})[- ]([A-Z][a-z]{2})[a-z]*[- ](\d{4})(?!\d)", "$3-$2-$1"),
]
# Patterns tried in order after ISO 8601; extend per call for other exports.
DATE_FORMATS = [day + time for day in ("yyyy-M-d", "yyyy-MMM-d") for time in ("", " H:mm", " H:mm:ss", " h:mm a", " h:mm:ss a")]
# A weekday in front and a zone behind, as mail headers have them.
_WEEKDAY = r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+(?=\d)"
_ZONE_NAME = r"(?i)\s*\b(?:GMT|UTC|Z)$"
_HALF = r"(?i)(\d) ?([ap])\.?m\.?$"

_ZONE = r"(?i)[T ]\d{1,2}:\d{2}.*(Z|UTC|GMT|[+-]\d{2}(:?\d{2})?)$"


def to_utc_timestamp(c: Column, formats=DATE_FORMATS) -> Column:
    """Text to a zone-less UTC timestamp, NULL where no pattern fits (CLN-06).

    Values with an offset are moved to UTC, values without one are taken as UTC.
    The result does not depend on the session time zone.
    """
    text = F.regexp_replace(F.trim(c), _WEEKDAY, "")
    zoned = F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), text.try_cast("timestamp").cast("timestamp_ntz")
    )
    bare = F.regexp_replace(F.regexp_replace(text, _ZONE_NAME, ""), r"\s+", " ")
    for form, ordered in _DAYS:
        bare = F.regexp_replace(bare, form, ordered)
    half = F.upper(F.regexp_extract(bare, _HALF, 2))
    bare = F.when(half != "", F.concat(F.regexp_replace(bare, _HALF, "$1 "), half, F.lit("M"))).otherwise(bare)

    def first_fit(value: Column) -> Column:
        return F.coalesce(value.try_cast("timestamp_ntz"), *[F.try_to_timestamp(value, F.lit(f)).cast("timestamp_ntz") for f in formats])

    # through an array, so that the rewritten text is worked out once for all patterns
    plain = F.get(F.transform(F.array(bare), first_fit), F.lit(0))
    return F.coalesce(F.when(text.rlike(_ZONE), zoned), plain)


def as_timestamp(df, name: str, formats=DATE_FORMATS) -> Column:
    """Column ``name`` as a zone-less timestamp whatever type it is stored in."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.col(f"`{name}`")
    if isinstance(kind, T.TimestampType):
        local = F.col(f"`{name}`").cast("timestamp_ntz")
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)
    if isinstance(kind, T.DateType):
        return F.col(f"`{name}`").cast("timestamp_ntz")
    return to_utc_timestamp(F.col(f"`{name}`"), formats)


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def quarter_label(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))


def year_label(ts: Column) -> Column:
    return F.year(ts).cast("string")


# period name -> (label, truncation unit, months in the period)
PERIODS = {
    "monthly": (month_label, "month", 1),
    "quarterly": (quarter_label, "quarter", 3),
    "yearly": (year_label, "year", 12),
}

# bucket name -> truncation unit; weeks start on Monday
BUCKETS = {"daily": "day", "weekly": "week", "monthly": "month"}


def period_label(ts: Column, period: str) -> Column:
    return PERIODS[period][0](ts)


def bucket_start(ts: Column, bucket: str) -> Column:
    """First day of the day, week or month; an unknown bucket means day (FN-12)."""
    return F.trunc(ts.cast("date"), BUCKETS.get(bucket, "day")) if bucket in ("weekly", "monthly") else ts.cast("date")


def period_starts(first: Column, last: Column, period: str) -> Column:
    """Array of the period start dates from ``first`` to ``last`` (FN-13)."""
    _, unit, months = PERIODS[period]
    return F.sequence(
        F.trunc(first.cast("date"), unit), F.trunc(last.cast("date"), unit), F.make_ym_interval(F.lit(0), F.lit(months))
    )


def month_name(month: Column) -> Column:
    """1..12 to the English month name (FN-14)."""
    return F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMMM")


def stamp(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text of a timestamp (FN-18)."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
