"""Row filters (FLT-*)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import contains_folded
from .clean import quoted


def _moment(value):
    """Literal zone-less timestamp from an ISO text, date or datetime."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    elif isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def exact_else_folded(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows equal to ``value``; only if there are none, rows equal ignoring case (FLT-01).

    The better of the two tiers is a scalar subquery, so no job runs between them.
    """
    cell = quoted(column)
    tier = F.when(cell == value, 1).when(F.lower(cell) == value.lower(), 2)
    best = df.agg(F.min(tier)).scalar()
    return df.filter(F.lower(cell) == value.lower()).filter(tier == best)


def date_range(df, start=None, end=None, column: str = S.SRC_DATE, end_of_day: bool = False) -> DataFrame:
    """Rows between two moments, both optional and inclusive (FLT-03).

    A plain end date means its midnight; ``end_of_day`` includes that whole day.
    The column is compared unwrapped, so the bounds reach the Parquet scan.
    """
    if start is not None:
        df = df.filter(quoted(column) >= _moment(start))
    if end is not None:
        bound = _moment(end)
        if end_of_day:
            df = df.filter(quoted(column) < bound + F.expr("interval 1 day"))
        else:
            df = df.filter(quoted(column) <= bound)
    return df


def in_year(df: DataFrame, year: int, column: str = S.SRC_DATE) -> DataFrame:
    """Rows of one calendar year, as a range so that it is pushed down (FLT-04)."""
    first, following = _moment(dt.date(year, 1, 1)), _moment(dt.date(year + 1, 1, 1))
    return df.filter((quoted(column) >= first) & (quoted(column) < following))


def history(df: DataFrame, statuses=None, kinds=None, search: str | None = None, regex: bool = False) -> DataFrame:
    """Ledger rows by status, type and file name; each part only if given (FLT-06).

    ``search`` is text found in any case, or with ``regex`` a regular expression in any case.
    """
    if statuses:
        df = df.filter(F.col("status").isin(*statuses))
    if kinds:
        df = df.filter(F.col("file_type").isin(*kinds))
    if search:
        name = F.col("file_name")
        df = df.filter(name.rlike(f"(?i){search}") if regex else contains_folded(name, F.lit(search)))
    return df


def name_in(df: DataFrame, names: DataFrame, column: str, name: str) -> DataFrame:
    """Rows whose value is in a one-column table of names (FLT-02)."""
    wanted = names.select(quoted(name).alias("_name")).distinct()
    return df.join(wanted, quoted(column) == F.col("_name"), "left_semi")
