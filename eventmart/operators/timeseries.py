"""Calendar series of submissions and of the event list (AGG-10/14/15/16/22/24..28, WIN-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import dates, numbers
from ..functions.text import fold
from .clean import quoted


def calendar_counts(
    df: DataFrame, created: str = S.CREATED, bucket: str = "daily", name: str = "Submissions", weight: str | None = None
) -> DataFrame:
    """Rows per day, week or month with a running total (AGG-10, WIN-01).

    The running total is a window without partitions, over the aggregated series:
    at most one row per calendar day, whatever the number of records. ``weight`` is the
    column with the number of records of a row, if ``df`` has been counted already.
    """
    if created not in df.columns:
        return S.empty(df.sparkSession, ("Date", T.DateType()), (name, T.LongType()), ("Cumulative", T.LongType()))
    moment = dates.as_timestamp(df, created)
    records = F.lit(1).cast("long") if weight is None else F.col(weight)
    days = df.select(dates.bucket_start(moment, bucket).alias("Date"), records.alias("_records")).filter(F.col("Date").isNotNull())
    series = days.groupBy("Date").agg(F.sum("_records").alias(name))
    running = Window.orderBy("Date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return series.withColumn("Cumulative", F.sum(name).over(running)).orderBy("Date")


def _sum(name: str):
    return F.coalesce(F.sum(quoted(name)), F.lit(0))


def event_trend(df: DataFrame, period: str = "monthly") -> DataFrame:
    """Events, participants, submissions and organizers per period (AGG-14)."""
    if period not in dates.PERIODS:
        raise ValueError(f"period must be one of {', '.join(dates.PERIODS)}, not {period!r}")
    label = dates.period_label(dates.as_timestamp(df, S.SRC_DATE), period)
    return (
        df.withColumn("Period", label)
        .filter(F.col("Period").isNotNull())
        .groupBy("Period")
        .agg(
            F.count(quoted(S.SRC_NAME)).alias("Hackathon Count"),
            _sum(S.SRC_PARTICIPANTS).alias("Total Participants"),
            _sum(S.SRC_SUBMISSIONS).alias("Total Submissions"),
            F.count_distinct(quoted(S.SRC_ORG)).alias("Unique Organizers"),
        )
        .orderBy("Period")
    )


def seasonal_patterns(df: DataFrame) -> DataFrame:
    """Events and mean sizes per calendar month over all years (AGG-15)."""
    month = F.month(dates.as_timestamp(df, S.SRC_DATE))
    return (
        df.withColumn("Month", month)
        .filter(F.col("Month").isNotNull())
        .groupBy("Month")
        .agg(
            F.count(quoted(S.SRC_NAME)).alias("Hackathon Count"),
            F.avg(quoted(S.SRC_PARTICIPANTS)).alias("Avg Participants"),
            F.avg(quoted(S.SRC_SUBMISSIONS)).alias("Avg Submissions"),
        )
        .withColumn("Month Name", dates.month_name(F.col("Month")))
        .orderBy("Month")
    )


def seasonal_insights(seasonal: DataFrame) -> DataFrame:
    """Busiest and slowest month (the earlier on ties) and the mean per month (WIN-05)."""
    count, month = F.col("Hackathon Count"), F.col("Month")
    return seasonal.agg(
        F.max_by("Month Name", F.struct(count, -month)).alias("peak_month"),
        F.max(count).alias("peak_count"),
        F.min_by("Month Name", F.struct(count, month)).alias("low_month"),
        F.min(count).alias("low_count"),
        numbers.round_half_even(F.avg(count), 1).alias("avg_per_month"),
    )


def year_over_year(df: DataFrame) -> DataFrame:
    """Yearly figures and their change against the previous year present (AGG-16, WIN-02).

    The window is over one row per year.
    """
    year = F.year(dates.as_timestamp(df, S.SRC_DATE))
    yearly = (
        df.withColumn("Year", year)
        .filter(F.col("Year").isNotNull())
        .groupBy("Year")
        .agg(
            F.count(quoted(S.SRC_NAME)).alias("Hackathon Count"),
            _sum(S.SRC_PARTICIPANTS).alias("Total Participants"),
            F.avg(quoted(S.SRC_PARTICIPANTS)).alias("Avg Participants per Hackathon"),
            _sum(S.SRC_SUBMISSIONS).alias("Total Submissions"),
            F.avg(quoted(S.SRC_SUBMISSIONS)).alias("Avg Submissions per Hackathon"),
            F.count_distinct(quoted(S.SRC_ORG)).alias("Unique Organizers"),
        )
    )
    years = Window.orderBy("Year")

    def change(metric):
        return numbers.growth(F.col(metric), F.lag(metric).over(years))

    return yearly.withColumns({
        "Hackathon Growth %": change("Hackathon Count"),
        "Participant Growth %": change("Total Participants"),
        "Submission Growth %": change("Total Submissions"),
    }).orderBy("Year")


def latest_year(yearly: DataFrame) -> DataFrame:
    """The row of the last year, as shown in the headline figures (WIN-04)."""
    return yearly.orderBy(F.desc("Year")).limit(1)


def rounded_for_display(df: DataFrame, columns, digits: int = 1) -> DataFrame:
    """Means and growth figures rounded half to even for a table (FN-16)."""
    return df.withColumns({c: numbers.round_half_even(quoted(c), digits) for c in columns})


def date_span(df: DataFrame, column: str = S.SRC_DATE) -> DataFrame:
    """First and last date; NULL for an empty table (AGG-22)."""
    moment = dates.as_timestamp(df, column)
    return df.agg(F.min(moment).alias("first_date"), F.max(moment).alias("last_date"))


def event_totals(df: DataFrame, organizers: bool = True) -> DataFrame:
    """Events, participants, submissions and (raw) organizer names (AGG-24, 28)."""
    figures = [
        F.count(F.lit(1)).alias("Hackathons"),
        _sum(S.SRC_PARTICIPANTS).alias("Total Participants"),
        _sum(S.SRC_SUBMISSIONS).alias("Total Submissions"),
    ]
    if organizers:
        figures.append(F.count_distinct(quoted(S.SRC_ORG)).alias("Unique Organizers"))
    return df.agg(*figures)


def top_organizers(df: DataFrame, limit: int = 10, canonical: bool = False) -> DataFrame:
    """Organizers by number of events (AGG-25).

    Groups by the spelling in the list, or by the folded name with ``canonical``.
    """
    key = fold(quoted(S.SRC_ORG)) if canonical else quoted(S.SRC_ORG)
    return (
        df.withColumn("Organizer", key)
        .filter(F.col("Organizer").isNotNull())
        .groupBy("Organizer")
        .agg(
            F.count(quoted(S.SRC_NAME)).alias("Hackathons"),
            _sum(S.SRC_PARTICIPANTS).alias("Total Participants"),
            _sum(S.SRC_SUBMISSIONS).alias("Total Submissions"),
        )
        .orderBy(F.desc("Hackathons"), "Organizer")
        .limit(limit)
    )
