"""Counts and trends of delimited tokens (FN-01/02, JON-01/02, AGG-02/03/12/13/26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import dates, numbers
from ..functions.text import normalised_tokens, strip_punctuation
from ..session import BROADCAST_ROWS, broadcast_if_small, materialise
from .clean import quoted
from .ranking import ranked, top


def synonym_frame(spark, mapping: dict[str, str]) -> DataFrame:
    """The alias table of one domain. It is configuration, so its size is known here."""
    rows = spark.createDataFrame(list(mapping.items()), "alias string, canonical string")
    return F.broadcast(rows) if len(mapping) <= BROADCAST_ROWS else rows


def with_canonical(df: DataFrame, token: str, synonyms: dict[str, str] | None) -> DataFrame:
    """Replace ``token`` by its canonical form; a token without one stays (JON-01)."""
    if not synonyms:
        return df
    aliases = synonym_frame(df.sparkSession, synonyms)
    joined = df.join(aliases, F.col(token) == F.col("alias"), "left")
    return joined.withColumn(token, F.coalesce("canonical", token)).drop("alias", "canonical")


def explode_tokens(
    df: DataFrame,
    column: str,
    separator: str = ",",
    synonyms: dict[str, str] | None = None,
    keep: dict[str, Column] | None = None,
    lookup_before_strip: bool = False,
) -> DataFrame:
    """One row per normalised token, with the ``keep`` columns of its record.

    ``lookup_before_strip`` also looks the token up with its punctuation on, which
    makes aliases like ``c++`` reachable.
    """
    keep = {n: c.alias(n) for n, c in (keep or {}).items()}
    tokens = normalised_tokens(quoted(column), separator, punctuation=not lookup_before_strip)
    rows = df.select(*keep.values(), F.explode(tokens).alias("token"))
    if lookup_before_strip:
        typed = with_canonical(rows.withColumn("_typed", F.col("token")), "token", synonyms)
        stripped = F.when(F.col("token") == F.col("_typed"), strip_punctuation(F.col("token")))
        rows = typed.withColumn("token", F.coalesce(stripped, F.col("token"))).drop("_typed")
        rows = rows.filter(F.col("token") != "")
    rows = with_canonical(rows, "token", synonyms)
    # only a synonym can be empty now
    return rows.filter(F.col("token") != "") if synonyms else rows


def distinct_lists(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column of delimited lists, with their number of records as ``_weight``."""
    return df.groupBy(quoted(column).alias(column)).agg(F.count(F.lit(1)).alias("_weight"))


def token_counts(df, column, separator=",", synonyms=None, name="Technology", weighted=True, weight=None, **options) -> DataFrame:
    """Occurrences of each token over all records.

    Lists repeat, so each different one is split and normalised once and counts with its number of
    records. Pass ``weighted=False`` for free text, where hardly a value repeats, and ``weight``, the column
    with the number of records, if ``df`` has been counted already.
    """
    if weighted or weight:
        lists = df.withColumnRenamed(weight, "_weight") if weight else distinct_lists(df, column)
        rows = explode_tokens(lists, column, separator, synonyms, keep={"_weight": F.col("_weight")}, **options)
        return rows.groupBy(F.col("token").alias(name)).agg(F.sum("_weight").alias("Count"))
    rows = explode_tokens(df, column, separator, synonyms, **options)
    return rows.groupBy(F.col("token").alias(name)).agg(F.count(F.lit(1)).alias("Count"))


def top_tokens(
    df: DataFrame,
    column: str = S.BUILT_WITH,
    separator: str = ",",
    synonyms: dict[str, str] | None = None,
    limit: int | None = 50,
    name: str = "Technology",
    **options,
) -> DataFrame:
    """Rank, token, Count and Percentage of **all** tokens (AGG-02/03).

    The total is a scalar subquery over the same aggregate; adaptive execution
    reuses its shuffle, so the records are read and exploded once.
    """
    if column not in df.columns:
        return S.empty(df.sparkSession, *_top_schema(name))
    counts = token_counts(df, column, separator, synonyms, name, **options)
    ordered = ranked(counts, "Count", name, limit)
    # without a limit the ranked table is complete and already written
    total = (ordered if limit is None else counts).agg(F.sum("Count")).scalar()
    return ordered.withColumn("Percentage", numbers.percentage(F.col("Count"), total, nearest=True))


def _top_schema(name):
    from pyspark.sql import types as T

    return [("Rank", T.LongType()), (name, T.StringType()), ("Count", T.LongType()), ("Percentage", T.DoubleType())]


def token_trend(
    df: DataFrame,
    period: str = "monthly",
    top_n: int = 10,
    column: str = S.BUILT_WITH,
    created: str = S.CREATED,
    separator: str = ",",
    synonyms: dict[str, str] | None = None,
    name: str = "Technology",
) -> DataFrame:
    """Count per period of the ``top_n`` tokens overall; no rows for zero counts (AGG-12).

    The different lists are split once for the overall ranking, undated records included, and once
    more for the leaders each of them holds. Records then only look their list up.
    """
    if not S.has_columns(df, column, created):
        from pyspark.sql import types as T

        return S.empty(df.sparkSession, ("Period", T.StringType()), (name, T.StringType()), ("Count", T.LongType()))
    if period not in dates.PERIODS:
        period = "monthly"
    lists = materialise(distinct_lists(df, column))
    held = explode_tokens(lists, column, separator, synonyms, keep={"_list": quoted(column), "_weight": F.col("_weight")})
    overall = held.groupBy(F.col("token").alias(name)).agg(F.sum("_weight").alias("Count"))
    leaders = top(overall, "Count", name, top_n).select(F.col(name).alias("token"))
    leaders = F.broadcast(leaders) if top_n <= BROADCAST_ROWS else leaders
    # a list that names a leader twice keeps both rows
    kept = materialise(held.join(leaders, "token", "left_semi").select("_list", F.col("token").alias(name)))
    label = dates.period_label(dates.as_timestamp(df, created), period)
    dated = df.select(label.alias("Period"), quoted(column).alias("_list")).filter(F.col("Period").isNotNull())
    counts = dated.join(broadcast_if_small(kept), "_list").groupBy("Period", name).agg(F.count(F.lit(1)).alias("Count"))
    return counts.select("Period", name, "Count").orderBy("Period", name)


def uniform_skill_trend(
    registrants: DataFrame,
    submissions: DataFrame,
    period: str = "monthly",
    top_n: int = 10,
    column: str = S.SKILLS,
    created: str = S.CREATED,
    separator: str = ";",
    synonyms: dict[str, str] | None = None,
    name: str = "Skill",
) -> DataFrame:
    """Each top skill spread evenly over the periods of the submissions (AGG-13, JON-09).

    Registrants carry no date, so this is an even split rounded down, not an
    observed series. Every skill gets a row for every period.
    """
    if column not in registrants.columns or created not in submissions.columns:
        from pyspark.sql import types as T

        return S.empty(registrants.sparkSession, ("Period", T.StringType()), (name, T.StringType()), ("Count", T.LongType()))
    if period not in dates.PERIODS:
        period = "monthly"
    moment = dates.as_timestamp(submissions, created)
    span = submissions.agg(F.min(moment).alias("first"), F.max(moment).alias("last"))
    starts = span.select(dates.period_starts(F.col("first"), F.col("last"), period)).scalar()
    leaders = top(token_counts(registrants, column, separator, synonyms, name), "Count", name, top_n)
    spread = leaders.withColumn("_starts", starts).select(
        F.explode("_starts").alias("_start"), name, "Count", F.size("_starts").alias("_periods")
    )
    return spread.select(
        dates.period_label(F.col("_start"), period).alias("Period"),
        name,
        F.floor(F.col("Count") / F.col("_periods")).alias("Count"),
    ).orderBy("Period", name)


def _distinct(trend: DataFrame, column: str) -> list[str]:
    """Values of a column of a trend: at most its leaders, or the periods of the calendar."""
    return sorted(r[0] for r in trend.select(quoted(column)).distinct().collect())


def trend_pivot(trend: DataFrame, values: list[str] | None = None, name: str = "Technology") -> DataFrame:
    """Periods as rows, tokens as columns, 0 where a token is absent (RSH-01).

    The columns are all tokens of the trend, at most its ``top_n``; giving ``values``
    saves the job that looks for them.
    """
    values = _distinct(trend, name) if values is None else values
    return trend.groupBy("Period").pivot(name, values).agg(F.sum("Count")).na.fill(0, values)


def trend_transposed(trend: DataFrame, periods: list[str] | None = None, name: str = "Technology") -> DataFrame:
    """Tokens as rows, all periods of the trend as columns (RSH-02)."""
    periods = _distinct(trend, "Period") if periods is None else periods
    return trend.groupBy(name).pivot("Period", periods).agg(F.sum("Count")).na.fill(0, periods)


def trend_statistics(trend: DataFrame, name: str = "Technology") -> DataFrame:
    """Total, mean per present period and peak of each token (AGG-26)."""
    return (
        trend.groupBy(name)
        .agg(
            F.sum("Count").alias("Total Uses"),
            numbers.round_half_even(F.avg("Count")).alias("Avg per Period"),
            F.max("Count").alias("Peak Usage"),
        )
        .orderBy(F.desc("Total Uses"), name)
    )
