"""Distributions, histograms, group statistics and the overall summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import numbers
from .clean import quoted
from .counted import WEIGHT, registrant_sets, submission_sets
from .ranking import top
from .tokens import top_tokens

# Experience ranges, open at the lower and closed at the upper end.
EXPERIENCE_BINS = [0, 2, 5, 10, 50]
EXPERIENCE_LABELS = ["0-2 years", "3-5 years", "6-10 years", "10+ years"]


def value_distribution(
    df: DataFrame,
    column: str,
    name: str | None = None,
    limit: int | None = None,
    by_value: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Count and share of each value (AGG-05..08).

    Shares are of all rows with a value, also when ``limit`` cuts the list. The
    empty text is a value, NULL is not. ``by_value`` orders by the value itself.
    ``weight`` is the column with the number of records of a row, if ``df`` has been counted already.
    """
    name = name or column
    if column not in df.columns:
        return S.empty(df.sparkSession, (name, T.StringType()), ("Count", T.LongType()), ("Percentage", T.DoubleType()))
    present = df.filter(quoted(column).isNotNull())
    records = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = present.groupBy(quoted(column).alias(name)).agg(records.alias("Count"))
    total = counts.agg(F.sum("Count")).scalar()
    if by_value:
        ordered = counts.orderBy(quoted(name))
        ordered = ordered if limit is None else ordered.limit(limit)
    else:
        ordered = top(counts, "Count", name, limit)
    return ordered.withColumn("Percentage", numbers.percentage(F.col("Count"), total))


def team_size_distribution(df: DataFrame, column: str = S.EXTRA_MEMBERS, weight: str | None = None) -> DataFrame:
    """Team sizes in ascending order (CLN-11, AGG-05)."""
    if column not in df.columns:
        return S.empty(df.sparkSession, ("Team Size", T.LongType()), ("Count", T.LongType()), ("Percentage", T.DoubleType()))
    sized = df.select(numbers.team_size(quoted(column)).alias("Team Size"), *([weight] if weight else []))
    return value_distribution(sized, "Team Size", by_value=True, weight=weight)


def binned_histogram(
    df: DataFrame,
    column: str = S.EXPERIENCE,
    edges=EXPERIENCE_BINS,
    labels=EXPERIENCE_LABELS,
    name: str = "Experience Range",
    include_lowest: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Rows per range, every range present, in range order (AGG-09).

    One pass counts all ranges side by side, and the single result row is turned
    into one row per range: no shuffle of the data, no join with the ranges.
    """
    if column not in df.columns:
        return S.empty(df.sparkSession, (name, T.StringType()), ("Count", T.LongType()), ("Percentage", T.DoubleType()))
    value = numbers.to_double(quoted(column))
    counts = []
    for position, (low, high) in enumerate(zip(edges, edges[1:])):
        above = value >= low if include_lowest and position == 0 else value > low
        inside = F.when(above & (value <= high), F.lit(1).cast("long") if weight is None else F.col(weight))
        counts.append(F.coalesce(F.sum(inside), F.lit(0)).alias(f"n{position}"))
    wide = df.agg(*counts)
    ranges = F.array(*[
        F.struct(F.lit(p).alias("p"), F.lit(label).alias("label"), F.col(f"n{p}").alias("n"))
        for p, label in enumerate(labels)
    ])
    total = sum((F.col(f"n{p}") for p in range(1, len(labels))), F.col("n0"))
    rows = wide.select(total.alias("total"), F.explode(ranges).alias("r"))
    return rows.orderBy("r.p").select(
        F.col("r.label").alias(name),
        F.col("r.n").alias("Count"),
        numbers.percentage(F.col("r.n"), F.col("total")).alias("Percentage"),
    )


def group_statistics(
    df: DataFrame,
    key: str = S.TITLE,
    counted: str = S.PROJECT,
    distinct: str = S.ORG,
    names=("Hackathon", "Submissions", "Organizations"),
    weight: str | None = None,
) -> DataFrame:
    """Rows and distinct values per group, largest first (AGG-04).

    ``weight`` is the column with the number of ``counted`` values of a row, if ``df`` has been counted already.
    """
    if key not in df.columns:
        return S.empty(df.sparkSession, (names[0], T.StringType()), (names[1], T.LongType()), (names[2], T.LongType()))
    return top(
        df.filter(quoted(key).isNotNull())
        .groupBy(quoted(key).alias(names[0]))
        .agg((F.count(quoted(counted)) if weight is None else F.sum(weight)).alias(names[1]), F.count_distinct(quoted(distinct)).alias(names[2])),
        names[1],
        names[0],
    )


def summary_statistics(
    submissions: DataFrame, registrants: DataFrame, technologies=None, skills=None
) -> DataFrame:
    """The overall figures as one row (AGG-11); the records of each kind are read once."""
    return summary_of(submission_sets(submissions), registrant_sets(registrants), technologies, skills)


def summary_of(subs: dict[str, DataFrame], people: dict[str, DataFrame], technologies=None, skills=None) -> DataFrame:
    """The overall figures from the counted sets of both kinds.

    All figures but the first three are scalar subqueries over small written tables, so
    nothing is collected and no table is joined.
    """
    events, days, teams = subs["events"], subs["days"], subs["teams"]

    total = F.coalesce(F.sum(WEIGHT), F.lit(0))

    def distinct(name):
        return F.count_distinct(quoted(name)) if name in events.columns else F.lit(0).cast("long")

    def day(pick):
        if S.CREATED not in days.columns:
            return F.lit(None).cast("string")
        return days.agg(F.date_format(pick(quoted(S.CREATED)), "yyyy-MM-dd")).scalar()

    mean = F.lit(0.0)
    if S.EXTRA_MEMBERS in teams.columns:
        members = F.sum(numbers.team_size(quoted(S.EXTRA_MEMBERS)) * F.col(WEIGHT)).cast("double")
        mean = F.coalesce(teams.agg(numbers.round_half_even(F.try_divide(members, F.sum(WEIGHT)))).scalar(), mean)
    top_technology = top_tokens(subs["lists"], S.BUILT_WITH, ",", technologies, 1, "Technology", weight=WEIGHT)
    top_skill = top_tokens(people[S.SKILLS], S.SKILLS, ";", skills, 1, "Skill", weight=WEIGHT)
    top_country = value_distribution(people[S.COUNTRY], S.COUNTRY, limit=1, weight=WEIGHT)
    figures = events.agg(
        total.alias("total_submissions"), distinct(S.TITLE).alias("unique_hackathons"), distinct(S.ORG).alias("unique_organizations")
    )
    return figures.select(
        "total_submissions",
        people[S.COUNTRY].agg(total).scalar().alias("total_registrants"),
        "unique_hackathons",
        "unique_organizations",
        day(F.min).alias("date_start"),
        day(F.max).alias("date_end"),
        top_technology.select("Technology").scalar().alias("most_popular_technology"),
        top_skill.select("Skill").scalar().alias("most_popular_skill"),
        top_country.select(quoted(S.COUNTRY)).scalar().alias("top_country"),
        mean.alias("avg_team_size"),
    )


# Labels of the summary listing, in report order.
SUMMARY_LABELS = {
    "total_submissions": "Total Submissions",
    "total_registrants": "Total Registrants",
    "unique_hackathons": "Unique Hackathons",
    "unique_organizations": "Unique Organizations",
    "date_start": "Date Range Start",
    "date_end": "Date Range End",
    "most_popular_technology": "Most Popular Technology",
    "most_popular_skill": "Most Popular Skill",
    "top_country": "Top Country",
    "avg_team_size": "Average Team Size",
}


def summary_listing(summary: DataFrame, fields=None) -> DataFrame:
    """The summary row as (Metric, Value) rows, values as text (RSH-04)."""
    fields = fields or list(SUMMARY_LABELS)
    cells = [
        F.struct(F.lit(SUMMARY_LABELS[f]).alias("Metric"), F.col(f).cast("string").alias("Value"))
        for f in fields
    ]
    return summary.select(F.inline(F.array(*cells)))
