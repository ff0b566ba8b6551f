"""Records counted once for many tables: one job over the records gives the counts of several sets of columns.

The tables of a report ask for counts of a few columns each. ``counted_sets`` groups by all these sets in one
pass (grouping sets, so counts are combined in the tasks that read the records) and writes the result, one
folder per set. Every table is then an aggregate over its set, whose size is that of the distinct
values, not of the records; functions that count take the column ``WEIGHT`` as the number of records of a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import dates, numbers
from ..session import run_dir
from .clean import quoted

WEIGHT, COUNTED = "_weight", "_counted"
_SET = "_set"


def counted_sets(df: DataFrame, sets: dict[str, list[str]], counted: str | None = None) -> dict[str, DataFrame]:
    """For each named set of columns its distinct values, with their number of records in ``WEIGHT``.

    ``COUNTED`` is the number of records whose column ``counted`` is not NULL. Columns that ``df`` lacks
    are left out of their set; a set without any is one row with the totals. An empty table gives empty sets.
    """
    present = {name: [c for c in columns if c in df.columns] for name, columns in sets.items()}
    names = list(dict.fromkeys(c for columns in present.values() for c in columns))
    counts = [
        F.count(F.lit(1)).alias(WEIGHT),
        F.count(quoted(counted) if counted in df.columns else F.lit(None)).alias(COUNTED),
    ]
    if not names:
        total = df.agg(*counts)
        return dict.fromkeys(sets, total)
    numbered = {name: _grouping_id(names, columns) for name, columns in present.items()}
    distinct = {numbered[name]: columns for name, columns in present.items()}
    grouped = df.groupingSets([[quoted(c) for c in columns] for columns in distinct.values()], *[quoted(c) for c in names])
    found = grouped.agg(*counts, F.grouping_id().cast("long").alias(_SET))
    path = run_dir(df.sparkSession, "counted-sets")
    found.write.partitionBy(_SET).parquet(path)
    written = df.sparkSession.read.schema(found.schema).parquet(path)
    return {
        name: written.filter(F.col(_SET) == numbered[name]).select(*[quoted(c) for c in columns], WEIGHT, COUNTED)
        for name, columns in present.items()
    }


def _grouping_id(names: list[str], columns: list[str]) -> int:
    """The number Spark gives to a set: one bit per grouping column, set where the column is left out."""
    return int("".join("0" if name in columns else "1" for name in names), 2)


def submission_sets(df: DataFrame) -> dict[str, DataFrame]:
    """Submissions counted by event and organization, day, team and list of technologies."""
    if S.CREATED in df.columns:
        df = df.withColumn(S.CREATED, dates.bucket_start(dates.as_timestamp(df, S.CREATED), "daily"))
    if S.EXTRA_MEMBERS in df.columns:
        df = df.withColumn(S.EXTRA_MEMBERS, numbers.team_size(quoted(S.EXTRA_MEMBERS)) - 1)
    sets = {"events": [S.TITLE, S.ORG], "days": [S.CREATED], "teams": [S.EXTRA_MEMBERS], "lists": [S.BUILT_WITH]}
    return counted_sets(df, sets, S.PROJECT)


def registrant_sets(df: DataFrame) -> dict[str, DataFrame]:
    """Registrants counted by each of the columns that reports show."""
    columns = [S.COUNTRY, S.OCCUPATION, S.SPECIALTY, S.EXPERIENCE, S.SKILLS]
    return counted_sets(df, {c: [c] for c in columns})
