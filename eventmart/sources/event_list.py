"""The authoritative event list (SRC-05, CLN-12, CLN-14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import dates
from ..functions.text import strip
from ..operators.clean import quoted

_TEXT = [S.SRC_NAME, S.SRC_ORG, S.SRC_URL, S.SRC_MODE]


def read_events(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read the list from CSV or Parquet and normalise it; returns every row and column."""
    if (fmt or path.rsplit(".", 1)[-1]) == "csv":
        raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    else:
        raw = spark.read.parquet(path)
    return normalise_events(raw)


def normalise_events(df: DataFrame) -> DataFrame:
    """Trim headers and texts, drop rows without a name, type dates and counts, add date parts."""
    if [c.strip() for c in df.columns] != df.columns:
        df = df.toDF(*[c.strip() for c in df.columns])
    name = quoted(S.SRC_NAME).cast("string")
    df = df.filter(F.length(strip(name)) > 0)
    df = df.withColumns({c: strip(quoted(c).cast("string")) for c in _TEXT if c in df.columns})
    counts = [c for c in (S.SRC_PARTICIPANTS, S.SRC_SUBMISSIONS) if c in df.columns]
    df = df.withColumns({c: quoted(c).try_cast("long") for c in counts if df.schema[c].dataType.simpleString() != "bigint"})
    if S.SRC_DATE in df.columns:
        # A column that already holds zone-less timestamps is left as it is, so that
        # range filters on it still reach the Parquet scan.
        if df.schema[S.SRC_DATE].dataType.simpleString() != "timestamp_ntz":
            df = df.withColumn(S.SRC_DATE, dates.as_timestamp(df, S.SRC_DATE))
        day = quoted(S.SRC_DATE)
        df = df.withColumns({"Year": F.year(day), "Month": F.month(day), "Quarter": F.quarter(day)})
    return df


def display_events(df: DataFrame) -> DataFrame:
    """The columns shown in a table of events, dates as ``yyyy-MM-dd`` (CLN-14)."""
    return df.select(
        F.date_format(quoted(S.SRC_DATE), "yyyy-MM-dd").alias("Date"),
        quoted(S.SRC_NAME).alias("Hackathon"),
        quoted(S.SRC_ORG).alias("Organizer"),
        quoted(S.SRC_PARTICIPANTS).alias("Participants"),
        quoted(S.SRC_SUBMISSIONS).alias("Submissions"),
        quoted(S.SRC_MODE).alias("Event Type"),
    )
