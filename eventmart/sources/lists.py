"""URL lists and the curated list (SRC-06, SRC-07, SMP-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.urls import HOST
from ..operators.clean import quoted
from ..operators.ranking import global_position

# Columns of the curated list that are kept.
CURATED = [
    S.SRC_URL,
    "Year",
    "Organization Type",
    "Organization Category",
    "In person vs virtual",
    "Hackathon Tags",
]


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """A list stored as CSV or Parquet, all rows and columns."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return spark.read.parquet(path)


def prepare_list(
    df: DataFrame, filter_column: str | None = None, filter_value: str | None = None, host: str = HOST
) -> tuple[DataFrame, str]:
    """Apply the optional equality filter and find the URL column (SRC-06).

    The first header containing "url" wins; without one, the first column in which
    any value names the host. Only that second case runs a job: one aggregate over
    all columns.
    """
    if filter_column and filter_value:
        if filter_column not in df.columns:
            raise ValueError(f"the list has no column {filter_column!r}")
        df = df.filter(quoted(filter_column) == filter_value)
    named = [c for c in df.columns if "url" in c.lower()]
    if named:
        return df, named[0]
    if df.columns:
        found = df.agg(*[
            F.coalesce(F.bool_or(F.contains(quoted(c).cast("string"), F.lit(host))), F.lit(False)).alias(f"c{i}")
            for i, c in enumerate(df.columns)
        ]).first()
        for position, name in enumerate(df.columns):
            if found[position]:
                return df, name
    raise ValueError("the list has no URL column")


def indexed(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """List entries as (idx, url), numbered from 0 in the given order.

    NULL entries get no number; blank ones do, because the seed of an entry is its
    position in the list (FLT-09 drops them afterwards).
    """
    present = df.filter(quoted(column).isNotNull()).select(
        quoted(column).cast("string").alias("url"), *[quoted(c).alias(f"_o{i}") for i, c in enumerate(order)]
    )
    by = [F.col(f"_o{i}") for i in range(len(order))] + [F.col("url")]
    numbered = global_position(present, by, "idx")
    return numbered.select((F.col("idx") - 1).alias("idx"), "url")


def curated_urls(df: DataFrame) -> DataFrame:
    """URLs of the curated list, NULLs dropped; an empty frame without that column."""
    if S.SRC_URL not in df.columns:
        return df.sparkSession.createDataFrame([], f"`{S.SRC_URL}` string")
    return df.select(quoted(S.SRC_URL)).filter(quoted(S.SRC_URL).isNotNull())


def curated_metadata(df: DataFrame) -> DataFrame:
    """The metadata columns that are present."""
    return df.select(*[quoted(c) for c in CURATED if c in df.columns])


def curated_size(df: DataFrame) -> DataFrame:
    """Number of URLs on the curated list (SMP-09)."""
    return curated_urls(df).agg(F.count(F.lit(1)).alias("size"))
