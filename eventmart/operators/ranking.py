"""Ordering, limits and ranks (SRT-*, WIN-03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .clean import quoted


# Rows one task may number on its own.
WINDOW_ROWS = 100_000


def top(df: DataFrame, metric: str, key: str, limit: int | None = None) -> DataFrame:
    """Largest ``metric`` first, ties by ``key``; all rows when ``limit`` is None (SRT-01)."""
    ordered = df.orderBy(F.desc(f"`{metric}`"), quoted(key))
    return ordered if limit is None else ordered.limit(limit)


def ranked(df: DataFrame, metric: str, key: str, limit: int | None = None, rank: str = "Rank") -> DataFrame:
    """Add the 1-based position in that order as first column (WIN-03).

    With a limit the window runs over at most ``limit`` rows. Without one, or beyond
    ``WINDOW_ROWS``, the order is spread over the cluster by :func:`global_position`.
    """
    order = [F.desc(f"`{metric}`"), quoted(key)]
    if limit is None or limit > WINDOW_ROWS:
        numbered = global_position(df, order, rank)
        numbered = numbered if limit is None else numbered.filter(F.col(rank) <= limit)
    else:
        limited = df.orderBy(*order).limit(limit)
        numbered = limited.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("long"))
    return numbered.select(rank, *[quoted(c) for c in df.columns])


def global_position(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Dense 1..n position over a frame of any size.

    Rows are range-partitioned by the order, numbered inside each range, and moved
    by the number of rows in the ranges before. The ranged rows are written to the
    shared checkpoint folder first, because recomputing them could choose other
    range bounds. Only one row per range meets in a single task.
    """
    ranges = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    spread = materialise(
        df.repartitionByRange(int(ranges), *order).withColumn("_range", F.spark_partition_id())
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        spread.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    # one row per range: bounded by the number of shuffle partitions
    return (
        spread.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_range")
        .withColumn(name, (F.col("_inside") + F.col("_offset")).cast("long"))
        .drop("_range", "_inside", "_offset")
        .orderBy(name)
    )


def chart_order(df: DataFrame, metric: str, key: str, horizontal: bool = True) -> DataFrame:
    """Row order a bar chart draws: horizontal bars ascending, vertical descending (SRT-09)."""
    return df.orderBy(quoted(metric).asc() if horizontal else quoted(metric).desc(), quoted(key))
