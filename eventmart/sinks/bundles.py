"""Report bundles, raw exports and their history (SNK-02..08)."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, numbers
from ..session import folder_bytes, remove_folder
from ..sources.store import read_parquet_if_any

_MANIFEST = "table string, rows long, columns int, path string"
#: Folder beside the bundles with one record per table written.
LOG = "export_log"
_LOGGED = T.StructType([
    T.StructField("bundle", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("columns", T.IntegerType()),
    T.StructField("path", T.StringType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("written", T.TimestampNTZType()),
])


def _folder(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_").lower()


def _write(df: DataFrame, path: str, fmt: str) -> int:
    """Write a frame and return its row count, counted while it is written."""
    seen = Observation()
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if fmt == "csv":
        flat = [F.array_join(c, ", ").alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes]
        observed.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        observed.write.mode("overwrite").parquet(path)
    return int(seen.get["rows"])


def raw_export(df: DataFrame, path: str, fmt: str = "csv") -> dict[str, int]:
    """Export a whole table as CSV or Parquet; returns its row and column count (SNK-02).

    The rows are counted by the write itself, there is no second scan.
    """
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"format must be csv or parquet, not {fmt!r}")
    return {"rows": _write(df, path, fmt), "columns": len(df.columns)}


# Tables of a bundle that are computed at the same time.
PARALLEL_TABLES = 4


def write_bundle(spark: SparkSession, tables: dict[str, DataFrame | None], path: str, fmt: str = "parquet") -> DataFrame:
    """Write named tables below ``path``, leaving out empty ones; returns the manifest (SNK-03).

    Each table is computed once, by the write that also counts its rows; the folder of a table without
    rows is removed again. A few tables run side by side, because most of them are small
    aggregates that do not fill a cluster. One record per table goes to the log beside the bundle.
    """
    base, _, bundle = path.rstrip("/").rpartition("/")
    started = datetime.now(UTC).replace(tzinfo=None)

    def write(item):
        name, df = item
        target = f"{path.rstrip('/')}/{_folder(name)}"
        rows = _write(df, target, fmt)
        if not rows:
            remove_folder(spark, target)
            return None
        return name, rows, len(df.columns), target, folder_bytes(spark, target)

    given = [(name, df) for name, df in tables.items() if df is not None]
    with ThreadPoolExecutor(PARALLEL_TABLES) as pool:
        written = [row for row in pool.map(write, given) if row is not None]
    logged = [(bundle, *row, started) for row in written] or [(bundle, None, 0, 0, path, 0, started)]
    spark.createDataFrame(logged, _LOGGED).coalesce(1).write.mode("append").parquet(f"{base}/{LOG}")
    return spark.createDataFrame([row[:4] for row in written], _MANIFEST)


def export_history(spark: SparkSession, folder: str) -> DataFrame:
    """Bundles written below a folder: name, time, size in KB, tables and rows, newest first (SNK-08).

    Comes from the log of the writes alone; no file is listed. A bundle written again shows its last state.
    """
    log = read_parquet_if_any(spark, f"{folder.rstrip('/')}/{LOG}", _LOGGED)
    log = spark.createDataFrame([], _LOGGED) if log is None else log
    runs = log.groupBy("bundle", "written").agg(
        F.sum("bytes").alias("bytes"), F.count("table").alias("tables"), F.sum("rows").alias("rows")
    )
    last = runs.groupBy("bundle").agg(F.max(F.struct("written", "bytes", "tables", "rows")).alias("run"))
    return last.select(
        F.col("bundle").alias("Filename"),
        dates.stamp(F.col("run.written")).alias("Created At"),
        numbers.round_half_even(F.col("run.bytes") / 1024).alias("Size (KB)"),
        F.col("run.tables").alias("Tables"),
        F.col("run.rows").alias("Rows"),
    ).orderBy(F.desc("Created At"), "Filename")
