"""The stored tables (SRC-01, SRC-09, SET-01, AGG-29).

Of each kind there is a current table (see :mod:`eventmart.sinks.store`), which holds each identity
once, and there may be parts of an older layout and a legacy file, which are deduplicated when read.
"""

from __future__ import annotations

import uuid
import warnings
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.dedup import deduplicate_store
from ..session import child_names

KINDS = ("submission", "registrant")
# Order key given to records of a legacy file: after everything ingested.
_LAST = 2**62
# What the Parquet reader says of a file that is none; every other failure of a read is raised.
_NO_PARQUET = "is not a Parquet file"


def parts_path(root: str, kind: str) -> str:
    return f"{root.rstrip('/')}/{kind}s/parts"


def read_parquet_if_any(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """A Parquet folder, None when there is nothing to read.

    Without ``schema`` the columns of all parts are merged and files that are no Parquet files are
    left out with a warning that names them (see :func:`skipped_parts`); any other failure to read is
    an error. With it nothing is inferred, and an unreadable part is an error.
    """
    if schema is not None:
        return _if_any(lambda: spark.read.schema(schema).parquet(path))
    found, skipped = _merged(spark, path)
    if skipped:
        warnings.warn(f"{path}: parts that cannot be read are left out: {', '.join(skipped)}", stacklevel=2)
    return found


def _if_any(read) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _merged(spark: SparkSession, path: str) -> tuple[DataFrame | None, list[str]]:
    """A Parquet folder with the columns of all its files, and the files that are no Parquet files."""

    def read(*paths):
        return spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", False).parquet(*paths)

    try:
        return _if_any(lambda: read(path)), []
    except Exception as error:
        if _NO_PARQUET not in str(error):
            raise
    # a given schema lists the files without opening them
    files = [unquote(f) for f in spark.read.schema("x int").parquet(path).inputFiles()]
    skipped: list[str] = []

    def look(some):
        try:
            read(*some)
        except Exception as error:
            if _NO_PARQUET not in str(error):
                raise
            if len(some) == 1:
                skipped.extend(some)
                return
            for half in (some[: len(some) // 2], some[len(some) // 2 :]):
                look(half)

    look(files)
    good = sorted(set(files) - set(skipped))
    if not good:
        return None, sorted(skipped)
    return spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", False).option("basePath", path).parquet(*good), sorted(skipped)


def skipped_parts(spark: SparkSession, root: str, kind: str, legacy: str | None = None) -> DataFrame:
    """(path) of the files that :func:`read_store` leaves out because they are no Parquet files."""
    paths = [parts_path(root, kind), *([legacy] if legacy else [])]
    return spark.createDataFrame([(f,) for path in paths for f in _merged(spark, path)[1]], "path string")


# ---- the current table --------------------------------------------------------------


def _current(root: str, kind: str) -> str:
    return f"{root.rstrip('/')}/{kind}s/current"


def generation_path(root: str, kind: str, number: int) -> str:
    return f"{_current(root, kind)}/generation-{number:06d}"


def staging_path(root: str, kind: str) -> str:
    """A new place for records that are to be merged; readers do not look at it."""
    return f"{_current(root, kind)}/staged-{uuid.uuid4().hex[:12]}"


def generation(path: str) -> int:
    return int(path.rsplit("-", 1)[1])


def generations(spark: SparkSession, root: str, kind: str) -> list[int]:
    """Numbers of the generations there are, complete or not."""
    return [generation(n) for n in child_names(spark, _current(root, kind)) if n.startswith("generation-")]


def current_path(spark: SparkSession, root: str, kind: str) -> str | None:
    """The newest complete generation of the current table."""
    for number in reversed(generations(spark, root, kind)):
        path = generation_path(root, kind, number)
        if "_SUCCESS" in child_names(spark, path):
            return path
    return None


def current_schema(spark: SparkSession, root: str, kind: str):
    """The columns of all records of the current table, from one footer; None without a table."""
    folder = f"{_current(root, kind)}/schema"
    for name in reversed(child_names(spark, folder)):
        if "_SUCCESS" in child_names(spark, f"{folder}/{name}"):
            return spark.read.parquet(f"{folder}/{name}").schema
    return None


def write_schema(spark: SparkSession, root: str, kind: str, schema) -> None:
    """Add a version of the table's schema: an empty file under the next number."""
    folder = f"{_current(root, kind)}/schema"
    last = max((int(n.rsplit("-", 1)[1]) for n in child_names(spark, folder)), default=0)
    spark.createDataFrame([], schema).coalesce(1).write.parquet(f"{folder}/version-{last + 1:06d}")


def read_current(spark: SparkSession, root: str, kind: str) -> DataFrame | None:
    """The current table: each identity once, nothing to merge; only the columns asked for are read."""
    path, schema = current_path(spark, root, kind), current_schema(spark, root, kind)
    if path is None or schema is None:
        return None
    return spark.read.schema(schema).parquet(path).drop(S.BUCKET)


def _keys(df: DataFrame) -> DataFrame:
    return df.select(F.col(S.DEDUP_KEY).alias("_stored"))


def _without(df: DataFrame, others: list[DataFrame]) -> DataFrame:
    """Records of ``df`` whose identity none of ``others`` has."""
    for other in others:
        df = df.join(_keys(other), F.col(S.DEDUP_KEY).eqNullSafe(F.col("_stored")), "left_anti")
    return df


def read_store(
    spark: SparkSession, root: str, kind: str, legacy: str | None = None, deduplicate: bool = True
) -> DataFrame | None:
    """All records of one kind, each identity once. None when nothing is stored.

    The current table is read as it is. Parts of the older layout, which are older than it, come before it in
    the keep-first order, a legacy file comes last. Parts may differ in columns; files that are no Parquet files are
    left out with a warning and listed by :func:`skipped_parts`, any other failure to read is raised.
    """
    current = read_current(spark, root, kind)
    parts = read_parquet_if_any(spark, parts_path(root, kind))
    if parts is not None and S.FILE_HASH in parts.columns:
        parts = parts.withColumn(S.FILE_HASH, F.col(S.FILE_HASH).cast("string"))
    old = read_parquet_if_any(spark, legacy) if legacy else None
    if current is None:
        if old is not None and parts is not None and S.INGEST_SEQ in parts.columns:
            old = old.withColumn(S.INGEST_SEQ, F.lit(_LAST))
        found = [df for df in (parts, old) if df is not None]
        if not found:
            return None
        merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
        return deduplicate_store(merged) if deduplicate else merged
    found = []
    for df in (parts, current, old):
        if df is None:
            continue
        if deduplicate and S.DEDUP_KEY in df.columns:
            df = _without(df if df is current else deduplicate_store(df), [f for f in found if S.DEDUP_KEY in f.columns])
        found.append(df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def data_exists(spark: SparkSession, root: str) -> bool:
    """Whether any record of any kind is stored; looks at one row (SRC-09)."""
    tables = (read_store(spark, root, kind, deduplicate=False) for kind in KINDS)
    return any(df is not None and not df.limit(1).isEmpty() for df in tables)


def store_summary(spark: SparkSession, root: str) -> DataFrame:
    """Per kind: stored or not, rows, column names (AGG-29)."""
    rows = []
    for kind in KINDS:
        df = read_store(spark, root, kind)
        names = [] if df is None else [c for c in df.columns if not c.startswith("_")]
        counted = spark.range(0) if df is None else df
        rows.append(
            counted.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(kind).alias("kind"),
                F.lit(df is not None).alias("exists"),
                "row_count",
                F.lit(", ".join(sorted(names))).alias("columns"),
            )
        )
    return reduce(DataFrame.unionByName, rows)
