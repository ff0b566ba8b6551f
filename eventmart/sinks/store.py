"""Writing the stored tables (SNK-01, AGG-01).

The current table of a kind holds each identity once, so that readers need not look for repetitions.
Records are merged into it when they are written: the first of each identity in the new records stays
if the table has none yet. What came first therefore wins, as in a table that is
deduplicated by order of arrival.

Its rows lie in folders by hash of the identity; identity, order of arrival and source file are
columns. One writer at a time: two at once could both add the same new identity, which
:func:`compact` mends.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..operators.clean import quoted
from ..operators.dedup import deduplicate_store, keep_first
from ..session import DELETE_SHUFFLES, broadcast_if_small, child_names, is_small, materialise, maybe_among, move_files, remove_folder, setting
from ..sources import store as source

# Folders of a new table; a table keeps the number it was made with until it is compacted with another.
BUCKETS = 8


def write_parts(df: DataFrame, root: str, kind: str) -> None:
    """Write cleaned records as parts, one partition per source file, without merging them.

    Only the partitions present in ``df`` are replaced, so writing a file again
    overwrites its own records and nothing else.
    """
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(S.FILE_HASH)
        .parquet(source.parts_path(root, kind))
    )


def _bucket(buckets: int) -> Column:
    number = F.pmod(F.xxhash64(S.DEDUP_KEY), F.lit(buckets)).cast("string")
    return F.concat(F.repeat(F.lit("0"), 5 - F.length(number)), number, F.lit(f"-of-{buckets:05d}")).alias(S.BUCKET)


def _buckets(spark: SparkSession, path: str, otherwise: int = BUCKETS) -> int:
    names = [n for n in child_names(spark, path) if n.startswith(f"{S.BUCKET}=")]
    return int(names[0].rsplit("-", 1)[1]) if names else otherwise


def _named(spark: SparkSession, root: str, kind: str, df: DataFrame) -> DataFrame:
    """``df`` under the table's column names."""
    known = source.current_schema(spark, root, kind)
    names = {f.name.lower(): f for f in (known.fields if known else [])}
    for f in df.schema.fields:
        have = names.get(f.name.lower())
        if have is not None and have.dataType != f.dataType:
            raise ValueError(f"{kind}: column {f.name} is {f.dataType.simpleString()}, the store has {have.dataType.simpleString()}")
    return df.select(*[quoted(c).alias(names[c.lower()].name if c.lower() in names else c) for c in df.columns])


def _add_columns(spark: SparkSession, root: str, kind: str, df: DataFrame) -> None:
    """Add the columns of ``df`` that are new to the table to its schema."""
    known = source.current_schema(spark, root, kind)
    fields = known.fields if known else []
    names = {f.name.lower() for f in fields}
    new = [f for f in _named(spark, root, kind, df).schema.fields if f.name.lower() not in names]
    if new:
        fields = [T.StructField(f.name, f.dataType, True) for f in [*fields, *new]]
        source.write_schema(spark, root, kind, T.StructType(fields))


def merge_records(df: DataFrame, root: str, kind: str, staged: bool = False, buckets: int = BUCKETS) -> None:
    """Add the records whose identity the current table lacks, each once, the first by arrival.

    Of the table only the identities are read. Records written by a run that broke off are found again
    and not added twice. A new table gets ``buckets`` folders.

    Records are reduced by identity in each task and shuffled once. A ``staged`` frame, of which most records are new, is
    written in the layout of the table first and merged from there (see :func:`merge_staged`).
    """
    spark = df.sparkSession
    if staged:
        written, rows = stage_records(df, root, kind, buckets)
        return merge_staged(written, rows, root, kind)
    path = source.current_path(spark, root, kind)
    buckets = _buckets(spark, path, buckets) if path else buckets
    df = _named(spark, root, kind, df)
    _add_columns(spark, root, kind, df)
    # identities often begin alike, so they are sorted by a hash first, in the aggregate and in the join
    order = [c for c in S.ARRIVAL if c in df.columns] or [c for c in df.columns if c != S.DEDUP_KEY]
    fresh = keep_first(df.withColumn("_hash", F.xxhash64(S.DEDUP_KEY)), ["_hash", S.DEDUP_KEY], order)
    if path:
        stored = spark.read.schema(f"{S.DEDUP_KEY} string").parquet(path).select(F.col(S.DEDUP_KEY).alias("_stored"))
        stored = stored.withColumn("_number", F.xxhash64("_stored"))
        # plain equality, so that the records stay where the aggregate has put them; NULL is looked up apart
        if not stored.filter(F.col("_stored").isNull()).isEmpty():
            fresh = fresh.filter(F.col(S.DEDUP_KEY).isNotNull())
        fresh = fresh.join(stored, (F.col("_hash") == F.col("_number")) & (F.col(S.DEDUP_KEY) == F.col("_stored")), "left_anti")
    fresh = fresh.drop("_hash")
    _write(fresh.withColumn(S.BUCKET, _bucket(buckets)), path or source.generation_path(root, kind, 1), buckets)


def stage_records(df: DataFrame, root: str, kind: str, buckets: int = BUCKETS) -> tuple[str, DataFrame]:
    """Write records beside the current table, in folders like its own; returns the path and what can be read there."""
    spark = df.sparkSession
    path = source.current_path(spark, root, kind)
    buckets = _buckets(spark, path, buckets) if path else buckets
    staged = source.staging_path(root, kind)
    df = _named(spark, root, kind, df).withColumn(S.BUCKET, _bucket(buckets))
    _write(df, staged, buckets)
    return staged, spark.read.schema(df.schema).parquet(staged)


# Folders up to which a task keeps a file open in each; with more its records are sorted first.
OPEN_FILES = 32


def _write(df: DataFrame, path: str, buckets: int) -> None:
    # a task that has opened as many files as this begins to sort, so it is one more than there are
    files = buckets + 1 if buckets <= OPEN_FILES else 0
    with setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", files), setting(df.sparkSession, DELETE_SHUFFLES, True):
        df.write.mode("append").option("compression", "zstd").partitionBy(S.BUCKET).parquet(path)


def merge_staged(
    staged: str, rows: DataFrame, root: str, kind: str, refused: Callable[[DataFrame], DataFrame] | None = None, leave: tuple = ()
) -> None:
    """Add staged records to the current table, without those that ``refused`` picks and the columns ``leave``.

    Files of which every record is new become files of the table by being moved, so their records
    are written once. Only hashes of identities are shuffled to find repetitions, and identities and places where a hash
    repeats; files with records to leave out are written again without them.
    """
    spark = rows.sparkSession
    path = source.current_path(spark, root, kind)
    target = path or source.generation_path(root, kind, 1)
    _add_columns(spark, root, kind, rows.drop(S.BUCKET, *leave))
    out = _left_out(rows, path, refused)
    # at most one row per staged file
    touched = {f"{S.BUCKET}={r[0]}/{unquote(r[1])}" for r in out.select(S.BUCKET, "_file").distinct().collect()}
    if path is None:
        remove_folder(spark, target)  # what a run that broke off has left
    if touched:
        names = [f"{staged}/{name}" for name in sorted(touched)]
        some = spark.read.schema(rows.schema).option("basePath", staged).parquet(*[re.sub(r"([\\*?\[\]{}])", r"\\\1", n) for n in names])
        _write(_kept(_located(some), out).drop(*PLACE, *leave), target, _buckets(spark, staged))
    folders = [n for n in child_names(spark, staged) if n.startswith(f"{S.BUCKET}=")]
    files = [f"{folder}/{name}" for folder in folders for name in child_names(spark, f"{staged}/{folder}") if name.endswith(".parquet")]
    move_files(spark, [f for f in files if f not in touched], staged, target)
    remove_folder(spark, staged)


# The place of a staged record in its folder.
PLACE = ["_file", "_at"]


def _located(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_file": F.col("_metadata.file_name"), "_at": F.col("_metadata.row_index")})


def _kept(located: DataFrame, out: DataFrame) -> DataFrame:
    """Staged records without those of ``out``; where that is long, only records that may be among them are shuffled."""
    where = [S.BUCKET, *PLACE]
    if is_small(out):
        return located.join(F.broadcast(out), where, "left_anti")
    number = F.xxhash64(*where)
    told = maybe_among(located, number, out.select(number.alias("_number")))
    return told.filter("not _maybe").unionByName(told.filter("_maybe").join(out, where, "left_anti")).drop("_maybe")


def _doubtful(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """The records whose ``_number`` is one of ``hashes``, and where those are many a few others; nothing is shuffled."""
    if is_small(hashes):
        return rows.join(F.broadcast(hashes), "_number", "left_semi")
    return maybe_among(rows, F.col("_number"), hashes).filter("_maybe").drop("_maybe")


def _left_out(rows: DataFrame, path: str | None, refused) -> DataFrame:
    """(folder, file, row) of staged records that are refused or have an identity that is stored or came before."""
    spark = rows.sparkSession
    located = _located(rows)
    where = [S.BUCKET, *PLACE]
    bad = None if refused is None else materialise(refused(located).select(*where))
    order = [c for c in S.ARRIVAL if c in rows.columns] or [c for c in rows.columns if c not in (S.DEDUP_KEY, S.BUCKET)]
    own = located.select(S.DEDUP_KEY, F.struct(*[quoted(c) for c in order], *PLACE).alias("_place"), *where)
    number = F.xxhash64(S.DEDUP_KEY).alias("_number")
    hashes = own.select(number, F.lit(1).alias("new"))
    stored = None
    if path:
        # at most one row per folder
        folders = [r[0] for r in rows.select(S.BUCKET).distinct().collect()]
        stored = spark.read.schema(f"{S.DEDUP_KEY} string, {S.BUCKET} string").parquet(path).filter(F.col(S.BUCKET).isin(folders))
        hashes = hashes.unionByName(stored.select(number, F.lit(0).alias("new")))
    seen = hashes.groupBy("_number").agg(F.count(F.lit(1)).alias("n"), F.max("new").alias("new")).filter("n > 1 and new = 1")
    doubtful = materialise(seen.select("_number"))
    own = _doubtful(own.withColumn("_number", number), doubtful)
    # refused records are counted with the others, so that only doubtful ones are looked up among them
    if bad is not None:
        own = own.join(broadcast_if_small(bad), where, "left_anti")
    every = own.select("_number", S.DEDUP_KEY, "_place")
    if stored is not None:
        held = _doubtful(stored.select(number, S.DEDUP_KEY), doubtful)
        none = F.lit(None).cast(own.schema["_place"].dataType)
        every = every.unionByName(held.select("_number", S.DEDUP_KEY, none.alias("_place")))
    # a stored identity has no first place among the new ones
    firsts = every.groupBy("_number", S.DEDUP_KEY).agg(
        F.min("_place").alias("_first"), F.max(F.col("_place").isNull()).alias("_held")
    ).withColumnsRenamed({S.DEDUP_KEY: "_stored", "_number": "_same"})
    same = (F.col("_number") == F.col("_same")) & F.col(S.DEDUP_KEY).eqNullSafe(F.col("_stored"))
    later = own.join(firsts, same).filter(F.col("_held") | (F.col("_place") > F.col("_first"))).select(*where)
    return materialise(later if bad is None else later.unionByName(bad))


def compact(spark: SparkSession, root: str, kind: str, buckets: int | None = None) -> None:
    """Write the current table anew with one file per folder, sorted by identity, and continue with that.

    The new generation counts once it is complete. The one before stays for readers that have begun
    with it; older ones are deleted. ``buckets`` changes the number of folders.
    """
    path = source.current_path(spark, root, kind)
    if path is None:
        return
    rows = source.read_current(spark, root, kind)
    number = source.generation(path)
    shaped = deduplicate_store(rows).withColumn(S.BUCKET, _bucket(buckets or _buckets(spark, path)))
    shaped = shaped.repartition(S.BUCKET).sortWithinPartitions(S.BUCKET, S.DEDUP_KEY)
    # what a run that broke off has left of this generation is replaced
    shaped.write.mode("overwrite").partitionBy(S.BUCKET).parquet(source.generation_path(root, kind, number + 1))
    for old in source.generations(spark, root, kind):
        if old < number:
            remove_folder(spark, source.generation_path(root, kind, old))
