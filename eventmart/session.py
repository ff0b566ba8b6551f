"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows up to which a table is broadcast after its size has been checked.
BROADCAST_ROWS = 200_000
# Logarithm of the rows that a filter of hashes has at most; each holds 64 bits.
FILTER_LOG = 20

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    # checkpointed steps are removed once nothing refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "eventmart", master: str | None = None, **settings) -> SparkSession:
    """A session with the settings the operators expect; anything else is left to the cluster.

    Leave ``spark.sql.shuffle.partitions`` to the deployment: a high value costs
    little because adaptive execution merges small partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def setting(spark: SparkSession, name: str, value):
    """A setting of the session for what is run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


# Shuffle files are deleted when the query ends, not when the driver collects garbage.
DELETE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="eventmart-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a *materialised* frame when a count proves it small.

    Beyond ``rows`` the frame is returned as it is and the planner shuffles both
    sides, with adaptive skew splitting.
    """
    return F.broadcast(df) if is_small(df, rows) else df


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a *materialised* frame has at most ``rows`` rows."""
    return df.limit(rows + 1).count() <= rows


def maybe_among(df: DataFrame, number: Column, few: DataFrame) -> DataFrame:
    """``df`` with ``_maybe``: whether the 64-bit hash ``number`` may be a ``_number`` of the *materialised* frame ``few``.

    True for every hash that is, and for the part of the others that meets a set bit among 2^26. However
    long ``few`` is, the filter is small enough to be broadcast, so rows can be told apart before a shuffle.
    """
    def place(hashed):
        return F.shiftrightunsigned(hashed, 64 - FILTER_LOG), F.shiftrightunsigned(hashed, 58 - FILTER_LOG).bitwiseAND(63).cast("int")

    word, bit = place(F.col("_number"))
    set_bit = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    # at most 2^FILTER_LOG rows
    words = F.broadcast(few.groupBy(word.alias("_word")).agg(F.bit_or(set_bit).alias("_bits")))
    word, bit = place(number)
    found = F.getbit(F.coalesce("_bits", F.lit(0).cast("long")), bit) == 1
    return df.join(words, word == F.col("_word"), "left").withColumn("_maybe", found).drop("_word", "_bits")


# ---- folders, in whatever file system Spark resolves their paths ----------------


def _hadoop(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, sorted; empty where there is no folder."""
    system, place = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder this library has written and nothing refers to any more."""
    system, place = _hadoop(spark, path)
    system.delete(place, True)


def move_files(spark: SparkSession, names: list[str], source: str, target: str) -> None:
    """Move files, given below ``source``, to the same places below ``target`` and mark that folder as complete."""
    system, place = _hadoop(spark, target)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {n.rpartition("/")[0] for n in names}:
        system.mkdirs(path(place, folder) if folder else place)
    for name in names:
        if not system.rename(path(f"{source}/{name}"), path(f"{target}/{name}")):
            raise OSError(f"{source}/{name} could not be moved to {target}")
    done = path(place, "_SUCCESS")
    if not system.exists(done):
        system.create(done).close()


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Size of what a folder holds, from the file system's records."""
    system, place = _hadoop(spark, path)
    return int(system.getContentSummary(place).getLength())
