"""Ingest of drop folders and archives (LED-01, LED-07, LED-08)."""

from __future__ import annotations

import re
import time
from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import clean, ledger
from ..operators.dedup import keep_first
from ..session import materialise, run_dir
from ..sinks.store import merge_staged, stage_records
from ..sources import files as opened
from ..sources import text_exports
from ..sources.archives import unpack_archives
from ..sources.store import read_parquet_if_any

# Files handled per round; bounds the path list of one read and the table joined to it.
FILES_PER_ROUND = 50_000

_FILE = ["file_hash", "file_name", "file_type", "path"]


def ingest_folder(spark: SparkSession, folders, store: str, ledger_path: str, **options) -> DataFrame:
    """Ingest every export in the drop folders; returns one row per file."""
    folders = [folders] if isinstance(folders, str) else folders
    return ingest_files(text_exports.scan_files(spark, *folders), store, ledger_path, **options)


def _as_uri(path: str) -> str:
    """A path as URI with three slashes where it is local."""
    if path.startswith("file:"):
        return "file:///" + path[len("file:"):].lstrip("/")
    return path if "://" in path else f"file://{path}"


def ingest_archives(spark: SparkSession, archives: str, store: str, ledger_path: str, **options) -> DataFrame:
    """Unpack the archives below the shared folder and ingest what they hold."""
    target = _as_uri(run_dir(spark, "unpacked"))
    unpacked = materialise(unpack_archives(spark, archives, target))
    if unpacked.isEmpty():
        return spark.createDataFrame([], RESULT)
    files = text_exports.scan_files(spark, target, recursive=True)
    return ingest_files(files, store, ledger_path, **options)


_DONE = "file_hash string, row_count long, error string"
RESULT = "path string, file_name string, file_hash string, file_type string, status string, row_count long, error string"


def ingest_files(files: DataFrame, store: str, ledger_path: str, max_experience: float = clean.MAX_EXPERIENCE) -> DataFrame:
    """Ingest files given as (uri, path, length, file_name).

    Looks at all files in one job, leaves out content that was completed before or
    occurs twice, and parses the rest once: one job per record kind, however many files
    and header layouts there are, writes cleaned records to a staging table, whose figures
    tell rows per file and files at fault; what is left is merged into the store. What passes
    through the driver is file metadata (paths and headers), never records.
    """
    spark = files.sparkSession
    seq = time.time_ns() // 1000
    found = materialise(text_exports.profile(files))
    jobs = ledger.state(ledger.read(spark, ledger_path))
    fresh = ledger.unprocessed(found, jobs)
    firsts = keep_first(fresh.filter(F.col("problem").isNull()), ["file_hash"], ["path"])
    accepted = materialise(firsts)
    rejected = fresh.filter(F.col("problem").isNotNull())
    keyed = rejected.withColumn("file_hash", F.coalesce("file_hash", F.sha2(F.col("path").cast("binary"), 256)))
    rejected = materialise(keyed)
    ledger.append(ledger.event(rejected, "failed", seq, error=F.col("problem")), ledger_path)
    ledger.append(ledger.event(accepted, "processing", seq), ledger_path)

    results = run_dir(spark, "ingest-results")
    try:
        for batch in _rounds(accepted):
            done = _write_batch(spark, batch, store, seq, max_experience)
            spark.createDataFrame(done, _DONE).write.mode("append").parquet(results)
    except BaseException as error:
        # every started file gets a closing event
        ledger.append(ledger.event(accepted, "failed", seq + 1, error=F.lit(f"The run was broken off: {error}")), ledger_path)
        raise

    told = read_parquet_if_any(spark, results, _DONE)
    told = spark.createDataFrame([], _DONE) if told is None else told
    outcome = materialise(accepted.join(told, "file_hash", "left"))
    done, broken = outcome.filter(F.col("error").isNull()), outcome.filter(F.col("error").isNotNull())
    ledger.append(ledger.event(done, "completed", seq + 1, row_count=F.col("row_count")), ledger_path)
    ledger.append(ledger.event(broken, "failed", seq + 1, error=F.col("error")), ledger_path)
    return _run_report(found, outcome, rejected)


def _run_report(found: DataFrame, outcome: DataFrame, rejected: DataFrame) -> DataFrame:
    """Each file of the run: processed, failed or skipped (LED-08)."""
    base = ["path", "file_name", "file_hash", "file_type"]
    worked = outcome.select(
        *base, F.when(F.col("error").isNull(), "processed").otherwise("failed").alias("status"), "row_count", "error"
    )
    refused = rejected.select(*base, F.lit("failed").alias("status"), F.lit(None).cast("long").alias("row_count"), F.col("problem").alias("error"))
    handled = worked.unionByName(refused)
    skipped = found.join(handled.select("path"), "path", "left_anti").select(
        *base, F.lit("skipped").alias("status"), F.lit(None).cast("long").alias("row_count"), F.lit(None).cast("string").alias("error")
    )
    return handled.unionByName(skipped)


def run_totals(report: DataFrame) -> DataFrame:
    """Files seen, processed, skipped and failed in a run (LED-08)."""
    def counted(status):
        return F.count_if(F.col("status") == status).alias(f"{status}_files")

    return report.agg(F.count(F.lit(1)).alias("total_files"), counted("processed"), counted("skipped"), counted("failed"))


def _rounds(accepted: DataFrame):
    """File metadata in batches of bounded size, read partition by partition."""
    columns = ["path", "uri", "file_hash", "file_type", "delimiter", "encoding", "header_rows", "whole_lines", "names"]
    batch = []
    for row in accepted.select(*columns).toLocalIterator():
        batch.append(row)
        if len(batch) == FILES_PER_ROUND:
            yield batch
            batch = []
    if batch:
        yield batch


def _layouts(files) -> dict:
    layouts = defaultdict(list)
    for f in files:
        layouts[f.file_type, f.delimiter, f.encoding, f.whole_lines, tuple(f.names)].append(f)
    return layouts


def _each_apart(spark, files, work, errors: dict[str, str]) -> None:
    """Do ``work`` on all files at once; if it fails, on halves, until the files at fault are alone."""
    if not files:
        return
    try:
        work(files)
    except Exception as error:
        if spark.sparkContext._jsc.sc().isStopped():
            raise
        if len(files) == 1:
            errors[files[0].file_hash] = str(error)
            return
        for half in (files[: len(files) // 2], files[len(files) // 2 :]):
            _each_apart(spark, half, work, errors)


def _write_batch(spark, files, store, seq, max_experience) -> list[tuple]:
    """Parse and store one batch; returns (hash, rows, error) of each file.

    A file with records wider than its header is refused as a whole, so no cell is lost.
    """
    errors: dict[str, str] = {}
    staged: list[tuple[str, str, DataFrame]] = []

    def stage(group):
        frames = defaultdict(list)
        for layout, some in _layouts(group).items():
            frames[layout[0]].append(_cleaned(spark, layout, some, seq, max_experience))
        written = []
        for kind, parts in frames.items():
            frame = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
            written.append((kind, *stage_records(frame, store, kind)))
        staged.extend(written)

    # files of one layout stay together, so that halves are read in few jobs
    _each_apart(spark, sorted(files, key=lambda f: (f.file_type, f.names, f.path)), stage, errors)
    by_hash = {f.file_hash: f for f in files}
    counts: dict[str, int] = {}
    for kind, path, rows in staged:
        skipped = []
        # one row per file of the round
        for seen in text_exports.file_figures(rows, S.FILE_HASH).collect():
            file = by_hash[seen[S.FILE_HASH]]
            counts[file.file_hash] = seen["rows"] - (file.header_rows > 1)
            if seen["wide"]:
                errors[file.file_hash] = text_exports.wide_problem(len(file.names), seen["most"], seen["wide"])
                skipped.append((file.file_hash, None, None))
            elif file.header_rows > 1:
                skipped.append((file.file_hash, *seen["first"]))
        merge_staged(path, rows, store, kind, _refused(spark, skipped), (text_exports.CELLS,))
    return [(h, None if h in errors else counts.get(h, 0), errors.get(h)) for h in by_hash]


def _refused(spark, skipped: list[tuple]):
    """A function that picks the files and single records (file, block, row) of ``skipped``; None without any."""
    if not skipped:
        return None
    # at most FILES_PER_ROUND rows
    out = F.broadcast(spark.createDataFrame(skipped, "_skipped string, _from long, _no long"))
    same = (F.col("_skipped") == F.col(S.FILE_HASH)) & (
        F.col("_from").isNull() | ((F.col("_from") == F.col(S.BLOCK)) & (F.col("_no") == F.col(S.ROW_NO)))
    )
    return lambda rows: rows.join(out, same, "left_semi")


def _cleaned(spark, layout, files, seq, max_experience) -> DataFrame:
    """Records of one layout, cleaned and keyed."""
    kind, delimiter, encoding, whole_lines, names = layout
    rows = text_exports.read_layout(spark, [f.path for f in files], list(names), delimiter, encoding, whole_lines)
    hashes = spark.createDataFrame([(f.uri, f.file_hash) for f in files], f"_uri string, {S.FILE_HASH} string")
    # at most FILES_PER_ROUND rows
    rows = rows.join(F.broadcast(hashes), "_uri").drop("_uri").withColumn(S.INGEST_SEQ, F.lit(seq))
    if kind == "submission":
        rows = clean.clean_submissions(rows)
    else:
        rows = clean.clean_registrants(rows, max_experience)
    return clean.with_dedup_key(rows, kind)


def retry_failed(
    spark: SparkSession, store: str, ledger_path: str, hashes: DataFrame | None = None, names: DataFrame | None = None
) -> DataFrame:
    """Ingest failed files again from where they lie (LED-07).

    A file that is no longer there is reported as failed and stays failed.
    """
    jobs = ledger.state(ledger.read(spark, ledger_path))
    wanted = ledger.retry_candidates(jobs, hashes, names).select(F.col("retry_path").alias("path"), "file_name", "file_hash", "file_type")
    wanted = materialise(opened.present(wanted))
    # fixed text
    missing = F.lit("Retry file not found. Please re-upload the file.")
    lost = wanted.filter("not found").select(
        "path", "file_name", "file_hash", "file_type",
        F.lit("failed").alias("status"), F.lit(None).cast("long").alias("row_count"), missing.alias("error"),
    )
    report = lost
    for paths in _path_rounds(wanted.filter("found").select("path").distinct()):
        report = report.unionByName(ingest_files(text_exports.scan_files(spark, *paths), store, ledger_path))
    return report


def _path_rounds(paths: DataFrame):
    """Paths in lists of bounded size; characters of patterns stand for themselves."""
    batch: list[str] = []
    for row in paths.toLocalIterator():
        batch.append(re.sub(r"([\\*?\[\]{}])", r"\\\1", row["path"]))
        if len(batch) == FILES_PER_ROUND:
            yield batch
            batch = []
    if batch:
        yield batch
