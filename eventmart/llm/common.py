"""Helpers of the training-data operators: written steps, files on the shared folder, small type checks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import run_dir


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and continue from the files."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give memory that this worker has freed back to the system: it may idle while other stages run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(rows: Callable) -> Callable:
    """``rows`` over batches, with :func:`release` once the task is done."""

    def each(batches):
        try:
            yield from rows(batches)
        finally:
            release()

    return each


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared path, for code that runs inside tasks."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def put_in_place(system: pafs.FileSystem, temporary: str, final: str) -> None:
    """Give a whole file its name, also where an earlier attempt of the task has done so."""
    if system.get_file_info(final).type != pafs.FileType.NotFound:
        system.delete_file(final)
    system.move(temporary, final)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = "_" + name
        while name in taken:
            name = "_" + name
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column name that holds dots or back-quotes, as an expression reads it."""
    return "`" + name.replace("`", "``") + "`"


def text_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; NULL reads as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def parts_of(batch: pa.RecordBatch, size: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch in parts, each of about ``size`` bytes of text or one row; rows keep their order."""
    lengths = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // size)) + 1
    for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield batch.slice(start, stop - start)


def id_text(column: str = "doc_id") -> Column:
    """An id written as text; a NULL id counts as empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of an id written as text."""
    return F.crc32(id_text(column).cast("binary"))


def spread(df: DataFrame) -> DataFrame:
    """Documents as id and text only."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def forest(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """Component labels of ``size`` points under links (i, j), each the smallest point of its component."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.random.default_rng(8).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """At least ``count`` powers of ``base`` modulo 2**64, kept between calls."""
    out = _POWERS.get(base, np.ones(1, np.uint64))
    while len(out) < count:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    _POWERS[base] = out
    return out


def word_hashes(text: str, stretch: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of the words of a text, split at ASCII white space, A-Z in lower case.

    A word's hash is the polynomial of its bytes, a difference of prefix sums, so whole texts are
    hashed at once. Long texts are taken in stretches that end at white space.
    """
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    out, at = [], 0
    while at < len(data):
        part = data[at : at + stretch]
        if at + stretch < len(data):
            gaps = np.flatnonzero(_SPACE[part])
            if len(gaps):
                part = part[: gaps[-1] + 1]
            else:
                behind = np.flatnonzero(_SPACE[data[at + stretch :]])
                part = data[at : at + stretch + (behind[0] if len(behind) else len(data))]
        out.append(_words(part))
        at += len(part)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _words(data: np.ndarray) -> np.ndarray:
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(_BASE, len(data) + 1), powers(_INVERSE, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))
