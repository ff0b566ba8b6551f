"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range is kept.

The sketch of a union is the union of the sketches, and containment can be estimated between texts of
very unequal length. Shingles are 16 code points, a shorter text is one shingle, and the same fraction of
hashes is kept of texts of every length.
A fingerprint is the number of shingles, a hash of the whole text (64 bits, hexadecimal) and the retained hashes
(ascending, 32 bits each, little-endian) in base64, with colons between.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, spread, text_of

WIDTH = 16
FRACTION = 4  # one hash in so many is kept
_STRETCH = 1 << 20
_M1, _M2, _BASE = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def sketch(text: str) -> np.ndarray:
    """Distinct retained hashes, ascending."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.zeros(0, np.uint32)
    limit = np.uint64((1 << 64) // FRACTION)
    found = []
    for at in range(0, max(1, len(points) - WIDTH + 1), _STRETCH):
        part = points[at : at + _STRETCH + WIDTH - 1].astype(np.uint64) + np.uint64(1)
        if len(part) < WIDTH:  # only a text that is shorter itself
            part = np.concatenate([part, np.zeros(WIDTH - len(part), np.uint64)])
        power, size = int(_BASE), 1
        while size < WIDTH:
            part = part[:-size] * np.uint64(power) + part[size:]
            power, size = power * power % (1 << 64), size * 2
        h = _mixed(part)
        found.append(np.unique((h[h < limit] // np.uint64((1 << 32) // FRACTION)).astype(np.uint32)))
    return np.unique(np.concatenate(found))


def _mark(shingles: int, whole: int, kept: np.ndarray) -> str:
    return f"{shingles}:{whole:016x}:{base64.b64encode(kept.astype('<u4').tobytes()).decode()}"


def fingerprint(text: str, kept: np.ndarray | None = None) -> str:
    shingles = 0 if not text else max(1, len(text) - WIDTH + 1)
    whole = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return _mark(shingles, int.from_bytes(whole, "little"), sketch(text) if kept is None else kept)


def values(mark: str) -> np.ndarray:
    """The sketch that a fingerprint holds."""
    return np.frombuffer(base64.b64decode(mark.split(":")[2]), "<u4")


def merged(*marks: str) -> str:
    """Fingerprint of texts taken together; shingle numbers and hashes of whole texts add up."""
    fields = [m.split(":") for m in marks]
    kept = np.unique(np.concatenate([values(m) for m in marks]))
    return _mark(sum(int(f[0]) for f in fields), sum(int(f[1], 16) for f in fields) % (1 << 64), kept)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the first one's shingles that the second has; 0 if the first retains none."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 0.0


def likeness(one: str, other: str, a: np.ndarray | None = None, b: np.ndarray | None = None) -> float:
    """Containment of the smaller sketch in the larger, from 0 to 1; 1 for equal texts.

    The standard error is sqrt(3 c (1 - c) / n) for a containment c of n distinct shingles. A sketch without
    hashes gives 0; a text of n distinct shingles has none with chance 0.75^n.
    """
    if one == other:
        return 1.0
    a, b = values(one) if a is None else a, values(other) if b is None else b
    return containment(a, b) if len(a) <= len(b) else containment(b, a)


def edited(text: str, other: str) -> str:
    """``text`` with its second half (rounded down) replaced by as many first code points of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edit with the next document and how alike they are.

    The next document is the one below in id order, after the last the first; NULL ids come last,
    repeated ids by text. NULL text is empty. Texts of any length are taken in stretches, other columns are
    not looked at. Texts are shuffled once: ranges of ids are fixed
    from their quantiles, and the first document of each range also goes to the range before it.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    keyed = spread(docs).withColumn("_key", F.coalesce("doc_id", F.lit(lowest)))
    number = partitions(spark)
    cuts = keyed.stat.approxQuantile("_key", [k / number for k in range(1, number)], 0.2 / number) if number > 1 else []
    bounds = np.unique(np.array(cuts, np.float64)).astype(np.int64)

    def slots(keys: np.ndarray) -> np.ndarray:
        return len(bounds) - np.searchsorted(bounds, keys, "left")  # the highest ids first

    def firsts(batches):
        for batch in batches:
            keys = batch.column("_key").to_numpy(zero_copy_only=False)
            slot = slots(keys)
            top = {int(s): int(keys[slot == s].max()) for s in np.unique(slot)}
            yield pa.RecordBatch.from_pydict({"slot": list(top), "top": list(top.values())}, schema=pa.schema([("slot", pa.int64()), ("top", pa.int64())]))

    # one row per range
    tops = keyed.select("_key").mapInArrow(firsts, "slot long, top long").groupBy("slot").agg(F.max("top").alias("top")).collect()
    tops = sorted((r["slot"], r["top"]) for r in tops)
    before = {top: tops[k - 1][0] for k, (_, top) in enumerate(tops)}

    def dealt(batches):
        for batch in batches:
            keys = batch.column("_key").to_numpy(zero_copy_only=False)
            extra = [i for i, k in enumerate(keys.tolist()) if k in before]
            rows = np.concatenate([np.arange(len(keys)), np.array(extra, np.int64)]).astype(np.int64)
            slot = np.concatenate([slots(keys), np.array([before[int(keys[i])] for i in extra], np.int64)])
            after = np.concatenate([np.zeros(len(keys), np.int8), np.ones(len(extra), np.int8)])
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot, pa.int32()), pa.array(after, pa.int8()), *(taken.column(c) for c in ("doc_id", "_key", "text"))],
                names=["_slot", "_after", "doc_id", "_key", "text"],
            )

    def marked(batches):
        waiting = None  # (slot, doc_id, text, sketch) whose next document is still to come
        rows: list[tuple] = []
        for batch in batches:
            slots_, after = batch.column("_slot").to_pylist(), batch.column("_after").to_pylist()
            for slot, late, doc_id, text in zip(slots_, after, batch.column("doc_id").to_pylist(), text_of(batch), strict=True):
                if late and waiting is None:
                    continue  # a further row with the id of the first of the next range
                kept = sketch(text)
                if waiting is not None:
                    rows.append(_compared(*waiting[1:], text, kept))
                waiting = None if late else (slot, doc_id, text, kept)
            if rows:
                yield _rows(rows)
                rows = []

    moved = keyed.mapInArrow(dealt, "_slot int, _after byte, doc_id long, _key long, text string")
    return (
        moved.repartitionById(max(number, len(bounds) + 1), "_slot")
        .sortWithinPartitions("_slot", "_after", F.desc("_key"), "text")
        .mapInArrow(marked, SCHEMA)
    )


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(doc_id, text: str, kept: np.ndarray, following: str, following_kept: np.ndarray) -> tuple:
    changed = edited(text, following)
    changed_kept = sketch(changed)
    own, its, nexts = fingerprint(text, kept), fingerprint(changed, changed_kept), fingerprint(following, following_kept)
    return (
        doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, its,
        likeness(own, its, kept, changed_kept), likeness(own, nexts, kept, following_kept),
    )


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
