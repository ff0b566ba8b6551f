"""Exact substring dedup by hash-compared suffix sorting.

A byte goes if it lies in a ``length``-byte string that also starts earlier. Suffixes that can be
equal are first brought together: each string has an anchor, the least hash among its GRAM-byte
pieces (the rightmost on ties), so equal strings have equal anchors at the same place in them. Starts
with the same anchor form a block. Of equal blocks all but the first go as a whole; the first ones of
different blocks around the same anchor are sorted by their suffixes.

The sort is a mergesort whose comparisons use prefix sums of a polynomial: a binary search over hashes
finds the common extension of two suffixes in logarithmic time, and the byte behind it decides.
Suffixes that come out equal are verified byte by byte; a collision sends its group to a plain sort.
Groups that are very large are cut by a hash of their strings before the sort.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .common import partitions, saved, text_of

GRAM = 32
LARGE = 512
BUCKET_BYTES = 1_500_000
_STRETCH = 1 << 19
_SEEN = 300_000
_LOW = -(1 << 63)

_rng = np.random.default_rng(100)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1 = np.uint64(0xFF51AFD7ED558CCD)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < count:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out


class Hashes:
    """Polynomial hashes of all pieces of some bytes: sums of byte values times powers of a base."""

    _up = _down = np.zeros(0, np.uint64)

    def __init__(self, data: np.ndarray):
        if len(Hashes._up) <= len(data):
            Hashes._up, Hashes._down = _powers(_BASE, len(data) + 1), _powers(_INVERSE, len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * Hashes._up[: len(data)], out=self._sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self._sums[start + length] - self._sums[start]) * Hashes._down[start]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M1
    return h ^ (h >> np.uint64(29))


def blocks(data: np.ndarray, length: int):
    """(anchor hash, block hash, first start, number of starts, anchor's place in the first string) arrays."""
    found = []
    for at in range(0, max(0, len(data) - length + 1), _STRETCH):
        part = data[at : at + _STRETCH + length - 1]
        hashes = Hashes(part)
        grams = _mixed(hashes.of(np.arange(len(part) - GRAM + 1), GRAM))
        place = np.arange(len(grams), dtype=np.uint64)
        low = (grams & ~np.uint64((1 << 20) - 1)) | (np.uint64((1 << 20) - 1) - place)
        width, size = length - GRAM + 1, 1
        while 2 * size <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < width:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        anchor = (np.uint64((1 << 20) - 1) - (low & np.uint64((1 << 20) - 1))).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        number = np.diff(np.append(first, len(anchor)))
        inside = anchor[first] - first
        whole = _mixed(hashes.of(first, number + length - 1) + np.uint64(7) * number.astype(np.uint64)) ^ _mixed(inside.astype(np.uint64))
        found.append((grams[anchor[first]], whole, first + at, number, inside))
    return [np.concatenate(x) for x in zip(*found)] if found else None


# --- the suffix sort -------------------------------------------------------------------------------


def _extension(hashes: Hashes, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Length of the common extension of suffixes at ``a`` and ``b``, up to ``length``."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), length)
    while (low < high).any():
        middle = (low + high + 1) >> 1
        same = hashes.of(a, middle) == hashes.of(b, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def _before(data: np.ndarray, hashes: Hashes, a: np.ndarray, b: np.ndarray, length: int, ties: bool) -> np.ndarray:
    """Whether the suffix at ``a`` sorts before that at ``b``; equal ones count as ``ties``."""
    common = _extension(hashes, a, b, length)
    behind = np.minimum(common, length - 1)
    return np.where(common == length, ties, data[a + behind] < data[b + behind])


def suffix_sorted(data: np.ndarray, hashes: Hashes, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Order of ``starts`` by group (ascending as given) and then by suffix; equal suffixes keep their order.

    Bottom-up mergesort over all groups at once: each pass places every element by counting, with a
    binary search of suffix comparisons, how many of the neighbouring run go before it.
    """
    n = len(starts)
    order = np.arange(n)
    edge = np.searchsorted(group, np.arange(group[-1] + 2)) if n else np.zeros(1, np.int64)
    first, end = edge[group], edge[group + 1]
    width = 1
    while n and width < (end - first).max():
        place = np.arange(n)
        run = first + (place - first) // width * width
        odd = (place - first) // width % 2 == 1
        other = np.where(odd, run - width, run + width)
        other_end = np.minimum(other + width, end)
        busy = np.flatnonzero(other < end)
        low, high = other[busy].copy(), other_end[busy].copy()
        mine = starts[order[busy]]
        late = odd[busy]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            theirs = starts[order[middle]]
            # a later run's element goes behind equal ones of the earlier run
            goes = np.where(
                late[open_],
                _before(data, hashes, theirs, mine[open_], length, True),
                _before(data, hashes, theirs, mine[open_], length, False),
            )
            low[open_], high[open_] = np.where(goes, middle + 1, low[open_]), np.where(goes, high[open_], middle)
        target = place.copy()
        target[busy] = np.where(late, run[busy] - width, run[busy]) + (place[busy] - run[busy]) + (low - other[busy])
        new = np.empty(n, np.int64)
        new[target] = order
        order = new
        width *= 2
    return order


def repeats(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which of ``starts`` (by group, earliest first inside a group) repeat the string of an earlier one of their group."""
    hashes = Hashes(data)
    order = suffix_sorted(data, hashes, starts, group, length)
    a, b = order[:-1], order[1:]
    same = (group[a] == group[b]) & (_extension(hashes, starts[a], starts[b], length) == length)
    out = np.zeros(len(starts), bool)
    out[b[same]] = True
    reach = np.arange(length)
    for at in range(0, int(same.sum()), 50_000):
        x, y = a[same][at : at + 50_000], b[same][at : at + 50_000]
        wrong = (data[starts[x][:, None] + reach] != data[starts[y][:, None] + reach]).any(axis=1)
        for g in np.unique(group[x[wrong]]).tolist():  # a collision of hashes
            seen: set[bytes] = set()
            for k in np.flatnonzero(group == g).tolist():
                string = data[starts[k] : starts[k] + length].tobytes()
                out[k] = string in seen
                seen.add(string)
    return out


# --- documents -------------------------------------------------------------------------------------


def _found(docs: DataFrame, length: int) -> DataFrame:
    """Blocks of all documents: kind 0 to be compared, kind 1 repeated inside the same task already."""

    def rows(batches):
        seen: dict[int, tuple] = {}
        for batch in batches:
            out: list[tuple] = []
            for d, e, text in zip(batch.column("d").to_pylist(), batch.column("e").to_pylist(), text_of(batch), strict=True):
                data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
                got = blocks(data, length) if len(data) >= length else None
                if got is None:
                    continue
                if len(seen) > _SEEN:
                    seen.clear()
                anchor, whole, first, number, inside = (x.view(np.int64).tolist() for x in got)
                open_ = None
                for h, b, p, q, i in zip(anchor, whole, first, number, inside):
                    mine, known = (d, e, p), seen.get(b)
                    if known is not None and known < mine:
                        if open_ and open_[1] >= p:
                            open_[1] = p + q + length - 1
                        else:
                            if open_:
                                out.append((1, h, 0, d, e, open_[0], open_[1]))
                            open_ = [p, p + q + length - 1]
                        continue
                    seen[b] = mine
                    out.append((0, h, b, d, e, p, q << 8 | i))
                if open_:
                    out.append((1, anchor[0], 0, d, e, open_[0], open_[1]))
            if out:
                yield _batch(out, ["kind", "h", "b", "d", "e", "p", "m"])

    return docs.mapInArrow(rows, "kind int, h long, b long, d long, e long, p long, m long")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32() if n == "kind" else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _told_apart(found: DataFrame, length: int) -> DataFrame:
    """Kind 1: bytes p..m go; kind 2: first ones of blocks whose anchor has different blocks."""

    def rows(batches):
        last_h = last_b = None
        pending, before = None, 0  # first one of the only block so far, number of different blocks of the last anchor
        names = ["kind", "h", "b", "d", "e", "p", "m"]
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, h, b, d, e, p, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in names)
            old = kind == 1
            new_h = np.empty(len(h), bool)
            new_b = np.empty(len(h), bool)
            new_h[1:] = (h[1:] != h[:-1]) | old[1:] != old[:-1]
            new_b[1:] = (b[1:] != b[:-1]) | new_h[1:]
            new_h[0] = h[0] != last_h or bool(old[0])
            new_b[0] = b[0] != last_b or new_h[0]
            again = ~new_b & ~old
            first = np.flatnonzero(new_b & ~old)
            # groups of anchors; group 0 goes on from the batch before
            group = np.cumsum(new_h)
            counts = np.bincount(group[first], minlength=int(group[-1]) + 1)
            carried = pending if not new_h[0] else None
            counts[0] += 0 if new_h[0] else before
            out = [np.stack([np.full(n.sum(), 1), h[n], b[n], d[n], e[n], p[n], s[n]]) for n, s in ((old, m), (again, p + (m >> 8) + length - 1))]
            many = first[counts[group[first]] > 1]
            out.append(np.stack([np.full(len(many), 2), h[many], b[many], d[many], e[many], p[many], m[many]]))
            if carried is not None and counts[0] > 1:
                out.append(np.array([[2], *[[x] for x in carried]]))
                carried = None
            if old[-1]:
                last_h = last_b = pending = None
                before = 0
            else:
                last_h, last_b = h[-1], b[-1]
                own = first[group[first] == group[-1]]
                before = int(counts[group[-1]])
                if before > 1:
                    pending = None
                elif len(own):
                    k = own[-1]
                    pending = (h[k], b[k], d[k], e[k], p[k], m[k])
                else:
                    pending = carried
            table = np.concatenate(out, axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "kind" else pa.int64()) for n, c in zip(names, table)], names=names)

    dealt = found.repartition(partitions(found.sparkSession), "h").sortWithinPartitions("kind", "h", "b", "d", "e", "p")
    return dealt.mapInArrow(rows, "kind int, h long, b long, d long, e long, p long, m long")


def _texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents named in ``keys`` (d, e)."""
    return docs.join(broadcast_if_small(saved(keys.distinct(), "repeat-keys"), 1_000_000), ["d", "e"], "left_semi")


def _sorted_apart(docs: DataFrame, told: DataFrame, length: int) -> DataFrame:
    """Bytes (d, e, p, m) that go because their string repeats in another block around the same anchor."""
    some = told.filter("kind = 2").select("h", "d", "e", "p", "m")
    sizes = some.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("m") / 256).cast("long") + length - 1).alias("bytes"))
    sizes = saved(sizes, "repeat-anchors")
    totals = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    buckets = max(partitions(docs.sparkSession), int(totals["bytes"]) // BUCKET_BYTES)
    large = broadcast_if_small(sizes.filter(F.col("n") > LARGE).select("h", F.lit(True).alias("large")))
    named = some.join(large, "h", "left").groupBy("d", "e").agg(F.collect_list(F.struct("h", "p", "m", F.coalesce("large", F.lit(False)).alias("large"))).alias("parts"))
    named = saved(named, "repeat-parts")

    def cut(batches):
        for batch in batches:
            out: list[tuple] = []
            keys = zip(batch.column("d").to_pylist(), batch.column("e").to_pylist(), text_of(batch), batch.column("parts").to_pylist(), strict=True)
            for d, e, text, parts in keys:
                data = text.encode("utf-8", "replace")
                for part in parts:
                    h, p, q, i = part["h"], part["p"], part["m"] >> 8, part["m"] & 255
                    if not part["large"]:
                        out.append((h % buckets, h, d, e, p, q << 8 | i, data[p : p + q + length - 1]))
                        continue
                    for k in range(q):  # cut by content: equal strings stay together
                        string = data[p + k : p + k + length]
                        route = int.from_bytes(hashlib.blake2b(string, digest_size=7).digest(), "little")
                        out.append((route % buckets, h, d, e, p + k, 1 << 8 | (i - k), string))
            if out:
                kinds = [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["bucket", "h", "d", "e", "p", "m", "data"])

    def compared(table: pa.Table) -> pa.Table:
        h, d, e, p, m = (table.column(c).to_numpy() for c in ("h", "d", "e", "p", "m"))
        parts = table.column("data").to_pylist()
        data = np.frombuffer(b"".join(parts), np.uint8)
        size = np.array([len(x) for x in parts], np.int64)
        number = m >> 8
        row = np.repeat(np.arange(len(h)), number)
        step = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
        start, place = (np.cumsum(size) - size)[row] + step, p[row] + step
        inside = (m & 255)[row] - step
        order = np.lexsort((place, e[row], d[row], inside, h[row]))
        row, start, place, inside = row[order], start[order], place[order], inside[order]
        fresh = np.concatenate([[True], (h[row][1:] != h[row][:-1]) | (inside[1:] != inside[:-1])])
        group = np.cumsum(fresh) - 1
        paired = np.bincount(group)[group] > 1
        row, start, place, group = row[paired], start[paired], place[paired], group[paired]
        if not len(row):
            return pa.table({c: np.zeros(0, np.int64) for c in "depm"})
        group = np.cumsum(np.concatenate([[False], group[1:] != group[:-1]]))
        gone = repeats(data, start, group, length)
        d, e, place = d[row[gone]], e[row[gone]], place[gone]
        order = np.lexsort((place, e, d))
        d, e, place = d[order], e[order], place[order]
        # neighbouring starts become one stretch
        first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (e[1:] != e[:-1]) | (place[1:] > place[:-1] + length)])) if len(d) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(d)) - 1 if len(d) else first
        return pa.table({"d": d[first], "e": e[first], "p": place[first], "m": place[last] + length})

    wide = _texts_of(docs, named.select("d", "e")).join(named, ["d", "e"]).select("d", "e", "text", "parts")
    rows = wide.mapInArrow(cut, "bucket long, h long, d long, e long, p long, m long, data binary")
    return rows.groupBy("bucket").applyInArrow(compared, "d long, e long, p long, m long")


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, text (bytes left), n_bytes, n_removed, n_spans of every row of ``docs``.

    A byte goes if it lies in a string of ``length`` bytes that also starts at a smaller doc_id, or earlier in the
    same document; matches do not cross documents. NULL text is empty, a NULL doc_id is smaller than all others.
    Rows that repeat an id are ordered by a hash of their text; rows equal in both are one document and come
    back alike. ``length`` is at least GRAM and at most 255.
    """
    if not GRAM <= length <= 255:
        raise ValueError(f"length must lie between {GRAM} and 255")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = F.coalesce("doc_id", F.lit(_LOW))
    again = slim.groupBy(key.alias("d")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    own = F.xxhash64(F.coalesce("text", F.lit(""))) if again else F.lit(0).cast("long")
    slim = slim.select("doc_id", "text", key.alias("d"), own.alias("e"))
    told = saved(_told_apart(_found(slim.select("d", "e", "text"), length), length), "repeat-told")
    gone = told.filter("kind = 1").select("d", "e", "p", "m")
    if told.filter("kind = 2").limit(1).count():
        gone = gone.unionByName(_sorted_apart(slim.select("d", "e", "text"), told, length))
    spans = saved(gone.groupBy("d", "e").agg(F.collect_list(F.struct("p", "m")).alias("spans")), "repeat-spans")

    def kept(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), text_of(batch), batch.column("spans").to_pylist(), strict=True):
                data = text.encode("utf-8", "replace")
                left, at, runs = [], 0, 0
                for p, m in sorted((s["p"], s["m"]) for s in spans or ()):
                    if p > at or not runs:
                        left.append(data[at:p])
                        runs += 1
                        at = m
                    else:
                        at = max(at, m)
                left.append(data[at:])
                rest = b"".join(left)
                out.append((doc_id, rest, len(data), len(data) - len(rest), runs))
            if out:
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "text", "n_bytes", "n_removed", "n_spans"])

    keys = broadcast_if_small(saved(spans.select("d", "e"), "repeat-keys"), 1_000_000)
    touched = slim.join(keys, ["d", "e"], "left_semi").join(spans, ["d", "e"]).select("doc_id", "text", "spans")
    rest = slim.join(keys, ["d", "e"], "left_anti").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    schema = "doc_id long, text binary, n_bytes long, n_removed long, n_spans long"
    return touched.mapInArrow(kept, schema).unionByName(rest.mapInArrow(kept, schema))
