"""Packing documents into sequences: large items matched in pairs, small ones best-fit into the gaps.

Lengths are whole numbers up to the capacity, so the packing is decided on the histogram of lengths
(at most ``capacity`` numbers) and every piece then finds its place from its rank among the pieces
of its length. The result is that of packing piece by piece, without a task that sees all pieces.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..session import broadcast_if_small
from .common import free_names, parts_of, quoted, released, saved, spread, text_of
from .encoding import KNOWN_WORDS, STRETCH, encoder, forget


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, remember: int = KNOWN_WORDS, stretch: int = STRETCH
) -> DataFrame:
    """Token ids of every whole text plus ``end_id``, cut only where longer than ``capacity``.

    Columns doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit). NULL text is
    empty: one piece with the end id. A longer document has full pieces; its first may be shorter.
    Repeated rows give repeated pieces. ``remember`` bounds the words a worker keeps between tasks,
    ``stretch`` the text it holds as words and ids at a time: more take memory, fewer take time.
    """

    def cut(batches):
        own = encoder(tokenizer, remember, stretch)
        end = int(end_id).to_bytes(4, "little")
        kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
        for batch in batches:
            for part in parts_of(batch, stretch):
                rows: list[tuple] = []
                for doc_id, data in zip(part.column("doc_id").to_pylist(), own.encode(text_of(part)), strict=True):
                    data += end
                    n = len(data) // 4
                    first = n if n <= capacity else n % capacity or capacity
                    at, piece = 0, 0
                    while at < n:
                        stop = first if piece == 0 else at + capacity
                        rows.append((doc_id, piece, at, stop - at, data[4 * at : 4 * stop]))
                        at, piece = stop, piece + 1
                if rows:
                    made = [pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)]
                    del rows
                    yield pa.RecordBatch.from_arrays(made, names=[n for n, _ in kinds])

    return spread(docs).mapInArrow(released(cut), "doc_id long, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for ``counts`` pieces of each length, as (length, first rank, end rank, first bin, per bin, offset).

    The piece of rank r goes to bin ``first bin + (r - first rank) // per bin``. Lengths over a third of
    the capacity are matched first: the longest with the longest that still fits beside it, at most two
    in a bin. Then lengths descend, each piece going to the tightest gap that holds it.
    """
    left = {s: c for s, c in counts.items() if c > 0}
    taken = dict.fromkeys(left, 0)
    steps: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of bins (first, number)
    bins = 0

    def put(size: int, number: int, first_bin: int, per_bin: int, offset: int) -> None:
        steps.append((size, taken[size], taken[size] + number, first_bin, per_bin, offset))
        taken[size] += number
        left[size] -= number

    def open_gap(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                bisect.insort(order, gap)
            gaps.setdefault(gap, []).append((first, number))

    order: list[int] = []
    large = sorted(s for s in left if 3 * s > capacity)
    for size in reversed(large):
        while left[size]:
            fitting = [t for t in large[: bisect.bisect_right(large, min(size, capacity - size))] if left[t]]
            mate = fitting[-1] if fitting else None
            if mate == size and left[size] == 1:
                mate = fitting[-2] if len(fitting) > 1 else None
            if mate is None:
                number = left[size]
                put(size, number, bins, 1, 0)
                open_gap(capacity - size, bins, number)
            elif mate == size:
                number = left[size] // 2
                put(size, 2 * number, bins, 2, 0)
                open_gap(capacity - 2 * size, bins, number)
            else:
                number = min(left[size], left[mate])
                put(size, number, bins, 1, 0)
                put(mate, number, bins, 1, size)
                open_gap(capacity - size - mate, bins, number)
            bins += number
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect.bisect_left(order, size)
            if at == len(order):
                per = capacity // size
                number = -(-left[size] // per)
                open_gap(capacity, bins, number)
                bins += number
                continue
            gap = order[at]
            first, number = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            per = gap // size
            full = min(number, left[size] // per)
            if full:
                put(size, full * per, first, per, capacity - gap)
                open_gap(gap - per * size, first, full)
            if full < number:
                rest = left[size]
                if rest:
                    put(size, rest, first + full, rest, capacity - gap)
                    open_gap(gap - rest * size, first + full, 1)
                    full += 1
                open_gap(gap, first + full, number - full)
    return steps


def pack(items: DataFrame, capacity: int, free: bool = False) -> DataFrame:
    """``items`` (any columns, one of them ``length`` from 1 to ``capacity``) with sequence_id and offset.

    Sequences are numbered from 0 and filled without holes from offset 0. Input columns of those two
    names are replaced. Equal rows take different places. Only the histogram of lengths reaches the driver.
    ``free`` drops what workers remember of a tokenizer before they rank; an encoder used again must then learn anew.
    """
    # written first, so that the workers that make the items are not also those that rank them
    items = saved(items.drop("sequence_id", "offset"), "pack-pieces")
    names = items.columns
    part_, rank_, number, shift = free_names(items, "part", "rank", "n", "before")

    def numbered(batches):
        from pyspark import TaskContext

        if free:
            forget()
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            size = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            if len(size) and not 0 < size.min() <= size.max() <= capacity:
                raise ValueError(f"lengths must lie between 1 and {capacity}")
            order = np.argsort(size, kind="stable")
            own = np.empty(len(size), np.int64)
            own[order] = np.arange(len(size)) - np.searchsorted(size[order], size[order])
            rank = own + seen[size]
            seen += np.bincount(size, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(size), part), pa.int32()), pa.array(rank)], names=[*names, part_, rank_])

    # ranks in two steps: inside each task as the pieces are written again, then shifted by the tasks before
    schema = StructType([*items.schema.fields, StructField(part_, IntegerType()), StructField(rank_, LongType())])
    ranked = saved(items.mapInArrow(released(numbered), schema), "pack-items")
    sizes = ranked.groupBy("length", part_).agg(F.count(F.lit(1)).alias(number))
    before = Window.partitionBy("length").orderBy(part_).rowsBetween(Window.unboundedPreceding, -1)
    offsets = saved(sizes.select("length", part_, number, F.coalesce(F.sum(number).over(before), F.lit(0)).alias(shift)), "pack-sizes")
    histogram = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum(number).alias("n")).collect()}
    steps = sorted(plan(histogram, capacity))
    keys = np.array([(s << 44) | r0 for s, r0, *_ in steps], np.int64)
    table = np.array(steps, np.int64).reshape(-1, 6)
    ranked = (
        ranked.join(broadcast_if_small(offsets.drop(number), 500_000), ["length", part_])
        .withColumn(rank_, F.col(rank_) + F.col(shift)).select(*[F.col(quoted(c)) for c in names], rank_)
    )

    def place(batches):
        for batch in batches:
            size = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(rank_).to_numpy(zero_copy_only=False).astype(np.int64)
            step = table[np.searchsorted(keys, (size << 44) | rank, "right") - 1]
            at = rank - step[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(step[:, 3] + at // step[:, 4]), pa.array(step[:, 5] + at % step[:, 4] * size)],
                names=[*names, "sequence_id", "offset"],
            )

    schema = StructType([*items.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(released(place), schema)
