"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosine, components.

Each table hashes a vector to the signs of its products with a few random hyperplanes; vectors that
share a bucket in any table are compared exactly. Bits grow with the logarithm of the number of
vectors, so buckets keep their size, and the number of tables follows from the chance of missing a
pair right at the threshold. Equal vectors are one class first. Buckets are compared in blocks of
bounded size; a block gives, per vector, the number of its partners that no earlier table
has counted, and a spanning forest of the links, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forest, saved
from .components import components

BUCKET = 64
MISS = 1e-5
BLOCK = 4096
_ROWS = 256


def layout(vectors: int, threshold: float) -> tuple[int, int]:
    """(tables, bits): buckets of about BUCKET unrelated vectors, pairs at the threshold missed with chance MISS."""
    bits = max(8, math.ceil(math.log2(max(1, vectors / BUCKET))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(MISS) / math.log1p(-same)), bits


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors scaled to length one in double precision; None where no cosine is defined."""
    out = []
    for value in column.to_pylist():
        if not value or any(x is None for x in value):
            out.append(None)
            continue
        x = np.array(value, np.float64)
        top = np.abs(x).max()
        out.append(None if not np.isfinite(x).all() or top == 0 else x)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def _classes(vectors: DataFrame) -> DataFrame:
    """vec_id, class (hash of the vector, NULL where it has no direction) and vec (doubles)."""

    def rows(batches):
        for batch in batches:
            found = _vectors(batch.column("embedding"))
            data = [None if x is None else x.tobytes() for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([d and xxhash.xxh3_128_digest(d) for d in data], pa.binary()), pa.array(data, pa.binary())],
                names=["vec_id", "class", "vec"],
            )

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(rows, "vec_id long, class binary, vec binary")


def _hashed(classes: DataFrame, tables: int, bits: int) -> DataFrame:
    """Classes with ``keys``, a bucket for each table; vectors of another length have other buckets."""

    def rows(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            data = batch.column("vec").to_pylist()
            keys = np.zeros((len(data), tables), np.int64)
            for size in {len(d) for d in data}:
                some = [i for i, d in enumerate(data) if len(d) == size]
                if size not in planes:
                    planes[size] = np.random.default_rng([11, size]).standard_normal((size // 8, tables * bits))
                x = np.frombuffer(b"".join(data[i] for i in some), np.float64).reshape(len(some), -1)
                signs = (_unit(x) @ planes[size] > 0).reshape(len(some), tables, bits)
                keys[some] = signs @ (1 << np.arange(bits)) + (size << 32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.tolist(), pa.list_(pa.int64()))], names=[*batch.schema.names, "keys"])

    return classes.mapInArrow(rows, "class binary, node long, n long, vec binary, keys array<long>")


def _compared(threshold: float):
    def cell(group: pa.Table) -> pa.Table:
        t, i, j = (group.column(c)[0].as_py() for c in ("t", "i", "j"))
        block = group.column("block").to_numpy()
        x = _unit(np.frombuffer(b"".join(group.column("vec").to_pylist()), np.float64).reshape(len(block), -1))
        keys = group.column("keys").combine_chunks().flatten().to_numpy().reshape(len(block), -1)
        node, weight = group.column("node").to_numpy(), group.column("n").to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links = np.zeros(len(block), np.int64)
        a, b = [], []
        for at in range(0, len(left), _ROWS):
            rows = left[at : at + _ROWS]
            near = x[rows] @ x[right].T >= threshold
            if i == j:
                near &= rows[:, None] < right[None, :]
            for earlier in range(t):
                if not near.any():
                    break
                near &= keys[rows, earlier][:, None] != keys[right, earlier][None, :]
            links[rows] += near @ weight[right]
            links[right] += weight[rows] @ near
            p, q = np.nonzero(near)
            if len(p):
                own = np.concatenate([rows, right])
                label = forest(p, q + len(rows), len(own))
                moved = np.flatnonzero(label != np.arange(len(own)))
                a.append(node[own[moved]])
                b.append(node[own[label[moved]]])
        some = np.flatnonzero(links)
        a.append(np.full(len(some), -1))
        b.append(links[some])
        marks = pa.array([None] * (sum(map(len, a)) - len(some)) + [group.column("class")[int(k)].as_py() for k in some], pa.binary())
        return pa.table({"a": np.concatenate(a).astype(np.int64), "b": np.concatenate(b).astype(np.int64), "class": marks})

    return cell


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding).

    n_links counts the other rows whose cosine is at least ``threshold``; component_id is the smallest
    vec_id reachable. Vectors that are NULL, empty, zero or hold NULL or non-finite
    components link with nothing, nor do vectors of different lengths. Rows that share a vec_id are
    one node for components. A row with a NULL vec_id links with nothing: NULL component_id, kept.
    """
    rows = saved(_classes(vectors), "vec-rows")
    valid = rows.filter("class is not null and vec_id is not null")
    classes = saved(
        valid.groupBy("class").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec")),
        "vec-classes",
    )
    tables, bits = layout(classes.count(), threshold)
    hashed = saved(_hashed(classes, tables, bits), "vec-hashed")
    slots = hashed.select("class", F.posexplode("keys").alias("t", "key"))
    buckets = saved(slots.groupBy("t", "key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "vec-buckets")
    placed = slots.join(buckets, ["t", "key"]).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.join(hashed, "class").select(
        "t", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class", "node", "n", "vec", "keys"
    )
    found = saved(cells.groupBy("t", "key", "i", "j").applyInArrow(_compared(threshold), "a long, b long, class binary"), "vec-found")

    counts = found.filter("class is not null").groupBy("class").agg(F.sum("b").alias("others"))
    own = classes.join(counts, "class", "left").select("class", "node", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    # rows that share an id tie their classes together
    shared = valid.join(classes.select("class", "node"), "class").filter("vec_id <> node").select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    repeated = valid.groupBy("vec_id").agg(F.min("class").alias("low"), F.max("class").alias("top")).filter("low <> top").select("vec_id")
    links = found.filter("class is null").select("a", "b").unionByName(shared.join(repeated, shared.a == repeated.vec_id, "left_semi"))
    labels = components(links)
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("class")).alias("class")).join(own, "class", "left").join(labels, "node", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "node", "vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
