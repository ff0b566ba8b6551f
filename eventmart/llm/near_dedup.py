"""Near duplicates by MinHash: banded candidates, odd sketches to sift them, full shingle sets to confirm.

Each text has the set of its ``words``-word shingles (words split at ASCII white space, A-Z in
lower case; a shorter text is one shingle; one without words has none and links with nothing).
MinHash samples of the set are cut into bands; texts that agree in a band are candidates. An odd
sketch folds the same samples into a bitmap of parities: the bits set in the XOR of two
bitmaps give the size of the symmetric difference of the samples, precise for similar texts. It
drops candidates far below the threshold, and every link is confirmed on the full sets.

Texts with equal sets are one class before any pair is formed. Candidates are first tied into families:
in each bucket members are compared with one pivot by their sketches, then what still lies in
different families block by block. Inside a family texts are confirmed in the same way, with pivots
and then in blocks whose tasks hold full sets. Blocks give spanning forests, so the number of pairs
written stays linear in the number of texts however large a group of copies is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .common import forest, free_names, partitions, quoted, release, released, saved, spread, text_of, word_hashes
from .components import components
from .encoding import forget

BANDS, ROWS = 32, 5
#: Bits of the odd sketch; samples that differ set about twice as many.
SKETCH_BITS = 512
#: Candidates whose estimate lies this far below the threshold are dropped: six deviations of it.
MARGIN = 0.22
ROUNDS = 2
PIVOTS = 3
BLOCK = 1024
CHUNK = 256
#: Shingles of the texts in a block of confirmation, beside BLOCK texts.
BLOCK_SHINGLES = 1 << 20

_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts."""

    def __init__(self, words: int):
        self._words = words

    def __call__(self, text: str) -> np.ndarray:
        h = word_hashes(text)
        if not len(h):
            return h
        k = min(self._words, len(h))
        out = np.full(len(h) - k + 1, np.uint64(k))
        for j in range(k):
            out = (out ^ h[j : len(h) - k + 1 + j]) * _MIX
            out ^= out >> np.uint64(29)
        return np.unique(out)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """One minimum for each hash function."""
    low = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):
        part = shingles[at : at + 256]
        np.minimum(low, (_A[:, None] * part[None, :] + _B[:, None]).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    rows = low.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = (key ^ rows[:, j]) * _MIX
        key ^= key >> np.uint64(31)
    return key


def odd_sketch(low: np.ndarray) -> bytes:
    """Parity bitmap of the samples, each placed by its function and value."""
    place = (low ^ (np.arange(len(low), dtype=np.uint64) * _MIX)) * _A[0]
    bits = np.bincount((place >> np.uint64(40)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def estimated(odd_bits: np.ndarray) -> np.ndarray:
    """Similarity estimates from the number of set bits in XORed sketches."""
    share = np.minimum(odd_bits, SKETCH_BITS // 2 - 1) * (2 / SKETCH_BITS)
    different = np.log1p(-share) / np.log1p(-2 / SKETCH_BITS)
    return 1 - different / (2 * BANDS * ROWS)


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, class (hash of the set, NULL if empty), bands, odd."""

    def rows(batches):
        forget()
        shingler = Shingler(words)
        for batch in batches:
            out: list[tuple] = []
            for text in text_of(batch):
                s = shingler(text)
                if not len(s):
                    out.append((0, None, None, None))
                    continue
                low = minhashes(s)
                out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), band_keys(low).view(np.int64), odd_sketch(low)))
            n, same, bands, odd = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.binary())],
                names=["doc_id", "n_shingles", "class", "bands", "odd"],
            )

    return docs.mapInArrow(released(rows), "doc_id long, n_shingles long, class binary, bands array<long>, odd binary")


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets reach the threshold.

    Pairs are dealt by (a, chunk of its partners); a task streams the text of ``a`` and then those
    of the partners, so a popular ``a`` takes many tasks and a task holds two sets at a time.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    dealt = saved(
        pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk")),
        "near-dealt",
    )
    texts = _texts(docs, dealt.select(F.explode(F.array("a", "b")).alias("node"))).withColumnRenamed("node", "doc_id")
    first = dealt.select("a", "chunk").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a")
    second = dealt.join(texts.withColumnRenamed("doc_id", "b"), "b")
    rows = first.select("a", "chunk", F.lit(None).cast("long").alias("b"), "text").unionByName(second.select("a", "chunk", "b", "text"))

    def linked(batches):
        shingler, at, own = Shingler(words), None, []
        for batch in batches:
            a, b = [], []
            keys = zip(batch.column("a").to_pylist(), batch.column("chunk").to_pylist(), batch.column("b").to_pylist(), text_of(batch), strict=True)
            for left, chunk, right, text in keys:
                if (left, chunk) != at:
                    at, own = (left, chunk), []
                s = shingler(text)
                if right is None:
                    own.append(s)
                elif any(_similar(x, s, percent) for x in own):
                    a.append(left)
                    b.append(right)
            yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return (
        rows.repartition(partitions(docs.sparkSession), "a", "chunk")
        .sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
        .mapInArrow(released(linked), "a long, b long")
    )


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _cells(members: DataFrame, block: int, shingles: int | None = None) -> DataFrame:
    """(key, kind, i, j, node, side) rows that bring together all members of a key in different components.

    The largest component of a key is cut into blocks that meet only the other members (kind 0,
    sides "o" and "m"); those meet one another block by block (kind 1, their blocks i <= j as side).
    A block has about ``block`` members at most and, if given, so many ``shingles`` (column ``size``) of them.
    """
    size = F.lit(0) if shingles is None else F.col("size")
    sizes = saved(members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("w")), "near-sizes")
    largest = F.struct("n", "component")
    keys = sizes.groupBy("key").agg(
        F.max_by("component", largest).alias("major"), F.max("n").alias("g"), (F.sum("n") - F.max("n")).alias("l"),
        F.max_by("w", largest).alias("gw"), (F.sum("w") - F.max_by("w", largest)).alias("lw"),
    ).filter("l > 0")
    blocks = lambda n, w: F.greatest(F.ceil(F.col(n) / block), F.ceil(F.col(w) / (shingles or 1))).cast("int")
    dealt = members.join(keys, "key").select("key", "node", (F.col("component") == F.col("major")).alias("in_major"), blocks("g", "gw").alias("gs"), blocks("l", "lw").alias("ls"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("in_major"), F.col("gs")).otherwise(F.col("ls"))).cast("int"))
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    own = F.col("block")
    placed = F.when(F.col("in_major"), F.transform(up_to("ls"), lambda k: cell(0, k, own))).otherwise(
        F.concat(F.transform(up_to("gs"), lambda k: cell(0, own, k)), F.transform(up_to("ls"), lambda k: cell(1, F.least(own, k), F.greatest(own, k))))
    )
    each = dealt.select("key", "node", "in_major", "block", F.explode(placed).alias("cell"))
    side = F.when(F.col("cell.kind") == 1, F.col("block")).otherwise(F.when(F.col("in_major"), F.lit(-1)).otherwise(F.lit(-2)))
    return each.select("key", "cell.kind", "cell.i", "cell.j", "node", side.cast("int").alias("side"))


CELL = ["key", "kind", "i", "j"]


def _in_cells(near):
    """A function over one cell: ``near(table)`` prepares it and gives links of row numbers x row numbers."""

    def forest_of(table: pa.Table) -> pa.Table:
        node, side = table.column("node").to_numpy(), table.column("side").to_numpy()
        kind, i, j = (table.column(c)[0].as_py() for c in CELL[1:])
        left, right = (np.flatnonzero(side == s) for s in ((-2, -1) if kind == 0 else (i, j)))
        p, q = np.nonzero(near(table)(left, right)) if len(left) and len(right) else (np.zeros(0, int),) * 2
        label = forest(left[p], right[q], len(node))
        moved = np.flatnonzero(label != np.arange(len(node)))
        if table.nbytes > 1 << 20:
            release()
        return pa.table({"a": node[moved], "b": node[label[moved]]})

    return forest_of


def _sketches_near(percent: int):
    def prepared(table: pa.Table):
        bits = np.frombuffer(b"".join(table.column("odd").to_pylist()), np.uint64).reshape(table.num_rows, -1)
        most = _most_bits(percent)

        def near(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            own = bits[right]
            return np.stack([np.bitwise_count(own ^ bits[k]).sum(axis=1) <= most for k in left])

        return near

    return prepared


def _sets_near(words: int, percent: int):
    def prepared(table: pa.Table):
        shingler = Shingler(words)
        sets = [shingler(t.as_py() or "") for t in table.column("text")]
        sizes = np.array([len(s) for s in sets])

        def near(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            both = np.zeros((len(left), len(right)), np.float32)
            shared = np.intersect1d(np.unique(np.concatenate([sets[k] for k in left])), np.unique(np.concatenate([sets[k] for k in right])), assume_unique=True)
            for at in range(0, len(shared), 4096):
                part = shared[at : at + 4096]
                both += _incidence(sets, left, part) @ _incidence(sets, right, part).T
            every = sizes[left][:, None] + sizes[right][None, :] - both
            return 100 * both.astype(np.float64) >= percent * every.astype(np.float64)

        return near

    return prepared


def _incidence(sets: list[np.ndarray], rows: np.ndarray, part: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(part)), np.float32)
    for k, row in enumerate(rows.tolist()):
        own = sets[row]
        own = own[np.searchsorted(own, part[0]) : np.searchsorted(own, part[-1], "right")]
        at = np.searchsorted(part, own)
        out[k, at[part[at] == own]] = 1
    return out


def _with(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``members`` with the component of their node; a node without label is its own."""
    if labels is None:
        return members.withColumn("component", F.col("node"))
    return saved(members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-known")


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of some documents."""
    involved = broadcast_if_small(saved(nodes.select(F.col("node").alias("doc_id")).distinct(), "near-involved"), 1_000_000)
    return docs.join(involved, "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text")


def _families(members: DataFrame, percent: int) -> DataFrame | None:
    """(node, family): what banding and sketches tie together, directly or through others; None if nothing."""
    labels, ties = None, []
    for turn in range(ROUNDS + 1):
        known = _with(members, labels)
        if turn < ROUNDS:
            draw = F.struct(F.xxhash64("node", F.lit(turn)), "node", "component", "odd")
            pivots = known.groupBy("key").agg(F.min(draw).alias("p"), F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1")
            bits = F.aggregate(
                F.sequence(F.lit(0), F.lit(SKETCH_BITS // 64 - 1)),
                F.lit(0),
                lambda s, k: s + F.bit_count(_word("odd", k).bitwiseXOR(_word("p.odd", k))),
            )
            new = known.join(pivots, "key").filter("component <> p.component").filter(bits <= _most_bits(percent))
            new = new.select(F.col("p.node").alias("a"), F.col("node").alias("b")).distinct()
        else:
            cells = _cells(known, BLOCK).join(members.select("node", "odd").distinct(), "node")
            new = cells.groupBy(*CELL).applyInArrow(_in_cells(_sketches_near(percent)), "a long, b long")
        new = saved(new, "near-ties")
        if new.limit(1).count():
            ties.append(new)
            labels = _joined(ties)
    return labels and labels.withColumnRenamed("component", "family")


def _links(members: DataFrame, families: DataFrame, docs: DataFrame, words: int, percent: int) -> list[DataFrame]:
    """Confirmed links that connect every component inside its family.

    A family is first compared with pivots, at first with the member that shares most buckets; then what
    still lies in different components meets in cells.
    """
    degrees = members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "key").groupBy("node").agg(F.sum("m").alias("degree"), F.first("size").alias("size"))
    people = saved(families.join(degrees, "node").select(F.col("family").alias("key"), "node", "size", "degree"), "near-people")
    labels, links = None, []
    for turn in range(PIVOTS + 1):
        known = _with(people, labels)
        if turn < PIVOTS:
            sizes = known.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("degree", "node")).alias("p"))
            # the first pivot from the largest component, later ones from the largest of the others
            ranked = sizes.groupBy("key").agg(F.max(F.struct("n", "component", "p")).alias("top"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
            if turn:
                rest = sizes.join(ranked.select("key", F.col("top.component").alias("first")), "key").filter("component <> first")
                ranked = rest.groupBy("key").agg(F.max(F.struct("n", "component", "p")).alias("top"))
            pivots = ranked.select("key", F.col("top.component").alias("c"), F.col("top.p.node").alias("a"))
            pairs = saved(known.join(pivots, "key").filter("component <> c").select("a", F.col("node").alias("b")), "near-pairs")
            if pairs.limit(1).count() == 0:
                break
            new = _confirmed(pairs, docs, words, percent)
        else:
            cells = saved(_cells(known, BLOCK, BLOCK_SHINGLES), "near-cells")
            if cells.limit(1).count() == 0:
                break
            cells = cells.join(_texts(docs, cells), "node")
            new = cells.groupBy(*CELL).applyInArrow(_in_cells(_sets_near(words, percent)), "a long, b long")
        new = saved(new, "near-links")
        if new.limit(1).count():
            links.append(new)
            labels = _joined(links)
    return links


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable by links; a row without links has its own. NULL and
    empty texts have no shingles and link with nothing. Rows that share a doc_id are one document for
    links; rows with a NULL doc_id come back with a NULL component_id and kept true, unlinked.
    """
    docs = spread(docs)
    rows = saved(_sketched(docs, words), "near-sketches")
    classes = saved(
        rows.filter("class is not null and doc_id is not null").groupBy("class")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("odd").alias("odd")),
        "near-classes",
    )
    banded = classes.select("node", "size", "odd", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    members = saved(banded.join(shared, "key"), "near-members")

    families = _families(members, percent)
    links = [] if families is None else _links(members, families, docs, words, percent)
    labels = _joined(links) if links else None
    mine = rows.join(classes.select("class", "node"), "class", "left")
    if labels is not None:
        mine = mine.join(labels, "node", "left")
    else:
        mine = mine.withColumn("component", F.col("node"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "node", "doc_id"))
    out = mine.select("doc_id", "n_shingles", component.cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _word(column: str, k) -> "F.Column":
    """64 bits of a bitmap as a number."""
    return F.conv(F.hex(F.substring(F.col(column), k * 8 + 1, F.lit(8))), 16, -10).cast("long")


def _most_bits(percent: int) -> int:
    """The most XOR bits at which a pair is still a candidate."""
    bits = np.arange(SKETCH_BITS // 2)
    return int(bits[estimated(bits) >= percent / 100 - MARGIN].max())


def _joined(links: list[DataFrame]) -> DataFrame:
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    return components(every)


def distinct_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest id; columns unchanged.

    Of rows that repeat an id, one stays (the smallest text). Rows with a NULL id all stay.
    """
    kept_id, number, row = free_names(docs, "kept_id", "n", "row")
    own = F.col("doc_id").cast("long").alias(kept_id)
    found = near_duplicates(docs, words, percent).filter("doc_id is not null and kept").select(own).distinct()
    same = F.col("doc_id").cast("long") == F.col(kept_id)
    rows = docs.join(found, same, "left_semi")
    again = docs.groupBy(own).agg(F.count(F.lit(1)).alias(number)).filter(F.col(kept_id).isNotNull() & (F.col(number) > 1)).select(kept_id)
    if again.limit(1).count():
        # written, so that the grouping does not rely on how the input was partitioned
        repeated = saved(rows.join(again, same, "left_semi"), "near-repeated")
        # all columns decide, so that the choice does not depend on the order of rows
        every = [F.col(quoted(c)) for c in docs.columns]
        single = repeated.groupBy("doc_id").agg(F.min_by(F.struct(*every), F.struct(F.coalesce("text", F.lit("")), *every)).alias(row)).select(f"{row}.*")
        rows = rows.join(again, same, "left_anti").unionByName(single)
    return rows.unionByName(docs.filter("doc_id is null"))
