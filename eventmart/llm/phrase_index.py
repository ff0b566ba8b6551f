"""Benchmark decontamination with a distributed positional inverted index.

The index is dealt by documents: every block of documents has its own sorted terms and, for each of
them, the places where it occurs. Queries (phrases) are stored in batches; a task that holds a block
runs batch after batch against it. Of each phrase the term with the fewest postings of the block
gives the possible places, the other terms are intersected from the next rarest on, each list moved
by the term's offset in the phrase. A phrase with a term the block lacks ends at once.

Terms are compared as whole byte strings, so every match is exact; nothing is hashed, cut or capped.
Blocks and batches are files below the shared checkpoint folder, under names no other attempt of a
task uses; the tables returned name the files of the attempts that count.

Words are the maximal runs of ASCII letters and digits and of all characters beyond ASCII, after A-Z
were lower-cased. NULL, empty and wordless texts are documents or items without words. Repeated ids
and repeated rows stay separate documents; items with one id count once per document, a NULL item id
reads as empty text. Empty tables give empty indexes and results. Other columns of either table are not looked at,
so their names cannot clash. Long texts are split into words in stretches and never leave their block.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import run_dir
from .common import filesystem, partitions, saved

#: Words of a block: 4 MB of places and as much again while it is sorted. A longer text is a block of its own.
BLOCK_WORDS = 1 << 20
BLOCK_DOCUMENTS = 1 << 16
#: Places left free between documents, so that no phrase reaches from one into the next.
GAP = 64
#: Phrases of a batch, and possible places that are looked at together.
BATCH_PHRASES = 100_000
CANDIDATES = 1 << 21
#: Bytes of a text that are split into words at once.
STRETCH = 1 << 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")
_ANY, _MISSING = -1, -2


class _Numbers(dict):
    """Numbers words in the order of their first appearance."""

    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def word_numbers(text: bytes | None, numbers: dict) -> np.ndarray:
    """The words of a UTF-8 text as numbers of ``numbers``."""
    data, at, out = (text or b"").lower(), 0, [np.zeros(0, np.int32)]  # bytes: lowers A-Z only
    while at < len(data):
        end = min(at + STRETCH, len(data))
        if end < len(data):
            found = _BREAK.search(data, end)
            end = found.start() if found else len(data)
        out.append(np.array(list(map(numbers.__getitem__, _WORD.findall(data, at, end))), np.int32))
        at = end
    return np.concatenate(out)


def _store(path: str, columns: dict) -> None:
    system, place = filesystem(path)
    table = pa.table(columns)
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with system.open_output_stream(place) as out, pa.ipc.new_file(out, table.schema, options=options) as writer:
        writer.write_table(table)


def _load(path: str) -> pa.Table:
    system, place = filesystem(path)
    with system.open_input_file(place) as source:
        return pa.ipc.open_file(source).read_all().combine_chunks()


def _new_file(folder: str) -> str:
    system, place = filesystem(folder)
    system.create_dir(place, recursive=True)
    return f"{folder}/{uuid.uuid4().hex}"


# ---- the index ----------------------------------------------------------------------


def build_index(docs: DataFrame) -> DataFrame:
    """Store the postings of ``docs`` (doc_id, text); returns (path, documents, words), one row per block.

    No shuffle: each task indexes the documents it reads, in blocks of at most ``BLOCK_WORDS`` words
    and one text. ``search`` and ``contamination`` take the table returned, as often as wanted.
    """
    spark = docs.sparkSession
    folder = run_dir(spark, "phrase-index")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, numbers = [], [], 0, _Numbers()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = word_numbers(text.as_py(), numbers)
                ids.append(doc_id)
                texts.append(words)
                size += len(words)
                if size >= BLOCK_WORDS or len(ids) >= BLOCK_DOCUMENTS:
                    yield _stored_block(folder, ids, texts, numbers)
                    ids, texts, size, numbers = [], [], 0, _Numbers()
        if ids:
            yield _stored_block(folder, ids, texts, numbers)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return saved(slim.mapInArrow(blocks, "path string, documents long, words long"), "phrase-blocks")


def _stored_block(folder: str, ids: list, texts: list[np.ndarray], numbers: dict) -> pa.RecordBatch:
    sizes = np.array([len(t) for t in texts], np.int64)
    tokens = np.concatenate(texts)
    firsts = GAP + np.cumsum(sizes + GAP) - sizes - GAP
    places = np.arange(len(tokens)) + np.repeat(firsts - (np.cumsum(sizes) - sizes), sizes)
    order = np.argsort(tokens, kind="stable")
    places, tokens = places[order], tokens[order]
    counts = np.bincount(tokens, minlength=len(numbers))
    ends = np.cumsum(counts)
    steps = np.diff(places, prepend=0)
    steps[ends[:-1]] = places[ends[:-1]]  # the first place of a term is absolute
    postings = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(steps.astype(np.uint32)))
    path = _new_file(folder)
    _store(f"{path}.terms", {"term": pa.array(list(numbers), pa.binary()), "steps": postings})
    _store(f"{path}.documents", {"doc_id": pa.array(ids, pa.int64()), "first": firsts, "words": sizes})
    return pa.RecordBatch.from_pydict({"path": [path], "documents": [len(ids)], "words": [len(tokens)]})


class Block:
    """One block of the index in memory."""

    def __init__(self, path: str):
        terms, documents = _load(f"{path}.terms"), _load(f"{path}.documents")
        steps = terms.column("steps")
        self.terms = terms.column("term")
        self.counts = pc.list_value_length(steps).to_numpy().astype(np.int64)
        self.ends = np.cumsum(self.counts)
        sums = np.cumsum(pc.list_flatten(steps).to_numpy().astype(np.int64))
        self.places = sums - np.repeat(np.append(0, sums[self.ends[:-1] - 1])[: len(self.counts)], self.counts)
        self.doc_ids = documents.column("doc_id")
        self.first = documents.column("first").to_numpy()
        self.words = documents.column("words").to_numpy()
        self.span = int(self.first[-1] + self.words[-1]) + 2 * GAP
        # postings of all terms as one sorted list
        self.keys = np.repeat(np.arange(len(self.counts)), self.counts) * self.span + self.places

    def has(self, term: np.ndarray, place: np.ndarray, slop: int = 0) -> np.ndarray:
        """Whether ``term`` occurs within ``slop`` places of ``place``."""
        wanted = term * self.span + place
        at = np.searchsorted(self.keys, wanted - slop)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= wanted + slop)

    def find(self, phrases: Phrases, slop: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrase number, place of its first word) of every match, in portions of bounded size.

        With ``slop`` each word may be that many places off the one the phrase gives it.
        """
        if not len(self.keys) or not len(phrases.grid):
            return
        own = pc.index_in(phrases.terms, value_set=self.terms).fill_null(_MISSING).to_numpy()
        grid = np.append(own, _ANY)[phrases.grid]  # _ANY is the last place
        alive = np.flatnonzero((grid != _MISSING).all(axis=1))
        grid = grid[alive].astype(np.int64)
        sizes = np.where(grid >= 0, self.counts[grid], np.iinfo(np.int64).max)
        order = np.argsort(sizes, axis=1, kind="stable")
        rarest = order[:, 0]
        row = np.arange(len(grid))
        leading = grid[row, rarest]
        portions = np.cumsum(self.counts[leading] * (2 * slop + 1)) // CANDIDATES
        for part in np.split(row, np.flatnonzero(np.diff(portions)) + 1) if len(row) else []:
            count = self.counts[leading[part]]
            inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            place = self.places[np.repeat(self.ends[leading[part]] - count, count) + inside] - np.repeat(rarest[part], count)
            which = np.repeat(part, count)
            if slop:
                moves = np.arange(-slop, slop + 1)
                place, which = (place[:, None] + moves).ravel(), np.repeat(which, len(moves))
            for step in range(1, grid.shape[1]):
                offset = order[which, step]
                term = grid[which, offset]
                kept = (term == _ANY) | self.has(term, place + offset, slop)
                place, which = place[kept], which[kept]
            if slop:  # one place is reached from several occurrences of the rarest term
                both = np.unique(np.stack([which, place]), axis=1)
                which, place = both[0], both[1]
            yield alive[which], place


# ---- the queries --------------------------------------------------------------------


class Phrases:
    """A batch of phrases in memory: ``grid`` holds numbers of ``terms``, _ANY behind the end of a short one."""

    def __init__(self, path: str):
        phrases, items = _load(f"{path}.phrases"), _load(f"{path}.items")
        self.terms = _load(f"{path}.terms").column("term")
        self.item = phrases.column("item").to_numpy()
        self.at = phrases.column("at").to_numpy()
        self.grid = pc.list_flatten(phrases.column("words")).to_numpy().reshape(len(self.item), -1)
        self.size = (self.grid != _ANY).sum(axis=1)
        self.items = items.column("item_id").to_pylist()


def stored_phrases(queries: DataFrame, window: int) -> list[str]:
    """Store the windows of ``window`` words of the items (item_id, text) in batches; returns their paths.

    An item of fewer words, but not none, is one window. Only paths come back to the driver, one for
    ``BATCH_PHRASES`` windows.
    """
    folder = run_dir(queries.sparkSession, "phrases")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        numbers, size = _Numbers(), 0
        for batch in rows:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = word_numbers(text, numbers)
                if not len(words):
                    continue
                if len(words) < window:
                    words = np.concatenate([words, np.full(window - len(words), _ANY, np.int32)])
                grid = np.lib.stride_tricks.sliding_window_view(words, window)
                for at in range(0, len(grid), BATCH_PHRASES):
                    held.append((item, at, grid[at : at + BATCH_PHRASES]))
                    size += len(held[-1][2])
                    if size >= BATCH_PHRASES:
                        yield _stored_batch(folder, held, numbers)
                        held, size = [], 0
                if not held:
                    numbers = _Numbers()
        if held:
            yield _stored_batch(folder, held, numbers)

    slim = queries.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")
    )
    return [r["path"] for r in saved(slim.mapInArrow(batches, "path string"), "phrase-batches").collect()]


def _stored_batch(folder: str, held: list[tuple], numbers: dict) -> pa.RecordBatch:
    path = _new_file(folder)
    grid = np.concatenate([g for _, _, g in held])
    sizes = np.array([len(g) for _, _, g in held])
    at = np.arange(len(grid)) - np.repeat(np.cumsum(sizes) - sizes - np.array([a for _, a, _ in held]), sizes)
    words = pa.FixedSizeListArray.from_arrays(pa.array(grid.ravel(), pa.int32()), grid.shape[1])
    _store(f"{path}.phrases", {"item": np.repeat(np.arange(len(held)), sizes), "at": at, "words": words})
    _store(f"{path}.items", {"item_id": pa.array([i for i, _, _ in held], pa.string())})
    _store(f"{path}.terms", {"term": pa.array(list(numbers), pa.binary())})
    return pa.RecordBatch.from_pydict({"path": [path]})


# ---- search -------------------------------------------------------------------------


def _dealt(index: DataFrame) -> DataFrame:
    """The blocks over tasks, a few to each."""
    blocks = index.count()
    return index.repartition(max(1, min(blocks, max(partitions(index.sparkSession), blocks // 8))))


def _each(paths: list[str]) -> Iterator[Phrases]:
    return (Phrases(p) for p in paths)


def _check(window: int, slop: int) -> None:
    if window < 1 or slop < 0 or window + 2 * slop >= GAP:
        raise ValueError(f"window + 2 * slop must be below {GAP}")


def search(index: DataFrame, queries: DataFrame, window: int = 10, slop: int = 0) -> DataFrame:
    """Every match of a window of the items (item_id, text) in the indexed documents.

    Returns doc_id, place (number of the document's word where the window would begin), item_id,
    item_place (number of the window in its item), n_words and exact. With ``slop`` a window also
    matches in the neighbourhood: each of its words occurs at most ``slop`` words off the place it
    has in the phrase, counted from ``place``, which may lie up to ``slop`` before the document.
    """
    _check(window, slop)
    paths = stored_phrases(queries, window)
    schema = pa.schema([
        ("doc_id", pa.int64()), ("place", pa.int64()), ("item_id", pa.string()), ("item_place", pa.int64()), ("n_words", pa.int32()), ("exact", pa.bool_()),
    ])

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            block = Block(path)
            for phrases in _each(paths):
                terms = np.append(pc.index_in(phrases.terms, value_set=block.terms).fill_null(_MISSING).to_numpy(), _ANY)
                items = pa.array(phrases.items, pa.string())
                for which, place in block.find(phrases, slop):
                    exact = np.ones(len(which), bool)
                    for offset in range(window if slop else 0):
                        term = terms[phrases.grid[which, offset]].astype(np.int64)
                        exact &= (term == _ANY) | block.has(term, place + offset)
                    doc = np.searchsorted(block.first - slop, place, "right") - 1
                    yield pa.RecordBatch.from_arrays([
                        block.doc_ids.take(pa.array(doc)).combine_chunks(), pa.array(place - block.first[doc]), items.take(pa.array(phrases.item[which])),
                        pa.array(phrases.at[which]), pa.array(phrases.size[which].astype(np.int32)), pa.array(exact),
                    ], schema=schema)

    return _dealt(index).mapInArrow(matches, "doc_id long, place long, item_id string, item_place long, n_words int, exact boolean")


def contamination(index: DataFrame, queries: DataFrame, window: int = 10) -> DataFrame:
    """Per indexed document: doc_id, n_words, n_hit and items.

    n_hit counts the words inside any occurrence of a window of the items (item_id, text), ``items``
    holds the ids of the items that have one, sorted, each once.
    """
    _check(window, 0)
    paths = stored_phrases(queries, window)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            block = Block(path)
            edges = np.zeros(block.span + 1, np.int64)
            items: dict[int, set[str]] = {}
            for phrases in _each(paths):
                for which, place in block.find(phrases):
                    np.add.at(edges, place, 1)
                    np.add.at(edges, place + phrases.size[which], -1)
                    doc = np.searchsorted(block.first, place, "right") - 1
                    pairs = np.unique(np.stack([doc, phrases.item[which]]), axis=1)
                    for d, i in pairs.T.tolist():
                        items.setdefault(d, set()).add(phrases.items[i])
            hit = np.append(0, np.cumsum(np.cumsum(edges) > 0))
            n_hit = hit[block.first + block.words] - hit[block.first]
            for at in range(0, len(block.first), 8192):
                some = slice(at, at + 8192)
                found = [sorted(items.get(d, ())) for d in range(at, min(at + 8192, len(block.first)))]
                yield pa.RecordBatch.from_arrays([
                    block.doc_ids.slice(at, 8192).combine_chunks(), pa.array(block.words[some]), pa.array(n_hit[some]), pa.array(found, pa.list_(pa.string())),
                ], names=["doc_id", "n_words", "n_hit", "items"])

    return _dealt(index).mapInArrow(documents, "doc_id long, n_words long, n_hit long, items array<string>")
