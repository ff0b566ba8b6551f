"""N-gram scoring with Elias-Fano tries.

The model is a hierarchical Dirichlet bigram: P(w|v) = (c(v,w) + M P(w)) / (c(v) + M), P(w) = (c(w) + 1) /
(N + V + 1). Its logarithm is a part that belongs to w and a part that belongs to v, and a context is
a word itself, so all that a token needs lies with its word: tokens are shuffled once, to the shard of
their word, which counts, builds its part of the trie and scores every document's tokens. Frequent
words are spread over shards by their predecessor; their counts are known from the vocabulary.

A shard's trie has two levels, words and under each the words before it. Both are Elias-Fano sequences:
words by hash, pointers to the first child, and child ids made monotone over all words by adding the
last value of the range before. Values are quantised. A query finds the range of its word by the
pointers and the successor of its target inside that range.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import run_dir
from .common import filesystem, id_crc, partitions, parts_of, put_in_place, release, released, saved, text_of, word_hashes

STRENGTH = 100.0  # M
LEVELS = 1 << 12  # of quantised values
BATCH_DOCS, BATCH_CHARS = 4096, 8_000_000
READ_BYTES = 1_000_000  # of texts that are Python strings at a time
SHARD_TOKENS = 4_000_000  # of training, on average at most
RANGE_TOKENS = 1 << 18  # of a shard that are sorted at a time
_STRETCH = 1 << 16
_RANGE_BITS = 12
_HASH_BITS = 48
_MASK = np.uint64((1 << _HASH_BITS) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


END, START = 0x5EED, 0xBEE5


def tokens(text: str) -> np.ndarray:
    """Word hashes of a text and one end."""
    return np.append(word_hashes(text) & _MASK, np.uint64(END))


# --- sequences -------------------------------------------------------------------------------------


def _to_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Values in ``width`` bits each, as bytes."""
    out = []
    for at in range(0, len(values), _STRETCH):  # a multiple of 8 values: stretches end on a byte
        some = np.ascontiguousarray(values[at : at + _STRETCH]).view(np.uint8).reshape(-1, 8)
        out.append(np.packbits(np.unpackbits(some, axis=1, bitorder="little")[:, :width].ravel(), bitorder="little"))
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def _from_bits(data: np.ndarray, start: int, count: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(count, np.uint64)
    first, skip = divmod(start * width, 8)
    bits = np.unpackbits(data[first : first + -(-(skip + count * width) // 8)], bitorder="little")[skip : skip + count * width]
    wide = np.zeros((count, 64), np.uint8)
    wide[:, :width] = bits.reshape(count, width)
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64).ravel()


class EliasFano:
    """A non-decreasing sequence of whole numbers in about 2 + log2(range / length) bits each."""

    def __init__(self, length: int, width: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.length, self._width, self._low, self._high, self._marks = length, width, low, high, marks

    @staticmethod
    def parts(values: np.ndarray) -> dict[str, np.ndarray]:
        values = values.astype(np.uint64)
        n = len(values)
        width = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        low = _to_bits(values & np.uint64((1 << width) - 1), width) if width else np.zeros(0, np.uint8)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) // 8 + 1 if n else 0, np.uint8)
        np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
        return {"shape": np.array([n, width], np.int64), "low": low, "high": high, "marks": ones[::_STRETCH]}

    @classmethod
    def opened(cls, parts: dict[str, np.ndarray]) -> EliasFano:
        return cls(int(parts["shape"][0]), int(parts["shape"][1]), parts["low"], parts["high"], parts["marks"])

    def stretch(self, k: int) -> np.ndarray:
        """Values k * _STRETCH onwards, at most _STRETCH of them."""
        start = k * _STRETCH
        count = min(_STRETCH, self.length - start)
        first = int(self._marks[k])
        last = int(self._marks[k + 1]) if k + 1 < len(self._marks) else 8 * len(self._high)
        bits = np.unpackbits(self._high[first >> 3 : (last + 7) >> 3], bitorder="little")
        ones = np.flatnonzero(bits) + (first & ~7)
        ones = ones[ones >= first][:count]
        high = (ones - np.arange(start, start + count)).astype(np.uint64)
        return (high << np.uint64(self._width)) | _from_bits(self._low, start, count, self._width)

    def at(self, places: np.ndarray) -> np.ndarray:
        """Values at some places."""
        out = np.zeros(len(places), np.uint64)
        part = places // _STRETCH
        for k in np.unique(part).tolist():
            some = np.flatnonzero(part == k)
            out[some] = self.stretch(k)[places[some] - k * _STRETCH]
        return out

    def successors(self, targets: np.ndarray) -> np.ndarray:
        """Place of the first value not below each target; the length if there is none."""
        out = np.full(len(targets), self.length, np.int64)
        order = np.argsort(targets, kind="stable")
        left = 0
        for k in range(len(self._marks)):
            if left == len(order):
                break
            values = self.stretch(k)
            upto = len(order) if k + 1 == len(self._marks) else left + int(np.searchsorted(targets[order[left:]], values[-1], "right"))
            some = order[left:upto]
            out[some] = k * _STRETCH + np.searchsorted(values, targets[some])
            left = upto
        return out


# --- trie ------------------------------------------------------------------------------------------


def _quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
    step = (high - low) / (LEVELS - 1) or 1.0
    return np.rint((values - low) / step).astype(np.uint16), np.array([low, step])


def build_trie(words: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, total: int, kinds: int) -> dict[str, np.ndarray]:
    """Levels of a trie. ``words`` ascend; ``pairs`` are (place in words) << 32 | predecessor, ascending."""
    unigram = (counts + 1.0) / (total + kinds + 1.0)
    parents = (pairs >> np.uint64(32)).astype(np.int64)
    children = pairs & np.uint64(0xFFFFFFFF)
    pointers = np.searchsorted(parents, np.arange(len(words) + 1))
    # each range continues after the last value of the one before
    lasts = np.where(pointers[1:] > pointers[:-1], children[np.maximum(pointers[1:] - 1, 0)] + np.uint64(1) if len(children) else 0, 0).astype(np.uint64)
    bases = np.concatenate([[np.uint64(0)], np.cumsum(lasts)[:-1]]).astype(np.uint64) if len(words) else np.zeros(0, np.uint64)
    out: dict[str, np.ndarray] = {}
    for name, values in (("words", words), ("pointers", pointers), ("children", children + bases[parents])):
        out |= {f"{name}.{k}": v for k, v in EliasFano.parts(values).items()}
    for name, values in (("unseen", np.log10(STRENGTH * unigram)), ("context", np.log10(counts + STRENGTH)), ("seen", np.log10(pair_counts + STRENGTH * unigram[parents]))):
        out[f"{name}.codes"], out[f"{name}.scale"] = _quantised(values)
    return out


def write_levels(levels: dict[str, np.ndarray], path: str, attempt: str) -> None:
    """One file: length of the index, index (names, kinds, shapes, offsets), arrays."""
    system, place = filesystem(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    index, at = {}, 0
    for name, array in levels.items():
        index[name] = (array.dtype.str, len(array), at)
        at += -(-array.nbytes // 8) * 8
    head = json.dumps(index).encode()
    head += b" " * (-len(head) % 8)
    with system.open_output_stream(f"{place}.{attempt}") as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for array in levels.values():
            out.write(array.tobytes() + b"\0" * (-array.nbytes % 8))
    put_in_place(system, f"{place}.{attempt}", place)


class Trie:
    """Levels of a file, memory-mapped where the shared folder is mounted and read otherwise."""

    def __init__(self, path: str):
        system, place = filesystem(path)
        if system.type_name == "local":
            data = np.memmap(place, np.uint8, "r")
        else:
            with system.open_input_file(place) as file:
                data = np.frombuffer(file.read(), np.uint8)
        size = int(data[:8].view("<i8")[0])
        index = json.loads(bytes(data[8 : 8 + size]))
        self._arrays = {n: data[8 + size + at : 8 + size + at + np.dtype(kind).itemsize * count].view(kind) for n, (kind, count, at) in index.items()}
        self._words, self._pointers, self._children = (
            EliasFano.opened({k.split(".")[1]: v for k, v in self._arrays.items() if k.startswith(f"{n}.")}) for n in ("words", "pointers", "children")
        )

    def _value(self, name: str, places: np.ndarray) -> np.ndarray:
        low, step = self._arrays[f"{name}.scale"]
        return low + step * self._arrays[f"{name}.codes"][places]

    def numerators(self, words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of known words: log10 of c + M P(w) after ``before``, log10 of c(w) + M, and whether the word is known."""
        place = self._words.successors(words)
        known = place < self._words.length
        known[known] = self._words.at(place[known]) == words[known]
        at = place[known]
        value = self._value("unseen", at)
        first, last = self._pointers.at(at).astype(np.int64), self._pointers.at(at + 1).astype(np.int64)
        base = np.zeros(len(at), np.uint64)
        some = first > 0
        base[some] = self._children.at(first[some] - 1) + np.uint64(1)
        target = base + before[known].astype(np.uint64)
        child = self._children.successors(target)
        seen = (child >= first) & (child < last)
        seen[seen] = self._children.at(child[seen]) == target[seen]
        value[seen] = self._value("seen", child[seen])
        numerator, context = np.zeros(len(words)), np.zeros(len(words))
        numerator[known], context[known] = value, self._value("context", at)
        return numerator, context, known


# --- corpus ----------------------------------------------------------------------------------------


def _vocabulary(docs: DataFrame) -> DataFrame:
    """(word, count) over the training documents."""

    def counted(batches):
        parts, size = [], 0
        for batch in (part for whole in batches for part in parts_of(whole, READ_BYTES)):
            for text, train in zip(text_of(batch), batch.column("train").to_pylist(), strict=True):
                if train:
                    parts.append(tokens(text))
                    size += len(parts[-1])
                if size > 4_000_000:
                    yield _counts(parts)
                    parts, size = [], 0
        if parts:
            yield _counts(parts)

    found = docs.filter("train").mapInArrow(released(counted), "word long, count long")
    return saved(found.groupBy("word").agg(F.sum("count").alias("count")), "lm-words")


def _counts(parts: list[np.ndarray]) -> pa.RecordBatch:
    words, counts = np.unique(np.concatenate(parts), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "count"])


def _dealt(docs: DataFrame, shards: int, hot: np.ndarray) -> DataFrame:
    """Tokens of batches of documents by shard of their word: (shard, batch, head, data)."""

    def rows(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        texts: list[tuple] = []
        size = 0
        for batch in (part for whole in batches for part in parts_of(whole, READ_BYTES)):
            for row in zip(batch.column("doc_id").to_pylist(), batch.column("train").to_pylist(), text_of(batch), strict=True):
                texts.append(row)
                size += len(row[2])
                if len(texts) == BATCH_DOCS or size > BATCH_CHARS:
                    yield _shuffled(texts, number, shards, hot)
                    number, texts, size = number + 1, [], 0
        if texts:
            yield _shuffled(texts, number, shards, hot)

    return docs.mapInArrow(released(rows), "shard int, batch long, head binary, data binary")


def _shuffled(texts: list[tuple], number: int, shards: int, hot: np.ndarray) -> pa.RecordBatch:
    each = [tokens(t) for _, _, t in texts]
    sizes = np.array([len(x) for x in each], np.int64)
    words = np.concatenate(each)
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[np.cumsum(sizes) - sizes] = START
    before = ((before * _MIX) >> np.uint64(32)).astype(np.uint32)
    doc = np.repeat(np.arange(len(each)), sizes).astype(np.uint16)
    spread = hot[np.minimum(np.searchsorted(hot, words), len(hot) - 1)] == words if len(hot) else np.zeros(len(words), bool)
    shard = np.where(spread, (words ^ before.astype(np.uint64)) * _MIX >> np.uint64(40), words) % np.uint64(shards)
    order = np.argsort((shard << np.uint64(_HASH_BITS)) | words, kind="stable")
    words, before, doc, shard = words[order], before[order], doc[order], shard[order]
    train = np.packbits(np.array([bool(t) for _, t, _ in texts]))
    head = np.array([[i or 0 for i, _, _ in texts], [i is None for i, _, _ in texts], sizes.tolist()], np.int64).tobytes()
    cuts = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
    out: list[tuple] = []
    for s in range(shards):
        a, b = int(cuts[s]), int(cuts[s + 1])
        if a == b and s:
            continue
        starts = np.flatnonzero(np.concatenate([[True], words[a + 1 : b] != words[a : b - 1]])) if b > a else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, b - a)).astype(np.uint32)
        own = words[a:b][starts]
        data = np.array([len(texts), len(own), b - a], np.uint32).tobytes() + train.tobytes()
        data += np.ascontiguousarray(own).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() + counts.tobytes() + doc[a:b].tobytes() + before[a:b].tobytes()
        out.append((s, number, head if s == 0 else None, data))
    kinds = [("shard", pa.int32()), ("batch", pa.int64()), ("head", pa.binary()), ("data", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), kinds)], names=[n for n, _ in kinds])


def _parsed(data: pa.Buffer):
    """Of one row: documents, which of them train, words ascending, end of each word's tokens, documents and predecessors of tokens."""
    n, kinds, tokens = (int(x) for x in np.frombuffer(data, np.uint32, 3))
    at = 12
    train = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at))[:n].astype(bool)
    at += -(-n // 8)
    wide = np.zeros((kinds, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8, 6 * kinds, at).reshape(kinds, 6)
    at += 6 * kinds
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint32, kinds, at), dtype=np.int64)])
    at += 4 * kinds
    doc = np.frombuffer(data, np.uint16, tokens, at)
    return n, train, wide.view(np.uint64).ravel(), ends, doc, np.frombuffer(data, np.uint32, tokens, at + 2 * tokens)


def _ranges(rows: list[tuple]) -> np.ndarray:
    """First words of ranges that hold about RANGE_TOKENS tokens of the shard each, and one word above all."""
    sizes = np.zeros(1 << _RANGE_BITS, np.int64)
    for _, _, own, ends, _, _ in rows:
        np.add.at(sizes, (own >> np.uint64(_HASH_BITS - _RANGE_BITS)).astype(np.int64), np.diff(ends))
    firsts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // RANGE_TOKENS)) + 1
    return np.concatenate([[0], firsts, [1 << _RANGE_BITS]]).astype(np.uint64) << np.uint64(_HASH_BITS - _RANGE_BITS)


def _pairs(rows: list[tuple]):
    """Words of a shard and their training counts; pairs (place of the word) << 32 | predecessor and theirs; the pair of every token.

    The rows ascend by word, so the shard is sorted range by range.
    """
    bounds = _ranges(rows)
    cuts = [np.searchsorted(own, bounds) for _, _, own, _, _, _ in rows]
    starts = np.cumsum([0, *(len(r[4]) for r in rows)])
    which = np.empty(int(starts[-1]), np.uint32)
    words, asked = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]  # a shard may have heads only
    counts, asked_counts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    n_words = n_pairs = 0
    for k in range(len(bounds) - 1):
        parts = [(i, int(r[3][c[k]]), int(r[3][c[k + 1]])) for i, (r, c) in enumerate(zip(rows, cuts)) if c[k] < c[k + 1]]
        if not parts:
            continue
        some = np.concatenate([np.repeat(rows[i][2][cuts[i][k] : cuts[i][k + 1]], np.diff(rows[i][3][cuts[i][k] : cuts[i][k + 1] + 1])) for i, _, _ in parts])
        train = np.concatenate([rows[i][1][rows[i][4][a:b]] for i, a, b in parts])
        own, place = np.unique(some, return_inverse=True)
        words.append(own)
        counts.append(np.bincount(place[train], minlength=len(own)))
        some = place.astype(np.uint64) << np.uint64(32)
        some |= np.concatenate([rows[i][5][a:b] for i, a, b in parts])
        own_pairs, place = np.unique(some, return_inverse=True)
        asked.append(own_pairs + (np.uint64(n_words) << np.uint64(32)))
        asked_counts.append(np.bincount(place[train], minlength=len(own_pairs)).astype(np.uint32))
        place += n_pairs
        at = 0
        for i, a, b in parts:
            which[starts[i] + a : starts[i] + b] = place[at : at + b - a]
            at += b - a
        n_words, n_pairs = n_words + len(own), n_pairs + len(own_pairs)
    return np.concatenate(words), np.concatenate(counts), np.concatenate(asked), np.concatenate(asked_counts), np.split(which, starts[1:-1])


def _scored_shard(folder: str, hot: np.ndarray, hot_counts: np.ndarray, total: int, kinds: int):
    def score(table: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        rows = [_parsed(x.as_buffer()) for x in table.column("data")]
        kinds_here, counts, asked, asked_counts, which = _pairs(rows)
        frequent = np.flatnonzero(np.isin(kinds_here, hot))
        counts[frequent] = hot_counts[np.searchsorted(hot, kinds_here[frequent])]
        known_here = counts > 0
        every, every_counts = kinds_here[known_here], counts[known_here]
        rank = np.cumsum(known_here) - 1
        # every pair of the shard is there once, with its number in the training documents
        asked_word = (asked >> np.uint64(32)).astype(np.uint32)
        asked &= np.uint64(0xFFFFFFFF)
        seen = asked_counts > 0
        pairs = (rank[asked_word[seen]].astype(np.uint64) << np.uint64(32)) | asked[seen]
        path = f"{folder}/shard-{table.column('shard')[0].as_py():06d}.trie"
        write_levels(build_trie(every, every_counts, pairs, asked_counts[seen], total, kinds), path, str(TaskContext.get().taskAttemptId()))
        del pairs, seen, asked_counts
        trie = Trie(path)
        value = np.empty(len(asked))
        for at in range(0, len(asked), RANGE_TOKENS):
            some = slice(at, at + RANGE_TOKENS)
            words = kinds_here[asked_word[some]]
            numerator, context, known = trie.numerators(words, asked[some].astype(np.uint32))
            numerator[~known] = np.log10(STRENGTH / (total + kinds + 1.0))
            context[~known] = np.log10(STRENGTH)
            context[words == np.uint64(END)] = 0  # nothing follows an end
            value[some] = numerator - context
        del asked
        base = np.log10(counts + 1.0)
        out: list[tuple] = []
        for (n, _, _, _, doc, _), own, batch, head in zip(rows, which, table.column("batch").to_pylist(), table.column("head").to_pylist(), strict=True):
            word = asked_word[own]
            there = np.flatnonzero(np.bincount(doc, minlength=n))
            sums = [np.bincount(doc, x, n)[there] for x in (base[word], value[own], known_here[word])]
            out.append((batch, head, there.astype("<u2").tobytes(), sums[0].astype("<f8").tobytes(), sums[1].astype("<f4").tobytes(), sums[2].astype("<u4").tobytes()))
        names = ["batch", "head", "doc", "base", "score", "known"]
        types = [pa.int64(), *[pa.binary()] * 5]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    def freed(table: pa.Table) -> pa.Table:
        try:
            return score(table)
        finally:
            release()

    return freed


def score_documents(docs: DataFrame, hold: tuple[int, int] = (7, 2)) -> DataFrame:
    """Scores of every row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from documents whose crc32 of the id does not leave ``hold[1]`` modulo ``hold[0]``.
    NULL and empty texts are one end. Repeated rows count and are scored as often as they are there. Without training
    documents all probabilities are those of an empty model.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (id_crc() % hold[0] != hold[1]).alias("train"))
    words = _vocabulary(slim)
    sums = words.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, kinds = int(sums["n"]), int(sums["v"])
    shards = max(partitions(spark), -(-total // SHARD_TOKENS))
    # at most 4 x shards words can be this frequent
    frequent = words.filter(F.col("count") * (4 * shards) >= total).orderBy("word").collect()
    hot = np.array([r["word"] for r in frequent], np.int64).astype(np.uint64)
    hot_counts = np.array([r["count"] for r in frequent], np.int64)
    ends = words.filter(F.col("word") == END).first()
    opening = float(np.log10((ends["count"] if ends else 0) + STRENGTH))
    norm = float(np.log10(total + kinds + 1.0))
    folder = run_dir(spark, "lm-tries")
    parts = saved(
        _dealt(slim, shards, hot).groupBy("shard").applyInArrow(
            _scored_shard(folder, hot, hot_counts, total, kinds), "batch long, head binary, doc binary, base binary, score binary, known binary"
        ),
        "lm-parts",
    )

    def whole(table: pa.Table) -> pa.Table:
        ids, missing, sizes = np.frombuffer(next(h for h in table.column("head").to_pylist() if h is not None), np.int64).reshape(3, -1)
        docs_there = [np.frombuffer(x.as_buffer(), "<u2") for x in table.column("doc")]
        base, score, known = (np.zeros(len(ids)) for _ in range(3))
        for sums, name, kind in ((base, "base", "<f8"), (score, "score", "<f4"), (known, "known", "<u4")):
            for there, x in zip(docs_there, table.column(name), strict=True):
                sums[there] += np.frombuffer(x.as_buffer(), kind)
        return pa.table({
            "doc_id": pa.array(ids, mask=missing.astype(bool)), "n_tokens": sizes, "n_known": np.rint(known).astype(np.int64),
            "train_tokens": np.full(len(ids), total), "base_score": base - norm * sizes, "score": score - opening,
        })

    out = parts.groupBy("batch").applyInArrow(whole, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.select("doc_id", (id_crc() % hold[0] == hold[1]).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
