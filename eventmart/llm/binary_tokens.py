"""Token ids in bit-packed files: each id takes the minimum bits of the vocabulary, blocks have offsets.

A file is: magic, packed blocks, index, index length (8 bytes), magic. The index holds, as
little-endian 64-bit integers: width, ids a block, ids, documents, blocks; then per document its
id, a flag for a NULL id and its first position; then the byte offset of each block. Documents lie
in ascending id order, also across files (NULL ids first, repeated ids by text).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import run_dir
from .common import filesystem, partitions, put_in_place, saved, spread, text_of
from .encoding import encoder

MAGIC = b"BITPACK1"
BLOCK = 8192  # ids; a multiple of 8, so blocks end on a byte
READ_IDS = 1 << 20


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in ``width`` bits each (at most 25), little-endian; the last byte is padded with zeros."""
    rows = -(-len(ids) // 8)
    padded = np.zeros((rows, 8), np.uint32)
    padded.ravel()[: len(ids)] = ids
    out = np.zeros((rows, width + 4), np.uint8)
    for j in range(8):
        value = padded[:, j] << np.uint32((j * width) & 7)
        for b in range((((j * width) & 7) + width + 7) // 8):
            out[:, (j * width >> 3) + b] |= ((value >> np.uint32(8 * b)) & np.uint32(255)).astype(np.uint8)
    return out[:, :width].tobytes()[: -(-len(ids) * width // 8)]


def unpack(data: bytes, count: int, width: int) -> np.ndarray:
    rows = -(-count // 8)
    padded = np.zeros((rows, width + 4), np.uint8)
    flat = np.zeros(rows * width, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    padded[:, :width] = flat.reshape(rows, width)
    out = np.empty((rows, 8), np.uint32)
    for j in range(8):
        value = np.zeros(rows, np.uint32)
        for b in range((((j * width) & 7) + width + 7) // 8):
            value |= padded[:, (j * width >> 3) + b].astype(np.uint32) << np.uint32(8 * b)
        out[:, j] = (value >> np.uint32((j * width) & 7)) & np.uint32((1 << width) - 1)
    return out.ravel()[:count]


class Writer:
    """Streams documents into one file; it appears under its name only when it is whole."""

    def __init__(self, path: str, width: int, attempt: str):
        self._fs, self._path = filesystem(path)
        self._fs.create_dir(self._path.rsplit("/", 1)[0], recursive=True)
        self._temporary = f"{self._path}.{attempt}"
        self._out = self._fs.open_output_stream(self._temporary)
        self._out.write(MAGIC)
        self._width, self._at, self.ids = width, len(MAGIC), 0
        self._docs, self._nulls, self._starts, self._blocks = [], [], [], []
        self._rest: list[np.ndarray] = []
        self._waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._docs.append(doc_id or 0)
        self._nulls.append(int(doc_id is None))
        self._starts.append(self.ids)
        self.ids += len(ids)
        self._rest.append(ids)
        self._waiting += len(ids)
        if self._waiting >= 16 * BLOCK:
            self._flush(False)

    def _flush(self, end: bool) -> None:
        ids = np.concatenate(self._rest) if self._rest else np.zeros(0, np.uint32)
        upto = len(ids) if end else len(ids) // BLOCK * BLOCK
        for at in range(0, upto, BLOCK):
            data = pack(ids[at : min(at + BLOCK, upto)], self._width)
            self._blocks.append(self._at)
            self._out.write(data)
            self._at += len(data)
        self._rest = [ids[upto:]]
        self._waiting = len(ids) - upto

    def close(self) -> None:
        self._flush(True)
        head = [self._width, BLOCK, self.ids, len(self._docs), len(self._blocks)]
        index = np.array([*head, *self._docs, *self._nulls, *self._starts, *self._blocks], "<i8").tobytes()
        self._out.write(index + len(index).to_bytes(8, "little") + MAGIC)
        self._out.close()
        put_in_place(self._fs, self._temporary, self._path)


class Reader:
    """Random access to one file; only its index and the asked blocks are read."""

    def __init__(self, path: str):
        system, place = filesystem(path)
        self._file = system.open_input_file(place)
        size = self._file.size()
        tail = self._file.read_at(16, size - 16)
        if bytes(tail[8:]) != MAGIC:
            raise ValueError(f"{path} is not a whole bit-packed file")
        length = int.from_bytes(tail[:8], "little")
        index = np.frombuffer(self._file.read_at(length, size - 16 - length), "<i8")
        self.width, self._block, self.ids, docs, blocks = (int(x) for x in index[:5])
        self.doc_ids, self.nulls, self.starts = index[5 : 5 + 3 * docs].reshape(3, docs)
        self._offsets = np.append(index[5 + 3 * docs :], size - 16 - length)
        assert len(self._offsets) == blocks + 1

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids at positions start..stop of the file."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self._block, (stop - 1) // self._block
        at, end = int(self._offsets[first]), int(self._offsets[last + 1])
        count = min((last + 1) * self._block, self.ids) - first * self._block
        ids = unpack(self._file.read_at(end - at, at), count, self.width)
        return ids[start - first * self._block : stop - first * self._block]

    def documents(self):
        """(doc_id, start, ids) of each document, read in stretches of about READ_IDS ids."""
        ends = np.append(self.starts[1:], self.ids)
        at = 0
        while at < len(self.starts):
            upto = max(at + 1, int(np.searchsorted(ends, self.starts[at] + READ_IDS, "right")))
            base = int(self.starts[at])
            ids = self.read(base, int(ends[upto - 1]))
            for k in range(at, upto):
                s, e = int(self.starts[k]), int(ends[k])
                yield None if self.nulls[k] else int(self.doc_ids[k]), s, ids[s - base : e - base]
            at = upto


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Encode all documents into files below ``folder``; returns the manifest (shard, path, documents, ids, first).

    NULL text is empty: such a document holds only ``end_id``. Repeated ids stay separate
    documents. No documents give no files. ``first`` counts the ids of all files before.
    One file per range of ids, written by one task as a stream; a repeated attempt writes the
    same file again under another name first.
    """
    spark = docs.sparkSession
    end = np.array([end_id], np.uint32)

    def shard(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        number, writer, count = context.partitionId(), None, 0
        own = encoder(tokenizer)
        path = f"{folder}/ids-{number:06d}.bin"
        for batch in batches:
            if writer is None:
                writer = Writer(path, bits_for(max(own.vocabulary, end_id + 1)), str(context.taskAttemptId()))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.encode(text_of(batch)), strict=True):
                writer.add(doc_id, np.concatenate([np.frombuffer(ids, "<u4"), end]))
                count += 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [number], "path": [path], "documents": [count], "ids": [writer.ids]})

    ranged = spread(docs).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = saved(ranged.mapInArrow(shard, "shard long, path string, documents long, ids long"), "token-files")
    # one row per file: bounded by the number of shuffle partitions
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Documents of the files of a manifest: doc_id, start (over all files), n_tokens, ids_crc32 and ids (binary)."""

    def documents(batches):
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                rows, size = [], 0
                for doc_id, start, ids in Reader(path).documents():
                    data = ids.astype("<u4").tobytes()
                    rows.append((doc_id, first + start, len(ids), zlib.crc32(data), data))
                    size += len(data)
                    if size > 4 * READ_IDS:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    return manifest.repartitionByRange(partitions(spark), "shard").mapInArrow(documents, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])


def token_folder(spark: SparkSession) -> str:
    return run_dir(spark, "token-ids")
