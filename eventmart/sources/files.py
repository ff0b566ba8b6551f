"""Files opened by path inside tasks and read as streams (FN-19, SRC-02, LED-07)."""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 4 << 20
# Bytes in which the first two records of a file must end; no header comes near it.
HEAD = 64 << 20
# Longest line taken; a record is one value for Spark, which ends at 2 GB. Files with longer ones are reported.
LINE = 512 << 20

_LEAD = re.compile(rb"^(?:\xef\xbb\xbf)?[\r\n]*")
_RECORD = rb'[^"\r\n]*+(?:"[^"]*+"[^"\r\n]*+)*+'
_TWO = re.compile(_RECORD + rb"[\r\n]+" + _RECORD + rb"[\r\n]")
# A line of white space only: one reader drops it, the other takes it for a record.
_WHITE = re.compile(rb"\n[\x00-\x09\x0b\x0c\x0e-\x20]+\r?\n")
_QUOTE, _LF, _CR = 34, 10, 13

SCHEMA = "uri string, path string, file_name string, length long, found boolean, file_hash string, utf8 boolean, whole_lines boolean, longest long, head binary"


def open_path(path: str):
    """A binary stream of a file, for code that runs inside tasks."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_stream("/" + path[5:].lstrip("/"))
    if "://" not in path:
        return fs.LocalFileSystem().open_input_stream(path)
    scheme, rest = path.split("://", 1)
    authority, _, inside = rest.partition("/")
    system, base = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system.open_input_stream(f"{base.rstrip('/')}/{inside}")


class LineTest:
    """Whether every line break of a text file ends a record, so that it may be cut at any of them.

    True only for files where this is sure: every quote that opens a cell stands at its beginning, no
    line break lies between quotes, line breaks are LF or CR LF, and no line holds white space only.
    """

    def __init__(self, delimiters: bytes = b",;\t|"):
        self.sure, self.inside, self.last, self.tail = True, 0, _LF, b"\n"
        self.longest = self.line = 0
        self.before = np.zeros(256, bool)
        self.before[[_LF, _CR, _QUOTE, 0xBF, *delimiters]] = True  # 0xBF ends a byte order mark

    def add(self, chunk: bytes) -> None:
        data = np.frombuffer(chunk, np.uint8)
        ends = np.flatnonzero(data == _LF)
        if len(ends):
            self.longest = max(self.longest, self.line + int(ends[0]), int(np.diff(ends).max(initial=0)))
            self.line = len(data) - 1 - int(ends[-1])
        else:
            self.line += len(data)
        if not self.sure:
            return
        quotes = np.flatnonzero(data == _QUOTE)
        if len(quotes):
            opening = quotes[(self.inside + np.arange(len(quotes))) % 2 == 0]
            before = np.where(opening > 0, data[opening - 1], self.last)
            breaks = np.flatnonzero((data == _LF) | (data == _CR))
            between = (self.inside + np.searchsorted(quotes, breaks)) % 2 == 1
            self.sure = bool(self.before[before].all() and not between.any())
        elif self.inside:
            self.sure = b"\n" not in chunk and b"\r" not in chunk
        if b"\r" in chunk or self.last == _CR:
            returns = np.flatnonzero(data == _CR)
            after = data[np.minimum(returns + 1, len(data) - 1)]
            self.sure &= bool((after[returns + 1 < len(data)] == _LF).all()) and (self.last != _CR or chunk[:1] == b"\n")
        lines = self.tail + chunk
        self.sure &= _WHITE.search(lines) is None
        last = lines[lines.rfind(b"\n") :]
        self.tail = last if not last.strip(b"\r\n \t") else b"x"
        self.inside = (self.inside + len(quotes)) % 2
        self.last = chunk[-1]

    def result(self) -> bool:
        return self.sure and not self.inside and self.last != _CR and _WHITE.search(self.tail + b"\n") is None


def look(path: str) -> dict | None:
    """What is known of one file after one pass over it, in bounded memory; None where there is no file."""
    digest, decoder, lines = hashlib.sha256(), codecs.getincrementaldecoder("utf-8")(), LineTest()
    utf8, head, tried, full = True, b"", 0, False
    try:
        source = open_path(path)
    except FileNotFoundError:
        return None
    with source:
        while chunk := source.read(CHUNK):
            digest.update(chunk)
            lines.add(chunk)
            if utf8:
                try:
                    decoder.decode(chunk)
                except UnicodeDecodeError:
                    utf8 = False
            if not full and len(head) < HEAD:
                head += chunk
                if len(head) >= 2 * tried:
                    tried = len(head)
                    lead = _LEAD.match(head).end()
                    found = _TWO.match(head, lead)
                    if found:
                        head, full = head[lead : found.end()], True
    if utf8:
        try:
            decoder.decode(b"", True)
        except UnicodeDecodeError:
            utf8 = False
    if not full:
        lead = _LEAD.match(head).end()
        found = _TWO.match(head, lead)
        # a longer file whose first records do not end has no head
        head = head[lead : found.end()] if found else head[lead:] if len(head) < HEAD else None
    return {"file_hash": digest.hexdigest(), "utf8": utf8, "whole_lines": lines.result(), "longest": max(lines.longest, lines.line), "head": head}


def looked_at(files: DataFrame) -> DataFrame:
    """The files (uri, path, file_name, length) with their SHA-256, encoding test, line test and first two records.

    Each file is read once, as a stream, in the task that holds its row. A path without a file is not ``found``.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["uri", "path", "file_name", "length"]
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                seen = look(row[1])
                whole = {**dict(zip(names, row)), "found": seen is not None, **(seen or dict.fromkeys(["file_hash", "utf8", "whole_lines", "longest", "head"]))}
                kinds = [pa.string()] * 3 + [pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(whole.values(), kinds)], names=list(whole))

    return files.select("uri", "path", "file_name", F.col("length").cast("long").alias("length")).mapInArrow(each, SCHEMA)


def present(paths: DataFrame) -> DataFrame:
    """The rows of ``paths`` (path, ...) with ``found``: whether the file is there. The executors look, no folder is listed."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = []
            for path in batch.column("path").to_pylist():
                try:
                    open_path(path or "").close()
                    there.append(True)
                except (FileNotFoundError, IsADirectoryError, OSError):
                    there.append(False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(there)], names=[*batch.schema.names, "found"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema.fields)
    return paths.mapInArrow(each, f"{schema}, found boolean")


def decoded(content: Column, utf8: Column) -> Column:
    return F.when(utf8, content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
