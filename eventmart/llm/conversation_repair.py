"""Repair of the turn structure of conversations, streamed in turn order.

Rows are dealt by conversation and sorted by turn inside each task; ``mapInPandas`` then reads them as
one stream and carries the state of a dynamic program from batch to batch. The program walks an
automaton of four places (nothing yet, after a system row, after a user row, after an assistant row)
and keeps, for each place, the cheapest edits that lead to it: their cost, their rank among the
places by audit text, the running SHA-256 of the repaired text, and one byte a row that says from
which place and by which edits it was reached. Those bytes go to the shared checkpoint folder whenever
``SPILL_ROWS`` rows of one conversation are held, so a conversation of any length needs little memory;
its audit is read backwards from them at the end.

Ties by audit are decided while streaming: edits are written as inserts before a row, then the edit of
the row, so at the same row no audit begins with another one, and a rank of four places is
enough to compare two of them after any further edits. A place that costs over ``FAR`` more than the cheapest
can't be on a cheapest way any more and is let go, so few states exist; their transitions are worked
out once each and looked up for every row.

Whether role and text were seen earlier needs no memory of the conversation either: an aggregate finds
the first turn of each (conversation, role, text) and sends a marker that sorts right before that row.

Defined results: a NULL conv_id is a conversation of its own; NULL role and text read as one space;
a NULL turn sorts first and counts for no gap. Rows of one turn are taken by role, then by the
SHA-256 of role and text, so repeated rows lie next to each other. Empty texts are blank. No rows
give no conversations. Other columns are not looked at, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import run_dir
from .common import filesystem

INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
#: Rows of a conversation whose backpointers are held in memory, four bytes each.
SPILL_ROWS = 1 << 18
#: Any place reaches the others for at most four (two inserts), and then matches all that one at the beginning
#: can for three more (a system row is deleted).
FAR = 7
RESULT = (
    "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)

_BLANK = " \t\n\x0b\x0c\r"
_ENDS = frozenset(".!?")
_LEGAL = frozenset(("su", "ua", "au"))
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_DEAD = 255
# The place after an inserted or changed row, and what is written for it.
_NEXT = {_START: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
_NAME = {_USER: "user", _ASSISTANT: "assistant"}
_KEPT = {
    (_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER,
    (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER,
}
# Inserts that make an audit of each place complete.
_TO_END = {_START: 0, _SYSTEM: 2, _USER: 1, _ASSISTANT: 0}
_EDITS = "DKR"


def _moves(place: int, initial: str, delete: bool, truncated: bool):
    """(cost, audit, place behind, inserted names, edit) of every way to pass a row."""
    inserted: list[str] = []
    for k in range(3):
        if k:
            place = _NEXT[place]
            inserted = [*inserted, _NAME[place]]
        base, audit = INSERT * k, "I" * k
        yield base + DELETE, audit + "D", place, inserted, "D"
        if not delete:
            if (place, initial) in _KEPT:
                yield base + truncated * TRUNCATED, audit + "K", _KEPT[place, initial], inserted, "K"
            yield base + REROLE + truncated * TRUNCATED, audit + "R", _NEXT[place], inserted, "R"


@lru_cache(maxsize=None)
def _step(state: tuple, initial: str, delete: bool, truncated: bool):
    """State after a row: (state, added cost, backpointers, ways).

    A state holds (cost above the cheapest, rank by audit) of each place, None where there is none.
    ``ways`` has (place before, place behind, inserted names, edit) for each place reached. There are few states.
    """
    best: dict[int, tuple] = {}
    for before, held in enumerate(state):
        if held is None:
            continue
        for cost, audit, behind, inserted, edit in _moves(before, initial, delete, truncated):
            found = (held[0] + cost, held[1], audit, before, inserted, edit)
            if behind not in best or found[:3] < best[behind][:3]:
                best[behind] = found
    least = min(f[0] for f in best.values())
    best = {p: f for p, f in best.items() if f[0] - least <= FAR}
    ranks = {p: k for k, p in enumerate(sorted(best, key=lambda p: best[p][1:3]))}
    after = tuple((best[p][0] - least, ranks[p]) if p in best else None for p in range(4))
    pointers = bytes(
        best[p][3] | len(best[p][4]) << 2 | _EDITS.index(best[p][5]) << 4 if p in best else _DEAD for p in range(4)
    )
    return after, least, pointers, [(f[3], p, f[4], f[5]) for p, f in best.items()]


class _Conversation:
    """One conversation while its rows pass."""

    __slots__ = ("id", "folder", "state", "cost", "hashes", "pointers", "files", "low", "high", "turns", "last", "illegal", "faults", "initial")

    def __init__(self, conv_id, folder: str):
        self.id, self.folder = conv_id, folder
        self.state, self.cost = ((0, 0), None, None, None), 0
        self.hashes = {_START: hashlib.sha256()}
        self.pointers, self.files = bytearray(), []
        self.low = self.high = self.last = self.initial = None
        self.turns = self.illegal = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, turn: int | None, role: str, text: str, first: bool) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.last
            self.high = self.last = turn
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in _LEGAL
        self.initial = initial
        seen = text.rstrip(_BLANK)
        fault = "blank" if not seen else "duplicate" if not first else "truncated" if seen[-1] not in _ENDS else None
        if fault:
            self.faults[fault] += 1
        delete = fault in ("blank", "duplicate")
        self.state, added, pointers, ways = _step(self.state, initial if initial in ("s", "u", "a") else "", delete, fault == "truncated")
        self.cost += added
        self.pointers += pointers
        self.hashes = {behind: self._written(before, behind, inserted, edit, role, text) for before, behind, inserted, edit in ways}
        if len(self.pointers) >= 4 * SPILL_ROWS:
            self._spill()

    def _written(self, before, behind, inserted, edit, role, text):
        lines = [f"{name}:" for name in inserted]
        if edit != "D":
            lines.append(f"{role if edit == 'K' else _NAME[behind]}:{text}")
        return _extended(self.hashes[before], before == _START, lines)

    def _spill(self) -> None:
        system, place = filesystem(self.folder)
        system.create_dir(place, recursive=True)
        path = f"{place}/{uuid.uuid4().hex}.back"
        with system.open_output_stream(path) as out:
            out.write(bytes(self.pointers))
        self.files.append(path)
        self.pointers = bytearray()

    def _blocks(self) -> Iterator[bytes]:
        """Backpointers from the last rows to the first; the files go as they are read."""
        yield bytes(self.pointers)
        if self.files:
            system, _ = filesystem(self.folder)
            for path in reversed(self.files):
                with system.open_input_stream(path) as source:
                    yield source.read()
                system.delete_file(path)

    def result(self) -> tuple:
        ends = [(held[0] + INSERT * _TO_END[p], held[1], p) for p, held in enumerate(self.state) if held is not None]
        cost, _, place = min(ends)
        names, at = [], place
        for _ in range(_TO_END[place]):
            at = _NEXT[at]
            names.append(f"{_NAME[at]}:")
        digest = _extended(self.hashes[place], place == _START, names).hexdigest()
        parts = ["I" * _TO_END[place]]
        for block in self._blocks():
            for at in range(len(block) - 4, -1, -4):
                way = block[at + place]
                parts.append("I" * (way >> 2 & 3) + _EDITS[way >> 4])
                place = way & 3
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.id, gaps, *self.faults.values(), self.illegal, self.cost + cost, "".join(reversed(parts)), digest


def _extended(digest, empty: bool, lines: list[str]):
    """The hash with further lines, a line break between each two."""
    if lines:
        digest = digest.copy()
        digest.update(("" if empty else "\n").encode() + "\n".join(lines).encode())
    return digest


def repair(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text).

    Returns the faults found, the cost of the cheapest edits that make the role initials match
    ``(s?(ua)+)?``, the edits' initials in order (Keep, Rerole, Delete, Insert; the ASCII-least on ties) and the SHA-256 of the
    repaired rows ``role:text``, joined by line breaks. Each row's first fault counts: blank, duplicate
    or truncated; the first two must be deleted, the last costs one unless deleted.
    Rows for which ``present`` is not true only name their conversation.
    """
    spark = rows.sparkSession
    folder = run_dir(spark, "conversation-pointers")
    kind = rows.schema["conv_id"].dataType.simpleString()
    read = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"),
    )
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    data = read.select("conv_id", order.alias("at"), "role", digest.alias("digest"), F.when(F.col("present"), 1).otherwise(2).alias("kind"), "text")
    # partial aggregates keep a text that fills a conversation from meeting in one task
    firsts = data.filter("kind = 1").groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at"))
    markers = firsts.select("conv_id", "at", "role", "digest", F.lit(0).alias("kind"), F.lit("").alias("text"))
    names = data.filter("kind = 2").select("conv_id").distinct().select(
        "conv_id", F.struct(F.lit(False).alias("known"), F.lit(None).cast("long").alias("turn")).alias("at"),
        F.lit("").alias("role"), F.lit(b"").alias("digest"), F.lit(2).alias("kind"), F.lit("").alias("text"),
    )
    stream = data.filter("kind = 1").unionByName(markers).unionByName(names)
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "at", "role", "digest", "kind")
    # text for what pandas would turn into floating-point numbers
    stream = stream.select(
        F.col("conv_id").cast("string").alias("conv_id"), F.col("at.turn").cast("string").alias("turn"), "role", "digest", "kind", "text"
    )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, mark, done = None, None, []
        for batch in batches:
            for conv_id, turn, role, own, what, text in zip(*(batch[c].tolist() for c in ("conv_id", "turn", "role", "digest", "kind", "text")), strict=True):
                if now is None or conv_id != now.id:
                    if now is not None:
                        done.append(now.result())
                    now, mark = _Conversation(conv_id, folder), None
                if what == 0:
                    mark = own
                elif what == 1:
                    now.add(None if turn is None else int(turn), role, text, own == mark)
                    mark = None
            if done:
                yield _frame(done)
                done = []
        if now is not None:
            yield _frame([now.result()])

    found = stream.mapInPandas(walk, RESULT.format(id="string"))
    return found.withColumn("conv_id", F.col("conv_id").cast(kind))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [part.split()[0] for part in RESULT.split(", ")]
    return pd.DataFrame(rows, columns=names)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of ``rows`` damaged by crc32 of ``conv_id:turn`` modulo 20, for tests of the repair.

    0 drops a row (``present`` is false), 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 sets its role to
    user. NULL values read as one space in the key, role and text.
    """
    def shown(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    copies = F.explode(F.array_repeat(F.lit(True), F.when(code == 3, 2).otherwise(1)))
    return rows.select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"),
        (code != 0).alias("present"), copies.alias("_copy"),
    ).drop("_copy")
