"""Whole texts to ids of a public tokenizer; the different words of a stretch of texts are encoded once.

Both vocabularies never join a word with what stands before the single space in front of it, so the
ids of a text are those of its words, each with its space, put together. Texts are cut into words and
the words numbered by Arrow, ids are gathered by numpy; only different words that are not remembered
reach the tokenizer, many at a time, with a separator between them whose id marks where each ends.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BOUNDARY = re.compile(r"(?<=\S)(?= \S)")
_RUN = re.compile(r"\s\s")
# A key is a word that follows a space; these marks make keys of other parts.
_BARE, _WHOLE = "\0", "\1"
#: Words remembered for the life of a worker (those met twice in a stretch), and their characters.
KNOWN_WORDS, KNOWN_CHARS = 400_000, 6_000_000
#: Characters of the texts whose words are numbered together, unless one text is longer.
STRETCH = 8_000_000
#: Words encoded together, and such groups given to the tokenizer at a time: its encodings take many times the memory of their ids.
TOGETHER, GROUPS = 50, 100

_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, remember: int = KNOWN_WORDS, stretch: int = STRETCH) -> Encoder:
    """The encoder of this worker process, which remembers so many words between tasks."""
    if path not in _ENCODERS or (_ENCODERS[path].remember, _ENCODERS[path].stretch) != (remember, stretch):
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path, remember, stretch)
    return _ENCODERS[path]


def forget() -> None:
    """Free what this worker remembers; another stage needs the memory."""
    _ENCODERS.clear()


class Encoder:
    """Encodes texts; the memory of what it remembers is bounded."""

    def __init__(self, path: str, remember: int = KNOWN_WORDS, stretch: int = STRETCH):
        self.remember, self.stretch = remember, stretch
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._known: dict[str, bytes] = {}
        self._chars = 0
        self._separator, self._mark = "\n", self._alone("\n")
        if len(self._mark) != 4:  # white space is dropped
            self._separator, self._mark = " | ", self._alone("|")

    @property
    def vocabulary(self) -> int:
        return self._tokenizer.get_vocab_size(with_added_tokens=True)

    def _alone(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, stretch, size = [], [], 0
        for text in texts:
            stretch.append(text)
            size += len(text)
            if size > self.stretch:
                out += self._some(stretch)
                stretch, size = [], 0
        return out + self._some(stretch) if stretch else out

    def _some(self, texts: list[str]) -> list[bytes]:
        words, ends, order = _words(texts)
        numbered = words.dictionary_encode()
        del words
        place = numbered.indices.to_numpy()
        made = self._of(numbered.dictionary.to_pylist(), place)
        del numbered
        lengths = np.fromiter(map(len, made), np.int64, len(made)) // 4
        starts = np.cumsum(lengths) - lengths
        ids = np.frombuffer(b"".join(made), "<u4")
        each = lengths[place]
        stops = np.cumsum(each)
        total = int(stops[-1]) if len(stops) else 0
        wide = np.int32 if max(total, len(ids)) < 1 << 31 else np.int64
        at = np.repeat((starts[place] - stops + each).astype(wide), each)
        at += np.arange(total, dtype=wide)
        cuts = np.concatenate([[0], stops])[ends].tolist()
        data, out = memoryview(ids[at]).cast("B"), [b""] * len(texts)
        for text, start, stop in zip(order, [0, *cuts], cuts):
            out[text] = bytes(data[4 * start : 4 * stop])
        return out

    def _of(self, words: list[str], place: np.ndarray) -> list[bytes]:
        """Ids of different keys; those that occur twice in ``place`` are remembered while there is room."""
        ids = list(map(self._known.get, words))
        new = [k for k, x in enumerate(ids) if x is None]
        made = self._made([words[k] for k in new])
        often = np.bincount(place, minlength=len(words)) > 1
        for k in new:
            ids[k] = made[words[k]]
            if often[k] and len(self._known) < self.remember and self._chars < KNOWN_CHARS:
                self._known[words[k]] = ids[k]
                self._chars += len(words[k])
        return ids

    def _made(self, words: list[str]) -> dict[str, bytes]:
        """Ids of new keys; a stop or comma after letters is apart from them."""
        stops = [w for w in words if w[-1:] in (".", ",") and w[w[:1] == _BARE : -1].isalpha()]
        parts = dict.fromkeys(words)
        for word in stops:
            del parts[word]
        ends = {word: (word[:-1], _BARE + word[-1]) for word in stops}
        parts.update((part, self._known.get(part)) for pair in ends.values() for part in pair)
        parts.update(self._encoded([part for part, x in parts.items() if x is None]))
        for word, (body, stop) in ends.items():
            parts[word] = parts[body] + parts[stop]
        return parts

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        plain, shown, out = [], [], {}
        for word in words:
            mark, bare = (word[:1], word[1:]) if word[:1] in (_BARE, _WHOLE) else ("", word)
            if bare and mark != _WHOLE and bare.isprintable() and not (" " in bare or "|" in bare):
                plain.append(word)
                shown.append(bare if mark else " " + bare)
            else:
                out[word] = self._alone(bare if mark else " " + bare)
        sep = self._separator
        joined = [sep.join(shown[at : at + TOGETHER]) + sep for at in range(0, len(shown), TOGETHER)]
        mark = int.from_bytes(self._mark, "little")
        for first in range(0, len(joined), GROUPS):
            some = self._tokenizer.encode_batch_fast(joined[first : first + GROUPS], add_special_tokens=False)
            for at, got in enumerate(some, first):
                group = plain[at * TOGETHER : (at + 1) * TOGETHER]
                ids = np.array(got.ids, "<u4")
                ends = np.flatnonzero(ids == mark).tolist()
                if len(ends) != len(group):
                    raise ValueError("the separator was not kept apart")
                data, start = ids.tobytes(), 0
                for word, end in zip(group, ends):
                    out[word] = data[4 * start : 4 * end]
                    start = end + 1
        return out


def _words(texts: list[str]) -> tuple[pa.Array, np.ndarray, list[int]]:
    """Keys of all texts one after the other, where each text ends, and which text it is."""
    plain, odd, rows = [], [], []
    for k, text in enumerate(texts):
        if _BARE in text or _WHOLE in text or _RUN.search(text):
            odd.append(k)
            rows.append(keys(text))
        else:
            plain.append(k)
    # marks make the parts around a line break keys of their own
    marked = [_BARE + texts[k].replace("\n", f" {_WHOLE}\n {_BARE}") for k in plain]
    lists = pc.split_pattern(pa.array(marked, pa.large_string()), " ")
    counts = np.concatenate([pc.list_value_length(lists).to_numpy(zero_copy_only=False), [len(row) for row in rows]])
    words = pa.concat_arrays([lists.flatten(), pa.array([key for row in rows for key in row], pa.large_string())])
    return words, np.cumsum(counts, dtype=np.int64), plain + odd


def keys(text: str) -> list[str]:
    """Keys of the parts of a text that has runs of white space or marks; their ids joined are those of the text."""
    if _BARE in text or _WHOLE in text:
        return [_WHOLE + text]
    first, *rest = _BOUNDARY.split(text)
    return [_WHOLE + first, *(part[1:] if part.isprintable() and part.count(" ") == 1 else _WHOLE + part for part in rest)]
