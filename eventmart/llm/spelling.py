"""Spelling variants by pivotal grams.

The bigrams of each word are put in one order for all words, rare ones first. Its *prefix* are the first
three bigrams and every further occurrence of the third; its *pivots* are two bigrams of the prefix that
share no letter, chosen by dynamic programming so that the two are as rare as can be. One edit spoils one of
two such bigrams at most, so of two words one letter apart, the one whose prefix ends earlier in the order
has a pivot that is also in the other's prefix. Its place is limited by the edit: an edit before the right pivot
leaves that pivot and all letters behind it, any other leaves the left pivot and all letters before it.
Pivots with those letters therefore meet prefix bigrams with theirs in an equality join that also fixes
the length. Of what meets, words whose letters differ too much to be one edit apart are left out, and the
rest is verified by its edit distance.

Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case. Defined results: NULL,
empty and wordless texts hold no words; repeated rows count as often as they are there; ties go to
the word that is smaller in code-point order. Long texts are taken in stretches, an empty table gives an empty
result, and only the columns named are looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, saved
from .components import roots

#: Fixed by the method for one edit and grams of two letters: grams of a prefix, length of a shortest word.
PREFIX, GRAM, SHORTEST = 3, 2, 5
#: Distinct words a task counts before it passes them on.
HELD = 200_000
#: Characters of a text that are split into words at once.
STRETCH = 1 << 20

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_OTHER = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _runs(text: str) -> Iterator[list[str]]:
    at = 0
    while at < len(text):
        end = min(at + STRETCH, len(text))
        if end < len(text):
            found = _OTHER.search(text, end)
            end = found.start() if found else len(text)
        yield _RUN.findall(text, at, end)
        at = end


def word_counts(docs: DataFrame, misspell: int | None = None) -> DataFrame:
    """(word, n) of all words of ``docs`` (doc_id, text).

    With ``misspell`` a run whose crc32 of ``<doc_id>:<run>`` it divides loses the letter at that crc32
    modulo its length, for tests of the grouping; a NULL doc_id reads as empty text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                start = zlib.crc32(f"{doc_id}:".encode())
                for runs in _runs(text.as_py() or ""):
                    # a run is misspelt alike all over a document
                    own = Counter(runs)
                    for run, n in own.items():
                        word = run.translate(_LOWER)
                        if misspell is not None:
                            h = zlib.crc32(word.encode(), start)
                            if h % misspell == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                        held[word] += n
                    if len(held) >= HELD:
                        yield _counted(held)
                        held = Counter()
        if held:
            yield _counted(held)

    slim = docs.select(id_text().alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = slim.mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """(place in the order, frequency) of every bigram: rare ones first, ties by the bigram.

    Words are made of at most 90 letters, so there are at most 8,100 bigrams to bring to the driver.
    """
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.select(F.explode(F.transform(places, lambda i: F.substring("word", i, GRAM))).alias("gram"))
    counted = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "gram").collect()
    return {r["gram"]: (k, r["n"]) for k, r in enumerate(counted)}


def prefix(word: str, order: dict[str, tuple[int, int]]) -> list[tuple[int, int]]:
    """(place in the order, place in the word) of the grams of a word's prefix."""
    ranked = sorted((order[word[i : i + GRAM]][0], i) for i in range(len(word) - GRAM + 1))
    last = ranked[PREFIX - 1][0]
    return [g for k, g in enumerate(ranked) if k < PREFIX or g[0] == last]


def pivots(grams: list[tuple[int, int]], frequency: list[int]) -> list[tuple[int, int]]:
    """Two grams of a prefix that share no letter, with the smallest sum of frequencies.

    ``frequency`` is by place in the order. From left to right, ``one`` is the rarest gram that ends before the
    current one begins, ``two`` the best pair so far. Of any three grams the outer two are disjoint.
    """
    along = sorted((at, rank) for rank, at in grams)
    one, two, behind = None, None, 0
    for at, rank in along:
        while behind < len(along) and along[behind][0] + GRAM <= at:
            cost = (frequency[along[behind][1]], along[behind][1], along[behind][0])
            one = cost if one is None or cost < one else one
            behind += 1
        if one is not None:
            pair = (one[0] + frequency[rank], one[1:], (rank, at))
            two = pair if two is None or pair < two else two
    return [two[1], two[2]]


def letters(word: str) -> int:
    """One bit for each letter that occurs an odd number of times; one edit changes two bits at most."""
    bits = 0
    for c in map(ord, word):
        bits ^= 1 << (c - 97 if 97 <= c < 123 else 26 + c % 37)
    return bits


def near_words(words: DataFrame) -> DataFrame:
    """(word, near) of all pairs of words exactly one inserted, deleted or replaced letter apart, both ways round.

    ``words`` has distinct words of at least ``SHORTEST`` letters.
    """
    order = gram_order(words)
    frequency = [n for _, n in sorted(order.values())]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for word in batch.column("word").to_pylist():
                grams, size = prefix(word, order), len(word)
                own = (grams[-1][0], letters(word), word)
                for _, at in grams:
                    out += [(False, True, size, word[: at + GRAM], *own), (False, False, size, word[at:], *own)]
                (_, left), (_, right) = pivots(grams, frequency)
                for its in (size - 1, size, size + 1):
                    out += [(True, True, its, word[: left + GRAM], *own), (True, False, its, word[right:], *own)]
            kinds = [pa.bool_(), pa.bool_(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(columns, names=["pivot", "left", "size", "part", "last", "letters", "word"])

    schema = "pivot boolean, left boolean, size int, part string, last int, letters long, word string"
    grams = words.select("word").mapInArrow(keys, schema)
    # parts that collide only meet in vain
    index = saved(grams.select("pivot", F.xxhash64("left", "size", "part").alias("key"), "last", "letters", "word"), "spelling-grams")
    asking = index.filter("pivot").select("key", F.col("last").alias("ends"), F.col("letters").alias("its"), F.col("word").alias("near"))
    meeting = index.filter("not pivot").join(asking, "key").filter("ends <= last and bit_count(letters ^ its) <= 2")
    close = meeting.filter(F.levenshtein("word", "near", 1) == 1).select("word", "near")
    both = close.unionByName(close.select(F.col("near").alias("word"), F.col("word").alias("near")))
    return saved(both.distinct(), "spelling-near")


def variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of each row of ``words`` (word, n).

    The form of a word is its near word of largest n, if that is at least ``factor`` times its own; the
    root is the last word on the way from form to form. ``factor`` is above 1, so no way turns back.
    """
    if factor <= 1:
        raise ValueError("factor must be above 1")
    words = saved(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    near = near_words(words.select("word"))
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    links = near.join(counts, "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    known = words.join(links, "word", "left").withColumn("_n", -F.col("best.minus"))
    large = F.col("_n") >= factor * F.col("n")
    known = saved(
        known.select(
            "word", F.when(large, F.col("best.near")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(large, F.col("_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    led = known.filter("form is not null").select(F.col("word").alias("node"), F.col("form").alias("parent"))
    found = roots(led).select(F.col("node").alias("word"), F.col("parent").alias("root"))
    return known.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
