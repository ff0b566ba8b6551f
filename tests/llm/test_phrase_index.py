import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import DOCS, EDGE_TEXTS, documents, stored, words

from eventmart.llm import phrase_index, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows(text, size=10):
    w = split(text)
    return [w[i : i + size] for i in range(max(1, len(w) - size + 1))] if w else []


def plain(docs, items, size=10):
    out = []
    for doc_id, text in docs:
        w, hit, found = split(text), set(), set()
        for item, its in items:
            for phrase in windows(its, size):
                for at in range(len(w) - len(phrase) + 1):
                    if w[at : at + len(phrase)] == phrase:
                        hit |= set(range(at, at + len(phrase)))
                        found.add("" if item is None else str(item))
        ids = ",".join(sorted(found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def fixture():
    rng = random.Random(4)
    items = [(k, words(100 + k, 3 + 2 * k, 30)) for k in range(14)]
    items += [(3, items[5][1]), (None, "Ab, cd! ef"), (90, None), (91, ""), (92, " .,; "), (93, "é Über ñandú 7"), (94, "w1")]
    texts = list(EDGE_TEXTS) + [words(k, 60, 30) for k in range(20)]
    for k, (_, text) in enumerate(items):
        around = words(500 + k, 15, 30).split()
        around[7:7] = [(text or "").upper().replace(" ", rng.choice([" ", ", ", "\n"]))]
        texts.append(" ".join(around))
    texts += ["AB-CD_ef" * 3, "ab cd eF", texts[-1], texts[-1], "w1 " * 300, "ÉÜ é über Ñandú 7", "é über ñandú 7"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[-2]), (2, texts[-9]), (2, texts[-9])]
    return rows, items


def tables(spark, tmp_path, rows, items):
    stored(spark, tmp_path, spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3))
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as path", "'y' as doc_id")
    return stored(spark, tmp_path, bench, "benchmark")


def test_query_equals_plain_search(spark, tmp_path):
    rows, items = fixture()
    got = queries.QUERIES["op12_benchmark_decontamination"](spark, tables(spark, tmp_path, rows, items))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, items)


@pytest.mark.parametrize("empty", ["documents", "benchmark", "both"])
def test_empty_tables(spark, tmp_path, empty):
    rows, items = fixture()
    rows = [] if empty != "benchmark" else rows[:5]
    items = [] if empty != "documents" else items
    folder = tables(spark, tmp_path, rows, items)
    got = queries.QUERIES["op12_benchmark_decontamination"](spark, folder).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, items)


def test_columns_with_names_of_the_operator(spark):
    docs = documents(spark, ["one two three"]).selectExpr("*", "1 as path", "2 as words", "3 as items", "4 as n_hit", "5 as documents")
    bench = spark.createDataFrame([(1, "two three", 1)], "item_id long, text string, path int")
    got = phrase_index.contamination(phrase_index.build_index(docs), bench, 2).collect()
    assert [tuple(r) for r in got] == [(0, 3, 2, ["1"])]


def near(w, phrase, slop):
    """Places where each word of the phrase lies within ``slop`` words of where the phrase has it."""
    return [
        s for s in range(-slop, len(w) + slop)
        if all(any(0 <= q < len(w) and w[q] == word for q in range(s + k - slop, s + k + slop + 1)) for k, word in enumerate(phrase))
    ]


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_search_finds_phrases_and_neighbourhoods(spark, slop):
    texts = [words(k, 70, 12) for k in range(25)] + [None, "", "w1", "w2 w1"]
    items = [(k, words(300 + k, 2 + k % 5, 12)) for k in range(12)]
    want = []
    for d, text in enumerate(texts):
        w = split(text)
        for item, its in items:
            for at, phrase in enumerate(windows(its, 4)):
                for s in near(w, phrase, slop):
                    want.append((d, s, str(item), at, len(phrase), s >= 0 and w[s : s + len(phrase)] == phrase))
    index = phrase_index.build_index(documents(spark, texts).repartition(4))
    got = phrase_index.search(index, spark.createDataFrame(items, "item_id long, text string"), 4, slop).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert any(w[-1] for w in want)


def test_index_is_asked_again(spark):
    index = phrase_index.build_index(documents(spark, ["one two three", "two three four"]))
    for text, hit in (("two three", [2, 2]), ("four", [0, 1]), ("five", [0, 0])):
        bench = spark.createDataFrame([(1, text)], "item_id long, text string")
        assert sorted(r.n_hit for r in phrase_index.contamination(index, bench, 3).collect()) == hit


def test_window_must_fit_between_documents(spark):
    bench = spark.createDataFrame([(1, "x")], "item_id long, text string")
    with pytest.raises(ValueError):
        phrase_index.search(phrase_index.build_index(documents(spark, ["x"])), bench, 60, 2)


def test_long_texts_are_split_alike(monkeypatch):
    text = (" ".join(EDGE_TEXTS[2:]) + words(1, 3000)).encode()
    whole = phrase_index.word_numbers(text, phrase_index._Numbers())
    for stretch in (1, 7, 100):
        monkeypatch.setattr(phrase_index, "STRETCH", stretch)
        assert (phrase_index.word_numbers(text, phrase_index._Numbers()) == whole).all()


def test_small_portions_and_gaps(tmp_path, monkeypatch):
    """One block, asked in portions of few candidates; a phrase never reaches into the next document."""
    numbers = phrase_index._Numbers()
    texts = [phrase_index.word_numbers(t.encode(), numbers) for t in ("a b a b a", "", "b a b", "a")]
    made = phrase_index._stored_block(f"file://{tmp_path}/i", [7, 8, None, 9], texts, numbers)
    block = phrase_index.Block(made.column("path")[0].as_py())
    assert block.doc_ids.to_pylist() == [7, 8, None, 9] and block.words.tolist() == [5, 0, 3, 1]
    terms = phrase_index._Numbers()
    held = [("x", 0, np.array([phrase_index.word_numbers(t, terms)], np.int32)) for t in (b"a b", b"b a", b"a a", b"a c")]
    made = phrase_index._stored_batch(f"file://{tmp_path}/p", held, terms)
    phrases = phrase_index.Phrases(made.column("path")[0].as_py())
    for candidates in (1, 3, 1 << 20):
        monkeypatch.setattr(phrase_index, "CANDIDATES", candidates)
        found = sorted((int(w), int(p)) for which, place in block.find(phrases) for w, p in zip(which, place))
        a, c = block.first[0], block.first[2]
        assert found == [(0, a), (0, a + 2), (0, c + 1), (1, a + 1), (1, a + 3), (1, c)]
    assert pa.types.is_binary(phrases.terms.type)
