import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyspark
import pytest
from llm_helpers import DOCS, EDGE_TEXTS, documents, stored, words

from eventmart.llm import language_model as lm
from eventmart.llm import queries
from eventmart.llm.common import word_hashes


@pytest.mark.parametrize("top", [3, 1 << 20, 1 << 55])
def test_elias_fano(top, monkeypatch):
    monkeypatch.setattr(lm, "_STRETCH", 64)
    rng = np.random.default_rng(top)
    values = np.sort(rng.integers(0, top, 1000).astype(np.uint64))
    got = lm.EliasFano.opened(lm.EliasFano.parts(values))
    places = rng.integers(0, 1000, 300)
    assert (got.at(places) == values[places]).all()
    targets = np.concatenate([values[::7], rng.integers(0, top, 200).astype(np.uint64), [np.uint64(top)]])
    assert (got.successors(targets) == np.searchsorted(values, targets)).all()
    assert lm.EliasFano.opened(lm.EliasFano.parts(values[:0])).successors(targets).tolist() == [0] * len(targets)


def test_word_hashes_follow_words():
    texts = ["", " ", "a", " A\tb  a\x0b\x1cb é É", words(3, 400) + " " + "x" * 300 + "\n" + words(3, 400)]
    seen = {}
    for text in texts:
        parts = text.encode().lower().split()
        for stretch in (1 << 20, 50):
            got = word_hashes(text, stretch).tolist()
            assert len(got) == len(parts)
            for part, h in zip(parts, got):
                assert seen.setdefault(part, h) == h
    assert len(set(seen.values())) == len(seen)


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def plain(rows):
    train = [tokens(t) for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip([b" ", *t], t))
    n, v, m = sum(c.values()), len(c), lm.STRENGTH
    out = []
    for i, t in rows:
        base = score = 0.0
        for before, w in zip([b" ", *tokens(t)], tokens(t)):
            p = (c[w] + 1) / (n + v + 1)
            base += math.log10(p)
            context = len(train) if before == b" " else c[before]
            score += math.log10((pairs[before, w] + m * p) / (context + m))
        out.append((i, zlib.crc32(str("" if i is None else i).encode()) % 7 == 2, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, base, score))
    return out


def held_against(got, rows):
    want = sorted(plain(rows), key=repr)
    got = sorted(map(tuple, got), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert abs(g[6] - w[6]) < 0.004 * w[2] ** 0.5 + 1e-5 * abs(w[6]) + 0.004


def test_query_against_plain_model(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lm, "BATCH_DOCS", 50)
    texts = EDGE_TEXTS + [words(k % 90, 5 + k % 70, 60 if k % 3 else 5000) + " The the THE" for k in range(300)]
    rows = list(enumerate(texts)) + [(None, "no id"), (5, "w1 w2"), (5, "w1 w2")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    held_against(queries.QUERIES["op8_ngram_scoring"](spark, stored(spark, tmp_path, df)).collect(), rows)


def test_one_word_everywhere(spark):
    rows = [(k, "same " * (k % 30) + f"x{k}") for k in range(200)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    held_against(lm.score_documents(df).collect(), rows)


def test_nothing_to_learn_and_nothing_to_score(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    held_against(lm.score_documents(documents(spark, ["a b"], held)).collect(), [(held, "a b")])
    assert lm.score_documents(documents(spark, [])).count() == 0


def test_more_shards_than_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 500)
    rows = [(k, words(k % 70, k % 90) + " same" * (k % 40)) for k in range(300)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    held_against(lm.score_documents(df).collect(), rows)


def shard(texts, each=10):
    """All tokens of some training texts, as one shard."""
    return pa.Table.from_batches([
        lm._shuffled([(k + j, (k + j) % 7 != 2, t or "") for j, t in enumerate(texts[k : k + each])], k, 1, np.zeros(0, np.uint64)) for k in range(0, len(texts), each)
    ])


def scorer(folder, monkeypatch, total):
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: type("Task", (), {"taskAttemptId": lambda self: 1})())
    return lm._scored_shard(str(folder), np.zeros(0, np.uint64), np.zeros(0, np.int64), total, 401)


def test_shard_in_ranges(tmp_path, monkeypatch):
    table = shard([*EDGE_TEXTS, *(words(k % 70, k % 90) + " same" * (k % 40) for k in range(300))])
    whole = scorer(tmp_path / "whole", monkeypatch, 20_000)(table)
    monkeypatch.setattr(lm, "RANGE_TOKENS", 50)
    assert scorer(tmp_path / "ranges", monkeypatch, 20_000)(table) == whole
    assert (tmp_path / "ranges/shard-000000.trie").read_bytes() == (tmp_path / "whole/shard-000000.trie").read_bytes()


def test_memory_of_a_shard(tmp_path, monkeypatch):
    table = shard([words(k, 5000) for k in range(200)])
    score = scorer(tmp_path, monkeypatch, 200 * 5001)
    tracemalloc.start()
    try:
        out = score(table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out.num_rows == 20
    assert peak < 60 * 200 * 5001  # bytes a token, beside its row in Arrow
