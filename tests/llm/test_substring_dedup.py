import hashlib
import random

import numpy as np
import pytest
from llm_helpers import DOCS, EDGE_TEXTS, documents, stored, words

from eventmart.llm import queries
from eventmart.llm import substring_dedup as sd


def plain(rows, length=100):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            string = data[s : s + length]
            if string in seen:
                gone[s : s + length] = True
            seen.add(string)
        left = bytes(b for b, g in zip(data, gone) if not g)
        runs = int(gone[0] if len(gone) else 0) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((doc_id, len(data), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return out


def corpus(seed, count):
    rng = random.Random(seed)
    passages = [words(seed * 50 + k, rng.randrange(5, 60)) for k in range(8)]
    texts = []
    for k in range(count):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.randrange(5)
            parts.append(rng.choice(passages) if kind < 2 else "ab" * rng.randrange(150) if kind == 2 else words(9000 + seed * 100 + k, rng.randrange(40)))
        text = (" é " if k % 4 == 0 else " ").join(parts)
        if texts and rng.random() < 0.3:  # an edited copy
            text = rng.choice(texts)
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(["", "X", "YY", " new "]) + text[at + rng.randrange(3) :]
        texts.append(text)
    return texts


@pytest.mark.parametrize(("seed", "large"), [(1, 512), (2, 512), (3, 3)])
def test_query_equals_plain_version(spark, tmp_path, monkeypatch, seed, large):
    monkeypatch.setattr(sd, "LARGE", large)
    texts = corpus(seed, 80) + EDGE_TEXTS
    rows = [((k * 61) % 997, t) for k, t in enumerate(texts)] + [(None, texts[0])]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(4)
    got = queries.QUERIES["op10_suffix_dedup"](spark, stored(spark, tmp_path, df)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(rows), key=repr)


def test_repeated_ids_and_nothing(spark):
    text = words(1, 200)
    rows = [(1, text), (1, text), (1, words(2, 200) + text), (2, text)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in sd.remove_repeats(df).collect())
    size = len(text)
    assert got[3] == (2, size, size) and got[0][1:] == got[1][1:]
    assert sum(r[2] for r in got[:3]) in (size, 2 * size)
    assert sd.remove_repeats(documents(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_suffix_sort(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1500] = data[:500]
    starts = rng.permutation(2900)[:700]
    group = np.sort(rng.integers(0, 9, 700))
    group = np.unique(group, return_inverse=True)[1]
    order = sd.suffix_sorted(data, sd.Hashes(data), starts, group, 100)
    want = sorted(range(700), key=lambda k: (group[k], data[starts[k] : starts[k] + 100].tobytes(), k))
    assert order.tolist() == want
    seen, repeated = set(), []
    for k in range(700):
        string = (group[k], data[starts[k] : starts[k] + 100].tobytes())
        repeated.append(string in seen)
        seen.add(string)
    assert sd.repeats(data, starts, group, 100).tolist() == repeated


def test_colliding_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(sd.Hashes, "of", lambda self, start, length: np.zeros(len(start), np.uint64))
    data = np.random.default_rng(0).integers(0, 256, 1000).astype(np.uint8)
    data[500:700] = data[:200]
    starts = np.array([0, 50, 300, 500, 550])
    assert sd.repeats(data, starts, np.zeros(5, np.int64), 100).tolist() == [False, False, False, True, True]


def test_blocks_in_stretches(monkeypatch):
    data = np.frombuffer(words(5, 3000).encode(), np.uint8)
    whole = sd.blocks(data, 100)
    assert whole[3].sum() == len(data) - 99 and (whole[4] < 69).all() and (whole[4] - whole[3] + 1 >= 0).all()
    monkeypatch.setattr(sd, "_STRETCH", 1000)
    cut = sd.blocks(data, 100)
    assert cut[3].sum() == whole[3].sum()
    assert set(whole[0].tolist()) == set(cut[0].tolist())


@pytest.mark.parametrize("size", [1, 2, 3, 1000])
def test_blocks_told_apart_over_small_batches(spark, size):
    names = "kind int, h long, b long, d long, e long, p long, m long"
    blocks = {4: [10, *[20] * 8, 30], 5: [10, 20, 20, 20, 20, 20, 20, 30, 30, 40], 6: [7] * 9, 8: [1, 1, 1, 1, 2], 9: [3, 4]}
    rows = [(0, h, b, d, 0, 0, 1 << 8) for h, found in blocks.items() for d, b in enumerate(found)]
    rows += [(1, 5, 0, d, 0, 0, 100) for d in range(20, 27)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        got = [tuple(r) for r in sd._told_apart(spark.createDataFrame(rows, names), 100).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(r[1:3] for r in got if r[0] == 2) == [(4, 10), (4, 20), (4, 30), (5, 10), (5, 20), (5, 30), (5, 40), (8, 1), (8, 2), (9, 3), (9, 4)]
    first = {(h, b): found.index(b) for h, found in blocks.items() for b in found}
    assert all(r[3] == first[r[1], r[2]] for r in got if r[0] == 2)
    assert sum(r[0] == 1 for r in got) == 7 + len(rows) - 7 - len(first)
