import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import DOCS, EDGE_TEXTS, documents, stored, words
from tokenizers import Tokenizer

from eventmart.llm import binary_tokens, packing, queries
from eventmart.llm.encoding import Encoder

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_encode_like_whole_texts(path):
    rng = random.Random(4)
    parts = ["the", "Thing", " ", "  ", "\n", "\t", "\u00a0", "\u0301", "e", "'s", "don't", "12", "3.5", "\u00e9t\u00e9", "!?", "\x1f", "\u4e2d\u6587", "<|endoftext|>", "\r\n", ".", ",", "|", "\0", "\1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)] + [t or "" for t in EDGE_TEXTS]
    plain = Tokenizer.from_file(path)
    for text, got in zip(texts * 2, (own := Encoder(path)).encode(texts) + own.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("width", [1, 3, 8, 15, 16, 17, 25])
@pytest.mark.parametrize("count", [0, 1, 7, 8, 9, 1000])
def test_bits_round_trip(width, count):
    ids = np.random.default_rng(count).integers(0, 1 << width, count).astype(np.uint32)
    data = binary_tokens.pack(ids, width)
    assert len(data) == -(-count * width // 8)
    assert (binary_tokens.unpack(data, count, width) == ids).all()


def test_random_access(tmp_path):
    ids = np.random.default_rng(1).integers(0, 49408, 100_000).astype(np.uint32)
    writer = binary_tokens.Writer(f"{tmp_path}/a.bin", 16, "1")
    for k, part in enumerate(np.split(ids, [10, 10, 50_000])):
        writer.add(k, part)
    writer.close()
    reader = binary_tokens.Reader(f"{tmp_path}/a.bin")
    for a, b in [(0, 1), (8190, 8195), (99_999, 100_000), (0, 100_000), (5, 5)]:
        assert (reader.read(a, b) == ids[a:b]).all()
    assert [(d, s, len(x)) for d, s, x in reader.documents()] == [(0, 0, 10), (1, 10, 0), (2, 10, 49_990), (3, 50_000, 50_000)]


def expected_tokens(rows):
    plain, out, at = Tokenizer.from_file(WORD), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_binary_tokens_query(spark, tmp_path):
    texts = EDGE_TEXTS + [words(k, 50) for k in range(40)]
    rows = [((k * 37) % 101, t) for k, t in enumerate(texts)] + [(None, "no id"), (5, "twice"), (5, "twice")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = queries.QUERIES["op7_binary_tokens"](spark, stored(spark, tmp_path, df))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == expected_tokens(rows)


def test_tokens_of_no_documents(spark, tmp_path):
    assert queries.QUERIES["op7_binary_tokens"](spark, stored(spark, tmp_path, documents(spark, []))).count() == 0


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def best_fit(lengths, capacity):
    gaps = []
    for s in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= s]
        g = min(fit, default=capacity)
        if fit:
            gaps.remove(g)
        gaps.append(g - s)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_rank_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 200])
    lengths = [min(capacity, 1 + int(rng.expovariate(4 / capacity))) for _ in range(rng.choice([1, 30, 700]))]
    counts = {s: lengths.count(s) for s in set(lengths)}
    seen, bins = {}, {}
    for s, r0, r1, first, per, offset in packing.plan(counts, capacity):
        for r in range(r0, r1):
            assert (s, r) not in seen
            seen[s, r] = 1
            bins.setdefault(first + (r - r0) // per, []).append((offset + (r - r0) % per * s, s))
    assert len(seen) == len(lengths)
    assert check_packing([{"sequence_id": b, "offset": o, "length": s} for b, x in bins.items() for o, s in x], capacity) == len(bins)
    assert len(bins) <= best_fit(lengths, capacity)
    for parts in bins.values():
        assert sum(3 * s > capacity for _, s in parts) <= 2


def test_packing_query(spark, tmp_path):
    texts = EDGE_TEXTS + [words(k, 20 + 13 * k) for k in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (7, texts[7])]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = queries.QUERIES["op9_best_fit_packing"](spark, stored(spark, tmp_path, df)).collect()
    plain, want = Tokenizer.from_file(BYTE), []
    for doc_id, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((doc_id, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    assert check_packing(got, 2048) <= best_fit([w[3] for w in want], 2048)


def test_packing_nothing_and_extra_columns(spark):
    assert packing.pack(spark.createDataFrame([], "length int"), 8).count() == 0
    df = spark.createDataFrame([(3, "x", 9)] * 7, "length int, note string, offset int")
    got = packing.pack(df, 8)
    assert got.columns == ["length", "note", "sequence_id", "offset"]
    assert check_packing(got.collect(), 8) == 4


def test_packing_keeps_columns_named_like_helpers(spark):
    names = ["_part", "_rank", "_n", "_before", "n", "length"]
    items = spark.createDataFrame([(k % 7 + 1,) for k in range(200)], "length int")
    for name in names[:-1]:
        items = items.withColumn(name, queries.F.lit(f"mine {name}"))
    got = packing.pack(items, 10)
    assert got.columns == [*items.columns, "sequence_id", "offset"]
    rows = got.collect()
    assert len(rows) == 200 and all(r[n] == f"mine {n}" for r in rows for n in names[:-1])
