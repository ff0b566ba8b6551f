import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
from llm_helpers import DOCS, documents, stored, words
from test_near_dedup import brute, corpus
from test_tokens import check_packing
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from eventmart.llm import encoding, mixing, packing


def test_stages_against_plain_versions(spark, tmp_path):
    rng_texts = corpus(3, 40, 6)
    texts = rng_texts + ["1234 567", "", None, "write to a.b@mail.example.com now please, " + words(77, 30), words(78, 5000)]
    df = documents(spark, texts).unionByName(documents(spark, [words(900 + k, 40, 90) for k in range(30)], 1000, lang="de", source="other"))
    sf_dir = stored(spark, tmp_path, df)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_dedup", "personal_data", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    kept = stages["language"](spark, docs, sf_dir)
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == df.columns
    assert {i for i, _ in rows} <= {r["doc_id"] for r in df.collect() if re.search(r"[^\W\d_]", r["text"] or "")}

    single = stages["near_dedup"](spark, kept, sf_dir)
    assert single.columns == df.columns
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, (_, _, k) in brute(rows, 5).items() if k)

    masked = stages["personal_data"](spark, single, sf_dir)
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    after = {r["doc_id"]: r["text"] for r in masked.collect()}
    changed = {i for i in before if before[i] != after[i]}
    assert masked.columns == df.columns and before.keys() == after.keys()
    assert changed == {i for i, t in before.items() if "@" in t}
    assert all("write to <EMAIL> now" in after[i] for i in changed)

    mixed = stages["mixing"](spark, masked, sf_dir)
    rates = {r["source"]: r for r in mixing.rates(masked).collect()}
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == df.columns and set(copies) <= set(after)
    for source, r in rates.items():
        mine = [copies[x["doc_id"]] for x in masked.filter(mixing.F.col("source") == source).collect()]
        assert abs(sum(mine) - r["rate"] * len(mine)) <= 5 * math.sqrt(r["rate"] * len(mine)) + 1

    packed = stages["packing"](spark, mixed, sf_dir).collect()
    check_packing(packed, corpus_pipeline.CAPACITY)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {}
    for r in sorted(packed, key=lambda r: (r["doc_id"], r["start"])):
        found.setdefault(r["doc_id"], Counter())[r["piece"], r["start"], bytes(r["ids"])] += 1
    for doc_id, parts in found.items():
        assert set(parts.values()) == {copies[doc_id]}
        ids = np.frombuffer(b"".join(p[2] for p in parts), "<u4").tolist()
        assert ids == plain.encode(after[doc_id] or "", add_special_tokens=False).ids + [0]


def test_run_and_empty_tables(spark, tmp_path):
    sf_dir = stored(spark, tmp_path, spark.createDataFrame([], DOCS))
    assert entry.queries()["pipeline"](spark, sf_dir).count() == 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_workers_give_memory_back_when_a_task_ends(monkeypatch):
    from eventmart.llm import common

    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    each = common.released(lambda batches: (b + 1 for b in batches))
    assert list(each([1, 2])) == [2, 3] and calls == [1]
    broken = common.released(lambda batches: (1 // b for b in batches))
    try:
        list(broken([1, 0]))
    except ZeroDivisionError:
        calls.append(2)
    assert calls == [1, 1, 2]


def test_packing_encodes_a_large_batch_in_parts(monkeypatch):
    class Docs:
        def mapInArrow(self, function, schema):
            return function

    held, given = [], []
    whole = encoding.Encoder.encode
    monkeypatch.setattr(packing, "spread", lambda docs: docs)
    monkeypatch.setattr(packing, "pack", lambda items, capacity, free: items)
    monkeypatch.setattr(encoding.Encoder, "encode", lambda self, texts: held.append(sum(map(len, texts))) or whole(self, texts))
    texts = [None, "", *(words(k, 20_000, 30_000) for k in range(30)), "w " * 700_000, None]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    found: dict[int, bytes] = {}
    encoding.forget()
    for part in corpus_pipeline.pack_sequences(None, Docs(), "")(iter([batch, batch.slice(0, 0)])):
        given.append(part.num_rows)
        for doc_id, ids in zip(part.column("doc_id").to_pylist(), part.column("ids").to_pylist()):
            found[doc_id] = found.get(doc_id, b"") + ids
    # no more than a part and the text that ends it
    assert len(given) > 3 and max(held) <= 2_500_000 < sum(held) == sum(len(t or "") for t in texts)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert list(found) == list(range(len(texts)))
    for doc_id in (0, 1, 2, 9, 31, 33):
        assert np.frombuffer(found[doc_id], "<u4").tolist() == plain.encode(texts[doc_id] or "", add_special_tokens=False).ids + [0]


def test_few_encodings_at_a_time():
    own = encoding.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    sizes, inner = [], own._tokenizer

    class Counting:
        def encode_batch_fast(self, texts, **options):
            sizes.append(len(texts))
            return inner.encode_batch_fast(texts, **options)

    own._tokenizer = Counting()
    texts = [" ".join(f"q{k}x" for k in range(12_345))]
    assert np.frombuffer(own.encode(texts)[0], "<u4").tolist() == inner.encode(texts[0], add_special_tokens=False).ids
    assert max(sizes) <= encoding.GROUPS and len(sizes) > 1
