import random

import numpy as np
import pytest
from check_oracle import compare, connect
from llm_helpers import DOCS, EDGE_TEXTS, documents, stored, words

from eventmart.llm import near_dedup, queries
from eventmart.llm.components import components


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(3)
    n = 300
    edges = {
        "path": [(k * 7919 % n, (k + 1) * 7919 % n) for k in range(n - 1)],
        "star": [(299, k) for k in range(1, 299)] + [(5, 5)],
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(180)],
    }[shape]
    got = components(spark.createDataFrame(edges + edges[:3] + [(b, a) for a, b in edges[:5]] + [(None, 1)], "a long, b long"))
    nodes = {x for a, b in edges for x in (a, b) if a != b}
    want = union_find(nodes, [e for e in edges if e[0] != e[1]])
    assert {r["node"]: r["component"] for r in got.collect()} == want


def shingle_set(text, k):
    parts = (text or "").encode().lower().split()
    if not parts:
        return frozenset()
    return frozenset(tuple(parts[i : i + k]) for i in range(max(1, len(parts) - k + 1)))


def brute(rows, k, percent=80):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    edges = []
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    edges.append((i, j))
    found = union_find([i for i, _ in rows], edges)
    return {i: (len(s), found[i], found[i] == i) for i, s in sets}


def corpus(seed, groups, most):
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        base = words(1000 * seed + g, rng.choice([1, 2, 6, 40, 150]), 5000).split()
        for _ in range(rng.randrange(1, most)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 10)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup_query_equals_brute_force(spark, tmp_path, seed):
    texts = corpus(seed, 60, 12) + EDGE_TEXTS + corpus(seed + 10, 1, 150)
    rows = [((k * 101) % 4999, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = queries.QUERIES["op1_minhash_near_dedup"](spark, stored(spark, tmp_path, df)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute(rows, 2)


def test_near_dedup_without_pivot_rounds(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "ROUNDS", 0)
    monkeypatch.setattr(near_dedup, "PIVOTS", 0)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rows = list(enumerate(corpus(5, 30, 40)))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = near_dedup.near_duplicates(df, 5).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute(rows, 5)


def test_null_and_repeated_ids(spark):
    text = words(1, 40)
    df = spark.createDataFrame(
        [(None, text, "en", "s", 0), (None, None, "en", "s", 0), (4, text, "en", "s", 0), (4, text, "en", "s", 0), (9, text.upper() + " more", "en", "s", 0)], DOCS
    )
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(df).collect()), key=repr)
    assert [r[0] for r in got] == [4, 4, 9, None, None]
    assert [r[2] for r in got] == [4, 4, 4, None, None]
    assert [r[3] for r in got] == [True, True, False, True, True]
    kept = near_dedup.distinct_documents(df.withColumn("class", near_dedup.F.lit("mine")))
    assert kept.columns == [*df.columns, "class"]
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == ["4", "None", "None"]


def test_near_dedup_of_nothing(spark):
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0
    assert near_dedup.distinct_documents(documents(spark, ["", None])).count() == 2


def test_odd_sketch_estimates():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(200):
        base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        other = np.concatenate([base[:360], rng.integers(0, 1 << 63, 40, dtype=np.uint64)])
        a, b = near_dedup.minhashes(np.unique(base)), near_dedup.minhashes(np.unique(other))
        x, y = (np.frombuffer(near_dedup.odd_sketch(s), np.uint64) for s in (a, b))
        errors.append(float(near_dedup.estimated(np.array([np.bitwise_count(x ^ y).sum()]))[0]) - 360 / 440)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < near_dedup.MARGIN / 5


def test_query_equals_sql(spark):
    sf, key = "/root/testdata/sf0.001", "op1_minhash_near_dedup"
    text, good = compare(spark, connect(sf), sf, key, queries.QUERIES[key], queries.SQL[key])
    assert good, text
