import numpy as np
import pytest
from check_oracle import compare, connect
from test_near_dedup import union_find

from eventmart.llm import embedding_dedup, queries

SF = "/root/testdata/sf0.01"


def brute(rows, threshold=0.95):
    good = [(k, np.array(v, float)) for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    links, edges = [0] * len(rows), []
    for x, (p, a) in enumerate(good):
        for q, b in good[:x]:
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold and rows[p][0] is not None and rows[q][0] is not None:
                links[p] += 1
                links[q] += 1
                edges.append((rows[p][0], rows[q][0]))
    found = union_find({i for i, _ in rows if i is not None}, edges)
    return sorted(((i, links[k], None if i is None else found[i], i is None or found[i] == i) for k, (i, _) in enumerate(rows)), key=repr)


def table(seed, groups=60, size=12):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = rng.standard_normal(24)
        for _ in range(rng.integers(1, size)):
            rows.append((base + rng.choice([0, 0.1, 0.2]) * rng.standard_normal(24)).astype(np.float32).tolist())
    return [((k * 37) % 9973, v) for k, v in enumerate(rows)]


@pytest.mark.parametrize("block", [4096, 5])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "_ROWS", 3)
    rows = table(1) + [(20001, None), (20002, []), (20003, [0.0] * 24), (20004, [1.0, None]), (20005, [float("nan")] * 24), (20006, [1.0, 2.0]), (20007, [2.0, 4.0]), (None, [1.0, 2.0]), (20008, [float("inf"), 1.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, class int"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_repeated_ids(spark):
    rows = [(3, [1.0, 0.0]), (3, [0.0, 1.0]), (5, [0.0, 2.0]), (1, [1.0, 0.01]), (3, [1.0, 0.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, got.collect())) == [(1, 2, 1, True), (3, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False), (5, 1, 1, False)]


def test_no_vectors(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_query_equals_sql(spark):
    key = "op2_embedding_near_dedup"
    text, good = compare(spark, connect(SF), SF, key, queries.QUERIES[key], queries.SQL[key])
    assert good, text
