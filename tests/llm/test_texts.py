import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from check_oracle import compare, connect
from llm_helpers import DOCS, EDGE_TEXTS, documents, stored, words

from eventmart.llm import fingerprints, language, mixing, near_dedup, personal_data, queries

SF = "/root/testdata/sf0.01"


def plain_edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (doc_id, text) in enumerate(order):
        text, other = text or "", order[(k + 1) % len(order)][1] or ""
        changed = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        own, its, nexts = (fingerprints.fingerprint(t) for t in (text, changed, other))
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, its, fingerprints.likeness(own, its), fingerprints.likeness(own, nexts)))
    return out


@pytest.mark.parametrize("count", [1, 2, 60])
def test_fingerprints_query(spark, tmp_path, count):
    texts = (EDGE_TEXTS + [words(k, 5 + 7 * k) for k in range(60)])[-count:] if count < 60 else EDGE_TEXTS + [words(k, 5 + 7 * k) for k in range(60)]
    rows = [((k * 53) % 997 - 100, t) for k, t in enumerate(texts)]
    if count == 60:
        rows += [(None, "nobody"), (rows[3][0], "z same id"), (rows[3][0], "z same id")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(5)
    got = queries.QUERIES["op3_document_fingerprints"](spark, stored(spark, tmp_path, df)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_edits(rows)))


def test_fingerprints_of_nothing(spark, tmp_path):
    assert queries.QUERIES["op3_document_fingerprints"](spark, stored(spark, tmp_path, documents(spark, []))).count() == 0


def test_sketch_estimates_containment_and_merges():
    long, other = words(1, 20_000, 5000), words(2, 20_000, 5000)
    part = long[40_000:60_000]
    a, b = fingerprints.sketch(part), fingerprints.sketch(long)
    assert fingerprints.containment(a, b) > 0.95
    assert fingerprints.containment(fingerprints.sketch(other), b) < 0.05
    exact = {part[i : i + 16] for i in range(len(part) - 15)}
    assert abs(len(a) * fingerprints.FRACTION / len(exact) - 1) < 0.15
    both = fingerprints.values(fingerprints.merged(fingerprints.fingerprint(part), fingerprints.fingerprint(other)))
    assert set(both.tolist()) == set(a.tolist()) | set(fingerprints.sketch(other).tolist())


def test_texts_have_fingerprints_of_their_own():
    short = ["This.", "Anouble thwh.", "Thtion.", "x", "xx", *(words(k, 2 + k % 30) for k in range(60)), "ab" * 3000, "ba" * 3000]
    marks = [fingerprints.fingerprint(t) for t in short]
    assert len(set(marks)) == len(set(short))
    both = fingerprints.merged(*marks[3:5])
    assert both != fingerprints.merged(*marks[4:6])


@pytest.mark.parametrize("length", [1, 15, 16, 20, 60, 200, 1000, 10_000])
def test_likeness_is_near_containment_at_every_length(length):
    """Mean error within two standard errors of a sample of one hash in four; every value from 0 to 1."""
    off, counts = [], []
    for seed in range(40):
        text = words(seed, 3000)[:length]
        other = fingerprints.edited(text, words(1000 + seed, 3000)[:length])
        x, y = ({t[i : i + 16] for i in range(max(1, len(t) - 15))} for t in (text, other))
        got = fingerprints.likeness(fingerprints.fingerprint(text), fingerprints.fingerprint(other))
        assert 0.0 <= got <= 1.0 and (text != other or got == 1.0)
        if text != other and len(fingerprints.sketch(text)) and len(fingerprints.sketch(other)):
            off.append(abs(got - len(x & y) / min(len(x), len(y))))
            counts.append(min(len(x), len(y)))
    if off:
        assert np.mean(off) <= 2 * np.sqrt(3 * 0.25 / np.mean(counts))


def test_likeness_of_empty_sketches():
    empty = next(t for t in map(str, range(100)) if not len(fingerprints.sketch(t)))
    kept = next(t for t in map(str, range(100)) if len(fingerprints.sketch(t)))
    marks = [fingerprints.fingerprint(t) for t in ("", empty, kept)]
    assert [fingerprints.likeness(a, b) for a in marks for b in marks] == [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def test_sketch_in_stretches(monkeypatch):
    text = words(3, 3000)
    whole = fingerprints.sketch(text)
    monkeypatch.setattr(fingerprints, "_STRETCH", 100)
    assert (fingerprints.sketch(text) == whole).all()


def test_features_in_stretches(monkeypatch):
    text = words(3, 3000) + " éè"
    whole = language.features(text)
    monkeypatch.setattr(language, "_STRETCH", 50)
    assert np.allclose(language.features(text), whole)


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES["op5_language_id"](spark, SF).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"] and r["lang"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, tmp_path):
    texts = EDGE_TEXTS + ["123 !?", "²½", "the " * 50, "der die " * 50] * 3
    df = documents(spark, texts).unionByName(documents(spark, ["le la les"] * 9, 500, lang=None)).unionByName(documents(spark, ["der die das"] * 9, 600, lang="de"))
    got = queries.QUERIES["op5_language_id"](spark, stored(spark, tmp_path, df)).collect()
    assert len(got) == len(texts) + 18
    by_id = {r["doc_id"]: r for r in got}
    for k, t in enumerate(texts):
        assert (by_id[k]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))
    assert by_id[600]["lang_pred"] == "de"


def test_language_without_labels(spark, tmp_path):
    got = queries.QUERIES["op5_language_id"](spark, stored(spark, tmp_path, documents(spark, ["abc"], lang=None))).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)]
    assert queries.QUERIES["op5_language_id"](spark, stored(spark, tmp_path, documents(spark, []))).count() == 0


def test_related_languages_form_families():
    rng = np.random.default_rng(0)
    base = rng.random((2, language.DIMENSIONS))
    x, labels = [], []
    for k in range(4):
        own = base[k // 2] + 0.3 * rng.random(language.DIMENSIONS)
        x += [own + 0.1 * rng.random(language.DIMENSIONS) for _ in range(30)]
        labels += [k] * 30
    x = np.array(x, np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = language.fit_model(list("abcd"), np.array(labels), x)
    assert sorted(model.families) == [[0, 1], [2, 3]]
    assert (model.predict(x)[0] == labels).mean() > 0.95


def test_rejected_languages_go(spark):
    df = documents(spark, ["123", None, "hello there"])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = language.keep_known(df.unionByName(docs.select(df.columns)), language.learn(docs), 0.5)
    assert kept.columns == df.columns
    assert kept.filter("text is null or text = '123'").count() == 0


def test_mixing_equals_sql(spark):
    text, good = compare(spark, connect(SF), SF, "op4_poisson_mixing", queries.QUERIES["op4_poisson_mixing"], queries.SQL["op4_poisson_mixing"])
    assert good, text


def test_mixing_reaches_weights(spark):
    df = documents(spark, ["x" * 100] * 3000, source="big").unionByName(documents(spark, ["y" * 50] * 300, 5000, source="small"))
    df = df.unionByName(documents(spark, [None, "", "z"], 9000, source=None))
    got = mixing.mix(df, {"big": 3, "small": 1, None: 0}).groupBy("source").sum("n_chars").collect()
    sizes = {r["source"]: r[1] for r in got}
    assert set(sizes) == {"big", "small"}
    assert abs(sizes["small"] / sum(sizes.values()) - 0.25) < 0.03
    assert mixing.mix(df, {}).count() == 0
    assert mixing.mix(documents(spark, [])).count() == 0


def test_mixing_keeps_columns_and_repeats(spark):
    df = documents(spark, ["a", "a"]).withColumn("copy", queries.F.lit("old"))
    got = mixing.mix(df, {"s": 1})
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy", "shuffle_key"]
    assert got.schema["copy"].dataType.simpleString() == "int"


def test_poisson_distribution(spark):
    cdf = mixing.rates(documents(spark, ["x"] * 10)).collect()[0]
    assert cdf["rate"] == 1.0
    assert abs(cdf["cdf"][0] - np.exp(-1)) < 1e-15 and abs(cdf["cdf"][2] - 2.5 * np.exp(-1)) < 1e-15


def test_mixing_of_a_tiny_source(spark, tmp_path):
    """A source of one document beside a large one: some thousand copies, drawn in blocks, as in SQL."""
    df = documents(spark, ["x" * 3999] * 8, source="big").unionByName(documents(spark, ["y"], 50, source="tiny"))
    folder = stored(spark, tmp_path, df)
    rates = {r["source"]: (r["rate"], r["blocks"]) for r in mixing.rates(df).collect()}
    assert rates["tiny"][1] > 1 and rates["tiny"][0] / rates["tiny"][1] <= mixing.BLOCK_MEAN and rates["big"][1] == 1
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    expected = con.execute(queries.SQL["op4_poisson_mixing"]).fetchall()
    got = queries.QUERIES["op4_poisson_mixing"](spark, folder).select("doc_id", "text", "lang", "source", "n_chars", "copy", "shuffle_key").collect()
    assert sorted(map(tuple, got)) == sorted(expected)
    tiny = sorted(r["copy"] for r in got if r["source"] == "tiny")
    assert tiny == list(range(1, len(tiny) + 1)) and abs(len(tiny) - rates["tiny"][0]) < 6 * rates["tiny"][0] ** 0.5


def test_mixing_of_a_source_that_repeats_very_often(spark):
    df = documents(spark, ["x" * 39_999] * 8, source="big").unionByName(documents(spark, [""], 50, source="tiny"))
    got = mixing.mix(df, {"big": 0, "tiny": 1}).agg(queries.F.count("*"), queries.F.max("copy"), queries.F.countDistinct("shuffle_key")).collect()[0]
    assert abs(got[0] - 320_001) < 6 * 320_001**0.5 and got[0] == got[1] == got[2]


def test_stages_keep_columns_named_like_helpers(spark):
    names = ["_key", "key", "_spans", "spans", "_n", "n", "_u", "_source", "_cdf", "_blocks", "_first", "_kept_id", "_row", "a.b", "class", "node", "kept"]
    df = documents(spark, ["mail a@b.cd today", "the same words in two rows here", "the same words in two rows here", None, ""])
    df = df.unionByName(documents(spark, ["the same words in two rows here"], 1))
    for name in names:
        df = df.withColumn(name, queries.F.lit(f"mine {name}"))
    for stage in (personal_data.masked, near_dedup.distinct_documents, lambda d: mixing.mix(d).drop("copy", "shuffle_key")):
        out = stage(df)
        assert out.columns == df.columns
        rows = out.collect()
        assert rows and all(r[n] == f"mine {n}" for r in rows for n in names)
        if stage is near_dedup.distinct_documents:
            assert sorted(r["doc_id"] for r in rows) == [0, 1, 3, 4]
