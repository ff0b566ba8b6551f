import hashlib
import random
import re

from llm_helpers import DOCS, EDGE_TEXTS, documents, stored, words

from eventmart.llm import personal_data, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if good(k, m.group())]


def check(row, text):
    base = plain_spans(text)
    assert [row[f"n_{k}"] for k in PLAIN] == [sum(s.startswith(k + ":") for s in base) for k in PLAIN]
    assert row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
    every = row["spans"].split(",") if row["spans"] else []
    assert set(base) <= set(every)
    assert every == sorted(every, key=lambda s: (list(PLAIN).index(s.split(":")[0]), int(s.split(":")[1])))
    return every


def test_base_equals_plain_patterns(spark, tmp_path):
    rng = random.Random(5)
    bits = ["a", "Z", "9", "1", "0", ".", "@", "-", " ", "+", "(", ")", "_", "%", "\n", "é", "😀", "4111 1111 1111 1111", "10.0.0.1", "256.1.1.1", "x@y.z", "+1 (555) 010-9999", "0001.2.3.4"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(1500)]
    texts += EDGE_TEXTS + ["a" * 50_000 + "@", "1" * 50_000, "a.b" * 20_000 + "@c" + ".d" * 20_000, "+1" + " 2" * 20_000, "1.1.1.1 " * 3000]
    df = documents(spark, texts).unionByName(spark.createDataFrame([(None, "x@y.z", None, None, None), (3, "1.2.3.4", "en", "s", 0), (3, "1.2.3.4", "en", "s", 0)], DOCS))
    got = queries.QUERIES["op6_contextual_pii"](spark, stored(spark, tmp_path, df)).collect()
    assert len(got) == len(texts) + 3
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    for k, text in enumerate(texts):
        if k != 3:
            check(by_id[k][0], text)
    assert sorted(r["n_ip"] for r in by_id[3]) == sorted([len([s for s in plain_spans(texts[3]) if s.startswith("ip")]), 1, 1])
    assert by_id[None][0]["n_email"] == 1


def test_contexts_find_unseen_identifiers(spark):
    texts = [f"{words(k, 6)} reach me at u{k}@mail.example.org today" for k in range(40)]
    texts += [f"{words(k, 6)} visa number 411111111111{1000 + k} paid" for k in range(40)]
    new = ["please reach me at jane(at)home99.example today", "nothing here 12 and user7 reach"]
    rows = personal_data.find(documents(spark, texts + new)).collect()
    by_id = {r["doc_id"]: r for r in rows}
    for k, text in enumerate(texts + new):
        check(by_id[k], text)
    start = new[0].index("jane")
    assert by_id[80]["spans"] == f"email:{start}:{start + len('jane(at)home99.example')}"
    assert by_id[81]["spans"] == ""


def test_masking(spark):
    texts = [None, "", "mail a@b.cd, from 10.0.0.1!", "😀 +1 (555) 010-9999 x", "plain 12"]
    df = documents(spark, texts).withColumn("key", queries.F.lit("mine"))
    got = personal_data.masked(df)
    assert got.columns == df.columns
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert [by_id[k]["text"] for k in range(5)] == [None, "", "mail <EMAIL>, from <IP>!", "😀 <PHONE> x", "plain 12"]
    assert by_id[3]["n_chars"] == len("😀 <PHONE> x")
    assert personal_data.masked(documents(spark, [])).count() == 0


def test_text_of_very_many_numbers(spark):
    """Tens of thousands of tokens in one text."""
    count = 20_000
    text = " ".join(str(k % 7) for k in range(count)) + " a@b.cd " + "10.0.0.1 " * 3 + "x9 " * count
    rows = personal_data.find(documents(spark, [text, "plain 12", None])).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[0]["n_email"] == 1 and by_id[0]["n_ip"] == 3 and by_id[1]["spans"] == by_id[2]["spans"] == ""
    check(by_id[0], text)


def test_tokens_that_coincide_with_base_spans(spark):
    """A token that is itself a base span counts once, whichever is looked at first."""
    texts = [f"{words(k, 4)} write to u{k}@mail.example.org now" for k in range(20)]
    for r in personal_data.find(documents(spark, texts)).collect():
        assert r["n_email"] == 1 and r["spans"].count(":") == 2
