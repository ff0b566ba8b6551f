import random
import re
import zlib
from collections import Counter

import pytest
from llm_helpers import DOCS, EDGE_TEXTS, documents, stored, words

from eventmart.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    known = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in known if v != w and one_apart(w, v)] for w in known}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-known[v], v), default=None)
        form[w] = best if best and known[best] >= 2 * known[w] else None
    out = []
    for w, n in known.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), form[w] and known[form[w]]))
    return sorted(out, key=repr)


def misspelt(seed, count):
    """Words of few letters, most of them near others, some with letters beyond ASCII."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abéÜst") for _ in range(rng.randrange(4, 9))) for _ in range(40)]
    out = []
    for _ in range(count):
        word = list(stems[min(int(rng.expovariate(0.1)), 39)])
        if rng.random() < 0.4:
            at = rng.randrange(len(word))
            word[at : at + rng.randrange(2)] = rng.choice(["", "a", "é", "T"])
        out.append("".join(word))
    return rng.choice([" ", ", ", "-"]).join(out)


def test_query_equals_comparing_all_words(spark, tmp_path):
    texts = list(EDGE_TEXTS) + [misspelt(k, 200) for k in range(30)] + ["aaaaaaa aaaaaa aaaaa aaaaaaaa " * 5, "ababab bababa abababa " * 4, "chainst " * 3 + "chains " * 7 + "chain " * 20]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[-4]), (12, texts[-4]), (12, texts[-4])]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(6).selectExpr("*", "1 as word", "2 as n", "3 as near")
    got = queries.QUERIES["op11_spelling_variants"](spark, stored(spark, tmp_path, df))
    found = sorted(map(tuple, got.collect()), key=repr)
    assert found == plain(rows)
    assert sum(r[1] is not None for r in found) > 50 and any(r[1] != r[2] and r[1] for r in found)


@pytest.mark.parametrize("texts", [[], [None], ["", " ", "a b c d"], ["alone alone alone"]])
def test_few_words(spark, tmp_path, texts):
    got = queries.QUERIES["op11_spelling_variants"](spark, stored(spark, tmp_path, documents(spark, texts)))
    assert sorted(map(tuple, got.collect())) == plain(list(enumerate(texts)))


def test_every_pair_one_letter_apart_meets(spark):
    rng = random.Random(5)
    known = {"".join(rng.choice("abc") for _ in range(rng.randrange(5, 8))) for _ in range(500)}
    got = spelling.near_words(spark.createDataFrame([(w,) for w in known], "word string"))
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for a in known for b in known if one_apart(a, b))


def test_pivots_are_disjoint_and_rarest():
    rng = random.Random(7)
    for _ in range(300):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(5, 12)))
        grams = sorted({word[i : i + 2] for i in range(len(word) - 1)})
        order = {g: (k, rng.choice([1, 5, 5, 9])) for k, g in enumerate(grams)}
        frequency = [order[g][1] for g in grams]
        kept = spelling.prefix(word, order)
        assert len(kept) >= 3
        (a, i), (b, j) = spelling.pivots(kept, frequency)
        assert i + 2 <= j and (a, i) in kept and (b, j) in kept
        least = min(frequency[x] + frequency[y] for x, p in kept for y, q in kept if p + 2 <= q)
        assert frequency[a] + frequency[b] == least


def test_long_texts_are_split_alike(monkeypatch):
    text = misspelt(3, 500) + " " + words(2, 100)
    whole = RUN.findall(text)
    for stretch in (1, 13, 400):
        monkeypatch.setattr(spelling, "STRETCH", stretch)
        assert [r for runs in spelling._runs(text) for r in runs] == whole


def test_roots_follow_long_ways(spark):
    rows = [("abcde" + "f" * k, 3 ** (k + 1)) for k in range(12)] + [("abcdx", 1)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got["abcde"].form == "abcdef" and got["abcde"].root == "abcde" + "f" * 11
    assert got["abcdx"].form == "abcde" and got["abcdx"].root == "abcde" + "f" * 11
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame(rows, "word string, n long"), 1)


def test_letters_differ_in_two_bits_at_most():
    rng = random.Random(9)
    alphabet = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    for _ in range(500):
        word = [rng.choice(alphabet) for _ in range(rng.randrange(5, 12))]
        at, new = rng.randrange(len(word)), rng.choice([[], [rng.choice(alphabet)], [rng.choice(alphabet), word[0]]])
        other = word[:at] + new + word[at + 1 :] if len(new) < 2 else word[:at] + new[:1] + word[at:]
        assert (spelling.letters("".join(word)) ^ spelling.letters("".join(other))).bit_count() <= 2
