"""Column expressions on their edge rows."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from eventmart.functions import dates, numbers, synonyms, text, urls


def apply(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("c"))).collect()]


def test_tokens(spark):
    def tokens(c):
        return text.normalised_tokens(c)

    values = ["JS, React.js ,,python", "c++", "C#", "( react )", "_x_", "é!", None, "", "!!", "　a ,\tb\n"]
    assert apply(spark, values, tokens) == [
        ["js", "react.js", "python"], ["c"], ["c"], [" react "], ["_x_"], ["é"], None, [], [], ["a", "b"],
    ]


def test_tokens_agree_with_the_plain_rule(spark):
    import re

    samples = ["a-b", "-a", "a-", "..x..", "Ünï,", "x y", "²", "½!", "日本。", "á", "'quoted'", "9)", "(9", "--", "a.b.c."]

    def plain(value):
        low = value.strip().lower()
        return re.sub(r"^[^\w\s]+|[^\w\s]+$", "", low)

    got = apply(spark, samples, lambda c: F.get(text.normalised_tokens(c, "|"), F.lit(0)))
    assert [g or "" for g in got] == [plain(s) for s in samples]


def test_split_list_keeps_punctuation(spark):
    assert apply(spark, ["a; b!;;c "], lambda c: text.split_list(c, ";")) == [["a", "b!", "c"]]
    assert apply(spark, ["a||b|c"], lambda c: text.split_list(c, "||")) == [["a", "b|c"]]
    assert apply(spark, ["a.b|c"], lambda c: text.split_list(c, ".")) == [["a", "b|c"]]


def test_clean_text(spark):
    values = ["  a \t\n b c ", None, "", "0"]
    assert apply(spark, values, text.clean_text) == ["a b c", "", "", "0"]
    assert apply(spark, values, lambda c: text.clean_text(c, True)) == ["a b c", None, None, "0"]


def test_dates(spark):
    values = [
        "2024-05-01T10:00:00+02:00", "bad", "2024-01-07", "5/3/2024 4:05", "2024-05-01 10:00:00 UTC",
        "May 3, 2024", None, "", "2024-02-30", "2024-05-01T10:00:00Z",
    ]
    day = dt.datetime
    expected = [
        day(2024, 5, 1, 8), None, day(2024, 1, 7), day(2024, 5, 3, 4, 5), day(2024, 5, 1, 10),
        day(2024, 5, 3), None, None, None, day(2024, 5, 1, 10),
    ]
    assert apply(spark, values, dates.to_utc_timestamp) == expected
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert apply(spark, values, dates.to_utc_timestamp) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_weeks_start_on_monday(spark):
    values = ["2024-01-07", "2024-01-08"]
    got = apply(spark, values, lambda c: dates.bucket_start(dates.to_utc_timestamp(c), "weekly"))
    assert got == [dt.date(2024, 1, 1), dt.date(2024, 1, 8)]


def test_slugs(spark):
    values = ["https://Foo.devpost.com/x", "foo.devpost.com", " Foo 2024 ", "http://a.devpost.com", None]
    assert apply(spark, values, urls.slug_from_input) == ["foo", "foo", "foo 2024", "a", None]
    assert apply(spark, values, urls.slug_from_url) == ["Foo", None, None, None, None]
    assert apply(spark, ["a", None], urls.event_url) == ["https://a.devpost.com", None]


def test_size_buckets(spark):
    got = apply(spark, [0, 1, 9, 10, 24, 25, 99, 100, 299, 300], numbers.size_bucket, "int")
    assert [g[7] for g in got] == list("AAABBCCDDE")


def test_numbers(spark):
    assert apply(spark, ["1.5", "x", None, "nan"], numbers.to_double) == [1.5, None, None, None]
    assert apply(spark, [50.0, 51.0, -1.0, None], lambda c: numbers.cap_to_null(c, 50), "double") == [50.0, None, -1.0, None]
    assert apply(spark, [None, 0.0, 2.9], numbers.team_size, "double") == [1, 1, 3]
    assert apply(spark, ["12.0", "12", "a.0", None], numbers.canonical_id) == ["12", "12", "a.0", None]


@pytest.mark.parametrize("total", [7, 400, 4000, 20000])
def test_percentages_round_like_the_scalar_and_the_array_rule(spark, total):
    import numpy as np

    df = spark.range(total + 1).select(
        "id",
        numbers.percentage(F.col("id"), F.lit(total), nearest=True).alias("nearest"),
        numbers.percentage(F.col("id"), F.lit(total)).alias("even"),
    )
    for part, nearest, even in rows(df):
        assert nearest == round(part / total * 100, 2)
        assert even == np.round(part / total * 100, 2)


def test_percentage_without_total(spark):
    assert rows(spark.range(1).select(numbers.percentage(F.lit(0), F.lit(0)))) == [(0.0,)]


def test_synonyms(spark, tmp_path):
    assert synonyms.load_synonyms(str(tmp_path / "none.json")) == {"technologies": {}, "skills": {}}
    assert synonyms.load_synonyms() == {"technologies": {}, "skills": {}}
    own = tmp_path / "own.json"
    own.write_text('{"technologies": {"blu": "blue", "azul": "blue"}, "skills": {"weld": "welding"}}')
    known = synonyms.load_synonyms(str(own))
    table = synonyms.read_synonyms(spark, str(own))
    assert {(d, a, c) for d, m in known.items() for a, c in m.items()} == set(rows(table))
    assert known["technologies"]["azul"] == "blue"


def test_date_forms(spark):
    forms = {
        "2024-05-03T16:05": "2024-05-03 16:05:00", "5/3/2024 4:05 PM": "2024-05-03 16:05:00", "2024-05-01 10:00 AM": "2024-05-01 10:00:00",
        "May 3, 2024 10:00": "2024-05-03 10:00:00", "3-May-2024": "2024-05-03 00:00:00", "20240501": "2024-05-01 00:00:00",
        "Wed, 01 May 2024 10:00:00 GMT": "2024-05-01 10:00:00", "September 3, 2024 12:05:07 a.m.": "2024-09-03 00:05:07",
        "2024/5/3 7:01:02": "2024-05-03 07:01:02", "3 May 2024": "2024-05-03 00:00:00", "2024-05-01T10:00:00+02:00": "2024-05-01 08:00:00",
        "13/3/2024": None, "20241301": None, "soon": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in forms], "t string")
    got = {r["t"]: None if r["d"] is None else str(r["d"]) for r in df.select("t", dates.to_utc_timestamp(df["t"]).alias("d")).collect()}
    assert got == forms
