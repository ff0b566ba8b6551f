"""Operators on edge rows and as properties."""

import datetime as dt

import pandas as pd
import pytest
from conftest import column, rows
from pyspark.sql import functions as F

from eventmart import schemas as S
from eventmart.operators import (
    clean, counted, dedup, distribution, entities, filters, ledger, organizers, ranking, reconcile, samples, timeseries, tokens,
)
from eventmart.sources import lists, text_exports
from eventmart.sources.event_list import normalise_events


def texts(spark, name, values):
    return spark.createDataFrame([(v,) for v in values], f"`{name}` string")


# ---- tokens, distributions ------------------------------------------------------------


def test_top_tokens_ties_synonyms_and_total(spark):
    df = texts(spark, S.BUILT_WITH, ["JS, b", "javascript , a", "c!", None, ""])
    top = tokens.top_tokens(df, synonyms={"js": "javascript"}, limit=2)
    assert rows(top) == [(1, "javascript", 2, 40.0), (2, "a", 1, 20.0)]
    every = tokens.top_tokens(df, synonyms={"js": "javascript"}, limit=None)
    assert column(every, "Rank") == [1, 2, 3, 4]
    assert sum(column(every, "Percentage")) == pytest.approx(100)


def test_lookup_before_strip(spark):
    df = texts(spark, S.BUILT_WITH, ["c++, C#, c!"])
    default = tokens.token_counts(df, S.BUILT_WITH, synonyms={"c++": "cpp", "c#": "csharp"})
    assert rows(default) == [("c", 3)]
    reached = tokens.token_counts(df, S.BUILT_WITH, synonyms={"c++": "cpp", "c#": "csharp"}, lookup_before_strip=True)
    assert sorted(rows(reached)) == [("c", 1), ("cpp", 1), ("csharp", 1)]


def test_missing_columns_give_empty_tables(spark):
    df = texts(spark, "x", ["a"])
    assert tokens.top_tokens(df).columns == ["Rank", "Technology", "Count", "Percentage"]
    assert tokens.token_trend(df).isEmpty()
    assert distribution.value_distribution(df, S.COUNTRY).isEmpty()
    assert distribution.binned_histogram(df).isEmpty()
    assert distribution.group_statistics(df).isEmpty()
    assert distribution.team_size_distribution(df).isEmpty()
    assert timeseries.calendar_counts(df).columns == ["Date", "Submissions", "Cumulative"]
    summary = distribution.summary_statistics(df, df).first()
    assert summary.total_submissions == 1 and summary.unique_hackathons == 0
    assert summary.avg_team_size == 0 and summary.top_country is None


def test_empty_text_is_a_value_and_null_is_not(spark):
    df = texts(spark, S.COUNTRY, ["", "", "FR", None])
    assert rows(distribution.value_distribution(df, S.COUNTRY)) == [("", 2, 66.67), ("FR", 1, 33.33)]


def test_experience_ranges(spark):
    df = texts(spark, S.EXPERIENCE, ["-1", "0", "0.5", "2", "2.5", "5", "10", "50", "51", "x"])
    got = rows(distribution.binned_histogram(df))
    assert [g[1] for g in got] == [2, 2, 1, 1]
    assert [g[0] for g in got] == distribution.EXPERIENCE_LABELS
    assert [g[1] for g in rows(distribution.binned_histogram(df, include_lowest=True))] == [3, 2, 1, 1]
    nothing = rows(distribution.binned_histogram(texts(spark, S.EXPERIENCE, [None])))
    assert [g[1:] for g in nothing] == [(0, 0.0)] * 4


def test_trends(spark):
    df = spark.createDataFrame(
        [("a,b", dt.datetime(2024, 1, 5)), ("a", dt.datetime(2024, 3, 1)), ("b,b", None), ("c", dt.datetime(2024, 1, 6))],
        f"`{S.BUILT_WITH}` string, `{S.CREATED}` timestamp_ntz",
    )
    trend = tokens.token_trend(df, "monthly", 2)
    # undated records count for the ranking only
    assert rows(trend) == [("2024-01", "a", 1), ("2024-01", "b", 1), ("2024-03", "a", 1)]
    assert rows(tokens.token_trend(df, "no such period", 2)) == rows(trend)
    assert rows(tokens.trend_pivot(trend, ["a", "b"]).orderBy("Period")) == [("2024-01", 1, 1), ("2024-03", 1, 0)]
    assert rows(tokens.trend_statistics(trend))[0] == ("a", 2, 1.0, 1)
    people = texts(spark, S.SKILLS, ["x;y", "x", "x;z"])
    even = tokens.uniform_skill_trend(people, df, "monthly", 2)
    assert rows(even) == [(m, s, c) for m in ("2024-01", "2024-02", "2024-03") for s, c in (("x", 1), ("y", 0))]


def test_calendar_counts_end_at_row_count(spark):
    df = texts(spark, S.CREATED, ["2024-01-07", "2024-01-08", "2024-01-08T09:00:00", "bad"])
    assert rows(timeseries.calendar_counts(df, bucket="weekly")) == [(dt.date(2024, 1, 1), 1, 1), (dt.date(2024, 1, 8), 2, 3)]
    assert rows(timeseries.calendar_counts(df, bucket="unknown"))[-1][2] == 3


# ---- ranking ----------------------------------------------------------------------------


def test_global_position_equals_sort(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).alias("m"))
    got = rows(ranking.ranked(df, "m", "k"))
    assert [g[0] for g in got] == list(range(1, 5001))
    assert [(g[2], g[1]) for g in got] == sorted([(r.m, r.k) for r in df.collect()], key=lambda t: (-t[0], t[1]))


def test_chart_order(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3)], "k string, n int")
    assert column(ranking.chart_order(df, "n", "k"), "k") == ["a", "b"]
    assert column(ranking.chart_order(df, "n", "k", horizontal=False), "k") == ["b", "a"]


# ---- cleaning ----------------------------------------------------------------------------


def test_header_repair(spark):
    def repaired(first, second):
        df = spark.createDataFrame([(first, second)], "a array<string>, b array<string>")
        return df.select(clean.repaired_header(F.col("a"), F.col("b"))).first()[0]

    assert repaired(["Unnamed: 0", "x"], ["A", "B"]) == ["A", "B"]
    assert repaired(["", "x"], ["A", None]) == ["A", "nan"]
    assert repaired(["﻿A", " b  c "], None) == ["A", "b c"]
    assert repaired(["Created At", "Created  At", "Created At", "x"], ["1", "2", "3", "4"]) == [
        "Created At", "Created At.1", "Created At.2", "x",
    ]


def test_merge_repeated_columns(spark):
    df = spark.createDataFrame(
        [("", "b", "c"), ("None", None, "c"), (None, "", "c"), ("a", "b", "c")], "`d` string, `d.1` string, `d.2` string"
    )
    assert rows(clean.merge_repeated_columns(df, "d")) == [("b",), ("c",), ("c",), ("a",)]
    assert clean.merge_repeated_columns(df, "x").columns == df.columns


def test_classification(spark):
    cases = [
        (["Organization Name", "Challenge Title", "Project  Title"], "x", "submission"),
        (["organization name", "challenge title", "built with", "skills", "country", "user id"], "x", "submission"),
        (["user id"], "x", "registrant"),
        (["a"], "My Registrants.csv", "registrant"),
        (["a"], "submissions.csv", "submission"),
        (["a"], "x", "unknown"),
    ]
    df = spark.createDataFrame([(c[0], c[1]) for c in cases], "n array<string>, f string")
    got = [r[0] for r in df.select(text_exports.classify(F.col("n"), F.col("f"))).collect()]
    assert got == [c[2] for c in cases]


def test_dedup_first_file_wins(spark):
    df = spark.createDataFrame(
        [("u", 2, "late"), ("u", 1, "early"), ("", 3, "blank1"), ("", 4, "blank2")], "k string, _ingest_seq long, v string"
    )
    kept = dedup.keep_first(df, ["k"], ["_ingest_seq"])
    assert sorted(rows(kept)) == [("", 3, "blank1"), ("u", 1, "early")]
    assert sorted(rows(dedup.keep_first(kept, ["k"], ["_ingest_seq"]))) == sorted(rows(kept))
    assert kept.columns == df.columns


# ---- filters, event list --------------------------------------------------------------------


def test_exact_before_folded(spark):
    df = texts(spark, "t", ["Ev", "ev", "EV", "other"])
    assert rows(filters.exact_else_folded(df, "t", "Ev")) == [("Ev",)]
    assert len(rows(filters.exact_else_folded(df, "t", "eV"))) == 3
    assert filters.exact_else_folded(df, "t", "none").isEmpty()


def source(spark, data):
    df = spark.createDataFrame(data, f"`{S.SRC_NAME}` string, `{S.SRC_ORG}` string, `{S.SRC_DATE} ` string, `{S.SRC_PARTICIPANTS}` string, `{S.SRC_SUBMISSIONS}` string, `{S.SRC_URL}` string, `{S.SRC_MODE}` string")
    return normalise_events(df)


def test_event_list_series(spark):
    df = source(spark, [
        (" A ", "MHacks", "2020-05-01", "10", None, "u", "Virtual"), ("B", "mhacks", "2022-05-31", "20", "5", "u", "Virtual"),
        ("C", "MHacks ", "2022-06-01", None, None, "u", "Virtual"), ("  ", "x", "2022-06-01", "1", "1", "u", "x"), (None, "x", None, "1", "1", "u", "x"),
    ])
    assert column(df, S.SRC_NAME) == ["A", "B", "C"]
    yearly = timeseries.year_over_year(df)
    assert column(yearly, "Year") == [2020, 2022]
    assert column(yearly, "Submission Growth %") == [None, None]
    assert column(yearly, "Hackathon Growth %") == [None, 100.0]
    assert column(yearly, "Total Submissions") == [0, 5] and column(yearly, "Avg Submissions per Hackathon") == [None, 5.0]
    with pytest.raises(ValueError):
        timeseries.event_trend(df, "weekly")
    assert len(rows(filters.date_range(df, "2020-05-01", "2022-05-31"))) == 2
    assert len(rows(filters.date_range(df, end="2020-05-01"))) == 1
    mapping = organizers.organizer_mapping(df)
    assert rows(mapping) == [("mhacks", "MHacks", ["MHacks", "mhacks"], 3)]
    asked = organizers.canonical_names(texts(spark, "n", [" MHACKS", "new"]), "n", mapping)
    assert sorted(rows(asked)) == [(" MHACKS", "MHacks", ["MHacks", "mhacks"]), ("new", "new", ["new"])]
    assert len(rows(organizers.organizer_timeline(df, "mhacks"))) == 3
    season = timeseries.seasonal_patterns(df)
    assert rows(timeseries.seasonal_insights(season)) == [("May", 2, "June", 1, 1.5)]


def test_date_range_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "events")
    source(spark, [("A", "o", "2020-05-01", "1", "1", "u", "m")]).write.parquet(path)
    from eventmart.sources.event_list import read_events

    for df in (filters.date_range(read_events(spark, path), "2020-01-01", "2021-01-01"), filters.in_year(read_events(spark, path), 2020)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(`Hackathon published date`" in plan.split("PushedFilters")[1]
        assert df.count() == 1


# ---- reconciliation ----------------------------------------------------------------------------


def test_reconciliation_outcomes(spark):
    counts = {"over": 11, "exact08": 8, "under": 7, "nullsrc": 3, "nosource": 2, "Case": 5}
    subs = spark.createDataFrame([(n,) for n, c in counts.items() for _ in range(c)], f"`{S.TITLE}` string")
    regs = spark.createDataFrame([("over",)] * 3, f"`{S.EVENT}` string")
    events = source(spark, [
        ("over", "o", None, "2", "10", "u", "m"), ("exact08", "o", None, "5", "10", "u", "m"), ("under", "o", None, "5", "10", "u", "m"),
        ("nullsrc", "o", None, None, None, "u", "m"), ("case", "p", None, "5", "5", "u", "m"), ("Ghost", "p", None, "5", "10", "u", "m"),
    ])
    got = {r.event: r for r in reconcile.reconcile_all(subs, regs, events).collect()}
    assert "exceeds source data (10)" in got["over"].warnings[0] and "unusual" in got["over"].warnings[1]
    assert got["exact08"].warnings == [] and "incomplete" in got["under"].warnings[0]
    assert got["nullsrc"].valid and got["nullsrc"].warnings == []
    assert not got["nosource"].valid and got["nosource"].error == "Hackathon 'nosource' not found in source data"
    assert got["Case"].valid and got["case"].submission_count == 5
    assert got["Ghost"].submission_count == 0 and "incomplete" in got["Ghost"].warnings[0]
    totals = {r.norm: r for r in reconcile.organizer_rollup(subs, regs, events).collect()}
    assert totals["o"].total_submissions == 29 and totals["p"].total_submissions == 5
    report = reconcile.organizer_report(" O", subs, regs, events)
    assert report["Organizer Summary"].first()["Canonical Name"] == "o"
    unknown = reconcile.organizer_report("zzz", subs, regs, events)["Organizer Summary"].first()
    assert tuple(unknown) == ("zzz", "zzz", 0, 0, 0)


# ---- entities and samples --------------------------------------------------------------------------


def submissions(spark, extra=()):
    data = [
        (f"https://{slug}.devpost.com/s/{i}", title, org, f"P{i}", dt.datetime(year, 1, 1))
        for slug, title, org, n, year in (("Alpha", "Alpha Cup", "A", 40, 2023), ("beta", "Beta alpha-cup", "B", 5, 2024), ("gamma", "Gamma", None, 12, 2022))
        for i in range(n)
    ] + list(extra)
    return spark.createDataFrame(data, f"`{S.URL}` string, `{S.TITLE}` string, `{S.ORG}` string, `{S.PROJECT}` string, `{S.CREATED}` timestamp_ntz")


def test_lookup_tiers(spark):
    extra = [("http://x", "Odd", "O", "P", dt.datetime(2021, 1, 1)), ("http://y", None, "O", "P", None)]
    dimension = entities.event_dimension(submissions(spark, extra))
    asked = ["https://ALPHA.devpost.com/x", "beta", "gamma", "odd", "CUP", "a", "zzz", "  ", "pha-c", "Alpha Cup"]
    found = {r.identifier: r for r in entities.lookup(texts(spark, "identifier", asked), dimension).collect()}
    assert found["https://ALPHA.devpost.com/x"].submission_count == 40
    assert found["beta"].challenge_title == "Beta alpha-cup"
    assert found["odd"].slug is None and found["odd"].url is None
    assert found["CUP"].submission_count == 45 and found["pha-c"].submission_count == 5
    assert found["a"].submission_count == 57 and found["Alpha Cup"].submission_count == 40
    assert "zzz" not in found and "" not in found
    assert found["CUP"].hackathon_year == 2023


def test_substring_tier_equals_brute_force(spark):
    import random

    draw = random.Random(3)
    titles = ["".join(draw.choice("ab -é") for _ in range(draw.randint(1, 12))) for _ in range(300)]
    needles = sorted({"".join(draw.choice("ab -é") for _ in range(draw.randint(1, 5))).strip() for _ in range(80)} - {""})
    names = spark.createDataFrame([(None, t) for t in titles], "slug string, title string").distinct()
    wanted = texts(spark, "identifier", needles).withColumn("needle", F.col("identifier"))
    got = {(r.identifier, r.title) for r in entities._titles_containing(wanted, names).collect()}
    assert got == {(n, t) for n in needles for t in titles if n in t.lower()}


def test_catalogue_and_search(spark):
    catalogue = entities.catalogue(entities.event_dimension(submissions(spark)))
    assert column(catalogue, "slug") == ["Alpha", "gamma", "beta"]
    hits = entities.search(catalogue, "Alpha")
    assert [(r.slug, r.score) for r in hits.collect()] == [("Alpha", 100), ("beta", 40)]
    assert [r.score for r in entities.search(catalogue, "alp").collect()] == [80, 40]
    assert [r.score for r in entities.search(catalogue, "mm").collect()] == [60]
    assert entities.search(catalogue, "q").isEmpty()


def entries(spark, urls):
    return spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "idx long, url string")


def test_samples(spark):
    subs = submissions(spark)
    listed = entries(spark, ["https://alpha.devpost.com", " ", "beta", "nothing"])
    drawn = samples.sample_events(listed, subs, 10, 5)
    sizes = {r["Hackathon Slug"]: r["count"] for r in drawn.groupBy("Hackathon Slug").count().collect()}
    assert sizes == {"alpha": 10, "beta": 5}
    again = samples.sample_events(listed.repartition(3), subs.repartition(5), 10, 5)
    assert set(column(drawn, S.URL)) == set(column(again, S.URL))
    assert set(column(drawn, S.URL)) <= set(column(subs, S.URL))
    other = samples.sample_events(listed, subs, 10, 6)
    assert set(column(drawn, S.URL)) != set(column(other, S.URL))
    # an entry draws with the seed of its position, blank entries included
    alone = samples.sample_events(entries(spark, ["", "", "beta", "alpha"]), subs, 10, 2)
    assert set(column(alone.filter("idx = 3"), S.URL)) == set(column(drawn.filter("idx = 0"), S.URL))
    everything = samples.sample_events(listed, subs, 10, 5, export_all=True)
    assert everything.count() == 45
    summary = samples.batch_summary(listed, entities.event_dimension(subs), 10)
    assert column(summary, "Status") == ["success", "success", "not_found"]
    assert column(summary, "Error")[-1] == "No submissions found for hackathon: nothing"
    assert rows(samples.batch_statistics(summary)) == [(3, 2, 1, 15)]


def test_smallest_tickets_are_drawn(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), F.md5(F.col("id").cast("string").cast("binary")).alias("t"))
    expected = {(g, t) for g in (0, 1) for t in sorted(r.t for r in df.collect() if r.g == g)[:700]}
    assert set(rows(samples.smallest_n(df, ["g"], "t", 700))) == expected
    few = samples.smallest_n(df, ["g"], "t", 3)
    assert {r.t for r in few.collect() if r.g == 0} == set(sorted(t for g, t in expected if g == 0)[:3])


def test_few_tickets_are_cut_before_the_shuffle(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), F.md5(F.col("id").cast("string").cast("binary")).alias("t"))
    few = samples.smallest_n(df.unionByName(spark.createDataFrame([(None, "0"), (1, None)], "g long, t string")), ["g"], "t", 3)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Range (0, 3000") == 1
    assert len(rows(few)) == 6 and not {r for r in rows(few) if None in r}


def test_sample_uses_the_dimension_it_is_given(spark, monkeypatch):
    subs, listed = submissions(spark), entries(spark, ["alpha", "beta"])
    dimension = entities.event_dimension(subs)
    expected = sorted(map(str, rows(samples.sample_events(listed, subs, 3, 1))))
    monkeypatch.setattr(entities, "event_dimension", None)
    assert sorted(map(str, rows(samples.sample_events(listed, subs, 3, 1, dimension=dimension)))) == expected


def test_sample_metadata_takes_first_entry(spark):
    meta = spark.createDataFrame(
        [(0, "https://Alpha.devpost.com", "X"), (1, "https://Alpha.devpost.com", "Y")], f"idx int, `{S.SRC_URL}` string, `Organization Type` string"
    )
    drawn = samples.sample_events(entries(spark, ["alpha", "beta"]), submissions(spark), 3, 1, metadata=meta)
    kinds = {(r["Hackathon Slug"], r["Organization Type"]) for r in drawn.collect()}
    assert kinds == {("alpha", "X"), ("beta", None)}


def test_lists(spark):
    df = spark.createDataFrame([("x", "a.devpost.com", "YES"), ("y", None, "NO")], "n string, address string, Include_in_Sample string")
    rows_, name = lists.prepare_list(df, "Include_in_Sample", "YES")
    assert name == "address" and rows_.count() == 1
    with pytest.raises(ValueError):
        lists.prepare_list(df, "nope", "YES")
    with pytest.raises(ValueError):
        lists.prepare_list(df.select("n"))
    assert lists.prepare_list(df.withColumn("My URL", F.lit("")))[1] == "My URL"
    ordered = spark.createDataFrame([(1, "b"), (0, None), (2, " "), (3, "c")], "o int, url string")
    assert rows(lists.indexed(ordered, "url", ["o"])) == [(0, "b"), (1, " "), (2, "c")]


# ---- ledger ----------------------------------------------------------------------------------------


def test_ledger_state(spark):
    def at(n):
        return dt.datetime(2024, 1, 1, 0, 0, n)

    data = [
        ("a1", "f1", "submission", "processing", None, None, at(1), 1, "p1"), ("a1", "f1", "submission", "failed", None, "boom", at(2), 2, "p1"),
        ("a1", "f1", "submission", "processing", None, None, at(3), 3, "p2"), ("a1", "f1", "submission", "completed", 7, None, at(4), 4, "p2"),
        ("b2", "f2", "registrant", "failed", None, "bad", at(1), 1, "q"), ("c3", "f3", "registrant", "completed", 5, None, at(1), 1, "r"),
        ("c3", "f3", "registrant", "deleted", None, None, at(2), 2, "r"),
    ]
    jobs = ledger.state(spark.createDataFrame(data, S.LEDGER_EVENTS))
    got = {r.file_hash: r for r in jobs.collect()}
    assert set(got) == {"a1", "b2"}
    assert (got["a1"].attempts, got["a1"].row_count, got["a1"].status, got["a1"].error_message) == (2, 7, "completed", None)
    assert got["a1"].created_at == at(1) and got["a1"].completed_at == at(4) and got["a1"].retry_path == "p2"
    assert got["b2"].error_message == "bad" and got["b2"].attempts == 1
    assert rows(ledger.statistics(jobs)) == [(2, 1, 1, 0, 7)]
    assert rows(ledger.statistics(jobs.limit(0))) == [(0, 0, 0, 0, 0)]
    assert sorted(rows(ledger.by_type(jobs))) == [("registrant", 0, 1, 0), ("submission", 1, 0, 0)]
    assert column(ledger.retry_candidates(jobs, names=texts(spark, "file_name", ["f2"])), "file_name") == ["f2"]
    gone = ledger.deletions(jobs, 9, status="failed")
    assert column(gone, "file_hash") == ["b2"]
    assert column(filters.history(jobs, ["failed"], ["registrant"], "F2"), "file_hash") == ["b2"]
    assert ledger.job_by_id(jobs, got["a1"].id).count() == 1


def test_against_plain_pandas_counting(spark):
    """An independent count of the same records with pandas."""
    values = ["JS, React ", "react;x, js", "(go), Go", None, "r"] * 30
    counted = pd.Series([v for v in values if v]).str.lower().str.split(",").explode().str.strip().str.strip("()").value_counts()
    got = {r.Technology: r.Count for r in tokens.token_counts(texts(spark, S.BUILT_WITH, values), S.BUILT_WITH).collect()}
    assert got == counted.to_dict()


def test_counted_sets(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", None), ("a", None, 3), (None, None, 4)], "k string, v string, c int")
    sets = counted.counted_sets(df, {"both": ["k", "v"], "v": ["v"], "gone": ["z"], "again": ["v", "z"]}, "c")
    order = lambda name: sorted((tuple(r) for r in sets[name].collect()), key=str)
    assert order("both") == sorted([("a", "x", 2, 1), ("a", None, 1, 1), (None, None, 1, 1)], key=str)
    assert order("v") == order("again") == sorted([("x", 2, 1), (None, 2, 2)], key=str)
    assert order("gone") == [(4, 3)]
    for empty in counted.counted_sets(df.limit(0), {"v": ["v"], "gone": ["z"]}).values():
        assert empty.agg(F.coalesce(F.sum(counted.WEIGHT), F.lit(0))).first()[0] == 0


def test_summary_of_tables_without_columns(spark):
    bare = spark.range(3).select(F.col("id").alias("other"))
    row = distribution.summary_statistics(bare, bare.limit(2)).first()
    assert (row.total_submissions, row.total_registrants, row.unique_hackathons, row.date_start, row.avg_team_size) == (3, 2, 0, None, 0.0)
    empty = distribution.summary_statistics(bare.limit(0), bare.limit(0)).first()
    assert (empty.total_submissions, empty.total_registrants, empty.most_popular_skill) == (0, 0, None)
