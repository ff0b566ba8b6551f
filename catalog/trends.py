"""Calendar series, token trends, event-list trends."""

from __future__ import annotations

from adapters import event_list, registrants, submissions, table
from eventmart import schemas as S
from eventmart.operators import filters, timeseries, tokens
from eventmart.session import materialise
from eventmart.sources.event_list import normalise_events

from .registry import SYNONYMS, query, tokens_sql


def _series(table_name: str, column: str, unit: str) -> str:
    return f"""with s as (select cast(date_trunc('{unit}', {column}) as date) as d, count(*) as n from {table_name}
 where {column} is not null group by 1)
select d as "Date", n as "Submissions", cast(sum(n) over (order by d) as bigint) as "Cumulative" from s"""


@query("time_trends_daily", _series("events", "ts", "day"))
def time_trends_daily(spark, sf_dir):
    return timeseries.calendar_counts(table(spark, sf_dir, "events"), "ts", "daily")


@query("time_trends_weekly", _series("sub", "created", "week"), ("sub",))
def time_trends_weekly(spark, sf_dir):
    return timeseries.calendar_counts(submissions(spark, sf_dir, S.CREATED), bucket="weekly")


@query("time_trends_monthly", _series("sub", "created", "month"), ("sub",))
def time_trends_monthly(spark, sf_dir):
    return timeseries.calendar_counts(submissions(spark, sf_dir, S.CREATED), bucket="monthly")


LABELS = {
    "monthly": "strftime({c}, '%Y-%m')",
    "quarterly": "concat(year({c}), 'Q', quarter({c}))",
    "yearly": "cast(year({c}) as varchar)",
}


def _trend_cte(period: str, top_n: int = 10) -> str:
    label = LABELS[period].format(c="created")
    return f"""with pt as (select p, token, count(*) as n from {tokens_sql('sub', 'built_with', ',', label + ' as p' if ',' not in label else 'lab as p').replace('from sub)', f'from (select *, {label} as lab from sub))')} group by 1, 2),
leaders as (select token from pt group by 1 order by sum(n) desc, token limit {top_n}),
trend as (select p as "Period", token as "Technology", n as "Count" from pt
 where p is not null and token in (select token from leaders))"""


def technology_trend(spark, sf_dir, period):
    subs = submissions(spark, sf_dir, S.BUILT_WITH, S.CREATED)
    return tokens.token_trend(subs, period, 10, synonyms=SYNONYMS)


for _period in LABELS:
    query(f"tech_trend_{_period}", _trend_cte(_period) + " select * from trend", ("sub",))(
        lambda spark, sf_dir, p=_period: technology_trend(spark, sf_dir, p)
    )

@query(
    "tech_trend_pivot",
    _trend_cte("quarterly")
    + """, cells as (select p as "Period", t as "Technology", coalesce((select sum("Count") from trend where "Period" = p and "Technology" = t), 0)::bigint as n
 from (select distinct "Period" as p from trend), (select distinct "Technology" as t from trend))
select "Period", "Technology", n as "Count" from cells""",
    ("sub",),
)
def tech_trend_pivot(spark, sf_dir):
    """The pivoted table cell by cell, because the names of its columns come from the data."""
    wide = tokens.trend_pivot(materialise(technology_trend(spark, sf_dir, "quarterly")))
    return wide.unpivot("Period", [c for c in wide.columns if c != "Period"], "Technology", "Count")


@query(
    "tech_trend_transposed",
    _trend_cte("yearly")
    + """, cells as (select p as "Period", t as "Technology", coalesce((select sum("Count") from trend where "Period" = p and "Technology" = t), 0)::bigint as n
 from (select distinct "Period" as p from trend), (select distinct "Technology" as t from trend))
select "Period", "Technology", n as "Count" from cells""",
    ("sub",),
)
def tech_trend_transposed(spark, sf_dir):
    """The transposed table cell by cell."""
    wide = tokens.trend_transposed(materialise(technology_trend(spark, sf_dir, "yearly")))
    return wide.unpivot("Technology", [c for c in wide.columns if c != "Technology"], "Period", "Count")


@query(
    "tech_trend_stats",
    _trend_cte("monthly")
    + """ select "Technology", cast(sum("Count") as bigint) as "Total Uses",
 round_even(avg("Count"), 2) as "Avg per Period", max("Count") as "Peak Usage" from trend group by 1""",
    ("sub",),
)
def tech_trend_stats(spark, sf_dir):
    return tokens.trend_statistics(technology_trend(spark, sf_dir, "monthly"))


@query(
    "skills_trend_monthly",
    f"""with counts as (select token, count(*) as n from {tokens_sql('reg', 'skills', ';')} group by 1),
leaders as (select * from counts order by n desc, token limit 10),
months as (select unnest(generate_series(date_trunc('month', (select min(created) from sub)),
  date_trunc('month', (select max(created) from sub)), interval 1 month)) as m)
select strftime(m, '%Y-%m') as "Period", token as "Skill",
 cast(floor(n / (select count(*) from months)) as bigint) as "Count" from months, leaders""",
    ("sub", "reg"),
)
def skills_trend_monthly(spark, sf_dir):
    return tokens.uniform_skill_trend(
        registrants(spark, sf_dir, S.SKILLS), submissions(spark, sf_dir, S.CREATED), synonyms=SYNONYMS
    )


# ---- event list ------------------------------------------------------------------


def source(spark, sf_dir, *columns):
    return normalise_events(event_list(spark, sf_dir, *columns))


for _period in LABELS:
    query(
        f"source_trends_{_period}",
        f"""select {LABELS[_period].format(c='published')} as "Period", count(name) as "Hackathon Count",
 cast(coalesce(sum(participants), 0) as bigint) as "Total Participants",
 cast(coalesce(sum(subs), 0) as bigint) as "Total Submissions", count(distinct org) as "Unique Organizers"
 from srcn where published is not null group by 1""",
        ("srcn",),
    )(lambda spark, sf_dir, p=_period: timeseries.event_trend(source(spark, sf_dir), p))

_SEASONAL = """with seasonal as (select month(published) as m, count(name) as n, avg(participants) as ap, avg(subs) as a_s
 from srcn where published is not null group by 1)"""


@query(
    "seasonal_patterns",
    _SEASONAL + """ select m as "Month", n as "Hackathon Count", ap as "Avg Participants", a_s as "Avg Submissions",
 monthname(make_date(2000, m, 1)) as "Month Name" from seasonal""",
    ("srcn",),
)
def seasonal_patterns(spark, sf_dir):
    return timeseries.seasonal_patterns(source(spark, sf_dir))


@query(
    "seasonal_insights",
    _SEASONAL + """ select (select monthname(make_date(2000, m, 1)) from seasonal order by n desc, m limit 1) as peak_month,
 max(n) as peak_count, (select monthname(make_date(2000, m, 1)) from seasonal order by n, m limit 1) as low_month,
 min(n) as low_count, round_even(avg(n), 1) as avg_per_month from seasonal""",
    ("srcn",),
)
def seasonal_insights(spark, sf_dir):
    return timeseries.seasonal_insights(timeseries.seasonal_patterns(source(spark, sf_dir)))


def _growth(column):
    return f"({column} / nullif(lag({column}) over (order by y), 0) - 1) * 100"


_YEARS = f"""with years as (select year(published) as y, count(name) as n, cast(coalesce(sum(participants), 0) as bigint) as tp,
 avg(participants) as ap, cast(coalesce(sum(subs), 0) as bigint) as ts, avg(subs) as a_s, count(distinct org) as o
 from srcn where published is not null group by 1),
yoy as (select y as "Year", n as "Hackathon Count", tp as "Total Participants", ap as "Avg Participants per Hackathon",
 ts as "Total Submissions", a_s as "Avg Submissions per Hackathon", o as "Unique Organizers",
 {_growth('n')} as "Hackathon Growth %", {_growth('tp')} as "Participant Growth %", {_growth('ts')} as "Submission Growth %"
 from years)"""


@query("year_over_year", _YEARS + " select * from yoy", ("srcn",))
def year_over_year(spark, sf_dir):
    return timeseries.year_over_year(source(spark, sf_dir))


_GROWTH = ["Hackathon Growth %", "Participant Growth %", "Submission Growth %"]


@query(
    "latest_year_kpis",
    _YEARS
    + """ select "Year", "Hackathon Count", "Total Participants", "Avg Participants per Hackathon", "Total Submissions",
 "Avg Submissions per Hackathon", "Unique Organizers", """
    + ", ".join(f'round_even("{g}", 1) as "{g}"' for g in _GROWTH)
    + ' from yoy order by "Year" desc limit 1',
    ("srcn",),
)
def latest_year_kpis(spark, sf_dir):
    latest = timeseries.latest_year(timeseries.year_over_year(source(spark, sf_dir)))
    return timeseries.rounded_for_display(latest, _GROWTH)


_WINDOW = ("1997-03-01", "1998-06-30")
_BETWEEN = f"published >= timestamp '{_WINDOW[0]}' and published <= timestamp '{_WINDOW[1]}'"


@query(
    "date_range_filter",
    f"""select strftime(published, '%Y-%m-%d') as "Date", name as "Hackathon", org as "Organizer",
 participants as "Participants", subs as "Submissions", mode as "Event Type" from srcn where {_BETWEEN}""",
    ("srcn",),
)
def date_range_filter(spark, sf_dir):
    from eventmart.sources.event_list import display_events

    return display_events(filters.date_range(source(spark, sf_dir), *_WINDOW))


@query(
    "date_range_kpis",
    f"""select count(*) as "Hackathons", cast(coalesce(sum(participants), 0) as bigint) as "Total Participants",
 cast(coalesce(sum(subs), 0) as bigint) as "Total Submissions", count(distinct org) as "Unique Organizers"
 from srcn where {_BETWEEN}""",
    ("srcn",),
)
def date_range_kpis(spark, sf_dir):
    return timeseries.event_totals(filters.date_range(source(spark, sf_dir), *_WINDOW))


@query(
    "top_organizers_in_range",
    f"""select org as "Organizer", count(name) as "Hackathons", cast(coalesce(sum(participants), 0) as bigint) as "Total Participants",
 cast(coalesce(sum(subs), 0) as bigint) as "Total Submissions" from srcn where {_BETWEEN} and org is not null
 group by 1 order by 2 desc, 1 limit 10""",
    ("srcn",),
)
def top_organizers_in_range(spark, sf_dir):
    return timeseries.top_organizers(filters.date_range(source(spark, sf_dir), *_WINDOW))


@query("year_filter", "select name, published from srcn where year(published) = 1998", ("srcn",))
def year_filter(spark, sf_dir):
    events = filters.in_year(source(spark, sf_dir, S.SRC_NAME, S.SRC_DATE), 1998)
    return events.selectExpr(f"`{S.SRC_NAME}` as name", f"`{S.SRC_DATE}` as published")


@query("date_span", "select min(published) as first_date, max(published) as last_date from srcn", ("srcn",))
def date_span(spark, sf_dir):
    return timeseries.date_span(source(spark, sf_dir, S.SRC_NAME, S.SRC_DATE))


@query(
    "source_overview",
    """select count(*) as "Total Hackathons",
 (select count(distinct lower(org)) from srcn where org is not null) as "Total Organizers",
 cast(coalesce(sum(participants), 0) as bigint) as "Total Participants",
 cast(coalesce(sum(subs), 0) as bigint) as "Total Valid Submissions" from srcn""",
    ("srcn",),
)
def source_overview(spark, sf_dir):
    from eventmart.operators.organizers import source_overview as overview

    return overview(source(spark, sf_dir))
