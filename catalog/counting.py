"""Ranked tokens, distributions, histograms, group statistics, summary."""

from __future__ import annotations

from adapters import registrants, submissions, table
from eventmart import schemas as S
from eventmart.operators import distribution, ranking, tokens

from .registry import SYNONYMS, distribution_sql, query, top_tokens_sql, tokens_sql


@query("top_tokens_part", top_tokens_sql("part", "p_name", " ", "Technology", 50))
def top_tokens_part(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return tokens.top_tokens(part, "p_name", " ", SYNONYMS, 50)


@query("top_technologies", top_tokens_sql("sub", "built_with", ",", "Technology", 50), ("sub",))
def top_technologies(spark, sf_dir):
    return tokens.top_tokens(submissions(spark, sf_dir, S.BUILT_WITH), synonyms=SYNONYMS)


@query("top_skills", top_tokens_sql("reg", "skills", ";", "Skill", 50), ("reg",))
def top_skills(spark, sf_dir):
    people = registrants(spark, sf_dir, S.SKILLS)
    return tokens.top_tokens(people, S.SKILLS, ";", SYNONYMS, 50, "Skill")


@query("top_technologies_all", top_tokens_sql("sub", "built_with", ",", "Technology", None), ("sub",))
def top_technologies_all(spark, sf_dir):
    return tokens.top_tokens(submissions(spark, sf_dir, S.BUILT_WITH), synonyms=SYNONYMS, limit=None)


@query("doc_top_words", top_tokens_sql("documents", "text", " ", "Technology", 100, synonyms=False))
def doc_top_words(spark, sf_dir):
    return tokens.top_tokens(table(spark, sf_dir, "documents"), "text", " ", None, 100, weighted=False)


@query("doc_words_ranked", top_tokens_sql("documents", "text", " ", "Technology", None, synonyms=False))
def doc_words_ranked(spark, sf_dir):
    return tokens.top_tokens(table(spark, sf_dir, "documents"), "text", " ", None, None, weighted=False)


@query(
    "submissions_by_event",
    """select title as "Hackathon", count(project) as "Submissions", count(distinct org) as "Organizations"
from sub where title is not null group by 1""",
    ("sub",),
)
def submissions_by_event(spark, sf_dir):
    return distribution.group_statistics(submissions(spark, sf_dir, S.TITLE, S.PROJECT, S.ORG))


TEAM_SQL = """with counts as (select cast(trunc(coalesce(extra, 0)) as bigint) + 1 as v, count(*) as n from sub group by 1)
select v as "Team Size", n as "Count", round_even(n::double / (select sum(n) from counts) * 100, 2) as "Percentage"
from counts"""


@query("team_size_distribution", TEAM_SQL, ("sub",))
def team_size_distribution(spark, sf_dir):
    return distribution.team_size_distribution(submissions(spark, sf_dir, S.EXTRA_MEMBERS))


@query("country_distribution", distribution_sql("reg", "country", "Country", 10), ("reg",))
def country_distribution(spark, sf_dir):
    return distribution.value_distribution(registrants(spark, sf_dir, S.COUNTRY), S.COUNTRY, limit=10)


@query("occupation_breakdown", distribution_sql("reg", "occupation", "Occupation", 50), ("reg",))
def occupation_breakdown(spark, sf_dir):
    return distribution.value_distribution(registrants(spark, sf_dir, S.OCCUPATION), S.OCCUPATION, limit=50)


@query("specialty_distribution", distribution_sql("reg", "specialty", "Specialty", None), ("reg",))
def specialty_distribution(spark, sf_dir):
    return distribution.value_distribution(registrants(spark, sf_dir, S.SPECIALTY), S.SPECIALTY)


@query("event_type_distribution", distribution_sql("events", "event_type", "event_type", 50))
def event_type_distribution(spark, sf_dir):
    return distribution.value_distribution(table(spark, sf_dir, "events"), "event_type", limit=50)


EXPERIENCE_SQL = """with v as (select case when experience <= 50 then experience end as x from reg),
n as (select * from (select count(*) filter (x > 0 and x <= 2) as a, count(*) filter (x > 2 and x <= 5) as b,
  count(*) filter (x > 5 and x <= 10) as c, count(*) filter (x > 10 and x <= 50) as d from v)),
bins as (select '0-2 years' as label, a as n from n union all select '3-5 years', b from n
  union all select '6-10 years', c from n union all select '10+ years', d from n)
select label as "Experience Range", n as "Count",
  coalesce(round_even(n::double / nullif((select sum(n) from bins), 0) * 100, 2), 0) as "Percentage" from bins"""


@query("work_experience_distribution", EXPERIENCE_SQL, ("reg",))
def work_experience_distribution(spark, sf_dir):
    return distribution.binned_histogram(registrants(spark, sf_dir, S.EXPERIENCE))


_SUMMARY = f"""with tech as (select token, count(*) as n from {tokens_sql('sub', 'built_with', ',')} group by 1),
skill as (select token, count(*) as n from {tokens_sql('reg', 'skills', ';')} group by 1),
summary as (select (select count(*) from sub) as total_submissions, (select count(*) from reg) as total_registrants,
 (select count(distinct title) from sub) as unique_hackathons, (select count(distinct org) from sub) as unique_organizations,
 (select strftime(min(created), '%Y-%m-%d') from sub) as date_start,
 (select strftime(max(created), '%Y-%m-%d') from sub) as date_end,
 (select token from tech order by n desc, token limit 1) as most_popular_technology,
 (select token from skill order by n desc, token limit 1) as most_popular_skill,
 (select country from reg where country is not null group by 1 order by count(*) desc, 1 limit 1) as top_country,
 (select round_even(avg(cast(trunc(coalesce(extra, 0)) as bigint) + 1), 2) from sub) as avg_team_size)"""


def summary(spark, sf_dir):
    subs = submissions(spark, sf_dir, S.TITLE, S.ORG, S.CREATED, S.BUILT_WITH, S.EXTRA_MEMBERS)
    people = registrants(spark, sf_dir, S.SKILLS, S.COUNTRY)
    return distribution.summary_statistics(subs, people, SYNONYMS, SYNONYMS)


@query("summary_statistics", _SUMMARY + " select * from summary", ("sub", "reg"))
def summary_statistics(spark, sf_dir):
    return summary(spark, sf_dir)


LISTING_SQL = _SUMMARY + " " + " union all ".join(
    f"select '{label}' as \"Metric\", cast({field} as varchar) as \"Value\" from summary"
    for field, label in distribution.SUMMARY_LABELS.items()
)


@query("summary_listing", LISTING_SQL, ("sub", "reg"))
def summary_listing(spark, sf_dir):
    return distribution.summary_listing(summary(spark, sf_dir))


@query(
    "chart_table",
    """select title as "Hackathon", count(project) as "Submissions", count(distinct org) as "Organizations"
from sub where title is not null group by 1 order by 2 desc, 1 limit 10""",
    ("sub",),
)
def chart_table(spark, sf_dir):
    counts = distribution.group_statistics(submissions(spark, sf_dir, S.TITLE, S.PROJECT, S.ORG))
    return ranking.chart_order(ranking.top(counts, "Submissions", "Hackathon", 10), "Submissions", "Hackathon")
