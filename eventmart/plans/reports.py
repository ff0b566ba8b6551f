"""Report compositions: named tables in report order (RPT-*, SNK-03..07)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from .. import schemas as S
from ..operators import distribution, samples, timeseries, tokens
from ..operators.clean import quoted
from ..operators.counted import COUNTED, WEIGHT, registrant_sets, submission_sets

_SUBMISSION_FIELDS = [
    "total_submissions", "unique_hackathons", "unique_organizations", "date_start", "date_end",
    "most_popular_technology", "avg_team_size",
]
_REGISTRANT_FIELDS = ["total_registrants", "most_popular_skill", "top_country"]


class Tables:
    """The tables of the catalogue over one pair of record tables.

    The records of a kind are counted once, when the first of its tables is asked for, and the counts are
    written to the shared folder; every table is a lazy frame over these counts.
    """

    def __init__(self, submissions: DataFrame, registrants: DataFrame, technologies=None, skills=None):
        self.submissions, self.registrants = submissions, registrants
        self.technologies_map, self.skills_map = technologies, skills

    @cached_property
    def _subs(self):
        return submission_sets(self.submissions)

    @cached_property
    def _people(self):
        return registrant_sets(self.registrants)

    def technologies(self, limit=50):
        return tokens.top_tokens(self._subs["lists"], S.BUILT_WITH, ",", self.technologies_map, limit, weight=WEIGHT)

    def skills(self, limit=50):
        return tokens.top_tokens(self._people[S.SKILLS], S.SKILLS, ";", self.skills_map, limit, "Skill", weight=WEIGHT)

    def by_event(self, limit=None):
        counts = distribution.group_statistics(self._subs["events"], weight=COUNTED)
        return counts if limit is None else counts.limit(limit)

    def team_sizes(self):
        return distribution.team_size_distribution(self._subs["teams"], weight=WEIGHT)

    def values(self, column, limit=None):
        return distribution.value_distribution(self._people[column], column, limit=limit, weight=WEIGHT)

    def experience(self):
        return distribution.binned_histogram(self._people[S.EXPERIENCE], weight=WEIGHT)

    def trend(self, bucket="daily", limit=None):
        series = timeseries.calendar_counts(self._subs["days"], bucket=bucket, weight=WEIGHT)
        return series if limit is None else series.limit(limit)

    def summary(self, fields=None):
        row = distribution.summary_of(self._subs, self._people, self.technologies_map, self.skills_map)
        return distribution.summary_listing(row, fields)


def combined(t: Tables) -> dict[str, DataFrame]:
    """All tables (RPT-01)."""
    return {
        "Top Technologies": t.technologies(),
        "Top Skills": t.skills(),
        "Submissions by Hackathon": t.by_event(),
        "Team Size Distribution": t.team_sizes(),
        "Country Distribution": t.values(S.COUNTRY, 50),
        "Occupation Breakdown": t.values(S.OCCUPATION, 50),
        "Specialty Distribution": t.values(S.SPECIALTY),
        "Work Experience": t.experience(),
        "Time Trends": t.trend(),
        "Summary Statistics": t.summary(),
    }


def submission_report(t: Tables) -> dict[str, DataFrame]:
    """Submission tables without limits (RPT-02)."""
    return {
        "Top Technologies": t.technologies(None),
        "Submissions by Hackathon": t.by_event(),
        "Team Size Distribution": t.team_sizes(),
        "Time Trends": t.trend(),
        "Summary Statistics": t.summary(_SUBMISSION_FIELDS),
    }


def registrant_report(t: Tables) -> dict[str, DataFrame]:
    """Registrant tables without limits (RPT-03)."""
    return {
        "Top Skills": t.skills(None),
        "Country Distribution": t.values(S.COUNTRY),
        "Occupation Breakdown": t.values(S.OCCUPATION),
        "Specialty Distribution": t.values(S.SPECIALTY),
        "Work Experience": t.experience(),
        "Summary Statistics": t.summary(_REGISTRANT_FIELDS),
    }


def preview(t: Tables, limit: int = 10) -> dict[str, DataFrame]:
    """Short form of the combined report, weekly trend (RPT-04)."""
    return {
        "Summary Statistics": t.summary(),
        "Top Technologies": t.technologies(limit),
        "Top Skills": t.skills(limit),
        "Submissions by Hackathon": t.by_event(limit),
        "Team Size Distribution": t.team_sizes(),
        "Country Distribution": t.values(S.COUNTRY, limit),
        "Occupation Breakdown": t.values(S.OCCUPATION, limit),
        "Specialty Distribution": t.values(S.SPECIALTY),
        "Work Experience": t.experience(),
        "Time Trends": t.trend("weekly", limit),
    }


def dashboard(t: Tables, chart_rows: int = 20, bucket: str = "weekly") -> dict[str, DataFrame]:
    """Tables behind the dashboard tabs; charts show the first ``chart_rows`` (RPT-05, SRT-08)."""
    return {
        "Summary Statistics": t.summary(),
        "Top Technologies": t.technologies(chart_rows),
        "Top Skills": t.skills(chart_rows),
        "Submissions by Hackathon": t.by_event(chart_rows),
        "Team Size Distribution": t.team_sizes(),
        "Country Distribution": t.values(S.COUNTRY, chart_rows),
        "Occupation Breakdown": t.values(S.OCCUPATION, chart_rows),
        "Specialty Distribution": t.values(S.SPECIALTY),
        "Work Experience": t.experience(),
        "Time Trends": t.trend(bucket),
    }


def sample_bundle(sample: DataFrame, figures: DataFrame, size: int, seed: int | None) -> dict[str, DataFrame]:
    """Sample and its metadata row (SNK-06). The sample is the one passed in, not drawn again."""
    return {"Random Sample": sample, "Metadata": samples.sample_metadata(figures, size, seed)}


def batch_bundle(sample: DataFrame, summary: DataFrame, include_summary: bool = True) -> dict[str, DataFrame]:
    """All samples, summary and statistics of a batch (SNK-07)."""
    lead = ["Hackathon URL", "Hackathon Slug"]
    rest = [c for c in sample.columns if c not in (*lead, "idx")]
    tables = {"All Samples": sample.select(*[quoted(c) for c in lead + rest])}
    if include_summary:
        tables["Summary"] = summary.drop("idx")
        tables["Statistics"] = samples.batch_statistics(summary)
    return tables
