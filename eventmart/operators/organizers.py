"""Organizer names: canonical spelling, ranking, timeline (AGG-17/18/27, JON-04, FLT-02, SRT-04/05)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import fold, strip
from .clean import quoted
from .timeseries import event_totals


def organizer_mapping(events: DataFrame, org: str = S.SRC_ORG) -> DataFrame:
    """Per case-insensitive name: commonest spelling, all spellings, rows (AGG-17).

    Spellings are counted first, so what meets per name is its distinct spellings,
    never its events. Ties go to the smallest spelling.
    """
    spellings = (
        events.filter(quoted(org).isNotNull())
        .groupBy(fold(quoted(org)).alias("norm"), quoted(org).alias("spelling"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return spellings.groupBy("norm").agg(
        F.min_by("spelling", F.struct(-F.col("n"), F.col("spelling"))).alias("canonical"),
        F.array_sort(F.collect_list("spelling")).alias("variations"),
        F.sum("n").alias("count"),
    )


def organizer_ranking(mapping: DataFrame) -> DataFrame:
    """Organizers by number of events (AGG-18)."""
    return mapping.select(
        F.col("canonical").alias("canonical_name"),
        "variations",
        F.size("variations").alias("variation_count"),
        F.col("count").alias("hackathon_count"),
    ).orderBy(F.desc("hackathon_count"), "canonical_name")


def canonical_names(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Add canonical name and spellings to a table of names; unknown names keep their own (JON-04)."""
    known = mapping.select(F.col("norm").alias("_norm"), "canonical", "variations")
    joined = df.join(known, fold(quoted(column)) == F.col("_norm"), "left").drop("_norm")
    return joined.withColumns({
        "canonical": F.coalesce("canonical", quoted(column)),
        "variations": F.coalesce("variations", F.array(quoted(column))),
    })


def events_of(events: DataFrame, organizer: str) -> DataFrame:
    """All events of an organizer in any spelling (FLT-02)."""
    return events.filter(fold(quoted(S.SRC_ORG)) == fold(F.lit(organizer)))


def organizer_timeline(events: DataFrame, organizer: str) -> DataFrame:
    """Events of an organizer by date, undated ones last (SRT-04)."""
    return events_of(events, organizer).orderBy(
        quoted(S.SRC_DATE).asc_nulls_last(), quoted(S.SRC_NAME)
    ).select(
        quoted(S.SRC_DATE).alias("Date"),
        quoted(S.SRC_NAME).alias("Hackathon"),
        quoted(S.SRC_PARTICIPANTS).alias("Participants"),
        quoted(S.SRC_SUBMISSIONS).alias("Submissions"),
        quoted(S.SRC_MODE).alias("Event Type"),
    )


def timeline_totals(events: DataFrame, organizer: str) -> DataFrame:
    """Events, participants and submissions of an organizer (AGG-28)."""
    return event_totals(events_of(events, organizer), organizers=False)


def event_names(events: DataFrame, column: str = S.SRC_NAME) -> DataFrame:
    """Distinct stripped names, sorted ignoring case (SRT-05)."""
    name = strip(quoted(column)).alias("name")
    return events.select(name).filter(F.length("name") > 0).distinct().orderBy(F.lower("name"), "name")


def source_overview(events: DataFrame) -> DataFrame:
    """Headline totals of the event list (AGG-27)."""
    return events.agg(
        F.count(F.lit(1)).alias("Total Hackathons"),
        F.count_distinct(fold(quoted(S.SRC_ORG))).alias("Total Organizers"),
        F.coalesce(F.sum(quoted(S.SRC_PARTICIPANTS)), F.lit(0)).alias("Total Participants"),
        F.coalesce(F.sum(quoted(S.SRC_SUBMISSIONS)), F.lit(0)).alias("Total Valid Submissions"),
    )
