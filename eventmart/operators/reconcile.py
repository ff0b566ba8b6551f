"""Processed records against the authoritative event list (VAL-01..04, JON-03, AGG-19, RSH-05)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import fold
from .clean import quoted
from .dedup import keep_first
from .filters import exact_else_folded
from .organizers import organizer_mapping

# Fixed value: share of the listed submissions below which data counts as incomplete.
INCOMPLETE_BELOW = 0.8


def processed_counts(df: DataFrame, column: str) -> DataFrame:
    """Records per event name."""
    return (
        df.filter(quoted(column).isNotNull())
        .groupBy(quoted(column).alias("event"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def with_count(df: DataFrame, name: str, counts: DataFrame, result: str) -> DataFrame:
    """Add the processed count of an event: exact name, else ignoring case, else 0 (JON-03).

    Both sides of the joins are aggregates with one row per name.
    """
    exact = counts.select(F.col("event").alias("_exact"), F.col("n").alias("_n"))
    folded = counts.groupBy(F.lower("event").alias("_folded")).agg(F.sum("n").alias("_m"))
    return (
        df.join(exact, quoted(name) == F.col("_exact"), "left")
        .join(folded, F.lower(quoted(name)) == F.col("_folded"), "left")
        .withColumn(result, F.coalesce("_n", "_m", F.lit(0)))
        .drop("_exact", "_n", "_folded", "_m")
    )


def source_rows(events: DataFrame, order: list[str] | None = None) -> DataFrame:
    """First row of the list per exact name."""
    order = order or [c for c in (S.SRC_DATE, S.SRC_URL, S.SRC_ORG) if c in events.columns]
    return keep_first(events, [S.SRC_NAME], order)


def with_source(names: DataFrame, name: str, events: DataFrame) -> DataFrame:
    """Add the list row of each name: exact, else ignoring case (columns listed_*)."""
    firsts = source_rows(events)
    counts = [quoted(S.SRC_SUBMISSIONS).alias("subs"), quoted(S.SRC_PARTICIPANTS).alias("regs")]
    exact = firsts.select(quoted(S.SRC_NAME).alias("_exact"), F.struct(F.lit(True).alias("hit"), *counts).alias("_e"))
    folded = firsts.groupBy(F.lower(quoted(S.SRC_NAME)).alias("_folded")).agg(
        F.min_by(F.struct(F.lit(True).alias("hit"), *counts), quoted(S.SRC_NAME)).alias("_f")
    )
    joined = (
        names.join(exact, quoted(name) == F.col("_exact"), "left")
        .join(folded, F.lower(quoted(name)) == F.col("_folded"), "left")
        .withColumn("_row", F.coalesce("_e", "_f"))
    )
    return joined.withColumns({
        "valid": F.coalesce(F.col("_row.hit"), F.lit(False)),
        "listed_submissions": F.col("_row.subs"),
        "listed_participants": F.col("_row.regs"),
    }).drop("_exact", "_e", "_folded", "_f", "_row")


def with_warnings(df: DataFrame, name: str = "event") -> DataFrame:
    """Add the outcome of the comparison: error text and list of warnings (VAL-02).

    A missing count on the list gives no warning.
    """
    subs, listed = F.col("submission_count"), F.col("listed_submissions")
    regs, people = F.col("registrant_count"), F.col("listed_participants")
    found = F.col("valid")
    too_many = F.concat(
        F.lit("Submission count ("), subs, F.lit(") exceeds source data ("), listed,
        F.lit("). This may be due to spam filtering."),
    )
    too_few = F.concat(
        F.lit("Submission count ("), subs, F.lit(") is significantly lower than source data ("), listed,
        F.lit("). Data may be incomplete."),
    )
    unusual = F.concat(
        F.lit("Registrant count ("), regs, F.lit(") exceeds source participant count ("), people,
        F.lit("). This is unusual."),
    )
    raised = F.array(
        F.when(found & (subs > listed), too_many).when(found & (subs < listed * INCOMPLETE_BELOW), too_few),
        F.when(found & (regs > people), unusual),
    )
    missing = F.concat(F.lit("Hackathon '"), quoted(name), F.lit("' not found in source data"))
    return df.withColumns({
        "error": F.when(~found, missing),
        "warnings": F.filter(raised, lambda w: w.isNotNull()),
    })


def reconcile_all(submissions: DataFrame, registrants: DataFrame, events: DataFrame) -> DataFrame:
    """Every event that has records or a list row, compared in one job (VAL-02)."""
    subs = processed_counts(submissions, S.TITLE)
    regs = processed_counts(registrants, S.EVENT)
    listed = events.select(quoted(S.SRC_NAME).alias("event"))
    names = subs.select("event").union(regs.select("event")).union(listed).distinct()
    counted = with_count(with_count(names, "event", subs, "submission_count"), "event", regs, "registrant_count")
    return with_warnings(with_source(counted, "event", events))


def organizer_events(submissions: DataFrame, registrants: DataFrame, events: DataFrame) -> DataFrame:
    """Every row of the event list with processed counts and warnings (VAL-04).

    An event listed twice appears twice, as it counts twice in the totals.
    """
    subs = processed_counts(submissions, S.TITLE)
    regs = processed_counts(registrants, S.EVENT)
    rows = events.select(quoted(S.SRC_ORG).alias("organizer"), quoted(S.SRC_NAME).alias("event"))
    counted = with_count(with_count(rows, "event", subs, "submission_count"), "event", regs, "registrant_count")
    checked = with_warnings(with_source(counted, "event", events))
    return checked.withColumn("status", F.when(F.col("valid"), "ok").otherwise("warning"))


def organizer_rollup(submissions: DataFrame, registrants: DataFrame, events: DataFrame) -> DataFrame:
    """Events, submissions and registrants per organizer (AGG-19)."""
    rows = organizer_events(submissions, registrants, events)
    totals = (
        rows.filter(F.col("organizer").isNotNull())
        .groupBy(fold(F.col("organizer")).alias("norm"))
        .agg(
            F.count(F.lit(1)).alias("hackathon_count"),
            F.sum("submission_count").alias("total_submissions"),
            F.sum("registrant_count").alias("total_registrants"),
        )
    )
    return organizer_mapping(events).select("norm", "canonical", "variations").join(totals, "norm")


def organizer_report(organizer: str, submissions, registrants, events) -> dict[str, DataFrame]:
    """Summary and event table of one organizer (VAL-04, SNK-05)."""
    norm = fold(F.lit(organizer))
    known = organizer_mapping(events).filter(F.col("norm") == norm)
    canonical = known.select("canonical").scalar()
    variations = known.select(F.array_join("variations", ", ")).scalar()
    rows = organizer_events(submissions, registrants, events).filter(
        fold(F.col("organizer")) == norm
    )
    totals = rows.agg(
        F.count(F.lit(1)).alias("Hackathon Count"),
        F.coalesce(F.sum("submission_count"), F.lit(0)).alias("Total Submissions"),
        F.coalesce(F.sum("registrant_count"), F.lit(0)).alias("Total Registrants"),
    )
    summary = totals.select(
        F.coalesce(canonical, F.lit(organizer)).alias("Canonical Name"),
        F.coalesce(variations, F.lit(organizer)).alias("Name Variations"),
        "Hackathon Count", "Total Submissions", "Total Registrants",
    )
    table = rows.select(
        F.col("status").alias("Status"),
        F.col("event").alias("Hackathon Name"),
        F.col("submission_count").alias("Submissions"),
        F.col("registrant_count").alias("Registrants"),
        F.coalesce(F.col("listed_submissions").cast("string"), F.lit("N/A")).alias("Source Submissions"),
        F.coalesce(F.col("listed_participants").cast("string"), F.lit("N/A")).alias("Source Participants"),
        F.array_join("warnings", "\n").alias("Warnings"),
    )
    return {"Organizer Summary": summary, "Hackathons": table}


def event_report(name: str, submissions, registrants, events) -> dict[str, DataFrame]:
    """Source row, records and attribution of one event (VAL-01, VAL-03, SNK-04)."""
    return {
        "Source Data": source_row(events, name),
        "Submissions": exact_else_folded(submissions, S.TITLE, name),
        "Registrants": exact_else_folded(registrants, S.EVENT, name),
        "Data Attribution": attribution(name, submissions, registrants, events),
    }


def source_row(events: DataFrame, name: str) -> DataFrame:
    """The list row of one event, exact name before folded name; empty if there is none."""
    order = [c for c in (S.SRC_DATE, S.SRC_URL, S.SRC_ORG) if c in events.columns]
    hits = exact_else_folded(events, S.SRC_NAME, name)
    return hits.orderBy(*[quoted(c) for c in order]).limit(1).select(
        quoted(S.SRC_ORG).alias("organization_name"),
        quoted(S.SRC_NAME).alias("hackathon_name"),
        quoted(S.SRC_URL).alias("hackathon_url"),
        quoted(S.SRC_DATE).alias("published_date"),
        quoted(S.SRC_PARTICIPANTS).alias("participant_count"),
        quoted(S.SRC_SUBMISSIONS).alias("valid_submissions"),
        quoted(S.SRC_MODE).alias("event_type"),
    )


def attribution(name: str, submissions, registrants, events) -> DataFrame:
    """Each figure of an event and where it comes from (VAL-03, RSH-05)."""
    truth, processed = "Source of Truth", "Processed Data Files"
    fields = {
        "Organization Name": "organization_name",
        "Hackathon URL": "hackathon_url",
        "Published Date": "published_date",
        "Total Participants (Source)": "participant_count",
        "Valid Submissions (Source)": "valid_submissions",
    }

    def line(label, value, origin):
        return F.struct(F.lit(label).alias("field"), value.cast("string").alias("value"), F.lit(origin).alias("source"))

    listed = source_row(events, name).select(
        F.inline(F.array(*[line(label, F.col(c), truth) for label, c in fields.items()]))
    )
    counts = exact_else_folded(submissions, S.TITLE, name).agg(F.count(F.lit(1)).alias("subs"))
    people = exact_else_folded(registrants, S.EVENT, name).agg(F.count(F.lit(1))).scalar()
    own = counts.select("subs", people.alias("regs")).select(
        F.inline(F.array(
            line("Processed Submissions", F.col("subs"), processed),
            line("Processed Registrants", F.col("regs"), processed),
        ))
    )
    return listed.unionByName(own)
