"""Events found in the submissions: catalogue, search, tiered lookup (AGG-20, JON-08, SMP-06..08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import dates, numbers
from ..functions.text import strip
from ..functions.urls import HOST, event_url, slug_from_input, slug_from_url
from ..session import materialise
from .clean import quoted


def arrival_order(df: DataFrame, fallback=(S.URL,)) -> list[str]:
    """Columns that define which record of a group came first."""
    return [c for c in S.ARRIVAL if c in df.columns] or list(fallback)


def event_dimension(
    df: DataFrame,
    url: str = S.URL,
    title: str = S.TITLE,
    org: str = S.ORG,
    project: str = S.PROJECT,
    created: str = S.CREATED,
    order: list[str] | None = None,
    host: str = HOST,
) -> DataFrame:
    """Submissions counted per (slug, title, organization, year), with the first arrival of each.

    Everything that looks events up works on this small table: the submissions are
    read once, combined inside each task, and never compared with identifiers.
    """
    order = order or arrival_order(df, (url,))
    first = quoted(order[0]) if len(order) == 1 else F.struct(*[quoted(c) for c in order])
    return df.groupBy(
        slug_from_url(quoted(url), host).alias("slug"),
        quoted(title).alias("title"),
        quoted(org).alias("organization"),
        F.year(dates.as_timestamp(df, created)).alias("year"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(quoted(project)).alias("projects"),
        F.min(first).alias("first"),
    )


def catalogue(dimension: DataFrame, host: str = HOST) -> DataFrame:
    """Events by slug with their first known title and organization, largest first (AGG-20)."""
    def first_known(name):
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("first")))

    return (
        dimension.filter(F.col("slug").isNotNull())
        .groupBy("slug")
        .agg(
            first_known("title").alias("challenge_title"),
            first_known("organization").alias("organization"),
            F.sum("projects").alias("submission_count"),
        )
        .withColumn("url", event_url(F.col("slug"), host))
        .orderBy(F.desc("submission_count"), "slug")
    )


# Search scores by kind of hit.
SCORES = {"slug": 100, "prefix": 80, "inside": 60, "title": 40}


def search_score(slug: Column, title: Column, text: str) -> Column:
    """Score of an event for a search text, NULL for no hit (FN-09)."""
    low = F.lower(F.coalesce(slug, F.lit("")))
    name = F.lower(F.coalesce(title, F.lit("")))
    needle = text.lower()
    return (
        F.when(low == needle, SCORES["slug"])
        .when(low.startswith(needle), SCORES["prefix"])
        .when(low.contains(needle), SCORES["inside"])
        .when(name.contains(needle), SCORES["title"])
    )


def search(events: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Best hits in the catalogue: by score, then size (SMP-08, SRT-06)."""
    scored = events.withColumn("score", search_score(F.col("slug"), F.col("challenge_title"), text))
    hits = scored.filter(F.col("score").isNotNull())
    return hits.orderBy(F.desc("score"), F.desc("submission_count"), "slug").limit(limit)


# ---- tiered lookup ---------------------------------------------------------------


def match_events(identifiers: DataFrame, dimension: DataFrame, host: str = HOST) -> DataFrame:
    """The (slug, title) pairs each identifier stands for, with the tier that hit (JON-08).

    ``identifiers`` has one column of that name. Tier 1 compares slugs, tier 2 whole
    titles ignoring case, tier 3 looks for the slug inside titles; a later tier is
    used only for identifiers without a hit so far. All three are equality joins.
    """
    wanted = (
        identifiers.select(strip(F.col("identifier")).alias("identifier"))
        .filter(F.col("identifier") != "")
        .distinct()
        .withColumn("needle", slug_from_input(F.col("identifier"), host))
    )
    names = dimension.select("slug", "title").distinct()
    columns = ["identifier", "slug", "title"]
    by_slug = wanted.join(names, F.col("needle") == F.lower("slug")).select(*columns, F.lit(1).alias("tier"))
    by_title = wanted.join(names, F.lower("identifier") == F.lower("title")).select(*columns, F.lit(2).alias("tier"))
    equal = by_slug.unionByName(by_title)
    best = equal.groupBy("identifier").agg(F.min("tier").alias("tier"))
    rest = wanted.join(best, "identifier", "left_anti")
    inside = _titles_containing(rest, names).select(*columns, F.lit(3).alias("tier"))
    return equal.join(best, ["identifier", "tier"], "left_semi").unionByName(inside)


def _grams(text: Column, size: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))


def _titles_containing(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of a needle and a title that contains it.

    A title holding the needle holds each of its three-letter pieces (the whole needle
    if it is shorter). Each needle is joined on the one of its pieces that the fewest
    titles hold, and the candidates are then compared in full, so the result is exact
    without comparing every needle with every title.
    """
    titles = names.filter(F.col("title").isNotNull()).withColumn("hay", F.lower("title"))
    sizes = F.array(F.lit(1), F.lit(2), F.lit(3))
    pieces = titles.withColumn("size", F.explode(sizes)).filter(F.length("hay") >= F.col("size"))
    pieces = pieces.withColumn("piece", F.explode(_grams(F.col("hay"), F.col("size"))))
    size = F.least(F.length("needle"), F.lit(3))
    asked = wanted.withColumn("piece", F.explode(_grams(F.col("needle"), size)))
    asked_pieces = asked.select("piece").distinct()
    held = pieces.join(asked_pieces, "piece", "left_semi")
    frequency = held.groupBy("piece").agg(F.count(F.lit(1)).alias("held_by"))
    rarest = (
        asked.join(frequency, "piece", "left")
        .groupBy("identifier", "needle")
        .agg(F.min_by("piece", F.struct(F.coalesce("held_by", F.lit(0)), F.col("piece"))).alias("piece"))
    )
    return rarest.join(held, "piece").filter(F.contains("hay", "needle"))


def lookup(identifiers: DataFrame, dimension: DataFrame, matches: DataFrame | None = None, host: str = HOST) -> DataFrame:
    """Figures of the event behind each identifier that is found (SMP-07).

    Slug, title and organization are those of the first matching submission; the year
    is the most frequent one, the earliest on ties (AGG-21).
    """
    if matches is None:
        # used several times below: written once, so that the submissions are read once
        dimension = materialise(dimension)
        matches = match_events(identifiers, dimension, host)
    keys = matches.select("identifier", F.col("slug").alias("m_slug"), F.col("title").alias("m_title"))
    same = F.col("slug").eqNullSafe(F.col("m_slug")) & F.col("title").eqNullSafe(F.col("m_title"))
    per_year = (
        dimension.join(keys, same)
        .groupBy("identifier", "year")
        .agg(
            F.sum("n").alias("n"),
            F.min_by(F.struct("slug", "title", "organization"), "first").alias("head"),
            F.min("first").alias("first"),
        )
    )
    return (
        per_year.groupBy("identifier")
        .agg(
            F.min_by("head", "first").alias("head"),
            F.sum("n").alias("submission_count"),
            F.min_by("year", F.when(F.col("year").isNotNull(), F.struct(-F.col("n"), F.col("year")))).alias("hackathon_year"),
        )
        .select(
            "identifier",
            F.col("head.slug").alias("slug"),
            F.col("head.title").alias("challenge_title"),
            F.col("head.organization").alias("organization"),
            "submission_count",
            event_url(F.col("head.slug"), host).alias("url"),
            numbers.size_bucket(F.col("submission_count")).alias("submission_bucket"),
            "hackathon_year",
        )
    )


def preview(entries: DataFrame, dimension: DataFrame, limit: int = 10, host: str = HOST) -> DataFrame:
    """The first ``limit`` list entries: found or not, title, size, and the list total (SMP-06).

    ``entries`` has the columns idx and url (see :func:`eventmart.sources.lists.indexed`).
    """
    total = entries.agg(F.count(F.lit(1))).scalar()
    head = entries.orderBy("idx").limit(limit).withColumn("identifier", strip(F.col("url")))
    head = head.filter(F.col("identifier") != "")
    found = lookup(head.select("identifier"), dimension, host=host)
    return (
        head.join(found.drop("url", "slug"), "identifier", "left")
        .select(
            "idx",
            F.col("identifier").alias("url"),
            slug_from_input(F.col("identifier"), host).alias("slug"),
            F.col("submission_count").isNotNull().alias("found"),
            F.col("challenge_title").alias("hackathon_name"),
            F.coalesce("submission_count", F.lit(0)).alias("submission_count"),
            total.alias("list_total"),
        )
        .orderBy("idx")
    )
