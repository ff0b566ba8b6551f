"""Reproducible exact-size samples per event (SMP-01..05, JON-05, CLN-13, CLN-15)."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import dates
from ..functions.text import strip
from ..functions.urls import HOST, slug_from_input, slug_from_url
from ..session import broadcast_if_small, materialise
from . import entities
from .clean import quoted
from .dedup import keep_first

# Columns left out of samples.
EXCLUDED = ["Hackathon Description", S.DEDUP_KEY]
# Ours: bookkeeping columns of the store.
INTERNAL = [S.FILE_HASH, S.INGEST_SEQ, S.BLOCK, S.ROW_NO]
# Metadata column -> name in the sample.
METADATA = {
    "Organization Type": "Organization Type",
    "Organization Category": "Organization Category",
    "In person vs virtual": "In Person vs Virtual",
}


def ticket(seed: Column, key: Column) -> Column:
    """Pseudo-random order of a record under a seed; the same on every cluster."""
    return F.md5(F.concat_ws(":", seed.cast("string"), key).cast("binary"))


def smallest_n(df: DataFrame, group: list[str], by: str, n: int) -> DataFrame:
    """Exactly the ``n`` rows with the smallest ticket per group, or all if there are fewer.

    Up to the bound for which Spark cuts the rows of each task to ``n`` a group before it shuffles them,
    ``df`` is read once and ranked. Beyond it tickets are counted per hash range, whole ranges are kept up
    to the one that crosses ``n``, and only inside a range are rows ranked. Either way no task ranks a hot group.
    """
    if n <= 0:
        return df.limit(0)
    keys = [quoted(g) for g in group]
    if n <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        known = df.dropna(subset=[*group, by])
        ranked = known.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(by)))
        return ranked.filter(F.col("_place") <= n).drop("_place")
    ranged = df.withColumn("_range", F.conv(F.substring(by, 1, 4), 16, 10).cast("int"))
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    room = counts.withColumn("_room", F.lit(n) - F.coalesce(F.sum("_size").over(before), F.lit(0)))
    room = room.filter(F.col("_room") > 0).drop("_size")
    within = Window.partitionBy(*keys, "_range").orderBy(by)
    placed = ranged.join(room, [*group, "_range"]).withColumn("_place", F.row_number().over(within))
    return placed.filter(F.col("_place") <= F.col("_room")).drop("_range", "_room", "_place")


def sample_events(
    entries: DataFrame,
    submissions: DataFrame,
    size: int = 30,
    seed: int | None = None,
    export_all: bool = False,
    metadata: DataFrame | None = None,
    key: str | None = None,
    order: list[str] | None = None,
    host: str = HOST,
    dimension: DataFrame | None = None,
) -> DataFrame:
    """Sampled submissions of every list entry in one job (SMP-01..03).

    ``entries`` has idx and url; entry ``idx`` draws with ``seed + idx``. Without a
    seed one is drawn here, so the returned frame still shows one fixed sample. The
    matched events are written to the checkpoint folder and their size is checked:
    a short list is broadcast and the submissions are filtered where they are read.
    Pass a written ``dimension`` (see :func:`entities.event_dimension`) of the same submissions if there is one.
    """
    key = key or (S.DEDUP_KEY if S.DEDUP_KEY in submissions.columns else S.URL)
    seed = random.randrange(2**31) if seed is None else seed
    asked = entries.withColumn("identifier", strip(F.col("url"))).filter(F.col("identifier") != "")
    if dimension is None:
        dimension = materialise(entities.event_dimension(submissions, order=order, host=host))
    matches = materialise(entities.match_events(asked.select("identifier"), dimension, host))
    figures = entities.lookup(asked.select("identifier"), dimension, matches, host)
    picked = asked.select("idx", "identifier").join(
        matches.select("identifier", F.col("slug").alias("_slug"), F.col("title").alias("_title")), "identifier"
    )
    picked = broadcast_if_small(materialise(picked))
    rows = submissions.withColumn("_own_slug", slug_from_url(quoted(S.URL), host))
    same = F.col("_own_slug").eqNullSafe(F.col("_slug")) & quoted(S.TITLE).eqNullSafe(F.col("_title"))
    drawn = rows.join(picked, same).drop("_slug", "_title", "_own_slug")
    if not export_all:
        drawn = drawn.withColumn("_ticket", ticket(F.lit(seed) + F.col("idx"), quoted(key)))
        drawn = smallest_n(drawn, ["idx"], "_ticket", size).drop("_ticket")
    drawn = drawn.join(figures.select("identifier", "submission_bucket", "hackathon_year", F.col("url").alias("_url")), "identifier")
    tagged = drawn.withColumns({
        "Year": F.year(dates.as_timestamp(drawn, S.CREATED)),
        "Submission Bucket": F.col("submission_bucket"),
        "Hackathon Year": F.col("hackathon_year"),
        "Hackathon URL": F.col("identifier"),
        "Hackathon Slug": slug_from_input(F.col("identifier"), host),
    })
    tagged = _with_metadata(tagged, metadata)
    return tagged.drop("identifier", "submission_bucket", "hackathon_year", "_url", *EXCLUDED, *INTERNAL)


def _with_metadata(df: DataFrame, metadata: DataFrame | None) -> DataFrame:
    """Add up to three metadata columns by event URL, the first entry per URL (JON-05)."""
    if metadata is None or S.SRC_URL not in metadata.columns:
        return df
    present = [c for c in METADATA if c in metadata.columns]
    if not present:
        return df
    order = ["idx"] if "idx" in metadata.columns else present
    one = keep_first(metadata, [S.SRC_URL], order, [S.SRC_URL, *present])
    one = one.select(quoted(S.SRC_URL).alias("_meta_url"), *[quoted(c).alias(METADATA[c]) for c in present])
    return df.join(one, F.col("_url") == F.col("_meta_url"), "left").drop("_meta_url")


def batch_summary(
    entries: DataFrame,
    dimension: DataFrame,
    size: int = 30,
    export_all: bool = False,
    curated: bool = False,
    host: str = HOST,
) -> DataFrame:
    """One row per list entry, also for those not found (SMP-04).

    The figures depend on counts only, so no sample is drawn.
    """
    asked = entries.withColumn("identifier", strip(F.col("url"))).filter(F.col("identifier") != "").drop("url")
    found = entities.lookup(asked.select("identifier"), dimension, host=host)
    total = F.coalesce("submission_count", F.lit(0))
    drawn = total if export_all else F.least(total, F.lit(size).cast("long"))
    hit = F.col("submission_count").isNotNull()
    columns = [
        "idx",
        F.col("identifier").alias("Hackathon URL"),
        slug_from_input(F.col("identifier"), host).alias("Hackathon Slug"),
        F.coalesce("challenge_title", F.lit("")).alias("Hackathon Name"),
        F.coalesce("organization", F.lit("")).alias("Organization"),
        total.alias("Total Submissions"),
        drawn.alias("Exported Count" if curated else "Sample Size"),
    ]
    if curated:
        columns += [
            F.coalesce("submission_bucket", F.lit("")).alias("Submission Bucket"),
            F.col("hackathon_year").alias("Hackathon Year"),
        ]
    columns += [
        F.when(hit, "success").otherwise("not_found").alias("Status"),
        F.when(hit, "").otherwise(
            F.concat(F.lit("No submissions found for hackathon: "), F.col("identifier"))
        ).alias("Error"),
    ]
    return asked.join(found, "identifier", "left").select(*columns).orderBy("idx")


def batch_statistics(summary: DataFrame) -> DataFrame:
    """Entries processed, found, not found, rows sampled (SMP-05)."""
    sampled = "Exported Count" if "Exported Count" in summary.columns else "Sample Size"
    return summary.agg(
        F.count(F.lit(1)).alias("Total Hackathons Processed"),
        F.count_if(F.col("Status") == "success").alias("Hackathons Found"),
        F.count_if(F.col("Status") == "not_found").alias("Hackathons Not Found"),
        F.coalesce(F.sum(quoted(sampled)), F.lit(0)).alias("Total Samples Collected"),
    )


def sample_metadata(figures: DataFrame, size: int, seed: int | None) -> DataFrame:
    """The metadata row of a sample export; the seed, or the word Random (SNK-06)."""
    return figures.select(
        F.col("challenge_title").alias("Hackathon"),
        F.col("organization").alias("Organization"),
        F.col("url").alias("URL"),
        F.col("submission_count").alias("Total Submissions"),
        F.least("submission_count", F.lit(size).cast("long")).alias("Sample Size"),
        F.lit("Random" if seed is None else str(seed)).alias("Random Seed"),
    )
