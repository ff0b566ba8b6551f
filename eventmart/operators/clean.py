"""Cleaning: header repair, text, dates, numbers, dedup keys (CLN-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import dates, numbers
from ..functions.text import clean_text, collapse, strip

MAX_EXPERIENCE = 50.0


def quoted(name: str) -> Column:
    """Column by its exact name; headers hold blanks and dots."""
    return F.col("`" + name.replace("`", "``") + "`")


# ---- headers: expressions over one row per file ------------------------------


def header_is_broken(cells: Column) -> Column:
    """True when a header cell is missing or was filled in by a spreadsheet (CLN-01)."""
    return F.exists(
        cells, lambda cell: cell.isNull() | (strip(cell) == "") | cell.startswith("Unnamed")
    )


def repaired_header(first: Column, second: Column) -> Column:
    """Column names of a file from its first two rows (CLN-01, 02, 03).

    A broken first row is replaced by the second. Names lose the byte order mark
    and surplus white space, and repeated names get ``.1``, ``.2`` and so on. Names that
    differ only in case are repeated names, as columns of a table are.
    """
    chosen = F.when(header_is_broken(first) & second.isNotNull(), second).otherwise(first)
    cleaned = F.transform(
        chosen,
        lambda cell: collapse(F.regexp_replace(F.coalesce(cell, F.lit("nan")), "^\ufeff+", "")),
    )
    return _numbered(cleaned)


def _numbered(names: Column) -> Column:
    """Each name once: a repeated one takes the next number that no other header cell uses."""
    given = F.transform(names, F.lower)

    def add(taken, name):
        repeated = F.exists(taken, lambda other: F.lower(other) == F.lower(name))
        numbered = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.concat(name, F.lit("."), k.cast("string")))
        free = F.filter(
            numbered,
            lambda new: ~F.array_contains(given, F.lower(new)) & ~F.exists(taken, lambda other: F.lower(other) == F.lower(new)),
        )
        return F.concat(taken, F.array(F.when(repeated, F.get(free, F.lit(0))).otherwise(name)))

    return F.aggregate(names, F.array().cast("array<string>"), add)


# ---- columns -------------------------------------------------------------------


def clean_text_columns(df: DataFrame, columns=None, blank_as_null: bool = False) -> DataFrame:
    """Normalise every text column (or the given ones) in one projection (CLN-04)."""
    chosen = columns or [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and not f.name.startswith("_")
    ]
    return df.withColumns({name: clean_text(quoted(name), blank_as_null) for name in chosen})


def merge_repeated_columns(df: DataFrame, base: str) -> DataFrame:
    """Fill gaps in ``base`` from ``base.1``, ``base.2``, … and drop those (CLN-05).

    A gap is NULL, the empty text or the word ``None``.
    """
    extras = [name for name in df.columns if name.startswith(f"{base}.")]
    if base not in df.columns or not extras:
        return df
    merged = quoted(base)
    for name in extras:
        gap = merged.isNull() | merged.cast("string").isin("", "None")
        merged = F.when(gap, quoted(name)).otherwise(merged)
    return df.withColumn(base, merged).drop(*extras)


def coerce_dates(df: DataFrame, columns, formats=dates.DATE_FORMATS) -> DataFrame:
    """Zone-less UTC timestamps for the columns present (CLN-06)."""
    present = [name for name in columns if name in df.columns]
    return df.withColumns({name: dates.as_timestamp(df, name, formats) for name in present})


def coerce_numbers(df: DataFrame, columns) -> DataFrame:
    """Doubles for the columns present, NULL where the text is no number (CLN-07)."""
    present = [name for name in columns if name in df.columns]
    return df.withColumns({name: numbers.to_double(quoted(name)) for name in present})


def clean_submissions(df: DataFrame, formats=dates.DATE_FORMATS, date_columns=S.SUBMISSION_DATES) -> DataFrame:
    """All cleaning steps of a submission export."""
    df = clean_text_columns(df)
    for base in date_columns:
        df = merge_repeated_columns(df, base)
    df = coerce_dates(df, date_columns, formats)
    return coerce_numbers(df, [S.EXTRA_MEMBERS])


def clean_registrants(df: DataFrame, max_experience: float = MAX_EXPERIENCE) -> DataFrame:
    """All cleaning steps of a registrant export (CLN-04, 07, 08, 09)."""
    df = clean_text_columns(df)
    df = coerce_numbers(df, [S.EXPERIENCE])
    if S.EXPERIENCE in df.columns:
        df = df.withColumn(S.EXPERIENCE, numbers.cap_to_null(quoted(S.EXPERIENCE), max_experience))
    if S.USER in df.columns:
        df = df.withColumn(S.USER, numbers.canonical_id(quoted(S.USER)))
    return df.drop(S.INTERESTS)


def with_dedup_key(df: DataFrame, kind: str) -> DataFrame:
    """Add the identity of a record (CLN-10).

    Submissions are identified by their URL, registrants by event and user. A file
    without those columns keeps all its rows: their identity is file and position.
    """
    position = F.concat_ws(":", *[quoted(c).cast("string") for c in (S.FILE_HASH, S.ROW_NO) if c in df.columns])
    if kind == "submission" and S.URL in df.columns:
        key = quoted(S.URL).cast("string")
    elif kind == "registrant" and S.has_columns(df, S.EVENT, S.USER):
        key = F.concat(quoted(S.EVENT), F.lit("|"), numbers.canonical_id(quoted(S.USER)))
    else:
        key = position
    return df.withColumn(S.DEDUP_KEY, key)
