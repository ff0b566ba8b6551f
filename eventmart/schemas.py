"""Record layouts and result column names.

Every header here is part of the data format: the exports being read carry these
names, so operators default to them and accept others as parameters.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: headers of the input records -------------------------------
ORG = "Organization Name"
TITLE = "Challenge Title"
PUBLISHED = "Challenge Published At"
PROJECT = "Project Title"
URL = "Submission Url"
CREATED = "Project Created At"
BUILT_WITH = "Built With"
EXTRA_MEMBERS = "Additional Team Member Count"

EVENT = "Hackathon Name"
USER = "User ID"
COUNTRY = "Country"
EXPERIENCE = "Work Experience"
SKILLS = "Skills"
OCCUPATION = "Occupation"
SPECIALTY = "Specialty"
INTERESTS = "Interests"

SRC_ORG = "Organization name"
SRC_NAME = "Hackathon name"
SRC_URL = "Hackathon url"
SRC_DATE = "Hackathon published date"
SRC_PARTICIPANTS = "Total participant count"
SRC_SUBMISSIONS = "Total valid submissions (excluding spam)"
SRC_MODE = "In person vs virtual"

SUBMISSION_DATES = [CREATED, PUBLISHED, "Created At"]
SUBMISSION_MARKERS = [
    "organization name",
    "challenge title",
    "project title",
    "submission url",
    "built with",
]
REGISTRANT_MARKERS = [
    "hackathon name",
    "user id",
    "country",
    "work experience",
    "skills",
    "occupation",
    "specialty",
]
# ---- end of fixed values ------------------------------------------------------

# Columns the store adds to each record: identity, source file and arrival order.
DEDUP_KEY = "_dedup_key"
FILE_HASH = "_file_hash"
INGEST_SEQ = "_ingest_seq"
BLOCK = "_block"
ROW_NO = "_row_no"
ARRIVAL = [INGEST_SEQ, FILE_HASH, BLOCK, ROW_NO]
BUCKET = "_bucket"

_text = T.StringType()


def _struct(*pairs) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in pairs])


SUBMISSIONS = _struct(
    (ORG, _text),
    (TITLE, _text),
    (PUBLISHED, T.TimestampNTZType()),
    (PROJECT, _text),
    (URL, _text),
    (CREATED, T.TimestampNTZType()),
    ("About The Project", _text),
    (BUILT_WITH, _text),
    (EXTRA_MEMBERS, T.DoubleType()),
)

REGISTRANTS = _struct(
    (EVENT, _text),
    (USER, _text),
    (COUNTRY, _text),
    (EXPERIENCE, T.DoubleType()),
    (SKILLS, _text),
    (OCCUPATION, _text),
    (SPECIALTY, _text),
)

EVENT_LIST = _struct(
    (SRC_ORG, _text),
    (SRC_NAME, _text),
    (SRC_URL, _text),
    (SRC_DATE, T.TimestampNTZType()),
    (SRC_PARTICIPANTS, T.LongType()),
    (SRC_SUBMISSIONS, T.LongType()),
    (SRC_MODE, _text),
)

LEDGER_EVENTS = _struct(
    ("file_hash", _text),
    ("file_name", _text),
    ("file_type", _text),
    ("status", _text),
    ("row_count", T.LongType()),
    ("error_message", _text),
    ("event_ts", T.TimestampNTZType()),
    ("event_seq", T.LongType()),
    ("path", _text),
)


def empty(spark, *pairs):
    """An empty frame with the given (name, type) columns."""
    return spark.createDataFrame([], _struct(*pairs))


def has_columns(df, *names: str) -> bool:
    return set(names) <= set(df.columns)
