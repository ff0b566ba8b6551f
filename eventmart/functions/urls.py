"""Event slugs and URLs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Fixed value: host below which each event has a sub-domain.
HOST = "devpost.com"


def slug_from_input(c: Column, host: str = HOST) -> Column:
    """Slug of what a user typed: a URL, a bare host or a plain name (FN-04)."""
    typed = strip(c)
    found = F.regexp_extract(typed, rf"^(?:https?://)?([A-Za-z0-9-]+)\.{re.escape(host)}", 1)
    return F.lower(F.coalesce(F.nullif(found, F.lit("")), typed))


def slug_from_url(c: Column, host: str = HOST, scheme: str = "https") -> Column:
    """Slug inside a stored URL, case kept, NULL when the URL has another form (FN-05)."""
    found = F.regexp_extract(c, rf"{scheme}://([^.]+)\.{re.escape(host)}", 1)
    return F.nullif(found, F.lit(""))


def event_url(slug: Column, host: str = HOST) -> Column:
    """URL of an event, NULL for a NULL slug (FN-06)."""
    return F.concat(F.lit("https://"), slug, F.lit(f".{host}"))
