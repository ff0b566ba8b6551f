"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(c: Column) -> Column:
    """Text or number to double, NULL where it does not parse (CLN-07)."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def cap_to_null(c: Column, maximum: float) -> Column:
    """NULL for values above ``maximum``; everything else is kept (CLN-08)."""
    return F.when(c <= F.lit(maximum), c)


def round_half_even(c: Column, digits: int = 2) -> Column:
    """Round a scaled double half to even, as array libraries do (FN-15, FN-16)."""
    scale = float(10**digits)
    return F.rint(c * scale) / scale


def round_nearest(c: Column) -> Column:
    """Two-digit value nearest to a double in [0, 128), exact ties to even.

    ``0.06725 * 100`` prints as 6.725 but lies above it, so scaling first would lose
    the digit that decides. The double is split in two parts whose products with 200
    are exact; the sign of their sum tells on which side of the tie it lies.
    """
    below = F.floor(c * 100).cast("double")
    head = F.floor(c * 524288).cast("double") / 524288
    side = (head * 200 - (below * 2 + 1)) + (c - head) * 200
    step = F.when(side > 0, 1.0).when(side < 0, 0.0).otherwise(below % 2)
    return (below + step) / 100


def percentage(part: Column, total: Column, nearest: bool = False) -> Column:
    """``part`` as a percentage of ``total`` with two digits; 0 when there is no total.

    ``nearest`` selects :func:`round_nearest`, the rule of the ranked token lists;
    distributions use :func:`round_half_even`.
    """
    share = F.try_divide(part, total) * 100
    return F.coalesce(round_nearest(share) if nearest else round_half_even(share), F.lit(0.0))


def growth(current: Column, previous: Column) -> Column:
    """Change against ``previous`` in percent; NULL for a missing or zero base (WIN-02)."""
    return (F.try_divide(current, previous) - 1) * 100


def canonical_id(c: Column) -> Column:
    """Identifier text that does not depend on how a reader typed it: ``12.0`` is ``12``."""
    return F.regexp_replace(c.cast("string"), r"^(-?\d+)\.0+$", "$1")


def team_size(extra_members: Column) -> Column:
    """Members in a team from the number of additional members (CLN-11)."""
    return F.coalesce(extra_members, F.lit(0.0)).cast("long") + 1


# Smallest submission count of each size bucket, largest first.
SIZE_BUCKETS = [
    (300, "Bucket E (Mega)"),
    (100, "Bucket D (Large)"),
    (25, "Bucket C (Mid-Size)"),
    (10, "Bucket B (Small)"),
    (1, "Bucket A (Micro)"),
]


def size_bucket(count: Column, buckets=SIZE_BUCKETS) -> Column:
    """Label of the first bucket whose threshold ``count`` reaches, else the last one (FN-08)."""
    chain = F
    for threshold, label in buckets:
        chain = chain.when(count >= threshold, F.lit(label))
    return chain.otherwise(F.lit(buckets[-1][1]))
