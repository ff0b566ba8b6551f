"""Keep-first deduplication (AGG-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from .clean import quoted


def keep_first(df: DataFrame, keys, order, columns=None) -> DataFrame:
    """One row per key: the smallest by ``order``.

    An aggregate, not a window: each task first reduces its own rows to one per key,
    so a key shared by a third of the table (the empty one, say) costs one row per
    task in the shuffle. Pass ``columns`` to carry fewer columns through it.
    """
    kept = [c for c in (columns or df.columns) if c not in keys]
    row = F.struct(*[quoted(c) for c in kept])
    rank = F.struct(*[quoted(c) for c in order])
    first = df.groupBy(*[quoted(k) for k in keys]).agg(F.min_by(row, rank).alias("_first"))
    picked = [quoted(k) for k in keys] + [F.col("_first").getField(c).alias(c) for c in kept]
    names = [c for c in (columns or df.columns)]
    return first.select(*picked).select(*[quoted(c) for c in names])


def deduplicate_store(df: DataFrame) -> DataFrame:
    """Records of the store, each identity once, the first arrival wins."""
    if S.DEDUP_KEY not in df.columns:
        return df
    order = [c for c in S.ARRIVAL if c in df.columns]
    return keep_first(df, [S.DEDUP_KEY], order or [c for c in df.columns if c != S.DEDUP_KEY])
