"""Mixing sources to target weights by Poisson replication.

Each source has a repetition rate that brings its share of characters to its weight. The number of
copies of a document inverts the Poisson distribution of that mean at a uniform number hashed from
seed and id, so it depends on nothing else, and copies are ordered by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .common import free_names, partitions, saved

SEED = "mix-1"
#: The largest mean that is inverted at once; larger ones are cut into equal blocks drawn one by one.
BLOCK_MEAN = 1024
#: Copies of a document that are listed at a time.
RANGE = 4096


def _hashed(*parts: Column) -> Column:
    """A whole number below 2**60 from the parts joined with bars; NULL reads as empty."""
    text = F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """(source, rate, blocks, cdf) of every source: mean number of copies, and the distribution function from 0
    of one of the ``blocks`` equal parts of that mean, each at most BLOCK_MEAN.

    ``weights`` gives relative weights; None weighs all sources alike, a source it does not name
    gets no copies. The mix has as many characters as the input in expectation (a document counts
    one more, so empty ones have a size). NULL is a source like any other.
    """
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(
        F.sum((F.coalesce(F.length("text"), F.lit(0)) + 1).cast("long")).alias("size")
    )
    weight = F.lit(1.0)
    if weights is not None:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    sizes = saved(sizes.withColumn("weight", weight), "mix-sizes")
    totals = sizes.agg(F.sum("size").alias("all"), F.sum("weight").alias("weights"))
    share = F.col("weight") / F.when(F.col("weights") > 0, F.col("weights"))
    rated = sizes.crossJoin(F.broadcast(totals)).withColumn("rate", F.coalesce(share * F.col("all") / F.col("size"), F.lit(0.0)))
    rated = rated.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("rate") / BLOCK_MEAN)).cast("int"))
    mean = F.col("rate") / F.col("blocks")
    # terms in logarithms, up to where the rest of the distribution is below any hashed number
    last = (F.ceil(mean + 12 * F.sqrt(mean)) + 30).cast("int")
    grown = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct((-mean).alias("log"), F.array(F.exp(-mean)).alias("cdf")),
        lambda state, k: F.struct(
            (state["log"] + F.log(mean / k)).alias("log"),
            F.concat(state["cdf"], F.array(F.element_at(state["cdf"], -1) + F.exp(state["log"] + F.log(mean / k)))).alias("cdf"),
        ),
    )
    cdf = F.when(F.col("rate") > 0, grown["cdf"]).otherwise(F.array(F.lit(1.0)))
    return rated.select("source", "rate", "blocks", cdf.alias("cdf"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """Each document as often as its draw says, with ``copy`` (from 1) and ``shuffle_key``, in the order of the key.

    Other columns stay; input columns of those two names are replaced. Rows that share an id share
    the draw. A NULL text is copied like any other. No documents give none. Each block of a source's mean is
    drawn with a hash of its own, and copies are listed in ranges, so the work is in proportion to the copies.
    ``copy`` is an int: a document with more than 2**31 - 1 copies fails the job. Texts are not looked into, whatever their length.
    """
    docs = docs.drop("copy", "shuffle_key")
    source, blocks, cdf, number, first = free_names(docs, "source", "blocks", "cdf", "n", "first")
    rate = saved(rates(docs, weights), "mix-rates").select(F.col("source").alias(source), F.col("blocks").alias(blocks), F.col("cdf").alias(cdf))

    def drawn(*block: Column) -> Column:
        u = _hashed(F.col("doc_id"), F.lit("copies"), *block) / F.lit(float(1 << 60))
        # the distribution function does not fall, so the values up to u come first
        return F.size(F.filter(cdf, lambda c: c <= u))

    more = F.when(F.col(blocks) > 1, F.sequence(F.lit(2), F.col(blocks))).otherwise(F.array().cast("array<int>"))
    copies = F.aggregate(more, drawn().cast("long"), lambda s, k: s + drawn(k).cast("long"))
    upto = F.least(F.col(first) + RANGE - 1, F.col(number))
    out = (
        docs.join(broadcast_if_small(rate), F.col("source").cast("string").eqNullSafe(F.col(source)))
        .withColumn(number, copies).filter(F.col(number) > 0)
        .withColumn(first, F.explode(F.sequence(F.lit(1).cast("long"), F.col(number), F.lit(RANGE).cast("long"))))
        .withColumn("copy", F.explode(F.sequence(F.col(first), upto).cast("array<int>")))
        .withColumn("shuffle_key", _hashed(F.col("doc_id"), F.col("copy")))
        .drop(source, blocks, cdf, number, first)
    )
    return out.repartitionByRange(partitions(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")
