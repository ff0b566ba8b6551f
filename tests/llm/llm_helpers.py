"""Small document tables and plain versions to hold operators against."""

import random

from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("n_chars", LongType()),
])
EDGE_TEXTS = [None, "", " ", "a", "one two", "one two", "  two  spaces \n\n and\ttabs ", "\u00e9\u00e8 \U0001f600 na\u00efve", "x" * 5000, "w " * 4000]


def documents(spark, texts, first=0, lang="en", source="s"):
    rows = [(first + i, t, lang, source, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(seed, count, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(count))


def stored(spark, tmp_path, df, name="documents"):
    """A folder that holds ``df`` as a table, as queries read it."""
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
