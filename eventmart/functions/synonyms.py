"""Synonym dictionaries (SRC-08)."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOMAINS = ("technologies", "skills")


def load_synonyms(path: str | None = None) -> dict[str, dict[str, str]]:
    """``{domain: {alias: canonical}}`` of a file; empty domains without one or when it is missing."""
    if path is None or not os.path.exists(path):
        return {domain: {} for domain in DOMAINS}
    with open(path, encoding="utf-8") as source:
        return json.load(source)


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary file as rows (domain, alias, canonical), from any storage Spark reads."""
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "map<string,map<string,string>>")
    domains = text.select(F.explode(parsed).alias("domain", "aliases"))
    return domains.select("domain", F.explode("aliases").alias("alias", "canonical"))
