"""Incremental pick-up of a drop folder (LED-09)."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from ..plans.ingest import ingest_files
from ..sources.text_exports import scan_files

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def pick_up(
    spark: SparkSession, folder: str, store: str, ledger_path: str, checkpoint: str, files_per_batch: int = 1000
) -> None:
    """Ingest the files that arrived since the last call, then stop.

    The stream remembers which files it has seen in ``checkpoint`` (a shared folder);
    a batch that is repeated after a failure changes nothing, because the ledger skips
    completed content and the store holds each identity once.
    """
    arrivals = (
        spark.readStream.format("binaryFile")
        .schema(_SCHEMA)
        .option("pathGlobFilter", "*.[cC][sS][vV]")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select("path")
    )

    def ingest(batch, _):
        # at most files_per_batch paths; characters of patterns stand for themselves
        paths = [re.sub(r"([\\*?\[\]{}])", r"\\\1", r["path"]) for r in batch.collect()]
        if paths:
            ingest_files(scan_files(spark, *paths), store, ledger_path)

    query = (
        arrivals.writeStream.foreachBatch(ingest)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
