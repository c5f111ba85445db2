"""Documents judged as they arrive: conversion, gates and scores work on single rows, so a stream of files needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillforge.functions.batches import bounded_batches
from quillforge.operators import checks as k
from quillforge.sources.candidates import candidates

DOCUMENTS = "doc_id long, text string"


def scorecards_of(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, a table or a stream.  A scorecard for each candidate, with the first gate that it fails."""
    bounded_batches(docs.sparkSession)
    cards = k.scorecards(k.check_rows(k.gates(k.judged(candidates(docs)))))
    return cards.select("doc_id", "adapter", "status", "first_failure", "total_score", "fail_count", "warn_count", "pass_count")


def take_in(spark: SparkSession, incoming: str, scored: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Judges the Parquet files of documents in `incoming` that no earlier call has, and appends their scorecards to `scored`.

    The checkpoint says which files are done, so a call that dies is taken up by the next and no scorecard is written twice.
    """
    docs = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(incoming)
    query = scorecards_of(docs).writeStream.format("parquet").option("path", scored).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
