"""Replay-safe ingest of newly landed source files with Structured Streaming."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vintry.plans.publish import run
from vintry.sources.documents import named_documents
from vintry.sources.store import Store


def landed_documents(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of whole documents, one row per new file."""
    reader = spark.readStream.option("recursiveFileLookup", "true").option("wholetext", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return named_documents(reader.text(path))


def ingest_landed(
    spark: SparkSession,
    store: Store,
    landing: str,
    issuers: DataFrame,
    checkpoint: str,
    as_of: date,
    files_per_batch: int | None = None,
    **contract,
) -> StreamingQuery:
    """Process everything that has landed since the last call, then stop.

    A batch that is replayed after a crash finds its snapshots in the ledger and its
    facts in the store, so exactly-once does not rest on the sink. A document that fails a
    gate becomes a dead letter, with its reason; the others of its batch are published.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        run(
            spark, store, batch, issuers, as_of=as_of, mode="stream",
            **{"complete": False, "stop_on_failure": False, **contract},
        )

    return (
        landed_documents(spark, landing, files_per_batch)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
