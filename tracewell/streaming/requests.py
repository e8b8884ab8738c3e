"""Arriving concerns and queries as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.operators.intents import derived_intents, semantic_intents
from tracewell.operators.search import hybrid_search, keyword_search, vector_search
from tracewell.operators.terms import chunk_features
from tracewell.operators.triage import refusal, triage
from tracewell.session import stored


def triage_stream(concerns: DataFrame, text: str = "concern_text") -> DataFrame:
    """Refusal, concern type, risk lane and intents per arriving concern.

    Stateless and row-local, so the same function serves a batch table and a stream.
    """
    return derived_intents(semantic_intents(triage(refusal(concerns, text), text), text))


def start_triage(concerns: DataFrame, path: str, checkpoint: str, text: str = "concern_text", **trigger) -> StreamingQuery:
    """Append triaged concerns to a Parquet folder."""
    return (
        triage_stream(concerns, text)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_retrieve(
    queries: DataFrame,
    chunks: DataFrame,
    path: str,
    checkpoint: str,
    k: int = 5,
    source_type: str | None = None,
    search: Callable[..., DataFrame] = keyword_search,
    index: DataFrame | None = None,
    **trigger,
) -> StreamingQuery:
    """Top-k evidence per arriving query against a static chunk table.

    Every micro-batch is one bulk search over ``index``, the stored chunk features, which are made once
    where none are given; a search of the caller's own gets the chunks alone.  Its rows go to the partition of its batch id, which a
    repeated batch overwrites, so a restart leaves no duplicates.
    """

    if index is None and search in (keyword_search, vector_search, hybrid_search):
        index = stored(chunk_features(chunks, 0 if search is keyword_search else 128), "stream-features")
    extra = {} if index is None else {"index": index}

    def write(batch: DataFrame, batch_id: int) -> None:
        # The batch is read by the size check and by the search; keep it for both.
        kept = batch.persist()
        try:
            found = search(kept, chunks, k, source_type, **extra)
            (
                found.withColumn("batch_id", F.lit(batch_id).cast("long"))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch_id")
                .parquet(path)
            )
        finally:
            kept.unpersist()

    return (
        queries.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
