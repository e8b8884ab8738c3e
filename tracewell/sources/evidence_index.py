"""An evidence index that grows while streams read it: segments, published one by one, and pinned snapshots.

A segment holds chunks and their counted features and appears with its commit record. A snapshot is the number of the
last record that counts; it names the same segments for ever. A stream pins the snapshot of every micro-batch by a
record of its own before it searches, so a batch that is repeated after a failure searches what it searched first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.operators.search import keyword_search
from tracewell.operators.terms import chunk_features
from tracewell.sources.commits import commit, new_generation, records


def add_segment(chunks: DataFrame, path: str, dims: int = 0) -> int:
    """Publish ``chunks`` as a further segment; returns its number. ``dims`` as in ``chunk_features``, 0 for terms only.

    Chunk ids must differ from those of the segments before.
    """
    spark, generation = chunks.sparkSession, new_generation()
    chunks.write.parquet(f"{path}/{generation}/chunks")
    kept = spark.read.schema(chunks.schema).parquet(f"{path}/{generation}/chunks")
    chunk_features(kept, dims).write.parquet(f"{path}/{generation}/features")
    return commit(spark, path, generation, {"dims": dims})


def snapshot(spark: SparkSession, path: str) -> int:
    """The number of the newest segment, -1 where there is none."""
    known = records(spark, path)
    return known[-1]["number"] if known else -1


def read_segments(spark: SparkSession, path: str, upto: int) -> tuple[DataFrame, DataFrame]:
    """(chunks, features) of the segments up to a snapshot."""
    names = [r["generation"] for r in records(spark, path) if r["number"] <= upto]
    if not names:
        raise ValueError(f"no segments up to {upto} in {path}")
    tables = ([spark.read.parquet(f"{path}/{n}/{kind}") for n in names] for kind in ("chunks", "features"))
    return tuple(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), some) for some in tables)


def pinned_snapshot(spark: SparkSession, path: str, pins: str, batch_id: int) -> int:
    """The snapshot of a micro-batch: the one pinned before, else the newest, which is pinned now."""
    for record in records(spark, pins):
        if record["batch"] == batch_id:
            return record["upto"]
    upto = snapshot(spark, path)
    commit(spark, pins, new_generation(), {"batch": batch_id, "upto": upto})
    return upto


def start_retrieve_growing(
    queries: DataFrame,
    index_path: str,
    path: str,
    checkpoint: str,
    k: int = 5,
    source_type: str | None = None,
    search: Callable[..., DataFrame] = keyword_search,
    **trigger,
) -> StreamingQuery:
    """Top-k evidence per arriving query against the segments that were published when its micro-batch began.

    Rows go to the partition of their batch id, which a repeated batch overwrites with the same rows; ``snapshot``
    says what they were searched in. Without a segment a batch has no rows. The pins lie beside the results.
    """
    pins = f"{path.rstrip('/')}-pins"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        upto = pinned_snapshot(spark, index_path, pins, batch_id)
        if upto < 0:
            return
        chunks, features = read_segments(spark, index_path, upto)
        kept = batch.persist()
        try:
            found = search(kept, chunks, k, source_type, index=features)
            found = found.withColumns({"batch_id": F.lit(batch_id).cast("long"), "snapshot": F.lit(upto).cast("long")})
            writer = found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("batch_id").parquet(path)
        finally:
            kept.unpersist()

    stream = queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"availableNow": True})).start()
