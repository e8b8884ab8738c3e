"""Chunk tables: JSONL with row checks, Parquet, and the stored term index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.functions.text import lit_array, strip
from tracewell.operators.terms import chunk_features
from tracewell.operators.validation import CHUNK_COLUMNS, collect_violations, strict_rows

CHUNK_SCHEMA = ", ".join(f"{c} {'BOOLEAN' if c == 'synthetic' else 'STRING'}" for c in CHUNK_COLUMNS)


def write_chunks(chunks: DataFrame, path: str, fmt: str = "json", mode: str = "error") -> None:
    """Write the chunk columns as JSONL or Parquet."""
    chunks.select(*CHUNK_COLUMNS).write.mode(mode).format(fmt).option("ignoreNullFields", False).save(path)


def parse_chunk_lines(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Chunks from JSON lines (column ``value``) with ``violations``; blank lines are skipped.

    Other columns of ``lines`` are kept.
    """
    parsed = lines.filter(strip(F.col("value")) != "").withColumn("_row", F.from_json("value", CHUNK_SCHEMA))
    keys = F.json_object_keys("value")
    missing = F.array_sort(F.array_except(lit_array(CHUNK_COLUMNS), keys))
    flag = F.get_json_object("value", "$.synthetic")
    tests = {
        "not a JSON object": keys.isNull(),
        "synthetic must be boolean": keys.isNotNull()
        & F.array_contains(keys, "synthetic")
        & (flag.isNull() | F.col("_row.synthetic").isNull()),
    }
    listed = F.when(
        F.size(missing) > 0, F.array(F.concat(F.lit("missing keys: "), F.array_join(missing, ", ")))
    ).otherwise(lit_array([]))
    chunks = parsed.withColumn(
        "violations", F.concat(collect_violations(tests), F.coalesce(listed, lit_array([])))
    ).select(
        *[c for c in lines.columns if c != "value"],
        *[F.col(f"_row.{c}").alias(c) for c in CHUNK_COLUMNS],
        "violations",
    )
    return strict_rows(chunks) if strict else chunks


def read_chunks(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Chunks of a JSONL file or folder with row checks."""
    return parse_chunk_lines(spark.read.text(path), strict)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Raise where ``df`` is empty."""
    if not df.limit(1).count():
        raise ValueError(f"no {what} found")
    return df


def write_term_index(chunks: DataFrame, path: str, mode: str = "error", dims: int = 0) -> None:
    """Store the features of each chunk, one row per chunk, so that later searches skip tokenizing.

    The folder is partitioned by source type, so a search of one type reads its part only.  With
    ``dims`` the hashed vectors are stored too, for vector and hybrid search.
    """
    features = chunk_features(chunks, dims)
    writer = features.write.mode(mode)
    (writer.partitionBy("source_type") if "source_type" in features.columns else writer).parquet(path)


def read_term_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
