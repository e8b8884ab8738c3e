"""Keyed store of intent predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracewell.functions.text import canonical_order, lit_array, text_sha256
from tracewell.operators.validation import collect_violations
from tracewell.tables.intents import INTENT_SCHEMA_VERSION, SEMANTIC_TAGS

KEY = ["question_id", "model", "intent_schema_version", "input_hash"]
STORE_SCHEMA = (
    "question_id STRING, input_hash STRING, model STRING, intent_schema_version STRING, "
    "semantic_intent STRUCT<tags: ARRAY<STRING>>"
)


def prediction_key(df: DataFrame, text: str, model: str, version: str = INTENT_SCHEMA_VERSION) -> DataFrame:
    """Add the key columns of a question text under a model and schema version."""
    return df.withColumns(
        {
            "input_hash": text_sha256(F.col(text)),
            "model": F.lit(model),
            "intent_schema_version": F.lit(version),
        }
    )


def entries(df: DataFrame, tags: str) -> DataFrame:
    """Store rows from keyed predictions."""
    return df.select(*KEY, F.struct(canonical_order(F.col(tags), SEMANTIC_TAGS).alias("tags")).alias("semantic_intent"))


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """Latest row per key: rows of ``new`` replace stored ones."""
    both = store.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    latest = F.row_number().over(Window.partitionBy(*KEY).orderBy("_age"))
    return both.withColumn("_n", latest).filter("_n = 1").drop("_age", "_n")


def store_violations(store: DataFrame) -> DataFrame:
    """Add ``violations``: blank keys, a hash of the wrong length, unknown tags."""
    tags = F.col("semantic_intent.tags")
    tests = {f"{k} missing": F.coalesce(F.col(k), F.lit("")) == "" for k in KEY}
    tests["input_hash length"] = F.length("input_hash") != 64
    tests["tags missing"] = tags.isNull()
    tests["unknown tag"] = F.size(F.array_except(F.coalesce(tags, lit_array([])), lit_array(SEMANTIC_TAGS))) > 0
    return store.withColumn("violations", collect_violations(tests))


def read_store(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return store_violations(spark.read.schema(STORE_SCHEMA).format(fmt).load(path))


def write_store(store: DataFrame, path: str, fmt: str = "parquet") -> None:
    store.select(*KEY, "semantic_intent").write.mode("error").format(fmt).save(path)
