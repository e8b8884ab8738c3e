"""Commit records: what readers of a folder see is named by records, each of which appears as a whole.

Writers put their files into a folder of a new name and then write one record that names it, as a table of one
row; its file appears when Spark's commit moves it into place. Until then readers follow the earlier records,
so a writer that fails half-way leaves them as they were. One writer at a time; readers need no lock.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

RECORD = "number long, generation string, facts string"


def new_generation() -> str:
    return uuid.uuid4().hex


def records(spark: SparkSession, path: str) -> list[dict]:
    """All records in order, each with number, generation and its facts; none where nothing was committed."""
    try:
        rows = spark.read.schema(RECORD).json(f"{path}/commits/*").where("number is not null").orderBy("number").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    return [{"number": r.number, "generation": r.generation, **json.loads(r.facts)} for r in rows]


def commit(spark: SparkSession, path: str, generation: str, facts: dict) -> int:
    """Publish a generation whose files are complete; returns its number."""
    known = records(spark, path)
    number = known[-1]["number"] + 1 if known else 0
    row: DataFrame = spark.range(1).select(
        F.lit(number).cast("long").alias("number"), F.lit(generation).alias("generation"), F.lit(json.dumps(facts)).alias("facts")
    )
    row.coalesce(1).write.mode("error").json(f"{path}/commits/{number:012d}-{generation}")
    return number
