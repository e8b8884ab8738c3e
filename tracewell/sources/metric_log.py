"""Metrics of runs that come in parts: additive states per part, merged under any grouping.

A part's results are read once, when its state is written: counts and sums per group, and its failed questions in
order. Whatever is asked later adds up states; a new part reads no older results. A part that is written again
replaces its state, and readers see it as soon as its commit record appears.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.operators.metrics import failures
from tracewell.sources.commits import commit, new_generation, records

SUMS = ["questions", "hits", "reciprocal_ranks", "passes"]


def retrieval_state(results: DataFrame, by: list[str]) -> DataFrame:
    """One row per group of question results: ``by`` and the sums that retrieval metrics are made of."""
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if("hit").alias("hits"),
        F.coalesce(F.sum("reciprocal_rank"), F.lit(0.0)).alias("reciprocal_ranks"),
        F.count_if("negative_constraints_passed").alias("passes"),
    )


def merged(states: DataFrame, by: list[str]) -> DataFrame:
    """States of coarser groups; merging in any order gives the same sums."""
    return states.groupBy(*by).agg(*(F.sum(c).alias(c) for c in SUMS))


def metrics_of(states: DataFrame) -> DataFrame:
    """The columns of ``metrics.retrieval_metrics`` from states; rates of no questions are null."""
    n = F.when(F.col("questions") > 0, F.col("questions"))
    rest = [c for c in states.columns if c not in SUMS]
    return states.select(
        *rest,
        F.col("questions").alias("total_questions"),
        (F.col("hits") / n).alias("hit_rate_at_k"),
        (F.col("reciprocal_ranks") / n).alias("mean_reciprocal_rank"),
        (F.col("passes") / n).alias("negative_constraint_pass_rate"),
        (F.col("questions") - F.col("hits")).alias("failed_count"),
        (F.col("questions") - F.col("passes")).alias("forbidden_hit_count"),
    )


def put_part(results: DataFrame, path: str, part: str, by: list[str], key: str = "question_id") -> int:
    """Store the state of one part: its sums by the groups ``by``, and its failures sorted by ``key``."""
    spark, generation = results.sparkSession, new_generation()
    retrieval_state(results, by).write.parquet(f"{path}/{generation}/sums")
    failed = failures(results, [*by, key])
    failed.repartitionByRange(key).sortWithinPartitions(key, "failure").write.parquet(f"{path}/{generation}/failures")
    return commit(spark, path, generation, {"part": part})


def read_parts(spark: SparkSession, path: str, table: str = "sums") -> DataFrame:
    """The rows of all parts, each as last written, with the column part; ``table`` is sums or failures."""
    if table not in ("sums", "failures"):
        raise ValueError("table must be sums or failures")
    last = {r["part"]: r["generation"] for r in records(spark, path)}
    if not last:
        raise ValueError(f"no parts in {path}")
    parts = [spark.read.parquet(f"{path}/{g}/{table}").withColumn("part", F.lit(p)) for p, g in sorted(last.items())]
    return reduce(DataFrame.unionByName, parts)
