"""Ranking windows and score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def check_top_k(k: int, most: int | None = None) -> int:
    """``k``, which must be at least 1 and at most ``most``."""
    if k < 1:
        raise ValueError("top_k must be at least 1")
    if most is not None and k > most:
        raise ValueError(f"top_k must be at most {most}")
    return k


def top_k(df: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """Best ``k`` rows per group: score descending, then ``tie`` ascending, with 1-based ``rank``.

    Written as row_number <= k, which is planned as a per-partition limit before the shuffle.
    """
    check_top_k(k)
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hybrid_weights(keyword: float = 0.65, vector: float = 0.35) -> tuple[float, float]:
    """Check both weights and scale them to a sum of one."""
    if keyword < 0 or vector < 0:
        raise ValueError("hybrid weights must be non-negative")
    if keyword == 0 and vector == 0:
        raise ValueError("at least one hybrid weight must be greater than zero")
    return keyword / (keyword + vector), vector / (keyword + vector)


def share_of_max(value: Column, top: Column) -> Column:
    """Score relative to the best one, 0 where the best is not positive."""
    return F.when(top > 0, value / top).otherwise(F.lit(0.0))


def ranked_sources(results: DataFrame, by: str = "query_id") -> DataFrame:
    """Ordered distinct source ids per query: (by, retrieved_source_ids).

    A group holds at most k result rows, so the collected array is bounded by k.
    """
    ordered = F.array_sort(F.collect_list(F.struct("rank", "source_id")))
    return results.groupBy(by).agg(
        F.array_distinct(F.transform(ordered, lambda r: r["source_id"])).alias("retrieved_source_ids")
    )


def source_ranks(results: DataFrame, by: str = "query_id") -> DataFrame:
    """Long form of the same: one row per query and source with its 1-based source_rank."""
    first = results.groupBy(by, "source_id").agg(F.min("rank").alias("_first"))
    return first.select(
        by,
        "source_id",
        F.row_number().over(Window.partitionBy(by).orderBy("_first")).alias("source_rank"),
    )
