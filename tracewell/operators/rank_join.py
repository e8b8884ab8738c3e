"""Rank join of two ordered lists per query: the best weighted sums without looking at every chunk twice.

One pass over the chunk features gives, per query, the ``n`` chunks with the best keyword scores and the ``n`` with the
best vector scores, each with both scores; the heads of the lists are the normalisers. A chunk in neither list has at
most the last score of each, so its sum is at most the threshold made of the two last scores. Where the k-th sum
among the listed chunks is above the threshold, the listed ones hold the answer; a list shorter than ``n`` ends with
zero. The other queries are named, and only they need another look at the chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tracewell.operators.ranking import share_of_max, top_k

# Rows of each list, per query and result asked for.
LIST_ROWS = 16


def list_length(k: int) -> int:
    return LIST_ROWS * max(k, 4)


def joined_ranks(lists: DataFrame, k: int, n: int, weights: tuple[float, float]) -> tuple[DataFrame, DataFrame]:
    """(best, asked): the k best listed chunks per query, and one row per query with its normalisers.

    ``lists`` holds query_id, list (0 keyword, 1 vector), chunk_id, score (the one that the list is ordered by),
    keyword_score, vector_score and matched_terms, at least the n best of each list. ``asked`` has query_id,
    best_keyword, best_vector and certain: no chunk outside the lists can be among the k best.
    """
    order = Window.partitionBy("query_id", "list").orderBy(F.col("score").desc(), "chunk_id")
    lists = lists.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)

    def of(number: int, value, aggregate):
        return aggregate(F.when(F.col("list") == number, value))

    heads = lists.groupBy("query_id").agg(
        *(F.coalesce(of(i, F.col("score"), F.max), F.lit(0.0)).alias(name) for i, name in enumerate(["best_keyword", "best_vector"])),
        *(
            F.coalesce(of(i, F.when(F.col("place") == n, F.col("score")), F.max), F.lit(0.0)).alias(name)
            for i, name in enumerate(["last_keyword", "last_vector"])
        ),
    )

    def combined(keyword: str, vector: str):
        first = F.lit(weights[0]) * share_of_max(F.col(keyword), F.col("best_keyword"))
        return first + F.lit(weights[1]) * share_of_max(F.col(vector), F.col("best_vector"))

    once = lists.groupBy("query_id", "chunk_id").agg(
        *(F.first(c).alias(c) for c in ("keyword_score", "vector_score", "matched_terms"))
    )
    summed = once.join(heads, "query_id").withColumn("score", combined("keyword_score", "vector_score"))
    best = top_k(summed, k)
    kth = best.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("found"))
    whole = (F.col("last_keyword") == 0) & (F.col("last_vector") == 0)
    above = (F.col("found") == k) & (F.col("least") > combined("last_keyword", "last_vector"))
    asked = heads.join(kth, "query_id").select("query_id", "best_keyword", "best_vector", (whole | above).alias("certain"))
    columns = ["query_id", "chunk_id", "score", "matched_terms", "keyword_score", "vector_score"]
    return best.select(*columns), asked
