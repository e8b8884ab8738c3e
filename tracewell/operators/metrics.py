"""Retrieval, tag and field metrics as aggregates over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions.text import lit_array, safe_divide


def question_results(questions: DataFrame, sources: DataFrame, by: str = "question_id", keep: list[str] | None = None) -> DataFrame:
    """Join labels with the ordered distinct sources found for them.

    ``questions``: id, expected_source_ids, optional forbidden_source_ids.  A question without
    results stays, with an empty list.
    """
    keep = keep or []
    forbidden = (
        F.coalesce("forbidden_source_ids", lit_array([]))
        if "forbidden_source_ids" in questions.columns
        else lit_array([])
    )
    found = F.coalesce("retrieved_source_ids", lit_array([]))
    joined = questions.join(sources, by, "left").withColumn("retrieved_source_ids", found)
    hits = F.filter("retrieved_source_ids", lambda s: F.array_contains("expected_source_ids", s))
    position = F.array_position("retrieved_source_ids", F.get(hits, F.lit(0)))
    return (
        joined.withColumn("forbidden_source_ids", forbidden)
        .withColumn(
            "reciprocal_rank",
            F.when(F.size(hits) > 0, F.lit(1.0) / position).otherwise(F.lit(0.0)),
        )
        .withColumn("hit", F.col("reciprocal_rank") > 0)
        .withColumn(
            "forbidden_source_hits",
            F.filter("retrieved_source_ids", lambda s: F.array_contains("forbidden_source_ids", s)),
        )
        .withColumn("negative_constraints_passed", F.size("forbidden_source_hits") == 0)
        .select(
            by,
            *keep,
            "expected_source_ids",
            "forbidden_source_ids",
            "retrieved_source_ids",
            "hit",
            "reciprocal_rank",
            "forbidden_source_hits",
            "negative_constraints_passed",
        )
    )


def retrieval_metrics() -> list[Column]:
    """Aggregates over question results; usable under any grouping."""
    return [
        F.count(F.lit(1)).alias("total_questions"),
        F.avg(F.col("hit").cast("double")).alias("hit_rate_at_k"),
        F.avg("reciprocal_rank").alias("mean_reciprocal_rank"),
        F.avg(F.col("negative_constraints_passed").cast("double")).alias("negative_constraint_pass_rate"),
        F.count_if(~F.col("hit")).alias("failed_count"),
        F.count_if(~F.col("negative_constraints_passed")).alias("forbidden_hit_count"),
    ]


def failures(results: DataFrame, by: list[str]) -> DataFrame:
    """Failed ids as rows, one per question and kind; a list could outgrow one row."""
    kinds = F.array_compact(
        F.array(
            F.when(~F.col("hit"), F.lit("expected_source_missed")),
            F.when(~F.col("negative_constraints_passed"), F.lit("forbidden_source_hit")),
        )
    )
    return results.select(*by, F.explode(kinds).alias("failure"))


def failure_difference(results: DataFrame, first: str, second: str, name: str = "retriever", by: str = "question_id") -> DataFrame:
    """Ids failed by ``first`` but not ``second``, and the other way round."""
    failed = results.filter(~F.col("hit")).select(name, by)
    a = failed.filter(F.col(name) == first).select(by)
    b = failed.filter(F.col(name) == second).select(by)
    return a.join(b, by, "left_anti").withColumn("failed_only_by", F.lit(first)).unionByName(
        b.join(a, by, "left_anti").withColumn("failed_only_by", F.lit(second))
    )


def best_by(summary: DataFrame, metric: str, name: str = "retriever") -> DataFrame:
    """Names with the best value of ``metric``; ties are kept."""
    top = summary.agg(F.max(metric).alias("_best"))
    return (
        summary.join(F.broadcast(top), F.col(metric) == F.col("_best"))
        .select(F.lit(metric).alias("metric"), name, F.col(metric).alias("value"))
    )


def tag_metrics(rows: DataFrame, by: list[str], predicted: str, expected: str, prefix: str) -> DataFrame:
    """Micro precision, recall and exact-match rate over rows with expectations and a prediction.

    A zero denominator gives 0; no scored row at all gives null.
    """
    scored = (F.size(F.coalesce(expected, lit_array([]))) > 0) & F.col(predicted).isNotNull()
    p, e = F.array_distinct(predicted), F.array_distinct(expected)
    tp = F.sum(F.when(scored, F.size(F.array_intersect(p, e))))
    exact = (F.size(F.array_except(p, e)) == 0) & (F.size(F.array_except(e, p)) == 0)
    n = F.count_if(scored)
    return rows.groupBy(*by).agg(
        F.when(n > 0, safe_divide(tp, F.sum(F.when(scored, F.size(p))))).alias(f"{prefix}_micro_precision"),
        F.when(n > 0, safe_divide(tp, F.sum(F.when(scored, F.size(e))))).alias(f"{prefix}_micro_recall"),
        F.avg(F.when(scored, exact.cast("double"))).alias(f"{prefix}_exact_match_rate"),
    )


def per_tag_metrics(rows: DataFrame, by: list[str], predicted: str, expected: str) -> DataFrame:
    """tp, predicted, expected, precision and recall per tag; tags never seen do not appear.

    Tags are exploded once with a predicted and an expected marker, so one aggregate replaces a
    full outer join.
    """
    scored = rows.filter(
        (F.size(F.coalesce(expected, lit_array([]))) > 0) & F.col(predicted).isNotNull()
    )
    tag = F.explode(F.array_union(predicted, expected)).alias("tag")
    marked = scored.select(*by, predicted, expected, tag).select(
        *by,
        "tag",
        F.array_contains(predicted, F.col("tag")).alias("_p"),
        F.array_contains(expected, F.col("tag")).alias("_e"),
    )
    return (
        marked.groupBy(*by, "tag")
        .agg(
            F.count_if(F.col("_p") & F.col("_e")).alias("true_positive"),
            F.count_if("_p").alias("predicted"),
            F.count_if("_e").alias("expected"),
        )
        .withColumn("precision", safe_divide(F.col("true_positive"), F.col("predicted")))
        .withColumn("recall", safe_divide(F.col("true_positive"), F.col("expected")))
    )


def set_comparison(expected: Column, actual: Column) -> dict[str, Column]:
    """Precision, recall, false positives and false negatives of two sets."""
    e = F.array_distinct(F.coalesce(expected, lit_array([])))
    a = F.array_distinct(F.coalesce(actual, lit_array([])))
    tp = F.size(F.array_intersect(e, a)).cast("double")
    return {
        "precision": F.when(F.size(a) > 0, tp / F.size(a))
        .when(F.size(e) == 0, F.lit(1.0))
        .otherwise(F.lit(0.0)),
        "recall": F.when(F.size(e) > 0, tp / F.size(e)).otherwise(F.lit(1.0)),
        "false_positives": F.array_sort(F.array_except(a, e)),
        "false_negatives": F.array_sort(F.array_except(e, a)),
    }


def run_counters() -> list[Column]:
    """Model and store counters over built queries with the columns of ``resolve_predictions``."""
    return [
        F.count_if("model_called").alias("model_call_count"),
        F.count_if("store_hit").alias("store_hit_count"),
        F.count_if("model_called").alias("store_miss_count"),
        F.count_if("used_fallback").alias("fallback_count"),
        F.count_if(F.col("prediction_status").isin("structured_output_failure", "unknown_tags")).alias(
            "structured_output_failure_count"
        ),
        F.count_if(F.col("prediction_status") == "model_error").alias("model_error_count"),
        F.sum(F.size(F.coalesce("unknown_tags", lit_array([])))).alias("unknown_tag_count"),
        F.sum(F.size(F.coalesce("unmapped_tags", lit_array([])))).alias("unmapped_tag_count"),
    ]


def split_overlap(development: DataFrame, holdout: DataFrame, by: str = "question_id") -> DataFrame:
    """Ids that occur in both splits; must be empty."""
    return development.select(by).join(holdout.select(by), by, "left_semi")


def unknown_sources(questions: DataFrame, sources: DataFrame, by: str = "question_id") -> DataFrame:
    """Labelled source ids that no chunk carries."""
    labelled = questions.select(
        by,
        F.explode(F.array_union("expected_source_ids", F.coalesce("forbidden_source_ids", lit_array([])))).alias(
            "source_id"
        ),
    )
    return labelled.join(sources.select("source_id").distinct(), "source_id", "left_anti")
