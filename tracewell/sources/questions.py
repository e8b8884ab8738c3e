"""Labelled inputs: retrieval questions, extraction cases, expected outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.functions.text import canonical_order, lit_array, strip
from tracewell.operators.validation import (
    RECORD_FIELDS,
    collect_violations,
    outside,
    record_violations,
    strict_rows,
)
from tracewell.tables.intents import RETRIEVAL_TAGS, SEMANTIC_TAGS
from tracewell.tables.summary import ENUM_FIELDS
from tracewell.tables.vocab import VOCAB

QUESTION_SCHEMA = (
    "question_id STRING, query STRING, expected_source_ids ARRAY<STRING>, "
    "forbidden_source_ids ARRAY<STRING>, rationale STRING, "
    "expected_semantic_intent_tags ARRAY<STRING>, expected_intent_tags ARRAY<STRING>"
)
CASE_SCHEMA = (
    "case_id STRING, concern_text STRING, reviewer_note STRING, "
    f"expected_review_summary STRUCT<{RECORD_FIELDS['review_summary'].replace(' ', ': ').replace(',: ', ', ')}>, "
    "expected_unresolved_field_names ARRAY<STRING>"
)


def question_violations(questions: DataFrame) -> DataFrame:
    """Add ``violations`` and put the tag lists in canonical order."""
    none = lit_array([])

    def blank(name: str):
        return F.coalesce(strip(F.col(name)), F.lit("")) == ""

    def unknown(name: str, vocabulary):
        return F.size(F.array_except(F.coalesce(name, none), lit_array(vocabulary))) > 0

    tests = {
        "question_id missing": blank("question_id"),
        "query missing": blank("query"),
        "expected_source_ids missing": F.size(F.coalesce("expected_source_ids", none)) == 0,
        "expected and forbidden overlap": F.arrays_overlap(
            F.coalesce("expected_source_ids", none), F.coalesce("forbidden_source_ids", none)
        ),
        "rationale blank": F.col("rationale").isNotNull() & blank("rationale"),
        "unknown semantic tag": unknown("expected_semantic_intent_tags", SEMANTIC_TAGS),
        "unknown intent tag": unknown("expected_intent_tags", RETRIEVAL_TAGS),
    }
    return questions.withColumn("violations", collect_violations(tests)).withColumns(
        {
            "forbidden_source_ids": F.coalesce("forbidden_source_ids", none),
            "expected_semantic_intent_tags": canonical_order(
                F.col("expected_semantic_intent_tags"), SEMANTIC_TAGS
            ),
            "expected_intent_tags": canonical_order(F.col("expected_intent_tags"), RETRIEVAL_TAGS),
        }
    )


def read_questions(spark: SparkSession, path: str, lines: bool = False, strict: bool = False) -> DataFrame:
    """Questions from a JSON list, or from JSON lines for large sets."""
    raw = spark.read.schema(QUESTION_SCHEMA).option("multiLine", not lines).json(path)
    checked = question_violations(raw)
    return strict_rows(checked, label="question_id") if strict else checked


def case_violations(cases: DataFrame) -> DataFrame:
    """Add ``violations`` to extraction cases."""
    summary = "expected_review_summary"
    tests = {
        f"{c} missing": F.col(c).isNull()
        for c in ("case_id", "concern_text", "reviewer_note", summary, "expected_unresolved_field_names")
    }
    for name in ENUM_FIELDS:
        tests[f"{name} invalid"] = outside(F.col(f"{summary}.{name}"), name)
    triggers = F.coalesce(F.col(f"{summary}.severe_triggers_observed"), lit_array([]))
    tests["severe_triggers_observed invalid"] = (
        F.size(F.array_except(triggers, lit_array(VOCAB["escalation_trigger"]))) > 0
    )
    return cases.withColumn("violations", collect_violations(tests))


def read_extraction_cases(spark: SparkSession, path: str, lines: bool = False, strict: bool = False) -> DataFrame:
    raw = spark.read.schema(CASE_SCHEMA).option("multiLine", not lines).json(path)
    checked = case_violations(raw)
    return strict_rows(checked, label="case_id") if strict else checked


def read_expected_outputs(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """One nested record per JSON file; the case id is the file name without its ending."""
    files = (
        spark.read.option("pathGlobFilter", "*.json")
        .text(path, wholetext=True)
        .select(
            F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("case_id"),
            F.col("value").alias("record_json"),
        )
    )
    checked = record_violations(files)
    return strict_rows(checked, label="case_id") if strict else checked
