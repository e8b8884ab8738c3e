"""Supplied intake records: parse, validate, and turn facts into checklist inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracewell.operators.checklist import checklist_rules
from tracewell.operators.validation import (
    RECORD_FIELDS,
    collect_violations,
    intake_tests,
    outside,
    record_schema,
    unknown_fields,
)
from tracewell.tables.vocab import VOCAB
from tracewell.tables.triage import REFUSAL_MESSAGES
from tracewell.operators.triage import text_map
from tracewell.functions.text import lit_array

EXTRA_FIELDS = (
    "possible_boundary_issue STRING, boundary_supporting_phrase STRING, "
    "extracted_customer_context STRING, facts_present ARRAY<STRING>, facts_missing ARRAY<STRING>"
)
TOP_KEYS = ["raw_intake", "product_context", *[f.strip().split(" ")[0] for f in EXTRA_FIELDS.split(",")]]


def intake_records(df: DataFrame, raw: str = "intake_json") -> DataFrame:
    """Add intake, intake_status and boundary_message.

    Status: ``ok``; ``stopped`` where the record names a boundary issue; ``rules_only`` where the
    JSON is missing or invalid, so that only the text rules apply.
    """
    sections = ["raw_intake", "product_context"]
    assert set(sections) <= set(RECORD_FIELDS)
    schema = record_schema(sections) + ", " + EXTRA_FIELDS
    parsed = df.withColumn("intake", F.from_json(F.col(raw), schema))
    keys = F.json_object_keys(F.col(raw))
    tests = {
        "not a record": keys.isNull(),
        "missing raw_intake": F.col("intake.raw_intake").isNull(),
        "missing product_context": F.col("intake.product_context").isNull(),
        "unknown field": F.size(F.array_except(keys, lit_array(TOP_KEYS))) > 0,
        "boundary issue invalid": ~F.col("intake.possible_boundary_issue").isin(*VOCAB["refusal_reason"]),
        "intake_source invalid": outside(F.col("intake.raw_intake.intake_source"), "intake_source"),
        "submitter_role invalid": outside(F.col("intake.raw_intake.submitter_role"), "submitter_role"),
        "submission_purpose invalid": outside(
            F.col("intake.raw_intake.submission_purpose"), "submission_purpose"
        ),
        "species invalid": outside(F.col("intake.product_context.species"), "species", False),
        "dosage_form invalid": outside(F.col("intake.product_context.dosage_form"), "dosage_form", False),
        **intake_tests("intake."),
    }
    inner = unknown_fields(F.col(raw), sections)
    inner.pop("unknown section")
    issue = F.col("intake.possible_boundary_issue")
    return (
        parsed.withColumn("intake_violations", collect_violations(tests | inner))
        .withColumn(
            "intake_status",
            F.when(F.size("intake_violations") > 0, "rules_only")
            .when(issue.isNotNull(), "stopped")
            .otherwise("ok"),
        )
        .withColumn(
            "boundary_message",
            F.when(F.col("intake_status") == "stopped", text_map(REFUSAL_MESSAGES)[issue]),
        )
    )


def intake_facts(records: DataFrame) -> DataFrame:
    """Add facts_text and the known_* flags that refine the missing items."""
    ok = F.col("intake_status") == "ok"
    product = "intake.product_context"
    return records.withColumns(
        {
            "facts_text": F.when(
                ok,
                F.concat_ws(
                    " ",
                    F.array_join(F.coalesce("intake.facts_present", lit_array([])), " "),
                    F.coalesce("intake.extracted_customer_context", F.lit("")),
                ),
            ).otherwise(""),
            "known_species": ok & (F.coalesce(f"{product}.species", F.lit("unknown")) != "unknown"),
            "known_dosage_form": ok & (F.coalesce(f"{product}.dosage_form", F.lit("unknown")) != "unknown"),
            "known_flavor": ok & F.col(f"{product}.flavor_or_attribute").isNotNull(),
        }
    )


def intake_checklist_rules(df: DataFrame, raw: str = "intake_json", text: str = "concern_text") -> DataFrame:
    """Checklist columns from the text and the supplied facts; stopped rows are left out."""
    facts = intake_facts(intake_records(df, raw))
    return checklist_rules(facts.filter(F.col("intake_status") != "stopped"), text, facts=True)
