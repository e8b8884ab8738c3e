"""Final assessment: product context, final lane and the decision table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions.text import any_of, lit_array
from tracewell.tables import assessment as t


def _first_rule(low: Column, rules) -> Column:
    chain = None
    for value, words in rules:
        hit = any_of(low, words)
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def product_context(df: DataFrame, text: str = "concern_text") -> DataFrame:
    """Add species, dosage_form and flavor_or_attribute."""
    low = F.lower(F.col(text))
    return df.withColumns(
        {
            "species": _first_rule(low, t.SPECIES_RULES).otherwise("unknown"),
            "dosage_form": _first_rule(low, t.DOSAGE_FORM_RULES).otherwise("unknown"),
            "flavor_or_attribute": _first_rule(low, [(f, [f]) for f in t.FLAVOR_RULES]),
        }
    )


def has_trigger() -> Column:
    return F.size(F.coalesce(F.col("severe_triggers_observed"), lit_array([]))) > 0


def final_risk_lane(df: DataFrame) -> DataFrame:
    """Add ``final_risk_lane`` from triggers, concern type and the first-pass lane."""
    return df.withColumn(
        "final_risk_lane",
        F.when(has_trigger(), "life_threatening_or_legal")
        .when(F.col("concern_type").isin(*t.ADVERSE_TYPES), "unexpected_non_life_threatening")
        .otherwise(F.coalesce("risk_lane", F.lit("expected_self_limiting"))),
    )


def _decisions() -> Column:
    """The decision table as a literal map, so the lookup needs no join."""
    entries = []
    for key, d in t.DECISIONS.items():
        entries += [
            F.lit(key),
            F.struct(
                F.lit(d["classification"]).alias("classification"),
                F.lit(d["category"]).cast("string").alias("category"),
                F.lit(d["subcategory"]).cast("string").alias("subcategory"),
                F.lit(d["review_scope"]).alias("review_scope"),
                F.lit(d["handling_path"]).alias("handling_path"),
                F.lit(d["resolution_review_required"]).alias("resolution_review_required"),
                lit_array(d["resolution_options"]).alias("resolution_options"),
                F.lit(d["rationale"]).alias("rationale"),
            ),
        ]
    return F.create_map(*entries)


def decide(df: DataFrame) -> DataFrame:
    """Add the struct ``derived_assessment``.

    Needs concern_type, risk_lane and severe_triggers_observed.  Wrong medication is decided
    first, then the severe lane, then the concern type.
    """
    kind = F.coalesce("concern_type", F.lit("possible_adverse_drug_event"))
    decision = (
        F.when(F.col("_kind") == "wrong_patient_or_wrong_medication", "wrong_medication")
        .when(F.col("final_risk_lane") == "life_threatening_or_legal", "severe")
        .when(F.col("_kind").isin(*t.ADVERSE_TYPES), "adverse_event")
        .when(F.col("_kind") == "syringe_or_device_issue", "device")
        .when(F.col("_kind") == "bud_question", "bud")
        .otherwise("routine")
    )
    row = F.col("_row")
    triggers = F.coalesce(F.col("severe_triggers_observed"), lit_array([]))
    wrong = F.col("_decision") == "wrong_medication"
    severe = F.col("_decision") == "severe"
    flavor_event = (F.col("_decision") == "adverse_event") & (F.col("_kind") == "flavor_related_vomiting")
    return (
        final_risk_lane(df)
        .withColumn("_kind", kind)
        .withColumn("_decision", decision)
        .withColumn("_row", _decisions()[F.col("_decision")])
        .withColumn(
            "derived_assessment",
            F.struct(
                row["classification"].alias("reviewer_assigned_classification"),
                row["category"].alias("reviewer_assigned_category"),
                F.when(flavor_event, "flavor_related_ADE")
                .otherwise(row["subcategory"])
                .alias("reviewer_assigned_subcategory"),
                F.col("_kind").alias("concern_type"),
                F.when(wrong, "life_threatening_or_legal")
                .otherwise(F.col("final_risk_lane"))
                .alias("risk_lane"),
                row["review_scope"].alias("review_scope"),
                F.when(wrong & (F.size(triggers) == 0), lit_array(["wrong_patient_or_wrong_medication"]))
                .when(wrong | severe, triggers)
                .otherwise(lit_array([]))
                .alias("escalation_triggers"),
                row["handling_path"].alias("handling_path"),
                row["resolution_review_required"].alias("resolution_review_required"),
                row["resolution_options"].alias("resolution_options"),
                row["rationale"].alias("rationale"),
            ),
        )
        .drop("_kind", "_decision", "_row")
    )


def final_assessment(checklists: DataFrame, summaries: DataFrame | None = None, text: str = "concern_text") -> DataFrame:
    """Assessment record per case: checklist rows joined to their review summaries.

    Pass one table that already carries both to skip the join.
    """
    joined = checklists if summaries is None else checklists.join(summaries, "case_id")
    decided = decide(joined).drop("species", "dosage_form", "flavor_or_attribute")
    context = product_context(decided, text)
    unknown = F.lit(None).cast("boolean")
    return context.withColumns(
        {
            "raw_intake": F.struct(
                F.lit("qre_general_question_form").alias("intake_source"),
                F.lit("unknown").alias("submitter_role"),
                F.lit("customer_reported_concern").alias("submission_purpose"),
                F.col(text).alias("concern_narrative"),
                F.lit(None).cast("int").alias("star_rating"),
                unknown.alias("review_text_present"),
                F.lit(None).cast("string").alias("submitter_selected_classification"),
            ),
            "product_context": F.struct(
                "species",
                "dosage_form",
                F.lit(None).cast("string").alias("product_placeholder"),
                "flavor_or_attribute",
                unknown.alias("bud_present"),
                unknown.alias("batch_lot_present"),
            ),
            "investigation_requirements": F.struct(
                F.lit(True).alias("record_review_required"),
                F.lit(True).alias("lot_batch_review_required"),
                unknown.alias("inventory_inspection_required"),
                unknown.alias("trend_scan_required"),
                unknown.alias("customer_outreach_required"),
                unknown.alias("frontline_guidance_lookup_required"),
                unknown.alias("technical_services_response_required"),
            ),
        }
    ).drop("species", "dosage_form", "flavor_or_attribute")
