"""Rules on short texts with results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from tracewell.functions.json_text import json_object_text, normalize_enum, normalize_list
from tracewell.operators import assessment, checklist, intents, summary, triage


def one(spark, fn, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells))
    return fn(df).first()[column]


@pytest.mark.parametrize(
    "text,reason,terms",
    [
        ("Is it in the package insert and in stock?", "external_drug_reference", ["package insert"]),
        ("It is out of stock, check the order page", "internal_record_access", ["order page", "out of stock"]),
        ("Please diagnose him", "clinical_or_legal_conclusion", ["diagnose"]),
        ("The dog refused it", None, []),
    ],
)
def test_refusal(spark, text, reason, terms):
    row = triage.refusal(spark.createDataFrame([(text,)], "concern_text string")).first()
    assert (row.refusal_reason, row.refusal_terms, row.refused) == (reason, terms, reason is not None)
    assert (row.refusal_message is not None) == row.refused


@pytest.mark.parametrize(
    "text,kind,lane",
    [
        ("Wrong medication and vomiting", "wrong_patient_or_wrong_medication", "life_threatening_or_legal"),
        ("vomited the chicken flavor", "flavor_related_vomiting", "unexpected_non_life_threatening"),
        ("threw up", "possible_adverse_drug_event", "unexpected_non_life_threatening"),
        ("spit out the pen cap", "pet_refused_flavor", "expected_self_limiting"),
        ("it just happened", "syringe_or_device_issue", "expected_self_limiting"),
        ("our budget", "bud_question", "expected_self_limiting"),
        ("a liquid", None, "expected_self_limiting"),
        ("hello", None, None),
    ],
)
def test_triage(spark, text, kind, lane):
    row = triage.triage(spark.createDataFrame([(text,)], "concern_text string")).first()
    assert (row.concern_type, row.risk_lane) == (kind, lane)


@pytest.mark.parametrize(
    "text,tags",
    [
        ("He was not hospitalized and no admitted pets", []),
        ("No er visit was needed in the whole long week that followed the dose but later he was admitted", ["pet_hospitalization"]),
        ("never   hospitalised. Admitted today", []),
        ("the pen happened", ["device_concern"]),
        ("it happened", []),
        ("a supplier", []),
        ("who is the supplier", ["supplier_question"]),
        ("who was told: manufacturer was notified", []),
        ("does not like it, tell me the full ingredient list", ["ingredient_question"]),
        ("does not like it", ["palatability_concern"]),
        ("syringe", []),
        ("how should the syringe be used", ["administration_question"]),
        ("vomited and weak", ["adverse_event", "gastrointestinal", "neurologic_signs"]),
        ("épen", []),
    ],
)
def test_semantic_intents(spark, text, tags):
    assert one(spark, intents.semantic_intents, "semantic_tags", concern_text=text) == tags


def test_derived_intents_and_search_text(spark):
    df = spark.createDataFrame([("pen leak", ["device_concern"]), ("hm", [])], "query string, semantic_tags array<string>")
    rows = {r.query: r for r in intents.expand_intent(intents.derived_intents(df)).collect()}
    assert rows["pen leak"].intent_tags == ["device_concern", "quality_review", "trend_review"]
    assert rows["pen leak"].search_text == (
        "pen leak\n\nRetrieval concepts: dispensing device pen function click mechanism quality review "
        "record review inventory inspection trend review pattern monitoring"
    )
    assert rows["hm"].search_text == "hm"


def test_deterministic_expansion_keeps_first_occurrences(spark):
    row = intents.expand_deterministic(spark.createDataFrame([(" Vomit and weakness, the BUD ",)], "query string")).first()
    assert row.issue_tags == ["adverse_event", "gastrointestinal", "neurologic_signs", "bud_question"]
    assert row.required_topics == ["adverse_event_review", "bud_guidance", "reference_boundary"]
    assert row.excluded_topics == ["routine_frontline_guidance"]
    assert row.search_text.startswith("Vomit and weakness, the BUD\n\nRetrieval concepts: gastrointestinal adverse event vomiting")


@pytest.mark.parametrize(
    "raw,status,tags,unknown",
    [
        ('{"tags": ["Device Concern", "adverse-event"]}', "ok", ["adverse_event", "device_concern"], []),
        ('```json\n{"tags": []}\n```', "ok", [], []),
        ('{"tags": ["x y", "a"]}', "unknown_tags", None, ["a", "x_y"]),
        ('{"tags": [], "more": 1}', "structured_output_failure", None, []),
        ("none", "structured_output_failure", None, []),
        (None, "model_error", None, []),
    ],
)
def test_model_intents(spark, raw, status, tags, unknown):
    row = intents.model_intents(spark.createDataFrame([(raw,)], "model_json string")).first()
    assert (row.model_status, row.model_tags, row.unknown_tags) == (status, tags, unknown)


def test_missing_information_drops_what_is_known(spark):
    df = spark.createDataFrame([("The dog vomited 20 minutes after 2 ml, lot A-123",)], "concern_text string")
    row = checklist.checklist_rules(df).first()
    assert row.missing_information == [
        "Medication or product placeholder", "Dosage form", "Whether any severe escalation trigger is present",
        "Whether symptoms resolved", "Whether veterinarian was contacted", "Whether the pet was hospitalized",
    ]
    assert row.triggers_to_rule_out[-1] == "repeat_issue_same_lot_or_batch_with_conditions"
    assert [c.check_name for c in row.review_checks][4:] == ["Customer clinical context follow-up"]


@pytest.mark.parametrize(
    "note,triggers",
    [
        ("The pet died.", []),
        ("The pet has died.", ["pet_death"]),
        ("No report that the pet has died.", []),
        ("Death was ruled out", []),
        ("He was hospitalized; a lawyer was not reported", ["pet_hospitalization", "threatened_legal_action"]),
        ("Not confirmed: mold was present", []),
        ("same lot with no similar issue was found", []),
        ("the state board was notified", ["rare_regulatory_or_compliance_concern"]),
    ],
)
def test_triggers(spark, note, triggers):
    got = one(spark, lambda d: summary.with_triggers(d, "reviewer_note", "t"), "t", reviewer_note=note)
    assert got == triggers


MODEL = json.dumps({
    "record_review_result": "No-Discrepancy Found", "lot_batch_pattern_summary": "unavailable",
    "inventory_inspection_result": "not_checked", "api_reference_review_result": "external_reference_needed",
    "customer_context_summary": "", "missing_information": "n/a", "evidence_limitations": ["a", "a", None],
    "severe_triggers_observed": ["pet death"],
})


def extract(spark, note, concern="", raw=MODEL, **options):
    df = spark.createDataFrame([(raw, concern, note)], "model_json string, concern_text string, reviewer_note string")
    return summary.extract_summary(df, **options).first()


def test_extraction_ignores_model_triggers_and_applies_defaults(spark):
    row = extract(spark, "Nothing off in the worksheet", "A question about dates")
    assert row.extraction_status == "ok" and row.severe_triggers_observed == []
    assert row.record_review_result == "not_applicable"
    assert row.evidence_limitations == ["a"] and row.customer_context_summary is None
    statuses = {e.field_name: e.status for e in row.field_evidence}
    assert statuses["record_review_result"] == "normalized" and statuses["missing_information"] == "not_stated"


def test_reference_needed_is_overwritten_unless_asked_otherwise(spark):
    note = "External reference needed."
    assert extract(spark, note).api_reference_review_result == "not_needed"
    assert extract(spark, note, fix_reference_needed=True).api_reference_review_result == "external_reference_needed"


def test_extraction_reports_and_asks(spark):
    row = extract(spark, "Inventory unavailable. Confirm storage temperature; dose is unknown", "The dog vomited and was hospitalized")
    assert row.severe_triggers_observed == ["pet_hospitalization"]
    assert row.inventory_inspection_result == "no_inventory_available"
    assert row.evidence_limitations == ["a", "Inventory was not available to inspect."]
    assert row.missing_information == ["Exact dose administered", "Storage and temperature conditions"]
    assert [q.field_name for q in row.unresolved_questions] == ["symptom_resolution", "veterinarian_contact", "dose_administered", "event_timing"]


@pytest.mark.parametrize("raw,status", [("no json", "unparsable"), ('{"x": 1}', "invalid"), (None, "unparsable"), (f"Answer: {MODEL}", "ok")])
def test_extraction_status(spark, raw, status):
    row = extract(spark, "n", raw=raw)
    assert row.extraction_status == status
    assert (row.record_review_result is None) == (status != "ok")


def test_json_helpers(spark):
    df = spark.createDataFrame([('pre ```json\n{"a": 1}\n``` post', "Not-Needed", '[" x ", "none", "x", "y"]')], "a string, b string, c string")
    row = df.select(
        json_object_text(F.col("a")).alias("a"), normalize_enum(F.col("b"), "api_reference_review_result").alias("b"), normalize_list(F.col("c")).alias("c")
    ).first()
    assert (row.a, row.b, row.c) == ('{"a": 1}', "not_needed", ["x", "y"])


@pytest.mark.parametrize(
    "kind,lane,triggers,category,path,listed",
    [
        ("wrong_patient_or_wrong_medication", None, [], "dispensing_error", "leadership_escalation_before_resolution", ["wrong_patient_or_wrong_medication"]),
        ("bud_question", "expected_self_limiting", ["pet_death"], "suspected_ADE", "leadership_escalation_before_resolution", ["pet_death"]),
        ("bud_question", "expected_self_limiting", [], None, "respond_to_frontline_pharmacist", []),
        (None, None, [], "suspected_ADE", "technical_services_customer_outreach", []),
        ("pet_refused_flavor", None, [], "medication_related", "technical_services_customer_outreach", []),
    ],
)
def test_decisions(spark, kind, lane, triggers, category, path, listed):
    df = spark.createDataFrame([("x", kind, lane, triggers)], "concern_text string, concern_type string, risk_lane string, severe_triggers_observed array<string>")
    d = assessment.final_assessment(df).first().derived_assessment
    assert (d.reviewer_assigned_category, d.handling_path, d.escalation_triggers) == (category, path, listed)


def test_blank_concerns_have_a_status(spark):
    from tracewell.operators.checklist import intake_checklist

    chunks = spark.createDataFrame(
        [("c", "s", "Title", "sop", "Device", "pen leak device")],
        "chunk_id string, source_id string, source_title string, source_type string, section_heading string, text string",
    )
    rows = [("1", "the pen is leaking"), ("2", " \n"), ("3", None)]
    concerns = spark.createDataFrame(rows, "case_id string, concern_text string")
    done = {r.case_id: r for r in intake_checklist(concerns, chunks, 2).collect()}
    assert {k: r.concern_status for k, r in done.items()} == {"1": "ok", "2": "blank", "3": "blank"}
    assert len(done["1"].evidence) == 1 and not done["2"].evidence and not done["3"].evidence
    with pytest.raises(ValueError, match="blank"):
        intake_checklist(concerns, chunks, 2, strict=True)


def test_top_k_is_refused_not_lowered():
    from tracewell.operators.ranking import check_top_k

    assert check_top_k(5, 20) == 5
    with pytest.raises(ValueError, match="at most"):
        check_top_k(21, 20)


def test_registered_text_functions_read_past_the_first_line(spark, tmp_path):
    from workload import rules  # noqa: F401
    from workload.registry import QUERIES as registered

    docs = [(1, "Same head\none tail", "s"), (2, "Same head\nother tail", "s"), (3, "same HEAD one-tail", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    term = {r.doc_id: r.term for r in registered["F3_F4_F10_text_functions"](spark, str(tmp_path)).collect()}
    assert term[1] != term[2] and term[1] == term[3]
