"""Decision table of the final assessment."""

# First match by substring gives the product context.
DOSAGE_FORM_RULES = [("transdermal", ["transdermal", "pen"]), ("oral_liquid", ["liquid", "oral"])]
SPECIES_RULES = [("dog", ["dog"]), ("cat", ["cat"])]
FLAVOR_RULES = ["chicken", "beef", "tuna", "flavor", "flavored"]

ADVERSE_TYPES = ["flavor_related_vomiting", "possible_adverse_drug_event"]

# Outcome per decision.
DECISIONS: dict[str, dict] = {
    "wrong_medication": {
        "classification": "QRE", "category": "dispensing_error", "subcategory": "wrong_medication",
        "review_scope": "escalation_review",
        "handling_path": "leadership_escalation_before_resolution",
        "resolution_review_required": True,
        "resolution_options": ["leadership_directed_resolution", "counseling_or_follow_up"],
        "rationale": (
            "Possible wrong patient or wrong medication concerns are treated conservatively and "
            "require escalation before routine resolution."),
    },
    "severe": {
        "classification": "QRE", "category": "suspected_ADE", "subcategory": "suspected_ADE",
        "review_scope": "escalation_review",
        "handling_path": "leadership_escalation_before_resolution",
        "resolution_review_required": True,
        "resolution_options": ["leadership_directed_resolution"],
        "rationale": (
            "A structured severe escalation trigger was supplied by the reviewer, so the case "
            "requires escalation before routine resolution."),
    },
    "adverse_event": {
        "classification": "QRE", "category": "suspected_ADE", "subcategory": "suspected_ADE",
        "review_scope": "full_quality_review",
        "handling_path": "technical_services_customer_outreach",
        "resolution_review_required": True,
        "resolution_options": ["counseling_or_follow_up", "alternate_dosage_form_discussion"],
        "rationale": (
            "Vomiting after administration is treated as a suspected adverse event. No structured "
            "severe escalation trigger was supplied, so the review-support path is follow-up rather "
            "than automatic leadership escalation."),
    },
    "device": {
        "classification": "QRE", "category": "equipment_device_related",
        "subcategory": "defective_device", "review_scope": "full_quality_review",
        "handling_path": "technical_services_customer_outreach",
        "resolution_review_required": True,
        "resolution_options": ["replacement_or_reship_review", "counseling_or_follow_up"],
        "rationale": (
            "A possible device or administration equipment issue supports quality review, customer "
            "follow-up, and possible replacement or reship review when no severe trigger is "
            "present."),
    },
    "bud": {
        "classification": "general_question", "category": None, "subcategory": None,
        "review_scope": "guidance_only", "handling_path": "respond_to_frontline_pharmacist",
        "resolution_review_required": False,
        "resolution_options": [],
        "rationale": (
            "A BUD clarification without a structured severe trigger, reported harm, defect, "
            "contamination, or dispensing error is handled as a guidance question requiring "
            "record-specific date fields."),
    },
    "routine": {
        "classification": "QRE", "category": "medication_related", "subcategory": "flavor",
        "review_scope": "full_quality_review",
        "handling_path": "technical_services_customer_outreach",
        "resolution_review_required": True,
        "resolution_options": ["counseling_or_follow_up", "alternate_dosage_form_discussion"],
        "rationale": (
            "Routine flavor or palatability concerns without structured severe triggers support "
            "guidance, counseling, and possible alternate dosage form discussion after standard "
            "review checks."),
    },
}

# Paths compared by default.
COMPARED_PATHS = [
    "derived_assessment.reviewer_assigned_classification",
    "derived_assessment.reviewer_assigned_category",
    "derived_assessment.reviewer_assigned_subcategory",
    "derived_assessment.concern_type",
    "derived_assessment.risk_lane",
    "derived_assessment.review_scope",
    "derived_assessment.handling_path",
    "derived_assessment.escalation_triggers",
    "derived_assessment.resolution_review_required",
    "derived_assessment.resolution_options",
]
