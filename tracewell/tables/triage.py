"""Lexicons, fact patterns and texts of the first-pass triage rules."""

# Refusal lexicons, in priority order.
REFUSAL_TERMS: dict[str, list[str]] = {
    "external_drug_reference": [
        "plumb", "plumb's", "plumbs", "drug handbook", "package insert", "external reference",
        "published adverse effects", "exact adverse effects", "contraindications",
        "drug interactions", "species-specific toxicity", "toxicity", "dose range",
        "therapeutic dose",
    ],
    "internal_record_access": [
        "real compounding record", "actual compounding record", "order page", "customer history",
        "customer record", "patient record", "look up the order", "check the real record",
        "inventory record", "real inventory", "inventory system", "inventory systems",
        "stock status", "stock availability", "in stock", "back in stock", "out of stock",
        "available to order", "order it again", "when this medication will be back in stock",
    ],
    "clinical_or_legal_conclusion": [
        "is this medication safe", "did this medication cause", "is chewy liable",
        "legal advice", "clinical diagnosis", "diagnose", "caused the death",
    ],
}

# Fixed values.
REFUSAL_MESSAGES: dict[str, str] = {
    "external_drug_reference": (
        "I can’t safely answer that from the synthetic SOP evidence available here. This proof of "
        "concept does not include Plumb’s, a package insert, or another validated drug reference, so "
        "I should not make medication-specific claims about adverse effects, contraindications, "
        "interactions, dosing ranges, or species-specific toxicity. A pharmacist should verify that "
        "information against an appropriate external drug reference before making a recommendation."
    ),
    "internal_record_access": (
        "I can’t verify that from the information available in this proof of concept. This system "
        "does not have access to real compounding records, order pages, customer history, patient "
        "records, or inventory systems. A pharmacist or reviewer should check the appropriate "
        "internal record and document what they confirm."
    ),
    "clinical_or_legal_conclusion": (
        "I can’t make that determination from this review-support workflow alone. The available "
        "evidence does not support a final clinical, causality, or legal conclusion. This should be "
        "reviewed by a pharmacist or the appropriate responsible professional before any final "
        "decision is made."
    ),
}

# Substring lexicons of the concern rules.
CONCERN_TERMS: dict[str, list[str]] = {
    "vomiting": ["vomit", "vomited", "vomiting", "threw up", "throwing up"],
    "flavor": ["flavor", "flavored", "chicken", "beef", "tuna", "palatability", "refuse", "refused"],
    "transdermal": ["transdermal", "pen", "click", "clicks", "leak", "leaking", "air bubbles"],
    "bud": ["bud", "beyond use", "beyond-use", "expiration", "expired"],
    "wrong_medication": ["wrong medication", "wrong patient", "wrong med", "dispensing error"],
    "oral_liquid": ["oral liquid", "compounded liquid", "liquid", "suspension", "solution"],
    "rejection": [
        "foamed", "foaming", "foamed at the mouth", "drooled", "drooling", "salivating",
        "hypersalivation", "spit out", "spat out", "refused", "wouldn't take",
    ],
    "species": ["dog", "canine", "cat", "feline", "horse", "equine"],
    "dosage_form": [
        "oral liquid", "oral suspension", "oral solution", "suspension", "solution", "capsule",
        "tablet", "transdermal", "chewable", "powder", "ophthalmic", "oral paste", "topical",
        "cream", "gel", "ointment",
    ],
    "severe": [
        "died", "death", "hospitalized", "hospitalization", "legal", "lawsuit", "lawyer",
        "vet said", "veterinarian said", "contamination", "contaminated", "wrong medication",
        "wrong patient", "seizure", "seizures", "collapsed", "collapse", "trouble breathing",
        "difficulty breathing", "could not breathe", "unresponsive",
    ],
}

# Facts a text may already state (matched without regard to case).
FACT_PATTERNS: dict[str, str] = {
    "dose": r"\b\d+(?:\.\d+)?\s*(?:ml|milliliters?|mg|milligrams?|mcg|micrograms?|units?|tablets?|capsules?|clicks?)\b",
    "timing": r"\b(?:about\s+)?\d+\s*(?:minutes?|mins?|hours?|hrs?)\b|\b(?:immediately|right after|shortly after|later)\b",
    "resolution": r"\b(?:seems? okay|seems? ok|fine now|okay now|ok now|recovered|resolved|doing well|back to normal|still vomiting|continued vomiting|ongoing symptoms?)\b",
    "veterinarian": r"\b(?:vet|veterinarian|animal hospital|emergency clinic)\b",
    "hospitalization": r"\b(?:hospitalized|hospitalised|hospitalization|hospitalisation|admitted|no er visit|er visit|emergency hospital|not hospitalized|not hospitalised)\b",
    "lot_identifier": r"\b(?:lot|batch)\s*(?:number|no\.?|#)?\s*[a-z0-9-]{3,}\b",
}

# Phrases added to the retrieval query of each concern type.
CONCERN_QUERY_TERMS: dict[str, list[str]] = {
    "flavor_related_vomiting": [
        "suspected adverse event", "vomiting after administration", "customer clinical context",
        "hospitalization", "veterinarian", "escalation"],
    "possible_adverse_drug_event": [
        "suspected adverse event", "customer clinical context", "hospitalization", "veterinarian",
        "escalation"],
    "syringe_or_device_issue": [
        "device administration", "dispense", "clicks", "leaking", "air bubbles"],
    "bud_question": [
        "beyond use date", "preparation date", "dispense date", "storage conditions"],
    "wrong_patient_or_wrong_medication": [
        "wrong patient", "wrong medication", "dispensing error", "escalation"],
}

# Phrases that raise a chunk's score for each concern type.
CONCERN_RERANK_TERMS: dict[str, list[str]] = {
    "flavor_related_vomiting": [
        "vomit", "adverse event", "clinical context", "hospital", "veterinarian"],
    "possible_adverse_drug_event": [
        "adverse event", "clinical context", "hospital", "veterinarian"],
    "syringe_or_device_issue": ["device", "transdermal", "click", "leak", "dispense"],
    "bud_question": ["beyond-use", "beyond use", "bud", "preparation date", "storage"],
    "wrong_patient_or_wrong_medication": [
        "wrong patient", "wrong medication", "dispensing error"],
}
RERANK_BONUS = 3.0

# Review checks as (condition lexicon or None, key, name, rationale, citations shown).
REVIEW_CHECKS: list[tuple[str | None, str, str, str, int]] = [
    (None, "record_review", "Record review",
     "Verify the synthetic compounding or dispensing record fields relevant to the concern.", 2),
    (None, "lot_batch_review", "Lot or batch context review",
     "Look for similar concerns tied to the same lot, batch, medication, dosage form, or concern "
     "type when those fields are available.", 2),
    (None, "inventory_inspection", "Inventory inspection if available",
     "Inspect available inventory when the concern could involve visible product quality, device, "
     "equipment, or packaging issues.", 2),
    (None, "trend_scan", "Trend scan",
     "Check for repeated similar concerns when enough synthetic fields exist to support trend "
     "review.", 2),
    ("vomiting", "customer_context_follow_up", "Customer clinical context follow-up",
     "Vomiting after administration requires timing, dose, symptom course, veterinarian contact, "
     "and severity context before final routing.", 3),
    ("transdermal", "device_administration_context", "Device administration context",
     "Transdermal device concerns require details on clicks, leaking, air bubbles, and whether "
     "medication could be administered.", 3),
    ("bud", "bud_field_review", "BUD field review",
     "BUD questions require preparation date, assigned BUD, review or dispense date, and relevant "
     "storage context.", 3),
]

# Missing-information items as (condition lexicon or None, item, fact that answers it).
MISSING_ITEMS: list[tuple[str | None, str, str | None]] = [
    (None, "Medication or product placeholder", None),
    (None, "Species", "species"),
    (None, "Dosage form", "dosage_form"),
    (None, "Lot or batch information if available", "lot_identifier"),
    (None, "Whether any severe escalation trigger is present", None),
    ("vomiting", "Dose administered", "dose"),
    ("vomiting", "Timing of vomiting relative to administration", "timing"),
    ("vomiting", "Whether symptoms resolved", "resolution"),
    ("vomiting", "Whether veterinarian was contacted", "veterinarian"),
    ("vomiting", "Whether the pet was hospitalized", "hospitalization"),
    ("transdermal", "Whether the device leaked from the top or bottom", None),
    ("transdermal", "Whether air bubbles were observed", "air_bubble"),
    ("transdermal", "Whether the device dispensed after expected clicks", None),
    ("transdermal", "Whether the customer has enough usable medication remaining", None),
    ("bud", "Preparation date", None),
    ("bud", "Assigned beyond-use date", None),
    ("bud", "Dispense or review date", None),
    ("bud", "Storage conditions if relevant", None),
    ("rejection", "Flavor or base if available", "flavor"),
    ("rejection", "Whether the pet swallowed the dose or spit it out", "swallowed"),
    ("rejection", "Whether this was the first dose or a repeat dose", None),
    ("rejection", "Whether the pet previously tolerated this medication or flavor", "flavor"),
    ("rejection", "Whether symptoms resolved without further issue", "resolution"),
]
AIR_BUBBLE_TERMS = ["air bubble"]
SWALLOWED_TERMS = ["swallowed", "spit it out", "spat it out"]

# Fixed values.
TRIGGERS_TO_RULE_OUT = [
    "pet_death", "pet_hospitalization", "threatened_legal_action",
    "veterinarian_alleges_harm_from_compound", "possible_contamination",
    "wrong_patient_or_wrong_medication",
]
LOT_TRIGGER_TERMS = ["lot", "batch"]
LOT_TRIGGER = "repeat_issue_same_lot_or_batch_with_conditions"

# Fixed values.
LIMITATIONS = [
    "This synthetic assistant does not access real compounding records, inventory, customer "
    "history, or external drug references.",
    "Phase 1 output is a review checklist, not a final clinical or legal conclusion.",
    "Causality should not be inferred from the intake narrative alone.",
]
