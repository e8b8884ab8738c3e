"""Ground reviewer notes in structured findings.

Row-local: every rule is a regex or substring test over columns of the same row.  Each regex is
evaluated once into a boolean column before the decision chains read it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions.json_text import json_object_text, normalize_enum, normalize_list
from tracewell.functions.text import any_of, lit_array, rx, sentences, strip
from tracewell.tables import summary as t
from tracewell.tables.vocab import VOCAB

ENUMS = t.ENUM_FIELDS
SUMMARY_FIELDS = [*ENUMS[:3], "customer_context_summary", ENUMS[3], *t.LIST_FIELDS]


def _note(name: str, col: str = "_note") -> Column:
    return rx(F.col(col), t.NOTE_PATTERNS[name])


# ---------------------------------------------------------------- escalation triggers


def affirmed_triggers(parts: Column | str) -> Column:
    """Sorted triggers that some sentence of ``parts`` names, does not negate and affirms.

    ``parts`` is a column of sentences.  Only the first occurrence of a term is inspected; a
    negation anywhere in the preceding 90 characters, or a coordinated one earlier in the
    sentence, negates it.
    """
    table = F.array(
        *[
            F.struct(F.lit(name).alias("name"), lit_array(words).alias("terms"))
            for name, words in t.TRIGGER_TERMS.items()
        ]
    )

    def negated(trigger: Column, low: Column, term: Column) -> Column:
        at = F.position(term, low)
        prefix = F.substring(low, F.lit(1), at - 1)
        near = F.substring(
            low, F.greatest(at - t.NEGATION_PREFIX_WINDOW, F.lit(1)),
            F.least(at - 1, F.lit(t.NEGATION_PREFIX_WINDOW)),
        )
        after = F.substring(low, at, F.length(term) + t.NEGATION_SUFFIX_WINDOW)
        repeat = trigger["name"] == "repeat_issue_same_lot_or_batch_with_conditions"
        return (at > 0) & (
            rx(after, t.NOTE_PATTERNS["ruled_out_after"])
            | (repeat & rx(after, t.NOTE_PATTERNS["repeat_negated_after"]))
            | rx(near, t.NOTE_PATTERNS["negation"])
            | rx(prefix, t.NOTE_PATTERNS["coordinated_negation"])
        )

    def affirmed(trigger: Column, sentence: Column) -> Column:
        low = F.lower(sentence)
        return (
            F.exists(trigger["terms"], lambda w: F.contains(low, w))
            & rx(sentence, t.NOTE_PATTERNS["affirmation"])
            & ~F.exists(trigger["terms"], lambda w: negated(trigger, low, w))
        )

    return F.array_sort(
        F.transform(
            F.filter(table, lambda tr: F.exists(parts, lambda s: affirmed(tr, s))),
            lambda tr: tr["name"],
        )
    )


def with_triggers(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add array ``out`` of affirmed triggers of ``text``.

    One substring pass over all trigger terms first drops the sentences that cannot matter.
    """
    every = [w for words in t.TRIGGER_TERMS.values() for w in words]
    named = F.filter(sentences(F.col(text)), lambda s: any_of(F.lower(s), every))
    return (
        df.withColumn("_parts", named)
        .withColumn(out, F.when(F.size("_parts") > 0, affirmed_triggers("_parts")).otherwise(lit_array([])))
        .drop("_parts")
    )


def merge_reported_triggers(observed: Column, reported: Column) -> Column:
    """Sorted union of triggers from the note and from the concern."""
    return F.array_sort(F.array_union(observed, reported))


# ---------------------------------------------------------------- field grounding


def ground_record(current: Column) -> Column:
    return (
        F.when(_note("record_not_applicable"), "not_applicable")
        .when(_note("record_incomplete"), "documentation_incomplete")
        .when(
            _note("record_discrepancy") & ~_note("record_discrepancy_cleared"),
            "documentation_discrepancy_found",
        )
        .when(_note("record_no_discrepancy"), "no_discrepancy_found")
        .otherwise(current)
    )


def ground_lot(current: Column) -> Column:
    return (
        F.when(_note("lot_not_applicable"), "not_applicable")
        .when(_note("lot_trend_threshold"), "trend_threshold_met")
        .when(_note("lot_no_similar"), "no_similar_batch_concerns_found")
        .when(_note("lot_same_batch"), "similar_concern_same_batch_found")
        .when(_note("lot_same_product"), "similar_concern_same_medication_dosage_form_found")
        .when(_note("lot_unavailable"), "unavailable")
        .otherwise(current)
    )


def ground_inventory(current: Column) -> Column:
    return (
        F.when(F.col("_inv_na"), "not_applicable")
        .when(F.col("_inv_none"), "no_inventory_available")
        .when(F.col("_inv_unchecked"), "not_checked")
        .when(_note("inventory_no_visual"), "no_visual_concern_found")
        .when(_note("inventory_visual"), "visual_concern_found")
        .otherwise(current)
    )


def ground_reference(fix_reference_needed: bool = False) -> Column:
    """Reference result from the note alone; the supplied value never survives.

    A note that asks for an external reference reads as ``not_needed``; set
    ``fix_reference_needed`` to report ``external_reference_needed`` instead.
    """
    chain = (
        F.when(F.col("_ref_unsupported"), "not_supported_by_public_corpus")
        .when(_note("reference_consulted"), "external_reference_consulted")
        .when(_note("reference_synthetic"), "synthetic_reference_consulted")
        .when(_note("reference_not_needed"), "not_needed")
    )
    if fix_reference_needed:
        chain = chain.when(_note("reference_needed"), "external_reference_needed")
    return chain.otherwise("not_needed")


def missing_item(sentence: Column) -> Column:
    """Canonical item for one sentence that says something is missing."""
    low = F.lower(sentence)
    rest = sentence
    for lead in t.MISSING_LEAD_PATTERNS:
        rest = F.regexp_replace(rest, "(?diU)" + lead, "")
    item = F.nullif(F.btrim(rest, F.lit(" .")), F.lit(""))
    for alternatives, name in reversed(t.MISSING_ITEM_RULES):
        hit = reduce(or_, (reduce(and_, (any_of(low, words) for words in needed)) for needed in alternatives))
        if name == t.VETERINARIAN_ITEM:
            hit = hit | rx(low, t.NOTE_PATTERNS["vet_word"])
        item = F.when(hit, F.lit(name)).otherwise(item)
    return item


def ground_missing() -> Column:
    """Ordered distinct missing items stated in ``_note`` (sentences in ``_sentences``)."""
    stated = F.filter("_sentences", lambda s: rx(s, t.NOTE_PATTERNS["missing_sentence"]))
    head = F.array(
        F.when(_note("dose_missing"), F.lit("Exact dose administered")),
        F.when(_note("dispense_missing"), F.lit("Whether medication dispensed from the device")),
    )
    return F.array_distinct(F.array_compact(F.concat(head, F.transform(stated, missing_item))))


def _append(values: Column, condition: Column, item: str) -> Column:
    return F.when(condition, F.array_union(values, F.array(F.lit(item)))).otherwise(values)


def ground_summary(df: DataFrame, note: str = "reviewer_note", fix_reference_needed: bool = False) -> DataFrame:
    """Override the summary columns with what the note supports."""
    base = (
        df.withColumn("_note", strip(F.col(note)))
        .withColumn("_sentences", sentences(F.col("_note")))
        .withColumns(
            {
                "_inv_na": _note("inventory_not_applicable"),
                "_inv_none": _note("inventory_unavailable"),
                "_inv_unchecked": _note("inventory_not_checked"),
                "_ref_unsupported": _note("reference_non_disclosure") | _note("reference_unsupported"),
            }
        )
    )
    none = ~F.col("_inv_na") & F.col("_inv_none")
    unchecked = ~F.col("_inv_na") & ~F.col("_inv_none") & F.col("_inv_unchecked")
    limits = F.array_distinct(F.coalesce(F.col("evidence_limitations"), lit_array([])))
    limits = _append(limits, none, t.LIMIT_NO_INVENTORY)
    limits = _append(limits, unchecked, t.LIMIT_NOT_INSPECTED)
    limits = _append(limits, F.col("_ref_unsupported"), t.LIMIT_UNSUPPORTED_REFERENCE)
    grounded = with_triggers(base, "_note", "severe_triggers_observed").withColumns(
        {
            "record_review_result": ground_record(F.col("record_review_result")),
            "lot_batch_pattern_summary": ground_lot(F.col("lot_batch_pattern_summary")),
            "inventory_inspection_result": ground_inventory(F.col("inventory_inspection_result")),
            "api_reference_review_result": ground_reference(fix_reference_needed),
            "missing_information": ground_missing(),
            "evidence_limitations": limits,
        }
    )
    return grounded.drop("_note", "_sentences", "_inv_na", "_inv_none", "_inv_unchecked", "_ref_unsupported")


# ---------------------------------------------------------------- scope and defaults


def review_scope(df: DataFrame, concern: str = "concern_text", note: str = "reviewer_note", out: str = "summary_scope") -> DataFrame:
    """Add full_investigation or guidance_only."""
    p = t.SCOPE_PATTERNS
    noted = [rx(strip(F.col(note)), p[n]) for n in ("record_result", "lot_result", "inventory_result")]
    told = [
        rx(strip(F.col(concern)), p[n])
        for n in (
            "clinical_event", "product_quality", "device_failure", "effectiveness_failure",
            "formulation_reaction",
        )
    ]
    full = F.lit(False)
    for test in noted + told:
        full = full | test
    return df.withColumn(out, F.when(full, "full_investigation").otherwise("guidance_only"))


def scope_defaults(df: DataFrame, concern: str = "concern_text", note: str = "reviewer_note") -> DataFrame:
    """Fill the four result fields where the note does not document them."""
    p = {name: rx(strip(F.col(note)), pattern) for name, pattern in t.SCOPE_PATTERNS.items()}
    full = F.col("_scope") == "full_investigation"

    def by_scope(if_full: str) -> Column:
        return F.when(full, if_full).otherwise("not_applicable")

    return (
        review_scope(df, concern, note, "_scope")
        .withColumns(
            {
                "record_review_result": F.when(
                    ~p["record_result"], by_scope("documentation_incomplete")
                ).otherwise(F.col("record_review_result")),
                "lot_batch_pattern_summary": F.when(p["same_batch"], "similar_concern_same_batch_found")
                .when(p["no_similar_lot"], "no_similar_batch_concerns_found")
                .when(~p["lot_result"], by_scope("unavailable"))
                .otherwise(F.col("lot_batch_pattern_summary")),
                "inventory_inspection_result": F.when(
                    ~p["inventory_result"], by_scope("not_checked")
                ).otherwise(F.col("inventory_inspection_result")),
                "api_reference_review_result": F.when(~p["reference_result"], "not_needed").otherwise(
                    F.col("api_reference_review_result")
                ),
            }
        )
        .drop("_scope")
    )


# ---------------------------------------------------------------- evidence per field


def first_sentence(parts: Column | str, terms) -> Column:
    """Earliest sentence that contains any term."""
    return F.get(F.filter(parts, lambda s: any_of(F.lower(s), terms)), F.lit(0))


def field_evidence(df: DataFrame, concern: str = "concern_text", note: str = "reviewer_note", out: str = "field_evidence") -> DataFrame:
    """Add an array of (field_name, status, supporting_quote, explanation) for the eight fields."""
    base = df.withColumns(
        {
            "_sentences": sentences(strip(F.col(note))),
            "_concern_sentences": sentences(F.coalesce(F.col(concern), F.lit(""))),
        }
    )
    quotes = {}
    for field, terms in t.FIELD_SUPPORT_TERMS.items():
        quote = first_sentence("_sentences", terms)
        if field == "severe_triggers_observed":
            quote = F.coalesce(quote, first_sentence("_concern_sentences", terms))
        quotes[f"_quote_{field}"] = quote
    statuses = {}
    for field in t.FIELD_SUPPORT_TERMS:
        quote = F.col(f"_quote_{field}")
        status = F.when(quote.isNull(), "not_stated").when(
            rx(quote, t.NOTE_PATTERNS["ambiguity"]), "ambiguous"
        )
        if field in t.ENUM_FIELDS:
            status = status.otherwise("normalized")
        elif field in t.LIST_FIELDS:
            empty = F.size(F.coalesce(F.col(field), lit_array([]))) == 0
            status = status.when(empty, "not_stated").otherwise("explicit")
        else:
            status = status.otherwise("explicit")
        statuses[f"_status_{field}"] = status
    rows = []
    for field in t.FIELD_SUPPORT_TERMS:
        status = F.col(f"_status_{field}")
        words = F.create_map(
            *[F.lit(x) for s, e in t.EVIDENCE_EXPLANATIONS.items() for x in (s, e.format(field=field))]
        )
        rows.append(
            F.struct(
                F.lit(field).alias("field_name"),
                status.alias("status"),
                F.col(f"_quote_{field}").alias("supporting_quote"),
                words[status].alias("explanation"),
            )
        )
    return (
        base.withColumns(quotes)
        .withColumns(statuses)
        .withColumn(out, F.array(*rows))
        .drop("_sentences", "_concern_sentences", *quotes, *statuses)
    )


# ---------------------------------------------------------------- open questions


def device_failure_context(text: Column) -> Column:
    p = t.QUESTION_PATTERNS
    return rx(text, p["device_direct"]) | F.exists(
        F.split(text, r"[.;\n]+"), lambda s: rx(s, p["device_object"]) & rx(s, p["device_signal"])
    )


def unresolved_questions(df: DataFrame, concern: str = "concern_text", note: str = "reviewer_note", out: str = "unresolved_questions") -> DataFrame:
    """Add the array of decision-relevant questions that concern, note and summary leave open."""
    p = t.QUESTION_PATTERNS
    c, n = F.col("_concern"), F.col("_note")
    base = df.withColumns(
        {
            "_concern": F.lower(strip(F.coalesce(F.col(concern), F.lit("")))),
            "_note": strip(F.coalesce(F.col(note), F.lit(""))),
            "_both": strip(F.concat_ws("\n", F.coalesce(F.col(concern), F.lit("")), F.coalesce(F.col(note), F.lit("")))),
        }
    )
    both = F.col("_both")
    vomiting = any_of(c, t.QUESTION_TERMS["vomiting"])
    ruled_out = rx(n, p["ruled_out"])
    no_trigger = F.size(F.coalesce(F.col("severe_triggers_observed"), lit_array([]))) == 0
    medication_cleared = (rx(n, p["wrong_medication"]) & ruled_out) | rx(n, p["correct_medication"])
    conditions = {
        "hospitalization_status": vomiting & ~rx(both, p["hospitalization"]),
        "symptom_resolution": vomiting & ~rx(both, p["resolution"]),
        "veterinarian_contact": vomiting & ~rx(both, p["vet_contact"]),
        "dose_administered": vomiting & ~rx(both, p["administered_dose"]),
        "event_timing": vomiting & ~rx(both, p["timing"]),
        "wrong_medication_status": rx(c, p["wrong_medication"]) & ~medication_cleared & no_trigger,
        "contamination_status": rx(c, p["contamination"])
        & ~(rx(n, p["contamination"]) & ruled_out)
        & no_trigger,
        "device_dispense_status": device_failure_context(c)
        & (rx(both, p["dispense_unresolved"]) | ~rx(both, p["dispense_documented"])),
        "bud_date_context": any_of(c, t.QUESTION_TERMS["bud"]) & ~rx(both, p["calendar_date"]),
        "lot_batch_context": any_of(c, ["lot", "batch"])
        & (F.col("lot_batch_pattern_summary") == "unavailable"),
    }
    rows = [
        F.when(
            conditions[field],
            F.struct(
                F.lit(field).alias("field_name"),
                F.lit(question).alias("question"),
                F.lit(reason).alias("reason"),
                lit_array(impact).alias("decision_impact"),
            ),
        )
        for field, (question, reason, impact) in t.OPEN_QUESTIONS.items()
    ]
    return base.withColumn(out, F.array_compact(F.array(*rows))).drop("_concern", "_note", "_both")


# ---------------------------------------------------------------- whole extraction


def parse_summary(df: DataFrame, raw: str = "model_json") -> DataFrame:
    """Parse supplied model JSON into the summary columns and ``extraction_status``.

    Status: ``ok``, ``unparsable`` (no JSON object) or ``invalid`` (does not fit the record).
    """
    body = F.col("_body")
    columns = {}
    for name in ENUMS:
        columns[name] = normalize_enum(F.get_json_object(body, f"$.{name}"), name)
    columns["customer_context_summary"] = F.nullif(
        F.get_json_object(body, "$.customer_context_summary"), F.lit("")
    )
    for name in t.LIST_FIELDS:
        items = normalize_list(F.get_json_object(body, f"$.{name}"))
        if name == "severe_triggers_observed":
            items = F.transform(items, lambda x: normalize_enum(x, "escalation_trigger"))
        columns[name] = items
    wrong = F.size(F.array_except(F.json_object_keys(body), lit_array(SUMMARY_FIELDS))) > 0
    for name in ENUMS:
        wrong = wrong | ~F.coalesce(F.col(name).isin(*VOCAB[name]), F.lit(False))
    wrong = wrong | (
        F.size(F.array_except("severe_triggers_observed", lit_array(VOCAB["escalation_trigger"]))) > 0
    )
    status = F.when(body.isNull(), "unparsable").when(wrong, "invalid").otherwise("ok")
    return (
        df.withColumn("_body", json_object_text(F.col(raw)))
        .withColumns(columns)
        .withColumn("extraction_status", status)
        .drop("_body")
    )


def extract_summary(
    df: DataFrame,
    raw: str = "model_json",
    concern: str = "concern_text",
    note: str = "reviewer_note",
    fix_reference_needed: bool = False,
) -> DataFrame:
    """Summary, field evidence and open questions per case from supplied model JSON and the note.

    Rows whose JSON cannot be used keep their status and get null results.
    """
    parsed = parse_summary(df, raw)
    grounded = ground_summary(parsed, note, fix_reference_needed)
    reported = with_triggers(grounded, concern, "_reported").withColumn(
        "severe_triggers_observed",
        merge_reported_triggers(F.col("severe_triggers_observed"), F.col("_reported")),
    )
    done = scope_defaults(reported.drop("_reported"), concern, note)
    done = unresolved_questions(field_evidence(done, concern, note), concern, note)
    ok = F.col("extraction_status") == "ok"
    results = [*SUMMARY_FIELDS, "field_evidence", "unresolved_questions"]
    return done.withColumns({c: F.when(ok, F.col(c)) for c in results})
