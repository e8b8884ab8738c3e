"""Intent detection, tag policy and query rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions.json_text import fenced_json
from tracewell.functions.text import (
    any_of,
    canonical_order,
    lit_array,
    normalize_space,
    normalize_term,
    ordered_distinct,
    phrase_match,
    rx,
    rx_any,
    strip,
)
from tracewell.operators.triage import list_map
from tracewell.tables import intents as t


def affirmed_hospitalization(text: Column) -> Column:
    """A hospital mention whose preceding text does not negate it.

    The look-behind captures up to 48 characters before every mention without consuming them, so
    each mention gets its own full prefix.  The look-ahead keeps it from running anywhere else.
    """
    w = t.HOSPITALIZATION_WINDOW
    before = F.regexp_extract_all(
        text,
        F.lit(rf"(?dU)(?={t.HOSPITALIZATION})(?<=(^.{{0,{w - 1}}}|.{{{w}}})){t.HOSPITALIZATION}"),
        F.lit(1),
    )
    return F.exists(before, lambda p: ~rx(p, t.HOSPITALIZATION_NEGATION, ignore_case=False))


def semantic_intents(
    df: DataFrame, text: str = "concern_text", out: str = "semantic_tags", patterns: dict[str, list[str]] | None = None
) -> DataFrame:
    """Add the array of detected semantic tags in canonical order.

    Every pattern family is one combined regex, evaluated once into a boolean column.  ``patterns``
    replaces families by name.
    """
    base = df.withColumn("_text", normalize_space(F.col(text)))
    families = {**t.INTENT_PATTERNS, **(patterns or {})}
    flags = {f"_rx_{name}": rx_any(F.col("_text"), listed) for name, listed in families.items()}
    flags["_rx_asks"] = phrase_match(F.col("_text"), t.INFORMATION_REQUEST_PHRASES)
    flags["_rx_ingredient_phrase"] = phrase_match(F.col("_text"), t.INGREDIENT_PHRASES)
    flags["_rx_hospital"] = affirmed_hospitalization(F.col("_text"))
    base = base.withColumns(flags)

    def f(name: str) -> Column:
        return F.col(f"_rx_{name}")

    ingredient = f("ingredient") & (f("asks") | f("ingredient_phrase"))
    detected = {
        "adverse_event": f("gastrointestinal") | f("neurologic") | f("respiratory"),
        "pet_hospitalization": f("hospital"),
        "gastrointestinal": f("gastrointestinal"),
        "neurologic_signs": f("neurologic"),
        "respiratory_context": f("respiratory"),
        "ingredient_question": ingredient,
        "supplier_question": f("supplier") & f("asks") & ~f("manufacturer_reporting"),
        "bud_question": f("bud"),
        "device_concern": f("device"),
        "efficacy_concern": f("efficacy"),
        "appearance_concern": f("appearance"),
        "storage_concern": f("storage"),
        "administration_question": f("administration_technique")
        | (f("administration_topic") & f("question_request")),
        "quantity_discrepancy": f("quantity"),
        "palatability_concern": f("palatability") & ~ingredient,
        "transdermal_site_concern": f("transdermal"),
    }
    tags = F.array_compact(F.array(*[F.when(detected[tag], F.lit(tag)) for tag in t.SEMANTIC_TAGS]))
    return base.withColumn(out, tags).drop("_text", *flags)


def derived_intents(
    df: DataFrame, tags: str = "semantic_tags", out: str = "intent_tags", policy: dict[str, list[str]] | None = None
) -> DataFrame:
    """Add the semantic tags plus the workflow tags the policy implies, in canonical order."""
    implied = F.flatten(
        F.transform(tags, lambda x: F.coalesce(list_map(policy or t.TAG_POLICY)[x], lit_array([])))
    )
    return df.withColumn(out, canonical_order(F.concat(F.col(tags), implied), t.RETRIEVAL_TAGS))


def tag_search_terms(tags: Column) -> Column:
    """Ordered distinct search phrases of an array of tags."""
    return F.array_distinct(
        F.flatten(
            F.transform(tags, lambda x: F.coalesce(list_map(t.TAG_SEARCH_TERMS)[x], lit_array([])))
        )
    )


def unmapped_tags(tags: Column) -> Column:
    """Tags without search phrases."""
    return F.array_except(tags, lit_array(list(t.TAG_SEARCH_TERMS)))


def _with_concepts(text: Column, terms: Column) -> Column:
    return F.when(
        F.size(terms) > 0,
        F.concat(text, F.lit("\n\nRetrieval concepts: "), F.array_join(terms, " ")),
    ).otherwise(text)


def expand_raw(df: DataFrame, text: str = "query") -> DataFrame:
    """Add ``search_text``: the trimmed query."""
    return df.withColumn("search_text", strip(F.col(text)))


def expand_deterministic(df: DataFrame, text: str = "query", groups=None) -> DataFrame:
    """Add ``search_text`` and the tag lists of all expansion groups whose trigger occurs."""
    groups = groups or t.EXPANSION_GROUPS
    base = df.withColumn("_trim", strip(F.col(text))).withColumn("_low", F.lower("_trim"))
    flags = {}
    for i, group in enumerate(groups):
        hit = any_of(F.col("_low"), group["when"])
        if group.get("when_pattern"):
            hit = hit | rx_any(F.col("_low"), group["when_pattern"])
        flags[f"_hit_{i}"] = hit

    def gathered(part: str) -> Column:
        lists = [
            F.when(F.col(f"_hit_{i}"), lit_array(g[part])).otherwise(lit_array([]))
            for i, g in enumerate(groups)
        ]
        return ordered_distinct(*lists)

    return (
        base.withColumns(flags)
        .withColumns(
            {
                "_terms": gathered("terms"),
                "issue_tags": gathered("tags"),
                "required_topics": gathered("required"),
                "excluded_topics": gathered("excluded"),
            }
        )
        .withColumn("search_text", _with_concepts(F.col("_trim"), F.col("_terms")))
        .drop("_trim", "_low", "_terms", *flags)
    )


def expand_intent(df: DataFrame, text: str = "query", tags: str = "intent_tags") -> DataFrame:
    """Add ``search_text``: the query followed by the phrases of its intent tags."""
    return (
        df.withColumn("_terms", tag_search_terms(F.col(tags)))
        .withColumn("search_text", _with_concepts(strip(F.col(text)), F.col("_terms")))
        .drop("_terms")
    )


def model_intents(df: DataFrame, raw: str = "model_json") -> DataFrame:
    """Parse supplied model output into model_tags, unknown_tags and model_status.

    Status is ``ok``, ``model_error`` (no output), ``structured_output_failure`` (not exactly one
    list under ``tags``) or ``unknown_tags``; only ``ok`` rows carry tags.
    """
    body = fenced_json(F.col(raw), leading_only=True)
    one_key = F.json_object_keys("_body") == lit_array(["tags"])
    is_list = F.substring(F.ltrim(F.get_json_object("_body", "$.tags")), 1, 1) == "["
    parsed = F.from_json("_body", "tags array<string>")["tags"]
    normal = F.transform(parsed, lambda x: normalize_term(F.coalesce(x, F.lit("none"))))
    return (
        df.withColumn("_body", body)
        .withColumn("_tags", F.when(one_key & is_list, normal))
        .withColumn("unknown_tags", F.array_sort(F.array_except("_tags", lit_array(t.SEMANTIC_TAGS))))
        .withColumn(
            "model_status",
            F.when(F.col(raw).isNull(), "model_error")
            .when(F.col("_tags").isNull(), "structured_output_failure")
            .when(F.size("unknown_tags") > 0, "unknown_tags")
            .otherwise("ok"),
        )
        .withColumn(
            "model_tags",
            F.when(F.col("model_status") == "ok", canonical_order(F.col("_tags"), t.SEMANTIC_TAGS)),
        )
        .withColumn("unknown_tags", F.coalesce("unknown_tags", lit_array([])))
        .drop("_body", "_tags")
    )
