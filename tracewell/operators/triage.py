"""First-pass triage of concern texts: refusal, concern type, risk lane, retrieval query.

All operators are row-local column arithmetic: no join, no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions.text import any_of, lit_array, strip, which_of
from tracewell.tables import triage as t


def text_map(entries: dict[str, str]) -> Column:
    """Literal map of strings."""
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def list_map(entries: dict[str, list[str]]) -> Column:
    """Literal map from a string to an array of strings."""
    return F.create_map(
        *[c for key, values in entries.items() for c in (F.lit(key), lit_array(values))]
    )


def refusal(df: DataFrame, text: str = "concern_text", terms=None, messages=None) -> DataFrame:
    """Add refused, refusal_reason, refusal_message and refusal_terms.

    The first lexicon with a hit wins and only its matched terms are reported.
    """
    terms = terms or t.REFUSAL_TERMS
    messages = messages or t.REFUSAL_MESSAGES
    low = F.lower(strip(F.col(text)))
    reason = None
    matched = None
    for name, words in terms.items():
        hit = any_of(F.col("_low"), words)
        reason = F.when(hit, name) if reason is None else reason.when(hit, name)
        here = F.col("refusal_reason") == name
        found = which_of(F.col("_low"), words)
        matched = F.when(here, found) if matched is None else matched.when(here, found)
    return (
        df.withColumn("_low", low)
        .withColumn("refusal_reason", reason)
        .withColumns(
            {
                "refused": F.col("refusal_reason").isNotNull(),
                "refusal_message": text_map(messages)[F.col("refusal_reason")],
                "refusal_terms": matched.otherwise(lit_array([])),
            }
        )
        .drop("_low")
    )


def concern_flags(df: DataFrame, text: str, names: list[str], lexicons=None) -> DataFrame:
    """Add one boolean column ``_has_<name>`` per lexicon, each computed once."""
    lexicons = lexicons or t.CONCERN_TERMS
    return df.withColumn("_low", F.lower(strip(F.col(text)))).withColumns(
        {f"_has_{n}": any_of(F.col("_low"), lexicons[n]) for n in names}
    )


def _has(name: str) -> Column:
    return F.col(f"_has_{name}")


def drop_flags(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_has_") or c == "_low"])


TYPE_FLAGS = ["wrong_medication", "vomiting", "flavor", "rejection", "transdermal", "bud"]
LANE_FLAGS = ["severe", "vomiting", "flavor", "rejection", "transdermal", "oral_liquid", "bud"]


def concern_type_of() -> Column:
    """First matching rule over the flag columns; null where none matches."""
    return (
        F.when(_has("wrong_medication"), "wrong_patient_or_wrong_medication")
        .when(_has("vomiting") & _has("flavor"), "flavor_related_vomiting")
        .when(_has("vomiting"), "possible_adverse_drug_event")
        .when(_has("rejection"), "pet_refused_flavor")
        .when(_has("transdermal"), "syringe_or_device_issue")
        .when(_has("bud"), "bud_question")
        .when(_has("flavor"), "pet_refused_flavor")
    )


def risk_lane_of() -> Column:
    routine = _has("flavor") | _has("rejection") | _has("transdermal") | _has("oral_liquid") | _has("bud")
    return (
        F.when(_has("severe"), "life_threatening_or_legal")
        .when(_has("vomiting"), "unexpected_non_life_threatening")
        .when(routine, "expected_self_limiting")
    )


def concern_type(df: DataFrame, text: str = "concern_text", lexicons=None) -> DataFrame:
    """Add ``concern_type``."""
    flagged = concern_flags(df, text, TYPE_FLAGS, lexicons)
    return drop_flags(flagged.withColumn("concern_type", concern_type_of()))


def risk_lane(df: DataFrame, text: str = "concern_text", lexicons=None) -> DataFrame:
    """Add ``risk_lane``."""
    flagged = concern_flags(df, text, LANE_FLAGS, lexicons)
    return drop_flags(flagged.withColumn("risk_lane", risk_lane_of()))


def triage(df: DataFrame, text: str = "concern_text", lexicons=None) -> DataFrame:
    """Add concern_type and risk_lane over one set of flags."""
    names = list(dict.fromkeys(TYPE_FLAGS + LANE_FLAGS))
    flagged = concern_flags(df, text, names, lexicons)
    return drop_flags(
        flagged.withColumns({"concern_type": concern_type_of(), "risk_lane": risk_lane_of()})
    )


def concern_query(df: DataFrame, text: str = "concern_text", terms=None) -> DataFrame:
    """Add ``query_text``: the concern followed by the phrases of its type, if any."""
    extra = {k: " ".join(v) for k, v in (terms or t.CONCERN_QUERY_TERMS).items()}
    return df.withColumn(
        "query_text",
        F.concat_ws(" ", strip(F.col(text)), text_map(extra)[F.col("concern_type")]),
    )
