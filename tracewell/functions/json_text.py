"""Expressions that take structured values out of supplied model output."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tracewell.functions.text import lit_array, normalize_token, strip
from tracewell.tables.summary import EMPTY_LIST_WORDS
from tracewell.tables.vocab import VOCAB


def fenced_json(col: Column, leading_only: bool = False) -> Column:
    """Text without its code fence.

    ``leading_only`` accepts a fence only around the whole text; otherwise the first fenced block
    anywhere is used.
    """
    text = strip(col)
    pattern = r"(?is)```(?:json)?\s*(.*?)\s*```"
    if leading_only:
        pattern = r"(?is)^```[^\n]*\n(?:json)?\s*(.*?)\s*\n\s*```$"
    inner = F.regexp_extract(text, pattern, 1)
    return F.when(F.rlike(text, F.lit(pattern)), strip(inner)).otherwise(text)


def json_object_text(col: Column) -> Column:
    """The JSON object in a model answer: fenced, bare, or from the first { to the last }.

    Null where no readable object is found.  Text with further braces after the object is not
    readable here and comes out null.
    """
    text = fenced_json(col)
    sliced = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.json_object_keys(text).isNotNull(), text).when(
        F.json_object_keys(sliced).isNotNull(), sliced
    )


def normalize_enum(col: Column, name: str) -> Column:
    """Vocabulary value that equals ``col`` up to case, spaces, hyphens; else ``col`` unchanged."""
    names = {v.lower().replace(" ", "_").replace("-", "_"): v for v in VOCAB[name]}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(known[normalize_token(col)], col)


def normalize_list(raw: Column) -> Column:
    """JSON value as array of strings: scalars become one element, empty words vanish.

    ``raw`` is the JSON text of the value; items are trimmed and kept once.
    """
    text = strip(raw)
    scalar = F.when(
        F.lower(text).isin("", "[]", "null", *EMPTY_LIST_WORDS), lit_array([])
    ).otherwise(F.array(text))
    items = F.filter(
        F.transform(F.from_json(text, "array<string>"), strip),
        lambda x: x.isNotNull() & (x != "") & ~F.lower(x).isin(*EMPTY_LIST_WORDS),
    )
    return F.when(text.isNull(), lit_array([])).when(
        F.startswith(text, F.lit("[")), F.array_distinct(F.coalesce(items, lit_array([])))
    ).otherwise(scalar)
