"""Text expressions.  Every function maps columns to a column and stays inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from tracewell.tables.words import STOP_WORDS, WHITESPACE

# Unicode classes, "\n" as the only line end: the dialect the rule patterns were written for.
_FLAGS = "(?dU)"
_FLAGS_CI = "(?diU)"


def lit_array(values) -> Column:
    """Array literal of strings (typed even when empty)."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def rx(col: Column, pattern: str, ignore_case: bool = True) -> Column:
    """True where ``pattern`` is found anywhere in ``col``."""
    return F.rlike(col, F.lit((_FLAGS_CI if ignore_case else _FLAGS) + pattern))


def rx_any(col: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    """One regex pass for a whole family of patterns.

    A word boundary that opens every pattern is tested once per position, ahead of the
    alternatives, so that most positions fail at that single test.
    """
    edge = r"\b"
    if all(p.startswith(edge) for p in patterns):
        return rx(col, edge + "(?:" + "|".join(p[len(edge):] for p in patterns) + ")", ignore_case)
    return rx(col, "|".join(f"(?:{p})" for p in patterns), ignore_case)


def any_of(col: Column, terms) -> Column:
    """True where any term occurs as a substring.  A term that contains another is redundant."""
    terms = list(dict.fromkeys(terms))
    needed = [t for t in terms if not any(o != t and o in t for o in terms)]
    found = F.lit(False)
    for term in needed:
        found = found | col.contains(term)
    return found


def which_of(col: Column, terms) -> Column:
    """Sorted array of the terms that occur as substrings."""
    return F.filter(lit_array(sorted(set(terms))), lambda t: F.contains(col, t))


def phrase_pattern(phrases) -> str:
    """Any of the whole phrases: any spacing between words, no word character on either side."""
    options = [r"\s+".join(re.escape(w) for w in p.lower().split()) for p in phrases]
    return r"(?<!\w)(?:" + "|".join(options) + r")(?!\w)"


def phrase_match(col: Column, phrases) -> Column:
    """True where any of ``phrases`` occurs as a whole phrase in lower-cased ``col``."""
    return rx(col, phrase_pattern(phrases), ignore_case=False)


def strip(col: Column) -> Column:
    """Remove white space at both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


def tokens(col: Column, stop_words=STOP_WORDS) -> Column:
    """Lower-case runs of ``[a-z0-9]``, longer than one character, without stop words."""
    parts = F.split(F.lower(col), "[^a-z0-9]+")
    return F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(list(stop_words)))


def normalize_space(col: Column) -> Column:
    """Lower case with runs of white space collapsed to one space."""
    return strip(F.regexp_replace(F.lower(col), r"(?U)\s+", " "))


def normalize_term(col: Column) -> Column:
    """Lower case with every run of other characters turned into one underscore."""
    return F.btrim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "_"), F.lit("_"))


def normalize_token(col: Column) -> Column:
    """Lower case with runs of spaces, hyphens and underscores turned into one underscore."""
    return F.regexp_replace(F.lower(strip(col)), r"(?U)[\s\-_]+", "_")


def slug(col: Column) -> Column:
    """Heading to identifier: lower case, other runs to ``-``, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "-"), F.lit("-"))


def line_ends(col: Column) -> Column:
    """Every kind of line end turned into ``\\n``."""
    return F.regexp_replace(col, r"\r\n|[\r\x0B\f\x1C\x1D\x1E\x85\u2028\u2029]", "\n")


def clean_text(col: Column) -> Column:
    """Strip the block and the right end of every line."""
    blank = r"[\s&&[^\n]]"
    lines = F.regexp_replace(line_ends(strip(col)), rf"(?U)(?<!{blank}){blank}++(?=\n)", "")
    return strip(lines)


def sentences(col: Column) -> Column:
    """Split at full stops, semicolons and line ends; trimmed, empties dropped."""
    parts = F.transform(F.split(col, r"[.;\n]+"), strip)
    return F.filter(parts, lambda s: s != "")


def typed_metadata(col: Column) -> Column:
    """Struct of a trimmed metadata value: its text and, for true/false, its boolean."""
    value = col
    low = F.lower(value)
    quoted = rx(value, "^(\"[\\s\\S]*\"|'[\\s\\S]*')$", ignore_case=False) & (F.length(value) >= 2)
    return F.struct(
        F.when(low == "true", F.lit("True"))
        .when(low == "false", F.lit("False"))
        .when(quoted, F.substring(value, F.lit(2), F.length(value) - 2))
        .otherwise(value)
        .alias("text"),
        F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False)).alias("flag"),
    )


def text_sha256(col: Column) -> Column:
    """Hex SHA-256 of the trimmed text."""
    return F.sha2(strip(col), 256)


def humanize(col: Column) -> Column:
    """Enum value as words; null reads as unknown."""
    return F.coalesce(F.replace(col, F.lit("_"), F.lit(" ")), F.lit("unknown"))


def ordered_distinct(*cols: Column) -> Column:
    """Concatenate arrays, keeping the first occurrence of every value."""
    return F.array_distinct(F.concat(*cols))


def canonical_order(col: Column, vocabulary) -> Column:
    """Distinct values in vocabulary order; values outside it are dropped."""
    return F.array_intersect(lit_array(vocabulary), col)


def safe_divide(a: Column, b: Column) -> Column:
    """Quotient as double, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
