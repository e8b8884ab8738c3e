"""Secret scans through a trigram inverted index.

Each rule is a regular expression. From its parsed form a Boolean query over trigrams is derived that every
match satisfies: literals give their trigrams, sequences combine with and, branches with or. An Arrow
batch of texts is one shard: its index has a posting list (rows) per trigram that a query names. A rule's
candidates are the union and intersection of postings; only they are verified with the expression. Rules
without a mandatory trigram, such as runs of hex digits, scan every text.

Defined cases: null and empty texts have no spans; very long texts are a shard like any other; spans are in
code points, end exclusive, and may overlap between kinds; input columns named like the added ones
are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre, _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tracewell.llm.common import prepare, replaced, with_fields


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters; other matches are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False

    @property
    def flags(self) -> int:
        return re.ASCII | (re.IGNORECASE if self.ignore_case else 0)


# The three kinds that every scan reports.
BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
        ignore_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{16,}=*", ignore_case=True),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{0,15}://[^\s:/@]+:[^\s:/@]{3,}@"),
)
RULES = BASE + MORE

# Query trees: True (any text), a trigram, ("and", parts) or ("or", parts).
ANY = True
MOST_STRINGS = 64


def _only_and(query) -> bool:
    return isinstance(query, str) or query[0] == "and" and all(isinstance(part, str) for part in query[1])


def _join(kind: str, parts: list):
    flat = []
    for part in parts:
        if part is ANY:
            if kind == "or":
                return ANY
        elif isinstance(part, tuple) and part[0] == kind:
            flat += part[1]
        else:
            flat.append(part)
    flat = list(dict.fromkeys(flat))
    if kind == "or":
        # A branch that needs all the trigrams of another one, and more, adds nothing.
        needs = [trigrams(part) if _only_and(part) else set() for part in flat]
        flat = [p for p, n in zip(flat, needs) if not any(m and m < n for m in needs)]
    return ANY if not flat else flat[0] if len(flat) == 1 else (kind, tuple(flat))


def _of_strings(strings: frozenset[str]):
    """The query that a text satisfies if it holds one of the strings."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(tree) -> tuple[frozenset[str] | None, object]:
    """(every string that the tree can match, if few; a query that any match satisfies), in lower case."""
    queries, run, whole = [], frozenset([""]), True
    for op, value in tree:
        strings, query = None, ANY
        if op is sre.LITERAL:
            strings = frozenset([chr(value).lower()])
        elif op is sre.IN:
            chars = _members(value)
            strings = frozenset(chars) if chars and len(chars) <= 4 else None
        elif op is sre.SUBPATTERN:
            strings, query = _walk(value[3])
        elif op is sre.BRANCH:
            parts = [_walk(branch) for branch in value[1]]
            query = _join("or", [q if s is None else _of_strings(s) for s, q in parts])
            if all(s is not None for s, _ in parts):
                strings = frozenset().union(*(s for s, _ in parts))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = value
            inner_strings, inner_query = _walk(inner)
            if inner_strings is not None and high == 1:
                strings = inner_strings | {""} if low == 0 else inner_strings
            elif low > 0:
                query = inner_query if inner_strings is None else _of_strings(inner_strings)
        elif op in (sre.AT, sre.ASSERT_NOT):
            strings = frozenset([""])
        joined = None
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            joined = frozenset(a + b for a in run for b in strings)
        if joined is None:
            queries += [_of_strings(run), query if strings is None else _of_strings(strings)]
            run, whole = frozenset([""]), False
        else:
            run = joined
    query = _join("and", [*queries, _of_strings(run)])
    return (run if whole else None), query


def _members(items) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            out.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < 8:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out


def trigram_query(rule: Rule):
    """A query over lower-case trigrams that every text with a match satisfies; True when there is none."""
    strings, query = _walk(parser.parse(rule.pattern, rule.flags))
    return _of_strings(strings) if strings is not None else query


def trigrams(query) -> set[str]:
    if query is ANY:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams(part) for part in query[1]))


class Shard:
    """Posting lists of the named trigrams over one batch of texts, as sorted row numbers."""

    def __init__(self, texts: list[str], names: set[str]):
        lowered = [t.encode().lower() for t in texts]
        self.rows = np.arange(len(texts))
        ends = np.cumsum([len(t) + 1 for t in lowered])
        joined = b"\n".join(lowered)
        self.postings = {}
        for name in names:
            needle, places, at = name.encode(), [], -1
            while (at := joined.find(needle, at + 1)) >= 0:
                row = int(np.searchsorted(ends, at, side="right"))
                places.append(row)
                at = int(ends[row]) - 1
            self.postings[name] = np.array(places, np.int64)

    def candidates(self, query) -> np.ndarray:
        if query is ANY:
            return self.rows
        if isinstance(query, str):
            return self.postings[query]
        kind, parts = query
        out = self.candidates(parts[0])
        for part in parts[1:]:
            found = self.candidates(part)
            out = np.intersect1d(out, found, assume_unique=True) if kind == "and" else np.union1d(out, found)
        return out


SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Adds secret_spans: array of struct(kind, start, end), by start, then in the order of ``rules``."""
    prepare(docs.sparkSession)
    queries = [trigram_query(rule) for rule in rules]
    names = set().union(*map(trigrams, queries))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verify = [re.compile(rule.pattern, rule.flags).finditer for rule in rules]
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            shard = Shard(texts, names)
            found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for order, (rule, query, matches) in enumerate(zip(rules, queries, verify)):
                for row in shard.candidates(query).tolist():
                    for m in matches(texts[row]):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            found[row].append((m.start(), order, m.end()))
            spans = [[{"kind": rules[o].kind, "start": a, "end": b} for a, o, b in sorted(f)] for f in found]
            yield replaced(batch, {"secret_spans": pa.array(spans, arrow)})

    return docs.mapInArrow(run, with_fields(docs.schema, [("secret_spans", ArrayType(SPAN))]))
