"""Terms of a lexicon table that occur in texts: looked up in place, or as an equi-join on anchors.

A lexicon is shipped in parts that were measured to fit. A task hashes the bytes at every place of its texts, for each
length of a term or of its head, looks the hashes up and compares the bytes of what is found: whole terms are met where
they are, no q-gram becomes a row and no candidate is searched for in the whole text.

A still larger lexicon stays a table. Every term names one of its q-grams as its anchor, the one that the fewest texts hold. A text that holds the term holds
the anchor, so the distinct q-grams of the texts are joined with the anchors and only the pairs found are
verified. The size of the lexicon is nowhere in the plan: anchors are shuffled by q-gram, and texts stay out of that
shuffle. A q-gram that a third of all texts hold is an
anchor only of terms that have no rarer one; its rows are as many as the texts, not more.

Terms shorter than a q-gram are their own anchors. Empty and null terms occur nowhere, repeated terms count
once, null texts hold nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions.runs import runs as _runs
from tracewell.functions.text import normalize_space
from tracewell.session import BROADCAST_BYTES, measured, prepare, stored

GRAM = 4
# Parts of a lexicon that are shipped; each needs a pass over the texts.
MOST_PARTS = 8


def grams(text: Column, width: int) -> Column:
    """Distinct substrings of ``width`` characters: what a look-ahead sees at every place, in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1)))


def _all_grams(text: Column, widths: list[int]) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(none, *[F.coalesce(grams(text, w), none) for w in widths])


def _exploded(texts: DataFrame, widths: list[int], keep: list[str]) -> DataFrame:
    return texts.select(*keep, F.explode(_all_grams(F.col("text"), widths)).alias("gram"))


def anchors(lexicon: DataFrame, texts: DataFrame) -> tuple[DataFrame, list[int]]:
    """(term, gram) with the rarest q-gram of each term by the number of ``texts`` that hold it, and the widths in use."""
    terms = lexicon.where("term is not null and term <> ''").select("term").distinct()
    own = F.least(F.length("term"), F.lit(GRAM))
    pairs = terms.select("term", F.explode(F.coalesce(*[F.when(own == w, grams(F.col("term"), w)) for w in range(1, GRAM + 1)])).alias("gram"))
    pairs = stored(pairs, "term-grams")
    widths = sorted(r[0] for r in pairs.select(F.length("gram")).distinct().collect())
    sought = pairs.select("gram").distinct()
    # The counts are added up before they are shuffled; only q-grams of the lexicon are counted.
    held = _exploded(texts, widths, []).join(_shipped(sought), "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rated = pairs.join(held, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = rated.groupBy("term").agg(F.min(F.struct("n", "gram")).alias("least"))
    # A term with a q-gram that no text holds occurs nowhere.
    return stored(best.where("least.n > 0").select("term", F.col("least.gram").alias("gram")), "anchors"), widths


def _shipped(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if measured(df)[1] <= BROADCAST_BYTES else df


# Odd, so that its powers can be undone; the second number spreads hashes over all bits.
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
# Bytes that are looked up together, and the widest heads by which terms are looked up.
BLOCK_BYTES = 1 << 18
WIDEST = 64


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Hashes:
    """Hashes of substrings of some bytes."""

    def __init__(self, data: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * _powers(_BASE, len(data)), dtype=np.uint64)])
        self.undo = _powers(_UNBASE, len(data)) * _SPREAD

    def of(self, first: np.ndarray | slice, last: np.ndarray | slice) -> np.ndarray:
        return (self.sums[last] - self.sums[first]) * self.undo[first]


class _Terms:
    """Terms of a lexicon by the hashes of their heads: whole up to 16 bytes, a power of two beyond."""

    def __init__(self, terms: pa.Array):
        self.offsets, self.data = _bytes_of(terms)
        hashes, first = _Hashes(self.data), self.offsets[:-1]
        size = np.diff(self.offsets)
        width = np.where(size <= 16, size, np.minimum(WIDEST, 1 << np.log2(np.maximum(size, 1)).astype(np.int64)))
        whole = hashes.of(first, first + size)
        self.order = np.argsort(whole)
        self.whole = whole[self.order]
        self.heads = []
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            head = hashes.of(first[at], first[at] + w)
            pairs = np.unique(np.rec.fromarrays([head, size[at]]))
            known, start = np.unique(pairs["f0"], return_index=True)
            shift = np.uint64(64 - max(10, min(26, int(len(known) * 32).bit_length())))
            seen = np.zeros(1 << (64 - int(shift)), bool)
            seen[(known >> shift).astype(np.int64)] = True
            self.heads.append((w, seen, shift, known, np.append(start, len(pairs)), pairs["f1"]))

    def met(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, terms) of all terms in ``data``; ``ends`` has the end of the text at each place."""
        places, terms = [], []
        hashes = _Hashes(data)
        for width, seen, shift, known, starts, sizes in self.heads:
            if len(data) < width:
                continue
            head = hashes.of(slice(0, len(data) - width + 1), slice(width, len(data) + 1))
            at = np.flatnonzero(seen[(head >> shift).astype(np.int64)])
            head = head[at]
            place = np.minimum(np.searchsorted(known, head), len(known) - 1)
            held = known[place] == head
            at, place = at[held], place[held]
            item, owner = _runs(starts[place], starts[place + 1])
            at, size = at[owner], sizes[item]
            inside = at + size <= ends[at]
            at, size = at[inside], size[inside]
            whole = hashes.of(at, at + size)
            place = np.minimum(np.searchsorted(self.whole, whole), len(self.whole) - 1)
            # Equal hashes of different terms follow each other.
            last = np.searchsorted(self.whole, whole, "right")
            item, owner = _runs(np.where(self.whole[place] == whole, place, last), last)
            at, size, term = at[owner], size[owner], self.order[item]
            same = np.diff(self.offsets)[term] == size
            at, size, term = at[same], size[same], term[same]
            pieces = np.unique([0, *np.searchsorted(np.cumsum(size), np.arange(1 << 20, int(size.sum()), 1 << 20))])
            for a, b in zip(pieces, [*pieces[1:], len(at)]):
                here, owner = _runs(at[a:b], at[a:b] + size[a:b])
                there, _ = _runs(self.offsets[term[a:b]], self.offsets[term[a:b]] + size[a:b])
                wrong = np.bincount(owner[data[here] != self.data[there]], minlength=b - a)
                places.append(at[a:b][wrong == 0])
                terms.append(term[a:b][wrong == 0])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *places]), np.concatenate([none, *terms])


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of strings, null as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def _finder(shipped, by: str, edges: bool):
    """Function for ``mapInArrow``: the distinct terms in each text, with ``edges`` each with the characters around it."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        terms = _Terms(known)
        for batch in batches:
            offsets, data = _bytes_of(batch.column("text"))
            cuts = np.unique([0, *np.searchsorted(offsets, np.arange(BLOCK_BYTES, offsets[-1], BLOCK_BYTES))])
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                if a == b:
                    continue
                own, text = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
                row = np.repeat(np.arange(b - a), np.diff(own))
                place, term = terms.met(text, own[1:][row])
                if edges:
                    before, after = _around(text, own, row, place, place + np.diff(terms.offsets)[term])
                    keys = np.unique(np.stack([row[place], term, before, after], axis=1), axis=0)
                    around = lambda codes: pa.array(["" if c < 0 else chr(c) for c in codes.tolist()], pa.string())
                    items = [known.take(pa.array(keys[:, 1])), around(keys[:, 2]), around(keys[:, 3])]
                    owner = keys[:, 0]
                else:
                    keys = np.unique(row[place] * len(known) + term)
                    none = pa.array(np.full(len(keys), "", object), pa.string())
                    items, owner = [known.take(pa.array(keys % len(known))), none, none], keys // len(known)
                found = pa.StructArray.from_arrays(items, ["term", "before", "after"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32)), found)
                yield pa.RecordBatch.from_arrays([batch.column(by).slice(a, b - a), lists], names=[by, "found"])

    return find


def _around(text: np.ndarray, own: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points before ``first`` and at ``last`` inside the same text, -1 where there is none."""
    lead = np.flatnonzero((text & 0xC0) != 0x80)
    value = text[lead].astype(np.int64)
    length = np.diff(np.append(lead, len(text)))
    value = np.where(length == 1, value, value & (0x7F >> length))
    for n in range(1, 4):
        more = text[np.minimum(lead + n, max(0, len(text) - 1))] & 0x3F
        value = np.where(length > n, value << 6 | more, value)
    value = np.append(value, -1)
    at = np.searchsorted(lead, first)
    before = np.where(first > own[row[first]], value[at - 1], -1)
    end = own[row[first] + 1]
    return before, np.where(last < end, value[np.searchsorted(lead, last)], -1)


def _found_in_place(texts: DataFrame, terms: DataFrame, by: str, phrases: bool) -> DataFrame:
    """(by, terms) by a shipped lexicon: one row per text that holds a term."""
    spark = texts.sparkSession
    prepare(spark)
    shipped = spark.sparkContext.broadcast(terms.toArrow().column("term").combine_chunks())
    kind = texts.schema[by].dataType.simpleString()
    held = texts.mapInArrow(
        _finder(shipped, by, phrases), f"`{by}` {kind}, found array<struct<term:string,before:string,after:string>>"
    )
    if phrases:
        word = F.lit(r"(?U)\w")
        free = lambda f: ~F.rlike(f["before"], word) & ~F.rlike(f["after"], word)
        held = held.withColumn("found", F.filter("found", free))
    return held.select(by, F.array_distinct(F.col("found.term")).alias("terms")).where("size(terms) > 0")


def lexicon_matches(
    texts: DataFrame, lexicon: DataFrame, by: str, phrases: bool = False, limit: int = BROADCAST_BYTES, lists: bool = False
) -> DataFrame:
    """(by, term) for every text and every term that occurs in it; with ``lists`` (by, terms), some rows per text.

    ``texts``: a key column ``by`` and text; ``lexicon``: term. As substrings, case as it stands; with
    ``phrases`` as whole phrases in lower case with any spacing. A lexicon is shipped in parts of about ``limit`` bytes,
    one after the other, where there are at most ``MOST_PARTS``.
    """
    if phrases:
        texts = texts.select(by, normalize_space(F.col("text")).alias("text"))
        lexicon = lexicon.select(normalize_space(F.col("term")).alias("term"))
    texts = texts.select(by, "text")
    terms = stored(lexicon.where("term is not null and term <> ''").select("term").distinct(), "lexicon")
    size = measured(terms)[1]
    if size <= limit * MOST_PARTS:
        parts = max(1, ceil(size / limit)) if limit else 1
        number = F.pmod(F.xxhash64("term"), F.lit(parts))
        found = reduce(DataFrame.unionByName, (_found_in_place(texts, terms.where(number == n), by, phrases) for n in range(parts)))
        return found if lists else found.select(by, F.explode("terms").alias("term"))
    known, widths = anchors(terms, texts)
    if phrases:
        quoted = F.replace(F.col("term"), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
        holds = F.rlike(F.col("text"), F.concat(F.lit("(?U)(?<!\\w)\\Q"), quoted, F.lit("\\E(?!\\w)")))
    else:
        holds = F.contains(F.col("text"), F.col("term"))
    found = _exploded(texts, widths, [by]).join(known, "gram").select(by, "term").distinct()
    found = texts.join(found, by).where(holds).select(by, "term")
    return found.select(by, F.array("term").alias("terms")) if lists else found


def matched_terms(matches: DataFrame, by: str) -> DataFrame:
    """(by, terms): the sorted terms of each text; a list is no longer than the lexicon's terms in that text.

    ``matches`` has term, or terms of a text in lists, which then meet without becoming rows of their own.
    """
    if "terms" in matches.columns:
        met = F.flatten(F.collect_list("terms"))
        return matches.groupBy(by).agg(F.array_sort(F.array_distinct(met)).alias("terms"))
    return matches.groupBy(by).agg(F.array_sort(F.collect_set("term")).alias("terms"))
