"""Benchmark decontamination: Wu-Manber search for the word windows of benchmark items in whole documents.

Texts become words: runs of digits, letters a-z (A-Z lower-cased) and everything beyond ASCII. An item's
patterns are its windows of ``WINDOW`` consecutive words; an item with fewer words is one shorter window.

Search, over word numbers (words that no pattern holds are number 0): a hashed table gives for every block of
two words how far the window may move before that block can stand inside a pattern, so most words are never
looked at. Where the shift is 0, the block's bucket (patterns ending in these words, ordered by a hash of the
whole window) selects the patterns, and their words are compared one by one. Patterns of each length have
their own tables. Many cursors, each on its own stretch of the words, move side by side as numpy arrays.

Plan: the documents never move. (window, item) rows are distinct and range-sorted into blocks of at most
``BLOCK_BYTES``; a block passes through the driver and is broadcast, and the blocks' searches are chained row
by row over the documents, the found ranges and items being united. A window that very many items share
spans blocks like any other rows. Very long texts are read in slices; only 4 bytes a word are kept of them.

Defined cases: null and empty texts have no words and nothing is found; an item without words is in no
document; rows with one item id are one item; a null item id is written as the empty string; repeated rows
and ids of documents are judged each for itself; input columns named like the added ones are replaced; an
empty table of documents gives an empty result, an empty benchmark finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tracewell.llm.common import prepare, replaced, stored, with_fields

WINDOW = 10
BLOCK_BYTES = 32 << 20
CHAINED = 4
PART_BYTES = 2 << 20
SLICE_BYTES = 1 << 20
STRETCH = 512

# The words of the contract as a Java pattern, after A-Z were lower-cased. Fixed value.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_FOLD = bytes(
    b if b >= 0x80 or chr(b) in LOWER or chr(b).isdigit() else b + 32 if chr(b) in UPPER else 0x20 for b in range(256)
)


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (words, item): every window of every item with at least one word."""
    folded = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.regexp_extract_all(folded, F.lit(WORDS), F.lit(0)).alias("all_words"),
    ).where(F.size("all_words") > 0)
    first = F.sequence(F.lit(1), F.greatest(F.size("all_words") - F.lit(window - 1), F.lit(1)))
    placed = items.select("item", "all_words", F.explode(first).alias("at"))
    return placed.select(F.slice("all_words", F.col("at"), F.lit(window)).alias("words"), "item").distinct()


@dataclass(frozen=True)
class Patterns:
    """The tables of all patterns of one length; row k of ``words`` is a pattern held by items[first[k]:first[k + 1]]."""

    length: int
    shift: np.ndarray
    buckets: np.ndarray
    keys: np.ndarray
    words: np.ndarray
    first: np.ndarray
    items: np.ndarray


@dataclass(frozen=True)
class Index:
    vocabulary: dict[bytes, int]
    items: list[str]
    tables: list[Patterns]


def _block(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (before.astype(np.int64) << 32) | last.astype(np.int64)


def _slot(block: np.ndarray, bits: int) -> np.ndarray:
    return ((block.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _window_hash(words: np.ndarray) -> np.ndarray:
    """40 bits from all words of each row."""
    out = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        out = (out ^ words[:, k].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return (out >> np.uint64(24)).astype(np.int64)


def _ends(words: np.ndarray, at: int) -> np.ndarray:
    """The block that ends with word ``at`` of each row; a single word has no word before it."""
    return _block(words[:, at - 1] if at else np.zeros(len(words), np.int32), words[:, at])


def _tables(length: int, words: np.ndarray, first: np.ndarray, items: np.ndarray) -> Patterns:
    """Shift and bucket tables; the block is two words, or one where patterns are single words."""
    block = min(2, length)
    bits = max(12, int(4 * len(words) * length).bit_length())
    shift = np.full(1 << bits, length - block + 1, np.uint8)
    for at in range(block - 1, length):
        np.minimum.at(shift, _slot(_ends(words, at), bits), np.uint8(length - 1 - at))
    buckets, bucket = np.unique(_ends(words, length - 1), return_inverse=True)
    keys = (bucket.astype(np.int64) << 40) | _window_hash(words)
    order = np.argsort(keys, kind="stable")
    counts = np.diff(first)[order]
    starts = np.repeat(first[:-1][order], counts)
    within = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
    held = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return Patterns(length, shift, buckets, keys[order], words[order], held, items[starts + within])


def build_index(rows: list[tuple[list[str], str]]) -> Index:
    """The tables of distinct (words, item) rows."""
    vocabulary: dict[bytes, int] = {}
    numbers: dict[str, int] = {}
    held: dict[int, dict[tuple[int, ...], list[int]]] = {}
    for words, item in rows:
        window = tuple(vocabulary.setdefault(w.encode(), len(vocabulary) + 1) for w in words)
        held.setdefault(len(window), {}).setdefault(window, []).append(numbers.setdefault(item, len(numbers)))
    tables = []
    for length, patterns in sorted(held.items()):
        first = np.cumsum([0, *map(len, patterns.values())]).astype(np.int64)
        items = np.array([i for some in patterns.values() for i in some], np.int32)
        tables.append(_tables(length, np.array(list(patterns), np.int32).reshape(-1, length), first, items))
    return Index(vocabulary, list(numbers), tables)


def _numbers(text: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The number of each word of a text, read in slices that end between words."""
    folded, out, begin = text.translate(_FOLD), [], 0
    while begin < len(folded):
        end = len(folded) if len(folded) - begin <= SLICE_BYTES else folded.find(b" ", begin + SLICE_BYTES)
        end = len(folded) if end < 0 else end
        words = folded[begin:end].split()
        out.append(np.fromiter(map(vocabulary.get, words, repeat(0)), np.int32, len(words)))
        begin = end
    return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, np.int32), *out])


def _candidates(table: Patterns, words: np.ndarray) -> np.ndarray:
    """Last positions of the windows whose block shifts by nothing, in no order."""
    bits = len(table.shift).bit_length() - 1
    at = np.arange(table.length - 1, len(words), STRETCH)
    end = np.minimum(at + STRETCH, len(words))
    found = []
    while len(at):
        before = words[at - 1] if table.length > 1 else np.zeros(len(at), np.int32)
        step = table.shift[_slot(_block(before, words[at]), bits)]
        found.append(at[step == 0])
        at = at + np.maximum(step, 1)
        live = at < end
        at, end = at[live], end[live]
    return np.concatenate([np.zeros(0, np.int64), *found])


def occurrences(table: Patterns, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first position, pattern) of every occurrence."""
    last = _candidates(table, words)
    before = words[last - 1] if table.length > 1 else np.zeros(len(last), np.int32)
    block = _block(before, words[last])
    bucket = np.searchsorted(table.buckets, block)
    known = bucket < len(table.buckets)
    known[known] = table.buckets[bucket[known]] == block[known]
    last, bucket = last[known], bucket[known]
    windows = words[last[:, None] + np.arange(1 - table.length, 1)]
    keys = (bucket.astype(np.int64) << 40) | _window_hash(windows)
    low, high = np.searchsorted(table.keys, keys, "left"), np.searchsorted(table.keys, keys, "right")
    starts, patterns = [], []
    while len(low):
        open_ = low < high
        low, high, last, windows = low[open_], high[open_], last[open_], windows[open_]
        same = (table.words[low] == windows).all(axis=1)
        starts.append(last[same] - table.length + 1)
        patterns.append(low[same])
        low = low + 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *patterns])


def _ranges(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of true."""
    edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


class _Search:
    """Searches texts for the patterns of one index and adds what was found before."""

    def __init__(self, index: Index):
        self.index, self.lists = index, {}

    def _items(self, patterns: list[np.ndarray]) -> list[str]:
        """The items of a document's patterns; documents with one passage in common share a list."""
        key = b"|".join(p.tobytes() for p in patterns)
        if key not in self.lists:
            if len(self.lists) > 1000:
                self.lists.clear()
            found = [t.items[t.first[p] : t.first[p + 1]] for t, some in zip(self.index.tables, patterns) for p in some]
            self.lists[key] = sorted(self.index.items[i] for i in np.unique(np.concatenate(found)))
        return self.lists[key]

    def __call__(self, texts: list[bytes | None], earlier: list[tuple] | None) -> list[tuple]:
        """(n_words, ranges, items) of each text; ``earlier`` has the ranges and items of the blocks before."""
        numbers = [_numbers(t or b"", self.index.vocabulary) for t in texts]
        sizes = np.array([len(n) for n in numbers], np.int64)
        # One position that is in no pattern parts the texts.
        begins = np.cumsum(sizes + 1) - sizes - 1
        words = np.zeros(int((sizes + 1).sum()), np.int32)
        for begin, n in zip(begins, numbers):
            words[begin : begin + len(n)] = n
        marks = np.zeros(len(words) + 1, np.int64)
        found = []
        for table in self.index.tables:
            at, pattern = occurrences(table, words)
            np.add.at(marks, at, 1)
            np.add.at(marks, at + table.length, -1)
            doc = np.searchsorted(begins, at, "right") - 1
            pairs = np.unique(np.stack([doc, pattern], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
            found.append(pairs)
        starts, ends = _ranges(np.cumsum(marks[:-1]) > 0)
        own = np.searchsorted(starts, np.append(begins, len(words)))
        holders = set().union(*(set(f[:, 0].tolist()) for f in found)) if found else set()
        out = []
        for k, begin in enumerate(begins.tolist()):
            ranges, items = [], []
            if k in holders:
                a, b = own[k], own[k + 1]
                ranges = list(zip((starts[a:b] - begin).tolist(), (ends[a:b] - begin).tolist()))
                items = self._items([f[slice(*np.searchsorted(f[:, 0], [k, k + 1])), 1] for f in found])
            if earlier and (earlier[k][0] or earlier[k][1]):
                ranges, items = _united(ranges, earlier[k][0]), sorted({*items, *earlier[k][1]})
            out.append((int(sizes[k]), ranges, items))
        return out


def _united(some: list[tuple[int, int]], more: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted([*some, *more]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_RANGES = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
FOUND = [("n_words", LongType()), ("hit_ranges", _RANGES), ("item_ids", ArrayType(StringType()))]
_ARROW_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about PART_BYTES of text, one row at least."""
    sizes = np.array([len(v.as_buffer() or b"") if v.is_valid else 0 for v in batch.column("text")], np.int64)
    run = np.cumsum(sizes) // PART_BYTES
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _searched(docs: DataFrame, index: Index, first: bool) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(shipped.value)
        for whole in batches:
            for batch in _parts(whole):
                earlier = None
                if not first:
                    ranges, items = (batch.column(n).to_pylist() for n in ("hit_ranges", "item_ids"))
                    earlier = [([(r["start"], r["end"]) for r in some], i) for some, i in zip(ranges, items)]
                found = search(batch.column("text").cast(pa.binary()).to_pylist(), earlier)
                ranges = [[{"start": a, "end": b} for a, b in f[1]] for f in found]
                added = {
                    "n_words": pa.array([f[0] for f in found], pa.int64()),
                    "hit_ranges": pa.array(ranges, _ARROW_RANGES),
                    "item_ids": pa.array([f[2] for f in found], pa.list_(pa.string())),
                }
                yield replaced(batch, added)

    return docs.mapInArrow(run, with_fields(docs.schema, FOUND))


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (text, ...) with n_words, hit_ranges and item_ids.

    hit_ranges are the disjoint ranges [start, end) of the words that stand inside an occurrence of a window, by
    number of the word from 0; item_ids are the items (item_id as string, sorted) of which a window occurs.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = stored(item_windows(benchmark, window), "benchmark-windows")
    size = rows.agg(F.sum(F.octet_length(F.array_join("words", " ")) + F.octet_length("item") + 40)).first()[0] or 0
    blocks = -(-int(size) // block_bytes)
    if blocks <= 1:
        return _searched(docs, build_index([tuple(r) for r in rows.collect()]), True)
    placed = rows.repartitionByRange(blocks, "words", "item").withColumn("block", F.spark_partition_id())
    placed = stored(placed, "benchmark-blocks")
    for k in range(blocks):
        some = placed.where(F.col("block") == k).select("words", "item").collect()
        docs = _searched(docs, build_index([tuple(r) for r in some]), k == 0)
        if (k + 1) % CHAINED == 0 and k + 1 < blocks:
            docs = stored(docs, "decontaminated")
    return docs
