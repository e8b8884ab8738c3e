"""Terms of text columns, counted for the rows of an Arrow batch together.

The same as ``functions.text.tokens`` and ``functions.runs.with_counts``, which sort and count inside each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tracewell.session import prepare
from tracewell.tables.words import STOP_WORDS

_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


def _runs_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words, row of each word) of strings that end with a separator."""
    column = column.cast(pa.large_string())
    _, edges, data = column.buffers()
    edges = np.frombuffer(edges, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
    inside = _WORD[data]
    before = np.concatenate([[False], inside[:-1]])
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(before & ~inside)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return words, np.repeat(np.arange(len(column)), np.diff(np.searchsorted(starts, edges - edges[0])))


def count_words(columns: list[pa.Array]) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(offsets by row, terms, counts, columns that hold the term as bits) over all columns of a row; terms are sorted."""
    words, rows, parts = [], [], []
    for n, column in enumerate(columns):
        found, row = _runs_of(column)
        words.append(found)
        rows.append(row)
        parts.append(np.full(len(row), n))
    coded = pa.concat_arrays(words).dictionary_encode()
    known, n, size = coded.dictionary, len(columns[0]), max(1, len(coded.dictionary))
    order = pc.sort_indices(known)
    rank = np.empty(len(known), np.int64)
    rank[order.to_numpy()] = np.arange(len(known))
    allowed = pc.and_(
        pc.greater(pc.binary_length(known), 1), pc.invert(pc.is_in(known, value_set=pa.array(list(STOP_WORDS), known.type)))
    ).to_numpy(zero_copy_only=False)
    code = coded.indices.to_numpy()
    keep = allowed[code]
    key = ((np.concatenate(rows)[keep] * size + rank[code[keep]]) << 2) | np.concatenate(parts)[keep]
    key.sort()
    pair = key >> 2
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    held = np.bitwise_or.reduceat(1 << (key & 3), first) if len(first) else first
    own = pair[first]
    terms = known.take(order).take(pa.array(own % size))
    return np.searchsorted(own // size, np.arange(n + 1)), terms, np.diff(np.append(first, len(pair))), held


def searched(text: Column | str) -> Column:
    """``text`` as ``count_words`` reads it: in lower case, null as empty, ended by a separator."""
    return F.concat(F.coalesce(F.lower(text), F.lit("")), F.lit(" "))


def weighted_terms_of(df: DataFrame, keep: list[str], title: str, heading: str, text: str) -> DataFrame:
    """``keep`` columns plus ``terms``: array of (term, weight, bonus) of title, heading and text together.

    The weight is the count up to 3; a term of the title has a bonus of 2, one of the heading 1.
    """
    prepare(df.sparkSession)
    read = df.select(*keep, *(searched(c).alias(f"_part{n}") for n, c in enumerate((title, heading, text))))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema.fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, terms, counts, held = count_words([batch.column(f"_part{n}") for n in range(3)])
            bonus = 2.0 * (held & 1) + 1.0 * (held >> 1 & 1)
            items = pa.StructArray.from_arrays(
                [terms.cast(pa.string()), pa.array(np.minimum(counts, 3).astype(np.float64)), pa.array(bonus)],
                ["term", "weight", "bonus"],
            )
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), items)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], names=[*keep, "terms"])

    return read.mapInArrow(count, f"{kinds}terms array<struct<term:string,weight:double,bonus:double>>")
