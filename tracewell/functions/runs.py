"""Row-local counting: what a group-by would do, inside one row and without a shuffle.

An expression inside a lambda is computed again for every element, so whatever a lambda looks up
is made a column of its own first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def runs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, owners): first[i], first[i] + 1, ... below last[i] of every i, one after the other."""
    length = last - first
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - length - first, length), np.repeat(np.arange(len(first)), length)


def run_starts(items: Column) -> Column:
    """1-based positions in a sorted array where a new value begins."""
    n = F.size(items)
    positions = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    return F.filter(
        positions,
        lambda i: (i == 1) | (F.get(items, i - 1) != F.get(items, F.greatest(i - 2, F.lit(0)))),
    )


def run_lengths(items: Column, starts: Column, value: str, count: str) -> Column:
    """Array of (value, count) structs from a sorted array and its run starts."""
    return F.transform(
        starts,
        lambda p, j: F.struct(
            F.get(items, p - 1).alias(value),
            (F.coalesce(F.get(starts, j + 1), F.size(items) + 1) - p).alias(count),
        ),
    )


def with_counts(df: DataFrame, items: str, out: str, value: str, count: str) -> DataFrame:
    """Add ``out``: the multiset of array column ``items`` as (value, count) structs.

    The sort and the run starts are columns of their own so that each is computed once.
    """
    s, r = f"_{out}_sorted", f"_{out}_starts"
    return (
        df.withColumn(s, F.sort_array(items))
        .withColumn(r, run_starts(F.col(s)))
        .withColumn(out, run_lengths(F.col(s), F.col(r), value, count))
        .drop(s, r)
    )


def with_ordinals(df: DataFrame, keys: str, out: str) -> DataFrame:
    """Add ``out``: for each element of array ``keys``, 1 for its first occurrence, 2 for the next.

    ``sort_array`` on (key, position) groups equal keys in text order, so the ordinal is the
    offset inside the run; sorting back by position costs O(n log n) for the row.
    """
    pair, only, start = f"_{out}_pairs", f"_{out}_keys", f"_{out}_starts"
    numbered = F.flatten(
        F.transform(
            start,
            lambda p, j: F.transform(
                F.slice(pair, p, F.coalesce(F.get(start, j + 1), F.size(pair) + 1) - p),
                lambda e, o: F.struct(e["i"].alias("i"), (o + 1).alias("n")),
            ),
        )
    )
    return (
        df.withColumn(
            pair,
            F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))),
        )
        .withColumn(only, F.transform(pair, lambda p: p["k"]))
        .withColumn(start, run_starts(F.col(only)))
        .withColumn(out, F.transform(F.sort_array(numbered), lambda e: e["n"]))
        .drop(pair, only, start)
    )
