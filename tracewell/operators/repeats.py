"""Values that occur more than once, found without shuffling all values.

First pass: a task marks its values in a sketch, a sparse bitmap of places named by a 63-bit hash, kept in slices of the
hash and packed to little more than a byte a value. The sketches of a slice meet in one task; places marked by two
tasks, or twice by one, are suspects. Second pass: only values at suspect places are grouped and counted, so the rows
that are shuffled are as many as there are repeats, and one chance suspect for about ``ROOM`` values.
A value that a third of all rows hold is one mark per task in the first pass and pre-aggregated in the second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewell.functions.packed import pack_sorted, unpack_sorted
from tracewell.session import broadcast_if_bounded, ship_package, stored

ROOM = 256
SLICE_VALUES = 8_000_000
HELD = 4_000_000


def _sketch_rows(hashes: np.ndarray, slices: int, room: int) -> pa.RecordBatch:
    """One row per slice: the marked places, and those marked twice."""
    both, count = np.unique((hashes % slices) * room + (hashes // slices) % room, return_counts=True)
    names = both // room
    edges = np.searchsorted(names, np.arange(slices + 1))
    used = np.flatnonzero(np.diff(edges))
    marked = [pack_sorted(both[edges[s] : edges[s + 1]] % room) for s in used]
    twice = [pack_sorted(both[edges[s] : edges[s + 1]][count[edges[s] : edges[s + 1]] > 1] % room) for s in used]
    return pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), pa.array(marked, pa.binary()), pa.array(twice, pa.binary())],
        names=["slice", "marked", "twice"],
    )


def suspects(hashed: DataFrame, slices: int, room: int) -> DataFrame:
    """(slice, place): places that more than one row of ``hashed`` (column h, not negative) marks."""
    ship_package(hashed.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column("h").to_numpy(zero_copy_only=False))
            size += batch.num_rows
            if size >= HELD:
                yield _sketch_rows(np.concatenate(held), slices, room)
                held, size = [], 0
        if held:
            yield _sketch_rows(np.concatenate(held), slices, room)

    def meet(group: pa.Table) -> pa.Table:
        marked = np.concatenate([unpack_sorted(m) for m in group.column("marked").to_pylist()])
        places, count = np.unique(marked, return_counts=True)
        twice = [unpack_sorted(t) for t in group.column("twice").to_pylist()]
        found = np.union1d(places[count > 1], np.concatenate([np.zeros(0, np.int64), *twice]))
        own = np.full(len(found), group.column("slice")[0].as_py(), np.int32)
        return pa.table({"slice": pa.array(own), "place": pa.array(found)})

    sketches = hashed.select("h").mapInArrow(sketch, "slice int, marked binary, twice binary")
    return sketches.groupBy("slice").applyInArrow(meet, "slice int, place long")


def repeated_values(df: DataFrame, name: str) -> DataFrame:
    """(name, count) of the values of a column that more than one row holds; nulls are no values."""
    spark = df.sparkSession
    positive = F.xxhash64(name).bitwiseAND(F.lit(2**63 - 1))
    rows = df.where(F.col(name).isNotNull()).select(F.col(name).alias("value"), positive.alias("h"))
    n = df.count()
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SLICE_VALUES))
    room = 1 << (ROOM * max(1, n // slices)).bit_length()
    found = broadcast_if_bounded(stored(suspects(rows, slices, room), "suspects"))
    placed = rows.select("value", F.expr(f"cast(h % {slices} as int)").alias("slice"), F.expr(f"(h div {slices}) % {room}").alias("place"))
    counted = placed.join(found, ["slice", "place"], "left_semi").groupBy("value").count().where("count > 1")
    return counted.withColumnRenamed("value", name)
