"""Repeated values by sketches against plain counts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions.packed import pack_sorted, read_varint, unpack_sorted, varint
from tracewell.operators import repeats
from tracewell.operators.repeats import repeated_values, suspects


def test_packed_numbers():
    values = np.array([0, 1, 127, 128, 300, 2**35, 2**62])
    raw, sizes = varint(values)
    assert (read_varint(raw) == values).all() and sizes.sum() == len(raw)
    for some in (np.zeros(0, np.int64), np.array([0]), np.array([5, 5, 9, 2**40])):
        assert (unpack_sorted(pack_sorted(some)) == some).all()


@pytest.mark.parametrize("room, held", [(256, 4_000_000), (1, 50)])
def test_counts(spark, monkeypatch, room, held):
    monkeypatch.setattr(repeats, "ROOM", room)
    monkeypatch.setattr(repeats, "HELD", held)
    rng = random.Random(1)
    values = [f"id{rng.randrange(3000)}" for _ in range(2000)] + ["hot"] * 900 + [None] * 5 + ["", ""]
    df = spark.createDataFrame([(v, 1) for v in values], "v string, slice int").repartition(6)
    want = {v: values.count(v) for v in set(values) if v is not None and values.count(v) > 1}
    assert {r.v: r["count"] for r in repeated_values(df, "v").collect()} == want


def test_suspects_are_few(spark):
    """Of unique values hardly any is suspected, so hardly any row is shuffled by its value."""
    rows = spark.range(0, 200_000, numPartitions=8).select(F.xxhash64("id").bitwiseAND(F.lit(2**63 - 1)).alias("h"))
    assert suspects(rows, 4, 1 << 24).count() < 200_000 / 100
    both = rows.unionByName(spark.range(0, 100).select(F.xxhash64("id").bitwiseAND(F.lit(2**63 - 1)).alias("h")))
    assert 100 <= suspects(both, 4, 1 << 24).count() < 100 + 200_000 / 100


def test_empty(spark):
    assert repeated_values(spark.createDataFrame([], "v string"), "v").collect() == []
    assert repeated_values(spark.createDataFrame([(None,), (None,)], "v string"), "v").collect() == []
