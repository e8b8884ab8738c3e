"""Streams over a growing index, and digests of files read as streams."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tracewell.session import work_folder
from tracewell.sources import evidence_index as ei
from tracewell.sources.file_digests import ItemCounter, streamed_manifest

KIND = "chunk_id string, source_id string, source_title string, source_type string, section_heading string, text string"


def chunk(name, text):
    return (name, "S", "title", "sop", "head", text)


def test_snapshots_of_batches(spark):
    source, out, state, path = (work_folder(spark, n) for n in ("asked", "found", "state", "evidence"))

    def ask(*rows):
        spark.createDataFrame(list(rows), "query_id long, query_text string").coalesce(1).write.mode("append").parquet(source)
        arriving = spark.readStream.schema("query_id long, query_text string").parquet(source)
        ei.start_retrieve_growing(arriving, path, out, state, k=3).awaitTermination()

    def seen():
        return sorted((r.query_id, r["rank"], r.chunk_id, r.snapshot) for r in spark.read.parquet(out).collect())

    assert ei.add_segment(spark.createDataFrame([chunk("a", "pen clicks"), chunk("b", "pen")], KIND), path) == 0
    ask((1, "pen clicks"))
    first = [(1, 1, "a", 0), (1, 2, "b", 0)]
    assert seen() == first
    assert ei.add_segment(spark.createDataFrame([chunk("c", "pen pen clicks clicks")], KIND), path) == 1
    ask((2, "pen clicks"))
    assert seen() == first + [(2, 1, "c", 1), (2, 2, "a", 1), (2, 3, "b", 1)]
    # A batch that is repeated after more segments were published searches what it searched before.
    ei.add_segment(spark.createDataFrame([chunk("d", "pen pen pen clicks clicks clicks")], KIND), path)
    assert ei.pinned_snapshot(spark, path, f"{out}-pins", 0) == 0 and ei.pinned_snapshot(spark, path, f"{out}-pins", 1) == 1
    assert ei.pinned_snapshot(spark, path, f"{out}-pins", 2) == 2
    chunks, features = ei.read_segments(spark, path, 1)
    assert chunks.count() == features.count() == 3
    with pytest.raises(ValueError, match="no segments"):
        ei.read_segments(spark, work_folder(spark, "none"), 5)


def test_counter_in_pieces():
    rng = random.Random(2)
    good = ["[]", " [ ] \n", "[1]", "[1, 2.5e3, -0]", '["a,]", "\\"", "é😀", {"x": [1, 2]}, [[]], null, true]', json.dumps(list(range(5000)))]
    bad = ["", " ", "1", "{}", '"[1]"', "[1", "[1,]", "[,1]", "[1] x", "[1][2]", "[NaN]", "[1 2]", "[tru]", "﻿[1]", '["a]', "[" * 50]
    for text in good + bad:
        data = text.encode()
        want = len(json.loads(text)) if text in good else None
        for _ in range(12):
            counter, at = ItemCounter(), 0
            while at < len(data):
                size = rng.choice([1, 2, 7, 1000])
                counter.feed(data[at : at + size])
                at += size
            counter.feed(b"", True)
            assert counter.total == want, text
    broken = ItemCounter()
    broken.feed(b"[\xff]")
    broken.feed(b"", True)
    assert broken.total is None


def test_manifest_of_files(spark, tmp_path):
    contents = {"a.json": json.dumps([{"n": i, "t": "x" * 50} for i in range(3000)]), "sub/b.txt": "no list", "sub/c.json": "[]", "_hidden": "[1]"}
    for name, text in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    big = tmp_path / "big.json"
    big.write_bytes(b"[" + b"7," * 3_000_000 + b"7]")
    for buffer, group in ((64 << 10, 1), (1000, 1 << 30)):
        rows = streamed_manifest(spark, str(tmp_path / "sub"), f"file://{tmp_path}/a.json", str(big), buffer=buffer, group=group)
        got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256, r.item_count) for r in rows.collect()}
        want = {n.rsplit("/", 1)[-1]: t.encode() for n, t in contents.items() if n != "_hidden"} | {"big.json": big.read_bytes()}
        counts = {"a.json": 3000, "b.txt": None, "c.json": 0, "big.json": 3_000_001}
        assert got == {n: (len(d), hashlib.sha256(d).hexdigest(), counts[n]) for n, d in want.items()}
    assert rows.select(F.spark_partition_id()).distinct().count() == 1
    assert streamed_manifest(spark, str(big), str(tmp_path / "sub"), group=1).rdd.getNumPartitions() == 3
