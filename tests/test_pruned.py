"""Keyword search over posting blocks against the search that scores every chunk."""

import random

import pytest

from tracewell.operators import pruned
from tracewell.operators.search import keyword_search
from tracewell.operators.terms import chunk_features
from tracewell.session import work_folder

KIND = "chunk_id string, source_title string, section_heading string, source_type string, text string"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(5000)]
    rows = [
        (f"c{i:03}", rng.choice(words), rng.choice([None, rng.choice(words)]), rng.choice(["sop", "other", None]), " ".join(rng.choices(words, k=rng.choice([0, 3, 30, 300]))))
        for i in range(300)
    ]
    rows += [(f"same{i}", "t", "h", "sop", "w1 w2 w3 w1") for i in range(40)]
    asked = [(i, " ".join(rng.choices(words, k=rng.choice([1, 4, 12])))) for i in range(25)]
    asked += [(90, ""), (91, None), (92, "the and"), (93, "nowhere"), (94, "w1 w1 w1")]
    return spark.createDataFrame(rows, KIND), spark.createDataFrame(asked, "query_id long, query_text string")


@pytest.mark.parametrize("size, tried, spans", [(4, 1, 1), (64, 2, 3)])
def test_same_rows_as_the_full_search(spark, tables, monkeypatch, size, tried, spans):
    chunks, asked = tables
    monkeypatch.setattr(pruned, "RANGE", size)
    monkeypatch.setattr(pruned, "SPAN", 4 * size)
    monkeypatch.setattr(pruned, "TRIED", tried)
    monkeypatch.setattr(pruned, "TRIED_SPANS", spans)
    path = work_folder(spark, "impact")
    pruned.write_impact_index(chunks, path, ranges=3)
    index = pruned.read_impact_index(spark, path)
    columns = ["query_id", "rank", "chunk_id", "score", "matched_terms"]
    for k, kind in ((1, None), (5, "sop"), (500, None)):
        found = pruned.pruned_search(asked, index, k, kind)
        want = keyword_search(asked, chunks, k, kind).select(*columns)
        assert sorted(map(tuple, found.best.collect())) == sorted(map(tuple, want.collect())), (k, kind)
        work = {r.query_id: r for r in found.work.collect()}
        assert all(r.blocks_read <= r.blocks for r in work.values())
        if k == 1 and size == 4:
            assert sum(r.blocks_read for r in work.values()) < 0.5 * sum(r.blocks for r in work.values())


def test_empty_tables_and_bad_k(spark, tables):
    chunks, asked = tables
    path = work_folder(spark, "impact")
    pruned.write_impact_index(chunks.limit(0), path)
    index = pruned.read_impact_index(spark, path)
    assert pruned.pruned_search(asked, index).best.collect() == []
    with pytest.raises(ValueError, match="top_k must be at least 1"):
        pruned.pruned_search(asked, index, 0)
    path = work_folder(spark, "impact")
    pruned.write_impact_index(chunks, path)
    found = pruned.pruned_search(asked.limit(0), pruned.read_impact_index(spark, path))
    assert found.best.collect() == [] and found.work.collect() == []


def test_postings_are_no_rows(spark, tables):
    """The table has a row for each term of a span; before, it had one for each term of a range, grouped from posting rows."""
    chunks, _ = tables
    path = work_folder(spark, "impact")
    pruned.write_impact_index(chunks, path, ranges=1)
    rows = spark.read.parquet(f"{path}/blocks")
    held = [(r.term, r.source_type, p.chunk_id, p.weight, p.bonus) for r in rows.collect() for block in r.postings for p in block]
    plain = [(t.term, r.source_type, r.chunk_id, t.weight, t.bonus) for r in chunk_features(chunks).collect() for t in r.terms]
    assert sorted(map(str, held)) == sorted(map(str, plain))
    assert rows.count() == len({p[:2] for p in plain}) < len(plain) / 5
