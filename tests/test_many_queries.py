"""Searches of many queries: grouped scores, batch counts and the texts of citations."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.operators import checklist, kernel, search, terms
from tracewell.operators.search import attach_chunks, keyword_search

KIND = "chunk_id string, source_id string, source_title string, section_heading string, source_type string, text string"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(5000)]
    # A few long chunks and many short ones, some of them twice, and one without an id.
    sizes = [1500] * 8 + [300] * 20 + [25] * 500 + [0, 1]
    rows = [(f"c{n:03}", "s", rng.choice([None, "w1 guide"]), rng.choice(words), "sop", " ".join(rng.choices(words, k=k))) for n, k in enumerate(sizes)]
    rows += [rows[3], rows[40], (None, None, None, None, "sop", "w1 w2")]
    asked = [(n, " ".join(rng.choices(words, k=rng.choice([1, 12, 40])))) for n in range(120)]
    asked += [(5, "w1 w2"), (None, "w1 w3"), (900, None), (901, ""), (902, "nowhere")]
    return spark.createDataFrame(rows, KIND).repartition(3), spark.createDataFrame(asked, "query_id long, query_text string")


@pytest.mark.parametrize("head, slab", [(2048, 2_000_000), (2, 3000)])
def test_grouped_search_gives_the_same_rows(tables, monkeypatch, head, slab):
    chunks, asked = tables
    columns = ["query_id", "rank", "chunk_id", "score", "matched_terms"]
    shown = lambda k: sorted(map(str, keyword_search(asked, chunks, k).select(*columns).collect()))
    want = {k: shown(k) for k in (1, 7, 1000)}
    monkeypatch.setattr(search, "GROUPED_QUERIES", 1)
    monkeypatch.setattr(search, "HEAD_CHUNKS", head)
    assert {k: shown(k) for k in want} == want
    # The same in this process, with small slabs and groups.
    for name, value in (("GROUPED_QUERIES", 1), ("SLAB_ENTRIES", slab), ("HELD_PAIRS", 50), ("GROUP_ENTRIES", [60])):
        monkeypatch.setattr(kernel, name, value)
    block = kernel.block_of(terms.query_features(asked).toArrow().combine_chunks())
    features = terms.chunk_features(chunks).where("chunk_id is not null").toArrow().combine_chunks()

    class Shipped:
        value = block

    def rows(k):
        got = [r for b in kernel.scorer(Shipped, "keyword", k)(iter(features.to_batches(max_chunksize=100))) for r in b.to_pylist()]
        return sorted((str(r["query_id"]), -r["score"], r["chunk_id"], r["matched_terms"]) for r in got)

    for k in (1, 7, 1000):
        grouped = rows(k)
        monkeypatch.setattr(kernel, "GROUPED_QUERIES", 10**9)
        assert grouped == rows(k)
        monkeypatch.setattr(kernel, "GROUPED_QUERIES", 1)


def test_few_pairs_are_scored(spark, monkeypatch):
    """Most chunks cannot be among the best of a query, and are left out by the bound of their group."""
    rng = random.Random(3)
    words = [f"w{n}" for n in range(600)]
    rows = [(f"c{n:03}", "s", "t", "h", "sop", " ".join(rng.choices(words, k=k))) for n, k in enumerate([1500] * 8 + [20] * 300)]
    asked = spark.createDataFrame([(n, " ".join(rng.sample(words, 40))) for n in range(60)], "query_id long, query_text string")
    features = terms.chunk_features(spark.createDataFrame(rows, KIND))
    monkeypatch.setattr(search, "GROUPED_QUERIES", 1)
    monkeypatch.setattr(search, "HEAD_CHUNKS", 8)
    floored = search._with_floors(terms.query_features(asked), features.select("chunk_id", "terms"), 3).toArrow().combine_chunks()

    class Shipped:
        value = kernel.block_of(floored)

    scored, plain = [0], kernel.Groups.scores

    def counted(self, tiles, group, queries, place):
        scored[0] += len(queries) * len(self.rows[group])
        return plain(self, tiles, group, queries, place)

    monkeypatch.setattr(kernel.Groups, "scores", counted)
    monkeypatch.setattr(kernel, "GROUPED_QUERIES", 1)
    monkeypatch.setattr(kernel, "GROUP_ENTRIES", [100])
    table = features.toArrow().combine_chunks()
    list(kernel.scorer(Shipped, "keyword", 3)(iter(table.to_batches())))
    assert 0 < scored[0] < 0.3 * len(Shipped.value.ids) * table.num_rows


def test_fractions(monkeypatch):
    rng = np.random.default_rng(2)
    held = [sorted(rng.choice(40, 20, replace=False).tolist()) for _ in range(60)]
    entries = [[{"term": f"w{t}", "weight": float(rng.random()), "bonus": float(rng.random())} for t in h] for h in held]
    asked = [[{"term": f"w{t}", "cnt": int(rng.integers(1, 4))} for t in rng.choice(40, 10, replace=False)] for _ in range(30)]

    class Shipped:
        value = kernel.block_of(pa.table({"query_id": list(range(30)), "terms": asked}))

    batch = pa.record_batch({"chunk_id": [f"c{n:02}" for n in range(60)], "terms": entries})
    found = {}
    for least in (1, 10**9):
        monkeypatch.setattr(kernel, "GROUPED_QUERIES", least)
        monkeypatch.setattr(kernel, "GROUP_ENTRIES", [50])
        rows = [r for b in kernel.scorer(Shipped, "keyword", 4)(iter([batch])) for r in b.to_pylist()]
        found[least] = sorted((r["query_id"], r["chunk_id"], round(r["score"], 9)) for r in rows)
    assert found[1] == found[10**9]


def test_counts_of_batches(spark):
    rows = [
        ("c1", "Rules rules", "The Heading a b Heading", None), ("c2", None, None, ""), (None, "aa", "bb", "aa bb cc"),
        ("c3", "", "İs K ſ é2é word\x00word x1 X1 the", "text Text a bb"), ("c4", None, "zz", "Σς end"), ("c4", "t1", "t1", "t1 " * 9),
    ]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_title string, section_heading string, text string")
    split = chunks.withColumns({"_title": terms.tokens(F.col("source_title")), "_heading": terms.tokens(F.col("section_heading"))})
    inside = terms.count_terms(split, terms.scoring_text(), ["chunk_id", "_title", "_heading"])
    want = sorted(map(str, inside.select("chunk_id", terms.weighted_terms().alias("terms")).collect()))
    features = terms.chunk_features(chunks)
    assert sorted(map(str, features.collect())) == want
    assert terms.chunk_features(chunks.limit(0)).collect() == []
    # No array of a row is sorted and walked to count its terms.
    assert "sort_array" not in features._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("text_bytes, returned", [(128 << 20, 16 << 20), (2000, 200)])
def test_citations_with_texts(spark, monkeypatch, text_bytes, returned):
    chunks = spark.createDataFrame(
        [(f"c{n}", "s", "t", None if n == 2 else f"head {n}", "sop", None if n == 1 else f"text {n} " * 20) for n in range(9)]
        + [("c3", "s2", "t2", "again", "sop", "another c3")], KIND,
    )
    best = [(q, r, f"c{(q * r) % 9}", float(10 - r), ["a", "b"]) for q in range(40) for r in range(1, 4)] + [(41, 1, "c3", 1.0, [])]
    best = spark.createDataFrame(best, "query_id long, rank int, chunk_id string, score double, matched_terms array<string>")
    rows = spark.createDataFrame([(q, f"row {q}") for q in (*range(45), 7, None)], "query_id long, note string")
    plain = rows.join(checklist.evidence_citation(attach_chunks(best, chunks)), "query_id", "left")
    want = sorted(map(str, plain.withColumn("evidence", F.coalesce("evidence", F.array())).collect()))
    monkeypatch.setattr(checklist, "TEXT_BYTES", text_bytes)
    monkeypatch.setattr(checklist, "RETURNED_BYTES", returned)
    found = checklist.with_evidence(rows, best, chunks)
    assert sorted(map(str, found.collect())) == want
    # No aggregate holds a text.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any("text" in line for line in plan.splitlines() if "Aggregate" in line)
