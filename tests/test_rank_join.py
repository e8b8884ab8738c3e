"""The rank join of hybrid search against sums over all chunks."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import rank_join, search
from tracewell.operators.search import candidate_totals, hybrid_search, keyword_search, vector_search

KIND = "chunk_id string, source_title string, section_heading string, source_type string, text string"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.8)) % 200}" for _ in range(3000)]
    rows = [(f"c{i:03}", "t", None, "sop", " ".join(rng.choices(words, k=rng.choice([0, 2, 8, 60])))) for i in range(220)]
    rows += [(f"same{i}", "t", None, "sop", "w1 w2 w3") for i in range(30)]
    asked = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 9])))) for i in range(20)] + [(50, "nowhere"), (51, None)]
    return spark.createDataFrame(rows, KIND), spark.createDataFrame(asked, "query_id long, query_text string")


def brute(chunks, asked, k, weights):
    """Both scores of every pair, then the sums."""
    pairs = {}
    for n, found in enumerate((keyword_search(asked, chunks, 1000), vector_search(asked, chunks, 1000))):
        for r in found.select("query_id", "chunk_id", "score").collect():
            pairs.setdefault(r.query_id, {}).setdefault(r.chunk_id, [0.0, 0.0])[n] = r.score
    out = []
    for q, chunks_of in pairs.items():
        tops = [max(s[n] for s in chunks_of.values()) for n in (0, 1)]
        sums = [(-sum(w * (s[n] / tops[n] if tops[n] > 0 else 0) for n, w in enumerate(weights)), c) for c, s in chunks_of.items()]
        out += [(q, rank + 1, c, round(-total, 9)) for rank, (total, c) in enumerate(sorted(sums)[:k])]
    return sorted(out)


@pytest.mark.parametrize("rows", [2, 64])
def test_same_rows_whatever_the_lists_hold(tables, monkeypatch, rows):
    chunks, asked = tables
    monkeypatch.setattr(search, "list_length", lambda k: rows)
    for k, weights in ((5, (0.65, 0.35)), (40, (0.0, 1.0))):
        found = hybrid_search(asked, chunks, k, keyword_weight=weights[0], vector_weight=weights[1])
        got = [(r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in found.collect()]
        assert sorted(got) == brute(chunks, asked, k, weights), (k, weights)


def test_threshold_decides(spark):
    lists = [
        (1, 0, "a", 10.0, 10.0, 0.9), (1, 0, "b", 9.0, 9.0, 0.2), (1, 1, "a", 0.9, 10.0, 0.9), (1, 1, "c", 0.5, 1.0, 0.5),
        (2, 0, "a", 5.0, 5.0, 0.0), (2, 0, "b", 5.0, 5.0, 0.1), (2, 1, "c", 0.8, 0.0, 0.8), (2, 1, "d", 0.8, 0.0, 0.8),
        (3, 1, "a", 0.3, 0.0, 0.3),
    ]
    kind = "query_id int, list int, chunk_id string, score double, keyword_score double, vector_score double"
    df = spark.createDataFrame(lists, kind).withColumn("matched_terms", F.array().cast("array<string>"))
    best, asked = rank_join.joined_ranks(df, 1, 2, (0.5, 0.5))
    assert {r.query_id: (r.chunk_id, round(r.score, 6)) for r in best.collect()} == {1: ("a", 1.0), 2: ("b", 0.5625), 3: ("a", 0.5)}
    # Query 1: its best sum is over that of the last scores; 2: an unseen chunk could have both; 3: the list ended.
    assert {r.query_id: r.certain for r in asked.collect()} == {1: True, 2: False, 3: True}


def test_normalisers_are_those_of_all_candidates(tables):
    chunks, asked = tables
    totals = {r.query_id: (r.best_keyword, r.best_vector) for r in candidate_totals(asked, chunks).collect()}
    found = hybrid_search(asked, chunks, 1).collect()
    for r in found:
        keyword, vector = totals[r.query_id]
        want = 0.65 * (r.keyword_score / keyword if keyword else 0) + 0.35 * (r.vector_score / vector if vector else 0)
        assert r.score == pytest.approx(want)
