"""Search against brute force written from the score definitions."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.functions.hashing import blake2b_bucket, md5_bucket, vocabulary_buckets
from tracewell.operators import kernel, search, terms
from tracewell.operators.dense import dense_search, embed_with
from tracewell.operators.kernel import best_cells
from tracewell.operators.ranking import hybrid_weights, share_of_max
from tracewell.operators.terms import chunk_terms, invalid_queries
from tracewell.sources.chunks import read_term_index, write_term_index
from tracewell.tables.words import STOP_WORDS

TEXTS = {
    "c1": ("Intake rules", "Vomiting review", "vomiting after dose vomiting vomiting vomiting", "sop"),
    "c2": ("Device guide", "Pen clicks", "pen clicks and leaking pen device", "sop"),
    "c3": ("Intake rules", "Storage", "storage of the pen in a cold room", "other"),
    "c4": ("Misc", "Other", "nothing shared here", "sop"),
    "c5": ("Device guide", "Pen clicks", "pen clicks and leaking pen device", "sop"),
}
QUERIES = {"q1": "vomiting after the pen dose pen", "q2": "Device leaking!", "q3": "the of and", "q4": "absent words only"}


def words(text):
    return [t for t in re.findall("[a-z0-9]+", text.lower()) if len(t) > 1 and t not in STOP_WORDS]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(k, k.upper(), *v) for k, v in TEXTS.items()]
    return spark.createDataFrame(rows, "chunk_id string, source_id string, source_title string, section_heading string, text string, source_type string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(list(QUERIES.items()), "query_id string, query_text string")


@pytest.fixture(scope="module")
def buckets(spark):
    vocabulary = {w for t, h, x, _ in TEXTS.values() for w in words(f"{t} {h} {x}")} | {w for q in QUERIES.values() for w in words(q)}
    df = spark.createDataFrame([(w,) for w in vocabulary], "term string")
    return {r.term: r.b for r in df.select("term", md5_bucket(F.col("term"), 16).alias("b")).collect()}


def keyword(query, chunk):
    title, heading, text, _ = TEXTS[chunk]
    asked, held = Counter(words(QUERIES[query])), Counter(words(f"{title} {heading} {text}"))
    score = 0.0
    for term, n in asked.items():
        if held[term]:
            score += n * min(held[term], 3) + 2 * (term in words(title)) + (term in words(heading))
    return score, sorted(set(asked) & set(held))


def cosine(query, chunk, buckets):
    title, heading, text, _ = TEXTS[chunk]
    a = Counter(buckets[w] for w in words(QUERIES[query]))
    b = Counter(buckets[w] for w in words(f"{title} {heading} {text}"))
    norm = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
    return sum(a[k] * b[k] for k in a) / norm if norm else 0.0


def expected(score, k, only=None):
    out = {}
    for q in QUERIES:
        scored = [(c, score(q, c)) for c in TEXTS if only is None or TEXTS[c][3] == only]
        out[q] = [(c, round(s, 9)) for c, s in sorted(((c, s) for c, s in scored if s > 0), key=lambda x: (-x[1], x[0]))[:k]]
    return out


def got(df):
    out = {q: [] for q in QUERIES}
    for r in sorted(df.select("query_id", "rank", "chunk_id", "score").collect()):
        out[r.query_id].append((r.chunk_id, round(r.score, 9)))
    return out


@pytest.mark.parametrize("k,only", [(2, None), (5, "sop")])
def test_keyword(queries, chunks, k, only):
    found = search.keyword_search(queries, chunks, k, only)
    assert got(found) == expected(lambda q, c: keyword(q, c)[0], k, only)
    for r in found.collect():
        assert r.matched_terms == keyword(r.query_id, r.chunk_id)[1]


def test_vector(queries, chunks, buckets):
    found = search.vector_search(queries, chunks, 3, dims=16)
    assert got(found) == expected(lambda q, c: cosine(q, c, buckets), 3)


def test_hybrid_normalises_over_all_candidates(queries, chunks, buckets):
    def score(q, c):
        kw = max(keyword(q, x)[0] for x in TEXTS)
        vec = max(cosine(q, x, buckets) for x in TEXTS)
        return 0.65 * (keyword(q, c)[0] / kw if kw else 0) + 0.35 * (cosine(q, c, buckets) / vec if vec else 0)

    assert got(search.hybrid_search(queries, chunks, 2, dims=16)) == expected(score, 2)


def test_hybrid_with_keyword_weight_only_orders_like_keyword(queries, chunks):
    a = got(search.hybrid_search(queries, chunks, 5, keyword_weight=1, vector_weight=0))
    b = got(search.keyword_search(queries, chunks, 5))
    assert {q: [c for c, _ in v] for q, v in a.items()} == {q: [c for c, _ in v] for q, v in b.items()}


def test_blocks_and_slices_change_nothing(queries, chunks, monkeypatch):
    whole = got(search.keyword_search(queries, chunks, 3))
    monkeypatch.setattr(search, "STATE_BYTES", 300)  # more blocks than queries, so some are empty
    monkeypatch.setattr(kernel, "SLICE_CELLS", 3)
    assert got(search.keyword_search(queries, chunks, 3)) == whole


def test_stored_index(spark, queries, chunks, tmp_path):
    write_term_index(chunks, str(tmp_path / "index"))
    index = read_term_index(spark, str(tmp_path / "index"))
    found = search.keyword_search(queries, chunks, 5, "sop", index=index)
    plain = search.keyword_search(queries, chunks, 5, "sop")
    assert got(found) == got(plain)
    matched = lambda df: {(r.query_id, r.chunk_id): r.matched_terms for r in df.collect()}
    assert matched(found) == matched(plain)


@pytest.mark.parametrize("state", [search.STATE_BYTES, 300])
@pytest.mark.parametrize("run", [search.keyword_search, search.vector_search, search.hybrid_search])
def test_empty_blocks_and_no_queries(queries, chunks, monkeypatch, state, run):
    whole = run(queries, chunks, 3)
    monkeypatch.setattr(search, "STATE_BYTES", state)
    found = run(queries, chunks, 3)
    assert found.columns == whole.columns and got(found) == got(whole)
    none = run(queries.limit(0), chunks, 3)
    assert none.columns == whole.columns and none.collect() == []


def test_tasks_return_k_rows_per_query(spark, queries, monkeypatch):
    rows = [(f"c{n:04d}", "s", "t", "h", f"pen dose {n}", "sop") for n in range(400)]
    names = "chunk_id string, source_id string, source_title string, section_heading string, text string, source_type string"
    many = spark.createDataFrame(rows, names).repartition(3)
    monkeypatch.setattr(kernel, "SLICE_CELLS", 20)
    rows = search.best_rows(terms.query_features(queries), terms.chunk_features(many).select("chunk_id", "terms"), "keyword", 2)
    assert 0 < rows.count() <= len(QUERIES) * 2 * 3
    best = sorted(r.chunk_id for r in search.keyword_search(queries, many, 2).filter("query_id = 'q1'").collect())
    assert best == ["c0000", "c0001"]


def test_running_best_equals_one_sort():
    rng = np.random.default_rng(0)
    best, all_rows = kernel.RunningBest(3, 4), []
    best.limit = 10
    for _ in range(30):
        q, score, ids = rng.integers(0, 3, 9), rng.integers(0, 6, 9).astype(float), rng.integers(0, 10**6, 9)
        all_rows += list(zip(q.tolist(), (-score).tolist(), ids.tolist()))
        best.add(pa.table({"query": q, "chunk_id": ids, "score": score, "matched_terms": [[]] * 9}))
    kept = best.prune().to_pylist()
    want = [r for q in range(3) for r in sorted(r for r in all_rows if r[0] == q)[:4]]
    assert [(r["query"], -r["score"], r["chunk_id"]) for r in kept] == want


def test_supplied_vectors_and_buckets(spark, queries, chunks):
    rng = np.random.default_rng(1)
    held = {c: rng.normal(size=5) for c in TEXTS if c != "c4"}
    asked = {q: rng.normal(size=5) for q in QUERIES if q != "q4"}
    as_table = lambda d, n: spark.createDataFrame([(k, v.tolist()) for k, v in d.items()], f"{n} string, vector array<double>")
    given = {"vectors": as_table(held, "chunk_id"), "query_vectors": as_table(asked, "query_id")}

    def cos(q, c):
        if q not in asked or c not in held:
            return 0.0
        return float(asked[q] @ held[c] / np.linalg.norm(asked[q]) / np.linalg.norm(held[c]))

    assert got(search.vector_search(queries, chunks, 3, **given)) == expected(cos, 3)

    def score(q, c):
        kw = max(keyword(q, x)[0] for x in TEXTS)
        vec = max(0.0, *(cos(q, x) for x in TEXTS))
        return 0.65 * (keyword(q, c)[0] / kw if kw else 0) + 0.35 * (cos(q, c) / vec if vec else 0)

    # A chunk with one positive score is a candidate, even where a negative cosine pulls its sum below zero.
    want = {}
    for q in QUERIES:
        listed = [(c, score(q, c)) for c in TEXTS if keyword(q, c)[0] > 0 or cos(q, c) > 0]
        want[q] = sorted(listed, key=lambda x: (-x[1], x[0]))[:4]
    found = got(search.hybrid_search(queries, chunks, 4, **given))
    for q in QUERIES:
        assert [c for c, _ in found[q]] == [c for c, _ in want[q]]
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in want[q]], abs=1e-5)
    with pytest.raises(ValueError, match="chunks and queries"):
        search.vector_search(queries, chunks, 3, vectors=given["vectors"])

    vocabulary = terms.chunk_terms(chunks).select("term").union(terms.query_terms(queries).select("term"))
    table = vocabulary_buckets(vocabulary, 16)
    where = {r.term: r.bucket for r in table.collect()}
    found = search.vector_search(queries, chunks, 3, dims=16, buckets=table)
    assert got(found) == expected(lambda q, c: cosine(q, c, where), 3)


def test_scores_of_all_candidates(queries, chunks, buckets):
    pairs = {(r.query_id, r.chunk_id): r for r in search.hybrid_search(queries, chunks, 9, dims=16).collect()}
    for q in QUERIES:
        for c in TEXTS:
            want = keyword(q, c)[0], cosine(q, c, buckets)
            row = pairs.get((q, c))
            have = (row.keyword_score, row.vector_score) if row else (0.0, 0.0)
            assert have == pytest.approx(want)


def test_chunk_terms_count_heading_words_twice(chunks):
    rows = {(r.chunk_id, r.term): r for r in chunk_terms(chunks).collect()}
    assert rows["c2", "pen"].dcount == 3 and rows["c2", "pen"].in_heading and not rows["c2", "pen"].in_title


def test_arguments(queries, chunks):
    with pytest.raises(ValueError, match="top_k"):
        search.keyword_search(queries, chunks, 0)
    with pytest.raises(ValueError, match="searchable"):
        search.keyword_search(queries, chunks, 5, strict=True)
    with pytest.raises(ValueError, match="dimensions"):
        search.vector_search(queries, chunks, 5, dims=0)
    for bad in ((-1, 1), (1, -1), (0, 0)):
        with pytest.raises(ValueError):
            hybrid_weights(*bad)
    assert hybrid_weights(2, 2) == (0.5, 0.5)
    assert [r.query_id for r in invalid_queries(queries).collect()] == ["q3"]


def test_best_cells_breaks_ties_by_position():
    import numpy as np

    q, c = best_cells(np.array([[1.0, 3.0, 3.0, 3.0], [0.0, 0.0, 0.0, 2.0]]), 2)
    assert list(zip(q.tolist(), c.tolist())) == [(0, 1), (0, 2), (1, 3)]


def test_share_of_max(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(share_of_max(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0]


def test_blake2b_bucket_matches_the_definition(spark):
    import hashlib

    df = spark.createDataFrame([("pen",), ("dose",)], "t string")
    for r in df.select("t", blake2b_bucket(F.col("t"), 128).alias("b")).collect():
        assert r.b == int.from_bytes(hashlib.blake2b(r.t.encode(), digest_size=8).digest(), "big") % 128


def test_dense_search_and_embedding_adapter(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])], "chunk_id string, vector array<double>")
    embed = embed_with(lambda texts: [[float(len(t)), 0.0] for t in texts])
    asked = spark.createDataFrame([("q", "abc")], "query_id string, t string").select("query_id", embed(F.col("t")).alias("vector"))
    found = dense_search(asked, vectors, 2).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in found] == [("a", 1.0), ("b", 0.707107)]
    with pytest.raises(ValueError, match="dimensions"):
        dense_search(spark.createDataFrame([("q", [1.0])], "query_id string, vector array<double>"), vectors, 2)


@pytest.mark.parametrize("limit", [search.BROADCAST_BYTES, 300])
def test_totals_over_all_candidates(queries, chunks, buckets, monkeypatch, limit):
    monkeypatch.setattr(search, "BROADCAST_BYTES", limit)  # small: several blocks of queries
    monkeypatch.setattr(kernel, "SLICE_CELLS", 3)
    found = {r.query_id: list(r)[1:] for r in search.candidate_totals(queries, chunks, dims=16).collect()}
    want = {}
    for q in QUERIES:
        pairs = [p for p in ((keyword(q, c)[0], cosine(q, c, buckets)) for c in TEXTS) if max(p) > 0]
        if pairs:
            first, second = zip(*pairs)
            want[q] = [len(pairs), max(first), max(second), sum(first), sum(second)]
    assert found.keys() == want.keys()
    for q in want:
        assert found[q] == pytest.approx(want[q])
    found = {r.chunk_id: tuple(r)[1:] for r in search.keyword_totals(queries, chunks).collect()}
    scored = {c: [s for s in (keyword(q, c)[0] for q in QUERIES) if s] for c in TEXTS}
    assert found == {c: (len(s), sum(s), max(s)) for c, s in scored.items() if s}


@pytest.mark.parametrize("name", ["J3_W2_hybrid_candidates", "A2_keyword_score"])
def test_registered_totals_pass_rank_20(spark, tmp_path, name):
    from workload import retrieval  # noqa: F401
    from workload.registry import QUERIES as registered

    docs = [(n, f"pen dose {n}\nline", "en", "src1", 10) for n in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "pen dose")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = registered[name](spark, str(tmp_path)).collect()
    assert sum(r.candidates if name.startswith("J3") else r.queries for r in rows) == 60


def test_a_task_holds_few_cells_and_whole_scores():
    import tracemalloc

    rng = np.random.default_rng(3)
    words_ = [f"w{n}" for n in range(60)]
    asked = [sorted(rng.choice(60, 40, replace=False).tolist()) for _ in range(400)]
    counts = [rng.integers(1, 4, 40).tolist() for _ in asked]
    held = [sorted(rng.choice(60, 45, replace=False).tolist()) for _ in range(500)]
    weights, bonuses = ([rng.integers(low, 4, 45).astype(float).tolist() for _ in held] for low in (1, 0))
    terms_ = [[{"term": words_[t], "cnt": n} for t, n in zip(*q)] for q in zip(asked, counts)]
    entries = [[{"term": words_[t], "weight": w, "bonus": b} for t, w, b in zip(*c)] for c in zip(held, weights, bonuses)]

    class Rows:
        def toArrow(self):
            return pa.table({"query_id": list(range(400)), "terms": terms_})

    class Shipped:
        value = kernel.collect_block(Rows())

    batch = pa.record_batch({"chunk_id": [f"c{n:03d}" for n in range(500)], "terms": entries})
    tracemalloc.start()
    got_ = [r for b in kernel.scorer(Shipped, "keyword", 3)(iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    scores = np.zeros((400, 500))
    for q in range(400):
        n = dict(zip(asked[q], counts[q]))
        for c in range(500):
            scores[q, c] = sum(n[t] * w + b for t, w, b in zip(held[c], weights[c], bonuses[c]) if t in n)
    want = {(q, f"c{c:03d}"): scores[q, c] for q in range(400) for c in np.lexsort((np.arange(500), -scores[q]))[:3]}
    assert {(r["query_id"], r["chunk_id"]): r["score"] for r in got_} == want
    for r in got_[::50]:
        both = set(asked[r["query_id"]]) & set(held[int(r["chunk_id"][1:])])
        assert r["matched_terms"] == sorted(words_[t] for t in both)
