import hashlib
import random
import re
from collections import defaultdict

import pytest

from tests.llm.data import documents
from tracewell.llm import mixing


def targets(sizes: dict, weights=(3, 1, 2), share=1.5, most=2):
    """Shares by weight; what exceeds a cap is shared again until none exceeds."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, left = {}, set(names)
    budget = share * sum(sizes.values())
    while left:
        rest = budget - sum(fixed.values())
        level = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if level[s] > most * sizes[s]}
        if not over:
            return {**fixed, **level}
        fixed |= {s: most * sizes[s] for s in over}
        left -= over
    return fixed


@pytest.mark.parametrize("per_bucket", [20_000, 3])
def test_mix(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", per_bucket)
    docs = documents(spark)
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in out:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.passes * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    want = targets(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    # The cut falls inside one document of each source, and the last one leaves room for no more.
    biggest = 2 * max(largest.values())
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    again = {(r.doc_id, r.size): r.taken for r in mixing.mix_sizes(docs).collect()}
    assert again == {(r.doc_id, r.size): r.taken for r in out}


def test_documents_of_the_mix(spark):
    docs = documents(spark)
    want = defaultdict(int)
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.text] += r.passes
    got = defaultdict(int)
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns
    for r in rows.collect():
        got[r.doc_id, r.text] += 1
    assert got == {k: v for k, v in want.items() if v}


def test_hot_source_and_small_ones(spark):
    rows = [(i, "w " * (1 + i % 7), "hot") for i in range(300)] + [(1000 + i, "x y z", f"s{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    sums = defaultdict(int)
    for r in out:
        sums[r.source] += r.taken
    want = {r.source: r.target for r in out}
    assert all(abs(sums[s] - want[s]) <= 7 for s in want)


def test_no_words_and_no_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(docs).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mixed_documents(docs).collect() == []
    assert mixing.mix(docs.limit(0)).collect() == [] and mixing.mixed_documents(docs.limit(0)).collect() == []


def brute_passes(rows, weights=(3, 1, 2), share=1.5, most=2):
    """How often the mix takes each (doc_id, source): entries by finish time, as long as the budget holds them all."""
    words = {(d, s): n for d, s, n in rows}
    sizes = defaultdict(int)
    for (_, s), n in words.items():
        sizes[s] += n
    want = targets(sizes, weights, share, most)
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    entries = []
    for rank, s in enumerate(names):
        own = sorted((int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16), d) for d, x in words if x == s)
        sent = 0
        for n in range(most if want[s] else 0):
            sent = 0
            for key, d in own:
                sent += words[d, s]
                entries.append(((n * sizes[s] + sent) / want[s], rank, n, key, d, s))
    taken, used = dict.fromkeys(words, 0), 0
    for _, _, _, _, d, s in sorted(entries):
        used += words[d, s]
        if used > share * sum(sizes.values()):
            break
        taken[d, s] += 1
    return taken


TIED = [
    (740122, "a", 2), (740123, "a", 2), (740124, "a", 5), (740125, "a", 0), (740126, "a", 3),
    (740127, "b", 0), (740128, "b", 5), (740129, "b", 2), (740130, "b", 1), (740131, "b", 0),
]


@pytest.mark.parametrize("seed", [None, 0, 1, 2, 3, 4, 5])
def test_passes_of_every_document(spark, seed):
    """Texts without words tie with their neighbours; the cut between the passes must not count them wrongly."""
    rng = random.Random(seed)
    rows = TIED if seed is None else [
        (rng.randrange(10**6) * 40 + i, rng.choice(["a", "b", None]), rng.choice([0, 0, 1, 2, 3, 9])) for i in range(rng.choice([6, 30]))
    ]
    docs = spark.createDataFrame([(d, s, "w " * n) for d, s, n in rows], "doc_id long, source string, text string")
    assert {(r.doc_id, r.source): r.passes for r in mixing.mix(docs).collect()} == brute_passes(rows)


def test_very_long_text(spark):
    rows = [(1, "a", "word " * 400_000), (2, "a", "x"), (3, "b", "y z")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {(r.doc_id, r.source): (r.size, r.passes) for r in mixing.mix(docs).collect()}
    want = brute_passes([(1, "a", 400_000), (2, "a", 1), (3, "b", 2)])
    assert got == {k: ({1: 400_000, 2: 1, 3: 2}[k[0]], n) for k, n in want.items()}
