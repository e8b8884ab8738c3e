import random
from collections import defaultdict

import numpy as np

from tests.llm.data import documents
from tracewell.llm import linededup
from tracewell.llm.linededup import NO_ID, LineShard, MinimalHash


def key_of(line):
    key = line.strip(" \t\n\r\v\f")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in key) if len(key) >= 10 else None


def brute(rows):
    """rows: (doc_id, text); the wanted (text, n_lines, n_dropped) of each."""
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if (key := key_of(line)) is not None:
                holders[key].add(NO_ID if doc is None else doc)
    out = []
    for doc, text in rows:
        ident, lines = NO_ID if doc is None else doc, (text or "").split("\n")
        kept = [x for x in lines if (k := key_of(x)) is None or len(holders[k]) < 2 or min(holders[k]) == ident]
        out.append((doc, text if len(kept) == len(lines) else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def in_order(rows):
    return sorted(rows, key=repr)


def test_minimal_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 17, 5000):
        h1, h2 = rng.integers(0, 2**63, n, np.uint64), rng.integers(0, 2**63, n, np.uint64)
        h1[: n // 2] = 5  # equal first halves are told apart by the second
        slots = MinimalHash.build(h1, h2).slots(h1, h2)
        assert sorted(slots.tolist()) == list(range(n))
        first, last = np.arange(n), np.arange(n) + np.arange(n) % 2
        shard = LineShard.from_row(LineShard.build(h1, h2, first, last).to_row())
        repeated, owner = shard.owner(h1, h2)
        assert (repeated == (first != last)).all() and (owner[repeated] == first[repeated]).all()
        other = rng.integers(0, 2**63, 100, np.uint64)
        assert not shard.owner(other, other)[0].any()


def test_against_brute_force(spark):
    docs = documents(spark)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    for share in (linededup.HOT_SHARE, 20):
        linededup_share, linededup.HOT_SHARE = linededup.HOT_SHARE, share
        out = linededup.dedup_lines(docs, shards=3)
        linededup.HOT_SHARE = linededup_share
        assert out.columns == [*(c for c in docs.columns if c != "text"), "text", "n_lines", "n_dropped"]
        assert in_order((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()) == in_order(want)


def test_random_lines_and_hot_line(spark):
    rng = random.Random(5)
    pool = [f"a line with number {i}" for i in range(40)] + ["Short", "\t A LINE WITH NUMBER 1 ", ""]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(9)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = linededup.dedup_lines(docs).collect()
    assert in_order((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out) == in_order(brute(rows))
    assert linededup.dedup_lines(docs.limit(0)).collect() == []


def test_shards_follow_the_lines(spark, monkeypatch):
    rows = [(i, "\n".join(f"a line with number {k}" for k in range(i, i + 20))) for i in range(0, 400, 10)] + [(999, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert linededup.measured_lines(docs) == (41, 800)
    seen, index = [], linededup.line_index
    monkeypatch.setattr(linededup, "line_index", lambda d, shards, *more: seen.append(shards) or index(d, shards, *more))
    for most in (linededup.SHARD_LINES, 10):
        monkeypatch.setattr(linededup, "SHARD_LINES", most)
        out = linededup.dedup_lines(docs).collect()
        assert in_order((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out) == in_order(brute(rows))
    assert seen == [4, 80]
