import math
from collections import defaultdict

import numpy as np
import pytest

from tracewell.llm import ann, neardup_vectors
from tracewell.llm.neardup_vectors import Tile, tile_links

KIND = "vec_id long, embedding array<float>, label int, rep string, copies int"


def vectors(seed=1, n=300, width=16):
    """Clusters at all cosines around the threshold, copies, scaled copies and unusable vectors."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 3 and rows:
            base = np.array(rows[rng.integers(len(rows))][1])
            v = base + rng.normal(size=width) * rng.uniform(0, 0.5) * np.linalg.norm(base) / math.sqrt(width)
        else:
            v = rng.normal(size=width)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    rows += [(n + i, rows[4][1], rows[4][2]) for i in range(9)]
    rows += [(n + 20, [2 * x for x in rows[4][1]], rows[4][2]), (n + 21, rows[4][1], None)]
    odd = [None, [], [0.0] * width, [float("nan")] * width, [float("inf")] * width, [None] * width, [1.0, 2.0]]
    rows += [(n + 30 + i, v, 0) for i, v in enumerate(odd)]
    return rows


def good(v, width=16):
    return bool(v) and len(v) == width and all(x is not None and math.isfinite(x) for x in v) and any(v)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], KIND)


def brute_links(rows, least):
    links = defaultdict(set)
    for i, (a, v, label) in enumerate(rows):
        for b, w, other in rows[:i]:
            if label is not None and label == other and good(v) and good(w):
                if neardup_vectors.exact_cosine(np.array(v), np.array(w)) >= least:
                    links[a].add(b)
                    links[b].add(a)
    return links


@pytest.mark.parametrize("tile, block", [(2048, 512), (7, 3)])
def test_near_duplicates(spark, monkeypatch, tile, block):
    monkeypatch.setattr(neardup_vectors, "TILE", tile)
    monkeypatch.setattr(neardup_vectors, "BLOCK", block)
    rows = vectors()
    links = brute_links(rows, 0.93)
    want = {}
    for a, _, _ in sorted(rows, key=lambda r: r[0]):
        stack = [a] if a not in want else []
        while stack:
            at = stack.pop()
            if at not in want:
                want[at] = a
                stack += links[at]
    out = neardup_vectors.near_duplicates(table(spark, rows)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out} == {
        a: (len(links[a]), want[a], a == want[a]) for a, _, _ in rows
    }
    assert len(out) == len(rows) and any(links.values())


def test_tile_links_are_all_pairs():
    rng = np.random.default_rng(2)
    raw = rng.normal(size=(80, 40))
    raw[40:] = raw[:40] + rng.normal(size=(40, 40)) * 0.3
    axes = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    found = {(a, b) for at, to in tile_links(Tile(raw, axes), Tile(raw, axes), 0.9, True) for a, b in zip(at, to)}
    want = {(i, j) for i in range(80) for j in range(i) if neardup_vectors.exact_cosine(raw[i], raw[j]) >= 0.9}
    assert found == want and want


def test_repeats_and_empty(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)]
    out = neardup_vectors.near_duplicates(table(spark, rows)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out), key=repr) == [
        (1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (None, 0, None, False)
    ]
    assert neardup_vectors.near_duplicates(table(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("shard, block", [(8192, 2048), (60, 10)])
def test_nearest_recall_and_order(spark, monkeypatch, shard, block):
    monkeypatch.setattr(ann, "SHARD", shard)
    monkeypatch.setattr(ann, "BLOCK", block)
    rows = vectors(3, 600)
    df = table(spark, rows)
    out = ann.nearest(df, df.where("vec_id % 20 = 0")).collect()
    by_query = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        by_query[r.query_id].append((r.score, r.vec_id))
    usable = {a: np.array(v) for a, v, _ in rows if good(v)}
    hits = total = 0
    assert set(by_query) == {a for a in usable if a % 20 == 0}
    for q, found in by_query.items():
        exact = sorted((float(np.sqrt(((v - usable[q]) ** 2).sum())), a) for a, v in usable.items() if a != q)
        assert len(found) == 10 and found == sorted(found)
        assert all(score == pytest.approx(float(np.sqrt(((usable[a] - usable[q]) ** 2).sum()))) for score, a in found)
        hits += len({a for _, a in found} & {a for _, a in exact[:10]})
        total += 10
    assert hits / total >= 0.9


def test_nearest_few_rows_ties_and_empty(spark):
    rows = [(i, [1.0, float(i % 2)], 0) for i in range(5)] + [(3, [1.0, 1.0], 0), (9, None, 0)]
    df = table(spark, rows)
    out = [(r.rank, r.vec_id) for r in ann.nearest(df, df.where("vec_id = 1")).orderBy("rank").collect()]
    assert out == [(1, 3), (2, 3), (3, 0), (4, 2), (5, 4)]
    assert ann.nearest(df.limit(0), df.limit(0)).collect() == []
    assert ann.nearest(df, df.where("vec_id = 9")).collect() == []


def test_ball_is_whole():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 2**32, (400, 3), dtype=np.uint32)
    index = ann.MultiIndex(codes)
    for radius in (0, 1, 5, 9, 35, 40, 96):
        for code in np.concatenate([codes[:20], codes[:5] ^ 1]):
            want = np.flatnonzero(np.bitwise_count(codes ^ code).sum(axis=1) <= radius)
            assert (index.ball(code, radius) == want).all()


def test_every_length_is_compared_with_itself(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16)], 0) for i in range(30)]
    base = rng.normal(size=5)
    near = [[float(np.float32(x)) for x in base * (1 + 0.01 * i)] for i in range(1, 5)]
    near = [[v[0] + 0.001 * i, *v[1:]] for i, v in enumerate(near)]
    rows += [(100 + i, v, 0) for i, v in enumerate(near)] + [(200, [1.0], 0), (201, [2.0], 0)]
    out = {r.vec_id: r for r in neardup_vectors.near_duplicates(table(spark, rows)).collect()}
    assert len(out) == len(rows)
    assert [(out[100 + i].n_links, out[100 + i].component_id) for i in range(4)] == [(3, 100)] * 4
    assert [(out[i].n_links, out[i].component_id) for i in (200, 201)] == [(1, 200)] * 2
    df = table(spark, rows)
    found = ann.nearest(df, df, 3).collect()
    short = {(r.query_id, r.vec_id) for r in found if 100 <= r.query_id < 200}
    assert short == {(100 + i, 100 + j) for i in range(4) for j in range(4) if i != j}
    assert {(r.query_id, r.rank, r.vec_id) for r in found if r.query_id >= 200} == {(200, 1, 201), (201, 1, 200)}


def test_few_rows_are_ranked_by_floats():
    """Of random directions, the hardest case, the learned ball holds nearly all neighbours and few other rows."""
    rng = np.random.default_rng(11)
    rows = rng.normal(size=(3000, 64))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    coder = ann.learn_coder(rows)
    codes = coder.codes(rows)
    index, hits, ranked, probed = ann.MultiIndex(codes), 0, 0, 0
    for q in range(0, 3000, 60):
        near = np.argsort(((rows - rows[q]) ** 2).sum(axis=1), kind="stable")[1:11]
        ball = index.ball(codes[q], coder.radius)
        hits += np.isin(near, ball).sum()
        ranked += len(ball)
        probed += len(index.probed(codes[q], coder.radius))
    assert hits / 500 >= 0.9 and ranked / 150_000 < 0.1 and probed / 150_000 < 0.8
