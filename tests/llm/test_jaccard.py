import random
import time
from collections import defaultdict

import pyarrow as pa
import pytest

from tests.llm.data import documents, prose
from tracewell.llm import jaccard
from tracewell.llm.components import components
from tracewell.llm.jaccard import Forest, SetTree


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """doc_id -> (sizes, component) by comparing all pairs; rows with equal ids are one document."""
    rows = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows if d is not None}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if None not in (a, b) and x and y and 100 * len(x & y) >= 75 * len(x | y):
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return sorted(((d, len(x), None if d is None else find(d)) for d, x in rows), key=repr)


def result(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()), key=repr)


def test_edge_cases(spark):
    docs = documents(spark)
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert result(docs.limit(0)) == []


@pytest.mark.parametrize("part", [2048, 4])
def test_near_copies(spark, monkeypatch, part):
    monkeypatch.setattr(jaccard, "PART", part)
    rng, rows = random.Random(2), []
    for group in range(6):
        words = prose(group, 60 + 25 * group).split()
        for _ in range(14):
            own = list(words)
            for _ in range(rng.randrange(6)):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(3)] = [f"new{rng.randrange(10**6)}"] * rng.randrange(1, 3)
            rows.append((len(rows), " ".join(own)))
    shared = prose(77, 40)
    rows += [(len(rows) + i, shared + " " + prose(300 + i, 50)) for i in range(10)]
    rows += [(len(rows) + i, " ".join(prose(77, 40).split()[i:])) for i in range(0, 9)]
    rng.shuffle(rows)
    want = brute(rows)
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == want
    assert len({c for _, _, c in want}) < len(rows)


def test_tree_finds_what_pairs_find():
    rng = random.Random(9)
    sets = []
    for i in range(150):
        base = list(range(rng.randrange(5) * 7, 40))
        sets.append((i, sorted(x for x in base if rng.random() > 0.15), rng.randrange(4)))
    tree = SetTree()
    for key, ranked, more in sets[:100]:
        tree.add(key, len(ranked) + more, ranked)
    for key, ranked, more in sets:
        size = len(ranked) + more
        linked = {
            k
            for k, other, extra in sets[:100]
            if k != key and 7 * len(set(ranked) & set(other)) >= 3 * (size + len(other) + extra)
        }
        found = tree.first_link(size, {s: i for i, s in enumerate(ranked)}, key)
        assert found in linked if linked else found is None
    assert sorted(m[0] for m in tree.members()) == list(range(100))


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)]
    edges += [(500 + i, 500) for i in range(60)] + [(7, 7), (None, 3), (3, None), (41, 40)]
    near = defaultdict(set)
    for a, b in edges:
        if None not in (a, b):
            near[a].add(b)
            near[b].add(a)
    want, seen = {}, set()
    for node in sorted(near):
        stack = [node] if node not in seen else []
        while stack:
            at = stack.pop()
            if at not in seen:
                seen.add(at)
                want[at] = node
                stack += near[at]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == {k: v for k, v in want.items() if k != v}
    assert components(df.limit(0)).collect() == []


def test_forest_joins_what_pairs_join():
    rng = random.Random(12)
    for _ in range(20):
        sets = [sorted({rng.randrange(12 * (1 + g)) for _ in range(rng.randrange(1, 14))}) for g in range(60)]
        # The order of a real run: shingles by how many sets hold them.
        held = defaultdict(int)
        for own in sets:
            for s in own:
                held[s] += 1
        ranked = [sorted((s for s in own if held[s] > 1), key=lambda s: (held[s], s)) for own in sets]
        forest, root = Forest(), list(range(len(sets)))

        def find(a):
            while root[a] != a:
                a = root[a]
            return a

        for i, own in enumerate(sets):
            before = {find(j) for j in range(i) if 7 * len(set(own) & set(sets[j])) >= 3 * (len(own) + len(sets[j]))}
            found = forest.link(i, len(own), ranked[i])
            assert {find(j) for j in found} == before and len(found) == len(before)
            for c in before:
                root[c] = i


def test_unlinked_sets_do_not_meet():
    """Sets that share one frequent shingle and have no link: twice as many take about twice as long."""
    took = {}
    for n in (1000, 4000):
        forest, start = Forest(), time.perf_counter()
        for i in range(n):
            # Rare shingles, held by two sets each, come first; the one that all hold comes last.
            forest.link(i, 21, [10 + (i // 2) * 20 + k if k % 2 else -(10 + ((i + 1) // 2) * 20 + k) for k in range(20)] + [1])
        took[n] = time.perf_counter() - start
    assert took[4000] < 8 * max(took[1000], 0.05)


def test_unlinked_sets_are_compared_at_once(monkeypatch):
    """Sets that share rare shingles and have no link walk no tree one by one."""
    walks, walk = [], SetTree.first_link
    monkeypatch.setattr(SetTree, "first_link", lambda self, *rest: walks.append(1) or walk(self, *rest))
    rng, forest = random.Random(6), Forest()
    for i in range(300):
        own = list(range(60)) + [rng.getrandbits(62) for _ in range(40)]
        assert forest.link(i, 100, own) == []
    assert len(walks) < 300


def test_a_part_returns_stars():
    """A chain of links in one part comes out as a star around its smallest set."""
    n = 40
    ranked = [list(range(i, i + 20)) for i in range(n)]
    keys = [(17 * i) % n for i in range(n)]
    part = pa.table({"rep": keys, "n": [20] * n, "ranked": ranked, "probe": [False] * n, "grow": [True] * n})
    found = jaccard._walk(part)
    assert sorted(found["a"].to_pylist()) == list(range(1, n))
    assert set(found["b"].to_pylist()) == {0}


def test_stars_take_no_step(spark, monkeypatch):
    """Edges that are stars already are written once; two levels of stars take one step."""
    from tracewell.llm import components as module

    written, write = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df, name: written.append(name) or write(df, name))
    stars = [(10 * s + i, 10 * s) for s in range(3) for i in range(1, 6)]
    found = {r.node: r.component for r in components(spark.createDataFrame(stars * 2, "a long, b long")).collect()}
    assert found == dict(stars) and len(written) == 1
    written.clear()
    found = {r.node: r.component for r in components(spark.createDataFrame(stars + [(0, 10), (0, 20)], "a long, b long")).collect()}
    assert found == {a: 0 for a in [a for a, _ in stars] + [10, 20]} and len(written) == 2


def test_components_without_broadcasts(spark, monkeypatch):
    from tracewell.llm import components as module

    monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    test_components(spark)
