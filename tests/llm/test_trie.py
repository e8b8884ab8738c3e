import hashlib
import random
import zlib

import pytest

from tracewell.llm import trie

KIND = "conv_id long, turn long, role string, text string, id string, open boolean"


def rows_of(convs):
    return [(c, t, r, x, "own", True) for c, turns in convs.items() for t, r, x in turns]


def sequences(convs):
    """Turns as (role, text) in order; the null turn first, equal turns by the id of role and text."""
    out = {}
    for c, turns in convs.items():
        told = [(t, r or "", x or "") for t, r, x in turns]
        told.sort(key=lambda t: (t[0] is not None, t[0] or 0, hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()))
        out[c] = [(r, x) for _, r, x in told]
    return out


def rebuilt(told):
    out = {}
    for c, turns in told.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = tuple(told.get(c - c % 100, [])[:h] + turns[h:])
    return out


def brute(keys):
    nodes = {}
    for c, k in keys.items():
        for d in range(len(k) + 1):
            nodes.setdefault(k[:d], []).append(c)
    children = {}
    for k in nodes:
        if k:
            children[k[:-1]] = children.get(k[:-1], 0) + 1
    out = []
    for k, members in nodes.items():
        under = [u for u in nodes if u[: len(k)] == k]
        leaves = sum(u not in children for u in under)
        saved = sum((len(nodes[u]) - 1) * len(u[-1][1]) for u in under if u)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(keys[c]) == len(k)))
        above = min(nodes[k[:-1]]) if k else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members), len(k), above, len(members), children.get(k, 0), leaves, saved, digest))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_shards_and_packs(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(trie, "PACK", 3)
    said = [("user", "hello"), ("user", None), (None, "x" * 40), ("assistant", "é😀"), ("", "")]
    convs = {}
    for _ in range(60):
        c = rng.choice([rng.randrange(0, 30), rng.randrange(100, 130), rng.randrange(250, 260), 200])
        convs[c] = [(rng.choice([None, 0, 1, 2, 2]), *rng.choice(said)) for _ in range(rng.choice([1, 2, 2, 5, 9]))]
    for c in range(300, 320):
        convs[c] = [(t, "user", "the same") for t in range(3)]
    turns = spark.createDataFrame(rows_of(convs) + [(None, 0, "user", "of nobody", None, None)], KIND)
    keys = rebuilt(sequences(convs))
    assert collected(trie.prefix_trie(trie.with_shared_heads(trie.turn_sequences(turns)), shard_keys=5)) == brute(keys)


def test_plain_sequences_and_long(spark):
    convs = {5: [(i, "user", str(i % 3)) for i in range(3000)], 6: [(i, "user", str(i % 3)) for i in range(2990)], 7: [(0, "user", "1")]}
    nodes = trie.prefix_trie(trie.turn_sequences(spark.createDataFrame(rows_of(convs), KIND)), shard_keys=1)
    rows = {(r.conv_id, r.depth): r for r in nodes.collect()}
    assert len(rows) == 3002
    assert (rows[5, 0].n_convs, rows[5, 0].n_leaves, rows[5, 0].saved_tokens) == (3, 2, 2990)
    assert rows[5, 2990].n_convs == 2 and rows[5, 2991].n_convs == 1 and rows[5, 2990].saved_tokens == 1
    assert rows[7, 1].parent_conv_id == 5


def test_empty_and_turnless(spark):
    none = spark.createDataFrame([], KIND)
    assert trie.prefix_trie(trie.with_shared_heads(trie.turn_sequences(none))).collect() == []
    # Of a conversation shorter than its head, with an absent base, nothing is left.
    short = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    one = spark.createDataFrame([(short, 0, "user", "gone", None, None)], KIND)
    digest = hashlib.sha256(str(short).encode()).hexdigest()
    got = collected(trie.prefix_trie(trie.with_shared_heads(trie.turn_sequences(one))))
    assert got == [(short, 0, None, 1, 0, 1, 0, digest)]


def test_node_layouts():
    tree = trie.RadixTree()
    keys = [bytes([a]) + bytes(trie.WIDTH - 2) + bytes([b]) for a in range(0, 256, 3) for b in range(a % 7)]
    keys += [k + bytes(trie.WIDTH) for k in keys[::2]]
    for i, k in enumerate(keys):
        tree.insert(k, trie.End(1, i, "", [1] * (len(k) // trie.WIDTH)))
    layouts = set()
    stack = [tree.root]
    while stack:
        node = stack.pop()
        layouts.add(node.layout)
        stack += [c for _, c in node.items()]
        assert all(node.child(b) is c for b, c in node.items())
    assert layouts == {4, 16, 256}
    rows = trie.trie_nodes(tree, set())
    assert len(rows) == 1 + len(keys) and all(r["depth"] * trie.WIDTH >= 0 for r in rows)
    node = trie.Node(b"")
    for b in range(256):
        node.put(b, trie.Node(bytes([b])))
        node.put(b, child := trie.Node(bytes([b])))
        assert node.child(b) is child and node.child(255 if b < 255 else 0) is (None if b < 255 else node.child(0))
        assert node.layout == next(n for n in trie.LAYOUTS if n > b or n == 256)
        assert [x for x, _ in node.items()] == list(range(b + 1))
