import random

import numpy as np
import pytest

from tests.llm.brute_align import Brute
from tests.llm.data import documents
from tracewell.llm import align
from tracewell.llm.queries import alignment_models


@pytest.fixture(scope="module")
def brute():
    return Brute()


def dense(m):
    out = np.zeros((m.rows, m.columns), np.int64)
    np.add.at(out, (m.row_of(), m.indices), m.data)
    return out


def test_sparse_products(monkeypatch):
    rng = np.random.default_rng(5)
    for block in (1, 7, 10_000):
        monkeypatch.setattr(align, "BLOCK_LINKS", block)
        x, y = (rng.integers(0, 3, s) * (rng.random(s) < 0.3) for s in ((9, 6), (6, 11)))
        a, b = (align.merged(*np.nonzero(m), m[np.nonzero(m)], *m.shape) for m in (x, y))
        assert (dense(align.transposed(a)) == x.T).all()
        got = np.concatenate([dense(block) for _, _, block in align.product_blocks(a, b)])
        assert (got == x @ y).all()
        one, two = np.array([2, 3, 1, 4]), np.array([1, 1, 3, 1, 4])
        links = list(zip(*(c.tolist() for c in align.overlap_links(one, two))))
        assert links == [(0, 0, 1), (0, 1, 1), (1, 2, 3), (2, 3, 1), (3, 4, 4)]


def test_odd_texts(spark, brute, monkeypatch):
    rng = random.Random(4)
    parts = list("ab1'st !\n\t\r   　 \x1c\x85é漢😀;}\x00") + ["  ", "'ll", "\r\n", "<|endoftext|>", "<s>", "x" * 70, "▁", "ﬁ", "{\r"]
    aligner = align.Aligner(alignment_models())
    for limit in (1 << 20, 9):
        monkeypatch.setattr(align, "SLICE_CHARS", limit)
        monkeypatch.setattr(align, "BATCH_CHARS", 3 * limit)
        texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(1500)]
        for text, (doc, pairs) in zip(texts, align._documents(aligner, texts, True)):
            want = brute.groups(text)
            shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)
            assert ("" if doc.broken else b"".join(doc.text).decode()) == shown, text
            if want:
                assert sum(pairs[1].tolist()) == doc.n_links == sum(len(a) * len(b) for a, b in want)


def test_full_table_keeps_frequent_pieces(brute, monkeypatch):
    monkeypatch.setattr(align, "MOST_PIECES", 40)
    monkeypatch.setattr(align, "BATCH_CHARS", 200)
    aligner, learnt, learn = align.Aligner(alignment_models()), [], align.Aligner.learn
    monkeypatch.setattr(align.Aligner, "learn", lambda self, pieces: (learnt.extend(pieces), learn(self, pieces))[1])
    rng, often = random.Random(9), ["the", "don't", "Straße,", "漢字", "▁x", "y" * 70]
    texts = [" ".join([*often, *(f"w{rng.randrange(10**6)}" for _ in range(5)), *often]) for _ in range(60)]
    texts = [t if k % 7 else t.replace("▁x", "x") + " \n" for k, t in enumerate(texts)]
    for text, (doc, pairs) in zip(texts, align._documents(aligner, texts, True)):
        want = brute.groups(text)
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)
        assert ("" if doc.broken else b"".join(doc.text).decode()) == shown, text
        assert not want or sum(pairs[1].tolist()) == doc.n_links
    # Six short frequent words: each is learnt once, though the table was full many times.
    assert len(learnt) > 5 * align.MOST_PIECES
    assert [learnt.count(" " + w) for w in often[:5]] == [1] * 5 and learnt.count(" " + often[5]) > 1


def test_tokens_that_do_not_give_back_their_piece():
    aligner = align.Aligner(alignment_models())
    pieces = [" plain", " ﬁn", " ▁", " ß😀", " ½", "\n\n", " end"]
    raw = np.frombuffer("".join(pieces).encode(), np.uint8)
    edges = np.cumsum([0, *(len(p.encode()) for p in pieces)])
    for model, found in ((aligner.a, aligner.a(pieces, edges)), (aligner.b, aligner.b(pieces))):
        parted = np.split(found[0], np.cumsum(found[1])[:-1])
        want = [b"".join(model.tokens[i] for i in ids) == p.encode() for ids, p in zip(parted, pieces)]
        assert align._gives_back(model, *found, raw, edges).tolist() == want
    assert not all(want)


def test_corpus(spark, brute, monkeypatch):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(7, "▁ is no space"), (7, "<|endoftext|> is text")]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(rows[-2:], "doc_id long, text string"))
    want = sorted(brute.corpus(rows), key=str)
    for size in (64 << 20, 1000):
        monkeypatch.setattr(align, "PART_BYTES", size)
        assert sorted((tuple(r) for r in align.align_corpus(docs, alignment_models()).collect()), key=str) == want


def test_groups_keep_columns_and_empty(spark, brute):
    docs = documents(spark).withColumnRenamed("key", "groups")
    back = align.with_groups(docs, alignment_models())
    assert back.columns[-5:] == ["n_a", "n_b", "n_groups", "n_links", "groups"]
    for r in back.collect():
        want = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in brute.groups(r.text))
        assert r.groups == want
    assert align.align_corpus(docs.limit(0), alignment_models()).collect() == []
    assert align.with_groups(docs.limit(0), alignment_models()).collect() == []
