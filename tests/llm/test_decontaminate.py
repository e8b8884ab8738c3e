import random
import re

import pytest

from tests.llm.data import LONG, documents
from tracewell.llm import decontaminate

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORDS.findall(lowered)


def brute(text, items, window=decontaminate.WINDOW):
    """(n_words, hit words, item ids) by looking everywhere."""
    w, hit, found = words(text), set(), set()
    for item, said in items:
        own = words(said)
        for p in range(max(1, len(own) - window + 1) if own else 0):
            part = own[p : p + window]
            for q in range(len(w) - len(part) + 1):
                if w[q : q + len(part)] == part:
                    hit.update(range(q, q + len(part)))
                    found.add("" if item is None else str(item))
    return len(w), hit, sorted(found)


def checked(row, items, window=decontaminate.WINDOW):
    hit = {i for r in row.hit_ranges for i in range(r.start, r.end)}
    assert (row.n_words, hit, row.item_ids) == brute(row.text, items, window), row.text[:80]
    assert all(a.end < b.start for a, b in zip(row.hit_ranges, row.hit_ranges[1:]))


@pytest.mark.parametrize("seed", range(25))
def test_search_against_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(decontaminate, "STRETCH", rng.choice([1, 5, 512]))
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", rng.choice([3, 1 << 20]))
    known = rng.choice([["a", "b"], ["a", "b", "é", "x1", "汉字"]])

    def made(n):
        return "".join(rng.choice(known) + rng.choice([" ", ". ", "-\n", "\x7f"]) for _ in range(n))

    window = rng.choice([1, 2, 3, 10])
    items = [(i, made(rng.randrange(14))) for i in range(rng.randrange(6))]
    rows = set()
    for i, said in items:
        own = words(said)
        rows |= {(tuple(own[p : p + window]), str(i)) for p in range(max(1, len(own) - window + 1) if own else 0)}
    search = decontaminate._Search(decontaminate.build_index([(list(a), b) for a, b in sorted(rows)]))
    texts = [made(rng.randrange(60)).upper() for _ in range(10)] + ["", None]
    for text, (n, ranges, found) in zip(texts, search([None if t is None else t.encode() for t in texts], None)):
        assert (n, {i for a, b in ranges for i in range(a, b)}, found) == brute(text, items, window)


@pytest.mark.parametrize("block_bytes", [32 << 20, 700])
def test_documents_and_blocks(spark, block_bytes):
    docs = documents(spark).withColumnRenamed("key", "n_words")
    texts = [r.text for r in docs.where("text is not null").collect()]
    items = [(i, " ".join(t.split()[5:30])) for i, t in enumerate(texts)] + [(900, "ONE two, three"), (901, ""), (902, None)]
    items += [(None, "alpha"), (7, "tail"), (7, "é"), (901, "!?"), (950, LONG[:500])]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, block int")
    found = decontaminate.find_benchmark(docs, benchmark, block_bytes=block_bytes)
    assert found.columns[-3:] == ["n_words", "hit_ranges", "item_ids"]
    rows = found.collect()
    assert len(rows) == len(texts) + 1
    for row in rows:
        if row.text != LONG:
            checked(row, items)
    long = [r for r in rows if r.text == LONG]
    assert len(long) == 2 and all(len(r.hit_ranges) == 1 and r.n_words == 20_001 for r in long)


def test_empty_tables(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.find_benchmark(docs, none).collect()
    assert len(rows) == docs.count() and not any(r.hit_ranges or r.item_ids for r in rows)
    some = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert decontaminate.find_benchmark(docs.limit(0), some).collect() == []
