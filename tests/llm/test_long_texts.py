"""Texts of millions of characters among short ones."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm.brute_align import Brute
from tests.llm.data import prose
from tracewell.llm import align, chat, decontaminate, jaccard, linededup, quality
from tracewell.llm.queries import alignment_models

MANY_WORDS = " ".join(f"w{i * 7919 % 300_007}" for i in range(300_000))
MANY_LINES = "\n".join(f"a line of its own {i}" for i in range(60_000))


@pytest.fixture(scope="module")
def docs(spark):
    near = MANY_WORDS.replace("w7919 ", "changed ", 1)
    rows = [(1, MANY_WORDS), (2, near), (3, MANY_LINES), (4, MANY_LINES + "\nand one more line"), (5, "short text"), (6, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_jaccard(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {1: (299_996, 1), 2: (299_996, 1), 3: (got[3][0], 3), 4: (got[3][0] + 4, 3), 5: (1, 5), 6: (0, 6)}


def test_line_dedup(docs):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in linededup.dedup_lines(docs).collect()}
    assert got[3] == (60_000, 0, MANY_LINES) and got[4] == (60_001, 60_000, "and one more line")
    assert got[1] == (1, 0, MANY_WORDS) and got[6] == (1, 0, None)


def test_quality(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 7)], "doc_id long, quality int")
    named = docs.withColumns({"source": F.lit("s"), "lang": F.lit("l")})
    rows = quality.score(named, quality.learn(named, labels)).collect()
    assert len(rows) == 6


def test_chat(spark):
    said = [(1, 0, "user", "q"), (1, 1, "assistant", MANY_WORDS + "<|im_end|>" * 1000), (2, 0, "user", "q")]
    turns = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert got[1].loss_text == said[1][3] and got[1].turns[1].text == said[1][3] and got[2].loss_text == ""


def test_decontamination(spark, docs):
    items = [(10, " ".join(MANY_WORDS.split()[150_000:150_030])), (11, prose(3, 20))]
    found = decontaminate.find_benchmark(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.hit_ranges], r.item_ids) for r in found.collect()}
    assert got[1] == got[2] == (300_000, [(150_000, 150_030)], ["10"])
    assert got[5] == (2, [], []) and got[6] == (0, [], [])


def test_alignment(docs):
    brute = Brute()
    some = docs.where("doc_id in (3, 5, 6)")
    rows = [(r.doc_id, r.text) for r in some.collect()]
    got = sorted(map(tuple, align.align_corpus(some, alignment_models()).collect()))
    assert got == sorted(brute.corpus(rows))
    assert hashlib.sha256(b"").hexdigest() not in {r[-1] for r in got}
