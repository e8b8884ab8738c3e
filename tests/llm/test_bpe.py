import base64
import os
import random
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm.data import documents, texts
from tracewell.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_and_bytes(vocabulary):
    assert bpe.PATTERN == public_tokenizers.PATTERN
    assert len(set(bpe.byte_characters())) == 256 and all(c.isprintable() for c in bpe.byte_characters())


def test_ids_of_odd_texts(vocabulary, reference):
    rng = random.Random(3)
    parts = list("ab1'st !\n\t\r   　 \x1c\x85é漢😀") + ["  ", "'ll", "\n\n", "<|endoftext|>", "x" * 70]
    samples = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(4000)]
    encoder, decoder = bpe._Encoder(vocabulary), bpe._Decoder(vocabulary)
    for i in range(0, len(samples), 500):
        for text, packed in zip(samples[i : i + 500], encoder.packed(samples[i : i + 500])):
            assert np.frombuffer(packed, "<u4").tolist() == reference.encode_ordinary(text)
            assert decoder.raw(packed) == text.encode()


def test_encode_and_decode_tables(spark, vocabulary, reference):
    docs = documents(spark)
    tokens = bpe.encode(docs, vocabulary, spans=True)
    assert tokens.columns[-4:] == ["n_tokens", "token_bytes", "span_starts", "span_ends"]
    assert set(docs.columns) <= set(tokens.columns)
    back = bpe.decode(tokens, vocabulary, as_text=True).collect()
    assert len(back) == len(texts()) + 2
    for row in back:
        text = row.text or ""
        ids = np.frombuffer(row.token_bytes, "<u4").tolist()
        assert ids == reference.encode_ordinary(text) and row.n_tokens == len(ids)
        assert bytes(row.decoded) == text.encode() and row.decoded_text == text
        for start, end, token in zip(row.span_starts, row.span_ends, ids):
            raw, part = reference.decode_single_token_bytes(token), text[start:end]
            at = part.encode().index(raw)
            # Only the first and the last character may stick out of the token.
            assert at < len(part[0].encode()) and len(part.encode()) - at - len(raw) < len(part[-1].encode())


def test_round_trip_and_empty(spark, vocabulary):
    docs = documents(spark)
    once = {(r.doc_id, r.n_chars, bytes(r.decoded)) for r in bpe.round_trip(docs, vocabulary).collect()}
    assert once == {(r.doc_id, r.n_chars, (r.text or "").encode()) for r in docs.collect()}
    assert bpe.round_trip(docs.limit(0), vocabulary).collect() == []
    assert bpe.encode(docs.limit(0), vocabulary).collect() == []


def test_piece_table_stays_small(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_PIECES", 10)
    encoder = bpe._Encoder(vocabulary)
    for i in range(20):
        encoder.packed([" ".join(f"w{i}x{j}" for j in range(8))])
        assert len(encoder.known) <= 18


def _workers(spark) -> dict[int, tuple[float, int]]:
    """Of each Python worker: MB of its own memory, pieces in its table."""

    def look(batches):
        list(batches)
        time.sleep(0.3)
        with open("/proc/self/smaps_rollup") as file:
            own = int(re.search(r"\nPss_Anon: +(\d+)", file.read())[1]) / 1024
        made = bpe._made.get("_Encoder")
        row = {"pid": os.getpid(), "mb": own, "pieces": len(made[1].known) if made else -1}
        yield pa.RecordBatch.from_pylist([row])

    rows = spark.range(0, 4, 1, 4).mapInArrow(look, "pid long, mb double, pieces long").collect()
    return {r.pid: (r.mb, r.pieces) for r in rows}


def test_workers_are_left_with_the_model_alone(spark, vocabulary):
    kind = "doc_id long, text string"
    few = spark.createDataFrame([(i, "some words") for i in range(4)], kind).repartition(4)
    words = F.transform(F.sequence(F.lit(0), F.lit(400)), lambda k: F.substring(F.sha1(F.concat(F.col("id"), F.lit("-"), k)), 1, 9))
    many = spark.range(0, 4_000, 1, 4).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    bpe.round_trip(few, vocabulary).collect()
    before = _workers(spark)
    assert bpe.round_trip(many, vocabulary).agg(F.sum("n_tokens")).first()[0] > 4_000_000
    after = _workers(spark)
    assert before.keys() & after.keys()
    assert all(pieces <= 0 for _, pieces in after.values())
    assert max(after[pid][0] - before[pid][0] for pid in before.keys() & after.keys()) < 45
