import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.data import prose
from tests.llm.test_jaccard import brute as brute_sets
from tests.llm.test_linededup import brute as brute_lines
from tracewell.llm import bpe, queries, toxicity
from tracewell.session import stored

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows, labels = random.Random(6), [], []
    for i in range(240):
        lines = [prose(1000 * i + k, rng.randrange(3, 30)) for k in range(rng.randrange(1, 4))]
        if i % 5 == 0:
            lines.insert(0, "released under one and the same license")
        toxic = int(i % 3 == 0)
        if toxic:
            lines[-1] += " vile wretch rotten"
        if i % 11 == 4:
            lines = [x + " more" for x in rows[-3][1].split("\n")]
        rows.append((i, "\n".join(lines), "en", f"s{i % 4}", 0))
        labels.append((i, toxic, 1))
    rows += [(300, None, None, None, None), (301, "", "en", "s0", 0), rows[7]]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, KIND).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    states = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), name)
        states.append(docs)
    raw, clean, lines, single, mixed, tokens = states
    assert all(s.columns == columns for s in states[:-1])

    model = toxicity.learn(raw, spark.read.parquet(f"{folder}/labels.parquet"))
    meter = toxicity._Meter(model)
    want = [r for r in raw.collect() if meter.scores([r.text])[0] < toxicity.THRESHOLD]
    assert Counter(clean.collect()) == Counter(want) and 0 < len(want) < raw.count()

    want = brute_lines([(r.doc_id, r.text) for r in want])
    assert Counter((r.doc_id, r.text) for r in lines.collect()) == Counter((d, t) for d, t, _, _ in want)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines.collect())

    kept = {d for d, _, c in brute_sets([(d, t) for d, t, _, _ in want]) if d == c}
    assert sorted(r.doc_id for r in single.collect()) == sorted(kept) and len(kept) < len(want)

    counts = Counter(r.doc_id for r in mixed.collect())
    assert set(counts) <= kept and set(counts.values()) == {1, 2}
    assert Counter(r.doc_id for r in tokens.collect()) == counts
    decoder = bpe._Decoder(queries.vocabulary())
    text = {r.doc_id: r.text for r in mixed.collect()}
    for r in tokens.collect():
        assert decoder.raw(bytes(r.token_bytes)) == (text[r.doc_id] or "").encode()
        assert r.n_tokens == len(np.frombuffer(r.token_bytes, "<u4"))


def test_run_is_the_stages(spark, folder):
    first, again = (Counter(corpus_pipeline.run(spark, folder).drop("token_bytes").collect()) for _ in range(2))
    assert first == again and sum(first.values()) > 0


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_empty_documents(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    assert out.collect() == [] and (name == "byte_bpe" or out.columns == docs.columns)


def test_rows_of_one_id_with_different_texts_stay(spark):
    texts = [(1, prose(1, 40)), (1, prose(2, 40)), (1, prose(2, 40)), (2, prose(3, 40)), (3, None), (3, None), (3, prose(4, 40))]
    docs = spark.createDataFrame([(d, t, "en", "s0", 0) for d, t in texts], KIND)
    found = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert Counter((r.doc_id, r.text) for r in found.collect()) == Counter(set(texts))
