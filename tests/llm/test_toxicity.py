import random
import zlib

import pytest

from tests.llm.data import documents, prose
from tracewell.llm import toxicity
from tracewell.llm.toxicity import Model

BAD = ["vile", "rotten", "wretch", "filthy", "scoundrel"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng, rows, labels = random.Random(1), [], []
    for i in range(700):
        words = prose(i, rng.randrange(5, 120)).split()
        toxic = int(i % 4 == 1)
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
        dict(labels),
    )


def test_held_out_accuracy(spark, labelled):
    docs, labels, truth = labelled
    model = toxicity.learn(docs, labels)
    rows = [r for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    hits = sum(r.toxic_predicted and truth[r.doc_id] for r in rows)
    assert len(rows) > 100 and all(0 <= r.toxic_score <= 1 for r in rows)
    assert hits / sum(r.toxic_predicted for r in rows) > 0.9 and hits / sum(truth[r.doc_id] for r in rows) > 0.9


def test_held_out_labels_are_not_learnt(spark, labelled):
    docs, labels, _ = labelled
    flipped = labels.selectExpr("doc_id", "if(crc32(string(doc_id)) % 4 = 2, 1 - toxic, toxic) as toxic")
    assert toxicity.learn(docs, labels) == toxicity.learn(docs, flipped)


def test_a_long_text_is_read_to_its_end(spark, labelled):
    docs, labels, _ = labelled
    model = toxicity.learn(docs, labels)
    clean = " ".join(prose(i, 100) for i in range(60))
    df = spark.createDataFrame([(1, clean), (2, clean + " vile wretch")], "doc_id long, text string")
    low, high = (r.toxic_score for r in toxicity.score(df, model).orderBy("doc_id").collect())
    assert high > low


def test_edges(spark, labelled):
    docs, labels, _ = labelled
    model = toxicity.learn(docs, labels)
    own = documents(spark)
    out = toxicity.score(own, model)
    assert out.columns == [*own.columns, "toxic_score", "toxic_predicted"] and out.count() == own.count()
    empty = [r.toxic_score for r in out.where("text is null or text = ''").collect()]
    assert len(set(empty)) == 1 and empty[0] < toxicity.THRESHOLD
    assert toxicity.score(own.limit(0), model).collect() == []
    assert toxicity.learn(docs, labels.limit(0)) == Model(b"", b"", (), 0.0)
    assert toxicity.learn(docs.limit(0), labels) == Model(b"", b"", (), 0.0)
    one_kind = toxicity.learn(docs, labels.selectExpr("doc_id", "1 as toxic"))
    assert {r.toxic_score for r in toxicity.score(own, one_kind).collect()} == {1.0}
    odd = labels.union(labels.selectExpr("cast(null as long)", "toxic")).union(labels.selectExpr("doc_id", "cast(null as int)"))
    assert toxicity.learn(docs, odd) == model


@pytest.mark.parametrize("kind", [0, 1])
@pytest.mark.parametrize("fold", [0, 3])
def test_a_fold_with_one_kind_is_no_reason_to_give_up(spark, labelled, fold, kind):
    docs, labels, truth = labelled
    some = labels.where(f"not (crc32(string(doc_id)) % 4 = {fold} and toxic = {kind})")
    rows = [r for r in toxicity.score(docs, toxicity.learn(docs, some)).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    hits = sum(r.toxic_predicted and truth[r.doc_id] for r in rows)
    assert hits / sum(r.toxic_predicted for r in rows) > 0.9 and hits / sum(truth[r.doc_id] for r in rows) > 0.9
