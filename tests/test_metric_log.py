"""Merged states of parts against metrics of all results together."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import metrics
from tracewell.session import work_folder
from tracewell.sources import metric_log as ml

KIND = "question_id string, retriever string, tag string, hit boolean, reciprocal_rank double, negative_constraints_passed boolean"


def made(seed, n):
    rng = random.Random(seed)
    return [
        (f"q{seed}-{i}", rng.choice(["keyword", "hybrid"]), rng.choice(["a", "b", None]), (h := rng.random() < 0.6), rng.choice([1.0, 0.5, 0.25]) if h else 0.0, rng.random() < 0.7)
        for i in range(n)
    ]


def rounded(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def test_parts_merge_to_the_whole(spark):
    path = work_folder(spark, "metrics")
    parts = {f"p{s}": made(s, 5 + 9 * s) for s in range(4)}
    for name, rows in parts.items():
        ml.put_part(spark.createDataFrame(rows, KIND), path, name, ["retriever", "tag"])
    # A part that comes again replaces its state.
    parts["p1"] = made(11, 8)
    assert ml.put_part(spark.createDataFrame(parts["p1"], KIND), path, "p1", ["retriever", "tag"]) == 4
    whole = spark.createDataFrame([r for rows in parts.values() for r in rows], KIND)
    states = ml.read_parts(spark, path)
    for by in ([], ["retriever"], ["tag"], ["retriever", "tag"]):
        want = whole.groupBy(*by).agg(*metrics.retrieval_metrics())
        assert rounded(ml.metrics_of(ml.merged(states, by))) == rounded(want.select(*by, *want.columns[len(by):]))
    failed = ml.read_parts(spark, path, "failures")
    columns = ["retriever", "tag", "question_id", "failure"]
    assert sorted(map(tuple, failed.select(*columns).collect()), key=str) == sorted(map(tuple, metrics.failures(whole, columns[:3]).collect()), key=str)
    # States of one group are as many as parts, whatever the number of results.
    assert states.count() <= 4 * 6


def test_old_results_are_not_read_again(spark):
    path = work_folder(spark, "metrics")
    ml.put_part(spark.createDataFrame(made(1, 5), KIND), path, "one", ["retriever"])
    gone = spark.createDataFrame(made(2, 5), KIND).withColumn("hit", F.raise_error(F.lit("read")).cast("boolean"))
    with pytest.raises(Exception, match="read"):
        ml.put_part(gone, path, "two", ["retriever"])
    assert {r.part for r in ml.read_parts(spark, path).collect()} == {"one"}


def test_empty_part_and_bad_names(spark):
    path = work_folder(spark, "metrics")
    with pytest.raises(ValueError, match="no parts"):
        ml.read_parts(spark, path)
    ml.put_part(spark.createDataFrame([], KIND), path, "none", ["retriever"])
    assert ml.metrics_of(ml.merged(ml.read_parts(spark, path), ["retriever"])).collect() == []
    with pytest.raises(ValueError, match="table must be"):
        ml.read_parts(spark, path, "other")
