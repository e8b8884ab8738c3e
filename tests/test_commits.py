"""The prediction log and published runs: what readers see, and which files are written."""

import os

import pytest
from pyspark.sql import functions as F

from tracewell.session import work_folder
from tracewell.sources import commits, prediction_log as log, predictions, runs


def rows(spark, texts, tag):
    df = spark.createDataFrame([(str(i), t) for i, t in texts], "question_id string, text string")
    keyed = predictions.prediction_key(df.withColumn("t", F.array(F.lit(tag))), "text", "m")
    return predictions.entries(keyed, "t")


def files(path):
    path = path.removeprefix("file://")
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names}


def seen(df):
    return {r.question_id: r.semantic_intent.tags for r in df.collect()}


def test_upserts_and_compaction(spark):
    path = work_folder(spark, "log")
    texts = [(i, f"text {i}") for i in range(40)] + [(90, ""), (91, "text 1")]
    assert log.put_predictions(rows(spark, texts, "bud_question"), path, 8) == 0
    base = files(path)
    # Few keys: only their buckets get new files, and no file changes.
    assert log.put_predictions(rows(spark, texts[3:5], "device_concern"), path) == 1
    twice = rows(spark, texts[4:6], "storage_concern")
    assert log.put_predictions(twice.union(twice), path, 99) == 2
    now = files(path)
    assert all(now[f] == t for f, t in base.items())
    parts = log.live_parts(spark, path)
    worn = sorted(b for b, g in parts.items() if len(g) > 1)
    assert 1 <= len(worn) <= 3 and len(parts) == 8
    want = {str(i): ["bud_question"] for i, _ in texts} | {"3": ["device_concern"], "4": ["storage_concern"], "5": ["storage_concern"]}
    assert seen(log.read_predictions(spark, path)) == want
    before = files(path)
    assert log.compact(spark, path) == worn and log.compact(spark, path) == []
    after = files(path)
    assert all(after[f] == t for f, t in before.items())
    fresh = {int(f.split("bucket=")[1].split("/")[0]) for f in after.keys() - before.keys() if "bucket=" in f}
    assert fresh == set(worn)
    assert seen(log.read_predictions(spark, path)) == want
    assert all(len(g) == 1 for g in log.live_parts(spark, path).values())
    assert len(log.unused_generations(spark, path)) >= 1
    keys = rows(spark, [*texts[2:4], (3, "another text"), (7, "unknown")], "x").drop("semantic_intent").withColumn("n", F.lit(1))
    for pushed in (1000, 1):
        got = log.look_up(keys, path, pushed).collect()
        assert sorted((r.question_id, r.semantic_intent and r.semantic_intent.tags) for r in got if r.semantic_intent) == [
            ("2", ["bud_question"]), ("3", ["device_concern"])
        ]
        assert len(got) == 4 and all(r.n == 1 for r in got)


def test_empty_log(spark):
    path = work_folder(spark, "log")
    assert log.read_predictions(spark, path).collect() == [] and log.compact(spark, path) == []
    assert log.put_predictions(rows(spark, [(1, "a")], "bud_question").limit(0), path) is None
    got = log.look_up(rows(spark, [(1, "a")], "x").drop("semantic_intent"), path).collect()
    assert [r.semantic_intent for r in got] == [None]


def test_runs_appear_as_a_whole(spark):
    path = work_folder(spark, "runs")
    first = spark.createDataFrame([("raw", "q1", True), ("rules", "q1", False)], "strategy string, question_id string, hit boolean")
    manifest = spark.createDataFrame([("f", 1)], "path string, n int")
    total = first.groupBy("strategy").count()
    with pytest.raises(ValueError, match="no committed run"):
        runs.read_run(spark, path, "results")
    runs.write_run(first, total, manifest, path, "run-1")
    # The manifest fails after results and comparison were written: readers still see the former run.
    broken = manifest.select("path", F.raise_error(F.lit("stopped")).alias("n"))
    changed = first.withColumn("hit", ~F.col("hit"))
    with pytest.raises(Exception, match="stopped"):
        runs.write_run(changed, total, broken, path, "run-1")

    def results(run=None):
        return sorted((r.run_id, r.strategy, r.hit) for r in runs.read_run(spark, path, "results", run).collect())

    assert results("run-1") == [("run-1", "raw", True), ("run-1", "rules", False)]
    # A strategy that is written again is replaced, another one of the run stays.
    runs.write_run(changed.where("strategy = 'raw'"), total, manifest, path, "run-1")
    runs.write_run(first.where("strategy = 'raw'"), total, manifest, path, "run-2")
    assert results() == [("run-1", "raw", False), ("run-1", "rules", False), ("run-2", "raw", True)]
    assert [r.n for r in runs.read_run(spark, path, "manifest", "run-1").collect()] == [1]
    assert len(commits.records(spark, path)) == 3
    with pytest.raises(ValueError, match="table must be one of"):
        runs.read_run(spark, path, "other")
