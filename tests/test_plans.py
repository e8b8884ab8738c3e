"""Evaluation arithmetic, ablation, checklists with evidence and streams on tiny tables."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import checklist, metrics
from tracewell.plans import evaluate as ev, records
from tracewell.streaming import requests

CHUNK = "chunk_id string, source_id string, source_title string, source_type string, section_heading string, text string"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("a1", "A", "alpha", "sop", "one", "pen clicks device"),
        ("a2", "A", "alpha", "sop", "two", "pen device"),
        ("b1", "B", "beta", "sop", "one", "pen storage"),
        ("c1", "C", "gamma", "other", "one", "pen pen pen"),
    ]
    return spark.createDataFrame(rows, CHUNK)


@pytest.fixture(scope="module")
def questions(spark):
    rows = [("q1", "pen clicks device", ["B"], ["A"], ["device_concern"], ["device_concern"]), ("q2", "storage", ["B"], [], [], []), ("q3", "zebra", ["A"], None, None, None)]
    return spark.createDataFrame(rows, "question_id string, query string, expected_source_ids array<string>, forbidden_source_ids array<string>, expected_semantic_intent_tags array<string>, expected_intent_tags array<string>")


def test_evaluate(questions, chunks):
    results = ev.evaluate(questions, chunks, 5)
    rows = {r.question_id: r for r in results.collect()}
    assert rows["q1"].retrieved_source_ids == ["A", "B"] and rows["q1"].reciprocal_rank == 0.5
    assert rows["q1"].forbidden_source_hits == ["A"] and not rows["q1"].negative_constraints_passed
    assert rows["q3"].retrieved_source_ids == [] and not rows["q3"].hit
    total = ev.summarize(results).first()
    assert (total.total_questions, round(total.hit_rate_at_k, 6), total.mean_reciprocal_rank) == (3, 0.666667, 0.5)
    assert round(total.negative_constraint_pass_rate, 6) == 0.666667
    kinds = {(r.question_id, r.failure) for r in metrics.failures(results, ["question_id"]).collect()}
    assert kinds == {("q1", "forbidden_source_hit"), ("q3", "expected_source_missed")}


def test_k_counts_chunks_before_sources(questions, chunks):
    rows = {r.question_id: r for r in ev.evaluate(questions, chunks, 2).collect()}
    assert rows["q1"].retrieved_source_ids == ["A"]


def test_ablation_uses_store_then_model_then_rules(spark, questions, chunks):
    supplied = spark.createDataFrame([("q1", '{"tags": ["storage_concern"]}'), ("q2", "broken")], "question_id string, model_json string")
    results = ev.ablate(["raw", "rule_intent", "nano_intent", "raw"], questions, chunks, 5, supplied=supplied, model="m")
    rows = {(r.strategy, r.question_id): r for r in results.collect()}
    assert len(rows) == 9
    assert rows["nano_intent", "q1"].semantic_tags == ["storage_concern"]
    assert rows["nano_intent", "q2"].prediction_status == "structured_output_failure"
    assert rows["nano_intent", "q3"].prediction_status == "model_error" and rows["nano_intent", "q3"].used_fallback
    summary = {r.strategy: r for r in ev.ablation_summary(results).collect()}
    assert summary["raw"].semantic_intent_micro_precision is None
    assert summary["rule_intent"].semantic_intent_exact_match_rate == 1.0
    assert summary["nano_intent"].semantic_intent_micro_precision == 0.0
    assert (summary["nano_intent"].model_call_count, summary["nano_intent"].fallback_count) == (3, 2)
    with pytest.raises(ValueError, match="unknown retrieval query strategy"):
        ev.build_queries(["other"], questions)


def test_set_comparison_edges(spark):
    df = spark.createDataFrame([([], []), (["a"], []), ([], ["a"]), (["a", "b"], ["b", "c"])], "e array<string>, a array<string>")
    parts = metrics.set_comparison(F.col("e"), F.col("a"))
    rows = df.select(*[v.alias(k) for k, v in parts.items()]).collect()
    assert [(r.precision, r.recall) for r in rows] == [(1.0, 1.0), (0.0, 0.0), (0.0, 1.0), (0.5, 0.5)]
    assert (rows[3].false_positives, rows[3].false_negatives) == (["c"], ["a"])


def test_best_keeps_ties(spark):
    df = spark.createDataFrame([("x", 0.5), ("y", 0.5), ("z", 0.1)], "retriever string, m double")
    assert sorted(r.retriever for r in metrics.best_by(df, "m").collect()) == ["x", "y"]


def test_compare_records_orders_lists(spark):
    schema = "case_id string, d struct<x: string, y: array<string>>"
    a = spark.createDataFrame([("1", (None, ["p", "q"]))], schema)
    b = spark.createDataFrame([("1", (None, ["q", "p"]))], schema)
    row = records.record_results(records.compare_records(a, b, ["d.x", "d.y"])).first()
    assert (row.passed, row.failed_fields) == (False, ["d.y"])


def test_checklist_reranks_by_concern_type(spark, chunks):
    cases = spark.createDataFrame([("k1", "the pen clicks"), ("k2", "zebra")], "case_id string, concern_text string")
    rows = {r.case_id: r for r in checklist.intake_checklist(cases, chunks, 2).collect()}
    evidence = rows["k1"].evidence
    assert [e.chunk_id for e in evidence][0] == "a1" and len(evidence) == 2
    assert len(rows["k1"].review_checks[0].evidence) == 2 and rows["k2"].evidence == []


def test_streams(spark, chunks, tmp_path):
    source, found, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([("q", "pen storage")], "query_id string, query_text string").write.parquet(source)
    arriving = spark.readStream.schema("query_id string, query_text string").parquet(source)
    for _ in range(2):
        requests.start_retrieve(arriving, chunks, found, state, 2).awaitTermination()
    assert [r.chunk_id for r in spark.read.parquet(found).orderBy("rank").collect()] == ["c1", "b1"]
    told = spark.createDataFrame([("1", "the pen leaks")], "case_id string, concern_text string")
    row = requests.triage_stream(told).first()
    assert row.concern_type == "syringe_or_device_issue" and row.intent_tags[0] == "device_concern"


def test_registered_queries_have_sql():
    from workload import records, registry, retrieval, rules  # noqa: F401

    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_comparison_refuses_unknown_pairs(spark):
    from tracewell.plans.evaluate import comparison

    names = "retriever string, question_id string, hit boolean, reciprocal_rank double, negative_constraints_passed boolean"
    results = spark.createDataFrame([("a", "q", True, 1.0, True), ("b", "q", False, 0.0, True)], names)
    with pytest.raises(ValueError, match="embedding, hybrid"):
        comparison(results.withColumn("retriever", F.regexp_replace("retriever", "a", "keyword")))
    assert set(comparison(results, [("a", "b")])) == {"summary", "best", "differences"}


def test_own_detector_pattern_and_strategy(spark):
    from tracewell.operators.intents import semantic_intents
    from tracewell.plans.evaluate import build_queries

    asked = spark.createDataFrame([("1", "The gizmo broke")], "question_id string, query string")
    tagged = semantic_intents(asked, "query", patterns={"device": [r"\bgizmo\b"]}).first()
    assert tagged.semantic_tags == ["device_concern"]
    own = {"loud": lambda q: q.withColumn("search_text", F.upper("query"))}
    built = build_queries(["loud", "rule_intent"], asked, own=own, detector=lambda q: semantic_intents(q, "query"))
    assert {r.strategy: r.search_text for r in built.collect()} == {"loud": "THE GIZMO BROKE", "rule_intent": "The gizmo broke"}
    with pytest.raises(ValueError, match="unknown"):
        build_queries(["loud"], asked)


def test_row_local_queries_move_nothing(spark, tmp_path):
    """With as many splits as cores, no query that works on single rows has an exchange in its plan."""
    import os

    from workload import inputs, records, registry, retrieval, rules  # noqa: F401

    source = "/root/testdata/sf0.001"
    if not os.path.isdir(source):
        pytest.skip("needs the test tables")
    for name in ("documents", "conversations", "events", "pages"):
        spark.read.parquet(f"{source}/{name}.parquet").repartition(8).write.parquet(f"{tmp_path}/{name}.parquet")
    names = [
        "R1_J6_refusal", "R2_R3_W5_triage", "R4_concern_query", "R5_R6_R7_checklist_rules", "F12_fact_detectors",
        "R9_documents_intents", "R9_R10_R11_J7_J8_T3_intent_queries", "R12_F7_model_intents", "F1_tokens", "F1_page_tokens",
        "F3_F4_F10_text_functions", "F3_F5_phrase_match", "F7_event_json", "J6_lexicon_substring", "A1_chunk_terms", "A3_hashed_vectors",
    ]
    for name in names:
        plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, name
    # A single file, on the other hand, is dealt out to the cores.
    spark.read.parquet(f"{source}/pages.parquet").coalesce(1).write.parquet(f"{tmp_path}/one/pages.parquet")
    assert inputs.load(spark, f"{tmp_path}/one", "pages").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
