"""Corpus edge cases, chunk lines, questions, runs, predictions and record checks."""

import json

import pytest
from pyspark.sql import functions as F

from tracewell.operators.validation import chunk_violations, record_violations
from tracewell.sources import chunks as chunk_source, corpus, predictions, questions, runs

BLOCK = '---\ndocument_id: D1\ntitle: "A: title"\nversion: 1.0\neffective_date: 2024-01-01\nprocess_area: p\nsource_type: sop\nsynthetic: TRUE\n---\n'
FILES = {
    "good.md": BLOCK + "# T\nlead text dropped\n\n## One  \n\nbody one  \nmore\t\n## Empty\n\n## One\nsecond body\n##\nNext line\ntail\n",
    "plain.md": BLOCK.replace("D1", "D2") + "only text\n",
    "noopen.md": "x\n" + BLOCK + "b",
    "unclosed.md": "---\ndocument_id: D3\n",
    "nocolon.md": BLOCK.replace("version: 1.0", "version 1.0") + "b",
    "missing.md": BLOCK.replace("version: 1.0\n", "") + "b",
    "empty.md": BLOCK + "\n \n",
    "repeat.md": BLOCK.replace("document_id: D1", "document_id: D8\ntitle: old").replace("synthetic: TRUE", "synthetic: true\nextra: 1") + "b",
    "notsynthetic.md": BLOCK.replace("TRUE", "yes") + "b",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    for name, text in FILES.items():
        (path / name).write_text(text)
    (path / "skip.txt").write_text("not markdown")
    return str(path)


def test_documents_and_errors(spark, folder):
    rows = {r.source_file: r for r in corpus.read_corpus(spark, folder).collect()}
    assert set(rows) == set(FILES)
    errors = {k: r.error for k, r in rows.items() if r.error}
    assert errors == {
        "noopen.md": "must start with a metadata block",
        "unclosed.md": "metadata block is not closed",
        "nocolon.md": "invalid metadata line: version 1.0",
        "missing.md": "missing metadata fields: version",
        "empty.md": "empty body text",
        "notsynthetic.md": "synthetic must be true",
    }
    assert rows["good.md"].title == "A: title" and rows["good.md"].synthetic is True
    assert rows["repeat.md"].title == "A: title" and rows["repeat.md"].document_id == "D8"


def test_strict_corpus_fails(spark, folder):
    with pytest.raises(Exception, match="md: "):
        corpus.read_corpus(spark, folder, strict=True).collect()


def test_sections(spark, folder):
    rows = corpus.section_chunks(corpus.read_corpus(spark, folder)).collect()
    by_id = {r.chunk_id: r for r in rows}
    assert set(by_id) == {"D1::one", "D1::one-2", "D1::next-line", "D2::document", "D8::document"}
    assert by_id["D1::one"].text == "One\n\nbody one\nmore"
    assert by_id["D1::one-2"].text == "One\n\nsecond body"
    assert by_id["D1::next-line"].section_heading == "Next line"
    assert by_id["D2::document"].text == "only text"


def test_chunk_lines_round_trip_and_violations(spark, folder, tmp_path):
    chunks = corpus.section_chunks(corpus.read_corpus(spark, folder))
    chunk_source.write_chunks(chunks, str(tmp_path / "c"))
    back = chunk_source.read_chunks(spark, str(tmp_path / "c"), strict=True)
    assert sorted(back.drop("violations").collect()) == sorted(chunks.select(*back.columns[:-1]).collect())
    good = chunks.toJSON().first() if hasattr(chunks, "toJSON") else None
    record = json.loads(good)
    lines = [json.dumps(record), "", "{oops", "[1]", json.dumps({**record, "synthetic": "true"}), json.dumps({k: v for k, v in record.items() if k != "text"})]
    df = spark.createDataFrame([(n, v) for n, v in enumerate(lines)], "n int, value string")
    found = {r.n: r.violations for r in chunk_source.parse_chunk_lines(df).collect()}
    assert found == {
        0: [], 2: ["not a JSON object"], 3: ["not a JSON object"], 4: ["synthetic must be boolean"], 5: ["missing keys: text"],
    }
    doubled = chunks.unionByName(chunks.filter("chunk_id = 'D1::one'").withColumn("text", F.lit("")))
    bad = {(r.chunk_id, r.text == ""): r.violations for r in chunk_violations(doubled).collect()}
    assert bad["D1::one", True] == ["missing text", "duplicate chunk_id"]
    assert bad["D2::document", False] == []
    with pytest.raises(ValueError, match="no chunks found"):
        chunk_source.require_rows(chunks.limit(0), "chunks")


def test_questions(spark, tmp_path):
    rows = [
        {"question_id": "a", "query": "q", "expected_source_ids": ["S1"], "expected_semantic_intent_tags": ["bud_question", "adverse_event"]},
        {"question_id": "b", "query": " ", "expected_source_ids": []},
        {"question_id": "c", "query": "q", "expected_source_ids": ["S1"], "forbidden_source_ids": ["S1"], "expected_intent_tags": ["nope"], "rationale": " "},
    ]
    (tmp_path / "q.json").write_text(json.dumps(rows))
    got = {r.question_id: r for r in questions.read_questions(spark, str(tmp_path / "q.json")).collect()}
    assert got["a"].violations == [] and got["a"].expected_semantic_intent_tags == ["adverse_event", "bud_question"]
    assert got["b"].violations == ["query missing", "expected_source_ids missing"]
    assert got["c"].violations == ["expected and forbidden overlap", "rationale blank", "unknown intent tag"]


def test_extraction_cases(spark, tmp_path):
    good = {
        "case_id": "x", "concern_text": "c", "reviewer_note": "n", "expected_unresolved_field_names": [],
        "expected_review_summary": {
            "record_review_result": "not_applicable", "lot_batch_pattern_summary": "unavailable",
            "inventory_inspection_result": "not_checked", "api_reference_review_result": "not_needed"},
    }
    bad = json.loads(json.dumps(good)) | {"case_id": "y"}
    bad["expected_review_summary"]["record_review_result"] = "odd"
    del bad["reviewer_note"]
    (tmp_path / "cases.json").write_text(json.dumps([good, bad]))
    got = {r.case_id: r.violations for r in questions.read_extraction_cases(spark, str(tmp_path / "cases.json")).collect()}
    assert got == {"x": [], "y": ["reviewer_note missing", "record_review_result invalid"]}


RECORD = {
    "raw_intake": {"intake_source": "qre_general_question_form", "submitter_role": "customer", "submission_purpose": "other", "concern_narrative": "n"},
    "product_context": {}, "investigation_requirements": {},
    "review_summary": {"record_review_result": "not_applicable", "lot_batch_pattern_summary": "unavailable", "inventory_inspection_result": "not_checked", "api_reference_review_result": "not_needed"},
    "derived_assessment": {"reviewer_assigned_classification": "general_question", "concern_type": "bud_question", "risk_lane": "expected_self_limiting", "review_scope": "guidance_only", "handling_path": "respond_to_frontline_pharmacist", "resolution_review_required": False, "resolution_options": [], "rationale": "r"},
}


def changed(section, **values):
    record = json.loads(json.dumps(RECORD))
    record[section].update(values)
    return json.dumps(record)


@pytest.mark.parametrize(
    "text,want",
    [
        (json.dumps(RECORD), []),
        ("nonsense", ["not a record"]),
        (changed("raw_intake", intake_source="customer_review"), ["star_rating required", "review_text_present required"]),
        (changed("raw_intake", star_rating=3, review_text_present=True), ["star_rating not allowed", "review_text_present not allowed"]),
        (changed("raw_intake", intake_source="customer_review", star_rating=9, review_text_present=True), ["star_rating out of range"]),
        (changed("derived_assessment", reviewer_assigned_classification="QRE"), ["category required", "subcategory required"]),
        (changed("derived_assessment", reviewer_assigned_category="suspected_ADE"), ["category not allowed"]),
        (changed("derived_assessment", resolution_options=["counseling_or_follow_up"]), ["resolution_options not allowed"]),
        (changed("review_summary", severe_triggers_observed=["odd"]), ["severe_triggers_observed invalid"]),
        (changed("product_context", color="red"), ["unknown field in product_context"]),
    ],
)
def test_record_rules(spark, text, want):
    found = record_violations(spark.createDataFrame([(text,)], "record_json string")).first().violations
    assert (found[:1] if want == ["not a record"] else found) == want


def test_expected_outputs_take_their_id_from_the_file(spark, tmp_path):
    (tmp_path / "case_7.json").write_text(json.dumps(RECORD))
    row = questions.read_expected_outputs(spark, str(tmp_path), strict=True).first()
    assert row.case_id == "case_7" and row.record.raw_intake.concern_narrative == "n"


def test_run_ids_and_manifest(spark, tmp_path):
    assert runs.check_run_id(" a-1_B ") == "a-1_B"
    for bad in ("", " ", "a b", "a/b", "é"):
        with pytest.raises(ValueError):
            runs.check_run_id(bad)
    (tmp_path / "f.json").write_text("[1, 2, 3]")
    row = runs.file_manifest(spark, str(tmp_path / "f.json")).first()
    import hashlib

    assert row.item_count == 3 and row.sha256 == hashlib.sha256(b"[1, 2, 3]").hexdigest()


def test_store_keeps_the_latest_entry(spark):
    q = spark.createDataFrame([("a", " text "), ("b", "other")], "question_id string, query string")
    keyed = predictions.prediction_key(q, "query", "m")
    old = predictions.entries(keyed.withColumn("t", F.array(F.lit("bud_question"))), "t")
    new = predictions.entries(keyed.filter("question_id = 'a'").withColumn("t", F.array(F.lit("storage_concern"), F.lit("adverse_event"))), "t")
    got = {r.question_id: r.semantic_intent.tags for r in predictions.upsert(old, new).collect()}
    assert got == {"a": ["adverse_event", "storage_concern"], "b": ["bud_question"]}
    bad = old.withColumn("input_hash", F.lit("short"))
    assert predictions.store_violations(bad).first().violations == ["input_hash length"]


def test_work_tables_can_be_cleared(spark):
    import os

    from tracewell.session import clear_work, stored

    kept = stored(spark.range(3), "kept")
    folder = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder) and clear_work(spark) >= 1
    assert not os.path.exists(folder) and clear_work(spark) == 0
