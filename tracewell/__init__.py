"""Bulk evidence retrieval, rule-based triage and evaluation on Spark DataFrames."""

from tracewell.operators.assessment import decide, final_assessment, final_risk_lane, product_context
from tracewell.operators.checklist import intake_checklist, review_contract
from tracewell.operators.dense import dense_search, embed_with
from tracewell.operators.intents import derived_intents, model_intents, semantic_intents
from tracewell.operators.search import hybrid_search, keyword_search, vector_search
from tracewell.operators.summary import extract_summary
from tracewell.operators.triage import concern_query, concern_type, refusal, risk_lane, triage
from tracewell.plans.evaluate import ablate, compare, evaluate, summarize
from tracewell.plans.records import batch_review, compare_records, evaluate_extraction
from tracewell.session import build_session, clear_work
from tracewell.sources.chunks import read_chunks, write_chunks
from tracewell.sources.corpus import read_corpus, section_chunks
from tracewell.streaming.requests import start_retrieve, start_triage, triage_stream

__all__ = [name for name in dir() if not name.startswith("_")]
