"""Evaluate, compare and ablate retrieval as one tagged job per call."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tracewell.functions.text import lit_array
from tracewell.operators import intents
from tracewell.operators.metrics import (
    best_by,
    failure_difference,
    failures,
    per_tag_metrics,
    question_results,
    retrieval_metrics,
    run_counters,
    tag_metrics,
)
from tracewell.operators.ranking import check_top_k, ranked_sources
from tracewell.operators.search import hybrid_search, keyword_search, vector_search
from tracewell.session import stored
from tracewell.sources.predictions import KEY, entries, prediction_key, upsert
from tracewell.tables.intents import INTENT_SCHEMA_VERSION, STRATEGIES

# A retriever maps (queries, chunks, k, source_type) to result rows; any callable will do. Where stored chunk
# features are given, it gets them as the keyword argument ``index``.
Retriever = Callable[..., DataFrame]

RETRIEVERS: dict[str, Retriever] = {
    "keyword": keyword_search,
    "embedding": vector_search,
    "hybrid": hybrid_search,
}
RUN_KEY = "run_key"


def _retrieved(
    retriever: Retriever, queries: DataFrame, chunks: DataFrame, k: int, source_type: str | None, index: DataFrame | None
) -> DataFrame:
    stored_features = {} if index is None else {"index": index}
    return retriever(queries, chunks, k, source_type, **stored_features)


def evaluate(
    questions: DataFrame,
    chunks: DataFrame,
    k: int = 5,
    retriever: Retriever = keyword_search,
    source_type: str | None = "sop",
    index: DataFrame | None = None,
) -> DataFrame:
    """Per-question results of one retriever.  ``k`` counts chunks before sources are merged.

    ``index``: stored features of the chunks (``sources.chunks.write_term_index``), made once for many runs.
    """
    check_top_k(k)
    queries = questions.select(F.col("question_id").alias("query_id"), F.col("query").alias("query_text"))
    found = _retrieved(retriever, queries, chunks, k, source_type, index)
    sources = ranked_sources(found).withColumnRenamed("query_id", "question_id")
    keep = [c for c in ("query", "rationale") if c in questions.columns]
    return question_results(questions, sources, keep=keep)


def summarize(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hit rate, MRR, negative-constraint rate and failure counts, per group where given."""
    return results.groupBy(*(by or [])).agg(*retrieval_metrics())


def compare(
    retrievers: Mapping[str, Retriever],
    questions: DataFrame,
    chunks: DataFrame,
    k: int = 5,
    source_type: str | None = "sop",
    index: DataFrame | None = None,
) -> DataFrame:
    """Per-question results of several named retrievers, stacked under ``retriever``.

    All of them read the one ``index`` where it is given.
    """
    if not retrievers:
        raise ValueError("retrievers must contain at least one retriever")
    parts = [
        evaluate(questions, chunks, k, run, source_type, index).withColumn("retriever", F.lit(name))
        for name, run in retrievers.items()
    ]
    return stored(reduce(DataFrame.unionByName, parts), "compared")


def comparison(
    results: DataFrame, pairs: list[tuple[str, str]] = (("keyword", "embedding"), ("hybrid", "keyword"))
) -> dict[str, DataFrame]:
    """Summary, best names per metric and failure differences of the named pairs of compared retrievers."""
    summary = stored(summarize(results, ["retriever"]), "comparison")
    known = {r.retriever for r in summary.select("retriever").collect()}
    if unknown := sorted({n for pair in pairs for n in pair} - known):
        raise ValueError(f"retrievers that were not compared: {', '.join(unknown)}")
    best = best_by(summary, "hit_rate_at_k").unionByName(best_by(summary, "mean_reciprocal_rank"))
    differences = reduce(
        DataFrame.unionByName,
        [
            failure_difference(results, a, b).withColumn("pair", F.lit(f"{a}/{b}"))
            for a, b in pairs
        ],
    )
    return {"summary": summary, "best": best, "differences": differences}


def resolve_predictions(
    questions: DataFrame,
    store: DataFrame | None,
    supplied: DataFrame | None,
    model: str,
    version: str = INTENT_SCHEMA_VERSION,
    refresh: bool = False,
) -> DataFrame:
    """Stored prediction, else supplied model output, else rule detection.

    ``supplied``: question_id, model_json.  Adds semantic_tags, store_hit, model_called,
    used_fallback, prediction_status and unknown_tags.
    """
    keyed = prediction_key(questions, "query", model, version)
    if store is None or refresh:
        looked = keyed.withColumn("_stored", F.lit(None).cast("array<string>"))
    else:
        tags = store.select(*KEY, F.col("semantic_intent.tags").alias("_stored"))
        looked = keyed.join(tags, KEY, "left")
    if supplied is None:
        answered = looked.withColumn("model_json", F.lit(None).cast("string"))
    else:
        answered = looked.join(supplied.select("question_id", "model_json"), "question_id", "left")
    parsed = intents.semantic_intents(intents.model_intents(answered), "query", "_rule")
    hit = F.col("_stored").isNotNull()
    ok = F.col("model_status") == "ok"
    return parsed.withColumns(
        {
            "store_hit": hit,
            "model_called": ~hit,
            "used_fallback": ~hit & ~ok,
            "prediction_status": F.when(hit, "stored").otherwise(F.col("model_status")),
            "unknown_tags": F.when(hit, lit_array([])).otherwise(F.col("unknown_tags")),
            "semantic_tags": F.coalesce("_stored", F.when(ok, F.col("model_tags")), "_rule"),
        }
    ).drop("_stored", "_rule", "model_json", "model_status", "model_tags")


def new_store(store: DataFrame, resolved: DataFrame) -> DataFrame:
    """Store contents after a run: only successful model predictions are added."""
    fresh = resolved.filter(F.col("prediction_status") == "ok")
    return upsert(store, entries(fresh, "semantic_tags"))


def build_queries(
    strategies: list[str],
    questions: DataFrame,
    store: DataFrame | None = None,
    supplied: DataFrame | None = None,
    model: str = "supplied",
    refresh: bool = False,
    detector: Callable[[DataFrame], DataFrame] | None = None,
    own: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> DataFrame:
    """Questions rewritten by every strategy, stacked under ``strategy``.

    ``detector`` replaces the rules of rule_intent: it adds semantic_tags to the questions.  ``own``
    names further strategies: each adds search_text, and tags where it has any.
    """
    own = dict(own or {})
    names = list(dict.fromkeys(s.strip() for s in strategies if s.strip()))
    if not names:
        raise ValueError("at least one retrieval query strategy is required")
    unknown = [s for s in names if s not in STRATEGIES and s not in own]
    if unknown:
        raise ValueError(f"unknown retrieval query strategy: {unknown[0]}")
    no_tags = F.lit(None).cast("array<string>")
    absent = {
        "semantic_tags": no_tags,
        "intent_tags": no_tags,
        "store_hit": F.lit(False),
        "model_called": F.lit(False),
        "used_fallback": F.lit(False),
        "prediction_status": F.lit(None).cast("string"),
        "unknown_tags": no_tags,
        "unmapped_tags": no_tags,
        "issue_tags": no_tags,
        "required_topics": no_tags,
        "excluded_topics": no_tags,
    }
    parts = []
    for name in names:
        if name in own:
            built = own[name](questions)
        elif name == "raw":
            built = intents.expand_raw(questions)
        elif name == "deterministic_expansion":
            built = intents.expand_deterministic(questions)
        else:
            if name == "rule_intent":
                tagged = detector(questions) if detector else intents.semantic_intents(questions, "query")
            else:
                tagged = resolve_predictions(questions, store, supplied, model, refresh=refresh)
            derived = intents.derived_intents(tagged)
            built = intents.expand_intent(derived).withColumn(
                "unmapped_tags", intents.unmapped_tags(F.col("intent_tags"))
            )
        missing = {c: v for c, v in absent.items() if c not in built.columns}
        parts.append(
            built.withColumns(missing)
            .withColumn("strategy", F.lit(name))
            .select("strategy", *questions.columns, "search_text", *absent)
        )
    return reduce(DataFrame.unionByName, parts)


def ablate(
    strategies: list[str],
    questions: DataFrame,
    chunks: DataFrame,
    k: int = 5,
    retriever: Retriever = keyword_search,
    source_type: str | None = "sop",
    index: DataFrame | None = None,
    **predictions,
) -> DataFrame:
    """Per-question results of every strategy in one search job.

    All rewritten queries go through the retriever together; each distinct search text is searched
    once, however many strategies or questions share it.  The rewritten queries are stored first:
    the size check, the broadcasts and the final join all read them, and none repeats the rules.
    """
    rewritten = build_queries(strategies, questions, **predictions).withColumn(
        RUN_KEY, F.sha2("search_text", 256)
    )
    built = stored(rewritten, "rewritten-queries")
    queries = built.groupBy(F.col(RUN_KEY).alias("query_id")).agg(F.first("search_text").alias("query_text"))
    found = ranked_sources(_retrieved(retriever, queries, chunks, k, source_type, index)).withColumnRenamed("query_id", RUN_KEY)
    extra = [
        c
        for c in built.columns
        if c not in (RUN_KEY, "expected_source_ids", "forbidden_source_ids")
    ]
    return question_results(built, found, by=RUN_KEY, keep=extra).drop(RUN_KEY)


def ablation_summary(results: DataFrame) -> DataFrame:
    """Retrieval, tag and run metrics per strategy."""
    summary = results.groupBy("strategy").agg(*retrieval_metrics(), *run_counters())
    for predicted, expected, prefix in (
        ("semantic_tags", "expected_semantic_intent_tags", "semantic_intent"),
        ("intent_tags", "expected_intent_tags", "intent"),
    ):
        if expected in results.columns:
            summary = summary.join(
                tag_metrics(results, ["strategy"], predicted, expected, prefix), "strategy"
            )
    return summary


def ablation_tags(results: DataFrame) -> DataFrame:
    """Per-tag metrics per strategy, for semantic and derived tags."""
    semantic = per_tag_metrics(results, ["strategy"], "semantic_tags", "expected_semantic_intent_tags")
    derived = per_tag_metrics(results, ["strategy"], "intent_tags", "expected_intent_tags")
    return semantic.withColumn("kind", F.lit("semantic")).unionByName(derived.withColumn("kind", F.lit("derived")))


__all__ = [
    "RETRIEVERS", "Retriever", "ablate", "ablation_summary", "ablation_tags", "build_queries",
    "compare", "comparison", "evaluate", "failures", "new_store", "resolve_predictions", "summarize",
]
