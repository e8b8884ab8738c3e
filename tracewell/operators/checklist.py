"""Intake checklist: checks, missing items, triggers to rule out, and attached evidence."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructType

from tracewell.functions.text import any_of, humanize, lit_array, rx, strip
from tracewell.operators.ranking import check_top_k, top_k
from tracewell.operators.search import keyword_winners
from tracewell.operators.terms import scoring_text
from tracewell.operators.triage import (
    LANE_FLAGS,
    TYPE_FLAGS,
    concern_flags,
    concern_query,
    concern_type_of,
    drop_flags,
    list_map,
    risk_lane_of,
)
from tracewell.session import broadcast_if_bounded, prepare, stored
from tracewell.tables import triage as t

# Distinct texts that a task holds while it attaches them, and texts of one Arrow batch that it returns.
TEXT_BYTES = 128 << 20
RETURNED_BYTES = 16 << 20
CHUNK_TEXTS = ["source_id", "source_title", "source_type", "section_heading", "text"]


def phrase_marks(terms=None) -> Column:
    """Array of the rerank phrases that the text of a chunk row contains."""
    phrases = sorted({p for _, listed in (terms or t.CONCERN_RERANK_TERMS).items() for p in listed})
    low = F.lower(scoring_text())
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in phrases)))


def rerank(results: DataFrame, k: int, terms=None, bonus: float = t.RERANK_BONUS) -> DataFrame:
    """Raise scores by ``bonus`` per preferred phrase of the concern type and keep ``k``.

    ``results`` carries concern_type and either marks (``phrase_marks`` of the chunk) or the chunk
    text columns.  A type without phrases leaves the order unchanged.
    """
    marks = F.col("marks") if "marks" in results.columns else phrase_marks(terms)
    wanted = F.coalesce(list_map(terms or t.CONCERN_RERANK_TERMS)[F.col("concern_type")], lit_array([]))
    marked = results.withColumns({"_wanted": wanted, "_marks": marks})
    hits = F.size(F.filter("_wanted", lambda w: F.array_contains("_marks", w)))
    raised = marked.withColumn("score", F.col("score") + hits * F.lit(bonus)).drop("rank", "_wanted", "_marks", "marks")
    return top_k(raised, k)


def evidence_citation(results: DataFrame) -> DataFrame:
    """One row per query with its citations in rank order; at most k per query."""
    citation = F.struct(
        "rank",
        "chunk_id",
        "source_id",
        "source_title",
        "source_type",
        "section_heading",
        "score",
        "matched_terms",
        F.col("text").alias("supporting_text"),
    )
    return results.groupBy("query_id").agg(F.array_sort(F.collect_list(citation)).alias("evidence"))


def _attached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a part with the texts of their citations; the chunks of a part come first."""
    part, held, places, size = None, [], {}, np.zeros(0, np.int64)
    for batch in (some for whole in batches for some in _by_part(whole)):
        if batch.column("part")[0].as_py() != part:
            part, held, places = batch.column("part")[0].as_py(), [], {}
        chunks = batch.filter(pc.equal(batch.column("kind"), 0)).column("chunk")
        if len(chunks):
            first = sum(map(len, held))
            for n, name in enumerate(chunks.field("chunk_id").to_pylist(), first):
                places.setdefault(name, []).append(n)
            # Chunk after chunk stays as it came; it becomes one array when the first row is met.
            held.append(chunks)
        rows = batch.filter(pc.equal(batch.column("kind"), 1)).column("row")
        if not len(rows):
            continue
        if len(held) != 1:
            held = [pa.concat_arrays(held)] if held else [chunks]
        known = held[0]
        size = sum(np.asarray(pc.fill_null(pc.binary_length(known.field(c)), 0)) for c in ("section_heading", "text"))
        cites = rows.field("cites")
        items, owner = cites.flatten(), pc.list_parent_indices(cites).to_numpy()
        pairs = [(n, at) for n, name in enumerate(items.field("chunk_id").to_pylist()) for at in places.get(name, ())]
        cite, chunk = np.array(pairs, np.int64).reshape(-1, 2).T
        # Rows are returned in runs whose texts stay below the limit.
        ends = np.cumsum(np.bincount(owner[cite], weights=size[chunk], minlength=len(rows)))
        cuts = np.unique([0, *np.searchsorted(ends, np.arange(RETURNED_BYTES, ends[-1], RETURNED_BYTES))])
        for a, b in zip(cuts, [*cuts[1:], len(rows)]):
            low, high = np.searchsorted(owner[cite], [a, b])
            its, own = items.take(pa.array(cite[low:high])), known.take(pa.array(chunk[low:high]))
            fields = {"rank": its.field("rank"), "chunk_id": its.field("chunk_id")}
            fields |= {c: own.field(c) for c in CHUNK_TEXTS[:-1]}
            fields |= {"score": its.field("score"), "matched_terms": its.field("matched_terms"), "supporting_text": own.field("text")}
            offsets = np.searchsorted(owner[cite[low:high]], np.arange(a, b + 1)).astype(np.int32)
            evidence = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
            yield pa.RecordBatch.from_arrays([rows.slice(a, b - a), evidence], names=["row", "evidence"])


def _by_part(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    parts = batch.column("part").to_numpy()
    cuts = [*np.flatnonzero(np.diff(parts, prepend=-1)), len(parts)]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]))


def with_evidence(rows: DataFrame, best: DataFrame, chunks: DataFrame) -> DataFrame:
    """``rows`` (query_id) with ``evidence``: the ``evidence_citation`` of its query, empty where there is none.

    A text that many queries cite does not move once for each of them: rows go into parts of similar best scores, which
    cite much the same chunks, every part gets each text once, and its task puts the texts into the rows. There are
    as many parts as the measured texts of a part need to fit a task.
    """
    spark = rows.sparkSession
    prepare(spark)
    cite = F.struct("rank", "chunk_id", "score", "matched_terms")
    cited = rows.join(best.groupBy("query_id").agg(F.collect_list(cite).alias("cites")), "query_id", "left")
    cited = stored(cited, "cited")
    top = F.coalesce(F.array_max(F.transform("cites", lambda c: c["score"])), F.lit(0.0))
    texts = chunks.select("chunk_id", *CHUNK_TEXTS).join(
        broadcast_if_bounded(stored(best.select("chunk_id").distinct(), "cited-chunks")), "chunk_id", "left_semi"
    )
    texts = stored(texts, "cited-texts")
    size = sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in ("section_heading", "text"))
    sizes = broadcast_if_bounded(stored(texts.groupBy("chunk_id").agg(F.sum(size).alias("size")), "text-sizes"))
    before, parts = None, 3 * spark.sparkContext.defaultParallelism
    while True:
        placed = cited.repartitionByRange(parts, top, "query_id").withColumn("part", F.spark_partition_id())
        placed = stored(placed, "placed")
        needed = stored(placed.select("part", F.explode("cites.chunk_id").alias("chunk_id")).distinct(), "needed")
        most = needed.join(sizes, "chunk_id").groupBy("part").agg(F.sum("size").alias("size")).agg(F.max("size")).first()[0] or 0
        # Where smaller parts do not help, some rows have too long texts of their own.
        if most <= TEXT_BYTES or (before is not None and most > 0.8 * before):
            break
        before, parts = most, parts * min(16, max(2, ceil(most / TEXT_BYTES)))
    row, chunk = F.struct(*cited.columns), F.struct("chunk_id", *CHUNK_TEXTS)
    kinds = {"row": placed.select(row.alias("x")).schema["x"].dataType, "chunk": texts.select(chunk.alias("x")).schema["x"].dataType}
    sent = texts.join(broadcast_if_bounded(needed), "chunk_id").select(
        "part", F.lit(0).alias("kind"), chunk.alias("chunk"), F.lit(None).cast(kinds["row"]).alias("row")
    )
    sent = sent.unionByName(placed.select("part", F.lit(1).alias("kind"), F.lit(None).cast(kinds["chunk"]).alias("chunk"), row.alias("row")))
    dealt = sent.repartition(parts, "part").sortWithinPartitions("part", "kind")
    types = {n: best.schema[n].dataType for n in ("rank", "chunk_id", "score", "matched_terms")} | {n: texts.schema[n].dataType for n in CHUNK_TEXTS}
    order = ["rank", "chunk_id", *CHUNK_TEXTS[:-1], "score", "matched_terms", "text"]
    evidence = StructType()
    for name in order:
        evidence = evidence.add("supporting_text" if name == "text" else name, types[name])
    schema = StructType().add("row", kinds["row"]).add("evidence", ArrayType(evidence))
    found = dealt.mapInArrow(_attached, schema)
    return found.select(*(F.col("row")[c].alias(c) for c in rows.columns), F.array_sort("evidence").alias("evidence"))


def _has(name: str) -> Column:
    return F.col(f"_has_{name}")


def review_checks_of(evidence: str | None = None) -> Column:
    """Array of (check_name, required, rationale, evidence) for the flags of a row."""
    none = F.array().cast("array<string>")
    checks = []
    for lexicon, _, name, rationale, shown in t.REVIEW_CHECKS:
        item = F.struct(
            F.lit(name).alias("check_name"),
            F.lit(True).alias("required"),
            F.lit(rationale).alias("rationale"),
            (F.slice(evidence, 1, shown) if evidence else none).alias("evidence"),
        )
        checks.append(item if lexicon is None else F.when(_has(lexicon), item))
    return F.array_compact(F.array(*checks))


def missing_information_of(known: Column, species=None, dosage_form=None, flavor=None) -> Column:
    """Ordered distinct items that neither the text nor the supplied facts answer.

    ``known`` is the lower-cased text plus supplied facts; the optional columns tell that a fact
    was supplied in structured form.
    """

    def supplied(flag: Column | None) -> Column:
        return F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))

    answered = {
        "species": _has("species") | supplied(species),
        "dosage_form": _has("dosage_form") | supplied(dosage_form),
        "flavor": _has("flavor") | supplied(flavor),
        "air_bubble": any_of(known, t.AIR_BUBBLE_TERMS),
        "swallowed": any_of(known, t.SWALLOWED_TERMS),
        **{name: rx(known, pattern) for name, pattern in t.FACT_PATTERNS.items()},
    }
    items = []
    for lexicon, item, fact in t.MISSING_ITEMS:
        wanted = F.lit(True) if lexicon is None else _has(lexicon)
        if fact is not None:
            wanted = wanted & ~answered[fact]
        items.append(F.when(wanted, F.lit(item)))
    return F.array_distinct(F.array_compact(F.array(*items)))


def triggers_to_rule_out_of(low: Column) -> Column:
    extra = F.when(any_of(low, t.LOT_TRIGGER_TERMS), lit_array([t.LOT_TRIGGER])).otherwise(lit_array([]))
    return F.concat(lit_array(t.TRIGGERS_TO_RULE_OUT), extra)


CHECKLIST_FLAGS = list(dict.fromkeys(TYPE_FLAGS + LANE_FLAGS + ["species", "dosage_form"]))


def checklist_rules(df: DataFrame, text: str = "concern_text", evidence: str | None = None, facts: bool = False) -> DataFrame:
    """Add every checklist column that follows from the text alone.

    With ``facts`` the optional columns facts_text, known_species, known_dosage_form and
    known_flavor refine the missing items.
    """
    flagged = concern_flags(df, text, CHECKLIST_FLAGS)
    known = F.concat_ws(" ", "_low", F.lower("facts_text")) if facts else F.col("_low")
    extra = [F.col(c) if facts else None for c in ("known_species", "known_dosage_form", "known_flavor")]
    return drop_flags(
        flagged.withColumn("_has_known", known).withColumns(
            {
                "concern_type": concern_type_of(),
                "risk_lane": risk_lane_of(),
                "review_checks": review_checks_of(evidence),
                "missing_information": missing_information_of(F.col("_has_known"), *extra),
                "triggers_to_rule_out": triggers_to_rule_out_of(F.col("_low")),
                "limitations": lit_array(t.LIMITATIONS),
            }
        )
    )


def intake_checklist(
    concerns: DataFrame,
    chunks: DataFrame,
    k: int = 5,
    source_type: str | None = "sop",
    facts: bool = False,
    index: DataFrame | None = None,
    strict: bool = False,
) -> DataFrame:
    """Full checklist per concern (case_id, concern_text) with reranked evidence.

    Over-fetches 3k chunks per concern, reranks by concern type, keeps k, and attaches them.  The rules
    run once and are stored; the over-fetched rows carry no text, only the phrases that each chunk holds,
    and the texts are attached to the k winners.  ``concern_status`` is blank for null and white concerns,
    which have no evidence; ``strict`` refuses them.
    """
    check_top_k(k)
    status = F.when(strip(F.coalesce("concern_text", F.lit(""))) == "", "blank").otherwise("ok")
    ruled = checklist_rules(concerns.withColumn("concern_status", status), facts=facts)
    typed = stored(concern_query(ruled.withColumn("query_id", F.col("case_id"))), "typed-concerns")
    if strict and typed.filter("concern_status = 'blank'").limit(1).count():
        raise ValueError("concern text must not be blank")
    asked = typed.filter("concern_status = 'ok'")
    found = stored(keyword_winners(asked.select("query_id", "query_text"), chunks, 3 * k, source_type, index), "found")
    sought = broadcast_if_bounded(stored(found.select("chunk_id").distinct(), "found-chunks"))
    held = chunks.join(sought, "chunk_id", "left_semi").select("chunk_id", phrase_marks().alias("marks"))
    marked = held.join(broadcast_if_bounded(found), "chunk_id").join(typed.select("query_id", "concern_type"), "query_id")
    best = stored(rerank(marked, k).drop("concern_type"), "reranked")
    cited = with_evidence(typed, best, chunks)
    checks = F.transform(
        "review_checks",
        lambda c: c.withField(
            "evidence",
            F.slice("evidence", F.lit(1), F.coalesce(_citations_shown()[c["check_name"]], F.lit(2))),
        ),
    )
    return cited.withColumn("review_checks", checks).drop("query_id", "query_text")


def _citations_shown() -> Column:
    return F.create_map(*[c for _, _, name, _, n in t.REVIEW_CHECKS for c in (F.lit(name), F.lit(n))])


def review_contract(checklists: DataFrame) -> DataFrame:
    """Project checklists into the output record: keys, derived scope and takeaway sentence."""
    keys = F.create_map(*[F.lit(x) for _, key, name, _, _ in t.REVIEW_CHECKS for x in (name, key)])
    scope = (
        F.when(F.col("risk_lane") == "life_threatening_or_legal", "escalation_review")
        .when(F.col("concern_type") == "bud_question", "guidance_only")
        .otherwise("full_quality_review")
    )
    fallback = lambda name: F.coalesce(
        F.nullif(F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_")), F.lit("")),
        F.lit("check"),
    )
    return checklists.withColumns(
        {
            "review_scope": scope,
            "initial_takeaway": F.concat(
                F.lit("Initial screen suggests "),
                humanize(F.col("concern_type")),
                F.lit(" with "),
                humanize(F.col("risk_lane")),
                F.lit(
                    " risk lane. Final routing depends on review findings and confirmed escalation triggers."
                ),
            ),
            "required_checks": F.transform(
                "review_checks",
                lambda c: F.struct(
                    F.coalesce(keys[c["check_name"]], fallback(c["check_name"])).alias("key"),
                    c["check_name"].alias("label"),
                    c["required"].alias("required"),
                    c["rationale"].alias("reason"),
                ),
            ),
        }
    )
