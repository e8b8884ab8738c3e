"""Views of the driver tables in the shapes the operators expect, in Spark and as SQL.

Concerns and notes are the conversation texts followed by one phrase per row, so that the domain
rules meet wording they know while every row of the tables is processed in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewell.functions.text import lit_array
from tracewell.tables.words import STOP_WORDS

CONCERN_PHRASES = [
    "My dog vomited about 20 minutes after the chicken flavored liquid dose.",
    "The cat threw up after 0.5 ml and seems okay now.",
    "The transdermal pen clicks but nothing came out.",
    "Is the bottle expired; can I use it after the BUD?",
    "We received the wrong medication for a different patient.",
    "The dog refused the tuna flavor and spit it out.",
    "He was hospitalized after the dose and the vet said it was the compound.",
    "She was not hospitalized but had bloody stool and diarrhea.",
    "No report of an ER visit, though he seemed weak and wobbly.",
    "The owner asks who the supplier of the source ingredient is.",
    "Tell me the full ingredient list; are the inactive ingredients vegan?",
    "We will not report to the manufacturer who makes it.",
    "The suspension is too thick and smells weird, lot number A12-77.",
    "It was left on the countertop at room temperature, can it be used?",
    "Is it okay to give it with food, and does absorption change?",
    "The bottle looked low and should have lasted all month.",
    "The liquid has sediment and will not resuspend, same batch as before.",
    "There are sores in the ears at the application site.",
    "Bloodwork values moved in the wrong direction and it is not working.",
    "I will call my lawyer, the cat died on 03/14/2024.",
    "Please look up the order page and the stock status.",
    "What does the package insert say about drug interactions and toxicity?",
    "Did this medication cause the seizure? I want legal advice.",
    "He was drooling and foaming at the mouth right after the beef flavor.",
    "Reading the syringe from the wrong side gave a short fill.",
    "The pen happened to be in the budget box.",
    "Shortness of breath and gagging were reported, later he recovered.",
    "Possible contamination, mold and foreign material were found.",
    "The air bubbles in the device mean it is not dispensing, 12 clicks each dose.",
    "Nothing else was mentioned.",
    "He was taken to the emergency hospital and never admitted, then admitted again.",
    "The regulatory board of pharmacy was notified; the state board is involved.",
]

NOTE_PHRASES = [
    "Record review was complete and no discrepancy was found.",
    "Worksheet review normal. Lot review: no similar complaints for the lot.",
    "The documentation incomplete flag is set; dose is unknown.",
    "Documentation discrepancy confirmed: label was for a different patient.",
    "Wrong medication was ruled out; correct medication and patient verified.",
    "Inventory was not available to inspect. Trend threshold was met.",
    "Inventory not checked; batch trend unavailable.",
    "Inspection found no concern; retained inventory reviewed.",
    "Foreign material observed during direct inspection, possible contamination confirmed.",
    "The external reference was reviewed; used the commercial package insert.",
    "The package insert is not supported by the public corpus.",
    "Supplier details cannot be disclosed. Reference was not needed.",
    "External reference needed for the dose range.",
    "Synthetic reference consulted. Similar complaints were found in the same batch.",
    "No severe escalation trigger. The dog was not hospitalized and no death was reported.",
    "The veterinarian alleged harm, and the pet died.",
    "Similar concern found for the same medication. Hospitalization was ruled out.",
    "Confirm storage temperature; clarify the vet recommendations.",
    "Determine whether the lot was affected; still need syringe details.",
    "Could not confirm whether the medication came out of the pen.",
    "Unresolved investigation items: confirm the packaging seal",
    "Dose appropriateness could not be evaluated. Event timeline missing.",
    "The owner maybe gave 2 ml; unclear if symptoms resolved after 3 hours.",
    "Two additional quality complaints were identified for the lot.",
    "No other quality complaints from the batch. Inventory inspection not applicable.",
    "Nothing off in the formula and worksheet.",
    "Attorney mentioned but no legal action was reported.",
    "Without evidence of mold; same lot no similar issue was documented.",
    "Need to confirm the dose. Unknown number of doses; missing rotation of the transdermal site.",
    "Resolved on 2024-05-01 after the vet was contacted, no ER visit.",
]

MODEL_ANSWERS = [
    '{"tags": ["device_concern", "Bud Question"]}',
    '```json\n{"tags": ["gastrointestinal"]}\n```',
    '{"tags": ["gastrointestinal", "billing"]}',
    '{"tags": "gastrointestinal"}',
    '{"tags": [], "note": "x"}',
    "not json",
    '{"tags": ["adverse-event", "supplier_question", "adverse_event"]}',
]


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table as it is stored.

    Only a table with fewer splits than cores is dealt out to them; a large one never moves.
    """
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def pick(options: list[str], n: Column) -> Column:
    """Option number ``n`` modulo the number of options."""
    return F.get(lit_array(options), (n % len(options)).cast("int"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("chunk_id"),
        F.col("source").alias("source_id"),
        F.concat("lang", F.lit(".md")).alias("source_file"),
        F.concat_ws(" ", F.lit("collection"), "source").alias("source_title"),
        F.when(F.col("lang") == "en", "sop").otherwise("synthetic_inquiry").alias("source_type"),
        F.substring_index("text", "\n", 1).alias("section_heading"),
        F.col("lang").alias("process_area"),
        F.lit("1.0").alias("version"),
        F.lit("2024-01-01").alias("effective_date"),
        F.lit(True).alias("synthetic"),
        "text",
    )


def queries(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items labelled with expected and forbidden sources and tags."""
    source = lambda n: F.concat(F.lit("src"), (n % 20).cast("string"))
    i = F.col("item_id")
    return load(spark, sf, "benchmark").select(
        i.cast("string").alias("question_id"),
        F.concat_ws(" ", "text", pick(CONCERN_PHRASES, i)).alias("query"),
        F.array(source(i), source(i + 7), source(i + 11)).alias("expected_source_ids"),
        F.array(source(i + 3)).alias("forbidden_source_ids"),
        F.when(i % 3 == 0, lit_array([]))
        .when(i % 3 == 1, lit_array(["adverse_event", "gastrointestinal"]))
        .otherwise(lit_array(["device_concern", "bud_question"]))
        .alias("expected_semantic_intent_tags"),
        F.when(i % 3 == 0, lit_array([]))
        .when(i % 3 == 1, lit_array(["adverse_event", "gastrointestinal", "adverse_event_review"]))
        .otherwise(lit_array(["device_concern", "quality_review", "trend_review"]))
        .alias("expected_intent_tags"),
    )


def concerns(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation turn as a concern."""
    n = F.col("conv_id") * 5 + F.col("turn") * 3
    return load(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("case_id"),
        F.concat_ws(" ", "text", pick(CONCERN_PHRASES, n)).alias("concern_text"),
    )


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """Every user turn followed by an answer: concern, note and supplied summary JSON."""
    turns = load(spark, sf, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("_asked"))
    answered = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("_answered")
    )
    n = F.col("conv_id") * 5 + F.col("turn") * 3
    limit = F.when(n % 4 == 0, "null").when(n % 4 == 1, '"N/A"').when(n % 4 == 2, '["seen once", "none", "seen once"]').otherwise('"single item"')
    body = F.concat(
        F.lit('{"record_review_result": "No Discrepancy-Found", "lot_batch_pattern_summary": "unavailable", '),
        F.lit('"inventory_inspection_result": "not_checked", "customer_context_summary": "'),
        F.concat(F.lit("case "), n.cast("string")),
        F.lit('", "api_reference_review_result": "not needed", "missing_information": ["x"], '),
        F.lit('"evidence_limitations": '),
        limit,
        F.lit(', "severe_triggers_observed": []}'),
    )
    return asked.join(answered, ["conv_id", "turn"]).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("case_id"),
        n.alias("n"),
        F.concat_ws(" ", "_asked", pick(CONCERN_PHRASES, n)).alias("concern_text"),
        F.concat_ws(". ", "_answered", pick(NOTE_PHRASES, F.col("conv_id") * 7 + F.col("turn"))).alias("reviewer_note"),
        F.when(n % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(n % 5 == 1, F.concat(F.lit("Here it is: "), body))
        .when(n % 11 == 2, F.lit("no answer"))
        .otherwise(body)
        .alias("model_json"),
    )


# ------------------------------------------------------------------ the same views in SQL


def sql_list(values) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_strip(x: str) -> str:
    codes = (32, 9, 10, 11, 12, 13, 28, 29, 30, 31, 133, 160)
    return f"trim({x}, {' || '.join(f'chr({c})' for c in codes)})"


def sql_tokens(x: str) -> str:
    return (
        f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), "
        f"lambda t: length(t) > 1 AND NOT list_contains({sql_list(STOP_WORDS)}, t))"
    )


def sql_ascii(x: str) -> str:
    """Accented letters as plain ones: the SQL engine's word boundary knows ASCII only."""
    return f"regexp_replace({x}, '[À-ÖØ-öø-ÿŒœ]', 'z', 'g')"


def sql_rx(x: str, pattern: str, ignore_case: bool = True) -> str:
    flag = "(?i)" if ignore_case else ""
    return f"regexp_matches({x}, {sql_text(flag + pattern)})"


def sql_any(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {sql_text(w)})" for w in terms) + ")"


def sql_pick(options: list[str], n: str) -> str:
    return f"{sql_list(options)}[({n}) % {len(options)} + 1]"


_N = "(conv_id * 5 + turn * 3)"

VIEWS: dict[str, str] = {
    "chunks": """
        SELECT 'doc-' || doc_id AS chunk_id, source AS source_id, lang || '.md' AS source_file,
               'collection ' || source AS source_title,
               CASE WHEN lang = 'en' THEN 'sop' ELSE 'synthetic_inquiry' END AS source_type,
               split_part(text, chr(10), 1) AS section_heading, lang AS process_area, text
        FROM documents""",
    "asked": "SELECT item_id AS query_id, text AS query_text FROM benchmark",
    "questions": f"""
        SELECT CAST(item_id AS VARCHAR) AS question_id,
               text || ' ' || {sql_pick(CONCERN_PHRASES, 'item_id')} AS query,
               ['src' || (item_id % 20), 'src' || ((item_id + 7) % 20), 'src' || ((item_id + 11) % 20)]
                   AS expected_source_ids,
               ['src' || ((item_id + 3) % 20)] AS forbidden_source_ids,
               CASE item_id % 3 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['adverse_event', 'gastrointestinal']
                    ELSE ['device_concern', 'bud_question'] END AS expected_semantic_intent_tags,
               CASE item_id % 3 WHEN 0 THEN CAST([] AS VARCHAR[])
                    WHEN 1 THEN ['adverse_event', 'gastrointestinal', 'adverse_event_review']
                    ELSE ['device_concern', 'quality_review', 'trend_review'] END AS expected_intent_tags
        FROM benchmark""",
    "concerns": f"""
        SELECT conv_id || '-' || turn AS case_id,
               text || ' ' || {sql_pick(CONCERN_PHRASES, _N)} AS concern_text
        FROM conversations""",
    "cases": f"""
        SELECT conv_id || '-' || turn AS case_id, {_N} AS n,
               u.text || ' ' || {sql_pick(CONCERN_PHRASES, _N)} AS concern_text,
               a.text || '. ' || {sql_pick(NOTE_PHRASES, 'conv_id * 7 + turn')} AS reviewer_note
        FROM (SELECT conv_id, turn, text FROM conversations WHERE role = 'user') u
        JOIN (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant') a
        USING (conv_id, turn)""",
    # one row per chunk and distinct term
    "chunk_tokens": f"""
        SELECT chunk_id, unnest({sql_tokens("source_title || ' ' || section_heading || ' ' || text")}) AS term
        FROM chunks""",
    "chunk_terms": f"""
        SELECT t.chunk_id, term, t.dcount,
               list_contains({sql_tokens('source_title')}, term) AS in_title,
               list_contains({sql_tokens('section_heading')}, term) AS in_heading
        FROM (SELECT chunk_id, term, count(*) AS dcount FROM chunk_tokens GROUP BY ALL) t
        JOIN chunks USING (chunk_id)""",
    "query_terms": f"""
        SELECT query_id, term, count(*) AS qcount
        FROM (SELECT query_id, unnest({sql_tokens('query_text')}) AS term FROM asked) GROUP BY ALL""",
    "keyword_pairs": """
        SELECT query_id, chunk_id,
               CAST(sum(qcount * least(dcount, 3) + CASE WHEN in_title THEN 2 ELSE 0 END
                        + CASE WHEN in_heading THEN 1 ELSE 0 END) AS DOUBLE) AS score,
               list_sort(list(term)) AS matched_terms
        FROM query_terms JOIN chunk_terms USING (term) GROUP BY ALL""",
    "chunk_buckets": """
        SELECT chunk_id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 128 AS bucket,
               sum(dcount) AS w
        FROM chunk_terms GROUP BY ALL""",
    "query_buckets": """
        SELECT query_id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 128 AS bucket,
               sum(qcount) AS w
        FROM query_terms GROUP BY ALL""",
    "vector_pairs": """
        SELECT query_id, chunk_id, CAST(sum(q.w * c.w) AS DOUBLE) / (any_value(qn) * any_value(cn)) AS score
        FROM query_buckets q JOIN chunk_buckets c USING (bucket)
        JOIN (SELECT query_id, sqrt(CAST(sum(w * w) AS DOUBLE)) AS qn FROM query_buckets GROUP BY ALL) USING (query_id)
        JOIN (SELECT chunk_id, sqrt(CAST(sum(w * w) AS DOUBLE)) AS cn FROM chunk_buckets GROUP BY ALL) USING (chunk_id)
        GROUP BY ALL""",
    "hybrid_pairs": """
        SELECT query_id, chunk_id, coalesce(k.score, 0.0::DOUBLE) AS keyword_score,
               coalesce(v.score, 0.0::DOUBLE) AS vector_score, coalesce(k.matched_terms, []) AS matched_terms
        FROM keyword_pairs k FULL JOIN vector_pairs v USING (query_id, chunk_id)""",
    "hybrid_scored": """
        SELECT *, 0.65::DOUBLE * (keyword_score / nullif(max(keyword_score) OVER (PARTITION BY query_id), 0))
                  + 0.35::DOUBLE * (vector_score / max(vector_score) OVER (PARTITION BY query_id)) AS score
        FROM hybrid_pairs""",
}

NEEDS: dict[str, list[str]] = {
    "chunk_tokens": ["chunks"],
    "chunk_terms": ["chunk_tokens", "chunks"],
    "query_terms": ["asked"],
    "keyword_pairs": ["query_terms", "chunk_terms"],
    "chunk_buckets": ["chunk_terms"],
    "query_buckets": ["query_terms"],
    "vector_pairs": ["query_buckets", "chunk_buckets"],
    "hybrid_pairs": ["keyword_pairs", "vector_pairs"],
    "hybrid_scored": ["hybrid_pairs"],
}


def with_views(names: list[str], body: str, **replaced: str) -> str:
    """``body`` preceded by the named views and what they need; ``replaced`` swaps definitions."""
    done: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []) if name not in replaced else []:
            add(other)
        if name not in done:
            done.append(name)

    for name in replaced:
        if name not in VIEWS:
            done.append(name)
    for name in names:
        add(name)
    parts = [f"{n} AS MATERIALIZED ({replaced.get(n) or VIEWS[n]})" for n in done]
    return "WITH " + ",\n".join(parts) + "\n" + body
