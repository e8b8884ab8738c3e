"""Ingestion, stores, ablation, record evaluation, checklists with evidence, and streams."""

from pyspark.sql import functions as F

from tracewell.functions import text as tx
from tracewell.functions.hashing import vocabulary_buckets
from tracewell.operators import checklist, intake, summary, validation
from tracewell.operators.search import keyword_search
from tracewell.operators.terms import chunk_terms
from tracewell.plans import evaluate as ev, records as rec
from tracewell.session import stored, work_folder
from tracewell.sources import chunks as chunk_source, corpus, evidence_index, prediction_log, predictions, questions as question_source, runs
from tracewell.sources.file_digests import streamed_manifest
from tracewell.streaming import requests
from tracewell.tables import intents as ti, triage as tt
from tracewell.tables.intents import SEMANTIC_TAGS
from workload import inputs as i, rules
from workload.inputs import sql_list, sql_strip, sql_text, with_views
from workload.registry import query
from workload.retrieval import METRICS, RANK, SOP_CHUNKS, judged_sql

joined, sql_join = rules.joined, rules.sql_join

# ------------------------------------------------------------------ corpus

HEADING = r"(?m)^([^.\n]{1,80})\.[ ]*"


def markdown_files(spark, sf):
    """Every document as a markdown file with a metadata block; some blocks are broken."""
    d = F.col("doc_id")
    block = lambda *lines: F.concat_ws("\n", *lines)
    ident = F.concat(F.lit("document_id: D"), d.cast("string"))
    title = F.concat(F.lit('title: "'), "source", F.lit(': notes"'))
    rest = [F.lit('version: "1.0"'), F.lit("effective_date: '2024-01-01'"), F.concat(F.lit("process_area: "), "lang"), F.lit("source_type: sop")]
    body = F.regexp_replace("text", HEADING, "## $1\n")
    good = block(F.lit("---"), ident, title, *rest, F.lit("synthetic: True"), F.lit("---"), F.lit(""), F.lit("# Intro"), F.lit(""), body)
    value = (
        F.when(d % 9 == 1, F.concat(F.lit("text first\n"), good))
        .when(d % 9 == 2, block(F.lit("---"), ident, title, *rest, F.lit("synthetic: true")))
        .when(d % 9 == 3, block(F.lit("---"), ident, *rest, F.lit("synthetic: true"), F.lit("---"), body))
        .when(d % 9 == 4, block(F.lit("---"), ident, F.lit("no colon here"), title, *rest, F.lit("---"), body))
        .when(d % 9 == 5, block(F.lit("---"), ident, title, F.lit("title: second"), *rest, F.lit("synthetic: true"), F.lit("---"), body))
        .when(d % 9 == 6, block(F.lit("---"), ident, title, *rest, F.lit("synthetic: false"), F.lit("---"), body))
        .otherwise(good)
    )
    return i.load(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), d.cast("string"), F.lit(".md")).alias("source_file"), value.alias("value")
    )


_md = f"regexp_replace(text, {sql_text(HEADING)}, '## \\1' || chr(10), 'g')"
DOCS_SQL = f"""
    docs AS (SELECT doc_id, doc_id % 9 AS v, source, lang,
        CASE WHEN doc_id % 9 IN (3, 4, 5, 6) THEN {_md} ELSE '# Intro' || chr(10) || chr(10) || {_md} END AS raw FROM documents),
    parsed AS (SELECT *, {sql_strip('raw')} AS body_text FROM docs)"""


@query(
    "S1_P1_read_corpus",
    f"""WITH {DOCS_SQL}
        SELECT 'doc-' || doc_id || '.md' AS source_file,
            CASE WHEN v NOT IN (1, 2) THEN 'D' || doc_id END AS document_id,
            CASE WHEN v IN (1, 2, 3) THEN NULL WHEN v = 5 THEN 'second' ELSE source || ': notes' END AS title,
            CASE WHEN v NOT IN (1, 2) THEN '1.0' END AS version, CASE WHEN v NOT IN (1, 2) THEN '2024-01-01' END AS effective_date,
            CASE v WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 4 THEN NULL WHEN 6 THEN false ELSE true END AS synthetic,
            CASE v WHEN 1 THEN 'must start with a metadata block' WHEN 2 THEN 'metadata block is not closed'
                   WHEN 3 THEN 'missing metadata fields: title' WHEN 4 THEN 'invalid metadata line: no colon here'
                   WHEN 6 THEN 'synthetic must be true' END AS error,
            CASE WHEN v NOT IN (1, 2) THEN md5(body_text) END AS body_hash
        FROM parsed""",
)
def s1(spark, sf):
    docs = corpus.parse_documents(markdown_files(spark, sf))
    kept = F.col("error") == "must start with a metadata block"
    shown = {c: F.when(~F.coalesce(kept, F.lit(False)), F.col(c)) for c in ("document_id", "title", "version", "effective_date", "synthetic", "body_text")}
    return docs.withColumns(shown).select(
        "source_file", "document_id", "title", "version", "effective_date", "synthetic", "error", F.md5("body_text").alias("body_hash")
    )


@query(
    "P2_P3_P4_W4_section_chunks",
    f"""WITH {DOCS_SQL},
        parts AS (SELECT doc_id, v, source, body_text, string_split_regex(body_text, '(?m)^##\\s+') AS p FROM parsed WHERE v NOT IN (1, 2, 3, 4, 6)),
        pieces AS (SELECT doc_id, v, source, generate_subscripts(p[2:], 1) AS k, unnest(p[2:]) AS piece FROM parts
                   UNION ALL SELECT doc_id, v, source, 1, 'Document' || chr(10) || body_text FROM parts WHERE len(p) = 1),
        cut AS (SELECT doc_id, k, v, source, {sql_strip("split_part(piece, chr(10), 1)")} AS heading,
                {sql_strip("CASE WHEN contains(piece, chr(10)) THEN substr(piece, strpos(piece, chr(10)) + 1) ELSE '' END")} AS body,
                piece LIKE 'Document' || chr(10) || '%' AND doc_id IN (SELECT doc_id FROM parts WHERE len(p) = 1) AS plain FROM pieces),
        slugged AS (SELECT *, trim(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM cut WHERE body <> ''),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY k) AS nth FROM slugged)
        SELECT 'D' || doc_id || '::' || slug || CASE WHEN nth > 1 THEN '-' || nth ELSE '' END AS chunk_id,
               'D' || doc_id AS source_id, CASE WHEN v = 5 THEN 'second' ELSE source || ': notes' END AS source_title,
               heading AS section_heading,
               md5({sql_strip("regexp_replace(CASE WHEN plain THEN body ELSE heading || chr(10) || chr(10) || body END, '[ \\t]+(\\n)', '\\1', 'g')")}) AS text_hash
        FROM numbered""",
)
def p2(spark, sf):
    sections = corpus.section_chunks(corpus.parse_documents(markdown_files(spark, sf)))
    return sections.select("chunk_id", "source_id", "source_title", "section_heading", F.md5("text").alias("text_hash"))


@query(
    "S2_chunk_lines",
    f"""WITH chunks AS ({i.VIEWS['chunks']})
        SELECT chunk_id, source_id, source_type, section_heading, md5(text) AS text_hash, '' AS violations FROM chunks""",
)
def s2(spark, sf):
    path = work_folder(spark, "chunks")
    chunk_source.write_chunks(i.chunks(spark, sf), path)
    back = chunk_source.read_chunks(spark, path)
    return back.select(
        "chunk_id", "source_id", "source_type", "section_heading", F.md5("text").alias("text_hash"), *joined("violations")
    )


@query(
    "S2_V1_broken_chunk_lines",
    """SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'not a JSON object' WHEN 2 THEN 'synthetic must be boolean'
            WHEN 3 THEN 'missing keys: text, version' WHEN 4 THEN 'not a JSON object' ELSE '' END AS violations FROM documents""",
)
def s2_broken(spark, sf):
    pool = i.chunks(spark, sf).withColumn("doc_id", F.expr("cast(substr(chunk_id, 5) as bigint)"))
    fields = [c for c in validation.CHUNK_COLUMNS]
    whole = F.to_json(F.struct(*fields))
    d = F.col("doc_id")
    line = (
        F.when(d % 6 == 1, F.lit("{not json"))
        .when(d % 6 == 2, F.regexp_replace(whole, '"synthetic":true', '"synthetic":"yes"'))
        .when(d % 6 == 3, F.to_json(F.struct(*[f for f in fields if f not in ("text", "version")])))
        .when(d % 6 == 4, F.lit("[1, 2]"))
        .otherwise(whole)
    )
    lines = pool.select("doc_id", line.alias("value"))
    return chunk_source.parse_chunk_lines(lines).select("doc_id", *joined("violations"))


@query(
    "V1_chunk_violations",
    """SELECT 'src-' || source AS chunk_id, lang, count(*) AS n,
              concat_ws('|', CASE WHEN split_part(text, chr(10), 1) = '' THEN 'missing section_heading' END,
                        CASE WHEN text = '' OR doc_id % 9 = 0 THEN 'missing text' END,
                        CASE WHEN m > 1 THEN 'duplicate chunk_id' END) AS violations
       FROM documents JOIN (SELECT source, count(*) AS m FROM documents GROUP BY ALL) USING (source) GROUP BY ALL""",
)
def v1(spark, sf):
    """Chunks with repeated ids, of which every ninth has lost its text."""
    number = F.expr("cast(substr(chunk_id, 5) as bigint)")
    pool = i.chunks(spark, sf).withColumn("text", F.when(number % 9 == 0, "").otherwise(F.col("text")))
    checked = validation.chunk_violations(pool.withColumn("chunk_id", F.concat(F.lit("src-"), "source_id")))
    return checked.groupBy("chunk_id", F.col("process_area").alias("lang"), *joined("violations")).agg(F.count("*").alias("n"))


@query(
    "V1_sketched_violations",
    """WITH pool AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM documents WHERE doc_id % 50 = 0)
       SELECT 'doc-' || doc_id AS chunk_id, concat_ws('|', CASE WHEN split_part(text, chr(10), 1) = '' THEN 'missing section_heading' END,
              CASE WHEN text = '' THEN 'missing text' END, CASE WHEN doc_id % 50 = 0 THEN 'duplicate chunk_id' END) AS violations
       FROM pool""",
)
def v1_sketched(spark, sf):
    """Mostly unique ids: every fiftieth chunk stands there twice."""
    chunks = i.chunks(spark, sf)
    twice = chunks.where(F.substring_index("chunk_id", "-", -1).cast("long") % 50 == 0)
    checked = validation.chunk_violations(chunks.unionByName(twice), sketched=True)
    return checked.select("chunk_id", *joined("violations"))


@query(
    "S7_content_manifest",
    "SELECT conv_id, turn, sha256(text) AS sha256 FROM conversations",
)
def s7(spark, sf):
    rows = i.load(spark, sf, "conversations").select("conv_id", "turn", F.encode("text", "UTF-8").alias("content"))
    return runs.content_hash(rows).select("conv_id", "turn", "sha256")


@query(
    "S7_file_manifest",
    f"""WITH questions AS ({i.VIEWS['questions']}), files AS (
            SELECT question_id, CASE WHEN CAST(question_id AS BIGINT) % 2 = 0 THEN '["' || question_id || '", "x"]' ELSE query END
                   || chr(10) AS content, CAST(question_id AS BIGINT) % 2 = 0 AS listed FROM questions)
        SELECT sha256(content) AS sha256, CASE WHEN listed THEN CAST(2 AS BIGINT) ELSE -1 END AS item_count,
               CAST(strlen(content) AS BIGINT) AS length FROM files""",
)
def s7_files(spark, sf):
    """One file per question: a JSON list for every second one, else its text."""
    path = work_folder(spark, "questions")
    listed = F.concat(F.lit('["'), "question_id", F.lit('", "x"]'))
    content = F.when(F.col("question_id").cast("long") % 2 == 0, listed).otherwise(F.col("query"))
    files = i.questions(spark, sf).select("question_id", content.alias("value")).repartition("question_id")
    files.write.partitionBy("question_id").text(path)
    found = runs.file_manifest(spark, path)
    return found.select("sha256", F.coalesce("item_count", F.lit(-1).cast("long")).alias("item_count"), "length")


@query(
    "S7_streamed_manifest",
    """WITH files AS (
            SELECT doc_id // 200 AS part, count(*) AS items,
                   '[' || string_agg('[' || CASE WHEN source IS NULL THEN 'null' ELSE '"' || source || '"' END || ',' || n_chars || ']', ',' ORDER BY doc_id)
                   || CASE WHEN part % 4 = 3 THEN '' ELSE ']' END || chr(10) AS content FROM documents GROUP BY part)
        SELECT sha256(content) AS sha256, CASE WHEN part % 4 = 3 THEN -1 ELSE items END AS item_count,
               CAST(strlen(content) AS BIGINT) AS length FROM files""",
)
def s7_streamed(spark, sf):
    """A JSON list for every two hundred documents; every fourth list does not end."""
    path = work_folder(spark, "lists")
    source = F.coalesce(F.concat(F.lit('"'), "source", F.lit('"')), F.lit("null"))
    item = F.concat(F.lit("["), source, F.lit(","), F.col("n_chars").cast("string"), F.lit("]"))
    told = i.load(spark, sf, "documents").select(F.floor(F.col("doc_id") / 200).alias("part"), "doc_id", item.alias("item"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "item"))), lambda x: x["item"])
    files = told.groupBy("part").agg(F.array_join(ordered, ",").alias("items"))
    close = F.when(F.col("part") % 4 == 3, "").otherwise("]")
    files.select("part", F.concat(F.lit("["), "items", close).alias("value")).write.partitionBy("part").text(path)
    found = streamed_manifest(spark, path, buffer=1000)
    return found.select("sha256", F.coalesce("item_count", F.lit(-1).cast("long")).alias("item_count"), "length")


@query(
    "S3_read_questions",
    f"""WITH questions AS ({i.VIEWS['questions']})
        SELECT question_id, query, {sql_join('expected_source_ids', 'expected')}, {sql_join('forbidden_source_ids', 'forbidden')},
               {sql_join(f"list_filter({sql_list(ti.SEMANTIC_TAGS)}, lambda t: list_contains(expected_semantic_intent_tags, t))", 'tags')},
               CASE WHEN CAST(question_id AS BIGINT) % 4 = 0 THEN 'expected and forbidden overlap' ELSE '' END AS violations
        FROM (SELECT * REPLACE (CASE WHEN CAST(question_id AS BIGINT) % 4 = 0 THEN list_append(forbidden_source_ids, expected_source_ids[1])
              ELSE forbidden_source_ids END AS forbidden_source_ids) FROM questions)""",
)
def s3(spark, sf):
    path = work_folder(spark, "questions")
    asked = i.questions(spark, sf).withColumn(
        "forbidden_source_ids",
        F.when(F.col("question_id").cast("long") % 4 == 0, F.array_append("forbidden_source_ids", F.get("expected_source_ids", F.lit(0)))).otherwise(
            F.col("forbidden_source_ids")
        ),
    )
    asked.write.json(path)
    back = question_source.read_questions(spark, path, lines=True)
    return back.select(
        "question_id", "query",
        F.array_join("expected_source_ids", "|").alias("expected"),
        F.array_join("forbidden_source_ids", "|").alias("forbidden"),
        F.array_join("expected_semantic_intent_tags", "|").alias("tags"),
        *joined("violations"),
    )


# ------------------------------------------------------------------ prediction store, ablation

MODEL = "supplied-model"


def supplied_answers(spark, sf):
    q = i.questions(spark, sf)
    n = F.col("question_id").cast("long")
    return q.select("question_id", F.when(n % 8 < 7, i.pick(i.MODEL_ANSWERS, n)).alias("model_json"))


def stored_predictions(spark, sf):
    """Predictions known beforehand for the questions whose number is divisible by three."""
    keyed = predictions.prediction_key(i.questions(spark, sf), "query", MODEL)
    known = keyed.filter(F.col("question_id").cast("long") % 3 == 0)
    return predictions.entries(known.withColumn("t", tx.lit_array(["storage_concern"])), "t")


_n = "CAST(question_id AS BIGINT)"
_status = "CASE " + f"WHEN {_n} % 3 = 0 THEN 'stored' WHEN {_n} % 8 = 7 THEN 'model_error' ELSE CASE {_n} % 7 " + " ".join(
    f"WHEN {k} THEN {sql_text(a[0])}" for k, a in enumerate(rules._answers)
) + " END END"
_model_tags = f"CASE {_n} % 7 " + " ".join(
    f"WHEN {k} THEN {sql_list(a[1].split('|')) if a[1] else 'NULL'}" for k, a in enumerate(rules._answers)
) + " END"


def resolved_sql():
    return f"""questions AS ({i.VIEWS['questions']}),
    {rules.semantic_sql('questions', 'query', 'question_id, query')},
    resolved AS (SELECT question_id, query, {_status} AS prediction_status, semantic_tags AS rule_tags,
        CASE WHEN {_status} = 'stored' THEN ['storage_concern'] WHEN {_status} = 'ok' THEN {_model_tags} ELSE semantic_tags END AS tags
        FROM semantic)"""


@query(
    "J5_S8_resolve_predictions",
    f"""WITH {resolved_sql()}
        SELECT question_id, prediction_status, prediction_status = 'stored' AS store_hit, prediction_status <> 'stored' AS model_called,
               prediction_status NOT IN ('stored', 'ok') AS used_fallback, {sql_join('tags', 'semantic_tags')} FROM resolved""",
)
def j5(spark, sf):
    done = ev.resolve_predictions(i.questions(spark, sf), stored_predictions(spark, sf), supplied_answers(spark, sf), MODEL)
    return done.select("question_id", "prediction_status", "store_hit", "model_called", "used_fallback", *joined("semantic_tags"))


TAG = [f"{sql_list(SEMANTIC_TAGS)}[(n_chars + doc_id * {k}) % {len(SEMANTIC_TAGS)} + 1]" for k in (1, 3, 5)]
LOG_ORDER = f"list_filter({sql_list(SEMANTIC_TAGS)}, lambda t: t = a OR t = b)"


def document_predictions(spark, sf, k):
    """Two tags for every document's text, as generation ``k`` of a store."""
    docs = i.load(spark, sf, "documents")
    tag = lambda m: i.pick(SEMANTIC_TAGS, F.col("n_chars") + F.col("doc_id") * m)
    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("question_id"), "text", F.array(tag(1), tag(k)).alias("t"))
    return predictions.prediction_key(rows, "text", MODEL)


@query(
    "S8_J5_prediction_log",
    f"""WITH put AS (
            SELECT doc_id, text, {TAG[0]} AS a, CASE WHEN doc_id % 5 = 1 THEN {TAG[2]} WHEN doc_id % 3 = 0 THEN {TAG[1]} ELSE {TAG[0]} END AS b,
                   doc_id % 7 > 0 OR doc_id % 5 = 1 OR doc_id % 3 = 0 AS kept FROM documents)
        SELECT doc_id, sha256({sql_strip('text')}) AS input_hash,
               CASE WHEN kept THEN array_to_string({LOG_ORDER}, '|') END AS tags, kept AS store_hit FROM put""",
)
def s8_log(spark, sf):
    """A base, two generations that change parts of it, a compaction between them, then a lookup of all documents."""
    path = work_folder(spark, "prediction-log")
    first, second, third = (document_predictions(spark, sf, k) for k in (1, 3, 5))
    put = lambda df: prediction_log.put_predictions(predictions.entries(df, "t"), path, 8)
    put(first.where("doc_id % 7 > 0"))
    put(second.where("doc_id % 3 = 0"))
    prediction_log.compact(spark, path)
    put(third.where("doc_id % 5 = 1"))
    found = prediction_log.look_up(first.select("doc_id", *predictions.KEY), path)
    tags = F.col("semantic_intent.tags")
    return found.select("doc_id", "input_hash", F.array_join(tags, "|").alias("tags"), tags.isNotNull().alias("store_hit"))


@query(
    "S8_prediction_store",
    f"""WITH {resolved_sql()}
        SELECT question_id, sha256({sql_strip('query')}) AS input_hash, 'supplied-model' AS model, '4' AS intent_schema_version,
               {sql_join('tags', 'tags')}, '' AS violations FROM resolved WHERE prediction_status IN ('stored', 'ok')""",
)
def s8(spark, sf):
    before = stored_predictions(spark, sf)
    done = ev.resolve_predictions(i.questions(spark, sf), before, supplied_answers(spark, sf), MODEL)
    path = work_folder(spark, "store")
    predictions.write_store(ev.new_store(before, done), path)
    return predictions.read_store(spark, path).select(
        *predictions.KEY, F.array_join("semantic_intent.tags", "|").alias("tags"), *joined("violations")
    )


def ablated(spark, sf):
    return ev.ablate(
        ti.STRATEGIES, i.questions(spark, sf), i.chunks(spark, sf), 5,
        store=stored_predictions(spark, sf), supplied=supplied_answers(spark, sf), model=MODEL,
    )


OWN_TAGS = [x for x in ti.RETRIEVAL_TAGS if x in {"device_concern", *ti.TAG_POLICY.get("device_concern", [])}]
OWN_PHRASES = " ".join(dict.fromkeys(p for x in OWN_TAGS for p in ti.TAG_SEARCH_TERMS.get(x, [])))


@query(
    "Y3_own_detector_and_strategy",
    f"""WITH questions AS ({i.VIEWS['questions']})
        SELECT 'rule_intent' AS strategy, question_id, {sql_strip('query')} || chr(10) || chr(10) || 'Retrieval concepts: '
               || {sql_text(OWN_PHRASES)} AS search_text, {sql_text('|'.join(OWN_TAGS))} AS intent_tags FROM questions
        UNION ALL SELECT 'prefixed', question_id, 'about: ' || query, '' FROM questions""",
)
def y3(spark, sf):
    built = ev.build_queries(
        ["rule_intent", "prefixed"], i.questions(spark, sf),
        detector=lambda q: q.withColumn("semantic_tags", tx.lit_array(["device_concern"])),
        own={"prefixed": lambda q: q.withColumn("search_text", F.concat(F.lit("about: "), "query"))},
    )
    return built.select("strategy", "question_id", "search_text", F.array_join(F.coalesce("intent_tags", tx.lit_array([])), "|").alias("intent_tags"))


def built_sql():
    """Questions rewritten by all strategies."""
    base = resolved_sql()
    rule = f"semantic2 AS (SELECT 'rule_intent|' || question_id AS run, question_id, query, rule_tags AS semantic_tags FROM resolved UNION ALL SELECT 'nano_intent|' || question_id, question_id, query, tags FROM resolved)"
    derived = rules.derived_sql("run").replace("FROM semantic)", "FROM semantic2)")
    return f"""{base}, {rule}, {derived},
    {rules.deterministic_sql('questions', 'query', 'question_id')},
    built AS (
        SELECT 'raw' AS strategy, question_id, {sql_strip('query')} AS search_text, NULL::VARCHAR[] AS semantic_tags, NULL::VARCHAR[] AS intent_tags FROM questions
        UNION ALL SELECT 'deterministic_expansion', question_id, {rules.concept_text('query', "array_to_string(terms, ' ')")}, NULL, NULL FROM expanded
        UNION ALL SELECT split_part(run, '|', 1), question_id, {rules.concept_text('query')}, semantic_tags, coalesce(intent_tags, [])
        FROM semantic2 LEFT JOIN derived USING (run) LEFT JOIN concepts USING (run))"""


def ablation_sql(body):
    views = with_views(["keyword_pairs", "chunks"], "", asked="SELECT strategy || '|' || question_id AS query_id, search_text AS query_text FROM built", chunks=SOP_CHUNKS)
    views = views.replace("WITH ", f"WITH {built_sql()}, ", 1).rstrip()
    inner = judged_sql("keyword_pairs").replace("FROM questions q LEFT JOIN", "FROM (SELECT * REPLACE (strategy || '|' || question_id AS question_id) FROM built JOIN questions USING (question_id)) q LEFT JOIN")
    return f"""{views},
    judged AS MATERIALIZED (SELECT j.*, strategy, b.question_id AS qid, search_text, semantic_tags, intent_tags, prediction_status,
            q.expected_semantic_intent_tags AS est, q.expected_intent_tags AS eit
        FROM ({inner}) j JOIN (SELECT *, strategy || '|' || question_id AS run FROM built) b ON j.question_id = b.run
        JOIN questions q ON q.question_id = b.question_id JOIN resolved r ON r.question_id = b.question_id)
    {body}"""


@query(
    "K6_ablation_questions",
    ablation_sql("""SELECT strategy, qid AS question_id, search_text, array_to_string(retrieved, '|') AS retrieved, len(good) > 0 AS hit,
        array_to_string(forbidden_hits, '|') AS forbidden_hits, array_to_string(intent_tags, '|') AS intent_tags FROM judged"""),
)
def k6(spark, sf):
    return ablated(spark, sf).select(
        "strategy", "question_id", "search_text",
        F.array_join("retrieved_source_ids", "|").alias("retrieved"), "hit",
        F.array_join("forbidden_source_hits", "|").alias("forbidden_hits"), *joined("intent_tags"),
    )


def micro(pred, exp, prefix):
    scored = f"(len({exp}) > 0 AND {pred} IS NOT NULL)"
    tp = f"sum(CASE WHEN {scored} THEN len(list_intersect({pred}, {exp})) END)"
    return f"""CASE WHEN count(*) FILTER ({scored}) > 0 THEN round(coalesce({tp} / nullif(sum(CASE WHEN {scored} THEN len({pred}) END), 0), 0), 6) END AS {prefix}_micro_precision,
        CASE WHEN count(*) FILTER ({scored}) > 0 THEN round(coalesce({tp} / nullif(sum(CASE WHEN {scored} THEN len({exp}) END), 0), 0), 6) END AS {prefix}_micro_recall,
        round(avg(CASE WHEN {scored} THEN CASE WHEN list_sort({pred}) = list_sort({exp}) THEN 1.0 ELSE 0.0 END END), 6) AS {prefix}_exact_match_rate"""


_nano = "strategy = 'nano_intent'"


@query(
    "A10_A15_A16_ablation_summary",
    ablation_sql(f"""SELECT strategy, {METRICS},
        count(*) FILTER ({_nano} AND prediction_status <> 'stored') AS model_call_count,
        count(*) FILTER ({_nano} AND prediction_status = 'stored') AS store_hit_count,
        count(*) FILTER ({_nano} AND prediction_status <> 'stored') AS store_miss_count,
        count(*) FILTER ({_nano} AND prediction_status NOT IN ('stored', 'ok')) AS fallback_count,
        count(*) FILTER ({_nano} AND prediction_status IN ('structured_output_failure', 'unknown_tags')) AS structured_output_failure_count,
        count(*) FILTER ({_nano} AND prediction_status = 'model_error') AS model_error_count,
        count(*) FILTER ({_nano} AND prediction_status = 'unknown_tags') AS unknown_tag_count,
        CAST(0 AS BIGINT) AS unmapped_tag_count,
        {micro('semantic_tags', 'est', 'semantic_intent')}, {micro('intent_tags', 'eit', 'intent')}
        FROM judged GROUP BY strategy"""),
)
def a16(spark, sf):
    done = ev.ablation_summary(stored(ablated(spark, sf), "ablation"))
    return done.withColumns({f.name: F.round(f.name, 6) for f in done.schema.fields if f.dataType.typeName() == "double"})


@query(
    "A11_per_tag_metrics",
    ablation_sql("""SELECT strategy, kind, tag, count(*) FILTER (p AND e) AS true_positive, count(*) FILTER (p) AS predicted, count(*) FILTER (e) AS expected,
        round(coalesce(count(*) FILTER (p AND e) / nullif(count(*) FILTER (p), 0), 0), 6) AS precision,
        round(coalesce(count(*) FILTER (p AND e) / nullif(count(*) FILTER (e), 0), 0), 6) AS recall
        FROM (SELECT strategy, kind, tag, list_contains(pred, tag) AS p, list_contains(exp, tag) AS e FROM (
            SELECT strategy, kind, pred, exp, unnest(list_distinct(list_concat(pred, exp))) AS tag FROM (
                SELECT strategy, 'semantic' AS kind, semantic_tags AS pred, est AS exp FROM judged
                UNION ALL SELECT strategy, 'derived', intent_tags, eit FROM judged) WHERE len(exp) > 0 AND pred IS NOT NULL)) GROUP BY ALL"""),
)
def a11(spark, sf):
    done = ev.ablation_tags(stored(ablated(spark, sf), "ablation"))
    return done.withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query(
    "S6_U3_write_run",
    ablation_sql("SELECT 'run-1' AS run_id, strategy, count(*) AS questions, count(*) FILTER (len(good) > 0) AS hits FROM judged GROUP BY ALL"),
)
def s6(spark, sf):
    shown = stored(ablated(spark, sf).select("strategy", "question_id", "hit"), "results")
    path = work_folder(spark, "runs")
    manifest = runs.content_hash(i.questions(spark, sf).select(F.encode("query", "UTF-8").alias("content"))).drop("content")
    runs.write_run(shown, shown.groupBy("strategy").count(), manifest, path, " run-1 ")
    return runs.read_run(spark, path, "results", "run-1").groupBy("run_id", "strategy").agg(
        F.count("*").alias("questions"), F.count_if("hit").alias("hits")
    )


# ------------------------------------------------------------------ extraction and record evaluation


def extraction_cases(spark, sf):
    """Cases with hand-set expectations that vary by row."""
    n = F.col("n")
    return i.cases(spark, sf).select(
        "case_id",
        F.struct(
            F.when(n % 2 == 0, "documentation_incomplete").otherwise("not_applicable").alias("record_review_result"),
            F.when(n % 3 == 0, "unavailable").otherwise("not_applicable").alias("lot_batch_pattern_summary"),
            F.lit("not_checked").alias("inventory_inspection_result"),
            F.lit("not_needed").alias("api_reference_review_result"),
            F.when(n % 4 == 0, tx.lit_array(["Exact dose administered"])).otherwise(tx.lit_array([])).alias("missing_information"),
            F.when(n % 5 == 0, tx.lit_array(["pet_death"])).otherwise(tx.lit_array([])).alias("severe_triggers_observed"),
        ).alias("expected_review_summary"),
        F.when(n % 3 == 1, tx.lit_array(["symptom_resolution", "event_timing"])).otherwise(tx.lit_array([])).alias("expected_unresolved_field_names"),
    )


@query(
    "S4_read_extraction_cases",
    f"""WITH cases AS ({i.VIEWS['cases']})
        SELECT case_id, md5(concern_text) AS concern_hash,
               concat_ws('|', CASE WHEN n % 7 = 0 THEN 'reviewer_note missing' END,
                         CASE WHEN n % 5 = 1 THEN 'record_review_result invalid' END,
                         CASE WHEN n % 6 = 2 THEN 'severe_triggers_observed invalid' END) AS violations FROM cases""",
)
def s4(spark, sf):
    """Cases written as JSON lines, some with a missing note or values outside their vocabulary."""
    n = F.col("n")
    labelled = extraction_cases(spark, sf).join(i.cases(spark, sf), "case_id")
    summary = F.col("expected_review_summary")
    summary = summary.withField(
        "record_review_result", F.when(n % 5 == 1, "made_up").otherwise(F.col("expected_review_summary.record_review_result"))
    ).withField(
        "severe_triggers_observed",
        F.when(n % 6 == 2, tx.lit_array(["pet_death", "made_up"])).otherwise(F.col("expected_review_summary.severe_triggers_observed")),
    )
    rows = labelled.select(
        "case_id", "concern_text", F.when(n % 7 != 0, F.col("reviewer_note")).alias("reviewer_note"),
        summary.alias("expected_review_summary"), "expected_unresolved_field_names",
    )
    path = work_folder(spark, "cases")
    rows.write.json(path)
    back = question_source.read_extraction_cases(spark, path, lines=True)
    return back.select("case_id", F.md5("concern_text").alias("concern_hash"), *joined("violations"))


def set_sql(name, exp, act):
    e, a = exp, f"list_distinct(coalesce({act}, []))"
    tp = f"len(list_intersect({e}, {a}))"
    return f"""CASE WHEN len({a}) > 0 THEN {tp} / len({a}) WHEN len({e}) = 0 THEN 1.0 ELSE 0.0 END AS {name}_precision,
        CASE WHEN len({e}) > 0 THEN {tp} / len({e}) ELSE 1.0 END AS {name}_recall,
        list_sort(list_filter({a}, lambda x: NOT list_contains({e}, x))) AS {name}_fp, list_sort(list_filter({e}, lambda x: NOT list_contains({a}, x))) AS {name}_fn"""


_u = rules.USABLE
CASE_SQL = rules.EXTRACT + f""", labelled AS (SELECT *, CASE WHEN n % 4 = 0 THEN ['Exact dose administered'] ELSE []::VARCHAR[] END AS e_missing,
        CASE WHEN n % 5 = 0 THEN ['pet_death'] ELSE []::VARCHAR[] END AS e_triggers,
        CASE WHEN n % 3 = 1 THEN ['symptom_resolution', 'event_timing'] ELSE []::VARCHAR[] END AS e_open,
        CAST(coalesce({_u} AND record_review_result = CASE WHEN n % 2 = 0 THEN 'documentation_incomplete' ELSE 'not_applicable' END, false) AS INT)
        + CAST({_u} AND lot_batch_pattern_summary = CASE WHEN n % 3 = 0 THEN 'unavailable' ELSE 'not_applicable' END AS INT)
        + CAST({_u} AND inventory_inspection_result = 'not_checked' AS INT) + CAST({_u} AND api_reference_review_result = 'not_needed' AS INT) AS correct
        FROM extracted),
    compared AS (SELECT case_id, correct, {set_sql('missing_information', 'e_missing', rules.usable('items'))},
        {set_sql('severe_trigger', 'e_triggers', rules.usable('triggers'))}, {set_sql('unresolved_question', 'e_open', rules.usable('open_fields'))} FROM labelled),
    flagged_cases AS (SELECT *, correct < 4 OR len(missing_information_fp) + len(missing_information_fn) + len(severe_trigger_fp) + len(severe_trigger_fn)
        + len(unresolved_question_fp) + len(unresolved_question_fn) > 0 AS failed FROM compared)
"""
_sets = list(rec.SET_FIELDS)


@query(
    "A12_case_results",
    CASE_SQL + "SELECT case_id, CAST(correct AS BIGINT) AS scalar_correct, failed, "
    + ", ".join(f"round({s}_{m}, 6) AS {s}_{m}" for s in _sets for m in ("precision", "recall")) + ", "
    + ", ".join(f"array_to_string({s}_{p}, '|') AS {s}_{p}" for s in _sets for p in ("fp", "fn")) + " FROM flagged_cases",
)
def a12(spark, sf):
    done = rec.case_results(extraction_cases(spark, sf), summary.extract_summary(i.cases(spark, sf)))
    return done.select(
        "case_id", F.col("scalar_correct").cast("long").alias("scalar_correct"), "failed",
        *[F.round(f"{s}_{m}", 6).alias(f"{s}_{m}") for s in _sets for m in ("precision", "recall")],
        *[F.array_join(f"{s}_false_{p}", "|").alias(f"{s}_{q}") for s in _sets for p, q in (("positives", "fp"), ("negatives", "fn"))],
    )


@query(
    "K7_A13_evaluate_extraction",
    CASE_SQL + "SELECT count(*) AS case_count, round(sum(correct) / (4 * count(*)), 6) AS scalar_field_accuracy, count(*) FILTER (failed) AS failed_count, "
    + ", ".join(f"round(avg({s}_{m}), 6) AS {s}_{m}" for s in _sets for m in ("precision", "recall")) + " FROM flagged_cases",
)
def k7(spark, sf):
    done = rec.evaluate_extraction(rec.case_results(extraction_cases(spark, sf), summary.extract_summary(i.cases(spark, sf))))
    return done.withColumns({f.name: F.round(f.name, 6) for f in done.schema.fields if f.dataType.typeName() == "double"})


def expected_records(spark, sf):
    """Nested expected-output JSON per case; parts of them break a rule."""
    n = F.col("n")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    json = F.concat(
        F.lit('{"raw_intake": {"intake_source": '),
        F.when(n % 7 == 1, '"customer_review"').otherwise('"qre_general_question_form"'),
        F.lit(', "submitter_role": "customer", "submission_purpose": "other", "concern_narrative": '),
        text(F.regexp_replace("concern_text", r'[\\"\n\r\t]', " ")),
        F.when(n % 7 == 2, F.lit(', "star_rating": 4')).otherwise(F.lit("")),
        F.when(n % 7 == 3, F.lit(', "extra": 1')).otherwise(F.lit("")),
        F.lit('}, "product_context": {}, "investigation_requirements": {}, "review_summary": {"record_review_result": "not_applicable", '),
        F.lit('"lot_batch_pattern_summary": "unavailable", "inventory_inspection_result": "not_checked", "api_reference_review_result": "not_needed"}, '),
        F.lit('"derived_assessment": {"reviewer_assigned_classification": "QRE", '),
        F.when(n % 7 == 4, F.lit("")).otherwise(F.lit('"reviewer_assigned_category": "suspected_ADE", ')),
        F.lit('"reviewer_assigned_subcategory": "suspected_ADE", "concern_type": '),
        F.when(n % 7 == 5, '"nonsense"').otherwise('"flavor_related_vomiting"'),
        F.lit(', "risk_lane": "unexpected_non_life_threatening", "review_scope": "full_quality_review", '),
        F.lit('"handling_path": "technical_services_customer_outreach", "resolution_review_required": '),
        F.when(n % 7 == 6, "false").otherwise("true"),
        F.lit(', "resolution_options": ["counseling_or_follow_up", "alternate_dosage_form_discussion"], "escalation_triggers": [], "rationale": "r"}}'),
    )
    return validation.record_violations(i.cases(spark, sf).select("case_id", "n", json.alias("record_json")))


@query(
    "V2_S5_record_violations",
    f"""WITH {rules.CASES} SELECT case_id, CASE n % 7 WHEN 1 THEN 'star_rating required|review_text_present required'
        WHEN 2 THEN 'star_rating not allowed' WHEN 3 THEN 'unknown field in raw_intake' WHEN 4 THEN 'category required'
        WHEN 5 THEN 'concern_type invalid' WHEN 6 THEN 'resolution_options not allowed' ELSE '' END AS violations FROM cases""",
)
def v2(spark, sf):
    return expected_records(spark, sf).select("case_id", *joined("violations"))


_paths = {
    "derived_assessment.reviewer_assigned_classification": ("'QRE'", "reviewer_assigned_classification"),
    "derived_assessment.reviewer_assigned_category": ("CASE WHEN n % 7 <> 4 THEN 'suspected_ADE' END", "reviewer_assigned_category"),
    "derived_assessment.reviewer_assigned_subcategory": ("'suspected_ADE'", "reviewer_assigned_subcategory"),
    "derived_assessment.concern_type": ("CASE WHEN n % 7 = 5 THEN 'nonsense' ELSE 'flavor_related_vomiting' END", "concern_type"),
    "derived_assessment.risk_lane": ("'unexpected_non_life_threatening'", "risk_lane"),
    "derived_assessment.review_scope": ("'full_quality_review'", "review_scope"),
    "derived_assessment.handling_path": ("'technical_services_customer_outreach'", "handling_path"),
    "derived_assessment.escalation_triggers": ("''", "escalation_triggers"),
    "derived_assessment.resolution_review_required": ("n % 7 <> 6", "resolution_review_required"),
    "derived_assessment.resolution_options": ("'counseling_or_follow_up|alternate_dosage_form_discussion'", "resolution_options"),
}


@query(
    "K8_A14_compare_records",
    rules.ASSESS + ", pairs AS (SELECT case_id, unnest([" + ", ".join(
        f"{{'p': {sql_text(p)}, 'ok': {e} IS NOT DISTINCT FROM a.{a}}}" for p, (e, a) in _paths.items()
    ) + "]) AS r FROM cases JOIN assessed a USING (case_id)) SELECT case_id, r.p AS field_path, r.ok AS passed FROM pairs",
)
def k8(spark, sf):
    expected = expected_records(spark, sf).select("case_id", "record.derived_assessment")
    actual = rules.assessed(spark, sf).select("case_id", "derived_assessment")
    return rec.compare_records(expected, actual).select("case_id", "field_path", "passed")


@query(
    "A14_record_results",
    rules.ASSESS + ", pairs AS (SELECT case_id, unnest([" + ", ".join(
        f"{{'p': {sql_text(p)}, 'ok': {e} IS NOT DISTINCT FROM a.{a}}}" for p, (e, a) in _paths.items()
    ) + """]) AS r FROM cases JOIN assessed a USING (case_id)) SELECT case_id, bool_and(r.ok) AS passed,
        coalesce(string_agg(r.p, '|' ORDER BY r.p) FILTER (NOT r.ok), '') AS failed_fields FROM pairs GROUP BY ALL""",
)
def a14(spark, sf):
    expected = expected_records(spark, sf).select("case_id", "record.derived_assessment")
    actual = rules.assessed(spark, sf).select("case_id", "derived_assessment")
    done = rec.record_results(rec.compare_records(expected, actual))
    return done.select("case_id", "passed", *joined("failed_fields"))


# ------------------------------------------------------------------ checklists with evidence


def reranked_sql(k):
    """Top 3k keyword hits per case, phrase bonus per concern type, top k."""
    bonus = "CASE concern_type " + " ".join(
        f"WHEN {sql_text(kind)} THEN 3.0 * len(list_filter({sql_list(words)}, lambda w: contains(lower(source_title || ' ' || section_heading || ' ' || text), w)))"
        for kind, words in tt.CONCERN_RERANK_TERMS.items()
    ) + " ELSE 0.0 END"
    asked = f"SELECT case_id AS query_id, {sql_strip('concern_text')} || {rules.case_map('concern_type', rules._query_terms, sql_text(''))} AS query_text FROM typed"
    views = with_views(["keyword_pairs", "chunks"], "", asked=asked, chunks=SOP_CHUNKS)
    views = views.replace("WITH ", rules.TYPED.rstrip() + ", ", 1).rstrip()
    return f"""{views},
    raised AS (SELECT query_id AS case_id, chunk_id, score + CAST({bonus} AS DOUBLE) AS score, concern_type, matched_terms
        FROM (SELECT *, {RANK} AS rank FROM keyword_pairs) p JOIN chunks USING (chunk_id) JOIN typed ON typed.case_id = p.query_id WHERE rank <= {3 * k}),
    best AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, chunk_id) AS rank FROM raised)"""


@query(
    "R8_T2_P8_intake_checklist",
    reranked_sql(5) + """
    SELECT t.case_id, 'ok' AS concern_status, t.concern_type, t.risk_lane, coalesce(string_agg(chunk_id || ':' || CAST(CAST(score AS BIGINT) AS VARCHAR), '|' ORDER BY rank), '') AS evidence,
           md5(coalesce(string_agg(concat_ws('~', rank, source_id, source_title, source_type, section_heading,
               array_to_string(matched_terms, ' '), md5(text)), '|' ORDER BY rank), '')) AS citations,
           CAST(least(count(chunk_id), 2) AS BIGINT) AS first_check_citations
    FROM typed t LEFT JOIN (SELECT case_id, chunk_id, score, rank, matched_terms, c.* EXCLUDE (chunk_id)
        FROM best JOIN chunks c USING (chunk_id) WHERE rank <= 5) USING (case_id)
    GROUP BY t.case_id, t.concern_type, t.risk_lane""",
)
def r8(spark, sf):
    done = checklist.intake_checklist(i.concerns(spark, sf), i.chunks(spark, sf), 5)
    cited = F.transform("evidence", lambda e: F.concat(e["chunk_id"], F.lit(":"), e["score"].cast("long").cast("string")))
    shown = F.transform("evidence", lambda e: F.concat_ws(
        "~", e["rank"].cast("string"), e["source_id"], e["source_title"], e["source_type"], e["section_heading"],
        F.array_join(e["matched_terms"], " "), F.md5(e["supporting_text"]),
    ))
    return done.select(
        "case_id", "concern_status", "concern_type", "risk_lane", F.array_join(cited, "|").alias("evidence"),
        F.md5(F.array_join(shown, "|")).alias("citations"),
        F.size(F.get("review_checks", F.lit(0))["evidence"]).cast("long").alias("first_check_citations"),
    )


@query(
    "R25_batch_review",
    with_views(
        ["keyword_pairs"],
        f"SELECT query_id AS case_id, rank, chunk_id, score FROM (SELECT *, {RANK} AS rank FROM keyword_pairs) WHERE rank <= 3",
        asked="SELECT case_id AS query_id, regexp_replace(concern_text, '[\\\\\"\\n\\r\\t]', ' ', 'g') AS query_text FROM cases",
        chunks=SOP_CHUNKS,
    ).replace("WITH ", f"WITH {rules.CASES}, ", 1),
)
def r25(spark, sf):
    found = rec.batch_review(expected_records(spark, sf), i.chunks(spark, sf), 3)
    return found.select("case_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score")


def intake_json(spark, sf):
    n = F.col("n")
    json = F.concat(
        F.lit('{"raw_intake": {"intake_source": "qre_general_question_form", "submitter_role": "customer", "submission_purpose": '),
        F.when(n % 6 == 1, '"bad purpose"').otherwise('"other"'),
        F.lit(', "concern_narrative": "n"}, "product_context": {"species": '),
        F.when(n % 2 == 0, '"cat"').otherwise('"unknown"'),
        F.lit("}"),
        F.when(n % 6 == 2, F.lit(', "possible_boundary_issue": "internal_record_access"')).otherwise(F.lit("")),
        F.lit(', "facts_present": ["gave 5 ml", "lot number 44-X1"]}'),
    )
    return i.cases(spark, sf).select("case_id", "n", "concern_text", F.when(n % 6 == 3, "oops").otherwise(json).alias("intake_json"))


@query(
    "R26_intake_records",
    f"""WITH {rules.CASES}, {rules.FLAGGED.format(table='cases')},
        stated AS (SELECT *, n % 6 NOT IN (1, 2, 3) AS usable, n % 6 NOT IN (1, 2, 3) AND n % 2 = 0 AS known_cat,
            low || ' ' || CASE WHEN n % 6 NOT IN (1, 2, 3) THEN 'gave 5 ml lot number 44-x1 ' ELSE '' END AS known FROM flagged)
        SELECT case_id, CASE WHEN n % 6 IN (1, 3) THEN 'rules_only' WHEN n % 6 = 2 THEN 'stopped' ELSE 'ok' END AS intake_status,
               CASE WHEN n % 6 <> 2 THEN array_to_string({rules.missing_sql('known', '(species OR known_cat)')}, '|') END AS missing_information
        FROM stated""",
)
def r26(spark, sf):
    rows = intake_json(spark, sf)
    status = intake.intake_records(rows).select("case_id", "intake_status")
    done = intake.intake_checklist_rules(rows).select("case_id", *joined("missing_information"))
    return status.join(done, "case_id", "left")


# ------------------------------------------------------------------ streams


@query(
    "X1_triage_stream",
    f"""WITH {rules.CONCERNS}, {rules.FLAGGED.format(table='concerns')},
        {rules.semantic_sql('concerns', 'concern_text', 'case_id')}
        SELECT case_id, {rules.TYPE_SQL} AS concern_type, {rules.LANE_SQL} AS risk_lane, {sql_join('semantic_tags', 'semantic_tags')}
        FROM flagged JOIN semantic USING (case_id)""",
)
def x1(spark, sf):
    source, out, state = (work_folder(spark, n) for n in ("arriving", "triaged", "state"))
    i.concerns(spark, sf).write.parquet(source)
    arriving = spark.readStream.schema("case_id string, concern_text string").parquet(source)
    requests.start_triage(arriving, out, state).awaitTermination()
    return spark.read.parquet(out).select("case_id", "concern_type", "risk_lane", *joined("semantic_tags"))


@query(
    "X2_retrieve_stream",
    with_views(["keyword_pairs"], f"SELECT query_id, rank, chunk_id, score FROM (SELECT *, {RANK} AS rank FROM keyword_pairs) WHERE rank <= 5"),
)
def x2(spark, sf):
    source, out, state = (work_folder(spark, n) for n in ("asked", "found", "state"))
    i.queries(spark, sf).write.parquet(source)
    arriving = spark.readStream.schema("query_id bigint, query_text string").parquet(source)
    requests.start_retrieve(arriving, i.chunks(spark, sf), out, state).awaitTermination()
    return spark.read.parquet(out).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score")


def growing_sql(parity, docs):
    chunks = f"SELECT * FROM ({i.VIEWS['chunks']} {docs})"
    body = f"SELECT query_id, rank, chunk_id, score FROM (SELECT *, {RANK} AS rank FROM keyword_pairs) WHERE rank <= 5"
    asked = f"SELECT item_id AS query_id, text AS query_text FROM benchmark WHERE item_id % 2 = {parity}"
    return f"SELECT *, CAST({parity} AS BIGINT) AS snapshot FROM ({with_views(['keyword_pairs'], body, chunks=chunks, asked=asked)})"


@query(
    "X2_growing_evidence",
    f"{growing_sql(0, 'WHERE doc_id % 3 > 0')} UNION ALL {growing_sql(1, '')}",
)
def x2_growing(spark, sf):
    """Even queries meet two thirds of the chunks; then the others are published, and odd queries meet all."""
    source, out, state, path = (work_folder(spark, n) for n in ("asked", "found", "state", "evidence"))
    chunks, asked = i.chunks(spark, sf), i.queries(spark, sf)
    third = F.substring_index("chunk_id", "-", -1).cast("long") % 3 > 0
    for parity, some in ((0, chunks.where(third)), (1, chunks.where(~third))):
        evidence_index.add_segment(some, path)
        asked.where(F.col("query_id") % 2 == parity).write.mode("append").parquet(source)
        arriving = spark.readStream.schema("query_id bigint, query_text string").parquet(source)
        evidence_index.start_retrieve_growing(arriving, path, out, state).awaitTermination()
    found = spark.read.parquet(out)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score", "snapshot")


@query(
    "S2_term_index_search",
    with_views(["keyword_pairs"], f"SELECT query_id, rank, chunk_id, score FROM (SELECT *, {RANK} AS rank FROM keyword_pairs) WHERE rank <= 5"),
)
def s2_index(spark, sf):
    path = work_folder(spark, "terms")
    chunk_source.write_term_index(i.chunks(spark, sf), path)
    found = keyword_search(i.queries(spark, sf), i.chunks(spark, sf), 5, index=chunk_source.read_term_index(spark, path))
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score")


@query(
    "F2_blake2b_vocabulary",
    with_views(["chunk_terms"], "SELECT term, count(*) AS chunks, true AS in_range, 1 AS buckets FROM chunk_terms GROUP BY ALL"),
)
def f2(spark, sf):
    """Every term has one bucket in range; known digests are tested in pytest."""
    terms = stored(chunk_terms(i.chunks(spark, sf)).groupBy("term").agg(F.count("*").alias("chunks")), "vocabulary")
    found = vocabulary_buckets(terms, 128).groupBy("term").agg(
        F.min(F.col("bucket").between(0, 127)).alias("in_range"), F.count_distinct("bucket").cast("int").alias("buckets")
    )
    return terms.join(found, "term")
