"""Triage, intents, query rewriting and note grounding."""

from pyspark.sql import functions as F

from tracewell.functions import text as tx
from tracewell.operators import assessment, checklist, intents, summary, triage
from tracewell.operators.lexicon import lexicon_matches, matched_terms
from tracewell.tables import assessment as ta, intents as ti, summary as ts, triage as tt
from tracewell.tables.intents import SEMANTIC_TAGS
from workload import inputs as i
from workload.inputs import sql_any, sql_ascii, sql_list, sql_rx, sql_strip, sql_text
from workload.registry import query

CONCERNS = f"concerns AS ({i.VIEWS['concerns']})"
CASES = f"cases AS MATERIALIZED ({i.VIEWS['cases']})"


def joined(*names):
    """Array columns as one string each, which both engines print alike."""
    return [F.array_join(n, "|").alias(n) for n in names]


def sql_join(expr, name):
    return f"array_to_string({expr}, '|') AS {name}"


def case_map(x, entries, default="NULL"):
    return f"CASE {x} " + " ".join(f"WHEN {sql_text(k)} THEN {v}" for k, v in entries.items()) + f" ELSE {default} END"


# ------------------------------------------------------------------ triage

_hits = {
    reason: f"list_sort(list_filter({sql_list(sorted(words))}, lambda w: contains(low, w)))"
    for reason, words in tt.REFUSAL_TERMS.items()
}
REFUSAL_SQL = f"""
WITH {CONCERNS},
low AS (SELECT case_id, lower({sql_strip('concern_text')}) AS low FROM concerns),
hits AS (SELECT case_id, {_hits['external_drug_reference']} AS a, {_hits['internal_record_access']} AS b,
                {_hits['clinical_or_legal_conclusion']} AS c FROM low)
SELECT case_id, len(a) + len(b) + len(c) > 0 AS refused,
       CASE WHEN len(a) > 0 THEN 'external_drug_reference' WHEN len(b) > 0 THEN 'internal_record_access'
            WHEN len(c) > 0 THEN 'clinical_or_legal_conclusion' END AS refusal_reason,
       CASE WHEN len(a) > 0 THEN {sql_text(tt.REFUSAL_MESSAGES['external_drug_reference'])}
            WHEN len(b) > 0 THEN {sql_text(tt.REFUSAL_MESSAGES['internal_record_access'])}
            WHEN len(c) > 0 THEN {sql_text(tt.REFUSAL_MESSAGES['clinical_or_legal_conclusion'])} END AS refusal_message,
       array_to_string(CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b ELSE c END, '|') AS refusal_terms
FROM hits"""


@query("R1_J6_refusal", REFUSAL_SQL)
def r1(spark, sf):
    return triage.refusal(i.concerns(spark, sf)).select(
        "case_id", "refused", "refusal_reason", "refusal_message", *joined("refusal_terms")
    )


FLAGS = ", ".join(f"{sql_any('low', words)} AS {name}" for name, words in tt.CONCERN_TERMS.items())
FLAGGED = f"""flagged AS (SELECT *, {FLAGS} FROM (SELECT *, lower({sql_strip('concern_text')}) AS low FROM {{table}}))"""
TYPE_SQL = """CASE WHEN wrong_medication THEN 'wrong_patient_or_wrong_medication'
    WHEN vomiting AND flavor THEN 'flavor_related_vomiting' WHEN vomiting THEN 'possible_adverse_drug_event'
    WHEN rejection THEN 'pet_refused_flavor' WHEN transdermal THEN 'syringe_or_device_issue'
    WHEN bud THEN 'bud_question' WHEN flavor THEN 'pet_refused_flavor' END"""
LANE_SQL = """CASE WHEN severe THEN 'life_threatening_or_legal' WHEN vomiting THEN 'unexpected_non_life_threatening'
    WHEN flavor OR rejection OR transdermal OR oral_liquid OR bud THEN 'expected_self_limiting' END"""
TYPED = f"WITH {CONCERNS}, {FLAGGED.format(table='concerns')}, typed AS (SELECT *, {TYPE_SQL} AS concern_type, {LANE_SQL} AS risk_lane FROM flagged) "


@query("R2_R3_W5_triage", TYPED + "SELECT case_id, concern_type, risk_lane FROM typed")
def r23(spark, sf):
    return triage.triage(i.concerns(spark, sf)).select("case_id", "concern_type", "risk_lane")


@query(
    "R2_documents_concern_type",
    f"""WITH docs AS (SELECT doc_id, text AS concern_text FROM documents), {FLAGGED.format(table='docs')}
        SELECT {TYPE_SQL} AS concern_type, {LANE_SQL} AS risk_lane, count(*) AS n FROM flagged GROUP BY ALL""",
)
def r2_docs(spark, sf):
    docs = i.load(spark, sf, "documents").select(F.col("text").alias("concern_text"))
    return triage.triage(docs).groupBy("concern_type", "risk_lane").agg(F.count("*").alias("n"))


_query_terms = {k: sql_text(" " + " ".join(v)) for k, v in tt.CONCERN_QUERY_TERMS.items()}


@query(
    "R4_concern_query",
    TYPED + f"SELECT case_id, {sql_strip('concern_text')} || {case_map('concern_type', _query_terms, sql_text(''))} AS query_text FROM typed",
)
def r4(spark, sf):
    return triage.concern_query(triage.triage(i.concerns(spark, sf))).select("case_id", "query_text")


_checks = "list_filter([" + ", ".join(
    (f"CASE WHEN {lex} THEN {sql_text(name)} END" if lex else sql_text(name)) for lex, _, name, _, _ in tt.REVIEW_CHECKS
) + "], lambda x: x IS NOT NULL)"


def missing_sql(known="low", species="species", dosage="dosage_form", flavor="flavor"):
    """Items of the missing-information table that nothing answers."""
    known_ascii = sql_ascii(known)
    tests = {
        "species": species,
        "dosage_form": dosage,
        "flavor": flavor,
        "air_bubble": f"contains({known}, 'air bubble')",
        "swallowed": sql_any(known, tt.SWALLOWED_TERMS),
        **{n: sql_rx(known_ascii, p) for n, p in tt.FACT_PATTERNS.items()},
    }
    parts = []
    for lex, item, fact in tt.MISSING_ITEMS:
        wanted = " AND ".join(([lex] if lex else []) + ([f"NOT {tests[fact]}"] if fact else [])) or "true"
        parts.append(f"CASE WHEN {wanted} THEN {sql_text(item)} END")
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


@query(
    "R5_R6_R7_checklist_rules",
    TYPED
    + f"""SELECT case_id, concern_type, risk_lane, {sql_join(_checks, 'review_checks')},
          {sql_join(missing_sql(), 'missing_information')},
          {sql_join(f"list_concat({sql_list(tt.TRIGGERS_TO_RULE_OUT)}, CASE WHEN {sql_any('low', tt.LOT_TRIGGER_TERMS)} THEN [{sql_text(tt.LOT_TRIGGER)}] ELSE [] END)", 'triggers_to_rule_out')}
          FROM typed""",
)
def r567(spark, sf):
    done = checklist.checklist_rules(i.concerns(spark, sf))
    return done.select(
        "case_id", "concern_type", "risk_lane",
        F.array_join(F.transform("review_checks", lambda c: c["check_name"]), "|").alias("review_checks"),
        *joined("missing_information", "triggers_to_rule_out"),
    )


_keys = "list_filter([" + ", ".join(
    (f"CASE WHEN {lex} THEN {sql_text(key)} END" if lex else sql_text(key)) for lex, key, _, _, _ in tt.REVIEW_CHECKS
) + "], lambda x: x IS NOT NULL)"


@query(
    "P9_F13_review_contract",
    TYPED
    + f"""SELECT case_id,
          CASE WHEN risk_lane = 'life_threatening_or_legal' THEN 'escalation_review'
               WHEN concern_type = 'bud_question' THEN 'guidance_only' ELSE 'full_quality_review' END AS review_scope,
          'Initial screen suggests ' || coalesce(replace(concern_type, '_', ' '), 'unknown') || ' with '
          || coalesce(replace(risk_lane, '_', ' '), 'unknown')
          || ' risk lane. Final routing depends on review findings and confirmed escalation triggers.' AS initial_takeaway,
          {sql_join(_keys, 'check_keys')} FROM typed""",
)
def p9(spark, sf):
    done = checklist.review_contract(checklist.checklist_rules(i.concerns(spark, sf)))
    return done.select(
        "case_id", "review_scope", "initial_takeaway",
        F.array_join(F.transform("required_checks", lambda c: c["key"]), "|").alias("check_keys"),
    )


@query(
    "F12_fact_detectors",
    f"WITH {CONCERNS} SELECT case_id, "
    + ", ".join(f"{sql_rx(sql_ascii('concern_text'), p)} AS {n}" for n, p in tt.FACT_PATTERNS.items())
    + " FROM concerns",
)
def f12(spark, sf):
    return i.concerns(spark, sf).select(
        "case_id", *[tx.rx(F.col("concern_text"), p).alias(n) for n, p in tt.FACT_PATTERNS.items()]
    )


LEXICON = ["tion", "the", "ing", "eau", "keit", "ción", "ent"]


@query(
    "J6_lexicon_substring",
    f"""SELECT doc_id, {sql_join(f"list_sort(list_filter({sql_list(sorted(LEXICON))}, lambda w: contains(lower(text), w)))", 'terms')}
        FROM documents""",
)
def j6(spark, sf):
    docs = i.load(spark, sf, "documents")
    return docs.select("doc_id", F.array_join(tx.which_of(F.lower("text"), LEXICON), "|").alias("terms"))


TABLE_LEXICON = f"""SELECT DISTINCT term FROM (SELECT unnest({i.sql_tokens('text')}) AS term FROM conversations) WHERE length(term) >= 5"""
FOUND_TERMS = "CAST(count(*) AS BIGINT) AS n_terms, md5(array_to_string(list_sort(list(term)), ',')) AS terms_md5"


def found_terms(matches):
    """How many terms each document holds and the digest of their sorted list."""
    lists = matched_terms(matches, "doc_id")
    return lists.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.md5(F.array_join("terms", ",")).alias("terms_md5"))


@query(
    "J6_table_lexicon",
    f"""WITH lexicon AS MATERIALIZED ({TABLE_LEXICON})
        SELECT doc_id, {FOUND_TERMS} FROM documents JOIN lexicon ON contains(lower(text), term) GROUP BY doc_id""",
)
def j6_table(spark, sf):
    """The thousands of words of the conversations, looked for inside every document."""
    said = i.load(spark, sf, "conversations").select(F.explode(tx.tokens(F.col("text"))).alias("term"))
    lexicon = said.where(F.length("term") >= 5).distinct()
    docs = i.load(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    return found_terms(lexicon_matches(docs, lexicon, "doc_id", lists=True))


@query(
    "F5_table_phrases",
    f"""WITH lexicon AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+ [a-z]+')) AS term FROM benchmark),
        docs AS MATERIALIZED (
            SELECT doc_id, {i.sql_ascii(r"trim(regexp_replace(lower(text), '[\s]+', ' ', 'g'))")} AS text FROM documents)
        SELECT doc_id, {FOUND_TERMS} FROM docs JOIN lexicon
        ON contains(text, term) AND regexp_matches(text, '(?:^|\\W)' || term || '(?:\\W|$)') GROUP BY doc_id""",
)
def f5_table(spark, sf):
    """Pairs of words of the benchmark as whole phrases."""
    pairs = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+ [a-z]+"), F.lit(0))
    lexicon = i.load(spark, sf, "benchmark").select(F.explode(pairs).alias("term"))
    return found_terms(lexicon_matches(i.load(spark, sf, "documents"), lexicon, "doc_id", phrases=True))


PHRASES = ["in the", "of the", "de la", "und der", "with the and"]


def phrase_sql(x, phrases):
    body = "|".join("(?:" + r"\s+".join(p.split()) + ")" for p in phrases)
    return f"regexp_matches({x}, {sql_text(r'(?:^|\W)(?:' + body + r')(?:\W|$)')})"


@query(
    "F3_F5_phrase_match",
    f"""SELECT doc_id, {phrase_sql(sql_ascii(r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"), PHRASES)} AS found FROM documents""",
)
def f5(spark, sf):
    docs = i.load(spark, sf, "documents")
    return docs.select("doc_id", tx.phrase_match(tx.normalize_space(F.col("text")), PHRASES).alias("found"))


@query(
    "F3_F4_F10_text_functions",
    rf"""SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS spaced,
        md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_')) AS term,
        regexp_replace(lower({sql_strip('source')}), '[\s\-_]+', '_', 'g') AS token,
        sha256({sql_strip('text')}) AS hash FROM documents""",
)
def f34(spark, sf):
    return i.load(spark, sf, "documents").select(
        "doc_id",
        F.md5(tx.normalize_space(F.col("text"))).alias("spaced"),
        F.md5(tx.normalize_term(F.col("text"))).alias("term"),
        tx.normalize_token(F.col("source")).alias("token"),
        tx.text_sha256(F.col("text")).alias("hash"),
    )


SENTENCES = f"list_filter(list_transform(string_split_regex({{x}}, '[.;\\n]+'), lambda s: {sql_strip('s')}), lambda s: s <> '')"


@query(
    "F6_W6_sentences",
    f"""SELECT doc_id, CAST(len(parts) AS BIGINT) AS n, list_filter(parts, lambda s: contains(lower(s), 'the'))[1] AS first_with_the
        FROM (SELECT doc_id, {SENTENCES.format(x='text')} AS parts FROM documents)""",
)
def f6(spark, sf):
    docs = i.load(spark, sf, "documents").withColumn("parts", tx.sentences(F.col("text")))
    return docs.select(
        "doc_id", F.size("parts").cast("long").alias("n"), summary.first_sentence("parts", ["the"]).alias("first_with_the")
    )


# ------------------------------------------------------------------ intents

_families = ", ".join(
    f"regexp_matches(t, {sql_text('|'.join(f'(?:{p})' for p in patterns))}) AS rx_{name}"
    for name, patterns in ti.INTENT_PATTERNS.items()
)
_w = ti.HOSPITALIZATION_WINDOW


def semantic_sql(table, text, keep):
    """Semantic tags of a table, one regex column per family."""
    return rf"""
    prepared AS (SELECT {keep}, {sql_ascii(rf"trim(regexp_replace(lower({text}), '\s+', ' ', 'g'))")} AS t FROM {table}),
    mentions AS (SELECT *, string_split_regex(t, {sql_text(ti.HOSPITALIZATION)}) AS parts,
                        regexp_extract_all(t, {sql_text(ti.HOSPITALIZATION)}) AS words FROM prepared),
    prefixes AS (SELECT *, list_transform(generate_series(1, len(words)), lambda k: right(array_to_string(
                        list_transform(generate_series(1, k), lambda j: parts[j] || CASE WHEN j < k THEN words[j] ELSE '' END), ''), {_w})) AS before
                 FROM mentions),
    families AS (SELECT {keep}, {_families},
        {phrase_sql('t', ti.INFORMATION_REQUEST_PHRASES)} AS asks, {phrase_sql('t', ti.INGREDIENT_PHRASES)} AS listed,
        len(list_filter(before, lambda p: NOT regexp_matches(p, {sql_text(ti.HOSPITALIZATION_NEGATION)}))) > 0 AS hospital
        FROM prefixes),
    detected AS (SELECT *, rx_ingredient AND (asks OR listed) AS ing FROM families),
    semantic AS (SELECT {keep}, list_filter([
        CASE WHEN rx_gastrointestinal OR rx_neurologic OR rx_respiratory THEN 'adverse_event' END,
        CASE WHEN hospital THEN 'pet_hospitalization' END,
        CASE WHEN rx_gastrointestinal THEN 'gastrointestinal' END,
        CASE WHEN rx_neurologic THEN 'neurologic_signs' END,
        CASE WHEN rx_respiratory THEN 'respiratory_context' END,
        CASE WHEN ing THEN 'ingredient_question' END,
        CASE WHEN rx_supplier AND asks AND NOT rx_manufacturer_reporting THEN 'supplier_question' END,
        CASE WHEN rx_bud THEN 'bud_question' END,
        CASE WHEN rx_device THEN 'device_concern' END,
        CASE WHEN rx_efficacy THEN 'efficacy_concern' END,
        CASE WHEN rx_appearance THEN 'appearance_concern' END,
        CASE WHEN rx_storage THEN 'storage_concern' END,
        CASE WHEN rx_administration_technique OR (rx_administration_topic AND rx_question_request) THEN 'administration_question' END,
        CASE WHEN rx_quantity THEN 'quantity_discrepancy' END,
        CASE WHEN rx_palatability AND NOT ing THEN 'palatability_concern' END,
        CASE WHEN rx_transdermal THEN 'transdermal_site_concern' END], lambda x: x IS NOT NULL) AS semantic_tags FROM detected)"""


_policy = ", ".join(f"({sql_text(a)}, {sql_text(b)})" for a, bs in ti.TAG_POLICY.items() for b in bs)
_tag_terms = ", ".join(
    f"({sql_text(tag)}, {t_ord}, {p_ord}, {sql_text(term)})"
    for t_ord, tag in enumerate(ti.RETRIEVAL_TAGS)
    for p_ord, term in enumerate(ti.TAG_SEARCH_TERMS[tag])
)


def derived_sql(key):
    """Derived tags and intent search terms per ``key``, from the semantic tags."""
    return f"""
    policy(a, b) AS (VALUES {_policy}),
    tag_terms(tag, t_ord, p_ord, term) AS (VALUES {_tag_terms}),
    tags AS (SELECT {key}, unnest(semantic_tags) AS tag FROM semantic),
    all_tags AS (SELECT {key}, tag FROM tags UNION SELECT {key}, b FROM tags JOIN policy ON tag = a),
    derived AS (SELECT {key}, list(tag ORDER BY list_position({sql_list(ti.RETRIEVAL_TAGS)}, tag)) AS intent_tags FROM all_tags GROUP BY ALL),
    concepts AS (SELECT {key}, string_agg(term, ' ' ORDER BY t_ord, p_ord) AS terms FROM (
        SELECT {key}, term, min(t_ord) AS t_ord, arg_min(p_ord, t_ord * 100 + p_ord) AS p_ord
        FROM all_tags JOIN tag_terms USING (tag) GROUP BY ALL) GROUP BY ALL)"""


def concept_text(text, terms="terms"):
    return f"{sql_strip(text)} || CASE WHEN coalesce({terms}, '') = '' THEN '' ELSE chr(10) || chr(10) || 'Retrieval concepts: ' || {terms} END"


INTENT_SQL = f"""WITH {CONCERNS}, {semantic_sql('concerns', 'concern_text', 'case_id, concern_text')}, {derived_sql('case_id')}
SELECT case_id, {sql_join('semantic_tags', 'semantic_tags')}, coalesce(array_to_string(intent_tags, '|'), '') AS intent_tags,
       {concept_text('concern_text')} AS search_text
FROM semantic LEFT JOIN derived USING (case_id) LEFT JOIN concepts USING (case_id)"""


@query("R9_R10_R11_J7_J8_T3_intent_queries", INTENT_SQL)
def r9(spark, sf):
    tagged = intents.derived_intents(intents.semantic_intents(i.concerns(spark, sf)))
    done = intents.expand_intent(tagged, "concern_text")
    return done.select("case_id", *joined("semantic_tags", "intent_tags"), "search_text")


@query(
    "R9_documents_intents",
    f"""WITH {semantic_sql('documents', 'text', 'doc_id')}
        SELECT doc_id, {sql_join('semantic_tags', 'semantic_tags')} FROM semantic""",
)
def r9_docs(spark, sf):
    return intents.semantic_intents(i.load(spark, sf, "documents"), "text").select("doc_id", *joined("semantic_tags"))


def _group_hit(g):
    hit = sql_any("low", g["when"])
    for p in g.get("when_pattern", []):
        hit = f"({hit} OR {sql_rx(sql_ascii('low'), p, False)})"
    return hit


def _gathered(part):
    lists = [f"CASE WHEN h{n} THEN {sql_list(g[part]) if g[part] else '[]::VARCHAR[]'} ELSE []::VARCHAR[] END" for n, g in enumerate(ti.EXPANSION_GROUPS)]
    flat = f"flatten([{', '.join(lists)}])"
    return f"list_filter({flat}, lambda x, k: list_position({flat}, x) = k)"


def deterministic_sql(table, text, keep):
    hits = ", ".join(f"{_group_hit(g)} AS h{n}" for n, g in enumerate(ti.EXPANSION_GROUPS))
    return f"""
    hit AS (SELECT *, {hits} FROM (SELECT {keep}, {text}, lower({sql_strip(text)}) AS low FROM {table})),
    expanded AS (SELECT {keep}, {text}, {_gathered('terms')} AS terms, {_gathered('tags')} AS issue_tags,
        {_gathered('required')} AS required_topics, {_gathered('excluded')} AS excluded_topics FROM hit)"""


@query(
    "R11_U1_deterministic_expansion",
    f"""WITH {CONCERNS}, {deterministic_sql('concerns', 'concern_text', 'case_id')}
        SELECT case_id, {concept_text('concern_text', "array_to_string(terms, ' ')")} AS search_text,
               {sql_join('issue_tags', 'issue_tags')}, {sql_join('required_topics', 'required_topics')},
               {sql_join('excluded_topics', 'excluded_topics')} FROM expanded""",
)
def r11(spark, sf):
    done = intents.expand_deterministic(i.concerns(spark, sf), "concern_text")
    return done.select("case_id", "search_text", *joined("issue_tags", "required_topics", "excluded_topics"))


# expected reading of each supplied answer, written out by hand
_answers = [
    ("ok", "bud_question|device_concern", ""),
    ("ok", "gastrointestinal", ""),
    ("unknown_tags", None, "billing"),
    ("structured_output_failure", None, ""),
    ("structured_output_failure", None, ""),
    ("structured_output_failure", None, ""),
    ("ok", "adverse_event|supplier_question", ""),
]


TAG_NAMES = [t.upper().replace("_", "-" if n % 2 else " ") for n, t in enumerate(SEMANTIC_TAGS)]


@query(
    "R12_F7_model_intents",
    f"""WITH told AS (
            SELECT conv_id || '-' || turn AS case_id, length(text) AS n, {i.sql_tokens('text')} AS words FROM conversations),
        tagged AS (
            SELECT *, list_filter({sql_list(SEMANTIC_TAGS)}, lambda t: t = {i.sql_pick(SEMANTIC_TAGS, 'n')}
                       OR t = {i.sql_pick(SEMANTIC_TAGS, 'len(words)')}) AS known,
                   CASE WHEN len(words) % 3 = 0 THEN list_sort(list_distinct(words[1:2])) ELSE [] END AS others FROM told)
        SELECT case_id, CASE WHEN n % 11 = 0 THEN 'structured_output_failure' WHEN len(others) > 0 THEN 'unknown_tags' ELSE 'ok' END
                   AS model_status,
               CASE WHEN n % 11 = 0 OR len(others) > 0 THEN NULL ELSE array_to_string(known, '|') END AS model_tags,
               CASE WHEN n % 11 = 0 THEN '' ELSE array_to_string(others, '|') END AS unknown_tags FROM tagged""",
)
def r12(spark, sf):
    """Answers made of each turn's own words: tags in several spellings, unknown words, and answers with a second key."""
    words, n = tx.tokens(F.col("text")), F.length("text")
    told = i.load(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("case_id"),
        n.alias("n"), words.alias("words"), "text",
    )
    tags = F.concat(
        F.array(i.pick(TAG_NAMES, F.col("n")), i.pick(TAG_NAMES, F.size("words"))),
        F.when(F.size("words") % 3 == 0, F.slice("words", 1, 2)).otherwise(tx.lit_array([])),
    )
    second = F.when(F.col("n") % 11 == 0, F.concat(F.lit(', "note": '), F.to_json(F.array("text")))).otherwise(F.lit(""))
    body = F.concat(F.lit('{"tags": '), F.to_json(tags), second, F.lit("}"))
    fenced = F.when(F.col("n") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    answers = told.select("case_id", fenced.alias("model_json"))
    return intents.model_intents(answers).select("case_id", "model_status", *joined("model_tags", "unknown_tags"))


@query(
    "F7_event_json",
    "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events",
)
def f7(spark, sf):
    from tracewell.functions.json_text import json_object_text

    fenced = F.concat(F.lit("Answer:\n```json\n"), "props", F.lit("\n``` done"))
    return i.load(spark, sf, "events").select(
        "event_id", F.from_json(json_object_text(fenced), "k bigint")["k"].alias("k")
    )


# ------------------------------------------------------------------ notes

NOTE = {n: sql_rx("note", p) for n, p in ts.NOTE_PATTERNS.items()}
SCOPE = {n: p for n, p in ts.SCOPE_PATTERNS.items()}


def nrx(name, x="note"):
    return sql_rx(sql_ascii(x), ts.NOTE_PATTERNS[name])


def srx(name, x):
    return sql_rx(sql_ascii(x), ts.SCOPE_PATTERNS[name])


_terms = ", ".join(f"({sql_text(n)}, {sql_text(w)})" for n, words in ts.TRIGGER_TERMS.items() for w in words)


def triggers_sql(name, table, text, key="case_id"):
    """Affirmed triggers per key: sentence by sentence, term by term."""
    return f"""
    {name}_parts AS (SELECT {key}, n, s, {sql_ascii('s')} AS a FROM (
        SELECT {key}, unnest({SENTENCES.format(x=text)}) AS s, generate_subscripts({SENTENCES.format(x=text)}, 1) AS n FROM {table})),
    {name}_terms AS (SELECT {key}, n, s, a, trig, term, strpos(lower(s), term) AS pos, lower(a) AS low
        FROM {name}_parts JOIN (VALUES {_terms}) AS w(trig, term) ON contains(lower(s), term)),
    {name}_said AS (SELECT {key}, n, trig,
        bool_or({sql_rx('substr(low, pos, length(term) + 45)', ts.NOTE_PATTERNS['ruled_out_after'])}
            OR (trig = 'repeat_issue_same_lot_or_batch_with_conditions' AND {sql_rx('substr(low, pos, length(term) + 45)', ts.NOTE_PATTERNS['repeat_negated_after'])})
            OR {sql_rx('right(substr(low, 1, pos - 1), 90)', ts.NOTE_PATTERNS['negation'])}
            OR {sql_rx('substr(low, 1, pos - 1)', ts.NOTE_PATTERNS['coordinated_negation'])}) AS negated,
        bool_or({sql_rx('a', ts.NOTE_PATTERNS['affirmation'])}) AS affirmed FROM {name}_terms GROUP BY ALL),
    {name} AS (SELECT {key}, list_sort(list(DISTINCT trig)) AS triggers FROM {name}_said WHERE affirmed AND NOT negated GROUP BY ALL)"""


@query(
    "R16_R17_triggers",
    f"""WITH {CASES}, {triggers_sql('noted', 'cases', 'reviewer_note')}, {triggers_sql('told', 'cases', 'concern_text')}
        SELECT case_id, coalesce(array_to_string(n.triggers, '|'), '') AS observed,
               coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(n.triggers, []), coalesce(t.triggers, [])))), '|'), '') AS merged
        FROM cases LEFT JOIN noted n USING (case_id) LEFT JOIN told t USING (case_id)""",
)
def r16(spark, sf):
    done = summary.with_triggers(
        summary.with_triggers(i.cases(spark, sf), "reviewer_note", "observed"), "concern_text", "told"
    )
    return done.select(
        "case_id", *joined("observed"),
        F.array_join(summary.merge_reported_triggers(F.col("observed"), F.col("told")), "|").alias("merged"),
    )


RECORD_SQL = f"""CASE WHEN {nrx('record_not_applicable')} THEN 'not_applicable' WHEN {nrx('record_incomplete')} THEN 'documentation_incomplete'
    WHEN {nrx('record_discrepancy')} AND NOT {nrx('record_discrepancy_cleared')} THEN 'documentation_discrepancy_found'
    WHEN {nrx('record_no_discrepancy')} THEN 'no_discrepancy_found' ELSE 'no_discrepancy_found' END"""
LOT_SQL = f"""CASE WHEN {nrx('lot_not_applicable')} THEN 'not_applicable' WHEN {nrx('lot_trend_threshold')} THEN 'trend_threshold_met'
    WHEN {nrx('lot_no_similar')} THEN 'no_similar_batch_concerns_found' WHEN {nrx('lot_same_batch')} THEN 'similar_concern_same_batch_found'
    WHEN {nrx('lot_same_product')} THEN 'similar_concern_same_medication_dosage_form_found'
    WHEN {nrx('lot_unavailable')} THEN 'unavailable' ELSE 'unavailable' END"""
INVENTORY_SQL = f"""CASE WHEN {nrx('inventory_not_applicable')} THEN 'not_applicable' WHEN {nrx('inventory_unavailable')} THEN 'no_inventory_available'
    WHEN {nrx('inventory_not_checked')} THEN 'not_checked' WHEN {nrx('inventory_no_visual')} THEN 'no_visual_concern_found'
    WHEN {nrx('inventory_visual')} THEN 'visual_concern_found' ELSE 'not_checked' END"""
UNSUPPORTED = f"({nrx('reference_non_disclosure')} OR {nrx('reference_unsupported')})"
REFERENCE_SQL = f"""CASE WHEN {UNSUPPORTED} THEN 'not_supported_by_public_corpus' WHEN {nrx('reference_consulted')} THEN 'external_reference_consulted'
    WHEN {nrx('reference_synthetic')} THEN 'synthetic_reference_consulted' ELSE 'not_needed' END"""
LIMITS_SQL = f"""list_concat(list_concat(CASE n % 4 WHEN 2 THEN ['seen once'] WHEN 3 THEN ['single item'] ELSE [] END,
    CASE WHEN {nrx('inventory_not_applicable')} THEN [] WHEN {nrx('inventory_unavailable')} THEN [{sql_text(ts.LIMIT_NO_INVENTORY)}]
         WHEN {nrx('inventory_not_checked')} THEN [{sql_text(ts.LIMIT_NOT_INSPECTED)}] ELSE [] END),
    CASE WHEN {UNSUPPORTED} THEN [{sql_text(ts.LIMIT_UNSUPPORTED_REFERENCE)}] ELSE [] END)"""
FULL_SQL = " OR ".join(
    [srx(n, "note") for n in ("record_result", "lot_result", "inventory_result")]
    + [srx(n, "concern") for n in ("clinical_event", "product_quality", "device_failure", "effectiveness_failure", "formulation_reaction")]
)


def has(*words):
    return sql_any("low", words)


ITEM_SQL = rf"""CASE WHEN {has('storage', 'temperature')} THEN 'Storage and temperature conditions'
    WHEN {has('shaking', 'resuspension')} THEN 'Shaking and resuspension technique'
    WHEN {has('syringe', 'measurement technique')} THEN 'Syringe selection and measurement technique'
    WHEN {has('other medications', 'concurrent therapy')} THEN 'Other medications and concurrent therapy'
    WHEN {has('dose appropriateness')} AND {has('could not be evaluated', 'unable to evaluate', 'could not evaluate')} THEN 'Dose appropriateness from the available directions'
    WHEN {has('dose')} THEN 'Exact dose administered'
    WHEN {has('timeline')} THEN 'Event timeline'
    WHEN {has('reported symptoms')} OR ({has('symptom')} AND {has('severity')}) THEN 'Reported symptoms and severity'
    WHEN {has('transdermal')} AND {has('rotation', 'cleaning', 'site')} THEN 'Transdermal application-site rotation and cleaning'
    WHEN {has('leakage', 'physical damage')} THEN 'Whether leakage or physical damage was observed'
    WHEN {has('exposure duration', 'number of doses')} THEN 'Exposure duration and number of doses administered'
    WHEN {has('device behavior', 'usable medication', 'dispense', 'came out')} THEN 'Whether medication dispensed from the device'
    WHEN {has('veterinarian')} OR {sql_rx(sql_ascii('low'), ts.NOTE_PATTERNS['vet_word'], False)} THEN 'Veterinarian involvement and recommendations'
    WHEN {has('lot', 'batch')} THEN 'Lot or batch trend information'
    WHEN {has('shortage')} THEN 'Whether there was a confirmed shortage'
    ELSE nullif(trim(regexp_replace(regexp_replace(s, '(?i)^unresolved investigation items:\s*', ''), '(?i)^(?:confirm|clarify|determine whether)\s+', ''), ' .'), '') END"""

NOTES = f"""{CASES},
    notes AS (SELECT case_id, n, {sql_strip('concern_text')} AS concern, {sql_strip('reviewer_note')} AS note, concern_text, reviewer_note FROM cases),
    note_parts AS (SELECT case_id, unnest(p) AS s, generate_subscripts(p, 1) AS k FROM (SELECT case_id, {SENTENCES.format(x='note')} AS p FROM notes)),
    items AS (
        SELECT case_id, -2 AS k, 'Exact dose administered' AS item FROM notes WHERE {nrx('dose_missing')}
        UNION ALL SELECT case_id, -1, 'Whether medication dispensed from the device' FROM notes WHERE {nrx('dispense_missing')}
        UNION ALL SELECT case_id, k, {ITEM_SQL} FROM (SELECT *, lower(s) AS low FROM note_parts) WHERE {sql_rx(sql_ascii('s'), ts.NOTE_PATTERNS['missing_sentence'])}),
    missing AS (SELECT case_id, list(item ORDER BY k) AS items FROM (
        SELECT case_id, item, min(k) AS k FROM items WHERE item IS NOT NULL GROUP BY ALL) GROUP BY ALL)"""


def supplied(df):
    """Cases with the summary columns as supplied."""
    return summary.parse_summary(df)


STATUS_SQL = "CASE WHEN n % 5 NOT IN (0, 1) AND n % 11 = 2 THEN 'unparsable' ELSE 'ok' END"


def null_unless_ok(df, *columns):
    """Columns of the rows whose JSON could be used; null in the others."""
    ok = F.col("extraction_status") == "ok"
    return df.withColumns({c: F.when(ok, F.col(c)) for c in columns})


@query(
    "R15_R18_ground_summary",
    f"""WITH {NOTES}
        SELECT case_id, extraction_status,
               CASE WHEN extraction_status = 'ok' THEN record_review_result END AS record_review_result,
               CASE WHEN extraction_status = 'ok' THEN lot_batch_pattern_summary END AS lot_batch_pattern_summary,
               CASE WHEN extraction_status = 'ok' THEN inventory_inspection_result END AS inventory_inspection_result,
               CASE WHEN extraction_status = 'ok' THEN api_reference_review_result END AS api_reference_review_result,
               CASE WHEN extraction_status = 'ok' THEN evidence_limitations END AS evidence_limitations,
               CASE WHEN extraction_status = 'ok' THEN missing_information END AS missing_information
        FROM (SELECT case_id, {STATUS_SQL} AS extraction_status, {RECORD_SQL} AS record_review_result, {LOT_SQL} AS lot_batch_pattern_summary,
               {INVENTORY_SQL} AS inventory_inspection_result, {REFERENCE_SQL} AS api_reference_review_result,
               {sql_join(LIMITS_SQL, 'evidence_limitations')}, coalesce(array_to_string(items, '|'), '') AS missing_information
        FROM notes LEFT JOIN missing USING (case_id))""",
)
def r15(spark, sf):
    done = summary.ground_summary(summary.parse_summary(i.cases(spark, sf)))
    lists = ("evidence_limitations", "missing_information")
    return null_unless_ok(done, *ts.ENUM_FIELDS, *lists).select("case_id", "extraction_status", *ts.ENUM_FIELDS, *joined(*lists))


DEFAULTS = f"""
    defaulted AS (SELECT notes.*, items, full_scope,
        CASE WHEN NOT {srx('record_result', 'reviewer_note')} THEN CASE WHEN full_scope THEN 'documentation_incomplete' ELSE 'not_applicable' END
             ELSE {RECORD_SQL} END AS record_review_result,
        CASE WHEN {srx('same_batch', 'reviewer_note')} THEN 'similar_concern_same_batch_found'
             WHEN {srx('no_similar_lot', 'reviewer_note')} THEN 'no_similar_batch_concerns_found'
             WHEN NOT {srx('lot_result', 'reviewer_note')} THEN CASE WHEN full_scope THEN 'unavailable' ELSE 'not_applicable' END
             ELSE {LOT_SQL} END AS lot_batch_pattern_summary,
        CASE WHEN NOT {srx('inventory_result', 'reviewer_note')} THEN CASE WHEN full_scope THEN 'not_checked' ELSE 'not_applicable' END
             ELSE {INVENTORY_SQL} END AS inventory_inspection_result,
        CASE WHEN NOT {srx('reference_result', 'reviewer_note')} THEN 'not_needed' ELSE {REFERENCE_SQL} END AS api_reference_review_result,
        {LIMITS_SQL} AS limits
        FROM (SELECT *, ({FULL_SQL}) AS full_scope FROM notes) notes LEFT JOIN missing USING (case_id))"""


@query(
    "R13_R14_scope_defaults",
    f"""WITH {NOTES}, {DEFAULTS}
        SELECT case_id, {STATUS_SQL} AS extraction_status,
               CASE WHEN full_scope THEN 'full_investigation' ELSE 'guidance_only' END AS summary_scope,
               CASE WHEN {STATUS_SQL} = 'ok' THEN record_review_result END AS record_review_result,
               CASE WHEN {STATUS_SQL} = 'ok' THEN lot_batch_pattern_summary END AS lot_batch_pattern_summary,
               CASE WHEN {STATUS_SQL} = 'ok' THEN inventory_inspection_result END AS inventory_inspection_result,
               CASE WHEN {STATUS_SQL} = 'ok' THEN api_reference_review_result END AS api_reference_review_result
        FROM defaulted""",
)
def r13(spark, sf):
    grounded = summary.ground_summary(summary.parse_summary(i.cases(spark, sf)))
    done = summary.review_scope(summary.scope_defaults(grounded))
    return null_unless_ok(done, *ts.ENUM_FIELDS).select("case_id", "extraction_status", "summary_scope", *ts.ENUM_FIELDS)


QX = {n: (lambda x, p=p: sql_rx(sql_ascii(x), p)) for n, p in ts.QUESTION_PATTERNS.items()}


def first_sql(parts, terms):
    return f"list_filter({parts}, lambda s: {sql_any('lower(s)', terms)})[1]"


def quotes_sql():
    columns = []
    for field, terms in ts.FIELD_SUPPORT_TERMS.items():
        quote = first_sql("np", terms)
        if field == "severe_triggers_observed":
            quote = f"coalesce({quote}, {first_sql('cp', terms)})"
        columns.append(f"{quote} AS q_{field}")
    return ", ".join(columns)


def status_sql(field):
    q = f"q_{field}"
    empty = {"missing_information": "coalesce(len(items), 0) = 0", "evidence_limitations": "len(limits) = 0",
             "severe_triggers_observed": "coalesce(len(triggers), 0) = 0"}
    rest = "'normalized'" if field in ts.ENUM_FIELDS else (
        f"CASE WHEN {empty[field]} THEN 'not_stated' ELSE 'explicit' END" if field in empty else "'explicit'")
    return f"CASE WHEN {q} IS NULL THEN 'not_stated' WHEN {sql_rx(sql_ascii(q), ts.NOTE_PATTERNS['ambiguity'])} THEN 'ambiguous' ELSE {rest} END"


_conditions = {
    "hospitalization_status": f"vom AND NOT {QX['hospitalization']('both_texts')}",
    "symptom_resolution": f"vom AND NOT {QX['resolution']('both_texts')}",
    "veterinarian_contact": f"vom AND NOT {QX['vet_contact']('both_texts')}",
    "dose_administered": f"vom AND NOT {QX['administered_dose']('both_texts')}",
    "event_timing": f"vom AND NOT {QX['timing']('both_texts')}",
    "wrong_medication_status": f"{QX['wrong_medication']('c')} AND NOT (({QX['wrong_medication']('note')} AND {QX['ruled_out']('note')}) OR {QX['correct_medication']('note')}) AND coalesce(len(triggers), 0) = 0",
    "contamination_status": f"{QX['contamination']('c')} AND NOT ({QX['contamination']('note')} AND {QX['ruled_out']('note')}) AND coalesce(len(triggers), 0) = 0",
    "device_dispense_status": f"({QX['device_direct']('c')} OR len(list_filter(string_split_regex({sql_ascii('c')}, '[.;\\n]+'), lambda s: {sql_rx('s', ts.QUESTION_PATTERNS['device_object'])} AND {sql_rx('s', ts.QUESTION_PATTERNS['device_signal'])})) > 0) AND ({QX['dispense_unresolved']('both_texts')} OR NOT {QX['dispense_documented']('both_texts')})",
    "bud_date_context": f"{sql_any('c', ts.QUESTION_TERMS['bud'])} AND NOT {QX['calendar_date']('both_texts')}",
    "lot_batch_context": "(contains(c, 'lot') OR contains(c, 'batch')) AND lot_batch_pattern_summary = 'unavailable'",
}
EXTRACT = f"""WITH {NOTES}, {DEFAULTS}, {triggers_sql('noted', 'cases', 'reviewer_note')}, {triggers_sql('told', 'cases', 'concern_text')},
    merged AS (SELECT d.*, list_sort(list_distinct(list_concat(coalesce(a.triggers, []), coalesce(b.triggers, [])))) AS triggers
        FROM defaulted d LEFT JOIN noted a USING (case_id) LEFT JOIN told b USING (case_id)),
    quoted AS (SELECT *, {quotes_sql()}, lower(concern) AS c, {sql_any('lower(concern)', ts.QUESTION_TERMS['vomiting'])} AS vom,
        {sql_strip("concern_text || chr(10) || reviewer_note")} AS both_texts
        FROM (SELECT *, {SENTENCES.format(x='note')} AS np, {SENTENCES.format(x='concern_text')} AS cp FROM merged)),
    extracted AS (SELECT *, [{', '.join(status_sql(f) for f in ts.FIELD_SUPPORT_TERMS)}] AS statuses,
        [{', '.join(f"coalesce(q_{f}, '-')" for f in ts.FIELD_SUPPORT_TERMS)}] AS quotes,
        list_filter([{', '.join(f"CASE WHEN {c} THEN {sql_text(f)} END" for f, c in _conditions.items())}], lambda x: x IS NOT NULL) AS open_fields FROM quoted)
"""
USABLE = "NOT (n % 5 NOT IN (0, 1) AND n % 11 = 2)"


def usable(column):
    return f"CASE WHEN {USABLE} THEN {column} END"


@query(
    "R19_R20_R21_F8_F9_extract_summary",
    EXTRACT
    + f"""SELECT case_id, CASE WHEN {USABLE} THEN 'ok' ELSE 'unparsable' END AS extraction_status,
        {', '.join(f"{usable(f)} AS {f}" for f in ts.ENUM_FIELDS)},
        {usable("'case ' || n")} AS customer_context_summary,
        {usable("coalesce(array_to_string(items, '|'), '')")} AS missing_information,
        {usable("array_to_string(limits, '|')")} AS evidence_limitations,
        {usable("array_to_string(triggers, '|')")} AS severe_triggers_observed,
        {usable("array_to_string(statuses, '|')")} AS statuses, {usable("array_to_string(quotes, '|')")} AS quotes,
        {usable("array_to_string(open_fields, '|')")} AS open_fields FROM extracted""",
)
def r21(spark, sf):
    done = summary.extract_summary(i.cases(spark, sf))
    return done.select(
        "case_id", "extraction_status", *ts.ENUM_FIELDS, "customer_context_summary", *joined(*ts.LIST_FIELDS),
        F.array_join(F.transform("field_evidence", lambda e: e["status"]), "|").alias("statuses"),
        F.array_join(F.transform("field_evidence", lambda e: F.coalesce(e["supporting_quote"], F.lit("-"))), "|").alias("quotes"),
        F.array_join(F.transform("unresolved_questions", lambda q: q["field_name"]), "|").alias("open_fields"),
    )


# ------------------------------------------------------------------ assessment


@query(
    "R22_product_context",
    f"""WITH {CONCERNS}, low AS (SELECT case_id, lower(concern_text) AS low FROM concerns)
        SELECT case_id, CASE WHEN {has('dog')} THEN 'dog' WHEN {has('cat')} THEN 'cat' ELSE 'unknown' END AS species,
        CASE WHEN {has('transdermal', 'pen')} THEN 'transdermal' WHEN {has('liquid', 'oral')} THEN 'oral_liquid' ELSE 'unknown' END AS dosage_form,
        CASE WHEN {has('chicken')} THEN 'chicken' WHEN {has('beef')} THEN 'beef' WHEN {has('tuna')} THEN 'tuna' WHEN {has('flavor')} THEN 'flavor' END AS flavor_or_attribute
        FROM low""",
)
def r22(spark, sf):
    done = assessment.product_context(i.concerns(spark, sf))
    return done.select("case_id", "species", "dosage_form", "flavor_or_attribute")


_d = ta.DECISIONS


def decided(field, last=None):
    return case_map("decision", {k: (sql_text(v[field]) if v[field] is not None else "NULL") for k, v in _d.items()})


ASSESS = f"""WITH {CASES}, {FLAGGED.format(table='cases')}, {triggers_sql('noted', 'cases', 'reviewer_note')},
    typed AS (SELECT case_id, {TYPE_SQL} AS concern_type, {LANE_SQL} AS risk_lane FROM flagged),
    laned AS (SELECT *, coalesce(concern_type, 'possible_adverse_drug_event') AS kind,
        CASE WHEN len(triggers) > 0 THEN 'life_threatening_or_legal'
             WHEN concern_type IN ('flavor_related_vomiting', 'possible_adverse_drug_event') THEN 'unexpected_non_life_threatening'
             ELSE coalesce(risk_lane, 'expected_self_limiting') END AS final_lane FROM typed LEFT JOIN noted USING (case_id)),
    decisions AS (SELECT *, CASE WHEN kind = 'wrong_patient_or_wrong_medication' THEN 'wrong_medication'
        WHEN final_lane = 'life_threatening_or_legal' THEN 'severe'
        WHEN kind IN ('flavor_related_vomiting', 'possible_adverse_drug_event') THEN 'adverse_event'
        WHEN kind = 'syringe_or_device_issue' THEN 'device' WHEN kind = 'bud_question' THEN 'bud' ELSE 'routine' END AS decision FROM laned),
    assessed AS (SELECT case_id, {decided('classification')} AS reviewer_assigned_classification, {decided('category')} AS reviewer_assigned_category,
        CASE WHEN decision = 'adverse_event' AND kind = 'flavor_related_vomiting' THEN 'flavor_related_ADE' ELSE {decided('subcategory')} END AS reviewer_assigned_subcategory,
        kind AS concern_type, CASE WHEN decision = 'wrong_medication' THEN 'life_threatening_or_legal' ELSE final_lane END AS risk_lane,
        {decided('review_scope')} AS review_scope, {decided('handling_path')} AS handling_path,
        decision <> 'bud' AS resolution_review_required,
        {case_map('decision', {k: sql_text('|'.join(v['resolution_options'])) for k, v in _d.items()})} AS resolution_options,
        CASE WHEN decision = 'wrong_medication' AND coalesce(len(triggers), 0) = 0 THEN 'wrong_patient_or_wrong_medication'
             WHEN decision IN ('wrong_medication', 'severe') THEN coalesce(array_to_string(triggers, '|'), '') ELSE '' END AS escalation_triggers,
        {decided('rationale')} AS rationale FROM decisions)
"""


def assessed(spark, sf):
    """Checklist rows joined to their review summaries, then decided."""
    rows = i.cases(spark, sf)
    checks = checklist.checklist_rules(rows.select("case_id", "concern_text"))
    notes = summary.with_triggers(rows.select("case_id", "reviewer_note"), "reviewer_note", "severe_triggers_observed")
    return assessment.final_assessment(checks, notes.drop("reviewer_note"))


@query("R23_R24_J11_final_assessment", ASSESS + "SELECT * FROM assessed")
def r24(spark, sf):
    d = assessed(spark, sf).select("case_id", "derived_assessment.*")
    return d.select(
        *[c for c in d.columns if c not in ("resolution_options", "escalation_triggers")],
        *joined("resolution_options", "escalation_triggers"),
    )
