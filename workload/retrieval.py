"""Search, ranking and retrieval evaluation."""

from pyspark.sql import functions as F

from tracewell.functions.text import tokens
from tracewell.operators import metrics
from tracewell.operators.dense import dense_search
from tracewell.operators.ranking import source_ranks, top_k
from tracewell.operators.pruned import pruned_search, read_impact_index, write_impact_index
from tracewell.operators.search import (
    candidate_totals,
    hybrid_search,
    keyword_search,
    keyword_totals,
    vector_search,
)
from tracewell.operators.terms import chunk_terms, chunk_vectors, invalid_queries, query_terms
from tracewell.plans import evaluate as ev
from tracewell.session import stored, work_folder
from tracewell.sources import metric_log
from tracewell.sources.chunks import read_term_index, write_term_index
from workload import inputs as i
from workload.inputs import with_views
from workload.registry import query

RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)"


def shown(df, *extra):
    return df.select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "chunk_id",
        F.round("score", 6).alias("score"),
        F.array_join("matched_terms", "|").alias("matched_terms"),
        *extra,
    )


def ranked_sql(view: str, k: int = 5, where: str = "") -> str:
    return f"""
        SELECT query_id, rank, chunk_id, round(score, 6) AS score, array_to_string(matched_terms, '|') AS matched_terms
        FROM (SELECT *, {RANK} AS rank FROM {view} {where}) WHERE rank <= {k}"""


SOP = "WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE source_type = 'sop')"


@query("K1_keyword_search", with_views(["keyword_pairs"], ranked_sql("keyword_pairs")))
def k1(spark, sf):
    return shown(keyword_search(i.queries(spark, sf), i.chunks(spark, sf), 5))


@query("K1_P5_keyword_search_by_source_type", with_views(["keyword_pairs"], ranked_sql("keyword_pairs", 5, SOP)))
def k1_source(spark, sf):
    return shown(keyword_search(i.queries(spark, sf), i.chunks(spark, sf), 5, "sop"))


def term_index(spark, sf):
    """Features of all chunks, counted once for every retriever."""
    path = work_folder(spark, "term-index")
    write_term_index(i.chunks(spark, sf), path, dims=128)
    return read_term_index(spark, path)


def impact_index(spark, sf):
    path = work_folder(spark, "impact-index")
    write_impact_index(i.chunks(spark, sf), path)
    return read_impact_index(spark, path)


@query("K1_J1_W1_pruned_keyword_search", with_views(["keyword_pairs"], ranked_sql("keyword_pairs", 10)))
def k1_pruned(spark, sf):
    """The ten best chunks from the posting blocks that can reach them."""
    return shown(pruned_search(i.queries(spark, sf), impact_index(spark, sf), 10).best)


@query("K1_P5_pruned_search_by_source_type", with_views(["keyword_pairs"], ranked_sql("keyword_pairs", 5, SOP)))
def k1_pruned_source(spark, sf):
    return shown(pruned_search(i.queries(spark, sf), impact_index(spark, sf), 5, "sop").best)


VECTOR_SQL = f"""
    SELECT query_id, rank, chunk_id, round(score, 6) AS score,
           coalesce(array_to_string(matched_terms, '|'), '') AS matched_terms
    FROM (SELECT v.*, k.matched_terms, row_number() OVER (PARTITION BY v.query_id ORDER BY v.score DESC, v.chunk_id) AS rank
          FROM vector_pairs v LEFT JOIN keyword_pairs k ON v.query_id = k.query_id AND v.chunk_id = k.chunk_id)
    WHERE rank <= 5"""


@query("K2_vector_search", with_views(["vector_pairs", "keyword_pairs"], VECTOR_SQL))
def k2(spark, sf):
    return shown(vector_search(i.queries(spark, sf), i.chunks(spark, sf), 5))


@query("K3_hybrid_search", with_views(["hybrid_scored"], ranked_sql("hybrid_scored")))
def k3(spark, sf):
    return shown(hybrid_search(i.queries(spark, sf), i.chunks(spark, sf), 5))


@query(
    "K3_Y2_hybrid_supplied_vectors",
    with_views(
        ["keyword_pairs"],
        f"""SELECT query_id, CAST(rank AS BIGINT) AS rank, chunk_id, round(score, 6) AS score FROM (
            SELECT *, {RANK} AS rank FROM (
                SELECT query_id, chunk_id,
                       0.65::DOUBLE * coalesce(keyword / nullif(max(keyword) OVER w, 0), 0)
                       + 0.35::DOUBLE * CASE WHEN max(cosine) OVER w > 0 THEN cosine / max(cosine) OVER w ELSE 0 END AS score
                FROM (SELECT query_id, chunk_id, coalesce(k.score, 0::DOUBLE) AS keyword, coalesce(v.score, 0::DOUBLE) AS cosine
                      FROM keyword_pairs k FULL JOIN (
                          SELECT q.vec_id AS query_id, 'doc-' || c.vec_id AS chunk_id,
                                 round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS score
                          FROM embeddings q JOIN benchmark ON item_id = q.vec_id, embeddings c JOIN documents ON doc_id = c.vec_id) v
                      USING (query_id, chunk_id))
                WHERE keyword > 0 OR cosine > 0 WINDOW w AS (PARTITION BY query_id)))
        WHERE rank <= 5""",
    ),
)
def k3_vectors(spark, sf):
    """The vectors of a model in place of hashed counts: row n embeds document n and query n."""
    given = i.load(spark, sf, "embeddings")
    found = hybrid_search(
        i.queries(spark, sf), i.chunks(spark, sf), 5,
        vectors=given.select(F.concat(F.lit("doc-"), "vec_id").alias("chunk_id"), F.col("embedding").alias("vector")),
        query_vectors=given.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")),
    )
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


@query(
    "J3_W2_hybrid_candidates",
    with_views(
        ["hybrid_pairs"],
        """SELECT query_id, count(*) AS candidates, round(max(keyword_score), 6) AS best_keyword,
                  round(max(vector_score), 6) AS best_vector, round(sum(keyword_score), 2) AS keyword_total,
                  round(sum(vector_score), 2) AS vector_total
           FROM hybrid_pairs GROUP BY ALL""",
    ),
)
def j3(spark, sf):
    """All candidates of either scorer: their number, the best scores that normalise them, and the sums."""
    found = candidate_totals(i.queries(spark, sf), i.chunks(spark, sf))
    return found.select(
        "query_id",
        "candidates",
        *(F.round(c, 6).alias(c) for c in ("best_keyword", "best_vector")),
        *(F.round(c, 2).alias(c) for c in ("keyword_total", "vector_total")),
    )


@query(
    "F1_tokens",
    f"SELECT doc_id, array_to_string({i.sql_tokens('text')}, ' ') AS tokens FROM documents",
)
def f1(spark, sf):
    return i.load(spark, sf, "documents").select("doc_id", F.array_join(tokens(F.col("text")), " ").alias("tokens"))


@query(
    "F1_page_tokens",
    f"SELECT page_id, CAST(len({i.sql_tokens('html')}) AS BIGINT) AS n, array_to_string({i.sql_tokens('url')}, ' ') AS url_tokens FROM pages",
)
def f1_pages(spark, sf):
    return i.load(spark, sf, "pages").select(
        "page_id",
        F.size(tokens(F.col("html"))).cast("long").alias("n"),
        F.array_join(tokens(F.col("url")), " ").alias("url_tokens"),
    )


@query(
    "A1_chunk_terms",
    with_views(["chunk_terms"], "SELECT chunk_id, term, dcount, in_title, in_heading FROM chunk_terms"),
)
def a1(spark, sf):
    return chunk_terms(i.chunks(spark, sf)).withColumn("dcount", F.col("dcount").cast("long"))


@query(
    "A1_query_terms", with_views(["query_terms"], "SELECT query_id, term, qcount FROM query_terms")
)
def a1_queries(spark, sf):
    return query_terms(i.queries(spark, sf)).withColumn("qcount", F.col("qcount").cast("long"))


@query(
    "A2_keyword_score",
    with_views(
        ["keyword_pairs"],
        """SELECT chunk_id, count(*) AS queries, sum(score) AS total, max(score) AS best
           FROM keyword_pairs GROUP BY ALL""",
    ),
)
def a2(spark, sf):
    """Every pair that shares a term, added up per chunk."""
    return keyword_totals(i.queries(spark, sf), i.chunks(spark, sf))


@query(
    "A3_hashed_vectors",
    with_views(
        ["chunk_buckets"],
        """SELECT chunk_id, bucket, CAST(w AS BIGINT) AS weight,
                  round(sqrt(CAST(sum(w * w) OVER (PARTITION BY chunk_id) AS DOUBLE)), 6) AS norm
           FROM chunk_buckets""",
    ),
)
def a3(spark, sf):
    vectors = chunk_vectors(i.chunks(spark, sf), 128)
    return vectors.select(
        "chunk_id", F.round("norm", 6).alias("norm"), F.inline_outer("buckets").alias("bucket", "weight")
    ).select("chunk_id", F.col("bucket").cast("long").alias("bucket"), "weight", "norm").filter("bucket is not null")


@query(
    "P7_invalid_queries",
    f"""SELECT doc_id AS query_id FROM documents WHERE len({i.sql_tokens('text')}) = 0
        UNION ALL SELECT -page_id - 1 FROM pages WHERE len({i.sql_tokens("regexp_replace(url, '[A-Za-z0-9]', '', 'g')")}) = 0""",
)
def p7(spark, sf):
    """Whole texts, and urls without their letters and digits, which no query can be made of."""
    texts = i.load(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text"))
    marks = i.load(spark, sf, "pages").select(
        (-F.col("page_id") - 1).alias("query_id"), F.regexp_replace("url", "[A-Za-z0-9]", "").alias("query_text")
    )
    return invalid_queries(texts.unionByName(marks)).select("query_id")


@query(
    "W3_source_rank",
    with_views(
        ["keyword_pairs"],
        f"""SELECT query_id, source_id, row_number() OVER (PARTITION BY query_id ORDER BY first) AS source_rank
            FROM (SELECT query_id, source_id, min(rank) AS first
                  FROM (SELECT *, {RANK} AS rank FROM keyword_pairs) JOIN chunks USING (chunk_id)
                  WHERE rank <= 10 GROUP BY ALL)""",
    ),
)
def w3(spark, sf):
    found = keyword_search(i.queries(spark, sf), i.chunks(spark, sf), 10)
    return source_ranks(found).withColumn("source_rank", F.col("source_rank").cast("long"))


@query(
    "J2_Y2_dense_search",
    """SELECT query_id, CAST(rank AS BIGINT) AS rank, chunk_id, round(score, 6) AS score
       FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
             FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id,
                          round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS score
                   FROM embeddings q, embeddings c) WHERE score > 0)
       WHERE rank <= 3""",
)
def j2(spark, sf):
    vectors = i.load(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = vectors.withColumnRenamed("chunk_id", "query_id")
    return dense_search(asked, vectors, 3).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score")
    )


# --------------------------------------------------------------------- evaluation


def judged_sql(pairs: str, k: int = 5) -> str:
    """Question results from scored pairs of questions and chunks."""
    return f"""
        SELECT q.question_id, coalesce(retrieved, []) AS retrieved, q.expected_source_ids AS expected, q.forbidden_source_ids AS forbidden,
               list_filter(coalesce(retrieved, []), lambda s: list_contains(q.forbidden_source_ids, s)) AS forbidden_hits,
               list_filter(coalesce(retrieved, []), lambda s: list_contains(q.expected_source_ids, s)) AS good
        FROM questions q LEFT JOIN (
            SELECT query_id AS question_id, list(source_id ORDER BY first) AS retrieved
            FROM (SELECT query_id, source_id, min(rank) AS first
                  FROM (SELECT *, {RANK} AS rank FROM {pairs}) JOIN chunks USING (chunk_id)
                  WHERE rank <= {k} GROUP BY ALL) GROUP BY ALL) USING (question_id)"""


SOP_CHUNKS = f"SELECT * FROM ({i.VIEWS['chunks']}) WHERE source_type = 'sop'"
QUESTION_VIEW = "SELECT question_id AS query_id, query AS query_text FROM questions"
RESULT_SQL = """
    SELECT question_id, array_to_string(retrieved, '|') AS retrieved, len(good) > 0 AS hit,
           CASE WHEN len(good) > 0 THEN round(1.0 / list_position(retrieved, good[1]), 6) ELSE 0.0 END AS reciprocal_rank,
           array_to_string(forbidden_hits, '|') AS forbidden_hits, len(forbidden_hits) = 0 AS passed
    FROM judged"""
METRICS = """count(*) AS total_questions, round(avg(CASE WHEN len(good) > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate_at_k,
    round(avg(CASE WHEN len(good) > 0 THEN 1.0 / list_position(retrieved, good[1]) ELSE 0.0 END), 6) AS mean_reciprocal_rank,
    round(avg(CASE WHEN len(forbidden_hits) = 0 THEN 1.0 ELSE 0.0 END), 6) AS negative_constraint_pass_rate,
    count(*) FILTER (len(good) = 0) AS failed_count, count(*) FILTER (len(forbidden_hits) > 0) AS forbidden_hit_count"""


def judged(body: str, pairs: str = "keyword_pairs") -> str:
    sql = with_views([pairs, "chunks"], "", asked=QUESTION_VIEW, chunks=SOP_CHUNKS)
    return sql.replace("WITH ", f"WITH questions AS ({i.VIEWS['questions']}), ", 1).rstrip() + f",\njudged AS ({judged_sql(pairs)})\n{body}"


def rounded(summary):
    names = ("hit_rate_at_k", "mean_reciprocal_rank", "negative_constraint_pass_rate")
    return summary.withColumns({n: F.round(n, 6) for n in names})


@query("K4_evaluate_questions", judged(RESULT_SQL))
def k4(spark, sf):
    results = ev.evaluate(i.questions(spark, sf), i.chunks(spark, sf), 5)
    return results.select(
        "question_id",
        F.array_join("retrieved_source_ids", "|").alias("retrieved"),
        "hit",
        F.round("reciprocal_rank", 6).alias("reciprocal_rank"),
        F.array_join("forbidden_source_hits", "|").alias("forbidden_hits"),
        F.col("negative_constraints_passed").alias("passed"),
    )


@query("A5_A6_A7_retrieval_metrics", judged(f"SELECT {METRICS} FROM judged"))
def a567(spark, sf):
    return rounded(ev.summarize(ev.evaluate(i.questions(spark, sf), i.chunks(spark, sf), 5)))


@query(
    "A5_A8_merged_parts",
    judged(f"""
    SELECT * FROM (SELECT 'half ' || CAST(question_id AS BIGINT) % 2 AS grouping, {METRICS} FROM judged GROUP BY ALL)
    UNION ALL SELECT 'all', {METRICS} FROM judged"""),
)
def a58_parts(spark, sf):
    """Question results that come in three parts; their states are merged for two groupings."""
    results = ev.evaluate(i.questions(spark, sf), i.chunks(spark, sf), 5)
    number = F.col("question_id").cast("long")
    results = stored(results.withColumn("half", F.concat(F.lit("half "), (number % 2).cast("string"))), "results")
    path = work_folder(spark, "metric-states")
    for part in range(3):
        metric_log.put_part(results.where(number % 3 == part), path, f"part-{part}", ["half"])
    states = metric_log.read_parts(spark, path)
    halves = metric_log.metrics_of(metric_log.merged(states, ["half"])).withColumnRenamed("half", "grouping")
    whole = metric_log.metrics_of(metric_log.merged(states, [])).withColumn("grouping", F.lit("all"))
    return rounded(halves.unionByName(whole))


@query(
    "A8_failures",
    judged("""
    SELECT question_id, 'expected_source_missed' AS failure FROM judged WHERE len(good) = 0
    UNION ALL SELECT question_id, 'forbidden_source_hit' FROM judged WHERE len(forbidden_hits) > 0"""),
)
def a8(spark, sf):
    return metrics.failures(ev.evaluate(i.questions(spark, sf), i.chunks(spark, sf), 5), ["question_id"])


def compared(body: str) -> str:
    views = with_views(
        ["keyword_pairs", "vector_pairs", "hybrid_scored", "chunks"], "", asked=QUESTION_VIEW, chunks=SOP_CHUNKS
    )
    views = views.replace("WITH ", f"WITH questions AS ({i.VIEWS['questions']}), ", 1).rstrip()
    parts = " UNION ALL ".join(
        f"SELECT '{name}' AS retriever, * FROM ({judged_sql(pairs)})"
        for name, pairs in (("keyword", "keyword_pairs"), ("embedding", "vector_pairs"), ("hybrid", "hybrid_scored"))
    )
    return f"{views},\njudged AS MATERIALIZED ({parts})\n{body}"


@query("K5_A9_compare_retrievers", compared(f"SELECT retriever, {METRICS} FROM judged GROUP BY ALL"))
def k5(spark, sf):
    results = ev.compare(ev.RETRIEVERS, i.questions(spark, sf), i.chunks(spark, sf), 5, index=term_index(spark, sf))
    return rounded(ev.comparison(results)["summary"])


@query(
    "A9_best_retrievers",
    compared(f"""
    SELECT 'hit_rate_at_k' AS metric, retriever, value FROM (
        SELECT retriever, hit_rate_at_k AS value, rank() OVER (ORDER BY hit_rate_at_k DESC) AS r FROM (SELECT retriever, {METRICS} FROM judged GROUP BY ALL)) WHERE r = 1
    UNION ALL
    SELECT 'mean_reciprocal_rank', retriever, value FROM (
        SELECT retriever, mean_reciprocal_rank AS value, rank() OVER (ORDER BY mean_reciprocal_rank DESC) AS r FROM (SELECT retriever, {METRICS} FROM judged GROUP BY ALL)) WHERE r = 1"""),
)
def a9(spark, sf):
    results = ev.compare(ev.RETRIEVERS, i.questions(spark, sf), i.chunks(spark, sf), 5, index=term_index(spark, sf))
    return ev.comparison(results)["best"].withColumn("value", F.round("value", 6))


@query(
    "J9_failure_difference",
    compared("""
    SELECT question_id, 'keyword' AS failed_only_by FROM judged WHERE retriever = 'keyword' AND len(good) = 0
        AND question_id NOT IN (SELECT question_id FROM judged WHERE retriever = 'embedding' AND len(good) = 0)
    UNION ALL
    SELECT question_id, 'embedding' FROM judged WHERE retriever = 'embedding' AND len(good) = 0
        AND question_id NOT IN (SELECT question_id FROM judged WHERE retriever = 'keyword' AND len(good) = 0)"""),
)
def j9(spark, sf):
    two = {n: ev.RETRIEVERS[n] for n in ("keyword", "embedding")}
    results = ev.compare(two, i.questions(spark, sf), i.chunks(spark, sf), 5)
    return metrics.failure_difference(results, "keyword", "embedding")


@query(
    "J10_unknown_sources",
    f"""WITH questions AS ({i.VIEWS['questions']})
        SELECT question_id, source_id FROM (
            SELECT DISTINCT question_id, unnest(list_concat(expected_source_ids, forbidden_source_ids)) AS source_id FROM questions)
        WHERE source_id NOT IN (SELECT source FROM documents)
        UNION ALL SELECT question_id, 'src-' || question_id FROM questions""",
)
def j10(spark, sf):
    """Each question also names a source of its own, which no document has."""
    known = i.load(spark, sf, "documents").select(F.col("source").alias("source_id"))
    own = F.array(F.concat(F.lit("src-"), "question_id"))
    asked = i.questions(spark, sf).withColumn("forbidden_source_ids", F.concat("forbidden_source_ids", own))
    return metrics.unknown_sources(asked, known).select("question_id", "source_id")


@query(
    "J10_split_overlap",
    "SELECT doc_id AS question_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def j10_overlap(spark, sf):
    ids = lambda name: i.load(spark, sf, name).select(F.col("doc_id").alias("question_id"))
    return metrics.split_overlap(ids("documents"), ids("labels"))


@query(
    "W1_T1_top_k_per_source",
    """SELECT source, doc_id, n_chars, rank FROM (
           SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
       WHERE rank <= 3""",
)
def w1(spark, sf):
    docs = i.load(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return top_k(docs, 3, "source", "n_chars", "doc_id").withColumn("rank", F.col("rank").cast("long"))


@query("Y1_custom_retriever", judged(RESULT_SQL, "vector_pairs"))
def y1(spark, sf):
    def retriever(asked, pool, k, source_type):
        return vector_search(asked, pool, k, source_type, dims=128)

    results = ev.evaluate(i.questions(spark, sf), i.chunks(spark, sf), 5, retriever)
    return results.select(
        "question_id",
        F.array_join("retrieved_source_ids", "|").alias("retrieved"),
        "hit",
        F.round("reciprocal_rank", 6).alias("reciprocal_rank"),
        F.array_join("forbidden_source_hits", "|").alias("forbidden_hits"),
        F.col("negative_constraints_passed").alias("passed"),
    )
