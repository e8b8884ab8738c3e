"""Keyword, vector and hybrid search of many queries over many chunks.

Plan shape, the same for all scorers and sizes:

1. chunk side: distinct terms and buckets are counted inside each chunk row, without a shuffle
   (``terms.chunk_features``; a stored feature table skips this step);
2. the query features are written once and cut into blocks whose measured size fits a broadcast and
   whose k results per query fit a task;
3. blocks run one after the other: a block is shipped as arrays, every task scores its batches of chunks
   against it and returns k rows per query once, the rows are written, the broadcast is released;
4. only those rows are shuffled for the final rank, and the winners are joined back to the chunks.

Sums over all candidates (``candidate_totals``, ``keyword_totals``) run the same blocks; the kernel adds them up
and returns one row per query and task, or per chunk and block, which Spark groups.

No step groups by a term or any other value of the data, so a term held by a third of all chunks
is spread over all tasks, and query-chunk pairs never become rows.
"""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tracewell.operators.kernel import GROUPED_QUERIES, QueryBlock, collect_block, collect_vectors, floors, scorer, totals
from tracewell.operators.rank_join import joined_ranks, list_length
from tracewell.operators.ranking import check_top_k, hybrid_weights, top_k
from tracewell.operators.terms import chunk_features, invalid_queries, query_features
from tracewell.session import BROADCAST_BYTES, broadcast_if_bounded, measured, prepare, stored, work_folder

CHUNK_KEYS = ["chunk_id", "source_id", "source_type"]
# What the best rows of one block may take in a task: k rows per query, none larger than its query.
STATE_BYTES = 256 << 20
# Chunks with the most terms that give many queries their first floors: at most so many, with so many term entries.
HEAD_CHUNKS = 2048
HEAD_ENTRIES = 1_500_000


def _by_source(chunks: DataFrame, source_type: str | None) -> DataFrame:
    return chunks if source_type is None else chunks.filter(F.col("source_type") == source_type)


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def best_rows(
    asked: DataFrame, features: DataFrame, mode: str, k: int, dims: int = 0, weights: tuple[float, float] = (1.0, 0.0)
) -> DataFrame:
    """The k best rows per query and task over all blocks of ``asked``, written to the work folder.

    ``asked`` and ``features`` come from ``query_features`` and ``chunk_features``.
    """
    spark = asked.sparkSession
    prepare(spark)
    q, c = _type(asked, "query_id"), _type(features, "chunk_id")
    schema = f"query_id {q}, chunk_id {c}, score double, matched_terms array<string>"
    if mode == "hybrid":
        schema += ", keyword_score double, vector_score double"
    asked = stored(asked, "asked")
    rows, size = measured(asked)
    kept = 2 * list_length(k) if mode == "hybrid" else k
    if mode == "keyword" and rows >= GROUPED_QUERIES:
        features = stored(features, "features")
        asked = stored(_with_floors(asked, features, k), "floors")
        # Terms are held as numbers of a third of their measured size or less.
        kept = k / 3
    blocks = max(1, ceil(size / BROADCAST_BYTES), ceil(size * kept / STATE_BYTES))
    # A hybrid search may read them twice; those for many queries are stored.
    if mode == "hybrid" or (blocks > 1 and "floor" not in asked.columns):
        features = stored(features, "features")
    number = F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.lit(blocks))
    collect = collect_block if "terms" in asked.columns else collect_vectors
    path = work_folder(spark, "best")
    spark.createDataFrame([], schema).write.parquet(path)

    def run(block: QueryBlock, mode: str, k: int, to: str, schema: str) -> None:
        shipped = spark.sparkContext.broadcast(block)
        features.mapInArrow(scorer(shipped, mode, k, weights), schema).write.mode("append").parquet(to)
        shipped.destroy()

    for b in range(blocks):
        some = asked.filter(number == b)
        block = collect(some, dims)
        if not len(block.ids):
            continue
        if mode != "hybrid":
            run(block, mode, k, path, schema)
            continue
        n, lists = list_length(k), work_folder(spark, "lists")
        run(block, "lists", n, lists, f"{schema}, list int")
        best, known = joined_ranks(spark.read.schema(f"{schema}, list int").parquet(lists), k, n, weights)
        known = stored(known, "normalisers")
        best.join(known.where("certain").select("query_id"), "query_id").select(
            *spark.read.schema(schema).parquet(path).columns
        ).write.mode("append").parquet(path)
        # Queries whose lists do not decide: all sums, with the normalisers that the first pass has found.
        open_ = {r[0]: (r[1], r[2]) for r in known.where("not certain").select("query_id", "best_keyword", "best_vector").collect()}
        if open_:
            block = collect(some.join(known.where("not certain").select("query_id"), "query_id", "left_semi"), dims)
            block.tops = np.array([open_[i] for i in block.ids.to_pylist()])
            run(block, "hybrid", k, path, schema)
    return spark.read.schema(schema).parquet(path)


def _with_floors(asked: DataFrame, features: DataFrame, k: int) -> DataFrame:
    """``asked`` with ``floor``: the k-th best score among the chunks with the most terms, which the k best of all reach."""
    spark = asked.sparkSession
    size = F.size("terms")
    sizes = [r[0] for r in features.select(size.alias("n")).where("n > 0").orderBy(F.desc("n")).limit(HEAD_CHUNKS).collect()]
    count = max(1, int(np.searchsorted(np.cumsum(sizes), HEAD_ENTRIES, "right")))
    head = features.where(size >= (sizes[:count] or [1])[-1]).limit(count).select("terms").toArrow().combine_chunks()
    # Places as ids: the floors need no others.
    head = head.add_column(0, "chunk_id", [np.arange(head.num_rows)])
    batches = head.to_batches()
    if not batches:
        return asked.withColumn("floor", F.lit(0.0))
    shipped = spark.sparkContext.broadcast(batches[0])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields)
    return asked.mapInArrow(floors(shipped, k), f"{kinds}, floor double")


def _added_up(asked: DataFrame, features: DataFrame, by: str, columns: str, dims: int = 0) -> DataFrame:
    """The rows of ``kernel.totals`` over all blocks of ``asked``, written to the work folder."""
    spark = asked.sparkSession
    prepare(spark)
    key, side = ("query_id", asked) if by == "query" else ("chunk_id", features)
    schema = f"{key} {_type(side, key)}, {columns}"
    asked = stored(asked, "asked")
    _, size = measured(asked)
    blocks = max(1, ceil(size / BROADCAST_BYTES))
    if blocks > 1:
        features = stored(features, "features")
    number = F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.lit(blocks))
    collect = collect_block if "terms" in asked.columns else collect_vectors
    path = work_folder(spark, "totals")
    spark.createDataFrame([], schema).write.parquet(path)
    for b in range(blocks):
        block = collect(asked.filter(number == b), dims)
        if not len(block.ids):
            continue
        shipped = spark.sparkContext.broadcast(block)
        features.mapInArrow(totals(shipped, by), schema).write.mode("append").parquet(path)
        shipped.destroy()
    return spark.read.schema(schema).parquet(path)


def candidate_totals(
    queries: DataFrame,
    chunks: DataFrame,
    source_type: str | None = None,
    dims: int = 128,
    index: DataFrame | None = None,
    buckets: DataFrame | None = None,
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
) -> DataFrame:
    """query_id, candidates, best_keyword, best_vector, keyword_total, vector_total of each query with a candidate.

    All candidates of ``hybrid_search`` count, the chunks with either score; the bests are its normalisers.
    """
    asked, features, dims = _features(queries, chunks, dims, index, buckets, vectors, query_vectors)
    columns = "candidates long, best_keyword double, best_vector double, keyword_total double, vector_total double"
    found = _added_up(asked, _by_source(features, source_type), "query", columns, dims)
    return found.groupBy("query_id").agg(
        F.sum("candidates").alias("candidates"),
        *(F.max(c).alias(c) for c in ("best_keyword", "best_vector")),
        *(F.sum(c).alias(c) for c in ("keyword_total", "vector_total")),
    )


def keyword_totals(
    queries: DataFrame, chunks: DataFrame, source_type: str | None = None, index: DataFrame | None = None
) -> DataFrame:
    """chunk_id, queries, total, best: over all queries that share a term with the chunk."""
    features = chunk_features(_by_source(chunks, source_type)) if index is None else _by_source(index, source_type)
    columns = "queries long, total double, best double"
    found = _added_up(query_features(queries), features.select("chunk_id", "terms"), "chunk", columns)
    return found.groupBy("chunk_id").agg(
        F.sum("queries").alias("queries"), F.sum("total").alias("total"), F.max("best").alias("best")
    )


def keyword_winners(
    queries: DataFrame, chunks: DataFrame, k: int = 5, source_type: str | None = None, index: DataFrame | None = None
) -> DataFrame:
    """query_id, rank, chunk_id, score, matched_terms of ``keyword_search``, without the chunk columns."""
    check_top_k(k)
    features = chunk_features(_by_source(chunks, source_type)) if index is None else _by_source(index, source_type)
    return top_k(best_rows(query_features(queries), features.select("chunk_id", "terms"), "keyword", k), k)


def keyword_search(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 5,
    source_type: str | None = None,
    index: DataFrame | None = None,
    strict: bool = False,
) -> DataFrame:
    """Top-k chunks per query by keyword score.

    ``queries``: query_id, query_text.  ``chunks``: the chunk columns.  ``index``: stored chunk features
    (see ``sources.chunks.write_term_index``) that replace tokenizing.
    """
    _require_valid(queries, strict)
    return attach_chunks(keyword_winners(queries, chunks, k, source_type, index), _by_source(chunks, source_type))


def _features(
    queries: DataFrame, chunks: DataFrame, dims: int, index: DataFrame | None, buckets: DataFrame | None,
    vectors: DataFrame | None, query_vectors: DataFrame | None,
) -> tuple[DataFrame, DataFrame, int]:
    """(asked, features, dims) for a scorer that uses vectors."""
    if (vectors is None) != (query_vectors is None):
        raise ValueError("supplied vectors are needed for chunks and queries")
    if vectors is not None:
        dims = vector_width(query_vectors, vectors)
    elif dims < 1:
        raise ValueError("dimensions must be at least 1")
    features = chunk_features(chunks, dims, buckets, vectors) if index is None else index
    return query_features(queries, dims, buckets, query_vectors), features, dims


def vector_width(*tables: DataFrame) -> int:
    """The common length of all vectors; 1 where there are none."""
    widths: set[int] = set()
    for table in tables:
        low, high = table.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
        widths |= {w for w in (low, high) if w is not None and w >= 0}
    if len(widths) > 1:
        raise ValueError("vectors must have the same dimensions")
    return max(1, *widths, 1)


def vector_search(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 5,
    source_type: str | None = None,
    dims: int = 128,
    strict: bool = False,
    index: DataFrame | None = None,
    buckets: DataFrame | None = None,
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
) -> DataFrame:
    """Top-k chunks per query by cosine of hashed token counts.

    ``buckets`` (term, bucket) replaces the default hash, ``vectors`` (chunk_id, vector) with
    ``query_vectors`` (query_id, vector) replaces the counts by the vectors of a model.  ``index``: stored chunk
    features made with the same choices.
    """
    check_top_k(k)
    asked, features, dims = _features(queries, chunks, dims, index, buckets, vectors, query_vectors)
    _require_valid(queries, strict)
    best = best_rows(asked, _by_source(features, source_type), "vector", k, dims)
    return attach_chunks(top_k(best, k), _by_source(chunks, source_type))


def hybrid_search(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 5,
    source_type: str | None = None,
    dims: int = 128,
    keyword_weight: float = 0.65,
    vector_weight: float = 0.35,
    strict: bool = False,
    index: DataFrame | None = None,
    buckets: DataFrame | None = None,
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
) -> DataFrame:
    """Top-k chunks per query by the weighted sum of normalised keyword and vector scores.

    A chunk with either score is a candidate.  The other arguments are those of ``vector_search``.
    """
    check_top_k(k)
    weights = hybrid_weights(keyword_weight, vector_weight)
    asked, features, dims = _features(queries, chunks, dims, index, buckets, vectors, query_vectors)
    _require_valid(queries, strict)
    best = best_rows(asked, _by_source(features, source_type), "hybrid", k, dims, weights)
    return attach_chunks(top_k(best, k), _by_source(chunks, source_type))


def _require_valid(queries: DataFrame, strict: bool) -> None:
    if strict and invalid_queries(queries).limit(1).count():
        raise ValueError("query must contain at least one searchable term")


def attach_chunks(best: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add the chunk columns to the winning rows; only the columns that are used later are read.

    The winners are broadcast where they were measured to fit, otherwise both sides are shuffled.
    """
    first = ["query_id", "rank", "chunk_id", "score", "matched_terms"]
    extra = [c for c in best.columns if c not in first]
    carried = [c for c in chunks.columns if c not in ("chunk_id", *first, *extra)]
    return chunks.select("chunk_id", *carried).join(broadcast_if_bounded(best), "chunk_id").select(*first, *extra, *carried)
