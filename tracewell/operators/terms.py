"""Term and bucket tables of queries and chunks.

Each is computed inside the row that holds the text, so no shuffle is needed to count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions.counting import weighted_terms_of
from tracewell.functions.hashing import md5_bucket
from tracewell.functions.runs import run_starts, with_counts
from tracewell.functions.text import tokens


def scoring_text() -> Column:
    """Title, heading and text of a chunk as one string."""
    return F.concat_ws(" ", "source_title", "section_heading", "text")


def count_terms(df: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """``keep`` columns plus ``terms``: array of (term, cnt) of ``text``."""
    base = df.select(*keep, tokens(text).alias("_tokens"))
    return with_counts(base, "_tokens", "terms", "term", "cnt").drop("_tokens")


def rows_of(df: DataFrame, items: Column | str, keep: list[str], names: list[str]) -> DataFrame:
    """One row per struct of array ``items``.

    The outer form plus a null check is used on purpose: for the plain form the optimizer infers
    a size filter on the array and pushes its whole expression below, which would compute the
    array a second time, inside its own lambdas.
    """
    exploded = df.select(*keep, F.inline_outer(items).alias(*names))
    return exploded.filter(F.col(names[0]).isNotNull())


def query_terms(queries: DataFrame) -> DataFrame:
    """One row per query and distinct term: (query_id, term, qcount)."""
    counted = count_terms(queries, F.col("query_text"), ["query_id"])
    return rows_of(counted, "terms", ["query_id"], ["term", "qcount"])


def invalid_queries(queries: DataFrame) -> DataFrame:
    """Queries without a single searchable term."""
    return queries.filter(F.size(tokens(F.col("query_text"))) == 0)


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """One row per chunk and distinct term, with title and heading membership."""
    keep = ["chunk_id", "_title", "_heading"]
    base = chunks.withColumns(
        {
            "_title": tokens(F.col("source_title")),
            "_heading": tokens(F.col("section_heading")),
        }
    )
    counted = count_terms(base, scoring_text(), keep)
    return rows_of(counted, "terms", keep, ["term", "dcount"]).select(
        "chunk_id",
        "term",
        "dcount",
        F.array_contains("_title", F.col("term")).alias("in_title"),
        F.array_contains("_heading", F.col("term")).alias("in_heading"),
    )


def with_buckets(counted: DataFrame, dims: int) -> DataFrame:
    """Turn ``terms`` into ``buckets``: array of (bucket, weight), and ``norm``.

    The bucket of a term is computed once per distinct term of the row; weights are integer
    token counts, so dot products and squared norms are exact.
    """
    pairs = F.sort_array(
        F.transform(
            "terms",
            lambda t: F.struct(md5_bucket(t["term"], dims).alias("bucket"), t["cnt"].alias("cnt")),
        )
    )
    return (
        counted.withColumn("_pairs", pairs)
        .withColumn("_keys", F.transform("_pairs", lambda p: p["bucket"]))
        .withColumn("_starts", run_starts(F.col("_keys")))
        .withColumn(
            "buckets",
            F.transform(
                "_starts",
                lambda p, j: F.struct(
                    F.get("_pairs", p - 1)["bucket"].alias("bucket"),
                    F.aggregate(
                        F.slice(
                            "_pairs",
                            p,
                            F.coalesce(F.get("_starts", j + 1), F.size("_pairs") + 1) - p,
                        ),
                        F.lit(0).cast("long"),
                        lambda acc, e: acc + e["cnt"],
                    ).alias("weight"),
                ),
            ),
        )
        .withColumn(
            "norm",
            F.sqrt(
                F.aggregate(
                    "buckets",
                    F.lit(0).cast("long"),
                    lambda acc, b: acc + b["weight"] * b["weight"],
                ).cast("double")
            ),
        )
        .drop("_pairs", "_keys", "_starts", "terms")
    )


def weighted_terms() -> Column:
    """Terms of a chunk row with their capped count and their title and heading bonus."""
    return F.transform(
        "terms",
        lambda t: F.struct(
            t["term"].alias("term"),
            F.least(t["cnt"], F.lit(3)).cast("double").alias("weight"),
            (
                F.when(F.array_contains("_title", t["term"]), 2.0).otherwise(0.0)
                + F.when(F.array_contains("_heading", t["term"]), 1.0).otherwise(0.0)
            ).alias("bonus"),
        ),
    )


def _bucketed(counted: DataFrame, keep: list[str], dims: int, buckets: DataFrame | None) -> DataFrame:
    """``keep`` columns plus buckets and norm of ``terms``: hashed in the row, or by a (term, bucket) table.

    A term without a row in the table has no bucket.
    """
    if buckets is None:
        return with_buckets(counted.select(*keep, "terms"), dims)
    rows = rows_of(counted, "terms", [keep[0]], ["term", "cnt"]).join(buckets.select("term", "bucket"), "term")
    sums = rows.groupBy(keep[0], "bucket").agg(F.sum(F.col("cnt").cast("long")).alias("weight"))
    lists = sums.groupBy(keep[0]).agg(F.array_sort(F.collect_list(F.struct("bucket", "weight"))).alias("buckets"))
    none = F.array().cast("array<struct<bucket:int,weight:bigint>>")
    return (
        counted.select(*keep)
        .join(lists, keep[0], "left")
        .withColumn("buckets", F.coalesce("buckets", none))
        .withColumn("norm", F.sqrt(F.aggregate("buckets", F.lit(0.0), lambda s, b: s + b["weight"] * b["weight"])))
    )


def chunk_features(
    chunks: DataFrame, dims: int = 0, buckets: DataFrame | None = None, vectors: DataFrame | None = None
) -> DataFrame:
    """What the scorers read of each chunk: chunk_id, source_type, terms (term, weight, bonus).

    Terms alone are counted batch by batch. With ``dims`` also buckets and norm; with ``vectors`` (chunk_id, vector) that vector instead, null
    for chunks without one.  Stored once, it serves every later search without tokenizing.
    """
    keep = ["chunk_id", *(c for c in ("source_type",) if c in chunks.columns)]
    if vectors is not None:
        # The texts meet their vectors: the counted terms of a text take several times its room in a shuffle.
        wide = vectors.select("chunk_id", F.col("vector").cast("array<double>").alias("vector"))
        chunks = chunks.select(*keep, "source_title", "section_heading", "text").join(wide, "chunk_id", "left")
        counted_keep = [*keep, "vector"]
    else:
        counted_keep = keep
    if vectors is None and not dims:
        return weighted_terms_of(chunks, keep, "source_title", "section_heading", "text")
    base = chunks.withColumns({"_title": tokens(F.col("source_title")), "_heading": tokens(F.col("section_heading"))})
    counted = count_terms(base, scoring_text(), [*counted_keep, "_title", "_heading"])
    if vectors is not None:
        return counted.select(*keep, weighted_terms().alias("terms"), "vector")
    kept = counted.withColumn("_kept", weighted_terms())
    return _bucketed(kept, [*keep, "_kept"], dims, buckets).withColumnRenamed("_kept", "terms")


def query_features(
    queries: DataFrame, dims: int = 0, buckets: DataFrame | None = None, vectors: DataFrame | None = None
) -> DataFrame:
    """The same of each query: query_id, terms (term, cnt) and buckets or vector."""
    counted = count_terms(queries, F.col("query_text"), ["query_id"])
    if vectors is not None:
        wide = vectors.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        return counted.join(wide, "query_id", "left")
    if not dims:
        return counted
    kept = counted.withColumn("_kept", F.col("terms"))
    return _bucketed(kept, ["query_id", "_kept"], dims, buckets).withColumnRenamed("_kept", "terms")


def chunk_vectors(chunks: DataFrame, dims: int) -> DataFrame:
    """(chunk_id, norm, buckets) of every chunk."""
    return with_buckets(count_terms(chunks, scoring_text(), ["chunk_id"]), dims)
