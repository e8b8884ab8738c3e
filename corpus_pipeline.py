"""A training corpus from raw documents: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's documents. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.llm import bpe, jaccard, linededup, mixing, toxicity
from tracewell.llm.common import broadcast_if_bounded, stored, table
from tracewell.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold; learnt from the labelled ones among them."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).where("toxic_predicted = 0").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that another document with a smaller id holds; n_chars follows the text."""
    kept = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts, that with the smallest id.

    Rows that agree in id and text become one. Rows with one id and different texts count as one document: they all
    stay, or all go when any of their texts is similar to that of a smaller id. Rows with a null id all stay.
    """
    found = jaccard.jaccard_components(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    rest = docs.join(broadcast_if_bounded(found), docs.doc_id == F.col("gone"), "left_anti")
    repeated = rest.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    repeated = stored(repeated.select(F.col("doc_id").alias("again")), "repeated-ids")
    again = broadcast_if_bounded(repeated)
    single = rest.join(again, rest.doc_id == F.col("again"), "left_anti")
    several = rest.join(again, rest.doc_id == F.col("again"), "left_semi")
    first = several.groupBy("doc_id", "text").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return single.unionByName(first).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with the digest of the bytes that they decode to."""
    tokens = bpe.round_trip(docs.select("doc_id", "source", "lang", "text"), vocabulary())
    return tokens.select(
        "doc_id", "source", "lang", "n_tokens", "token_bytes",
        F.sha2("token_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("source_mix", mix_sources),
    ("byte_bpe", tokenize),
]

# Compression lengths and hash trees have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
