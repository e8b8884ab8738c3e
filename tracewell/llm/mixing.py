"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source shuffles its documents by a hash of the id. A document's virtual finish time is the number of
words its source has sent up to it, over all passes, divided by the source's target. All entries are
ranked by finish time and the mix ends where the total budget is used up.

The hot source is no single task: running sums are taken in two steps, first over buckets of the hash (few
numbers per source), then inside a bucket. The texts themselves never move: the cut is one key per source.

Defined cases: a null text has size 0; a null source is a source of its own, ranked last; a null id sorts
first; rows with the same source and id are taken or left together; sources without words have target 0
and send nothing; a very long text is one document and is taken or left whole; an empty table gives an empty
result. Input columns named like the added ones are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.llm.common import broadcast_if_bounded, stored, words_of

ROWS_PER_BUCKET = 2_000
HASH_BITS = 60


def shuffle_key(doc_id: Column) -> Column:
    """60 bits of the md5 of the id as text."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, n_docs, source_size, rank, target for a table (source, size).

    Sources get ``share`` of all words by weight; a target stops at ``most`` times its source's size and
    the excess goes to the others by weight. Sorted by size over weight, the stopped sources are a prefix,
    so the common level follows from running sums over one row per source.
    """
    sources = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("rank", F.row_number().over(by_name))
    weight = reduce(
        lambda out, k: F.when((F.col("rank") - 1) % len(weights) == k, F.lit(weights[k])).otherwise(out),
        range(1, len(weights)),
        F.lit(weights[0]),
    )
    sources = sources.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * most)
    ratio = F.col("most") / F.col("weight")
    before = Window.orderBy(ratio, "rank").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(ratio, "rank").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum(
        "weight"
    ).over(onward)
    sources = sources.withColumn("level", level).withColumn("ratio", ratio)
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))
    sources = sources.withColumn("level", F.min(fits).over(everything)["level"])
    return sources.select(
        "source", "n_docs", "source_size", "rank", F.least(F.col("level") * F.col("weight"), F.col("most").cast("double")).alias("target")
    )


def _finish_times(rows: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """One entry per document and pass with its virtual finish time."""
    bits = F.ceil(F.log2(F.greatest(F.col("n_docs") / ROWS_PER_BUCKET, F.lit(1.0)))).cast("int")
    rows = rows.join(broadcast_if_bounded(sources.where("target > 0")), rows.source.eqNullSafe(sources.source)).drop(
        sources.source
    )
    bucket = F.floor(F.col("key") / F.pow(F.lit(2.0), F.lit(HASH_BITS) - bits)).cast("long")
    rows = rows.withColumn("bucket", bucket)
    totals = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "rank", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("rank", "bucket").orderBy("key", F.col("doc_id").asc_nulls_first())
    rows = rows.join(totals, ["rank", "bucket"]).withColumn("sent", F.col("offset") + F.sum("size").over(inside))
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    finish = (F.col("pass") * F.col("source_size") + F.col("sent")) / F.col("target")
    return rows.select("rank", "key", "doc_id", "pass", "size", finish.alias("finish"))


def mix_table(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """(sizes, sources): the measured documents and one row per source with target and cut.

    The cut is the last entry that the mix takes from the source: cut_pass, cut_key, cut_id.
    """
    sizes = stored(
        docs.select("doc_id", "source", words_of(F.col("text")).alias("size"), shuffle_key(F.col("doc_id")).alias("key")),
        "mix-sizes",
    )
    sources = stored(source_targets(sizes, weights, share, most), "mix-sources")
    rows = sizes.groupBy("source", "key", "doc_id").agg(F.sum("size").alias("size"))
    entries = stored(_finish_times(rows, sources, most), "mix-entries")
    n_rows, budget = sources.agg(F.sum("n_docs"), F.sum("source_size") * share).first()
    budget = budget or 0.0
    # Range sort by finish time: buckets of equal width hold about equal numbers of words.
    width = F.floor(F.col("finish") * max(64, (n_rows or 0) // ROWS_PER_BUCKET)).cast("long")
    entries = entries.withColumn("slot", width)
    slots = entries.groupBy("slot").agg(F.sum("size").alias("words"))
    slots = slots.withColumn("ends", F.sum("words").over(Window.orderBy("slot")))
    last = slots.where(F.col("ends") > budget).orderBy("slot").select("slot", F.col("ends") - F.col("words")).first()
    slot, used = last if last else (None, 0)
    if slot is None:
        taken = entries
    else:
        # Within a source this is the order of the cut, so that texts without words cannot move it.
        order = Window.orderBy("finish", "rank", "pass", "key", F.col("doc_id").asc_nulls_first())
        edge = entries.where(F.col("slot") == slot).withColumn("upto", F.sum("size").over(order) + used)
        taken = entries.where(F.col("slot") < slot).unionByName(edge.where(F.col("upto") <= budget).drop("upto"))
    cuts = taken.groupBy("rank").agg(F.max(F.struct("pass", "key", "doc_id")).alias("cut"))
    sources = sources.join(cuts, "rank", "left").select(
        "source", "rank", "source_size", "target",
        F.col("cut.pass").alias("cut_pass"), F.col("cut.key").alias("cut_key"), F.col("cut.doc_id").alias("cut_id"),
    )
    return sizes, stored(sources, "mix-cuts")


def _apply(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds source_size, target, passes and taken to rows with source, key, doc_id and size."""
    named = sources.withColumnRenamed("source", "mix_source")
    out = rows.join(broadcast_if_bounded(named), rows.source.eqNullSafe(F.col("mix_source")), "left").drop("mix_source")
    ident, cut = F.coalesce(F.col("doc_id"), F.lit(-(2**63))), F.coalesce(F.col("cut_id"), F.lit(-(2**63)))
    within = (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (ident <= cut))
    passes = F.when(F.col("cut_pass").isNull(), F.lit(0)).otherwise(F.col("cut_pass") + within.cast("int"))
    out = out.withColumn("passes", passes.cast("int"))
    return out.withColumn("taken", F.col("passes") * F.col("size")).drop("cut_pass", "cut_key", "cut_id", "rank")


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """``docs`` with size, source_size, target, passes (times the mix holds the row) and taken (words)."""
    added = ["size", "key", "source_size", "target", "passes", "taken", "rank"]
    rows = docs.drop(*added, "cut_pass", "cut_key", "cut_id", "mix_source")
    _, sources = mix_table(rows, weights, share, most)
    rows = rows.withColumns({"size": words_of(F.col("text")), "key": shuffle_key(F.col("doc_id"))})
    return _apply(rows, sources).drop("key")


def mixed_documents(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it, with the columns of ``docs``."""
    _, sources = mix_table(docs, weights, share, most)
    named = docs.select("doc_id", "source", F.struct(*docs.columns).alias("row"))
    rows = named.withColumns({"size": F.lit(0).cast("long"), "key": shuffle_key(F.col("doc_id"))})
    rows = _apply(rows, sources).where("passes > 0")
    return rows.withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("passes")))).select("row.*")


def mix_sizes(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """The decisions alone, from the measured sizes: doc_id, size, source_size, target, passes, taken."""
    sizes, sources = mix_table(docs, weights, share, most)
    return _apply(sizes, sources).select("doc_id", "size", "source_size", "target", "passes", "taken")
