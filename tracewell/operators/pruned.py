"""Keyword search over impact-ordered posting blocks: blocks that cannot reach a query's floor are not read.

Index: chunks are sorted by the largest score that they can give (the sum of their weights and bonuses) and cut
into ranges of ``RANGE`` neighbours, so that the first ranges hold the high scores of all terms together. The
postings of a term in a range are one block with its largest weight and bonus. A row holds the blocks of a term in a span
of ``SPAN`` chunks and the largest of their values; the task that sorts the chunks of a span packs its rows, so postings
are no rows of their own and nothing is shuffled but the chunks.

Search, for all queries together, as joins on (term, range) and grouped sums:

1. the sum of a query's block maxima bounds the score of every chunk of a range, first over spans;
2. the postings of the ranges with the highest bounds give scores, and their k-th is the query's floor;
3. spans, then ranges, whose bound does not reach the floor are left out; the others' postings are read.

Only bounds (one row per query and span, and per query and range of the spans that are left) and the postings of
the blocks that are read become rows. A term that a third of all chunks hold has its postings in as many blocks as
there are ranges, none larger than ``RANGE``. Scores, ties and matched terms are those of ``keyword_search``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewell.operators.ranking import check_top_k, top_k
from tracewell.operators.terms import chunk_features, query_features, rows_of
from tracewell.session import broadcast_if_bounded, prepare, stored

# Powers of two: a range is named by the place of its first chunk, a span by that of its first range.
RANGE = 16
SPAN = 64 * RANGE
# Spans and ranges with the highest bounds that give a query its first floor, besides those that k chunks fill.
TRIED_SPANS = 8
TRIED = 8


def _first_of(place: Column, width: int) -> Column:
    return place - F.pmod(place, F.lit(width))


def write_impact_index(chunks: DataFrame, path: str, features: DataFrame | None = None, ranges: int | None = None) -> None:
    """Store the blocks with the span maxima of ``chunks`` (or of stored chunk features) below ``path``.

    ``ranges`` is the number of sorted output parts, by default that of the session's shuffles.
    """
    features = chunk_features(chunks) if features is None else features
    spark = features.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = F.col("source_type") if "source_type" in features.columns else F.lit(None).cast("string")
    impact = F.aggregate("terms", F.lit(0.0), lambda s, t: s + t["weight"] + t["bonus"])
    sized = stored(features.select("chunk_id", kind.alias("source_type"), "terms", impact.alias("impact")), "impacts")
    order = [F.col("impact").desc(), F.col("chunk_id")]
    placed = sized.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("impact")
    kind = placed.schema["chunk_id"].dataType.simpleString()
    prepare(spark)
    blocks = placed.mapInArrow(
        _packed(RANGE, SPAN),
        "source_type string, term string, span long, most_weight double, most_bonus double,"
        " ranges array<struct<range:long,most_weight:double,most_bonus:double>>,"
        f" postings array<array<struct<chunk_id:{kind},weight:double,bonus:double>>>",
    )
    blocks.write.parquet(f"{path}/blocks")


def _packed(width: int, span: int):
    """Function for ``mapInArrow`` over sorted chunks: a row for each source type and term of a span, with its blocks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, size = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            while size >= span:
                whole = pa.Table.from_batches(held)
                yield _span_rows(whole.slice(0, span), place, width)
                held = whole.slice(span).to_batches()
                place, size = place + span, size - span
        if size:
            yield _span_rows(pa.Table.from_batches(held), place, width)

    return pack


def _span_rows(chunks: pa.Table, place: int, width: int) -> pa.RecordBatch:
    """The postings of neighbouring chunks, the first of them at ``place``, by source type, term and range."""
    batch = chunks.combine_chunks().to_batches()[0]
    terms, kinds = batch.column("terms"), batch.column("source_type").dictionary_encode(null_encoding="encode")
    items, row = terms.flatten(), pc.list_parent_indices(terms).to_numpy()
    coded = items.field("term").dictionary_encode()
    names = coded.dictionary
    key = kinds.indices.to_numpy()[row].astype(np.int64) * max(1, len(names)) + coded.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    weight, bonus = (items.field(f).to_numpy()[order] for f in ("weight", "bonus"))
    new = np.diff(key, prepend=-1) != 0
    at = row // width
    first = np.flatnonzero(new | (np.diff(at, prepend=-1) != 0))
    term = np.flatnonzero(new)
    most = [np.maximum.reduceat(v, first) if len(first) else v for v in (weight, bonus)]
    group = np.searchsorted(first, term)
    lists = pa.array(np.append(group, len(first)).astype(np.int32))
    ranges = pa.StructArray.from_arrays([pa.array(place + at[first] * width), *map(pa.array, most)], ["range", "most_weight", "most_bonus"])
    postings = pa.StructArray.from_arrays(
        [batch.column("chunk_id").take(pa.array(row)), pa.array(weight), pa.array(bonus)], ["chunk_id", "weight", "bonus"]
    )
    blocks = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), postings)
    own = key[term]
    columns = {
        "source_type": kinds.dictionary.take(pa.array(own // max(1, len(names)))),
        "term": names.take(pa.array(own % max(1, len(names)))),
        "span": pa.array(np.full(len(own), place, np.int64)),
        "most_weight": pa.array(np.maximum.reduceat(most[0], group) if len(group) else most[0]),
        "most_bonus": pa.array(np.maximum.reduceat(most[1], group) if len(group) else most[1]),
        "ranges": pa.ListArray.from_arrays(lists, ranges),
        "postings": pa.ListArray.from_arrays(lists, blocks),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


@dataclass(frozen=True)
class ImpactIndex:
    """The stored table: blocks (term, span, ranges with their maxima, postings by range) and its spans (term, span, maxima)."""

    blocks: DataFrame
    spans: DataFrame

    def of_type(self, source_type: str | None) -> ImpactIndex:
        if source_type is None:
            return self
        only = F.col("source_type") == source_type
        return ImpactIndex(self.blocks.where(only), self.spans.where(only))


def read_impact_index(spark: SparkSession, path: str) -> ImpactIndex:
    blocks = spark.read.parquet(f"{path}/blocks")
    return ImpactIndex(blocks, blocks.select("source_type", "term", "span", "most_weight", "most_bonus"))


def _bounds(asked: DataFrame, maxima: DataFrame, by: list[str]) -> DataFrame:
    """(query_id, ..., bound): no chunk of the place has a higher score. Blocks of one term in two source types count once."""
    part = F.col("qcount") * F.col("most_weight") + F.col("most_bonus")
    met = maxima.join(asked, "term").groupBy("query_id", *by, "term").agg(F.max(part).alias("part"))
    return met.groupBy("query_id", *by).agg(F.sum("part").alias("bound"), F.count(F.lit(1)).alias("blocks"))


def _scores(asked: DataFrame, chosen: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, matched_terms) of every chunk in the chosen (query_id, range) with a shared term."""
    sought = asked.join(chosen.select("query_id", "range", _first_of(F.col("range"), SPAN).alias("span")), "query_id")
    read = blocks.select("term", "span", F.col("ranges.range").alias("ranges"), "postings")
    read = read.join(broadcast_if_bounded(stored(sought, "sought")), ["term", "span"])
    block = F.get("postings", F.array_position("ranges", F.col("range")).cast("int") - 1)
    found = read.select("query_id", "term", "qcount", F.explode(block).alias("p"))
    part = F.col("qcount") * F.col("p.weight") + F.col("p.bonus")
    return found.groupBy("query_id", F.col("p.chunk_id").alias("chunk_id")).agg(
        F.sum(part).alias("score"), F.array_sort(F.collect_list("term")).alias("matched_terms")
    )


@dataclass(frozen=True)
class PrunedSearch:
    """``best``: query_id, rank, chunk_id, score, matched_terms; ``work``: query_id, blocks, blocks_read."""

    best: DataFrame
    work: DataFrame


def pruned_search(queries: DataFrame, index: ImpactIndex, k: int = 5, source_type: str | None = None) -> PrunedSearch:
    """The k best chunks of every query and how many of its terms' blocks were read for them."""
    check_top_k(k)
    index = index.of_type(source_type)
    asked = rows_of(query_features(queries), "terms", ["query_id"], ["term", "qcount"])
    asked = stored(asked.withColumn("qcount", F.col("qcount").cast("double")), "asked-terms")
    terms = broadcast_if_bounded(asked)
    maxima = index.blocks.select("term", "span", "ranges")
    spans = stored(_bounds(terms, index.spans, ["span"]), "span-bounds")

    # A first floor from the best ranges of the best spans; both lists are short, whatever the size of the index.
    first = top_k(spans, TRIED_SPANS, score="bound", tie="span").select("query_id", "span")
    inside = _refined(asked, maxima, first)
    tried = stored(top_k(inside, TRIED + -(-k // RANGE), score="bound", tie="range").select("query_id", "range", "blocks"), "tried")
    early = stored(_scores(asked, tried, index.blocks), "early-scores")
    floor = top_k(early, k).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    floor = floor.where(F.col("n") == k).select("query_id", "least")
    floor = broadcast_if_bounded(stored(floor, "floors"))

    def reach(bounds: DataFrame) -> DataFrame:
        return bounds.join(floor, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least")))

    left = stored(reach(spans).select("query_id", "span"), "spans-left")
    ranges = reach(_refined(asked, maxima, left)).select("query_id", "range", "blocks")
    ranges = stored(ranges.join(tried.select("query_id", "range"), ["query_id", "range"], "left_anti"), "ranges-left")
    late = _scores(asked, ranges, index.blocks)
    # Ranges are counted for each term before they meet its queries.
    held = maxima.join(terms.select("term").distinct(), "term", "left_semi").select("term", F.explode("ranges.range").alias("range"))
    held = held.groupBy("term").agg(F.countDistinct("range").alias("blocks"))
    total = asked.select("query_id", "term").distinct().join(held, "term").groupBy("query_id").agg(F.sum("blocks").alias("blocks"))
    read = tried.unionByName(ranges).groupBy("query_id").agg(F.sum("blocks").alias("blocks_read"))
    work = total.join(read, "query_id", "left").select("query_id", "blocks", F.coalesce("blocks_read", F.lit(0)).alias("blocks_read"))
    best = top_k(early.unionByName(late), k)
    return PrunedSearch(best.select("query_id", "rank", "chunk_id", "score", "matched_terms"), work)


def _refined(asked: DataFrame, maxima: DataFrame, left: DataFrame) -> DataFrame:
    """Bounds of the ranges inside the (query_id, span) that are left."""
    sought = stored(asked.join(left, "query_id"), "asked-spans")
    part = F.col("qcount") * F.col("most_weight") + F.col("most_bonus")
    met = maxima.join(broadcast_if_bounded(sought), ["term", "span"]).select("query_id", "qcount", "term", F.inline("ranges"))
    met = met.groupBy("query_id", "range", "term").agg(F.max(part).alias("part"))
    return met.groupBy("query_id", "range").agg(F.sum("part").alias("bound"), F.count(F.lit(1)).alias("blocks"))
