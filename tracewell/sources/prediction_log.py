"""A prediction store that is added to: hash buckets, generations of changes, and compaction.

A write goes into a new generation and holds only the buckets that its keys fall into; nothing older is rewritten.
A commit record names the generation and its buckets. Readers take, per bucket, the generations since the last one that
replaced the bucket, and of several rows with one key the newest. Compaction writes buckets with many live
generations anew, as a generation that replaces them. A lookup reads the buckets of its keys only, and Parquet's
Bloom filters on the input hash leave out the row groups without them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracewell.session import BROADCAST_BYTES, measured, stored
from tracewell.sources.commits import commit, new_generation, records
from tracewell.sources.predictions import KEY, STORE_SCHEMA

BUCKETS = 32
COLUMNS = [*KEY, "semantic_intent"]


def bucket_of(buckets: int) -> Column:
    """The bucket of a key; the hash of the text alone, so that lookups need no model name."""
    return F.pmod(F.xxhash64("input_hash"), F.lit(buckets)).cast("int")


def _newest(rows: DataFrame, by: str) -> DataFrame:
    order = Window.partitionBy(*KEY).orderBy(F.col(by).desc())
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def _put(spark: SparkSession, path: str, rows: DataFrame, buckets: int, replaces: bool) -> int | None:
    generation = new_generation()
    placed = stored(rows.select(*COLUMNS).withColumn("bucket", bucket_of(buckets)), "predictions")
    touched = sorted(r[0] for r in placed.select("bucket").distinct().collect())
    if not touched:
        return None
    # Rows of a bucket meet in one task, unless they are too many for it.
    placed.hint("rebalance", "bucket").write.option("parquet.bloom.filter.enabled#input_hash", "true").partitionBy(
        "bucket"
    ).parquet(f"{path}/{generation}")
    return commit(spark, path, generation, {"buckets": touched, "replaces": replaces, "of": buckets})


def put_predictions(new: DataFrame, path: str, buckets: int = BUCKETS) -> int | None:
    """Add rows or replace those with equal keys; of repeated keys in ``new`` one row stays.

    ``buckets`` counts when the store is made. Returns the number of the commit, None without rows.
    """
    spark = new.sparkSession
    known = records(spark, path)
    once = new.groupBy(*KEY).agg(F.min("semantic_intent").alias("semantic_intent"))
    return _put(spark, path, once, known[0]["of"] if known else buckets, False)


def live_parts(spark: SparkSession, path: str) -> dict[int, list[tuple[int, str]]]:
    """Per bucket the (number, generation) that readers need, oldest first."""
    parts: dict[int, list[tuple[int, str]]] = {}
    for record in records(spark, path):
        for bucket in record["buckets"]:
            earlier = [] if record["replaces"] else parts.get(bucket, [])
            parts[bucket] = [*earlier, (record["number"], record["generation"])]
    return parts


def _rows(spark: SparkSession, path: str, parts: dict[int, list[tuple[int, str]]]) -> DataFrame:
    """Live rows with their generation's number, one read per generation."""
    wanted: dict[tuple[int, str], list[int]] = {}
    for bucket, generations in parts.items():
        for one in generations:
            wanted.setdefault(one, []).append(bucket)
    reads = [
        spark.read.schema(STORE_SCHEMA).parquet(*[f"{path}/{generation}/bucket={b}" for b in buckets]).withColumn("_number", F.lit(number))
        for (number, generation), buckets in sorted(wanted.items())
    ]
    empty = spark.createDataFrame([], STORE_SCHEMA).withColumn("_number", F.lit(0))
    return reduce(DataFrame.unionByName, reads, empty)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every key. Buckets of a single generation are read as they are."""
    parts = live_parts(spark, path)
    single = {b: g for b, g in parts.items() if len(g) == 1}
    several = {b: g for b, g in parts.items() if len(g) > 1}
    whole = _rows(spark, path, single).unionByName(_newest(_rows(spark, path, several), "_number"))
    return whole.select(*COLUMNS)


def look_up(keys: DataFrame, path: str, pushed: int = 1000) -> DataFrame:
    """``keys`` (the key columns and any others) with semantic_intent, null where nothing is stored.

    Reads the buckets of the keys; up to ``pushed`` distinct hashes go into the scan as a filter.
    """
    spark = keys.sparkSession
    parts = live_parts(spark, path)
    known = records(spark, path)
    of = known[0]["of"] if known else BUCKETS
    asked = stored(keys, "asked-keys")
    needed = {r[0] for r in asked.select(bucket_of(of)).distinct().collect()}
    rows = _rows(spark, path, {b: g for b, g in parts.items() if b in needed})
    hashes = [r[0] for r in asked.select("input_hash").distinct().limit(pushed + 1).collect()]
    if len(hashes) <= pushed:
        rows = rows.where(F.col("input_hash").isin(hashes))
    small = F.broadcast(asked.select(*KEY).distinct()) if measured(asked.select(*KEY))[1] <= BROADCAST_BYTES else asked.select(*KEY).distinct()
    found = _newest(rows.join(small, KEY, "left_semi"), "_number")
    return asked.join(found.select(*COLUMNS), KEY, "left")


def compact(spark: SparkSession, path: str, at_least: int = 2) -> list[int]:
    """Write buckets with ``at_least`` live generations as one; returns these buckets. The others' files stay."""
    parts = live_parts(spark, path)
    worn = {b: g for b, g in parts.items() if len(g) >= at_least}
    if worn:
        of = records(spark, path)[0]["of"]
        _put(spark, path, _newest(_rows(spark, path, worn), "_number"), of, True)
    return sorted(worn)


def unused_generations(spark: SparkSession, path: str) -> list[str]:
    """Committed generations that no reader needs any more."""
    live = {g for generations in live_parts(spark, path).values() for _, g in generations}
    return [r["generation"] for r in records(spark, path) if r["generation"] not in live]
