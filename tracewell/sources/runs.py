"""Run outputs and input manifests."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.sources.commits import commit, new_generation, records


def check_run_id(run_id: str) -> str:
    """Trimmed run id; only letters, digits, hyphens and underscores."""
    clean = run_id.strip()
    if not re.fullmatch(r"[A-Za-z0-9_-]+", clean):
        raise ValueError("run_id may contain only letters, numbers, hyphens, and underscores")
    return clean


TABLES = ("results", "comparison", "manifest")


def write_run(
    results: DataFrame,
    summary: DataFrame,
    manifest: DataFrame,
    path: str,
    run_id: str,
    name: str = "strategy",
    fmt: str = "parquet",
) -> None:
    """Write question results, comparison and manifest of a run, partitioned by run and name, and publish them as one.

    The tables go into a folder of their own; a commit record that appears last makes them visible together. Names
    of the run that are not written again keep their earlier results.
    """
    clean, spark = check_run_id(run_id), results.sparkSession
    generation = new_generation()
    parts = {"results": (results, ["run_id", name]), "comparison": (summary, ["run_id"]), "manifest": (manifest, ["run_id"])}
    for table, (df, by) in parts.items():
        df.withColumn("run_id", F.lit(clean)).write.partitionBy(*by).format(fmt).save(f"{path}/{generation}/{table}")
    written = spark.read.format(fmt).load(f"{path}/{generation}/results") if results.limit(1).count() else results.limit(0)
    names = sorted({str(r[0]) for r in written.select(F.col(name).cast("string")).distinct().collect()})
    commit(spark, path, generation, {"run_id": clean, "name": name, "names": names})


def read_run(spark: SparkSession, path: str, table: str, run_id: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A table of one run or of all runs, as their last commit records name it."""
    if table not in TABLES:
        raise ValueError(f"table must be one of {', '.join(TABLES)}")
    wanted = None if run_id is None else check_run_id(run_id)
    last: dict[tuple[str, str], tuple[str, str]] = {}
    for record in records(spark, path):
        for one in record["names"] if table == "results" else [""]:
            last[record["run_id"], one] = (record["generation"], record["name"])
    kept: dict[str, list[tuple[str, str]]] = {}
    for (run, one), (generation, name) in last.items():
        if wanted in (None, run):
            kept.setdefault(generation, []).append((name, one))
    if not kept:
        raise ValueError(f"no committed run {'' if wanted is None else wanted} in {path}".replace("  ", " "))
    out = []
    for generation, names in kept.items():
        df = spark.read.format(fmt).load(f"{path}/{generation}/{table}")
        only = F.col(names[0][0]).cast("string").isin([one for _, one in names]) if table == "results" else F.lit(True)
        out.append(df.where(only))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def content_hash(df: DataFrame, content: str = "content") -> DataFrame:
    """Add sha256 and item_count (elements of a JSON list; null where it is none)."""
    text = F.decode(F.col(content), "UTF-8")
    return df.withColumns(
        {"sha256": F.sha2(F.col(content), 256), "item_count": F.json_array_length(text).cast("long")}
    )


def file_manifest(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per input file: path, sha256, item_count and the time of freezing."""
    files = spark.read.format("binaryFile").load(list(paths))
    return content_hash(files.select("path", "length", "content")).select(
        "path", "length", "sha256", "item_count", F.current_timestamp().alias("frozen_at")
    )
