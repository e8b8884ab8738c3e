"""Session defaults, shared work folder and plan-size guards."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A table is broadcast only after its content was measured below this size.
BROADCAST_BYTES = 64 << 20


def build_session(master: str | None = None, app: str = "tracewell", **conf) -> SparkSession:
    """Session with adaptive execution on; cluster settings win where already present."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()
_work: dict[str, list[str]] = {}


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root, name = os.path.split(package)
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), name), "zip", root, name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


# Arrow batches of rows that hold whole texts, or their terms.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Give the workers this package and make Arrow batches smaller than Spark's default of 64 MB.

    A limit that the session has set itself stays.
    """
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == f"{64 << 20}b":
        spark.conf.set(name, str(BATCH_BYTES))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, under the shared checkpoint folder of the cluster.

    Only a local session without that setting gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _work.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_work(spark: SparkSession) -> int:
    """Remove every work table that this application has written; results that read them end here.

    Returns the number of folders.  Call it between jobs of a long session.
    """
    paths = _work.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared work folder and read it back.

    Cuts the lineage and survives the loss of executors, unlike a cache.
    """
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes of content) of ``df``, computed on the executors; two numbers come back."""
    row_bytes = F.lit(16)
    for field in df.schema.fields:
        row_bytes = row_bytes + F.coalesce(F.octet_length(F.col(field.name).cast("string")), F.lit(0)) + 8
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes), F.lit(0))).first()
    return int(rows), int(size)


def broadcast_if_bounded(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint where its content was measured below the limit, else unchanged.

    Without the hint Spark shuffles both sides and adaptive execution splits a hot key.
    """
    _, size = measured(df)
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
