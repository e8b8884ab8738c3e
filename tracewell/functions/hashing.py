"""Token hashing for the hashed-vector scorer."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tracewell.session import ship_package


def md5_bucket(token: Column, dims: int) -> Column:
    """First 32 bits of md5 modulo ``dims``; native and reproducible in plain SQL."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dims).cast("int")


def blake2b_bucket(token: Column, dims: int) -> Column:
    """Big-endian 64-bit blake2b modulo ``dims``.

    Arrow UDF; callers apply it to a distinct vocabulary, never per token occurrence.
    """

    @F.pandas_udf("int")
    def bucket(values: pd.Series) -> pd.Series:
        return values.map(
            lambda v: int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "big")
            % dims
        ).astype("int32")

    return bucket(token)


def vocabulary_buckets(terms: DataFrame, dims: int) -> DataFrame:
    """(term, bucket) for the distinct terms of ``terms`` under blake2b hashing."""
    ship_package(terms.sparkSession)
    return terms.select("term").distinct().withColumn("bucket", blake2b_bucket(F.col("term"), dims))
