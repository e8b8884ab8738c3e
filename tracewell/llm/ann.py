"""Approximate nearest neighbours by multi-index hashing.

A vector's code holds the signs of its coordinates after ``ROTATIONS`` rotations that are learned on a bounded sample
(principal axes, then alternating sign fitting and Procrustes turns from different starts). Codes are split into
m substrings of 32 bits and every substring value has a posting list. Two codes within a Hamming radius
r = m * a + b agree up to a bits in one of the first b + 1 substrings or up to a - 1 bits in one of the others, so
probing all values within these distances finds every code in the ball. Codes found are kept by their whole
Hamming distance and ranked by the distance of the original vectors. The radius is learned too: it covers RECALL of
the true neighbours inside the sample, where neighbours are farther apart than among all rows. A shard with
fewer than k codes in the ball widens it until it has k or all.

Every row is indexed, once. Vectors of each length have their own coder and are compared among themselves. Rows of a
length are hashed into shards of about SHARD vectors; a shard is stored as one row with its vectors and codes.
Queries are shipped in blocks of at most BLOCK, one block after the other; a task takes its shards one by one past
the block and returns k rows per query at its end. Vectors are shuffled once, whatever the number of queries.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components and null ids
take no part, neither as queries nor as candidates; an id that has queries of several lengths is ranked for
each of them; a query without candidates of its length has no rows; rows with the
query's id are no candidates; equal distances go to the smaller id; repeated rows are ranked as often as
they occur; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tracewell.llm.common import prepare, stored
from tracewell.llm.vectors import lengths, principal_axes, sample, usable
from tracewell.session import work_folder

K = 10
SUBSTRING = 32
ROTATIONS = 4
RECALL = 0.95
SHARD = 8192
BLOCK = 20_000
TURNS = 30


@dataclass(frozen=True)
class Coder:
    """The rotations side by side, and the learned Hamming radius."""

    mean: np.ndarray
    turn: np.ndarray
    radius: int

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """Substring values, one column per substring."""
        bits = (rows - self.mean) @ self.turn > 0
        pad = -bits.shape[1] % SUBSTRING
        return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1).view(np.uint32)


def _distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - query) ** 2).sum(axis=1))


def learn_coder(rows: np.ndarray, k: int = K, seed: int = 7) -> Coder:
    """Codes of ROTATIONS times as many bits as dimensions from sampled rows; without rows a coder of no bits."""
    if not len(rows):
        return Coder(np.zeros(0), np.zeros((0, 0)), 0)
    mean, axes = principal_axes(rows, True)
    flat = (rows - mean) @ axes
    rng, turns = np.random.default_rng(seed), []
    for _ in range(ROTATIONS):
        turn, _ = np.linalg.qr(rng.normal(size=axes.shape))
        for _ in range(TURNS):
            left, _, right = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = right.T @ left.T
        turns.append(axes @ turn)
    coder = Coder(mean, np.concatenate(turns, axis=1), 0)
    codes = coder.codes(rows)
    seen = []
    for q in range(0, len(rows), max(1, len(rows) // 256)):
        near = np.argsort(_distances(rows, rows[q]), kind="stable")[1 : k + 1]
        seen += np.bitwise_count(codes[near] ^ codes[q]).sum(axis=1).tolist()
    radius = int(np.quantile(seen, RECALL, method="higher")) if seen else coder.turn.shape[1]
    return Coder(mean, coder.turn, radius)


class MultiIndex:
    """Posting lists per substring over the codes of one shard."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, s], kind="stable") for s in range(codes.shape[1])]
        self.values = [np.unique(codes[:, s], return_counts=True) for s in range(codes.shape[1])]

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows in a posting list that the pigeonhole names; every code within ``radius`` is among them."""
        most, more = divmod(radius, max(1, len(code)))
        near = np.zeros(len(self.codes), bool)
        for s, own in enumerate(code):
            values, counts = self.values[s]
            hit = np.bitwise_count(values ^ own) <= (most if s <= more else most - 1)
            near[self.order[s][np.repeat(hit, counts)]] = True
        return np.flatnonzero(near)

    def ball(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within ``radius``."""
        if not len(code):
            return np.arange(len(self.codes))
        rows = self.probed(code, radius)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]

    def at_least(self, code: np.ndarray, radius: int, k: int) -> np.ndarray:
        bits = SUBSTRING * self.codes.shape[1]
        while len(found := self.ball(code, radius)) < k and radius < bits:
            radius += len(code)
        return found


@dataclass(frozen=True)
class Block:
    """Queries of one length: ids, vectors and codes."""

    ids: np.ndarray
    vectors: np.ndarray
    codes: np.ndarray


def search_shard(ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, block: Block, radius: int, k: int) -> list[tuple]:
    """(scores, ids) of the k nearest rows of a shard for each query of a block."""
    index, out = MultiIndex(codes), []
    for q, query, code in zip(block.ids.tolist(), block.vectors, block.codes):
        found = index.at_least(code, radius, k + int((ids == q).sum()))
        found = found[ids[found] != q]
        score = _distances(vectors[found], query)
        best = np.lexsort((ids[found], score))[:k]
        out.append((score[best], ids[found[best]]))
    return out


def _packed(rows: DataFrame, shipped) -> DataFrame:
    """One row per length and shard: ids, vectors and codes as bytes."""
    schema = pa.schema([("width", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("codes", pa.binary())])

    def pack(group: pa.Table) -> pa.Table:
        width = group.column("width")[0].as_py()
        vectors = np.array(group.column("vector").combine_chunks().flatten(), np.float64).reshape(-1, width)
        codes = shipped.value[width].codes(vectors)
        row = {"width": width, "ids": group.column("id").to_numpy().tobytes(), "vectors": vectors.tobytes(), "codes": codes.tobytes()}
        return pa.Table.from_pylist([row], schema=schema)

    kind = "width int, ids binary, vectors binary, codes binary"
    return rows.groupBy("width", "shard").applyInArrow(pack, kind)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of ``vectors`` for each row of ``queries``.

    Both have vec_id and embedding. One row per query row and rank; queries with equal ids share their ranks.
    """
    spark = vectors.sparkSession
    prepare(spark)

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
        return rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).select(
            F.col("id").cast("long").alias("id"), F.transform("vector", lambda x: x.cast("double")).alias("vector")
        )

    good = clean(vectors)
    held = lengths(good)
    coders = {n: learn_coder(sample(good, n), k) for n in held}
    models = spark.sparkContext.broadcast(coders)
    width = F.size("vector").alias("width")
    asked = clean(queries).where(F.size("vector").isin(list(held))).select("id", "vector", width)
    asked = stored(asked.dropDuplicates(["id", "width"]), "asked-vectors")
    parts = F.lit(1)
    for n, rows in held.items():
        parts = F.when(F.size("vector") == n, -(-rows // SHARD)).otherwise(parts)
    shards = stored(_packed(good.select("id", "vector", width, F.pmod(F.xxhash64("id"), parts).alias("shard")), models), "vector-shards")

    kind, path = "query_id long, width int, vec_id long, score double", work_folder(spark, "nearest")
    spark.createDataFrame([], kind).write.parquet(path)
    blocks = max(1, -(-asked.count() // BLOCK))
    for number in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number)
        shipped = spark.sparkContext.broadcast(_blocks(some, coders))
        shards.mapInArrow(_searcher(shipped, models, k), kind).write.mode("append").parquet(path)
        shipped.destroy()
    order = Window.partitionBy("query_id", "width").orderBy("score", "vec_id")
    ranked = spark.read.schema(kind).parquet(path).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _blocks(asked: DataFrame, coders: dict[int, Coder]) -> dict[int, Block]:
    """The queries of one bounded block, by length."""
    out = {}
    table = asked.toArrow()
    widths = table.column("width").to_numpy()
    for n in np.unique(widths).tolist():
        some = table.filter(pa.array(widths == n))
        rows = np.array(some.column("vector").combine_chunks().flatten(), np.float64).reshape(-1, n)
        out[n] = Block(some.column("id").to_numpy(), rows, coders[n].codes(rows))
    return out


def _searcher(shipped, models, k: int):
    """Function for ``mapInArrow``: a task's shards against the block, k rows per query at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, best = shipped.value, {}
        for batch in batches:
            for row in batch.to_pylist():
                n = row["width"]
                if n not in blocks:
                    continue
                ids, codes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["codes"], np.uint32)
                rows = np.frombuffer(row["vectors"], np.float64).reshape(-1, n)
                found = search_shard(ids, rows, codes.reshape(len(ids), -1), blocks[n], models.value[n].radius, k)
                held = best.setdefault(n, [(np.zeros(0), np.zeros(0, np.int64))] * len(found))
                for q, (new, old) in enumerate(zip(found, held)):
                    score, vec = (np.concatenate(pair) for pair in zip(old, new))
                    first = np.lexsort((vec, score))[:k]
                    held[q] = (score[first], vec[first])
        for n, held in best.items():
            sizes = [len(score) for score, _ in held]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(blocks[n].ids, sizes)), pa.array(np.full(sum(sizes), n, np.int32)),
                    pa.array(np.concatenate([v for _, v in held])), pa.array(np.concatenate([score for score, _ in held])),
                ],
                names=["query_id", "width", "vec_id", "score"],
            )

    return run
