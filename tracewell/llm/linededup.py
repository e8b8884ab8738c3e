"""Line dedup: documents probe a sharded minimal perfect hash of all distinct lines.

Build: every distinct line hash (128 bits) of the corpus goes, pre-aggregated per Arrow batch, to its shard.
A shard's hash function maps its n lines to 0..n-1 without gaps: levels of bit arrays take the keys that
collide with no other, the rest goes on to the next level. At a line's slot stand a 32-bit fingerprint, a
count (1, or 2 for two and more documents) and the smallest document id that holds the line.
The number of shards follows the number of lines, so a shard stays at about SHARD_LINES of them.
Probe: documents send their line hashes to the shards, which answer with the lines to drop. Lines held by
more than one document in HOT_SHARE would make a shard's probes uneven; there are at most HOT_SHARE times
the mean number of lines per document of them, so their entries are shipped to all tasks instead.

Defined cases: a null text stays null and counts as one empty line; lines with fewer than ``shortest`` code
points in their key always stay; a document that repeats a line is one holder, and the smallest holder
keeps all its repeats; rows with the same id are one document, a null id counts as the smallest, so rows
without an id lose no lines; very long texts are read whole, a hash for each of their lines at a time; input
columns named like the added ones are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType

from tracewell.llm.common import broadcast_if_bounded, prepare, releasing, replaced, stored, with_fields

SHORTEST = 10
HOT_SHARE = 1000
SHARD_LINES = 250_000
BLANKS = " \t\n\r\v\f"
NO_ID = -(2**63)
_LOAD = 2


def line_digest(line: str, shortest: int) -> bytes | None:
    """128-bit hash of a line's key, None for a short one. Only A-Z are lower-cased."""
    import xxhash

    key = line.strip(BLANKS)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= shortest else None


def _mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    out = (h1 ^ np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
    out = (out ^ (out >> np.uint64(32))) + h2 * np.uint64(2 * level + 1)
    out *= np.uint64(0xA0761D6478BD642F)
    return out ^ (out >> np.uint64(29))


class MinimalHash:
    """Slots 0..n-1 for n distinct 128-bit keys; ``levels`` are bit arrays, packed."""

    def __init__(self, sizes: list[int], levels: list[np.ndarray]):
        self.sizes, self.levels = sizes, levels
        counts = [np.cumsum(np.bitwise_count(bits), dtype=np.int64) for bits in levels]
        self.ranks = [np.concatenate([[0], c[:-1]]) if len(c) else c for c in counts]
        totals = [int(c[-1]) if len(c) else 0 for c in counts]
        self.offsets = np.concatenate([[0], np.cumsum(totals)]).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> MinimalHash:
        sizes, levels = [], []
        while len(h1):
            size = _LOAD * len(h1) + 8 - (_LOAD * len(h1)) % 8
            at = (_mixed(h1, h2, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little"))
            rest = ~alone[at]
            h1, h2 = h1[rest], h2[rest]
        return cls(sizes, levels)

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that no level holds."""
        out, left = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, (size, bits) in enumerate(zip(self.sizes, self.levels)):
            at = (_mixed(h1[left], h2[left], level) % np.uint64(size)).astype(np.int64)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            hit = (bits[byte] >> bit) & 1 == 1
            below = np.bitwise_count(bits[byte] & ((1 << bit.astype(np.uint16)) - 1).astype(np.uint8))
            found = self.offsets[level] + self.ranks[level][byte] + below
            out[left[hit]] = found[hit]
            left = left[~hit]
        return out


class LineShard:
    """One shard: the hash function and the arrays at its slots."""

    def __init__(self, mph: MinimalHash, prints: np.ndarray, counts: np.ndarray, owners: np.ndarray):
        self.mph, self.prints, self.counts, self.owners = mph, prints, counts, owners

    @classmethod
    def build(cls, h1, h2, first, last) -> LineShard:
        mph = MinimalHash.build(h1, h2)
        at = mph.slots(h1, h2)
        prints, counts, owners = np.empty(len(h1), np.uint32), np.empty(len(h1), np.uint8), np.empty(len(h1), np.int64)
        prints[at], counts[at], owners[at] = h2.astype(np.uint32), 1 + (first != last), first
        return cls(mph, prints, counts, owners)

    def owner(self, h1, h2) -> tuple[np.ndarray, np.ndarray]:
        """(repeated, owner) of each key."""
        at = self.mph.slots(h1, h2)
        known = at >= 0
        known[known] = self.prints[at[known]] == h2[known].astype(np.uint32)
        repeated = np.zeros(len(at), bool)
        repeated[known] = self.counts[at[known]] > 1
        return repeated, np.where(repeated, self.owners[at] if len(self.owners) else 0, 0)

    def to_row(self) -> dict:
        return {
            "sizes": self.mph.sizes, "bits": b"".join(b.tobytes() for b in self.mph.levels),
            "prints": self.prints.tobytes(), "counts": self.counts.tobytes(), "owners": self.owners.tobytes(),
        }

    @classmethod
    def from_row(cls, row: dict) -> LineShard:
        bits, levels, begin = np.frombuffer(row["bits"], np.uint8), [], 0
        for size in row["sizes"]:
            levels.append(bits[begin : begin + size // 8])
            begin += size // 8
        return cls(
            MinimalHash(list(row["sizes"]), levels), np.frombuffer(row["prints"], np.uint32),
            np.frombuffer(row["counts"], np.uint8), np.frombuffer(row["owners"], np.int64),
        )


def _held(batch: pa.RecordBatch, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (h1, h2, document) of a batch, sorted."""
    digests, docs = [], []
    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
        found = [d for d in (line_digest(line, shortest) for line in (text or "").split("\n")) if d]
        digests += found
        docs += [NO_ID if doc is None else doc] * len(found)
    keys = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    doc = np.array(docs, np.int64)
    order = np.lexsort((doc, keys[:, 1], keys[:, 0]))
    keys, doc = keys[order], doc[order]
    if len(doc):
        new = np.ones(len(doc), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1) | (doc[1:] != doc[:-1])
        keys, doc = keys[new], doc[new]
    return keys[:, 0].copy(), keys[:, 1].copy(), doc


def line_index(docs: DataFrame, shards: int, hot_at: float, shortest: int = SHORTEST) -> DataFrame:
    """One row per shard with its hash function, its arrays and its hot entries (h1, h2, owner), packed."""
    prepare(docs.sparkSession)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, doc = _held(batch, shortest)
            new = np.ones(len(doc), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(doc))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((h1[begin] % np.uint64(shards)).astype(np.int32)),
                    pa.array(h1[begin].view(np.int64)),
                    pa.array(h2[begin].view(np.int64)),
                    pa.array(doc[begin]),
                    pa.array(doc[end - 1] if len(begin) else doc),
                    pa.array((end - begin).astype(np.int64)),
                ],
                names=["shard", "h1", "h2", "first", "last", "holders"],
            )

    kind = "shard int, h1 long, h2 long, first long, last long, holders long"
    held = docs.select("doc_id", "text").mapInArrow(releasing(lines), kind).repartition(shards, "shard")
    held = held.groupBy("shard", "h1", "h2").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("holders").alias("holders")
    )

    def build(group: pa.Table) -> pa.Table:
        cols = {n: group.column(n).to_numpy() for n in ("h1", "h2", "first", "last", "holders")}
        h1, h2 = cols["h1"].view(np.uint64), cols["h2"].view(np.uint64)
        shard = LineShard.build(h1, h2, cols["first"], cols["last"])
        hot = (cols["holders"] > hot_at) & (cols["first"] != cols["last"])
        packed = np.stack([cols["h1"][hot], cols["h2"][hot], cols["first"][hot]], axis=1).tobytes()
        row = {"shard": group.column("shard")[0].as_py(), **shard.to_row(), "hot": packed}
        return pa.Table.from_pylist([row], schema=target)

    target = pa.schema(
        [("shard", pa.int32()), ("sizes", pa.list_(pa.int64()))]
        + [(n, pa.binary()) for n in ("bits", "prints", "counts", "owners", "hot")]
    )
    kind = "shard int, sizes array<long>, bits binary, prints binary, counts binary, owners binary, hot binary"
    return held.groupBy("shard").applyInArrow(build, kind)


def measured_lines(docs: DataFrame) -> tuple[int, int]:
    """(documents, lines), short and repeated lines included."""
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return tuple(docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(lines), F.lit(0))).first())


def shards_for(lines: int, least: int) -> int:
    """Shards of at most about SHARD_LINES lines, ``least`` or more."""
    return max(least, -(-lines // SHARD_LINES))


def dedup_lines(docs: DataFrame, shortest: int = SHORTEST, shards: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) with repeated lines taken out, and n_lines (before) and n_dropped.

    A line repeated in two or more documents stays only in the document with the smallest id.
    """
    spark = docs.sparkSession
    n_docs, n_lines = measured_lines(docs)
    shards = shards or shards_for(n_lines, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot_at = max(1.0, n_docs / HOT_SHARE)
    index = stored(line_index(docs, shards, hot_at, shortest), "line-index")
    packed = index.where("length(hot) > 0").select("hot").collect()
    entries = np.frombuffer(b"".join(bytes(r.hot) for r in packed), np.int64).reshape(-1, 3)
    hot = {a.tobytes() + b.tobytes(): int(o) for a, b, o in entries}
    shipped = spark.sparkContext.broadcast(hot)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array([k for k in shipped.value], "S16")
        for batch in batches:
            h1, h2, doc = _held(batch, shortest)
            if len(known) and len(doc):
                both = np.stack([h1, h2], axis=1)
                cold = np.array([k.tobytes() not in shipped.value for k in both])
                h1, h2, doc = h1[cold], h2[cold], doc[cold]
            yield pa.RecordBatch.from_arrays(
                [pa.array((h1 % np.uint64(shards)).astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(doc)],
                names=["shard", "h1", "h2", "doc"],
            )

    sent = docs.select("doc_id", "text").mapInArrow(releasing(probes), "shard int, h1 long, h2 long, doc long")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"doc": pa.array([], pa.int64()), "line": pa.array([], pa.binary())})
        shard = LineShard.from_row(left.slice(0, 1).to_pylist()[0])
        h1, h2 = (right.column(n).to_numpy() for n in ("h1", "h2"))
        repeated, owner = shard.owner(h1.view(np.uint64), h2.view(np.uint64))
        doc = right.column("doc").to_numpy()
        drop = repeated & (owner != doc)
        lines = [k.tobytes() for k in np.stack([h1[drop], h2[drop]], axis=1)]
        return pa.table({"doc": pa.array(doc[drop]), "line": pa.array(lines, pa.binary())})

    drops = index.drop("hot").groupBy("shard").cogroup(sent.groupBy("shard")).applyInArrow(answer, "doc long, line binary")
    drops = stored(drops.groupBy("doc").agg(F.collect_list("line").alias("line_drops")), "line-drops")
    source = docs.withColumn("line_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    joined = source.join(broadcast_if_bounded(drops), F.col("line_doc") == F.col("doc"), "left").drop("doc")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shipped.value
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            columns = (batch.column(n).to_pylist() for n in ("line_doc", "text", "line_drops"))
            for doc, text, drops in zip(*columns):
                lines = (text or "").split("\n")
                n_lines.append(len(lines))
                drops = set(drops or ())
                if drops or hot:
                    kept = []
                    for line in lines:
                        d = line_digest(line, shortest)
                        if d is None or not (d in drops or hot.get(d, doc) != doc):
                            kept.append(line)
                    n_dropped.append(len(lines) - len(kept))
                    texts.append(text if len(kept) == len(lines) else "\n".join(kept))
                else:
                    n_dropped.append(0)
                    texts.append(text)
            new = {
                "text": pa.array(texts, pa.string()),
                "n_lines": pa.array(n_lines, pa.int64()),
                "n_dropped": pa.array(n_dropped, pa.int64()),
            }
            out = replaced(batch, new)
            yield out.select([n for n in out.schema.names if n not in ("line_doc", "line_drops")])

    added = [("text", StringType()), ("n_lines", LongType()), ("n_dropped", LongType())]
    return joined.mapInArrow(releasing(cut), with_fields(docs.schema, added))
