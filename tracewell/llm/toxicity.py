"""Toxicity by compression distance: two zstandard dictionaries, compared over windows of the text.

A text is read as words, each written as its 8-byte hash, and cut into windows of WINDOW words. One
dictionary holds the words that most ordinary documents use; the other holds the same and, before them,
the words that toxic documents use and ordinary ones do not. A window that gets shorter with the second
dictionary speaks for toxicity. Hashed words keep chance matches inside words out of the lengths: a
window without such words has the same length under both. How far windows shrink is turned into a
probability by logistic calibration on labelled documents that the dictionaries have not seen: each learnable fold
is measured with dictionaries of the other ones, and the dictionaries that score are those of all of them.

Learning reads a sample of at most MOST_LABELLED labelled documents, the first by a hash of the id; its
counts are grouped by Spark and only the dictionaries' words and the calibration's few numbers reach the
driver. Scoring reads every window of every text.

Defined cases: null and empty texts have one empty window and the lowest score; rows with a null id are never
learnt from, and held_out is null for them; labels other than 0 and 1 are ignored, the larger of several
labels of a document counts; without labels of both kinds every score is the share of label 1 (0 without
labels); input columns named like the added ones are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType

from tracewell.llm.common import prepare, releasing, replaced, stored, with_fields

WINDOW = 32
MOST_LABELLED = 20_000
ORDINARY_WORDS = 12_000
TOXIC_WORDS = 4_000
LEAST_SHARE = 0.01
LEAST_RATIO = 20
THRESHOLD = 0.3
HELD_OUT = 2
LEARNABLE = (0, 1, 3)


@dataclass(frozen=True)
class Model:
    """Dictionary contents and calibration; ``weights`` empty means the constant score ``base``."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    base: float


def fold(doc_id):
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 4


def word_codes(text: str | None) -> list[bytes]:
    import re

    import xxhash

    return [xxhash.xxh3_64_digest(w.encode()) for w in re.findall(r"[^\W_]+", (text or "").lower())]


class _Meter:
    """Window lengths under both dictionaries."""

    def __init__(self, model: Model):
        import zstandard as z

        options = z.ZstdCompressionParameters(
            window_log=18, chain_log=16, hash_log=17, search_log=3, min_match=6, target_length=16,
            strategy=z.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        self.both = []
        for content in (model.ordinary, model.toxic + model.ordinary):
            shared = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT) if content else None
            if shared:
                shared.precompute_compress(compression_params=options)
            self.both.append(z.ZstdCompressor(dict_data=shared, compression_params=options).compress)
        self.weights, self.base = np.array(model.weights), model.base

    def features(self, text: str | None) -> list[float]:
        """How the windows shrink: most, number shrinking by a word, mean; and the number of windows."""
        codes = word_codes(text)
        windows = [b"".join(codes[i : i + WINDOW]) for i in range(0, len(codes), WINDOW)] or [b""]
        ordinary, toxic = self.both
        gain = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows], float)
        n = len(gain)
        return [1.0, min(gain.max(), 10) / 5, np.log1p((gain >= 3).sum()), gain.sum() / (3 + n), np.log1p(n)]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), self.base)
        rows = np.array([self.features(t) for t in texts]).reshape(-1, len(self.weights))
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights, -35, 35)))


def _logistic(rows: np.ndarray, label: np.ndarray, pull: float = 1e-2) -> np.ndarray:
    """Newton steps with a small pull to zero."""
    w = np.zeros(rows.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -35, 35)))
        slope = rows.T @ (p - label) + pull * w
        w -= np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + pull * np.eye(len(w)), slope)
    return w


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) outside the held-out fold."""
    spark = docs.sparkSession
    prepare(spark)
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    # Fixed names, so that clashing columns of the inputs play no part.
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    texts = stored(texts.withColumn("fold", fold(F.col("doc_id")).cast("int")), "toxic-sample")
    found = texts.groupBy("fold").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    sizes = {f: (0, 0) for f in LEARNABLE} | {r.fold: (r.t, r.n - r.t) for r in found}
    n_toxic, n_other = (sum(size[kind] for size in sizes.values()) for kind in (0, 1))
    if not n_toxic or not n_other:
        return Model(b"", b"", (), n_toxic / (n_toxic + n_other) if n_toxic else 0.0)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, toxic, folds = [], [], []
            for text, label, own in zip(*(batch.column(n).to_pylist() for n in ("text", "toxic", "fold"))):
                found = set(word_codes(text))
                codes += found
                toxic += [label] * len(found)
                folds += [own] * len(found)
            code = np.frombuffer(b"".join(codes), "<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(code), pa.array(toxic, pa.int64()), pa.array(folds, pa.int32())], names=["code", "toxic", "fold"]
            )

    counts = texts.select("text", "toxic", "fold").mapInArrow(releasing(words), "code long, toxic long, fold int").groupBy("code")
    marks = {"t": F.col("toxic"), "o": 1 - F.col("toxic")}
    counts = counts.agg(
        *(F.sum(F.when(F.col("fold") == f, m).otherwise(0)).alias(f"{n}{f}") for f in LEARNABLE for n, m in marks.items())
    )
    counts = stored(counts, "toxic-words")

    def content(rows: DataFrame, by: str, most: int) -> bytes:
        found = [r.code for r in rows.orderBy(F.desc(by), "code").limit(most).collect()]
        return np.array(found[::-1], "<i8").tobytes()

    def dictionaries(left_out: int | None = None) -> Model:
        kept = [f for f in LEARNABLE if f != left_out]
        toxic, other = (sum(sizes[f][kind] for f in kept) for kind in (0, 1))
        rows = counts.selectExpr("code", *(" + ".join(f"{n}{f}" for f in kept) + f" as {n}" for n in marks))
        telling = rows.where(
            (F.col("t") >= max(3, LEAST_SHARE * toxic)) & (F.col("t") * other > LEAST_RATIO * F.col("o") * toxic)
        )
        return Model(content(rows.where("o > 0"), "o", ORDINARY_WORDS), content(telling, "t", TOXIC_WORDS), (), 0.0)

    shipped = spark.sparkContext.broadcast({f: dictionaries(f) for f in LEARNABLE})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meters = {f: _Meter(model) for f, model in shipped.value.items()}
        for batch in batches:
            pairs = zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist())
            rows = [meters[f].features(t) for t, f in pairs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), batch.column("toxic")], names=["row", "toxic"]
            )

    seen = texts.select("text", "toxic", "fold").mapInArrow(releasing(measure), "row array<double>, toxic long").toPandas()
    weights = _logistic(np.stack(seen.row.to_list()), seen.toxic.to_numpy(float))
    model = dictionaries()
    return Model(model.ordinary, model.toxic, tuple(weights.tolist()), 0.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with toxic_score (0 to 1) and toxic_predicted (1 from THRESHOLD on)."""
    prepare(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = _Meter(shipped.value)
        for batch in batches:
            found = meter.scores(batch.column("text").to_pylist())
            yield replaced(
                batch,
                {
                    "toxic_score": pa.array(found, pa.float64()),
                    "toxic_predicted": pa.array((found >= THRESHOLD).astype(np.int32)),
                },
            )

    added = [("toxic_score", DoubleType()), ("toxic_predicted", IntegerType())]
    return docs.mapInArrow(releasing(run), with_fields(docs.schema, added))
