"""Quality by hierarchical empirical Bayes: a document's own evidence, its host and its path.

A document classifier (logistic, on shares of character classes and of repeated words) gives each
document a probability. Hosts and paths are summed up by grouped aggregation of these probabilities: a host's
posterior is pulled to the global mean, a path's posterior to its host's, each by a prior strength in
documents that is estimated from the data as the variance inside groups over the variance between them.
Sparse sites therefore stay near their prior. A document's score multiplies its evidence, as a
likelihood ratio against the global mean, with its path's posterior, from which its own share is taken out.

Learning reads at most MOST_LABELLED labelled documents outside the held-out fold; scores and site sums
cover all documents. Groups are sums, so a host with a third of all documents is pre-aggregated.

Defined cases: null and empty texts have the features of an empty text; null hosts and paths are groups of
their own; labels other than 0 and 1 are ignored, the larger of several labels of a document counts; without
labels of both kinds the evidence is the share of label 1 (0.5 without labels); an empty table gives an
empty result; other columns are ignored, whatever their names; very long texts are read whole, in time
proportional to their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracewell.llm.common import broadcast_if_bounded, prepare, stored
from tracewell.llm.toxicity import HELD_OUT, _logistic, fold

MOST_LABELLED = 20_000
KEEP_FROM = 0.5
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1e6
EDGE = 1e-6

# Byte classes: letters, upper case, digits, blanks, sentence marks, other marks, beyond ASCII.
_CLASSES = np.full(256, 5, np.int8)
for _class, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\v\f", b".,;'")):
    _CLASSES[list(_bytes)] = _class
_CLASSES[128:] = 6


def features(text: str | None) -> list[float]:
    """Shares of byte classes and of words that repeat the one before, variety of words, mean length, log sizes."""
    raw = (text or "").encode()
    counts = np.bincount(_CLASSES[np.frombuffer(raw, np.uint8)], minlength=7)
    words = raw.split()
    n = len(words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    odd = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words)
    return [
        1.0,
        *(counts / max(1, len(raw))).tolist(),
        same / max(1, n),
        len(set(words)) / max(1.0, n**0.8),
        odd / max(1, n),
        len(raw) / max(1, n) / 10,
        float(np.log1p(n)),
    ]


@dataclass(frozen=True)
class Model:
    mean: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]
    base: float

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.base)
        rows = (np.array([features(t) for t in texts]).reshape(-1, len(self.weights)) - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(rows @ np.array(self.weights), -30, 30)))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality) outside the held-out fold."""
    prepare(docs.sparkSession)
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    marked = marked.groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array([features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows, batch.column("quality")], names=["doc_id", "row", "quality"])

    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, row array<double>, quality double"
    seen = texts.mapInArrow(measure, kind).toPandas().sort_values("doc_id", kind="stable")
    if seen.empty or seen.quality.nunique() < 2:
        return Model((), (), (), float(seen.quality.mean()) if len(seen) else 0.5)
    rows = np.stack(seen.row.to_list())
    mean, spread = rows.mean(axis=0), rows.std(axis=0)
    mean[0], spread[0] = 0.0, 1.0
    spread[spread == 0] = 1.0
    weights = _logistic((rows - mean) / spread, seen.quality.to_numpy(), pull=1.0)
    return Model(tuple(mean), tuple(spread), tuple(weights), 0.0)


def _strength(groups: DataFrame, over: list[str]) -> float:
    """Prior strength in documents for groups (n, s, q: number, sum and sum of squares) inside ``over``."""
    whole = groups.groupBy(*over).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") ** 2 / F.col("n")).alias("m"),
                                      F.sum("q").alias("q"), F.count(F.lit(1)).alias("groups"))
    row = whole.agg(
        F.sum(F.col("q") - F.col("m")).alias("inside"),
        F.sum(F.col("m") - F.col("s") ** 2 / F.col("n")).alias("between"),
        F.sum("n").alias("n"), F.sum("groups").alias("groups"), F.count(F.lit(1)).alias("wholes"),
    ).first()
    if not row.n:
        return MOST_STRENGTH
    inside = row.inside / max(1, row.n - row.groups)
    extra = (row.between - inside * (row.groups - row.wholes)) / row.n
    return float(min(max(inside / extra, LEAST_STRENGTH), MOST_STRENGTH)) if extra > 0 else MOST_STRENGTH


def _log_odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(p / (1 - p))


def score(docs: DataFrame, model: Model, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, host, path, evidence, host_posterior, path_posterior, score and kept for every row of ``docs``."""
    prepare(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(shipped.value.evidence(batch.column("text").to_pylist()), pa.float64())
            names = ["doc_id", "host", "path"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), found], names=[*names, "evidence"])

    named = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text")
    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, host string, path string, evidence double"
    rows = stored(named.mapInArrow(run, kind), "quality-evidence")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("s"), F.sum(F.col("evidence") ** 2).alias("q")]
    paths = stored(rows.groupBy("host", "path").agg(*sums), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = float(total.s / total.n) if total.n else 0.5
    by_host, by_path = _strength(hosts, []), _strength(paths, ["host"])
    posterior = (F.lit(by_host * mean) + F.col("s")) / (by_host + F.col("n"))
    hosts = hosts.select(F.col("host").alias("of_host"), posterior.alias("host_posterior"))
    sites = paths.join(broadcast_if_bounded(hosts), F.col("host").eqNullSafe(F.col("of_host"))).select(
        "of_host", F.col("path").alias("of_path"), "n", "s", "host_posterior"
    )
    same = F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path"))
    out = rows.join(broadcast_if_bounded(sites), same, "left")
    prior = F.lit(by_path) * F.col("host_posterior")
    others = (prior + F.col("s") - F.col("evidence")) / (by_path + F.col("n") - 1)
    log_odds = _log_odds(F.col("evidence")) - _log_odds(F.lit(mean)) + _log_odds(others)
    out = out.withColumn("score", 1 / (1 + F.exp(-log_odds)))
    return out.select(
        "doc_id", "host", "path", "evidence", "host_posterior",
        ((prior + F.col("s")) / (by_path + F.col("n"))).alias("path_posterior"),
        "score", (F.col("score") >= KEEP_FROM).alias("kept"),
    )
