"""Byte-level BPE over Arrow batches with the tokenizers library, and its inverse.

A vocabulary is a file of ranks (one base64 token and its rank per line). The driver reads it once, derives
the merges and ships the model, whose size is that of the vocabulary, to the tasks.

Whole texts are encoded. Inside a task the text is cut before each run of white space, where a match of the
splitting pattern always begins, so a piece has the same ids wherever it stands; pieces are encoded once
and kept in a bounded table. Batches are cut by bytes, so one long text does not enlarge its neighbours.
A worker lives on through the stages that follow: it gives free memory back after each part, and its table is
emptied at the end of a task, so that only the model stays.

Defined cases: null and empty texts have no ids and decode to no bytes; ids are those of ordinary text,
special tokens do not exist; a token may hold part of a character, then its span covers that character
and ``decode_text`` joins the bytes before it reads characters; input columns named like the added ones
are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

from tracewell.llm.common import prepare, releasing, replaced, with_fields

# The pattern that parts text before merging, and the white space it knows. Fixed values.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

MOST_PIECES = 120_000
MOST_PIECE_CHARS = 64
LEARNT_AT_ONCE = 5_000
PART_BYTES = 256 << 10


def byte_characters() -> list[str]:
    """The printable stand-in for each byte: itself where printable, else the next free code point from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], free = chr(free), free + 1
    return [out[b] for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """Tokens by rank (empty where a rank is free) and the merges that make them, as pairs of ranks."""

    tokens: list[bytes]
    merges: np.ndarray
    pattern: str
    digest: str


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that ``token`` is made of by merges of lower rank."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        found = [(ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, at = min(found)
        if rank >= limit:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def read_vocabulary(path: str, pattern: str = PATTERN) -> Vocabulary:
    with open(path, "rb") as file:
        content = file.read()
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    merges = [_last_merge(t, ranks) for t in tokens if len(t) > 1]
    pairs = np.array([(ranks[m[0]], ranks[m[1]]) for m in merges if m], np.int32).reshape(-1, 2)
    return Vocabulary(tokens, pairs, pattern, hashlib.sha256(content + pattern.encode()).hexdigest())


def build_tokenizer(vocabulary: Vocabulary):
    """The tokenizers model over stand-in characters."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    stand_in = byte_characters()
    names = ["".join(stand_in[b] for b in token) for token in vocabulary.tokens]
    out = Tokenizer(
        models.BPE(
            vocab={name: rank for rank, name in enumerate(names) if name},
            merges=[(names[a], names[b]) for a, b in vocabulary.merges.tolist()],
            ignore_merges=True,
            cache_capacity=0,
        )
    )
    out.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(vocabulary.pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return out


def _sizes(vocabulary: Vocabulary) -> np.ndarray:
    """Bytes of each token by rank."""
    return np.array([len(t) for t in vocabulary.tokens], np.int64)


class _Encoder:
    """Packed ids of texts; a table keeps the ids of short pieces seen before."""

    def __init__(self, vocabulary: Vocabulary):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = build_tokenizer(vocabulary)
        self.pieces = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.white = frozenset(c for c in map(chr, range(0x3001)) if re.fullmatch(f"[{WHITE}]", c))
        self.known: dict[str, bytes] = {}
        self.sizes = _sizes(vocabulary)

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Packed ids of each piece, from few long texts.

        A piece that begins with white space is not changed by what stands before it, so such pieces are
        encoded joined and parted again by the byte lengths of their tokens; others get a line end first.
        """
        out = {}
        for i in range(0, len(pieces), LEARNT_AT_ONCE):
            self._learn_some(pieces[i : i + LEARNT_AT_ONCE], out)
        return out

    def _learn_some(self, pieces: list[str], out: dict[str, bytes]) -> None:
        closed = [p for p in pieces if p[-1] not in self.white]
        joined = ["".join(p if p[0] in self.white else "\n" + p for p in closed)] if closed else []
        open_ended = [p for p in pieces if p[-1] in self.white]
        codes = self.model.encode_batch_fast(joined + open_ended, add_special_tokens=False)
        if closed:
            ids = np.array(codes[0].ids, "<u4")
            lengths = np.array([len(p.encode()) + (p[0] not in self.white) for p in closed])
            cuts = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(lengths)) + 1
            raw, ends, begin = ids.tobytes(), (cuts * 4).tolist(), 0
            for p, end in zip(closed, ends):
                out[p] = raw[begin + 4 * (p[0] not in self.white) : end]
                begin = end
        for p, code in zip(open_ended, codes[len(joined) :]):
            out[p] = np.array(code.ids, "<u4").tobytes()

    def packed(self, texts: list[str]) -> list[bytes]:
        parted = [self.pieces(t) for t in texts]
        if len(self.known) > MOST_PIECES:
            self.known.clear()
        known = self.known
        new = set().union(*parted).difference(known)
        if new:
            found = self._learn(list(new))
            known.update(found)
        out = [b"".join(map(known.__getitem__, p)) for p in parted]
        for p in new:
            if len(p) > MOST_PIECE_CHARS:
                del known[p]
        return out


class _Decoder:
    """Bytes of packed ids through one flat table of all tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.tokens, self.sizes = vocabulary.tokens, _sizes(vocabulary)

    def ids(self, packed: bytes | None) -> np.ndarray:
        return np.frombuffer(packed or b"", "<u4")

    def raw(self, packed: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, self.ids(packed).tolist()))

    def spans(self, packed: bytes | None, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last character of each token; a split character counts for all its tokens."""
        ends = np.cumsum(self.sizes[self.ids(packed)])
        starts = ends - self.sizes[self.ids(packed)]
        is_first = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        upto = np.concatenate([[0], np.cumsum(is_first)])
        return np.maximum(upto[np.minimum(starts + 1, len(raw))] - 1, 0), upto[ends]


_made: dict[str, tuple] = {}


def _once(kind, shipped: Shipped):
    """One model of a kind per worker, built at first use; another vocabulary replaces it."""
    if kind.__name__ not in _made or _made[kind.__name__][0] != shipped.digest:
        _made.pop(kind.__name__, None)
        _made[kind.__name__] = (shipped.digest, kind(shipped.data.value))
    return _made[kind.__name__][1]


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose values in ``column`` hold about PART_BYTES, one row at least."""
    sizes = np.array([len(v.as_buffer() or b"") if v.is_valid else 0 for v in batch.column(column)], np.int64)
    run = np.cumsum(sizes) // PART_BYTES
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


@dataclass(frozen=True)
class Shipped:
    digest: str
    data: Broadcast


def ship_vocabulary(spark, vocabulary: Vocabulary) -> Shipped:
    prepare(spark)
    return Shipped(vocabulary.digest, spark.sparkContext.broadcast(vocabulary))


def _encoded(encoder: _Encoder, texts: list[str], added: dict) -> list[bytes]:
    packed = encoder.packed(texts)
    added["n_tokens"] = pa.array([len(p) // 4 for p in packed], pa.int64())
    added["token_bytes"] = pa.array(packed, pa.binary())
    return packed


def _with_spans(decoder: _Decoder, packed: list[bytes], texts: list[str], added: dict) -> None:
    found = [decoder.spans(p, t.encode()) for p, t in zip(packed, texts)]
    for name, k in (("span_starts", 0), ("span_ends", 1)):
        added[name] = pa.array([f[k].astype(np.int32) for f in found], pa.list_(pa.int32()))


def _decoded(decoder: _Decoder, packed: list[bytes | None], as_text: bool, added: dict) -> None:
    raw = [decoder.raw(p) for p in packed]
    added["decoded"] = pa.array(raw, pa.binary())
    if as_text:
        added["decoded_text"] = pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())


TOKENS = [("n_tokens", LongType()), ("token_bytes", BinaryType())]
SPANS = [("span_starts", ArrayType(IntegerType())), ("span_ends", ArrayType(IntegerType()))]


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", spans: bool = False) -> DataFrame:
    """Adds n_tokens and token_bytes (ids as little-endian unsigned 32-bit integers, the layout of training shards).

    With ``spans`` also span_starts and span_ends, the characters of the text that each token covers.
    """
    shipped = ship_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _once(_Encoder, shipped), _once(_Decoder, shipped)
        for whole in batches:
            for batch in _parts(whole, text):
                texts, added = [t or "" for t in batch.column(text).to_pylist()], {}
                packed = _encoded(encoder, texts, added)
                if spans:
                    _with_spans(decoder, packed, texts, added)
                yield replaced(batch, added)
        encoder.known.clear()

    return docs.mapInArrow(releasing(run), with_fields(docs.schema, TOKENS + (SPANS if spans else [])))


def decode(tokens: DataFrame, vocabulary: Vocabulary, as_text: bool = False) -> DataFrame:
    """Adds decoded, the bytes of token_bytes; with ``as_text`` also decoded_text, broken characters replaced."""
    shipped = ship_vocabulary(tokens.sparkSession, vocabulary)
    new = [("decoded", BinaryType())] + ([("decoded_text", StringType())] if as_text else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _once(_Decoder, shipped)
        for whole in batches:
            for batch in _parts(whole, "token_bytes"):
                added = {}
                _decoded(decoder, batch.column("token_bytes").to_pylist(), as_text, added)
                yield replaced(batch, added)

    return tokens.mapInArrow(releasing(run), with_fields(tokens.schema, new))


def round_trip(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass over the texts: n_tokens, token_bytes and decoded instead of the text."""
    shipped = ship_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _once(_Encoder, shipped), _once(_Decoder, shipped)
        for whole in batches:
            for batch in _parts(whole, text):
                added = {}
                packed = _encoded(encoder, [t or "" for t in batch.column(text).to_pylist()], added)
                _decoded(decoder, packed, False, added)
                yield replaced(batch, added).drop_columns([text])
        encoder.known.clear()

    kept = StructType([f for f in docs.schema.fields if f.name != text])
    return docs.mapInArrow(releasing(run), with_fields(kept, TOKENS + [("decoded", BinaryType())]))
