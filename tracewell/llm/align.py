"""Cross-tokenizer alignment: two tokenizations of the same bytes, compared by sparse matrix products.

A is a byte-level BPE, B a sentencepiece model. Token-byte incidence matrices are built by hand in CSR form. The
product A * transpose(B), row by row after Gustavson, gives the overlap links: which tokens share how many bytes.
Where the next link moves on in both tokenizations, tokens of both end at one byte, and a group ends. The product of
the group incidences of both sides gives the links: all pairs of tokens that share a group.

Both models end a token before a run of white space (unless the model has tokens that go on there), so a text is
the sequence of its pieces between such places; a piece has the same ids, groups and links wherever it stands.
New pieces go through the matrices together and stay in a bounded table; where that is full, the pieces used most
often stay.

Plan: a task aligns its texts and collects, per part of at most about ``PART_BYTES`` of text, each document's
distinct id pairs as short numbers into the part's list of pairs. Only that list is shuffled: its document counts
are added up by pair, joined back by pair, and brought to the part, whose documents then add up theirs. Texts,
tokens and links of single occurrences never move. A pair that every document holds is one row per part.

Defined cases: a null or empty text, and one whose joined token bytes in A or B differ from a space and the text
(such as a text with U+2581), has no tokens; strings of special tokens are plain text; every row counts as one
document, whatever its id; very long texts are read in slices that end between pieces; further columns of the
input do not come back from ``align_corpus``; those named like the added ones are replaced by ``with_groups``;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType

from tracewell.functions.packed import read_varint, varint
from tracewell.llm.bpe import MOST_PIECE_CHARS, WHITE, byte_characters
from tracewell.llm.common import prepare, replaced, stored, with_fields

MOST_PIECES = 250_000
MOST_CHARS = 8 << 20
LEARNT_AT_ONCE = 5_000
BATCH_CHARS = 1 << 20
SLICE_CHARS = 1 << 20
PART_BYTES = 16 << 20
MOST_HELD = 8_000_000
BLOCK_LINKS = 2_000_000
SPACE = "▁"


@dataclass(frozen=True)
class Csr:
    """A sparse matrix by rows: row i has columns ``indices[indptr[i]:indptr[i + 1]]`` with ``data``."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def row_of(self) -> np.ndarray:
        """The row of every stored value."""
        return np.repeat(np.arange(self.rows), np.diff(self.indptr))


def _csr(row: np.ndarray, column: np.ndarray, data: np.ndarray, rows: int, columns: int) -> Csr:
    """Rows from triples that are sorted by row."""
    return Csr(np.searchsorted(row, np.arange(rows + 1)), column, data, columns)


def byte_incidence(sizes: np.ndarray) -> Csr:
    """Tokens by bytes: token i covers ``sizes[i]`` bytes, one after the other."""
    indptr = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    total = int(indptr[-1])
    return Csr(indptr, np.arange(total), np.ones(total, np.int64), total)


def transposed(m: Csr) -> Csr:
    order = np.argsort(m.indices, kind="stable")
    return _csr(m.indices[order], m.row_of()[order], m.data[order], m.columns, m.rows)


def merged(row: np.ndarray, column: np.ndarray, data: np.ndarray, rows: int, columns: int) -> Csr:
    """Rows from triples in any order; values of one place are added up."""
    key = row * np.int64(columns) + column
    if len(key) > 1 and not (key[1:] >= key[:-1]).all():
        order = np.argsort(key, kind="stable")
        key, data = key[order], data[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    data = np.add.reduceat(data, first) if len(first) else data[:0]
    return _csr(key[first] // columns, key[first] % columns, data, rows, columns)


def product_blocks(a: Csr, b: Csr) -> Iterator[tuple[int, int, Csr]]:
    """(first row, row after the last, these rows of a * b) in blocks of about ``BLOCK_LINKS`` products.

    Gustavson: row i of the product is the sum of the rows of b that row i of a names, each times its value.
    """
    lengths = np.diff(b.indptr)[a.indices]
    upto = np.concatenate([[0], np.cumsum(lengths)])[a.indptr]
    begin = 0
    while begin < a.rows:
        end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + BLOCK_LINKS, "right")) - 1)
        low, high = a.indptr[begin], a.indptr[end]
        count = lengths[low:high]
        start = np.repeat(b.indptr[a.indices[low:high]], count)
        at = start + np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)
        row = np.repeat(np.repeat(np.arange(end - begin), np.diff(a.indptr[begin : end + 1])), count)
        data = np.repeat(a.data[low:high], count) * b.data[at]
        yield begin, end, merged(row, b.indices[at], data, end - begin, b.columns)
        begin = end


def overlap_links(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, shared bytes), in order, of tokenizations of the same bytes."""
    parts = [
        (begin + block.row_of(), block.indices, block.data)
        for begin, _, block in product_blocks(byte_incidence(a_sizes), transposed(byte_incidence(b_sizes)))
    ]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *column]) for column in zip(*parts)) if parts else (none, none, none)


def token_groups(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """The group of every A token and of every B token, from the overlap links in order."""
    new = (a[1:] != a[:-1]) & (b[1:] != b[:-1])
    group = np.concatenate([[0], np.cumsum(new)]) if len(a) else np.zeros(0, np.int64)
    of_a, of_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
    of_a[a], of_b[b] = group, group
    return of_a, of_b


def shared_links(of_a: np.ndarray, a_ids: np.ndarray, of_b: np.ndarray, b_ids: np.ndarray, n: int, size_b: int):
    """Blocks of (group, A id, B id, links): the product of group incidences, tokens of one id in a group as one."""
    vocabulary = int(a_ids.max(initial=0)) + 1
    left = merged(of_a, a_ids.astype(np.int64), np.ones(len(of_a), np.int64), n, vocabulary)
    right = merged(of_b, b_ids.astype(np.int64), np.ones(len(of_b), np.int64), n, size_b)
    group = left.row_of()
    by_entry = Csr(np.arange(len(group) + 1), group, left.data, n)
    for begin, _, block in product_blocks(by_entry, right):
        entry = begin + block.row_of()
        yield group[entry], left.indices[entry], block.indices, block.data


@dataclass(frozen=True)
class Models:
    """The contents of both model files, shipped to the tasks; their size is that of the vocabularies."""

    byte_json: str
    piece_model: bytes
    digest: str


def read_models(byte_json: str, piece_model: str) -> Models:
    with open(byte_json, encoding="utf-8") as a, open(piece_model, "rb") as b:
        one, two = a.read(), b.read()
    return Models(one, two, hashlib.sha256(one.encode() + two).hexdigest())


class _ByteModel:
    """A: ids of pieces that begin with white space, by the tokenizers model of the file."""

    def __init__(self, content: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_str(content)
        self.model.encode_special_tokens = True
        self.white = frozenset(c for c in map(chr, range(0x3001)) if re.fullmatch(f"[{WHITE}]", c))
        back = {c: b for b, c in enumerate(byte_characters())}
        names = {i: name for name, i in json.loads(content)["model"]["vocab"].items()}
        self.tokens = [bytes(back[c] for c in names[i]) if i in names else b"" for i in range(max(names) + 1)]
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)

    def __call__(self, pieces: list[str], edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, ids a piece); the bytes of the pieces end at ``edges[1:]``.

        What stands before a piece does not change it, nor does what follows, unless it ends with white space:
        pieces up to such a one are encoded joined and parted again by the byte lengths of their tokens.
        """
        ends = {k + i for k, p in enumerate(pieces) if p[-1] in self.white for i in (0, 1)}
        cuts = sorted(ends | set(range(0, len(pieces), LEARNT_AT_ONCE)) | {len(pieces)})
        joined = ["".join(pieces[i:k]) for i, k in zip(cuts, cuts[1:])]
        codes = self.model.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.int64), *(np.array(c.ids, np.int64) for c in codes)])
        upto = np.minimum(np.searchsorted(np.cumsum(self.sizes[ids]), edges[1:]) + 1, len(ids))
        upto[-1] = len(ids)
        return ids, np.diff(upto, prepend=0)


class _PieceModel:
    """B: ids of pieces that begin with white space, by the sentencepiece model, which puts a space before each text."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.tokens = [self._bytes(i) for i in range(len(self.names))]
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.space = self.model.piece_to_id(SPACE)

    def _bytes(self, i: int) -> bytes:
        if self.model.is_byte(i):
            return bytes([int(self.names[i][3:5], 16)])
        if self.model.is_control(i) or self.model.is_unknown(i):
            return b""
        return self.names[i].replace(SPACE, " ").encode()

    def glued(self, white: frozenset[str]) -> str:
        """White space that some token holds after its first character, so that no piece may begin there."""
        if any(SPACE in name.lstrip(SPACE) for name in self.names):
            raise ValueError("this model's tokens go on across spaces")
        return "".join(sorted(w for w in white if any(w in name[1:] for name in self.names)))

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, ids a piece)."""
        # The added space stands for that of the piece; other white space does not merge with it, it is cut off again.
        own = [p[0] == " " for p in pieces]
        codes = self.model.encode([p[1:] if o else p for p, o in zip(pieces, own)], num_threads=1)
        codes = [c or [self.space] if o else c[1:] for c, o in zip(codes, own)]
        sizes = np.fromiter(map(len, codes), np.int64, len(codes))
        return np.fromiter(chain.from_iterable(codes), np.int64, int(sizes.sum())), sizes


def _edges(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])


def _gives_back(model, ids: np.ndarray, n: np.ndarray, raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Of each piece whether the bytes of its ``n`` tokens are its own, those of ``raw`` between neighbouring edges."""
    sizes = np.diff(edges)
    same = np.diff(_edges(model.sizes[ids])[_edges(n)]) == sizes
    got = b"".join(map(model.tokens.__getitem__, ids[np.repeat(same, n)].tolist()))
    wrong = _edges(np.frombuffer(got, np.uint8) != raw[np.repeat(same, sizes)])
    same[same] = np.diff(wrong[_edges(sizes[same])]) == 0
    return same


class _Numbers(dict):
    """Piece -> number, in order; a piece that is not there is added and waits to be learnt."""

    def __init__(self, pieces: list[str]):
        super().__init__(zip(pieces, range(len(pieces))))
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


class Aligner:
    """Aligns pieces and keeps what it found: groups as text, counts, and distinct id pairs with their links."""

    def __init__(self, models: Models):
        self.a, self.b = _ByteModel(models.byte_json), _PieceModel(models.piece_model)
        glue = re.escape(self.b.glued(self.a.white))
        go_on = f"(?:[{glue}][{WHITE}]*[^{WHITE}]*)*" if glue else ""
        self.pieces = re.compile(f"[{WHITE}]*[^{WHITE}]+{go_on}|[{WHITE}]+").findall
        self.cut = re.compile(f"(?<=[^{WHITE}])[{WHITE}]" if not glue else f"(?<=[^{WHITE}])(?![{glue}])[{WHITE}]")
        self.size_b = len(self.b.tokens)
        names_a, names_b = ([str(i).encode() for i in range(len(m.tokens))] for m in (self.a, self.b))
        # A token's text by its id, then that of a group's last token; those of B after those of A.
        texts = [n + e for names, ends in ((names_a, b",|"), (names_b, b",;")) for e in (ends[:1], ends[1:]) for n in names]
        self.texts = np.array(texts, object)
        self.known, self.groups, self.chars = _Numbers([]), [], 0
        self.counts, self.used = np.zeros((0, 5), np.int64), np.zeros(0, np.int64)
        self.indptr, self.keys, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keeps the short pieces that were used most often, at least twice, up to half of the table."""
        pieces = list(self.known)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        keep = np.flatnonzero((self.used > 1) & (sizes <= MOST_PIECE_CHARS))
        keep = keep[np.argsort(-self.used[keep], kind="stable")]
        keep = np.sort(keep[np.cumsum(sizes[keep]) <= MOST_CHARS // 2][: MOST_PIECES // 2])
        self.known, self.chars = _Numbers([pieces[k] for k in keep.tolist()]), int(sizes[keep].sum())
        self.groups = [self.groups[k] for k in keep.tolist()]
        at, count = self._places(keep)
        self.keys, self.links, self.indptr = self.keys[at], self.links[at], _edges(count)
        # What was frequent long ago gives way to what is now.
        self.counts, self.used = self.counts[keep], self.used[keep] // 2

    def _places(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of all pairs of these pieces, pairs a piece)."""
        count = np.diff(self.indptr)[numbers]
        start = self.indptr[numbers] - np.cumsum(count) + count
        return np.repeat(start, count) + np.arange(int(count.sum())), count

    def slices(self, text: str) -> Iterator[str]:
        """A space and the text, in slices that end between pieces."""
        text, begin = " " + text, 0
        while len(text) - begin > SLICE_CHARS:
            found = self.cut.search(text, begin + SLICE_CHARS)
            if not found:
                break
            yield text[begin : found.start()]
            begin = found.start()
        yield text[begin:] if begin else text

    def learn(self, pieces: list[str]) -> None:
        """Adds distinct pieces, those that got the next numbers."""
        if not pieces:
            return
        size, text = len(pieces), "".join(pieces)
        raw = np.frombuffer(text.encode(), np.uint8)
        first = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        edges = first[_edges(np.fromiter(map(len, pieces), np.int64, size))]
        a, n_a = self.a(pieces, edges)
        b, n_b = self.b(pieces)
        whole = _gives_back(self.a, a, n_a, raw, edges) & _gives_back(self.b, b, n_b, raw, edges)
        a, b = a[np.repeat(whole, n_a)], b[np.repeat(whole, n_b)]
        n_a, n_b = n_a * whole, n_b * whole
        link_a, link_b, _ = overlap_links(self.a.sizes[a], self.b.sizes[b])
        of_a, of_b = token_groups(link_a, link_b, len(a), len(b))
        n = int(of_a[-1]) + 1 if len(of_a) else 0
        piece_of_group = np.zeros(n, np.int64)
        piece_of_group[of_a] = np.repeat(np.arange(size), n_a)
        in_a, in_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
        total = np.bincount(piece_of_group, weights=in_a * in_b, minlength=size)
        counts = [n_a, n_b, np.bincount(piece_of_group, minlength=size), total, ~whole]
        self.counts = np.concatenate([self.counts, np.stack(counts, axis=1).astype(np.int64)])
        self.used = np.concatenate([self.used, np.zeros(size, np.int64)])
        self._add_pairs(size, piece_of_group, of_a, a, of_b, b, n)
        self.groups += self._texts(a, of_a, b, of_b, n_a + n_b)
        self.chars += len(text)

    def _add_pairs(self, size, piece_of_group, of_a, a, of_b, b, n) -> None:
        found = [(np.zeros(0, np.int64),) * 3]
        for group, x, y, links in shared_links(of_a, a, of_b, b, n, self.size_b):
            block = merged(piece_of_group[group], x * self.size_b + y, links, size, len(self.a.tokens) * self.size_b)
            found.append((block.row_of(), block.indices, block.data))
        piece, key, links = (np.concatenate(column) for column in zip(*found))
        pairs = merged(piece, key, links, size, len(self.a.tokens) * self.size_b)
        self.indptr = np.concatenate([self.indptr, self.indptr[-1] + pairs.indptr[1:]])
        self.keys, self.links = np.concatenate([self.keys, pairs.indices]), np.concatenate([self.links, pairs.data])

    def _texts(self, a, of_a, b, of_b, sizes) -> list[bytes]:
        """The groups of each piece as a1,a2|b1;a3|b2,b3; -- with the last separator."""
        last_a = np.append(of_a[1:] != of_a[:-1], True) if len(of_a) else np.zeros(0, bool)
        last_b = np.append(of_b[1:] != of_b[:-1], True) if len(of_b) else np.zeros(0, bool)
        which = np.zeros(len(a) + len(b), np.int64)
        # A group's A tokens stand before its B tokens.
        which[np.arange(len(a)) + np.searchsorted(of_b, of_a, "left")] = a + last_a * len(self.a.tokens)
        which[np.arange(len(b)) + np.searchsorted(of_a, of_b, "right")] = (
            2 * len(self.a.tokens) + b + last_b * len(self.b.tokens)
        )
        out, ends = self.texts[which].tolist(), _edges(sizes).tolist()
        return [b"".join(out[begin:end]) for begin, end in zip(ends, ends[1:])]

    def __call__(self, slices: list[str]) -> list[np.ndarray]:
        """The numbers of each slice's pieces; all are known until the next call."""
        if len(self.known) > MOST_PIECES or self.chars > MOST_CHARS:
            self.forget()
        number, numbers = self.known.__getitem__, []
        for s in slices:
            some = self.pieces(s)
            numbers.append(np.fromiter(map(number, some), np.int64, len(some)))
        new, self.known.new = self.known.new, []
        self.learn(new)
        if numbers:
            self.used += np.bincount(np.concatenate(numbers), minlength=len(self.known))
        return numbers

    def pairs(self, numbers: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, pair, links) of pieces, distinct by doc and pair and sorted."""
        at, count = self._places(numbers)
        return _distinct(np.repeat(doc, count), self.keys[at], self.links[at], len(self.a.tokens) * self.size_b)


def _distinct(doc, key, links, keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both = doc * np.int64(keys) + key
    order = np.argsort(both, kind="stable")
    both, links = both[order], links[order]
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    links = np.add.reduceat(links, first) if len(first) else links
    return both[first] // keys, both[first] % keys, links


@dataclass
class Aligned:
    """One document: counts of tokens, groups and links, and its groups as text or as a digest."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    broken: bool = False
    text: list[bytes] | None = None
    digest: object | None = None


def _documents(aligner: Aligner, texts: list[str | None], as_text: bool) -> Iterator[tuple[Aligned, tuple | None]]:
    """Every document with (pair, links); documents are read together up to BATCH_CHARS, long ones in slices."""
    docs = [Aligned(text=[] if as_text else None, digest=None if as_text else hashlib.sha256()) for _ in texts]
    held: list[tuple] = []
    waiting: list[tuple[int, str]] = []
    begin, keys = 0, len(aligner.a.tokens) * aligner.size_b

    def read() -> None:
        numbers = aligner([s for _, s in waiting])
        groups = aligner.groups
        for (k, _), n in zip(waiting, numbers):
            doc, sums = docs[k], aligner.counts[n].sum(axis=0).tolist()
            text = b"".join(map(groups.__getitem__, n.tolist()))[:-1]
            if text and doc.n_groups:
                text = b";" + text
            doc.text.append(text) if as_text else doc.digest.update(text)
            doc.n_a, doc.n_b, doc.n_groups, doc.n_links = (
                x + y for x, y in zip((doc.n_a, doc.n_b, doc.n_groups, doc.n_links), sums)
            )
            doc.broken |= bool(sums[4])
        which = np.repeat([k for k, _ in waiting], [len(n) for n in numbers]).astype(np.int64)
        held.append(aligner.pairs(np.concatenate(numbers), which) if numbers else (np.zeros(0, np.int64),) * 3)
        waiting.clear()

    def done(upto: int) -> Iterator[tuple[Aligned, tuple | None]]:
        nonlocal begin
        doc, key, links = (np.concatenate(c) for c in zip(*held)) if held else (np.zeros(0, np.int64),) * 3
        held.clear()
        doc, key, links = _distinct(doc, key, links, keys)
        edges = np.searchsorted(doc, np.arange(begin, upto + 1))
        for k, a, b in zip(range(begin, upto), edges, edges[1:]):
            one, docs[k] = docs[k], None
            yield one, None if one.broken else (key[a:b], links[a:b])
        begin = upto

    chars = 0
    for k, text in enumerate(texts):
        for part in aligner.slices(text) if text else ():
            waiting.append((k, part))
            chars += len(part)
            if chars >= BATCH_CHARS:
                read()
                chars = 0
                if sum(len(h[0]) for h in held) > MOST_HELD:
                    held[:] = [_distinct(*(np.concatenate(c) for c in zip(*held)), keys)]
        if chars == 0:
            yield from done(k + 1)
    read()
    yield from done(len(texts))


def _cut(raw: np.ndarray, sizes: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """The bytes of the values between neighbouring edges."""
    upto = np.concatenate([[0], np.cumsum(sizes)])[edges].tolist()
    whole = raw.tobytes()
    return [whole[a:b] for a, b in zip(upto, upto[1:])]


_PART = pa.schema(
    [("part", pa.int64()), ("doc_id", pa.int64())]
    + [(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string()), ("places", pa.binary()), ("links", pa.binary())]
    + [("place", pa.int64()), ("pair", pa.int64()), ("docs", pa.int64())]
)
_PART_KIND = (
    "part long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "places binary, links binary, place long, pair long, docs long"
)


class _Part:
    """Documents whose pairs are numbered together; frequent pairs have small numbers."""

    def __init__(self, part: int):
        self.part, self.rows, self.pairs, self.links, self.bytes = part, [], [], [], 0

    def add(self, doc_id: int | None, doc: Aligned, found: tuple | None, size: int) -> None:
        ok = found is not None and doc.n_groups > 0
        row = {n: getattr(doc, n) if ok else 0 for n in ("n_a", "n_b", "n_groups", "n_links")}
        self.rows.append({"part": self.part, "doc_id": doc_id, **row, "groups_sha256": doc.digest.hexdigest() if ok else ""})
        none = np.zeros(0, np.int64)
        self.pairs.append(found[0] if ok else none)
        self.links.append(found[1] if ok else none)
        self.bytes += size

    def batches(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        edges = np.cumsum([0, *map(len, self.pairs)])
        pairs, place, docs = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        order = np.argsort(-docs, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        links = np.concatenate(self.links)
        several = links > 1
        # A place is followed by its number of links only where that is not 1; the lowest bit says so.
        places = _cut(*varint(rank[place] * 2 + several), edges)
        counts = _cut(*varint(links[several]), np.concatenate([[0], np.cumsum(several)])[edges])
        for row, a, b in zip(self.rows, places, counts):
            row |= {"places": a, "links": b}
        for begin in range(0, len(self.rows), 2000):
            yield pa.RecordBatch.from_pylist(self.rows[begin : begin + 2000], schema=_PART)
        for begin in range(0, len(order), 100_000):
            some = order[begin : begin + 100_000]
            own = {"part": pa.array(np.full(len(some), self.part)), "place": pa.array(np.arange(begin, begin + len(some)))}
            own |= {"pair": pa.array(pairs[some]), "docs": pa.array(docs[some].astype(np.int64))}
            columns = [own[f.name] if f.name in own else pa.nulls(len(some), f.type) for f in _PART]
            yield pa.RecordBatch.from_arrays(columns, schema=_PART)


_made: dict[str, Aligner] = {}


def _aligner(shipped) -> Aligner:
    """One aligner per worker."""
    models = shipped.value
    if models.digest not in _made:
        _made.clear()
        _made[models.digest] = Aligner(models)
    return _made[models.digest]


def _sized(batch: pa.RecordBatch) -> list[int]:
    return [len(v.as_buffer() or b"") if v.is_valid else 0 for v in batch.column("text")]


def with_groups(docs: DataFrame, models: Models) -> DataFrame:
    """``docs`` (text, ...) with n_a, n_b, n_groups, n_links and groups, the ids as a1,a2|b1;a3|b2,b3."""
    prepare(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(models)
    names = ("n_a", "n_b", "n_groups", "n_links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shipped)
        for batch in batches:
            found = [d for d, _ in _documents(aligner, batch.column("text").to_pylist(), True)]
            added = {n: pa.array([0 if d.broken else getattr(d, n) for d in found], pa.int64()) for n in names}
            texts = ["" if d.broken else b"".join(d.text).decode() for d in found]
            yield replaced(batch, added | {"groups": pa.array(texts, pa.string())})

    return docs.mapInArrow(run, with_fields(docs.schema, [(n, LongType()) for n in names] + [("groups", StringType())]))


def _parts(docs: DataFrame, models: Models) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, number = _aligner(shipped), TaskContext.get().partitionId() << 32
        part = _Part(number)
        for batch in batches:
            ids, sizes = batch.column("doc_id").to_pylist(), _sized(batch)
            found = _documents(aligner, batch.column("text").to_pylist(), False)
            for doc_id, size, (doc, pairs) in zip(ids, sizes, found):
                part.add(doc_id, doc, pairs, size)
                if part.bytes >= PART_BYTES:
                    yield from part.batches()
                    part = _Part(part.part + 1)
        yield from part.batches()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PART_KIND)


_RESULT = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    + [("groups_sha256", pa.string())]
)


def _summed(docs: pa.Table, known: pa.Table) -> pa.Table:
    """n_best and count_sum of a part's documents from the counts of its pairs."""
    count, best = np.zeros(known.num_rows, np.int64), np.zeros(known.num_rows, np.int64)
    place = known.column("place").to_numpy()
    count[place], best[place] = known.column("n").to_numpy(), known.column("is_best").to_numpy()
    raw = docs.column("places").to_pylist()
    coded = read_varint(np.frombuffer(b"".join(raw), np.uint8))
    links = np.ones(len(coded), np.int64)
    several = coded & 1 == 1
    links[several] = read_varint(np.frombuffer(b"".join(docs.column("links").to_pylist()), np.uint8))
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(b"".join(raw), np.uint8) < 0x80)])
    edges = ends[np.cumsum([0, *map(len, raw)])]
    out = {n: docs.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    for name, value in (("n_best", best), ("count_sum", count)):
        upto = np.concatenate([[0], np.cumsum(value[coded >> 1] * links)])
        out[name] = pa.array(upto[edges[1:]] - upto[edges[:-1]])
    return pa.table([out[f.name] for f in _RESULT], schema=_RESULT)


def align_corpus(docs: DataFrame, models: Models) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    The count of an id pair is the number of documents in which it is linked. n_best counts the links whose pair has
    the highest count of its A id, count_sum adds up the counts of all links. groups_sha256 is the digest of the
    groups as ``with_groups`` writes them, empty for a document without tokens.
    """
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    size_b = _size_b(models)
    parts = stored(_parts(docs, models), "aligned")
    pairs = parts.where("pair is not null").select("part", "place", "pair", "docs")
    counts = stored(pairs.groupBy("pair").agg(F.sum("docs").alias("n")), "pair-counts")
    counts = counts.withColumn("a", F.floor(F.col("pair") / size_b))
    # At most one row per id of A.
    best = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("most")))
    counts = counts.join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("is_best"))
    known = pairs.join(counts, "pair").select(F.col("part").alias("known_part"), "place", "n", "is_best")
    rows = parts.where("pair is null").drop("place", "pair", "docs")
    kind = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("part").cogroup(known.groupBy("known_part")).applyInArrow(_summed, kind)


@lru_cache
def _size_b(models: Models) -> int:
    return len(_PieceModel(models.piece_model).tokens)
