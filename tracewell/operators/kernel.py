"""Score Arrow batches of chunks against a shipped block of queries.

Spark counts terms and buckets inside each chunk row and partitions the work; a task turns slices of its
batches and tiles of the queries into score matrices, keeps the best k chunks per query over all of them and
returns those once at its end.  Terms that many pairs share are multiplied as matrices, the entries of the others
are joined.  Neither chunk rows nor query-chunk pairs are ever shuffled.  Sums over all candidates are added up in the
same matrices: per query over the task, or per chunk over the block.

Blocks of many queries meet groups of chunks with similar possible scores first: the largest weights in a group bound
the score of each of its chunks, and only groups whose bound reaches a query's floor are scored chunk by chunk for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from time import perf_counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Scores, and term entries, held at a time by one task.
SLICE_CELLS = 1_000_000
# Queries scored at a time.
TILE_QUERIES = 1024
# A product in a matrix costs about this part of a product found by joining entries; matrices have so many terms at most.
DENSE_SHARE = 1000
DENSE_TERMS = 4096
# Blocks of so many queries are compared with groups of chunks first.
GROUPED_QUERIES = 1024
# Term entries of a group: the first number, and the least and the most. A worker takes larger groups where their bounds
# took most of its time, and smaller ones where the scores inside did; neither changes what is found.
GROUP_ENTRIES = [2000]
GROUP_RANGE = 500, 50_000
# Term entries of the chunks that are grouped together, and pairs of a query and a group that wait to be scored.
SLAB_ENTRIES = 2_000_000
HELD_PAIRS = 1_000_000


@dataclass
class QueryBlock:
    """Queries of one block as arrays; its size was measured before it was collected."""

    ids: pa.Array
    vocabulary: pa.Array
    starts: np.ndarray  # postings of term t are starts[t]:starts[t + 1]
    members: np.ndarray  # query position per posting
    counts: np.ndarray  # query count per posting
    ranks: np.ndarray  # place of each term in sorted order
    vectors: np.ndarray | None = None  # (queries, dims)
    norms: np.ndarray | None = None
    tops: np.ndarray | None = None  # best keyword and vector score per query
    floors: np.ndarray | None = None  # a keyword score that k chunks reach, per query


def collect_block(queries: DataFrame, dims: int = 0) -> QueryBlock:
    """Arrays of ``queries``: query_id, terms (term, cnt) and, with ``dims``, buckets and norm; floor where there is one."""
    return block_of(queries.toArrow().combine_chunks(), dims)


def block_of(table: pa.Table | pa.RecordBatch, dims: int = 0) -> QueryBlock:
    ids = _column(table, "query_id")
    terms = _column(table, "terms")
    parents = pc.list_parent_indices(terms).to_numpy()
    items = terms.flatten()
    coded = items.field("term").dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    order = np.argsort(codes, kind="stable")
    starts = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
    block = QueryBlock(
        ids, coded.dictionary, starts, parents[order].astype(np.int64),
        items.field("cnt").to_numpy().astype(np.float64)[order],
        np.argsort(pc.sort_indices(coded.dictionary).to_numpy()),
    )
    if dims:
        block.vectors = _matrix(table, dims)
        block.norms = _norms(block.vectors)
    if "floor" in table.schema.names:
        block.floors = _column(table, "floor").to_numpy()
    return block


def collect_vectors(queries: DataFrame, dims: int) -> QueryBlock:
    """The same for queries that have a vector and no terms."""
    table = queries.toArrow().combine_chunks()
    none = np.zeros(0, np.int64)
    vectors = _matrix(table, dims)
    ids = _column(table, "query_id")
    return QueryBlock(ids, pa.array([], pa.string()), np.zeros(1, np.int64), none, none, none, vectors, _norms(vectors))


def _norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=1))


def _matrix(table: pa.Table | pa.RecordBatch, dims: int) -> np.ndarray:
    """Rows of the column vector (null: zeros), or of the sparse column buckets."""
    if "vector" not in table.schema.names:
        return _dense(_column(table, "buckets"), dims)
    column = _column(table, "vector")
    out = np.zeros((len(column), dims))
    values = column.flatten().to_numpy(zero_copy_only=False)
    out[pc.is_valid(column).to_numpy(zero_copy_only=False)] = values.reshape(-1, dims)
    return out


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _dense(buckets: pa.ListArray, dims: int) -> np.ndarray:
    out = np.zeros((len(buckets), dims))
    items = buckets.flatten()
    out[pc.list_parent_indices(buckets).to_numpy(), items.field("bucket").to_numpy()] = items.field("weight").to_numpy()
    return out


def _terms(batch: pa.RecordBatch, block: QueryBlock) -> ChunkTerms:
    """The term entries of a batch that the queries know."""
    none = np.zeros(0, np.int64)
    if "terms" not in batch.schema.names:
        return ChunkTerms(none, none, np.zeros(0), np.zeros(0))
    terms = batch.column("terms")
    items = terms.flatten()
    codes = pc.index_in(items.field("term"), value_set=block.vocabulary)
    found = pc.is_valid(codes).to_numpy(zero_copy_only=False)
    return ChunkTerms(
        codes.filter(pa.array(found)).to_numpy().astype(np.int64),
        pc.list_parent_indices(terms).to_numpy()[found].astype(np.int64),
        items.field("weight").to_numpy()[found],
        items.field("bonus").to_numpy()[found],
    )


def _slices(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """Row ranges whose term entries and ``width`` scores a row stay below the cell limit, in the order of their ids."""
    n = batch.num_rows
    cost = np.full(n, width, dtype=np.int64)
    if "terms" in batch.schema.names:
        cost += pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy(zero_copy_only=False)
    total, start = 0, 0
    for i in range(n + 1):
        if i == n or (total and total + cost[i] > SLICE_CELLS):
            if i > start:
                part = batch.slice(start, i - start)
                yield part.take(pc.sort_indices(part.column("chunk_id")))
            total, start = 0, i
        if i < n:
            total += cost[i]


@dataclass
class ChunkTerms:
    """Term entries of the chunks of a slice: vocabulary code, chunk row, weight and bonus of each."""

    code: np.ndarray
    row: np.ndarray
    weight: np.ndarray
    bonus: np.ndarray

    def keys(self, size: int) -> np.ndarray:
        """Sorted (row, code) pairs of a vocabulary of ``size`` terms, each as one number."""
        return np.sort(self.row * size + self.code)


class Tiles:
    """The queries of a block in runs of neighbours, with the term entries of each run by term."""

    def __init__(self, block: QueryBlock):
        self.block, queries, size = block, len(block.ids), len(block.vocabulary)
        self.width = max(1, min(TILE_QUERIES, SLICE_CELLS, queries))
        self.edges = [(a, min(a + self.width, queries)) for a in range(0, queries, self.width)]
        code = np.repeat(np.arange(size, dtype=np.int32), np.diff(block.starts))
        order = np.argsort(block.members // self.width, kind="stable")
        self.code, self.member, self.count = code[order], block.members[order], block.counts[order]
        self.cuts = np.searchsorted(self.member // self.width, np.arange(len(self.edges) + 1))
        # The sorted terms of each query, for the shared ones of the winners.
        order = np.lexsort((block.ranks[code], block.members))
        self.sorted_code, self.sorted_count = code[order], block.counts[order]
        self.first = np.searchsorted(block.members[order], np.arange(queries + 1))

    def keyword_scores(self, tile: int, terms: ChunkTerms, n: int) -> np.ndarray:
        """(queries of the tile, chunks) matrix of count * weight + bonus over the shared terms.

        Counts, weights and bonuses are integers, whose sums are exact in single precision below 2**24.
        """
        a, b = self.edges[tile]
        part = slice(self.cuts[tile], self.cuts[tile + 1])
        code, query, count = self.code[part], self.member[part] - a, self.count[part]
        most = np.bincount(query, weights=count, minlength=1).max() * 2 * (terms.weight + terms.bonus).max(initial=0)
        whole = all(np.array_equal(v, np.rint(v)) for v in (terms.weight, terms.bonus))
        out = np.zeros((b - a, n), np.float32 if whole and most < 1 << 24 else np.float64)
        size = len(self.block.vocabulary)
        _add_product(out, size, (code, query, count), (terms.code, terms.row, terms.weight + terms.bonus))
        # A bonus counts once for each term, however often the query has it.
        again, extra = count != 1, terms.bonus != 0
        _add_product(
            out, size, (code[again], query[again], count[again] - 1),
            (terms.code[extra], terms.row[extra], -terms.bonus[extra]),
        )
        return out

    def shared_terms(self, q: np.ndarray, c: np.ndarray, keys: np.ndarray) -> pa.ListArray:
        """Codes of the sorted shared terms of the chosen queries and chunks; ``keys`` are those of the chunks."""
        size, found, lengths = len(self.block.vocabulary), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        ends = np.cumsum(self.first[q + 1] - self.first[q])
        pieces = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, max(1, SLICE_CELLS))))
        for a, b in zip(pieces, [*pieces[1:], len(q)]):
            at, owner = _runs(self.first[q[a:b]], self.first[q[a:b] + 1])
            code = self.sorted_code[at]
            sought = c[a:b][owner] * size + code
            place = np.searchsorted(keys, sought)
            held = place < len(keys)
            held[held] = keys[place[held]] == sought[held]
            found.append(code[held])
            lengths.append(np.bincount(owner[held], minlength=b - a))
        lengths = np.concatenate(lengths)
        if len(lengths) < len(q):  # none of the queries has a term
            lengths = np.zeros(len(q), np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found), pa.int32()))


def _runs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, owners): first[i], first[i] + 1, ... below last[i] of every i, one after the other."""
    length = last - first
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - length - first, length), np.repeat(np.arange(len(first)), length)


def _add_product(out: np.ndarray, size: int, queries: tuple, chunks: tuple) -> None:
    """Add to ``out`` the products of the (term, place, value) entries of both sides that have the same term.

    Terms that many pairs share go through dense matrices; the entries of the others are joined.
    """
    (qcode, query, qvalue), (ccode, row, cvalue) = queries, chunks
    if not len(qcode) or not len(ccode):
        return
    held = np.bincount(qcode, minlength=size)
    pairs = held * np.bincount(ccode, minlength=size)
    dense = np.flatnonzero(pairs * DENSE_SHARE > out.size)
    if len(dense) > DENSE_TERMS:
        dense = np.sort(dense[np.argpartition(-pairs[dense], DENSE_TERMS)[:DENSE_TERMS]])
    place = np.full(size, -1, np.int32)
    place[dense] = np.arange(len(dense))
    if len(dense):
        left, right = np.zeros((out.shape[0], len(dense)), out.dtype), np.zeros((len(dense), out.shape[1]), out.dtype)
        at = place[qcode]
        left[query[at >= 0], at[at >= 0]] = qvalue[at >= 0]
        at = place[ccode]
        right[at[at >= 0], row[at >= 0]] = cvalue[at >= 0]
        out += left @ right
    rest = (place[ccode] < 0) & (held[ccode] > 0)
    ccode, row, cvalue = ccode[rest], row[rest], cvalue[rest]
    starts = np.cumsum(held) - held
    ends = np.cumsum(held[ccode])
    pieces = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, max(1, SLICE_CELLS))))
    flat = out.reshape(-1)
    for a, b in zip(pieces, [*pieces[1:], len(ccode)]):
        at, owner = _runs(starts[ccode[a:b]], starts[ccode[a:b]] + held[ccode[a:b]])
        cell, value = query[at] * out.shape[1] + row[a:b][owner], qvalue[at] * cvalue[a:b][owner]
        if len(cell) * 8 > out.size:
            flat += np.bincount(cell, weights=value, minlength=out.size).astype(out.dtype, copy=False)
        else:
            np.add.at(flat, cell, value.astype(out.dtype))


def vector_scores(chunk: np.ndarray, block: QueryBlock, a: int, b: int, rounded: bool) -> np.ndarray:
    """(queries a to b, chunks) matrix of cosines.

    Integer counts keep the dot products of buckets exact; cosines of supplied vectors are rounded
    to 9 digits, so that equal vectors tie whatever batch they are in.
    """
    scale = np.outer(block.norms[a:b], _norms(chunk))
    dot = block.vectors[a:b] @ chunk.T
    out = np.divide(dot, scale, out=np.zeros_like(dot), where=scale > 0)
    return np.round(out, 9) if rounded else out


def best_cells(
    scores: np.ndarray, k: int, floor: np.ndarray | None = None, above: float = 0.0
) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k best scores per query over ``above`` that reach ``floor``, ties to the earlier chunk."""
    n = scores.shape[1]
    least = np.full(len(scores), above) if floor is None else floor
    chosen = (scores >= least[:, None]) & (scores > above)
    # The floors of a long run leave few cells; only where they do not are the best of every row looked for.
    if n > k and np.count_nonzero(chosen) > 2 * k * len(scores):
        chosen &= scores >= np.partition(scores, n - k, axis=1)[:, n - k][:, None]
    q, c = np.nonzero(chosen)
    order = np.lexsort((c, -scores[q, c], q))
    q, c = q[order], c[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return q[keep], c[keep]


class RunningBest:
    """The k best rows per query of everything a task has seen so far."""

    def __init__(self, queries: int, k: int, above: float = 0.0):
        self.k, self.floor, self.held, self.rows = k, np.full(queries, above), [], 0
        self.limit = max(10_000, 2 * queries * k)

    def add(self, rows: pa.Table) -> None:
        self.held.append(rows)
        self.rows += rows.num_rows
        if self.rows > self.limit:
            self.prune()

    def prune(self) -> pa.Table | None:
        if not self.held:
            return None
        rows = pa.concat_tables(self.held)
        keys = [("query", "ascending"), ("score", "descending"), ("chunk_id", "ascending")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=keys))
        q = rows.column("query").to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        full = place == self.k - 1
        self.floor[q[full]] = rows.column("score").to_numpy()[full]
        rows = rows.filter(pa.array(place < self.k))
        self.held, self.rows = [rows], rows.num_rows
        return rows


def floors(shipped, k: int):
    """Function for ``mapInArrow`` over queries: adds ``floor``, the k-th best keyword score among some shipped chunks."""

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: pa.RecordBatch = shipped.value
        for batch in batches:
            block = block_of(batch)
            tiles = Tiles(block)
            best = np.zeros((batch.num_rows, k))
            for part in _slices(head, tiles.width):
                terms = _terms(part, block)
                for tile, (a, b) in enumerate(tiles.edges):
                    both = np.hstack([best[a:b], tiles.keyword_scores(tile, terms, part.num_rows)])
                    best[a:b] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            # Sums of fractions depend on their order by less than this.
            yield batch.append_column("floor", pa.array(best.min(axis=1, initial=np.inf) * (1 - 1e-9)))

    return lowest


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold enough term entries, in the order of their ids."""

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        slab = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return slab.take(pc.sort_indices(slab.column("chunk_id")))

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += pc.sum(pc.list_value_length(batch.column("terms"))).as_py() or 0
        if size >= SLAB_ENTRIES:
            yield joined(held)
            held, size = [], 0
    if held:
        yield joined(held)


class Groups:
    """The chunks of a slab in groups of similar possible scores, with the largest value of each term in a group."""

    def __init__(self, terms: ChunkTerms, rows: int, size: int):
        self.terms, self.size, value = terms, size, terms.weight + terms.bonus
        self.starts = np.searchsorted(terms.row, np.arange(rows + 1))
        entries = np.diff(self.starts)
        order = np.argsort(-np.bincount(terms.row, weights=value, minlength=rows), kind="stable")
        order = order[entries[order] > 0]
        ends = np.cumsum(entries[order])
        _, number = np.unique((ends - entries[order]) // int(GROUP_ENTRIES[0]), return_inverse=True)
        self.count = int(number[-1]) + 1 if len(number) else 0
        self.rows = np.split(order, np.flatnonzero(np.diff(number)) + 1)
        group = np.zeros(rows, np.int64)
        group[order] = number
        key = group[terms.row] * size + terms.code
        if np.array_equal(value, np.rint(value)) and 0 <= value.min(initial=0) and value.max(initial=0) < 16:
            both = np.sort(key << 4 | value.astype(np.int64))
            key, value = both >> 4, (both & 15).astype(np.float64)
        else:
            at = np.lexsort((value, key))
            key, value = key[at], value[at]
        last = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]])) if len(key) else np.zeros(0, np.int64)
        self.group, self.code, self.value = key[last] // size, key[last] % size, value[last]
        self.edges = np.searchsorted(self.group, np.arange(self.count + 1))

    def bounds(self, tiles: Tiles, tile: int) -> np.ndarray:
        """(queries of the tile, groups) matrix that no score of a chunk of the group exceeds.

        A bonus counts as often as the query has the term, which is at least once.
        """
        a, b = tiles.edges[tile]
        part = slice(tiles.cuts[tile], tiles.cuts[tile + 1])
        code, query, count = tiles.code[part], tiles.member[part] - a, tiles.count[part]
        most = np.bincount(query, weights=count, minlength=1).max() * self.value.max(initial=0)
        whole = np.array_equal(self.value, np.rint(self.value)) and most < 1 << 24
        out = np.zeros((b - a, self.count), np.float32 if whole else np.float64)
        _add_product(out, self.size, (code, query, count), (self.code, self.group, self.value))
        return out if whole else out * (1 + 1e-9)

    def scores(self, tiles: Tiles, group: int, queries: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(queries, chunks of the group in the order of their ids) matrix of scores; ``place`` is -1 for all terms."""
        rows = np.sort(self.rows[group])
        known = self.code[self.edges[group] : self.edges[group + 1]]
        at, column = _runs(self.starts[rows], self.starts[rows + 1])
        code, weight, bonus = self.terms.code[at], self.terms.weight[at], self.terms.bonus[at]
        place[known] = np.arange(len(known))
        at, row = _runs(tiles.first[queries], tiles.first[queries + 1])
        asked, count = place[tiles.sorted_code[at]], tiles.sorted_count[at]
        held = asked >= 0
        asked, row, count = asked[held], row[held], count[held]
        out = np.zeros((len(queries), len(rows)))
        # A bonus counts once for each term, however often the query has it.
        again, extra = count != 1, bonus != 0
        for entries, values in (
            ((asked, row, count), (code, column, weight + bonus)),
            ((asked[again], row[again], count[again] - 1), (code[extra], column[extra], -bonus[extra])),
        ):
            (term, query, left), (own, chunk, right) = entries, values
            if not len(term) or not len(own):
                continue
            used = np.zeros(len(known), bool)
            used[term] = True
            to = np.cumsum(used) - 1
            own = place[own]
            shared = used[own]
            kind = np.float32 if np.array_equal(right, np.rint(right)) and _small(query, left, right) else np.float64
            b = np.zeros((int(used.sum()), len(rows)), kind)
            b[to[own[shared]], chunk[shared]] = right[shared]
            a = np.zeros((len(queries), len(b)), kind)
            a[query, to[term]] = left
            out += a @ b
        place[known] = -1
        return out


def _small(query: np.ndarray, left: np.ndarray, right: np.ndarray) -> bool:
    """Whether sums of whole products are exact in single precision."""
    return np.bincount(query, weights=left).max() * np.abs(right).max() < 1 << 24


def _grouped(batches: Iterator[pa.RecordBatch], block: QueryBlock, k: int) -> RunningBest:
    """The k best chunks per query by keyword score, scoring only groups whose bound reaches the query's floor."""
    tiles, best, size = Tiles(block), RunningBest(len(block.ids), k), len(block.vocabulary)
    if block.floors is not None:
        best.floor[:] = block.floors
    place = np.full(size, -1, np.int64)
    for part in _slabs(batches):
        terms = _terms(part, block)
        groups, found, waiting = Groups(terms, part.num_rows, size), [], []

        def settle() -> None:
            """Score the waiting pairs; keep what may be among the best of the slab."""
            if not waiting:
                return
            query, group = (np.concatenate(v) for v in zip(*waiting))
            waiting.clear()
            order = np.argsort(group, kind="stable")
            query, group = query[order], group[order]
            cuts = np.flatnonzero(np.diff(group, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(group)]):
                width = max(1, 2 * SLICE_CELLS // max(1, groups.edges[group[a] + 1] - groups.edges[group[a]]))
                for start in range(a, b, width):
                    some = query[start : min(b, start + width)]
                    scores = groups.scores(tiles, group[a], some, place)
                    q, c = best_cells(scores, k, best.floor[some])
                    found.append((some[q], np.sort(groups.rows[group[a]])[c], scores[q, c]))
            chosen = [np.concatenate(v) for v in zip(*found)]
            order = np.lexsort((chosen[1], -chosen[2], chosen[0]))
            query, row, score = (v[order] for v in chosen)
            rank = np.arange(len(query)) - np.searchsorted(query, query)
            full = rank == k - 1
            best.floor[query[full]] = np.maximum(best.floor[query[full]], score[full])
            keep = (rank < k) & (score >= best.floor[query])
            found[:] = [(query[keep], row[keep], score[keep])]

        pairs, spent, begun = 0, 0.0, perf_counter()
        for tile, (a, b) in enumerate(tiles.edges if groups.count else ()):
            bounds = groups.bounds(tiles, tile)
            query, group = np.nonzero((bounds >= best.floor[a:b, None]) & (bounds > 0))
            waiting.append((query + a, group))
            pairs += len(query)
            if pairs >= HELD_PAIRS or tile == len(tiles.edges) - 1:
                since = perf_counter()
                settle()
                pairs, spent = 0, spent + perf_counter() - since
        rest = perf_counter() - begun - spent
        if max(rest, spent) > 2 * min(rest, spent):
            GROUP_ENTRIES[0] = min(max(GROUP_ENTRIES[0] * (1.5 if rest > spent else 1 / 1.5), GROUP_RANGE[0]), GROUP_RANGE[1])
        if not found or not len(found[0][0]):
            continue
        query, row, score = found[0]
        columns = {
            "query": pa.array(query, pa.int64()),
            "chunk_id": part.column("chunk_id").take(pa.array(row, pa.int64())),
            "score": pa.array(score, pa.float64()),
            "matched_terms": tiles.shared_terms(query, row, terms.keys(size)),
        }
        best.add(pa.table(columns))
    return best


def scorer(shipped, mode: str, k: int, weights: tuple[float, float] = (1.0, 0.0)):
    """Function for ``mapInArrow``; ``mode`` is keyword, vector, hybrid or lists.

    ``lists`` keeps the k best by keyword (list 0) and the k best by vector (list 1), each with both scores.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: QueryBlock = shipped.value
        if mode == "keyword" and len(block.ids) >= GROUPED_QUERIES:
            rows = _grouped(batches, block, k).prune()
            for named in _named(rows, block) if rows is not None else ():
                yield from named.combine_chunks().to_batches()
            return
        tiles = Tiles(block)
        # A hybrid candidate has one positive score; its weighted sum may still be negative.
        above = -np.inf if mode == "hybrid" else 0.0
        kept = [RunningBest(len(block.ids), k, above) for _ in range(2 if mode == "lists" else 1)]
        for part in (part for whole in batches for part in _slices(whole, tiles.width)):
            n, terms = part.num_rows, _terms(part, block)
            keys = terms.keys(len(block.vocabulary))
            chunk = None if mode == "keyword" else _matrix(part, block.vectors.shape[1])
            for tile, (a, b) in enumerate(tiles.edges):
                keyword = vector = None
                if mode != "vector":
                    keyword = tiles.keyword_scores(tile, terms, n)
                if mode != "keyword":
                    vector = vector_scores(chunk, block, a, b, "vector" in part.schema.names)
                if mode == "hybrid":
                    scores = weights[0] * _share(keyword.astype(np.float64, copy=False), block.tops[a:b, 0])
                    scores += weights[1] * _share(vector, block.tops[a:b, 1])
                    scores[(keyword <= 0) & (vector <= 0)] = -np.inf
                else:
                    scores = vector if keyword is None else keyword
                for best, ranked in zip(kept, (keyword, vector) if mode == "lists" else (scores,)):
                    q, c = best_cells(ranked, k, best.floor[a:b], above)
                    if not len(q):
                        continue
                    columns = {
                        "query": pa.array(q + a, pa.int64()),
                        "chunk_id": part.column("chunk_id").take(pa.array(c, pa.int64())),
                        "score": pa.array(ranked[q, c].astype(np.float64), pa.float64()),
                        "matched_terms": tiles.shared_terms(q + a, c, keys),
                    }
                    if mode in ("hybrid", "lists"):
                        columns |= {"keyword_score": pa.array(keyword[q, c].astype(np.float64)), "vector_score": pa.array(vector[q, c])}
                    best.add(pa.table(columns))
        for number, best in enumerate(kept):
            rows = best.prune()
            best.held = []
            for named in _named(rows, block) if rows is not None else ():
                if mode == "lists":
                    named = named.append_column("list", pa.array(np.full(named.num_rows, number, np.int32)))
                yield from named.combine_chunks().to_batches()

    return score


def _named(rows: pa.Table, block: QueryBlock) -> Iterator[pa.Table]:
    """The kept rows with the ids of their queries and the texts of their terms, some at a time."""
    for start in range(0, rows.num_rows, 10_000):
        some = rows.slice(start, 10_000).combine_chunks()
        codes = _column(some, "matched_terms")
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(codes).to_numpy())]).astype(np.int32)
        shared = pa.ListArray.from_arrays(pa.array(offsets), block.vocabulary.take(codes.flatten()))
        ids = block.ids.take(_column(some, "query"))
        named = some.drop_columns(["query"]).add_column(0, "query_id", ids)
        yield named.set_column(named.schema.get_field_index("matched_terms"), "matched_terms", shared)


def totals(shipped, by: str):
    """Function for ``mapInArrow``: sums over all candidates, added up without making rows of them.

    ``by`` query: one row per query and task over the chunks with either score; ``by`` chunk: one row per chunk
    over the queries of the block with a keyword score.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: QueryBlock = shipped.value
        count = np.zeros(len(block.ids), np.int64)
        best, total = np.full((len(block.ids), 2), -np.inf), np.zeros((len(block.ids), 2))
        tiles = Tiles(block)
        for part in (part for whole in batches for part in _slices(whole, tiles.width)):
            n, terms = part.num_rows, _terms(part, block)
            if by == "query":
                chunk = _matrix(part, block.vectors.shape[1])
            hits, sums, most = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            for tile, (a, b) in enumerate(tiles.edges):
                keyword = tiles.keyword_scores(tile, terms, n)
                if by == "chunk":
                    hits += (keyword > 0).sum(axis=0)
                    sums += keyword.sum(axis=0, dtype=np.float64)
                    most = np.maximum(most, keyword.max(axis=0))
                    continue
                vector = vector_scores(chunk, block, a, b, "vector" in part.schema.names)
                either = (keyword > 0) | (vector > 0)
                count[a:b] += either.sum(axis=1)
                for i, scores in enumerate((keyword, vector)):
                    best[a:b, i] = np.maximum(best[a:b, i], np.where(either, scores, -np.inf).max(axis=1))
                    total[a:b, i] += np.where(either, scores, 0).sum(axis=1, dtype=np.float64)
            if by == "chunk":
                found = np.flatnonzero(hits)
                yield pa.record_batch(
                    [part.column("chunk_id").take(pa.array(found)), *(pa.array(v[found]) for v in (hits, sums, most))],
                    names=["chunk_id", "queries", "total", "best"],
                )
        if by == "query":
            found = np.flatnonzero(count)
            yield pa.record_batch(
                [block.ids.take(pa.array(found)), pa.array(count[found])]
                + [pa.array(values[found, n]) for values in (best, total) for n in (0, 1)],
                names=["query_id", "candidates", "best_keyword", "best_vector", "keyword_total", "vector_total"],
            )

    return add


def _share(scores: np.ndarray, top: np.ndarray) -> np.ndarray:
    return np.divide(scores, top[:, None], out=np.zeros_like(scores), where=top[:, None] > 0)
