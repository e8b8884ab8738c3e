"""Near-duplicate vectors: exact cosine links between vectors of one label, by PCA-ordered tiles.

Unit vectors are rotated so that the axes of largest spread come first. Links at a cosine of ``least``
are no farther apart than a chord, so vectors are laid into cells of that width along the first two axes
of their length (each length has its own axes) and only equal and neighbouring cells are compared. Cells are cut into tiles of at most about TILE vectors;
a pair of tiles is one unit of work of bounded size. Inside it products are accumulated over the leading
dimensions first; what the rest can add is at most the product of the norms of the rests, and pairs that cannot
reach ``least`` any more are left. Products near the threshold are taken again from the original vectors.

Equal vectors are compared once and counted by their number. A unit of work returns for each vector its number
of links and one edge of a spanning forest, never the pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components and rows with a null label
link with nothing; vectors of different lengths never link with each other; every input row gives one row; rows with equal id
are counted as two vectors; a null id is never a component's id and its rows link with nothing; an empty
table gives an empty result; columns beyond vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tracewell.llm.common import broadcast_if_bounded, prepare, stored
from tracewell.llm.components import components
from tracewell.llm.vectors import lengths, principal_axes, sample, usable

LEAST = 0.93
TILE = 2048
BLOCK = 512
STEPS = (8, 16, 32)
CLOSE = 1e-9


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine of two vectors in double precision with exactly rounded sums."""
    top = math.fsum((a * b).tolist())
    return top / (math.sqrt(math.fsum((a * a).tolist())) * math.sqrt(math.fsum((b * b).tolist())))


class Tile:
    """Original vectors of a tile, their unit forms along the axes, and the norms of what follows each step."""

    def __init__(self, raw: np.ndarray, axes: np.ndarray):
        self.raw = raw
        unit = raw / np.sqrt((raw * raw).sum(axis=1))[:, None]
        self.turned = unit @ axes
        width = raw.shape[1]
        self.cuts = [0, *(s for s in STEPS if s < width), width]
        squares = np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1]
        rest = np.concatenate([squares, np.zeros((len(raw), 1))], axis=1)
        self.rest = [np.sqrt(rest[:, c]) for c in self.cuts]


def tile_links(a: Tile, b: Tile, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``a`` and ``b`` with a cosine of ``least`` and more; for one tile with itself each pair once."""
    slack, cuts = CLOSE, a.cuts
    for i in range(0, len(a.raw), BLOCK):
        for j in range(i if same else 0, len(b.raw), BLOCK):
            rows, cols = slice(i, i + BLOCK), slice(j, j + BLOCK)
            part = a.turned[rows, : cuts[1]] @ b.turned[cols, : cuts[1]].T
            open_ = part + np.outer(a.rest[1][rows], b.rest[1][cols]) >= least - slack
            if same and i == j:
                open_ &= np.tri(*open_.shape, k=-1, dtype=bool)
            at, to = np.nonzero(open_)
            total, at, to = part[at, to], at + i, to + j
            for k in range(1, len(cuts) - 1):
                own = slice(cuts[k], cuts[k + 1])
                total = total + np.einsum("ij,ij->i", a.turned[at, own], b.turned[to, own])
                left = total + a.rest[k + 1][at] * b.rest[k + 1][to] >= least - slack
                at, to, total = at[left], to[left], total[left]
            linked = total >= least
            for k in np.flatnonzero(np.abs(total - least) <= slack):
                linked[k] = exact_cosine(a.raw[at[k]], b.raw[to[k]]) >= least
            yield at[linked], to[linked]


def _forest(n: int, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[at], root[to])
        new = root.copy()
        np.minimum.at(new, root[at], low)
        np.minimum.at(new, root[to], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _units(tiles: DataFrame) -> DataFrame:
    """Pairs of tiles to compare: equal cells and neighbours, each once. Lists of tiles only, no vectors."""
    tile = F.struct("label", "width", "x", "y", "sub")
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    ends = tiles.select("label", "width", "x", "y", "sub", F.explode(near).alias("to")).select(
        "label", "width", (F.col("x") + F.col("to.i")).alias("x"), (F.col("y") + F.col("to.j")).alias("y"), tile.alias("one")
    )
    both = ends.join(
        tiles.select("label", "width", "x", "y", F.col("sub").alias("other")), ["label", "width", "x", "y"]
    )
    other = F.struct("label", "width", "x", "y", F.col("other").alias("sub"))
    return both.select("one", other.alias("two")).where("one <= two")


def vector_links(vectors: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(links, edges) of distinct vectors (rep, label, vector, copies): rep, n_links; and a, b."""
    spark = vectors.sparkSession
    prepare(spark)
    axes = {}
    for width in lengths(vectors):
        rows = sample(vectors, width)
        axes[width] = principal_axes(rows / np.sqrt((rows * rows).sum(axis=1))[:, None], False)[1]
    reach = math.sqrt(2 * (1 - least)) + CLOSE
    shipped = spark.sparkContext.broadcast(axes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.list_value_length(whole.column("vector")).to_numpy(zero_copy_only=False)
            for width in np.unique(sizes).tolist():
                batch = whole.filter(pa.array(sizes == width))
                raw = np.array(batch.column("vector").flatten(), np.float64).reshape(-1, width)
                lead = (raw / np.sqrt((raw * raw).sum(axis=1))[:, None]) @ shipped.value[width][:, :2]
                cells = np.floor(lead / reach).astype(np.int32)
                x, y = cells[:, 0], cells[:, 1] if cells.shape[1] > 1 else np.zeros(len(cells), np.int32)
                own = pa.array(np.full(len(raw), width, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, own, pa.array(x.copy()), pa.array(y.copy())],
                    names=[*batch.schema.names, "width", "x", "y"],
                )

    doubles = vectors.select(
        "rep", "label", F.transform("vector", lambda v: v.cast("double")).alias("vector"), "copies"
    )
    kind = "rep long, label int, vector array<double>, copies long, width int, x int, y int"
    placed = stored(doubles.mapInArrow(place, kind), "placed-vectors")
    counts = placed.groupBy("label", "width", "x", "y").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("subs"))
    cut = placed.join(broadcast_if_bounded(counts), ["label", "width", "x", "y"])
    cut = cut.withColumn("sub", F.pmod(F.xxhash64("rep"), "subs")).drop("subs")

    def pack(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.argsort(group.column("rep").to_numpy(), kind="stable")))
        first = group.slice(0, 1).select(["label", "width", "x", "y", "sub"]).to_pylist()[0]
        raw = np.array(group.column("vector").combine_chunks().flatten(), np.float64)
        row = first | {n: group.column(n).to_numpy().tobytes() for n in ("rep", "copies")} | {"raw": raw.tobytes()}
        kinds = [("label", pa.int32()), ("width", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("sub", pa.int64())]
        return pa.Table.from_pylist([row], schema=pa.schema(kinds + [(n, pa.binary()) for n in ("rep", "copies", "raw")]))

    kind = "label int, width int, x int, y int, sub long, rep binary, copies binary, raw binary"
    tiles = stored(cut.groupBy("label", "width", "x", "y", "sub").applyInArrow(pack, kind), "vector-tiles")
    tile = F.struct("label", "width", "x", "y", "sub")
    blob = tiles.select(tile.alias("tile"), F.struct("rep", "copies", "raw").alias("blob"))
    units = _units(tiles.select("label", "width", "x", "y", "sub"))
    units = units.join(blob.select(F.col("tile").alias("one"), F.col("blob").alias("a")), "one")
    units = units.join(blob.select(F.col("tile").alias("two"), F.col("blob").alias("b")), "two")
    units = units.select((F.col("one") == F.col("two")).alias("same"), F.col("one.width").alias("width"), "a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                unit = batch.slice(k, 1).to_pylist()[0]
                yield _compare(unit, shipped.value[unit["width"]], least)

    found = stored(units.mapInArrow(compare, "rep long, n_links long, root long"), "vector-links")
    links = found.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    return links, found.select(F.col("rep").alias("a"), F.col("root").alias("b"))


def _compare(unit: dict, axes: np.ndarray, least: float) -> pa.RecordBatch:
    sides = []
    for name in ("a", "b"):
        side = unit[name]
        raw = np.frombuffer(side["raw"], np.float64).reshape(-1, len(axes))
        sides.append((Tile(raw, axes), np.frombuffer(side["rep"], np.int64), np.frombuffer(side["copies"], np.int64)))
    (a, ids_a, n_a), (b, ids_b, n_b) = sides
    shift = 0 if unit["same"] else len(ids_a)
    ids = ids_a if unit["same"] else np.concatenate([ids_a, ids_b])
    counts, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for at, to in tile_links(a, b, least, unit["same"]):
        np.add.at(counts, at, n_b[to])
        np.add.at(counts, to + shift, n_a[at])
        # What was connected before stands in as edges, so only one block of pairs is held.
        root = _forest(len(ids), np.concatenate([at, np.arange(len(ids))]), np.concatenate([to + shift, root]))
    hit = counts > 0
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[hit]), pa.array(counts[hit]), pa.array(ids[root[hit]])], names=["rep", "n_links", "root"]
    )


def near_duplicates(embeddings: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``embeddings`` (vec_id, embedding, label)."""
    rows = embeddings.select("vec_id", F.col("embedding").alias("vector"), "label")
    fits = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    good = rows.where(fits)
    reps = good.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = stored(reps, "vector-reps")
    links, edges = vector_links(reps, least)
    copies = reps.where("copies > 1").select(
        F.col("label").alias("of_label"), F.col("vector").alias("of_vector"), "rep", "copies"
    )
    same = (F.col("label") == F.col("of_label")) & (F.col("vector") == F.col("of_vector"))
    held = good.join(broadcast_if_bounded(copies), same, "left").select("vec_id", F.coalesce("rep", "vec_id").alias("rep"), "copies")
    held = held.join(broadcast_if_bounded(links), "rep", "left")
    edges = edges.union(held.where("vec_id <> rep").select("vec_id", "rep"))
    joined = components(edges)
    held = held.join(broadcast_if_bounded(joined), F.col("vec_id") == F.col("node"), "left").select(
        "vec_id",
        (F.coalesce("n_links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
    )
    alone = rows.where(~F.coalesce(fits, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return held.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
