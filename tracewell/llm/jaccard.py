"""N-gram Jaccard join: sets of word shingles, linked at a similarity of 0.75, by prefix trees.

The plan, each step exact:

1. Every text becomes its set of 64-bit shingle hashes. Equal sets share a digest and count once from here on.
2. A set of n shingles may miss at most n - ceil(0.75 n) of them in a linked set. Of the shingles whose hash
   lies in the lowest SHARE of all hashes, the ones that no other set holds are counted; a set with more such
   shingles than it may miss has no link and is done. This reads a share of the shingles, never a share of sets.
3. For the sets that are left all shingles are counted, which gives the global order: rarest first, then by
   hash. Only shingles that two sets hold are kept. A set's prefix is its first n - ceil(0.75 n) + 1 shingles
   in this order; linked sets share a prefix shingle. Sets without a shared prefix shingle are done.
4. Each set goes to the set with which it shares most prefix shingles (the smallest one for each shingle
   votes). Such a home, cut into parts of bounded size, is one tree: sets are stored along their ordered
   shingles, so equal beginnings are walked once, with the overlap so far; a branch is left where the
   remaining lengths cannot reach the similarity. Sets of a home that are not linked yet stand in trees of their
   own, and a set walks those that hold one of its prefix shingles in a prefix; trees of few sets are not walked
   one by one, their overlaps are counted at once. The first link found in a tree is enough. A part returns its
   components as stars, so that joining the parts takes few steps.
5. Sets that share a prefix shingle but are not connected yet meet in a second pass: each set of the smaller
   component walks the trees of the larger one, again cut into parts.
6. Links become components.

Two different shingles with equal 64-bit hashes, or two sets with equal 128-bit digests, would be taken as
one. Defined cases: null and empty texts have no set, n_shingles 0, and are their own component; a text of
fewer than five words is one shingle; rows with equal id are one document; a row with a null id takes no part
and has a null component; a very long text is one set of 8 bytes a shingle; further columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracewell.llm.common import broadcast_if_bounded, prepare, releasing, stored
from tracewell.llm.components import components

WORDS = 5
SHARE = 0.375
PART = 2048
RUN = 48
LISTED = 1024
FEW = 8
BLOCK = 1 << 18

# Odd multipliers for the places of a shingle, and of the mixing steps.
_PLACES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    import xxhash

    found = (text or "").encode().lower().split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    last = len(hashes) - width + 1
    out = np.full(last, width, np.uint64)
    for k in range(width):
        place = _PLACES[k % len(_PLACES)] + 2 * (k // len(_PLACES))
        out += hashes[k : k + last] * np.uint64(place)
    for shift, factor in zip((30, 27), _MIX):
        out = (out ^ (out >> np.uint64(shift))) * factor
    return np.unique(out ^ (out >> np.uint64(31)))


def text_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (128-bit digest of the set), low (its shingles in the lowest SHARE of hashes)."""
    prepare(docs.sparkSession)
    top = np.uint64(int(SHARE * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sizes, digests, low = [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                low.append(found[: np.searchsorted(found, top)].view(np.int64))
            digest = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(digest[:, 0].copy()),
                    pa.array(digest[:, 1].copy()),
                    pa.array(low, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "low"],
            )

    kind = "doc_id long, n_shingles long, d1 long, d2 long, low array<long>"
    return docs.select("doc_id", "text").mapInArrow(releasing(run), kind)


def _spare(n: Column) -> Column:
    """How many of n shingles a linked set may lack."""
    return n - F.ceil(n * 3 / 4)


def _candidates(sets: DataFrame) -> DataFrame:
    """rep: the smallest document of each set that step 2 leaves."""
    single = sets.where("n_shingles > 0 and doc_id is not null")
    reps = single.groupBy("d1", "d2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep"))
    # A shingle is held by one set only when the smallest and the largest digest of its holders agree.
    held = single.select("d1", F.explode("low").alias("shingle")).groupBy("shingle")
    alone = held.agg(F.min("d1").alias("d1"), F.max("d1").alias("other")).where("d1 = other")
    alone = alone.groupBy("d1").agg(F.count(F.lit(1)).alias("alone"))
    left = reps.join(alone, "d1", "left").where(F.coalesce("alone", F.lit(0)) <= _spare(F.col("n")))
    return stored(left.select("rep").distinct(), "set-candidates")


def _full_sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, d1 (digest), n, shingles for the documents in ``reps``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(broadcast_if_bounded(reps), "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            found = [shingle_set(t).view(np.int64) for t in batch.column("text").to_pylist()]
            digest = np.array([xxhash.xxh3_64_intdigest(f.tobytes()) for f in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rep"),
                    pa.array(digest),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array(found, pa.list_(pa.int64())),
                ],
                names=["rep", "d1", "n", "shingles"],
            )

    return texts.select("rep", "text").mapInArrow(releasing(run), "rep long, d1 long, n long, shingles array<long>")


def _ordered(sets: DataFrame) -> DataFrame:
    """rep, n, ranked (shared shingles, rarest first), prefix: sets whose prefix holds a shared shingle."""
    rows = sets.select("rep", "d1", "n", F.explode("shingles").alias("shingle"))
    counts = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    # A repeated row only repeats what its set already has.
    back = rows.join(counts, "shingle").groupBy("rep", "d1", "n").agg(
        F.array_sort(F.collect_set(F.struct("holders", "shingle"))).alias("ranked")
    )
    alone = F.col("n") - F.size("ranked")
    length = _spare(F.col("n")) + 1 - alone
    ranked = F.transform("ranked", lambda s: s["shingle"])
    return back.where(length > 0).select(
        "rep", "n", ranked.alias("ranked"), F.slice(ranked, F.lit(1), length.cast("int")).alias("prefix")
    )


class _Node:
    __slots__ = ("label", "kids", "ends", "least", "most")

    def __init__(self, label: list[int], size: int):
        self.label, self.kids, self.ends, self.least, self.most = label, {}, [], size, size


class SetTree:
    """Ordered sets in a tree whose edges carry runs of shingles.

    A member's size may exceed its list: shingles that no other set holds are counted in the size only.
    """

    def __init__(self):
        self.root = _Node([], 0)
        self.size = 0

    def add(self, key, size: int, ranked: list[int]) -> None:
        node, at = self.root, 0
        node.least, node.most = (min(node.least, size), max(node.most, size)) if self.size else (size, size)
        self.size += 1
        while at < len(ranked):
            kid = node.kids.get(ranked[at])
            if kid is None:
                kid = node.kids[ranked[at]] = _Node(ranked[at:], size)
                node, at = kid, len(ranked)
                break
            label, same = kid.label, 1
            while same < len(label) and at + same < len(ranked) and label[same] == ranked[at + same]:
                same += 1
            if same < len(label):
                upper = _Node(label[:same], kid.least)
                upper.most = kid.most
                kid.label = label[same:]
                upper.kids[kid.label[0]] = kid
                node.kids[ranked[at]] = kid = upper
            kid.least, kid.most = min(kid.least, size), max(kid.most, size)
            node, at = kid, at + same
        node.ends.append((key, size))

    def first_link(self, size: int, places: dict[int, int], skip=None):
        """A member linked with the set whose shingles have these places, or None.

        7 * overlap >= 3 * (both sizes) is a similarity of 0.75.
        """
        if not self.size:
            return None
        stack = [(self.root, 0, 0, 0)]
        while stack:
            node, overlap, depth, passed = stack.pop()
            for at in range(0, len(node.label), RUN):
                run = node.label[at : at + RUN]
                hits = [places[s] for s in run if s in places]
                depth += len(run)
                if hits:
                    overlap, passed = overlap + len(hits), hits[-1] + 1
                if not self._can_link(node, size, len(places) - passed, overlap, depth):
                    break
            else:
                for key, other in node.ends:
                    if 7 * overlap >= 3 * (size + other) and key != skip:
                        return key
                stack += [(kid, overlap, depth, passed) for kid in node.kids.values()]
        return None

    @staticmethod
    def _can_link(node: _Node, size: int, left: int, overlap: int, depth: int) -> bool:
        """Whether any size in the branch allows the similarity when everything that is left overlaps."""
        other = min(max(depth + left, node.least), node.most)
        return 7 * (overlap + min(left, other - depth)) >= 3 * (size + other)

    def members(self) -> Iterator[tuple[int, int, list[int]]]:
        stack = [(self.root, [])]
        while stack:
            node, before = stack.pop()
            path = before + node.label
            for key, size in node.ends:
                yield key, size, path
            stack += [(kid, path) for kid in node.kids.values()]


class Forest:
    """The trees of the components found so far, and for every prefix shingle the trees that hold it in a prefix.

    Linked sets share a prefix shingle, so a set meets only the trees that its own prefix names. The members of a
    tree of up to FEW sets are also kept as arrays. Their overlaps with a set are counted at once, by the slots of
    the shingles in a table, which counts too many at most; only the trees that may have a link are walked.
    """

    def __init__(self):
        self.trees: dict[int, SetTree] = {}
        self.joined: list[int] = []
        self.holders: dict[int, set[int]] = {}
        self.few: dict[int, list[tuple[int, np.ndarray]]] = {}
        self.slots = np.zeros(1 << 16, bool)

    def _now(self, tree: int) -> int:
        while self.joined[tree] != tree:
            self.joined[tree] = tree = self.joined[self.joined[tree]]
        return tree

    def _may_link(self, trees: list[int], size: int, own: np.ndarray) -> Iterator[int]:
        """Those of the small trees in which a member may be linked with the set."""
        while len(self.slots) < 16 * len(own):
            self.slots = np.zeros(2 * len(self.slots), bool)
        mask = len(self.slots) - 1
        self.slots[own & mask] = True
        members = [(t, *member) for t in trees for member in self.few[t]]
        last = 0
        while last < len(members):
            first, room = last, BLOCK
            while last < len(members) and (last == first or len(members[last][2]) <= room):
                room -= len(members[last][2])
                last += 1
            of, sizes, others = zip(*members[first:last])
            ends = np.cumsum([len(o) for o in others])
            met = np.concatenate(([0], np.cumsum(self.slots[np.concatenate(others) & mask])))
            overlap = np.diff(met[ends], prepend=0)
            yield from {of[i] for i in np.flatnonzero(7 * overlap >= 3 * (size + np.array(sizes))).tolist()}
        self.slots[own & mask] = False

    def _add(self, tree: int, key, size: int, ranked: list[int]) -> None:
        self.trees[tree].add(key, size, ranked)
        if tree in self.few:
            self.few[tree].append((size, np.array(ranked, np.int64)))
            if len(self.few[tree]) > FEW:
                del self.few[tree]

    def link(self, key, size: int, ranked: list[int]) -> list:
        """One linked member of every component that has one; the set joins these components."""
        # n - ceil(3n / 4) shingles may be missing, among them those that no other set holds.
        prefix = ranked[: max(0, size - (3 * size + 3) // 4 + 1 - (size - len(ranked)))]
        places = {s: i for i, s in enumerate(ranked)}
        named = {self._now(t) for t in set().union(*(self.holders.get(s, ()) for s in prefix))}
        few = sorted(named & self.few.keys())
        walked = (named - self.few.keys()).union(self._may_link(few, size, np.array(ranked, np.int64)))
        found = [(t, self.trees[t].first_link(size, places, key)) for t in sorted(walked)]
        linked = [t for t, other in found if other is not None]
        home = max(linked, key=lambda t: self.trees[t].size, default=None)
        if home is None:
            home = len(self.joined)
            self.joined.append(home)
            self.trees[home], self.few[home] = SetTree(), []
        self._add(home, key, size, ranked)
        for tree in linked:
            if tree != home:
                self.few.pop(tree, None)
                for member in self.trees.pop(tree).members():
                    self._add(home, *member)
                self.joined[tree] = home
        for s in prefix:
            self.holders.setdefault(s, set()).add(home)
        return [other for _, other in found if other is not None]


def _stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Every set that the links touch with the smallest one that they connect it to, if that is another."""
    root: dict[int, int] = {}

    def find(a: int) -> int:
        while root.setdefault(a, a) != a:
            root[a] = a = root[root[a]]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [(a, find(a)) for a in root if root[a] != a]


def _walk(group: pa.Table) -> pa.Table:
    """Links inside one part, as stars around the smallest set of each component.

    With ``grow`` every set walks the trees of the earlier ones, one tree per component found so far, and
    joins them. Otherwise the members form one tree, which the probes walk.
    """
    order = np.lexsort([group.column(n).to_numpy() for n in ("rep", "n", "probe")])
    group = group.take(pa.array(order))
    tree, forest, links = SetTree(), Forest(), []
    columns = (group.column(n).to_pylist() for n in ("rep", "n", "ranked", "probe", "grow"))
    for rep, n, ranked, probe, grow in zip(*columns):
        if grow:
            found = forest.link(rep, n, ranked)
        elif probe:
            other = tree.first_link(n, {s: i for i, s in enumerate(ranked)}, rep)
            found = [] if other is None else [other]
        else:
            tree.add(rep, n, ranked)
            continue
        links += [(rep, other) for other in found]
    a, b = zip(*_stars(links)) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _in_parts(members: DataFrame, key: str) -> DataFrame:
    """Adds ``part``: members of a key, hashed into parts of about PART."""
    counts = members.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    return members.join(counts, key).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))


def _homes(prefixes: DataFrame) -> DataFrame:
    """rep, home: the set that shares most prefix shingles among the smallest holders of each."""
    least = prefixes.groupBy("shingle").agg(F.min(F.struct("rep", "n")).alias("least"), F.count(F.lit(1)).alias("c"))
    least = least.where("c > 1")
    fits = "4 * least(n, least.n) >= 3 * greatest(n, least.n)"
    votes = prefixes.join(least, "shingle").where(fits).groupBy("rep", F.col("least.rep").alias("home"))
    return votes.agg(F.count(F.lit(1)).alias("votes")).groupBy("rep").agg(
        F.max_by("home", F.struct("votes", -F.col("home"))).alias("home")
    )


def set_links(sets: DataFrame) -> DataFrame:
    """(a, b) that connect the sets of ``_ordered`` as the links at the similarity do."""
    prefixes = stored(sets.select("rep", "n", F.explode("prefix").alias("shingle")), "set-prefixes")
    flag = {"probe": F.lit(False), "grow": F.lit(True)}
    home = F.array(F.struct("rep", "home"), F.struct(F.col("home").alias("rep"), "home"))
    named = stored(_homes(prefixes).select(F.inline(home)).distinct(), "set-homes")
    members = stored(_in_parts(named, "home").select("rep", "home", "part"), "set-members")
    first = members.join(sets.select("rep", "n", "ranked"), "rep").withColumns(flag)
    links = stored(first.groupBy("home", "part").applyInArrow(_walk, "a long, b long"), "set-links")

    # Second pass: components that still share a prefix shingle.
    labels = components(links)
    labelled = sets.select("rep").distinct().join(labels, F.col("rep") == F.col("node"), "left")
    labelled = labelled.select("rep", F.coalesce("component", "rep").alias("label"))
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("weight"))
    # Sets of one part have met already, so only shingles that lead out of a set's part count.
    first = members.groupBy("rep").agg(F.min_by(F.struct("home", "part"), F.col("home") == F.col("rep")).alias("met"))
    labelled = stored(labelled.join(sizes, "label").join(first, "rep", "left"), "set-labels")
    rows = prefixes.join(labelled, "rep").select("shingle", "rep", "n", "label", "weight", "met")
    spans = rows.groupBy("shingle", "label", "weight", "met").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    mixed = spans.groupBy("shingle").agg(F.count_distinct("label").alias("labels")).where("labels > 1")
    # Each set reads the components at a shingle as lists of bounded length; a component that several
    # shingles name is one entry of the set's own list before it becomes a row.
    piece = F.pmod(F.xxhash64("label"), F.ceil(F.col("labels") / LISTED))
    span = F.struct("label", "weight", "met", "least", "most")
    lists = spans.join(mixed, "shingle").groupBy("shingle", piece.alias("piece")).agg(F.collect_list(span).alias("spans"))
    rows = rows.join(lists, "shingle")

    def worth(s: Column) -> Column:
        n, smaller = F.col("n"), (F.col("weight") < s["weight"]) | ((F.col("weight") == s["weight"]) & (F.col("label") > s["label"]))
        fits = (4 * n >= 3 * s["least"]) & (4 * s["most"] >= 3 * n)
        return smaller & fits & F.coalesce(F.col("met") != s["met"], F.lit(True))

    rows = rows.select("rep", F.transform(F.filter("spans", worth), lambda s: F.struct(s["label"], s["weight"])).alias("into"))
    named = rows.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("into"))).alias("into"))
    probes = named.select("rep", F.inline("into"))
    parts = F.ceil(F.col("weight") / PART)
    probes = stored(probes.select("rep", "label", parts.alias("parts")), "set-probes")
    targets = probes.select("label").distinct()
    part = F.pmod(F.xxhash64("rep"), parts)
    members = labelled.join(targets, "label").select("rep", "label", part.alias("part"), F.lit(False).alias("probe"))
    sent = probes.select(
        "rep", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("probe")
    )
    both = members.union(sent).join(sets.select("rep", "n", "ranked"), "rep").withColumn("grow", F.lit(False))
    more = both.groupBy("label", "part").applyInArrow(_walk, "a long, b long")
    # The first pass is known as its components, which are stars.
    return labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest document reachable by links) for every row of ``docs``."""
    sets = stored(text_sets(docs), "text-sets")
    full = stored(_full_sets(docs, _candidates(sets)), "full-sets")
    links = set_links(stored(_ordered(full), "ordered-sets"))
    single = sets.where("n_shingles > 0 and doc_id is not null").select("doc_id", "d1", "d2")
    reps = single.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    copies = single.join(broadcast_if_bounded(reps.where("rep <> last")), ["d1", "d2"])
    joined = components(links.union(copies.where("doc_id <> rep").select("doc_id", "rep")))
    out = sets.select("doc_id", "n_shingles").join(broadcast_if_bounded(joined), F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
