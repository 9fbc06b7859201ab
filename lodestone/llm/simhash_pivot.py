"""Near-duplicates by SimHash fingerprints and a table of distances to pivots.

The table holds, for every distinct fingerprint, its Hamming distances to reference fingerprints:
zero, and for each of four blocks of its 64 bits the Walsh patterns and the full block. The
distances to one block's references, less the distance to zero, depend on that block alone. Of two
fingerprints at most two bits apart at least two blocks are the same, and so are the table's entries
for them; fingerprints that share the entries of some two blocks meet in a cell. A cell with more
members than ``MOST_IN_CELL`` is split in the same way by further references, those of four blocks of
the bits that its members may still differ in (32 bits, then 16, 8 and 4), until it is small; as
members are distinct, cells of the third kind hold 256 at most. In a cell a pair is discarded as soon
as one pivot distance differs by more than the radius (the triangle inequality), and what is left is
verified by its Hamming distance.

That holds for a radius of a few bits, as ``op1`` has it. Texts whose sets of five-word shingles
have a Jaccard similarity of 0.8 differ by some ten bits with a deviation of three, so no radius that
still tells texts apart reaches all of them. Where a similarity is asked for, which is the default,
the table therefore holds fingerprints of ``BANDS`` parts of a set, each the ``BAND_ROWS`` shingles that
come first in orders of the part's own: alike sets have 0.41 of the parts the same at 0.8, so 3 in a
million of such pairs have none. Sets meet in a cell where the table's entries for a part, to all
pivots, are the same. No cell is paired up: every text is first held against a leader,
the least one of its cells that fingerprints and sizes allow (``MOST_BITS``). A text that is then in
another component than some leader of its cells is held against all of that component, and against
the others that are left over beside it; so every pair of a cell is decided or joined otherwise,
whatever the cell's size. No component is paired up there: its sets are told by their differences from
what is usual in it. A set that is not like the usual one can be like another one only if they share
more than half of the other's differences (``shared_least``), so it has one of any half of them; the
half is taken that the fewest sets ask for, and a set that asks likewise uses its first differences alone. Sets that are like the
usual one and not like the set nearest to it (the centre, which is tried first) are told by their
differences from that one. So most sets of a family never meet, and none is lost, whatever the centre;
what meets is decided by the exact Jaccard similarity.

Null texts and texts without words have fingerprint zero, linked like any other; as sets they equal
each other alone. Copies share a fingerprint, and texts of equal sets a set's digest, and are joined
before any pairing. Long texts are hashed whole, their shingles counted in portions. A null doc_id is
reported as null and never names a component unless all of its members have none; rows of one id are
reported each. An empty table gives an empty one. Ties of ids do not arise: a component is named by
its least. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import combinations
from math import floor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import common
from lodestone.llm.components import connected_components

SEED, SHINGLE, RADIUS = 42, 3, 2
BLOCKS, BITS = 4, 64
MOST_IN_CELL = 256
#: Kinds of cells: each leaves half of the bits of the one before free, down to 2.
LEVELS = 5
PAIRS_AT_ONCE = 1 << 21
_PAIRS = tuple(combinations(range(BLOCKS), 2))
#: The general rule for near-duplicates, where ``op1`` has SHINGLE and RADIUS.
WIDE_SHINGLE, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 24, 4
MOST_BITS = 26
#: Set members that are put in the order of every band at once.
MEMBERS_AT_ONCE = 1 << 11
_MASKS, _FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * BAND_ROWS, 1), np.uint64)
_FACTORS |= np.uint64(1)
_INVERSES = np.array([pow(int(f), -1, 1 << 64) for f in _FACTORS[:, 0]], np.uint64)


def shingle_hashes(raw: bytes, shingle: int) -> np.ndarray:
    """Hashes of the lower-cased text's word shingles in their order; a text of fewer words is one shingle."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops, strict=True)), np.uint64, len(starts))


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the lower-cased text's word shingles; a bit is set if it is in over half of the hashes."""
    return majority(shingle_hashes(raw, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def blocks_of(free: int) -> list[list[int]]:
    """The free bits of a mask in four blocks, from the low end."""
    bits = [i for i in range(BITS) if free >> i & 1]
    size = len(bits) // BLOCKS
    return [bits[b * size : (b + 1) * size] for b in range(BLOCKS)]


def references(free: int = (1 << BITS) - 1) -> np.ndarray:
    """The pivots of a mask: zero, then for each block its Walsh patterns and the block of ones."""
    out = [0]
    for bits in blocks_of(free):
        for j in [*range(1, len(bits)), None]:
            out.append(sum(1 << bit for i, bit in enumerate(bits) if j is None or (i & j).bit_count() & 1))
    return np.array(out, np.uint64)


PIVOTS = references()


def distance_table(prints: np.ndarray, pivots: np.ndarray = PIVOTS) -> np.ndarray:
    """Hamming distance of every fingerprint to every pivot [fingerprints, pivots]."""
    return np.bitwise_count(prints[:, None] ^ pivots).astype(np.int8)


def free_after(free: int) -> list[int]:
    """The bits that stay free once two blocks are the same, for each two blocks."""
    masks = [sum(1 << i for i in bits) for bits in blocks_of(free)]
    return [free & ~(masks[a] | masks[b]) for a, b in _PAIRS]


def block_entries(prints: np.ndarray, free: int = (1 << BITS) - 1) -> np.ndarray:
    """The table's entries for each block of the free bits, folded into one number [fingerprints, blocks]."""
    size = free.bit_count() // BLOCKS
    rows = distance_table(prints, references(free))
    own = (rows[:, 1:] - rows[:, :1]).reshape(len(prints), BLOCKS, size)
    base = 2 * BITS + 1
    with np.errstate(over="ignore"):
        powers = np.array([pow(base, i, 1 << 64) for i in range(size)], np.uint64)
        return ((own.astype(np.int64) + BITS).astype(np.uint64) * powers).sum(2)


def cell_keys(prints: np.ndarray, free: int = (1 << BITS) - 1) -> np.ndarray:
    """A key of the table's entries for each two blocks of the free bits [fingerprints, pairs of blocks]."""
    folded = block_entries(prints, free)
    with np.errstate(over="ignore"):
        mixed = [(folded[:, a] * np.uint64(0x9E3779B97F4A7C15)) ^ (folded[:, b] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(k + 1)) for k, (a, b) in enumerate(_PAIRS)]
    return np.stack(mixed, 1)


def _pairs(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within groups of these sizes, in bounded portions."""
    starts = np.cumsum(sizes) - sizes
    weights = np.cumsum(sizes.astype(np.int64) ** 2)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(weights, (weights[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        own = sizes[at:end]
        first = np.repeat(np.arange(own.sum()) + starts[at], np.repeat(own, own) - 1 - (np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)))
        run = np.repeat(own, own) - 1 - (np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own))
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(run) - run, run)
        yield first, second
        at = end


def linked_pairs(prints: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within groups that no pivot tells apart and that the Hamming distance confirms."""
    table = distance_table(prints)
    left, right = [], []
    for a, b in _pairs(sizes):
        for pivot in range(table.shape[1]):
            near = np.abs(table[a, pivot] - table[b, pivot]) <= RADIUS
            a, b = a[near], b[near]
        near = np.bitwise_count(prints[a] ^ prints[b]) <= RADIUS
        left.append(a[near])
        right.append(b[near])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each member's component under the links a-b."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Columns (doc_id, fp) of every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches):
            prints = np.array([fingerprint(r, shingle) for r in common.utf8(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return common.only(docs, "doc_id", "text").mapInArrow(rows, "doc_id long, fp long")


def _cells(members: DataFrame) -> DataFrame:
    """Columns (cell, free, fp): the members of cells (the same columns) in the finer cells of each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, frees, prints = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "free", "fp"))
            for free in np.unique(frees):
                own = np.flatnonzero(frees == free)
                mask = int(free) & (1 << BITS) - 1
                with np.errstate(over="ignore"):
                    keys = cell_keys(prints[own].view(np.uint64), mask) ^ (cells[own].view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))[:, None]
                left = np.array(free_after(mask), np.uint64).view(np.int64)
                columns = [keys.view(np.int64).ravel(), np.tile(left, len(own)), np.repeat(prints[own], len(_PAIRS))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "free", "fp"])

    return members.select("cell", "free", "fp").mapInArrow(rows, "cell long, free long, fp long")


def _populated(cells: DataFrame) -> DataFrame:
    """Members of cells with two members or more, with their number; counts are gathered before they are
    shuffled, and written, so that Spark can deal a crowded cell out anew where it joins."""
    sizes = common.written(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    return common.written(cells.join(sizes, "cell"), "cells")


def _links_in_cells(members: DataFrame) -> DataFrame:
    """Links of cells of bounded size, as one spanning star for each linked set of a cell."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_cells, held = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def emit(cells: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            edges = np.flatnonzero(np.diff(cells)) + 1
            sizes = np.diff(np.concatenate([[0], edges, [len(cells)]]))
            a, b = linked_pairs(prints.view(np.uint64), sizes)
            root = spanning(len(prints), a, b)
            moved = root != np.arange(len(prints))
            links = np.unique(np.stack([prints[moved], prints[root[moved]]], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["u", "v"])

        for batch in batches:
            cells = np.concatenate([held_cells, batch.column("cell").to_numpy(zero_copy_only=False)])
            prints = np.concatenate([held, batch.column("fp").to_numpy(zero_copy_only=False)])
            if not len(cells):
                continue
            whole = int(np.searchsorted(cells, cells[-1], "left"))
            if whole:
                yield emit(cells[:whole], prints[:whole])
            held_cells, held = cells[whole:], prints[whole:]
        if len(held):
            yield emit(held_cells, held)

    return members.select("cell", "fp").repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(rows, "u long, v long")


def links(distinct: DataFrame, most_in_cell: int = MOST_IN_CELL) -> DataFrame:
    """Links (u, v) that join distinct fingerprints (column fp) within ``RADIUS`` bits into their components."""
    members = _populated(_cells(distinct.select(F.lit(0).cast("long").alias("cell"), F.lit(-1).cast("long").alias("free"), "fp")))
    found = []
    for level in range(LEVELS):
        small = F.lit(True) if level + 1 == LEVELS else F.col("n") <= most_in_cell
        found.append(_links_in_cells(members.where(small)))
        crowded = members.where(~small)
        if crowded.isEmpty():
            break
        members = _populated(_cells(crowded).distinct())
    return reduce(DataFrame.unionByName, found)


def set_digest(members: np.ndarray) -> int:
    """A hash of a sorted set of shingle hashes."""
    return xxhash.xxh64_intdigest(members.tobytes(), SEED)


def band_prints(members: np.ndarray) -> np.ndarray:
    """SimHash of a part of a set for each band: of the members that come first in the band's orders [BANDS]."""
    least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    with np.errstate(over="ignore"):
        for at in range(0, len(members), MEMBERS_AT_ONCE):
            np.minimum(least, ((members[at : at + MEMBERS_AT_ONCE] ^ _MASKS) * _FACTORS).min(1), out=least)
        first = (least * _INVERSES) ^ _MASKS[:, 0]
    bits = np.unpackbits(first.view(np.uint8).reshape(BANDS, BAND_ROWS, 8), axis=2, bitorder="little")
    return np.packbits(2 * bits.sum(1, dtype=np.uint32) > BAND_ROWS, axis=1, bitorder="little").view(np.uint64)[:, 0]


def band_keys(members: np.ndarray) -> np.ndarray:
    """The cells of a set: for each band a hash of all of the table's entries for its fingerprint [BANDS]; none for the empty set."""
    if not len(members):
        return np.zeros(0, np.int64)
    entries = block_entries(band_prints(members))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(entries)], np.uint64).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have this Jaccard similarity at least."""
    common_members = len(np.intersect1d(a, b, assume_unique=True))
    return common_members >= similarity * (len(a) + len(b) - common_members) - 1e-9


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """Columns (doc_id, fp, node, mark, size, cells): fingerprint of the text; digest, fingerprint, size and cells of its set of shingles."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches):
            prints, nodes, marks, sizes, cells = [], [], [], [], []
            for raw in common.utf8(batch.column("text")):
                hashes = shingle_hashes(raw, shingle)
                members = np.unique(hashes)
                prints.append(majority(hashes))
                nodes.append(set_digest(members))
                marks.append(majority(members))
                sizes.append(len(members))
                cells.append(band_keys(members))
            whole = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (prints, nodes, marks)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *whole, pa.array(sizes, pa.int64()), pa.array(cells, pa.list_(pa.int64()))],
                names=["doc_id", "fp", "node", "mark", "size", "cells"],
            )

    return common.only(docs, "doc_id", "text").mapInArrow(rows, "doc_id long, fp long, node long, mark long, size long, cells array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """Columns (node, members) for the wanted nodes (columns node, rep): the bytes of the sorted set.

    Here and where sets meet their pairs the join is a merge at any size, whose cost is in proportion.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # rows of one id meet in one task
        for batch in common.text_slices(batches):
            sets = [np.unique(shingle_hashes(raw, shingle)) for raw in common.utf8(batch.column("text"))]
            own = np.array([set_digest(s) for s in sets], np.uint64).view(np.int64)
            right = np.flatnonzero(own == batch.column("wanted").to_numpy(zero_copy_only=False))
            take = np.array([i for i in right.tolist() if not (own[i] in done or done.add(own[i]))], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own[take]), pa.array([sets[i].tobytes() for i in take], pa.binary())], names=["node", "members"])

    texts = common.only(docs, "doc_id", "text")
    wanted = wanted.select("rep", F.col("node").alias("wanted"))
    found = texts.join(wanted.hint("merge"), texts["doc_id"].eqNullSafe(wanted["rep"])).select("wanted", "text")
    return found.mapInArrow(rows, "node long, members binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (u, v) whose sets are alike."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = [alike(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), similarity) for a, b in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(pa.array(keep, pa.bool_())), batch.column("v").filter(pa.array(keep, pa.bool_()))], names=["u", "v"])

    first = sets.select(F.col("node").alias("u"), F.col("members").alias("a"))
    second = sets.select(F.col("node").alias("v"), F.col("members").alias("b"))
    return pairs.join(first.hint("merge"), "u").join(second.hint("merge"), "v").select("u", "v", "a", "b").mapInArrow(rows, "u long, v long")


def _fits(similarity: float, other: str = "lead") -> Column:
    """Whether a row's set and another one (a struct of node, mark, size) are likely to have the similarity, by their fingerprints and sizes."""
    sizes = F.least("size", f"{other}.size") >= similarity * F.greatest("size", f"{other}.size") - 1e-9
    return (F.col("node") != F.col(f"{other}.node")) & (F.bit_count(F.col("mark").bitwiseXOR(F.col(f"{other}.mark"))) <= MOST_BITS) & sizes


def _in_order(pairs: DataFrame) -> DataFrame:
    """Pairs (node, other) as (u, v), the lesser first, each once."""
    return pairs.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()


def shared_least(differences: int, size: int, centre: int, similarity: float) -> int:
    """How many of its differences from a centre a set shares at least with any set that is like it and not like the centre.

    For similarity s let b = (1 - s) / (1 + s): two sets are alike if they differ in b times the sum of their
    sizes at most. One that is not like the centre differs from it in more than that. Differences from the
    centre that both sets have cancel out between them, which gives more than (differences + b * (centre - size)) / 2.
    """
    s = Fraction(str(similarity))
    b = (1 - s) / (1 + s)
    return floor((differences + b * (centre - size)) / 2) + 1


#: What a row of ``_told_apart`` says: the set is like the centre; one of its differences; one by which it also meets others.
LIKE, DIFFERS, MEETS_BY = 0, 1, 2
#: Sets from which the usual one is taken. Any gives the same pairs in the end; a fitting one lets fewer meet.
USUAL_OF = 64


def _usual(held: DataFrame, sets: DataFrame) -> DataFrame:
    """Columns (home, usual): of some sets held against each other the shingles that most have."""

    def most(some: pa.Table) -> pa.Table:
        values, counts = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in some.column("members").to_pylist()]), return_counts=True)
        return pa.table({"home": some.column("home")[:1], "usual": [values[2 * counts > len(some)].tobytes()]})

    order = Window.partitionBy("home").orderBy(F.xxhash64("node"), "node")
    some = held.select("home", "node").withColumn("at", F.row_number().over(order)).where(F.col("at") <= USUAL_OF)
    return some.select("home", "node").join(sets.hint("merge"), "node").groupBy("home").applyInArrow(most, "home long, usual binary")


def _centres(held: DataFrame, sets: DataFrame) -> DataFrame:
    """Columns (home, heart, heart_root, centre, usual): of all sets held against each other the one nearest to what is usual among them."""

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("members").to_pylist(), batch.column("usual").to_pylist(), strict=True)
            apart = [len(np.setxor1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)) for a, b in both]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("home", "node", "root")), pa.array(apart, pa.int64())], names=["home", "node", "root", "apart"])

    usual = common.written(_usual(held, sets), "usual")
    each = held.join(sets.hint("merge"), "node").join(usual.hint("merge"), "home").select("home", "node", "root", "members", "usual")
    found = each.mapInArrow(distances, "home long, node long, root long, apart long").groupBy("home").agg(F.min(F.struct("apart", "node", "root")).alias("best"))
    found = found.select("home", F.col("best.node").alias("heart"), F.col("best.root").alias("heart_root"))
    return found.join(sets.select(F.col("node").alias("heart"), F.col("members").alias("centre")).hint("merge"), "heart").join(usual, "home")


def _told_apart(held: DataFrame, similarity: float) -> DataFrame:
    """Columns (home, node, root, heart, kind, part, apart, size, least) from (home, node, root, asks, members, heart, centre, usual): what sets share with others.

    A set that asks is told to be like its centre, or meets others by any of its differences: from the
    usual shingles if it is not like these, else from the centre, told by ``part``'s lowest bit. Of every
    set all differences of either kind are told, by the first of which it is met (``_first_parts``).
    ``apart``: how many differences it has; ``least``: how many of them a set like it has.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int, np.ndarray, int, int, int]] = []
            for i, (asks, *sets) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("asks", "members", "centre", "usual")), strict=True)):
                own, centre, usual = (np.frombuffer(x, np.uint64) for x in sets)
                parts: list[tuple[int, int, np.ndarray, int, int, int]] = []
                for kind, other in ((0, usual), (1, centre)):
                    if kind and np.array_equal(centre, usual):
                        break
                    apart = np.concatenate([np.setdiff1d(own, other, assume_unique=True), np.setdiff1d(other, own, assume_unique=True)])
                    apart = (apart & ~np.uint64(1) | np.uint64(kind)).view(np.int64)
                    least = shared_least(len(apart), len(own), len(other), similarity)
                    parts.append((i, DIFFERS, apart, len(apart), len(own), least))
                if asks and alike(own, centre, similarity):
                    parts.append((i, LIKE, np.zeros(1, np.int64), 0, 0, 0))
                elif asks:
                    at = -1 if alike(own, usual, similarity) else 0
                    parts[at] = (i, MEETS_BY, *parts[at][2:])
                found += parts
            counts = np.array([len(x[2]) for x in found], np.int64)
            at, kinds, *sizes = (pa.array(np.repeat(np.array([x[c] for x in found], np.int64), counts)) for c in (0, 1, 3, 4, 5))
            parts = pa.array(np.concatenate([x[2] for x in found]) if found else np.zeros(0, np.int64))
            own = [batch.column(c).take(at) for c in ("home", "node", "root", "heart")]
            yield pa.RecordBatch.from_arrays([*own, kinds, parts, *sizes], names=names)

    names = ["home", "node", "root", "heart", "kind", "part", "apart", "size", "least"]
    return held.select("home", "node", "root", "heart", "asks", "members", "centre", "usual").mapInArrow(rows, ", ".join(f"{n} long" for n in names))


def _first_parts(told: DataFrame, similarity: float) -> DataFrame:
    """Of the told differences those by which sets meet: columns asks and met say on which side, held how many the asking side holds back.

    All sets of a home have their differences in one order, those by which the fewest ask first: a
    passage that many texts share, or a shingle that many copies lack, comes last. The first one that two
    alike sets share lies so far in front on either side that the others they share have room after it:
    a set that asks shares all but (1 - s) / s times its size, one that is met ``least``.
    """
    differences = told.where(F.col("kind") != LIKE)
    askers = differences.where(F.col("kind") == MEETS_BY).groupBy("home", "part").agg(F.count("*").alias("askers"))
    order = Window.partitionBy("home", "node", F.col("part").bitwiseAND(1)).orderBy("askers", "part")
    placed = differences.join(common.written(askers, "askers"), ["home", "part"], "left").withColumn("askers", F.coalesce("askers", F.lit(0))).withColumn("at", F.row_number().over(order))
    room = F.least("apart", F.floor((1 - similarity) / similarity * F.col("size") + 1e-6) + 1)
    placed = placed.withColumn("asks", (F.col("kind") == MEETS_BY) & (F.col("at") <= room)).withColumn("held", F.col("apart") - room)
    placed = placed.withColumn("met", (F.col("at") <= F.col("apart") - F.col("least") + 1) & (F.col("askers") > (F.col("kind") == MEETS_BY).cast("int")))
    return placed.where("asks OR met").drop("askers", "at", "kind")


def similar_components(docs: DataFrame, distinct: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Columns (node, root) that join distinct sets (columns node, rep, mark, size, cells) into components of alike sets."""
    own = distinct.select("node", "mark", "size", F.explode("cells").alias("cell"))
    leads = own.groupBy("cell").agg(F.count("*").alias("n"), F.min(F.struct("node", "mark", "size")).alias("lead")).where("n > 1").drop("n")
    # Written, and joined to all rows, so that a crowded cell is dealt out anew.
    met = own.join(common.written(leads, "leads"), "cell", "left").where("lead IS NOT NULL")
    couples = met.groupBy("node", F.col("lead.node").alias("other")).agg(F.max(_fits(similarity)).alias("fits"))
    couples = common.written(couples, "couples")
    wanted = distinct.join(couples.select("node").distinct(), "node", "left_semi").select("node", "rep")
    sets = common.written(_sets(docs, common.written(wanted, "wanted"), shingle), "sets")
    asked = _in_order(couples.where("fits").groupBy("node").agg(F.min("other").alias("other")))
    links = common.written(_confirmed(common.written(asked, "pairs"), sets, similarity), "links")
    settled = common.written(connected_components(links), "settled")

    # Who is in another component than a leader of its cells, and whom to hold it against.
    root_of = lambda column, name: settled.select(F.col("node").alias(column), F.col("root").alias(name))
    placed = couples.where("node <> other").select("node", "other").join(root_of("node", "root"), "node", "left").join(root_of("other", "home"), "other", "left")
    placed = placed.select("node", F.coalesce("root", "node").alias("root"), F.coalesce("home", "other").alias("home"))
    strays = common.written(placed.where("root <> home").distinct(), "strays")
    if strays.isEmpty():
        return settled
    rooted = common.written(sets.select("node").join(root_of("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    inside = rooted.join(strays.select("home").distinct(), F.col("root") == F.col("home")).select("home", "node", "root", F.lit(False).alias("asks"))
    held = common.written(inside.unionByName(strays.select("home", "node", "root", F.lit(True).alias("asks"))), "held")
    centres = common.written(_centres(held, sets), "centres")
    # Sets of the component ask too where the centre is not one of it; else being like the centre settles a set.
    held = held.join(sets.hint("merge"), "node").join(centres.hint("merge"), "home").withColumn("asks", F.col("asks") | (F.col("heart_root") != F.col("home")))
    told = common.written(_told_apart(held, similarity), "differences")
    like = told.where(F.col("kind") == LIKE).select(F.col("heart").alias("u"), F.col("node").alias("v"))
    first = common.written(_first_parts(told, similarity), "first")
    met = first.where("met").select("home", "part", F.col("node").alias("other"), F.col("root").alias("root_2"), F.col("apart").alias("apart_2"), F.col("size").alias("size_2"), F.col("least").alias("least_2"))
    pairs = first.where("asks").select("home", "part", "node", "root", "apart", "size", "held").join(met, ["home", "part"]).where("root <> root_2")
    # Beside those by which they met, two sets share no more differences than the side that ends first holds back.
    share = (1 - similarity) / (1 + similarity)
    needed = F.ceil((F.col("apart") + F.col("apart_2") - share * (F.col("size") + F.col("size_2"))) / 2 - 1e-6)
    pairs = pairs.groupBy("home", "node", "other", "apart", "apart_2", "size", "size_2", "held", "least_2").agg(F.count("*").alias("met"))
    pairs = pairs.where(F.col("met") + F.greatest(F.col("least_2") - 1, "held") >= needed)
    fresh = _confirmed(common.written(_in_order(pairs.select("node", "other")), "pairs"), sets, similarity)
    return _joined_roots(fresh.unionByName(like), rooted).where("node <> root")


def _joined_roots(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Columns (node, root) once links have joined components: by their roots, one link for each two however many pairs there are."""
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    between = links.join(of("u"), "u").join(of("v"), "v").select(F.col("u_root").alias("u"), F.col("v_root").alias("v")).distinct()
    joined = connected_components(common.written(between, "between")).select(F.col("node").alias("root"), F.col("root").alias("now"))
    return common.written(roots.join(joined, "root", "left").select("node", F.coalesce("now", "root").alias("root")), "roots")


def near_duplicates(
    docs: DataFrame, most_in_cell: int = MOST_IN_CELL, shingle: int = WIDE_SHINGLE, radius: int | None = None, similarity: float = SIMILARITY
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (its least doc_id).

    With a radius (cells are made for ``RADIUS`` alone) fingerprints within so many bits are linked;
    without one, texts whose sets of shingles have the similarity (cells are made for ``SIMILARITY`` or more).
    """
    if radius not in (None, RADIUS) or similarity < SIMILARITY:
        raise ValueError(f"cells are made for a radius of {RADIUS} bits, or a similarity of {SIMILARITY} or more")
    if radius is None:
        prints = common.written(sketches(docs, shingle), "sketches")
        distinct = prints.groupBy("node").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("mark", "size", "cells")])
        distinct = common.written(distinct, "distinct")
        settled = similar_components(docs, distinct, shingle, similarity)
    else:
        prints = common.written(fingerprints(docs, shingle), "fingerprints").withColumn("node", F.col("fp"))
        distinct = prints.groupBy("node").agg(F.min("doc_id").alias("rep"))
        settled = connected_components(links(distinct.select(F.col("node").alias("fp")), most_in_cell))
    rooted = distinct.select("node", "rep").join(settled, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    rooted = common.written(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    mapping = rooted.join(named, "root").select("node", "component_id")
    return prints.select("doc_id", "fp", "node").join(mapping, "node").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
