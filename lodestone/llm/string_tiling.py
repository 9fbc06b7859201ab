"""Benchmark decontamination by greedy string tiling.

Texts become words (letters and digits, lower-cased). A document and a benchmark item are compared
if they share seeds, runs of ``SEED`` words, which are joined on their rolling hash: the items' seeds
are counted first, and up to ``MOST_SEEDS`` of them are handed to every task, which looks its
documents' seeds up; beyond that the seeds of documents are joined with them by a shuffle. A pair goes
on if its seeds, side by side, could cover enough of the item. It is then tiled: with a window that
shrinks from long to the seed's length, running Karp-Rabin hashes find common runs of unmarked words,
each is stretched as far as it goes, and the longest are marked first, so that tiles do not overlap.
Where words repeat so much that runs match in over ``MOST_MATCHES`` places, the longest one is found
row by row instead, which takes a fixed number of steps for each word of item and document. The share
of the item's words that are marked does not depend on the order of its passages in the document.

Items shorter than a seed, and without an id, are never reported: so few words prove nothing. Null and
empty texts match nothing, an empty table on either side gives none. Long documents are tiled only
where they share seeds with the item. Copies of a document are reported each, also under one id or
none; an item that occurs twice in the table is reported under both ids. Of tiles of one length the
first in the item, then in the document, is marked first. Other columns are not looked at.
"""

from __future__ import annotations

import re
from array import array
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common

SEED = 5
FIRST_WINDOW = 20
COVERAGE = 0.5
#: Seeds of the items that every task is handed, at 20 bytes each.
MOST_SEEDS = 4_000_000
#: Places in which runs of a pair may match before it is tiled row by row.
MOST_MATCHES = 50_000
#: Bytes of distinct words that a task remembers.
HELD_WORDS = 16 << 20
_WORD = re.compile(r"[^\W_]+")
_BASE, _MODULUS = 1_000_003, (1 << 61) - 1
TILES = "array<struct<item_word:long,doc_word:long,length:long>>"
SCHEMA = f"doc_id long, item_id long, coverage double, n_tiles long, longest long, tiles {TILES}"


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall((text or "").lower())


class WordHashes:
    """Hashes of words, each distinct one hashed once while it is remembered."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        """Empties the memory of words."""
        self.known, self.hashes, self.size = common.Numbers(), array("Q"), 0

    def of(self, texts: list[list[str]]) -> np.ndarray:
        """The hashes of all words of the texts, one text after the other."""
        if self.size > HELD_WORDS:
            self.forget()
        number = self.known.of(chain.from_iterable(texts), sum(map(len, texts)))
        for word in self.known.fresh:
            raw = word.encode("utf-8", "surrogatepass")
            self.hashes.append(xxhash.xxh64_intdigest(raw))
            self.size += len(raw) + 100
        self.known.fresh = []
        return np.array(self.hashes, np.uint64)[number] if len(number) else np.zeros(0, np.uint64)


def seed_hashes(hashes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Hash of the run of ``seed`` words that starts at each place, from the words' hashes."""
    n = len(hashes) - seed + 1
    out = np.zeros(max(0, n), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(seed if n > 0 else 0):
            out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
        return out ^ (out >> np.uint64(29))


@dataclass(frozen=True)
class Seeds:
    """Seeds of all items in order of their hash: the item that each is of (by place in ``items``) and how often it is there."""

    keys: np.ndarray
    owners: np.ndarray
    times: np.ndarray
    items: np.ndarray
    sizes: np.ndarray


def shared_items(texts: list[str | None], seeds: Seeds, hashes: WordHashes, least: float, seed: int = SEED) -> list[list[int]]:
    """For each text the items of which its seeds, side by side, could cover the share ``least``."""
    out: list[list[int]] = [[] for _ in texts]
    split = [words(t) for t in texts]
    sizes = np.array([len(x) for x in split], np.int64)
    ends = np.cumsum(sizes)
    flat = seed_hashes(hashes.of(split), seed)
    if not len(flat) or not len(seeds.keys):
        return out
    low = np.searchsorted(seeds.keys, flat, "left")
    place = np.flatnonzero((low < len(seeds.keys)) & (seeds.keys[np.minimum(low, len(seeds.keys) - 1)] == flat))
    text = np.searchsorted(ends, place, "right")
    whole = place + seed <= ends[text]
    place, text = place[whole], text[whole]
    if not len(place):
        return out
    # Each seed counts once a text, for every place that it has in the item.
    pairs = np.unique(np.stack([text.astype(np.uint64), flat[place]]), axis=1)
    text, key = pairs[0].astype(np.int64), pairs[1]
    low, high = np.searchsorted(seeds.keys, key, "left"), np.searchsorted(seeds.keys, key, "right")
    counts = high - low
    at = np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    both = np.repeat(text, counts) * len(seeds.items) + seeds.owners[at]
    pair, which = np.unique(both, return_inverse=True)
    covered = np.bincount(which, weights=seeds.times[at]) * seed
    owner = pair % len(seeds.items)
    for t, o in zip((pair // len(seeds.items))[covered >= least * seeds.sizes[owner]], owner[covered >= least * seeds.sizes[owner]], strict=True):
        out[t].append(int(seeds.items[o]))
    return out


def rolling(tokens: list[int], marked: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """Place and Karp-Rabin hash of each run of ``size`` unmarked words."""
    lead = pow(_BASE, size - 1, _MODULUS)
    value = filled = 0
    for i, token in enumerate(tokens):
        if marked[i]:
            value = filled = 0
            continue
        if filled == size:
            value = (value - tokens[i - size] * lead) % _MODULUS
        else:
            filled += 1
        value = (value * _BASE + token) % _MODULUS
        if filled == size:
            yield i - size + 1, value


def longest_runs(item: list[int], doc: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles found row by row: for each tile one pass over all places of the item, each against the whole document."""
    own, other = np.array(item, np.int64), np.array(doc, np.int64)
    free_item, free_doc = np.ones(len(own), bool), other >= 0
    tiles: list[tuple[int, int, int]] = []
    while True:
        best = (0, 0, 0)
        run = np.zeros(len(other) + 1, np.int64)
        for i in range(len(own) - 1, -1, -1):
            run[:-1] = np.where((other == own[i]) & free_doc & free_item[i], run[1:] + 1, 0)
            at = int(run[:-1].argmax()) if len(other) else 0
            if run[at] >= max(best[0], 1):
                best = (int(run[at]), i, at)
        n, i, at = best
        if n < least:
            return sorted(tiles, key=lambda t: (-t[2], t[0]))
        free_item[i : i + n] = free_doc[at : at + n] = False
        tiles.append((i, at, n))


def tile(item: list[int], doc: list[int], least: int = SEED, first: int = FIRST_WINDOW, most_matches: int = MOST_MATCHES) -> list[tuple[int, int, int]]:
    """Tiles (place in the item, place in the document, length), longest first.

    Always the longest match of unmarked words is the next tile; of several the first in the item, then in
    the document. What is left of a match that a tile has cut waits with the others, by its new length.
    """
    item_marked, doc_marked = [False] * len(item), [t < 0 for t in doc]
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(first, len(item)))
    while True:
        places: dict[int, list[int]] = {}
        for at, value in rolling(doc, doc_marked, size):
            places.setdefault(value, []).append(at)
        starts = list(rolling(item, item_marked, size))
        if sum(len(places.get(value, ())) for _, value in starts) > most_matches:
            return longest_runs(item, doc, least)
        matches: list[tuple[int, int, int]] = []
        for i, value in starts:
            for at in places.get(value, ()):
                if i and at and item[i - 1] == doc[at - 1] and not item_marked[i - 1] and not doc_marked[at - 1]:
                    continue  # a part of the match that begins before
                n = 0
                while i + n < len(item) and at + n < len(doc) and item[i + n] == doc[at + n] and not item_marked[i + n] and not doc_marked[at + n]:
                    n += 1
                if n >= size:
                    matches.append((-n, i, at))
        if matches and -min(matches)[0] > 2 * size:
            size = -min(matches)[0]
            continue
        heapq.heapify(matches)
        while matches:
            n, i, at = heapq.heappop(matches)
            free = [not (item_marked[i + k] or doc_marked[at + k]) for k in range(-n)]
            if all(free):
                item_marked[i : i - n] = doc_marked[at : at - n] = [True] * -n
                tiles.append((i, at, -n))
                continue
            for whole, part in groupby(range(-n), free.__getitem__):
                own = list(part)
                if whole and len(own) >= size:  # shorter ones are found with a shorter window
                    heapq.heappush(matches, (-len(own), i + own[0], at + own[0]))
        if size == least:
            return sorted(tiles, key=lambda t: (-t[2], t[0]))
        size = max(least, size // 2)


def _zones(starts: np.ndarray, ids: np.ndarray, seed: int) -> tuple[list[int], list[int]]:
    """The words under seed hits, zones set apart by a negative number, and their places."""
    tokens: list[int] = []
    places: list[int] = []
    cuts = np.flatnonzero(np.diff(starts) > seed) + 1
    for zone in np.split(starts, cuts):
        low, high = int(zone[0]), int(zone[-1]) + seed
        tokens += [*ids[low:high].tolist(), -1]
        places += [*range(low, high), -1]
    return tokens, places


def tiled(item: str, doc: str, seed: int = SEED) -> tuple[list[tuple[int, int, int]], float]:
    """Tiles of a document on an item, by places of words in both, and the share of the item that they cover."""
    numbers: dict[str, int] = {}
    own = [numbers.setdefault(w, len(numbers) + 1) for w in words(item)]
    ids = np.array([numbers.get(w, 0) for w in words(doc)], np.int64)
    known = {tuple(own[i : i + seed]) for i in range(len(own) - seed + 1)}
    blanks = np.concatenate([[0], np.cumsum(ids == 0)])
    whole = np.flatnonzero(blanks[seed:] == blanks[:-seed]) if len(ids) >= seed else np.zeros(0, np.int64)
    starts = np.array([i for i in whole.tolist() if tuple(ids[i : i + seed].tolist()) in known], np.int64)
    if not len(starts):
        return [], 0.0
    tokens, places = _zones(starts, ids, seed)
    tiles = [(i, places[at], n) for i, at, n in tile(own, tokens, seed)]
    return tiles, sum(n for _, _, n in tiles) / len(own)


def item_table(benchmark: DataFrame) -> DataFrame:
    """The items that can be found, written: item (a number), item_id, text, n_words, seeds (hashes, as often as they occur)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in common.text_slices(batches):
            split = [words(t) for t in batch.column("text").to_pylist()]
            seeds = [seed_hashes(hashes.of([x])).view(np.int64) for x in split]
            keep = pa.array([len(x) >= SEED for x in split], pa.bool_())
            columns = [batch.column("item_id").cast(pa.int64()), batch.column("text"), pa.array([len(x) for x in split], pa.int64()), pa.array(seeds, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=["item_id", "text", "n_words", "seeds"])

    own = common.only(benchmark, "item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    found = own.mapInArrow(rows, "item_id long, text string, n_words long, seeds array<long>")
    return common.written(found.withColumn("item", F.monotonically_increasing_id()), "items")


def _looked_up(docs: DataFrame, seeds: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Documents that share seeds with items (row, doc_id, text), and the pairs (row, item), by handing the seeds out."""
    table = seeds.select("seed", "item", "n_words", "times").toArrow()
    key, item, size, times = (table.column(c).to_numpy() for c in ("seed", "item", "n_words", "times"))
    items, owner = np.unique(item, return_inverse=True)
    sizes = np.zeros(len(items), np.int64)
    sizes[owner] = size
    order = np.argsort(key.view(np.uint64), kind="stable")
    handed = docs.sparkSession.sparkContext.broadcast(Seeds(key.view(np.uint64)[order], owner[order].astype(np.int32), times[order].astype(np.int32), items, sizes))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in common.text_slices(batches):
            found = shared_items(batch.column("text").to_pylist(), handed.value, hashes, least)
            keep = pa.array([bool(x) for x in found], pa.bool_())
            columns = [batch.column("doc_id").cast(pa.int64()), batch.column("text"), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=["doc_id", "text", "items"])

    hits = docs.mapInArrow(rows, "doc_id long, text string, items array<long>").withColumn("row", F.monotonically_increasing_id())
    hits = common.written(hits, "hits")
    return hits.drop("items"), hits.select("row", F.explode("items").alias("item"))


def _joined(docs: DataFrame, seeds: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The same by joining the seeds of all documents with those of the items."""
    numbered = common.written(docs.withColumn("row", F.monotonically_increasing_id()), "documents")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in common.text_slices(batches):
            own = [np.unique(seed_hashes(hashes.of([words(t)]))) for t in batch.column("text").to_pylist()]
            row = np.repeat(batch.column("row").to_numpy(zero_copy_only=False), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64))], names=["row", "seed"])

    met = numbered.select("row", "text").mapInArrow(rows, "row long, seed long").join(seeds, "seed")
    counted = met.groupBy("row", "item", "n_words").agg(F.sum("times").alias("times"))
    pairs = common.written(counted.where(F.col("times") * SEED >= least * F.col("n_words")).select("row", "item"), "pairs")
    return numbered.join(pairs.select("row").distinct(), "row", "left_semi"), pairs


def leaks(docs: DataFrame, benchmark: DataFrame, least_coverage: float = COVERAGE, most_seeds: int = MOST_SEEDS) -> DataFrame:
    """One row for each document and item of which the document's tiles cover at least ``least_coverage``."""
    items = item_table(benchmark)
    seeds = common.written(items.select("item", "n_words", F.explode("seeds").alias("seed")).groupBy("item", "n_words", "seed").agg(F.count("*").alias("times")), "seeds")
    texts = common.only(docs, "doc_id", "text").where(F.col("text").isNotNull())
    find = _looked_up if seeds.count() <= most_seeds else _joined
    hits, pairs = find(texts, seeds, least_coverage)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("item_word", pa.int64()), ("doc_word", pa.int64()), ("length", pa.int64())]))
        for batch in common.text_slices(batches):
            both = [tiled(item, doc) for item, doc in zip(batch.column("item_text").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            at = [i for i, (_, covered) in enumerate(both) if covered >= least_coverage]
            tiles = [[{"item_word": i, "doc_word": d, "length": n} for i, d, n in both[x][0]] for x in at]
            chosen = pa.array(at, pa.int64())
            columns = [batch.column("doc_id").take(chosen), batch.column("item_id").take(chosen), pa.array([both[x][1] for x in at], pa.float64()), pa.array([len(t) for t in tiles], pa.int64()), pa.array([max(x["length"] for x in t) for t in tiles], pa.int64()), pa.array(tiles, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "coverage", "n_tiles", "longest", "tiles"])

    asked = pairs.join(items.select("item", "item_id", F.col("text").alias("item_text")), "item").join(hits, "row")
    return asked.select("doc_id", "item_id", "item_text", "text").mapInArrow(rows, SCHEMA)
