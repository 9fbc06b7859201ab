"""Periodic runs of words: stretches that repeat themselves four times or more, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q and at least ``max(least, exponent * q)``
words, which no neighbouring word extends keeping that period. Two copies of it, q words apart, share
all but q of its words, hence at least ``shared_words`` whatever q is. So every word of a run lies in a
k-gram of that many words found twice in its document: all other words are masked, cannot join runs,
and cut the document into segments. Segments are searched by halving, as Main and Lorentz do: a run
that crosses the middle of a block reaches at least half its length to one side of it, so for each
period the words beside the middle are held against those a period away, and where they agree the
common extensions give the run. All blocks of a level, and all documents of a batch, go at once; the
extensions are read off ranks of words doubled in length, so they are exact.

Null or empty text, or text of separators only: no words, no run, an empty collapsed text. Every text
is taken whole; a long one is a batch of its own, and memory grows with the words of its segments
times the logarithm of the longest. Ties for the strongest run go to the smallest start, then period.
A null doc_id is passed on, repeated rows are judged row by row, an empty table gives an empty one.
Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common

EXPONENT, LEAST = 4, 6
RUN = "start: bigint, length: bigint, period: bigint"
SCHEMA = f"doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<{RUN}>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def shared_words(exponent: int = EXPONENT, least: int = LEAST) -> int:
    """The fewest words that a run shares with itself one period on: ``max(least, exponent * q) - q`` at its least."""
    return min(max(least, exponent * q) - q for q in range(1, least + 1))


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes: the group of each member, and its number there."""
    groups = np.repeat(np.arange(len(counts)), counts)
    return groups, np.arange(len(groups)) - np.repeat(np.cumsum(counts) - counts, counts)


def repeated_cover(ids: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that their document (of ``sizes`` words each) holds twice or more.

    Grams are told apart by a hash of 64 bits, so a word may be let through in error, never masked in error.
    """
    n, none = len(ids), np.zeros(len(ids), bool)
    if n < k + 1:
        return none
    document, at = _spread(sizes)
    inside = np.flatnonzero(at <= sizes[document] - k)
    with np.errstate(over="ignore"):
        scattered = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        scattered ^= scattered >> np.uint64(29)
        grams = document[inside].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        for step in range(k):
            grams = grams * np.uint64(0xBF58476D1CE4E5B9) + scattered[inside + step]
    ordered = np.sort(grams)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return none
    starts = inside[twice[np.minimum(np.searchsorted(twice, grams), len(twice) - 1)] == grams]
    edges = np.zeros(n + 1, np.int64)
    edges[starts] += 1
    edges[starts + k] -= 1
    return np.cumsum(edges[:-1]) > 0


class Segments:
    """Words of segments, one after another, with ranks of all their stretches of 1, 2, 4, ... words."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray) -> None:
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        of = np.repeat(np.arange(len(sizes)), sizes)
        self.low, self.high = self.begins[of], self.ends[of]
        here, unlike = np.arange(len(words)), -1 - np.arange(len(words), dtype=np.int64)
        self.ranks = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
        while 2 ** len(self.ranks) <= sizes.max():
            half, last = 2 ** (len(self.ranks) - 1), self.ranks[-1]
            whole = np.flatnonzero(here + 2 * half <= self.high)
            ranks = unlike.copy()  # a stretch that its segment does not hold is like no other
            ranks[whole] = np.unique(last[whole] * (len(words) + 1) + last[whole + half], return_inverse=True)[1]
            self.ranks.append(ranks)

    def alike(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``2 ** level`` words from a and b on, of one segment, are there and equal."""
        if level >= len(self.ranks):
            return np.zeros(len(a), bool)
        size, ranks = 2**level, self.ranks[level]
        there = (a >= self.low[b]) & (b + size <= self.high[b])
        return there & (ranks[np.where(there, a, 0)] == ranks[np.where(there, b, 0)])

    def extents(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For places a < b of one segment: how many words agree before them, and from them on."""
        low, high = self.low[a], self.high[a]
        before, after = a.copy(), b.copy()
        gap = b - a
        for level in reversed(range(len(self.ranks))):
            size, ranks = 2**level, self.ranks[level]
            fits = np.flatnonzero(after + size <= high)
            fits = fits[ranks[after[fits] - gap[fits]] == ranks[after[fits]]]
            after[fits] += size
            fits = np.flatnonzero(before - size >= low)
            fits = fits[ranks[before[fits] - size] == ranks[before[fits] + gap[fits] - size]]
            before[fits] -= size
        return a - before, after - b

    def _candidates(self, middle: np.ndarray, reach: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Places a and periods at which the words beside the middle agree with those a period away on one side.

        A run reaches at least ``max(3, 2 * q)`` words to that side, so at least ``max(2, q)`` words agree.
        """
        block, period = _spread(np.maximum(reach, 0))
        period += 1
        at = middle[block]
        for level in (1, 2, 3):
            size = 2**level
            a = at if side > 0 else at - period - size
            b = at + period if side > 0 else at - size
            held = self.alike(level, a, b) | (period < size * (level > 1))
            at, period = at[held], period[held]
        return (at, period) if side > 0 else (at - period, period)

    def runs(self, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and smallest period of every run, by start and period."""
        low, high = self.begins, self.ends
        found = []
        while True:
            large = high - low >= least
            low, high = low[large], high[large]
            if not len(low):
                break
            middle = (low + high) // 2
            for side, reach in ((1, (high - middle) // 2), (-1, (middle - low) // 2)):
                a, period = self._candidates(middle, reach, side)
                before, after = self.extents(a, a + period)
                start, length = a - before, before + period + after
                held = length >= np.maximum(least, exponent * period)
                found.append(np.stack([start[held], length[held], period[held]]))
            low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        order = np.lexsort((period, length, start))
        start, length, period = start[order], length[order], period[order]
        # one stretch is found under its smallest period and under multiples of it
        first = np.ones(len(start), bool)
        first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
        start, length, period = start[first], length[first], period[first]
        order = np.lexsort((period, start))
        return start[order], length[order], period[order]


def runs_of(ids: np.ndarray, sizes: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start, length and period of every run in documents of ``sizes`` words each, by document, start and period."""
    if exponent < 4 or least < 6:
        raise ValueError("runs of four periods and six words are the shortest that are found")
    none = (np.zeros(0, np.int64),) * 4
    covered = repeated_cover(ids, sizes, shared_words(exponent, least))
    if not covered.any():
        return none
    document, number = _spread(sizes)
    fresh = covered & ~(np.r_[False, covered[:-1]] & (number > 0))
    kept = np.flatnonzero(covered)
    segment = np.cumsum(fresh)[kept] - 1
    lengths = np.bincount(segment)
    large = (lengths >= least)[segment]
    kept = kept[large]
    if not len(kept):
        return none
    start, length, period = Segments(ids[kept], lengths[lengths >= least]).runs(exponent, least)
    return document[kept[start]], number[kept[start]], length, period


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int | None, ...]:
    """The run of the greatest length over period, by exact fractions, with that times a thousand."""
    best = None
    for run in runs:  # by start and period, so that ties stay with the first
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return b" ".join(compress(words, (np.cumsum(edges[:-1]) == 0).tolist()))


def _judged(texts: list[bytes], exponent: int, least: int) -> list[tuple]:
    words = [text.split() for text in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    numbers = common.Numbers()
    ids = np.concatenate([numbers.of(w, len(w)) for w in words]) if words else np.zeros(0, np.int64)
    document, *run = runs_of(ids, sizes, exponent, least)
    edges = np.searchsorted(document, np.arange(len(words) + 1))
    rows = list(zip(*(x.tolist() for x in run), strict=True))
    out = []
    for own, low, high in zip(words, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        runs = rows[low:high]
        out.append((len(own), len(runs), *_strongest(runs), [{"start": s, "length": n, "period": p} for s, n, p in runs], _collapsed(own, runs)))
    return out


def find_runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """One row per document: its number of words and runs, the strongest run (nulls where there is none),
    all runs by start and period, and the text without the words that repeat a run's first period.

    ``exponent`` is at least four, ``least`` at least six.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches):
            found = _judged(common.utf8(batch.column("text")), exponent, least)
            n_words, n_runs, start, length, period, milli, runs, collapsed = map(list, zip(*found, strict=True))
            longs = [pa.array(x, pa.int64()) for x in (n_words, n_runs, start, length, period, milli)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *longs, pa.array(runs, pa.list_(_RUN)), pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"],
            )

    return common.only(docs, "doc_id", "text").mapInArrow(rows, SCHEMA)


def woven(text: Column, key: Column) -> Column:
    """The text, in which for every tenth key (by its CRC-32) the words from some place on repeat with some period.

    With ``h`` the CRC-32 of the decimal key and ``g = floor(h / 10)``, word i >= a becomes word
    ``a + (i - a) % p``, where ``a = g % n`` and ``p = 1 + floor((n - a) / (3 + g % 8))``. Other texts,
    and those without words, are left as they are. For tests of long periods on given tables.
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def turned(own: Column) -> Column:
        n = F.size(own)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, F.transform(own, lambda w, i: F.when(i < a, w).otherwise(F.get(own, (a + (i - a) % p).cast("int")))))

    changed = F.array_join(F.element_at(F.transform(F.array(words), turned), 1), " ")
    return F.when(h % 10 == 0, F.coalesce(changed, text)).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """Counts, the strongest run, and SHA-256 of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
