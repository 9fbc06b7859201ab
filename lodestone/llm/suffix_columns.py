"""Removal of repeated byte strings by a column-wise suffix order of many strings.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts earlier, in a document
of smaller id or further ahead in the same one. Strings are judged on the input.

Hashes only bring strings together; which of them are equal is decided by the order of their bytes.
Every window of ``LENGTH`` bytes is represented by its least hashed ``GRAM``-byte string; equal
windows have the same one. Neighbouring windows with the same representative form a passage, and
passages meet by representative. Collections of passages get their Burrows-Wheeler transform and
longest common prefixes column by column from the right end. A symbol is a word of ``WORD`` bytes, in
step with the representative, which equal windows have at the same offset. A round inserts one symbol
of every string: the symbol is entered where the string's last suffix stands, the stable order of the
symbols gives the places of the new suffixes, and the common prefixes with both neighbours follow
from the least value in between. Transform and prefixes are read and rewritten in sequential passes,
a chunk at a time, in files once they outgrow ``IN_MEMORY``. In the end intervals with common prefixes
of all whole words of a window, and the same bytes at its edges, hold the equal windows; of each all
but the first are repeats.

This is done twice. Each task orders the passages of its own texts that meet there, and drops those
of which every window stands earlier in the same task; so a string that is everywhere comes once
from each task. What is left meets across tasks: of representatives that several passages have, the
bytes are fetched and ordered. Representatives with more than ``MOST_IN_GROUP`` passages are split
by ever longer strings around them (``CONTEXTS``): a window holds at least half of what is missing
on one side, so equal windows stay together on every level, and the longest string is the window
itself. At most that many passages of a representative, or as many as there are tasks that hold one
and the same window, meet in one task.

Null texts are empty; texts shorter than ``LENGTH`` bytes keep all; an empty table gives an empty one.
A text is cut in blocks of ``BLOCK`` bytes with an overlap, so long ones are only read and hashed
whole where they are written back. Rows that share a doc_id are told apart, and ordered, by the hash
of their text; rows alike in both are one document, reported for each row. Documents without an id
come first. Ties between equal windows go to the earlier one. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common

LENGTH, GRAM, WORD = 100, 32, 4
#: Bytes beside its representative that a window takes in on at least one side.
SIDE = (LENGTH - GRAM) // 2
#: Windows of a passage, at most: as many as may hold one and the same place of its representative.
MOST_WINDOWS = LENGTH - GRAM + 1
#: Sizes of the strings that crowded representatives are split by, each half-way to the window.
CONTEXTS = (66, 83, 92, 96, 98, 99, 100)
#: Bytes of a text that are looked at together; longer texts are cut with an overlap.
BLOCK = 2 << 20
#: Bytes of text whose passages a task orders together.
HELD = 8 << 20
#: Bytes of a collection; passages of one representative that are ordered together, at most.
COLLECTION, MOST_IN_GROUP = 4 << 20, 512
#: Symbols from which on transform and prefixes are in files, and those of a chunk of a pass.
IN_MEMORY, CHUNK = 1 << 18, 1 << 16
#: Low bits of a hash that give way to the place in a buffer.
PLACE_BITS = 24
OPEN, REPEAT = 0, 1
ROWS = "key long, doc_id long, begin long, size int, kind int"
PIECES = "key long, doc_id long, begin long, at int, data binary, size int, kind int"
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(29))


_BYTE = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _M1)
_BASE = int(_M3)
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of the ``size`` bytes (a power of two) from each place, by doubling."""
    h, step, power = _BYTE[data], 1, _M3
    with np.errstate(over="ignore"):
        while step < size:
            h = h[:-step] * power + h[step:]
            power, step = power * power, 2 * step
        return _mixed(h)


def least_ahead(values: np.ndarray, n: int) -> np.ndarray:
    """The least of the ``n`` values from each place on, by doubling."""
    step = 1
    while 2 * step <= n:
        values, step = np.minimum(values[:-step], values[step:]), 2 * step
    return np.minimum(values[: len(values) - (n - step)], values[n - step :]) if step < n else values


class Prints:
    """Hashes of any substring of a buffer, from sums of its weighted bytes."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            self.powers = _powers(_BASE, len(data) + 1)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_INVERSE, len(data) + 1)[:-1])])

    def of(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            own = (self.sums[begin + size] - self.sums[begin]) * self.powers[begin]
            return _mixed(own + size.astype(np.uint64) * _M1)


def passages(parts: list[bytes], most_windows: int = MOST_WINDOWS, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Passages of several byte strings: (string, begin in it, size, representative, whether it may repeat itself).

    The representative is the gram with the least hash, by its high bits and then by its place in the
    window, which does not depend on what else is in the buffer. A passage in which it stands more
    than once may hold equal windows.
    """
    if sum(map(len, parts)) >> PLACE_BITS:
        raise ValueError(f"a buffer holds less than {1 << PLACE_BITS} bytes")
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, bool))
    if len(data) < length:
        return none
    ends = np.cumsum(sizes)
    begins = ends - sizes
    live = np.zeros(len(data) + 1, np.int64)
    long_enough = sizes >= length
    np.add.at(live, begins[long_enough], 1)
    np.add.at(live, ends[long_enough] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(live)[:-1] > 0)
    if not len(starts):
        return none
    hashes = gram_hashes(data)
    # Equal windows have their least (by the high bits, then by place) at the same offset, in whatever buffer they are.
    mask = np.uint64((1 << PLACE_BITS) - 1)
    place = least_ahead(hashes & ~mask | np.arange(len(hashes), dtype=np.uint64), length - GRAM + 1)[starts] & mask
    least = hashes[place]
    owner = np.searchsorted(ends, starts, "right")
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    run = np.cumsum(fresh) - 1
    within = np.arange(len(starts)) - np.flatnonzero(fresh)[run]
    first = np.flatnonzero(within % most_windows == 0)
    count = np.diff(np.append(first, len(starts)))
    return owner[first], starts[first] - begins[owner[first]], count + length - 1, least[first], place[first] != place[first + count - 1]


def _cut(raws: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Texts, the long ones in overlapping blocks, in bounded groups: (strings, their rows, their offsets)."""
    strings: list[bytes] = []
    rows: list[int] = []
    offsets: list[int] = []
    held = 0
    for row, raw in enumerate(raws):
        for at in range(0, max(1, len(raw) - LENGTH + 1), BLOCK):
            part = raw[at : at + BLOCK + LENGTH - 1]
            if held + len(part) > 2 * BLOCK and strings:
                yield strings, np.array(rows), np.array(offsets)
                strings, rows, offsets, held = [], [], [], 0
            strings.append(part)
            rows.append(row)
            offsets.append(at)
            held += len(part)
    if strings:
        yield strings, np.array(rows), np.array(offsets)


def _batch(key: np.ndarray, doc: np.ndarray, begin: np.ndarray, size: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(key), 50_000):
        part = slice(at, at + 50_000)
        columns = [key[part].view(np.int64), doc[part], begin[part], size[part].astype(np.int32), np.full(len(key[part]), kind, np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "doc_id", "begin", "size", "kind"])


def _merged(doc: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches with those of a document that meet or overlap made one."""
    if not len(doc):
        return doc, begin, size
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], (begin + size)[order]
    # Ends rise within a document once every document lies beyond the one before.
    span = int(end.max()) + 1
    number = np.cumsum(np.append(False, doc[1:] != doc[:-1]))
    upto = np.maximum.accumulate(end + number * span) - number * span
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (begin[1:] > upto[:-1])
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(doc) - 1)
    return doc[fresh], begin[fresh], upto[last] - begin[fresh]


def _settled(doc: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray, periodic: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Which passages of a task go on, and the stretches that repeat others of the same task.

    ``doc`` numbers the texts, ``data`` holds their bytes, ``begin`` is a place in them.
    """
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    met = np.append(False, same) | np.append(same, False)
    chosen = order[met | periodic[order]]
    strings = [data[d][b : b + s] for d, b, s in zip(doc[chosen].tolist(), begin[chosen].tolist(), size[chosen].tolist(), strict=True)]
    goes_on = np.ones(len(key), bool)
    stretches = []
    for part, found, whole in ordered(key[chosen], doc[chosen], begin[chosen], strings):
        goes_on[chosen[part[whole]]] = False
        stretches.append(found)
    return goes_on, tuple(np.concatenate(c) for c in zip(*stretches, strict=True)) if stretches else (np.zeros(0, np.int64),) * 3


def candidates(docs: DataFrame) -> DataFrame:
    """Of all texts (columns doc_id, text) the stretches that repeat others of their task, and the passages that go on."""

    def settle(held: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        # In order of documents, so that the first of equal windows is the earlier one.
        held = sorted(held, key=lambda h: h[:2])
        ids, offsets = (np.array([h[i] for h in held], np.int64) for i in (0, 1))
        columns = []
        for at, group in _groups([len(h[2]) for h in held]):
            owner, *rest = passages([held[i][2] for i in group])
            columns.append((owner + at, *rest))
        owner, begin, size, key, periodic = (np.concatenate(c) for c in zip(*columns, strict=True))
        goes_on, (doc, start, span) = _settled(owner, begin, size, key, periodic, [h[2] for h in held])
        # Blocks of one text are put together again; equal rows (id and text) are one document.
        gone = _merged(ids[doc], start + offsets[doc], span)
        yield from _batch(np.zeros(len(gone[0]), np.int64), *gone, REPEAT)
        owner, begin, size, key = owner[goes_on], begin[goes_on], size[goes_on], key[goes_on]
        yield from _batch(key, ids[owner], begin + offsets[owner], size, OPEN)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in common.text_slices(batches):
            ids = batch.column("doc_id").to_pylist()
            for strings, row, offset in _cut(common.utf8(batch.column("text"))):
                for string, r, o in zip(strings, row.tolist(), offset.tolist(), strict=True):
                    if len(string) >= LENGTH:
                        held.append((ids[r], o, string))
                        size += len(string)
                if size >= HELD:
                    yield from settle(held)
                    held, size = [], 0
        if held:
            yield from settle(held)

    return docs.select("doc_id", "text").mapInArrow(rows, ROWS)


def _groups(sizes: list[int]) -> Iterator[tuple[int, range]]:
    """Neighbouring strings of up to two blocks together: (first, all)."""
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > 2 * BLOCK:
            yield first, range(first, i)
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield first, range(first, len(sizes))


def shared(rows: DataFrame) -> DataFrame:
    """Passages whose representative others have as well, with their number ``n``.

    Counts are gathered before they are shuffled, and written: then a representative with very many
    passages is one that Spark deals out anew where it joins (a skewed join).
    """
    counts = common.written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    return rows.drop("kind").join(counts, "key")


def _room(n: int, kind: type, folder: str, name: str) -> np.ndarray:
    """Zeroed numbers, in a file of the folder if there are many."""
    return np.memmap(f"{folder}/{name}", kind, "w+", shape=(n,)) if n > IN_MEMORY else np.zeros(n, kind)


def _stable_order(symbols: np.ndarray, alphabet: int) -> np.ndarray:
    """The stable order of numbers under ``alphabet``, by halves of 16 bits."""
    order = np.argsort(symbols.astype(np.uint16), kind="stable")
    return order if alphabet <= 1 << 16 else order[np.argsort((symbols >> 16).astype(np.uint16)[order], kind="stable")]


def _least_upto(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The least of ``values[:end]`` for rising ends of 1 or more."""
    return np.minimum.accumulate(np.minimum.reduceat(values[: ends[-1]], np.append(0, ends[:-1])))


class _Round:
    """What a pass over the transform gathers while a round's symbols are entered."""

    def __init__(self, alphabet: int) -> None:
        self.alphabet = alphabet
        self.count = np.zeros(alphabet, np.int64)
        self.seen = np.zeros(alphabet, bool)
        self.last_is_new = np.zeros(alphabet, bool)
        self.least_since = np.full(alphabet, 255, np.uint8)
        self.found: list[tuple[np.ndarray, ...]] = []

    def take(self, symbols: np.ndarray, prefixes: np.ndarray, entered: np.ndarray, who: np.ndarray) -> None:
        """A chunk: its symbols, among them those entered (at rising places, for strings), and its prefixes."""
        n = len(symbols)
        order = _stable_order(symbols, self.alphabet)
        here = np.bincount(symbols, minlength=self.alphabet)
        letters = np.flatnonzero(here)
        upto = np.cumsum(here[letters])
        heads = upto - here[letters]
        marks = np.zeros(n, bool)
        marks[entered] = True
        fresh = marks[order]
        # A prefix changes where the symbol, or the same one before it, is new.
        changed = fresh.copy()
        changed[1:] |= fresh[:-1]
        changed[heads] = fresh[heads] | self.seen[letters] & self.last_is_new[letters]
        at = np.flatnonzero(changed)
        group = np.searchsorted(heads, at, "right") - 1
        if letters[0] == 0:
            at, group = at[group > 0], group[group > 0]
        letter, place = letters[group], order[at]
        value = np.zeros(len(at), np.uint8)
        inner = at > heads[group]
        value[inner] = _least_between(prefixes, order[at[inner] - 1] + 1, place[inner] + 1)
        if not inner.all():
            outer = np.flatnonzero(~inner)
            outer = outer[np.argsort(place[outer])]
            value[outer] = np.where(self.seen[letter[outer]], np.minimum(_least_upto(prefixes, place[outer] + 1), self.least_since[letter[outer]]), 0)
        value += (inner | self.seen[letter]) & (value < 255)
        string = np.full(len(at), -1, np.int64)
        new = fresh[at]
        string[new] = who[np.searchsorted(entered, place[new])]
        self.found.append((letter, at - heads[group] + self.count[letter], value, string))
        # For the chunks that follow: the last place of each symbol here, and the least prefix behind it.
        last = order[upto - 1]
        by_place = np.argsort(-last)
        behind = _least_upto(np.append(np.uint8(255), prefixes[::-1]), n - last[by_place])
        np.minimum(self.least_since, prefixes.min(), out=self.least_since)
        self.least_since[letters[by_place]] = behind
        self.last_is_new[letters] = fresh[upto - 1]
        self.seen[letters] = True
        self.count += here


def column_order(columns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform and longest common prefixes (up to 255) of all suffixes of the strings.

    ``columns[r]`` holds the symbol ``r`` places from the end of every string, 1 or more, and 0 past
    its beginning. Suffixes are in order of their symbols; the empty ones come first. The transform
    has 0 for whole strings. A round takes two sequential passes: one that enters the symbols and
    finds the places and prefixes of the new suffixes, one that writes the next files.
    """
    m, rounds = len(sizes), int(sizes.max(initial=0))
    alphabet = int(columns.max(initial=0)) + 1
    place, string = np.arange(m), np.arange(m)
    with tempfile.TemporaryDirectory() as folder:
        whole = m + int(sizes.sum())
        files = [[_room(whole, kind, folder, f"{kind.__name__}{i}") for kind in (np.uint32, np.uint8)] for i in (0, 1)]
        size = m
        for r in range(rounds):
            symbols, prefixes = (x[:size] for x in files[r & 1])
            longer = sizes[string] > r
            place, string = place[longer], string[longer]
            gathered = _Round(alphabet)
            cuts = np.searchsorted(place, np.arange(0, size + CHUNK, CHUNK))
            for i, begin in enumerate(range(0, size, CHUNK)):
                own = slice(cuts[i], cuts[i + 1])
                chunk = symbols[begin : begin + CHUNK]
                chunk[place[own] - begin] = columns[r][string[own]]
                gathered.take(np.asarray(chunk), np.asarray(prefixes[begin : begin + CHUNK]), place[own] - begin, string[own])
            letter, rank, value, who = (np.concatenate(c) for c in zip(*gathered.found, strict=True))
            gathered.count[0] = 0
            row = m + (np.cumsum(gathered.count) - gathered.count)[letter] + rank
            order = np.argsort(row)
            row, value, who = row[order], value[order], who[order]
            new = who >= 0
            place, string = row[new], who[new]
            size += len(place)
            next_symbols, next_prefixes = (x[:size] for x in files[~r & 1])
            starts = np.arange(0, size + CHUNK, CHUNK)
            cuts, changes = np.searchsorted(place, starts), np.searchsorted(row, starts)
            for i, begin in enumerate(range(0, size, CHUNK)):
                here = min(CHUNK, size - begin)
                taken = slice(begin - cuts[i], begin - cuts[i] + here - int(cuts[i + 1] - cuts[i]))
                part, own = next_prefixes[begin : begin + here], next_symbols[begin : begin + here]
                if cuts[i] == cuts[i + 1]:
                    own[:], part[:] = symbols[taken], prefixes[taken]
                else:
                    old = np.ones(here, bool)
                    old[place[cuts[i] : cuts[i + 1]] - begin] = False
                    own[~old] = 0
                    own[old], part[old] = symbols[taken], prefixes[taken]
                part[row[changes[i] : changes[i + 1]] - begin] = value[changes[i] : changes[i + 1]]
        return tuple(np.array(x[:size]) for x in files[rounds & 1])


def _least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``values[low:high]`` for each pair, from the least of spans that double."""
    if not len(low):
        return np.zeros(0, np.uint8)
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    out = np.empty(len(low), np.uint8)
    for at in range(int(level.max()) + 1):
        if at:
            values = np.minimum(values[: -(1 << at - 1)], values[1 << at - 1 :])
        here = np.flatnonzero(level == at)
        out[here] = np.minimum(values[low[here]], values[high[here] - (1 << at)])
    return out


def equal_windows(strings: list[bytes], owner: np.ndarray, phase: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the strings as (entry, place, set of equal windows), from their suffix order.

    An entry is a string (``owner``) whose words begin at ``phase`` and every ``WORD`` bytes from there;
    sets are told apart by where in a word their windows begin. The length is a multiple of ``WORD``, so
    that the bytes beside whole words make one word.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(sizes)
    flat = np.frombuffer(b"".join(strings) + bytes(2 * WORD), np.uint8)
    begin = (ends - sizes)[owner]
    cells = np.maximum(sizes[owner] - phase, 0) // WORD
    width = int(cells.max(initial=0))
    entry = np.repeat(np.arange(len(owner)), cells)
    number = np.arange(len(entry)) - np.repeat(np.cumsum(cells) - cells, cells)
    words = np.lib.stride_tricks.sliding_window_view(flat, WORD)[(begin + phase)[entry] + WORD * number].copy().view(np.uint32)[:, 0]
    columns = np.zeros((width, len(owner)), np.uint32)
    columns[cells[entry] - 1 - number, entry] = np.unique(words, return_inverse=True)[1] + 1
    symbols, common_prefix = column_order(columns, cells)
    # Windows that begin ``lead`` bytes before a word have so many whole words; the rest is compared as bytes.
    intervals = {n: np.cumsum(common_prefix < n) for n in {(length - lead) // WORD for lead in range(WORD)}}
    order = _stable_order(symbols, int(symbols.max(initial=0)) + 1)
    whole = len(symbols) - np.count_nonzero(symbols)
    behind = np.empty(len(symbols), np.int64)
    behind[order] = np.arange(len(symbols)) - whole + len(owner)
    alive = place = np.arange(len(owner))
    out = []
    for size in range(1, width + 1):
        keep = cells[alive] >= size
        alive, place = alive[keep], behind[place[keep]]
        for lead in range(WORD):
            n = (length - lead) // WORD
            window = phase[alive] + WORD * (cells[alive] - size) - lead
            fits = (window >= 0) & (window <= sizes[owner[alive]] - length)
            if not fits.any():
                continue
            at = begin[alive[fits]] + window[fits]
            edge = np.zeros(len(at), np.int64)
            for i in (*range(lead), *range(lead + WORD * n, length)):
                edge = edge << 8 | flat[at + i]
            out.append((alive[fits], window[fits], ((intervals[n][place[fits]] * WORD + lead) << 8 * WORD) | edge))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _places(key: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings (their bytes one after the other) hold their representative: (string, place in all bytes)."""
    hashes = gram_hashes(flat) if len(flat) >= GRAM else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(hashes)]
    at = np.flatnonzero((hashes == key.view(np.uint64)[owner]) & (np.arange(len(hashes)) + GRAM <= np.cumsum(sizes)[owner]))
    return owner[at], at


def may_share(key: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """Which passages may hold a window that another passage of their representative, or they themselves, hold as well.

    A window has at least half of its bytes beyond the representative on one side of it. So what two
    passages share takes in the ``SIDE`` bytes before the representative, or those behind it.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(sizes)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    owner, at = _places(key, flat, sizes)
    prints = Prints(flat)
    needed = np.bincount(owner, minlength=len(strings)) != 1
    for begin in (at - SIDE, at):
        whole = (begin >= (ends - sizes)[owner]) & (begin + GRAM + SIDE <= ends[owner])
        mark = prints.of(begin[whole], np.full(whole.sum(), GRAM + SIDE))
        with np.errstate(over="ignore"):
            mark = _mixed(mark + key.view(np.uint64)[owner[whole]] * _M3)
        order = np.argsort(mark, kind="stable")
        twin = mark[order[1:]] == mark[order[:-1]]
        met = np.zeros(len(mark), bool)
        met[order[1:][twin]] = met[order[:-1][twin]] = True
        needed[owner[whole][met]] = True
    return needed


def ordered(key: np.ndarray, doc: np.ndarray, begin: np.ndarray, strings: list[bytes], at: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray]]:
    """Passages in order of their keys, in collections of whole keys: (which, stretches that repeat others, whether all of one does).

    Passages that are the same byte for byte are entered once, for the first of them. ``at`` is the
    place of the representative in each, where it is known otherwise than by its hash; if it is not,
    passages without a copy that cannot share a window are left out before.
    """
    if not strings:
        return
    known: dict[tuple[int, bytes], int] = {}
    number = np.fromiter((known.setdefault(k, len(known)) for k in zip(key.tolist(), strings, strict=True)), np.int64, len(strings))
    order = np.lexsort((begin, doc, number))
    head = np.ones(len(order), bool)
    head[1:] = number[order][1:] != number[order][:-1]
    firsts = order[head]
    several = np.diff(np.append(np.flatnonzero(head), len(order))) > 1
    copies, of = order[~head], firsts[np.cumsum(head) - 1][~head]
    later = (doc[copies] != doc[of]) | (begin[copies] != begin[of])
    if len(copies):
        again = copies[later]
        yield copies, (doc[again], begin[again], np.array([len(strings[i]) for i in again], np.int64)), np.ones(len(copies), bool)
    # Distinct strings are numbered as they come, so keys stay in order.
    part = firsts
    if at is None:
        part = firsts[several | may_share(key[firsts], [strings[i] for i in firsts])]
    upto = np.cumsum([len(strings[i]) for i in part])
    edges = np.append(np.flatnonzero(key[part][1:] != key[part][:-1]) + 1, len(part)) if len(part) else part
    first = 0
    for edge in edges.tolist():
        if edge == len(part) or upto[edge - 1] - (upto[first - 1] if first else 0) >= COLLECTION:
            own = part[first:edge]
            *found, whole = repeats_among(key[own], doc[own], begin[own], [strings[i] for i in own], None if at is None else at[own])
            yield own, tuple(found), whole
            first = edge


def repeats_among(key: np.ndarray, doc: np.ndarray, begin: np.ndarray, strings: list[bytes], at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (doc, begin, size) of the strings that are covered by windows found earlier, and which strings are so throughout.

    A string in which the representative stands several times is entered once for every step of words
    that its places ask for; a window then counts where its own, the next place from it on, does.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    starts = np.cumsum(sizes) - sizes
    if at is None:
        held, places = _places(key, np.frombuffer(b"".join(strings), np.uint8), sizes)
        entries = np.unique(held * WORD + (places - starts[held]) % WORD)
        owner, phase = entries // WORD, entries % WORD
    else:
        owner, phase = np.arange(len(strings)), at.astype(np.int64) % WORD
    entry, place, group = equal_windows(strings, owner, phase)
    string = owner[entry]
    if at is None and len(owner) > len(strings):
        following = places[np.searchsorted(places, starts[string] + place)]
        own = (following - starts[string]) % WORD == phase[entry]
        string, place, group = string[own], place[own], group[own]
    # Windows in order of their texts and places, as one number each; the least of a set is the first.
    order = np.lexsort((begin, doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (doc[order][1:] != doc[order][:-1]) | (begin[order][1:] != begin[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh)
    when = rank[string] * int(sizes.max(initial=1)) + place
    by_group = np.argsort(group)
    head = np.ones(len(group), bool)
    head[1:] = group[by_group][1:] != group[by_group][:-1]
    heads = np.flatnonzero(head)
    earliest = np.minimum.reduceat(when[by_group], heads) if len(heads) else when
    gone = np.zeros(int(sizes.sum()) + 1, np.int8)
    chosen = by_group[when[by_group] != earliest[np.cumsum(head) - 1]] if len(heads) else by_group
    gone[starts[string[chosen]] + place[chosen]] = 1
    # A string's last windows begin before its end, so runs never go on into the next one.
    turns = np.diff(gone, prepend=np.int8(0))
    low, high = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    of = np.searchsorted(starts, low, "right") - 1
    whole = np.bincount(of, high - low, len(strings)).astype(np.int64) == sizes - LENGTH + 1
    return doc[of], begin[of] + low - starts[of], high - low + LENGTH - 1, whole


def fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of passages (key, n, doc_id, begin, size).

    A text meets the list of what is wanted of it, which is no longer than a small multiple of the text.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches):
            ids, raws = batch.column("doc_id").to_pylist(), common.utf8(batch.column("text"))
            for doc, raw, asked in zip(ids, raws, batch.column("asked"), strict=True):
                key, n, begin, size = (asked.values.field(c).to_numpy(zero_copy_only=False) for c in ("key", "n", "begin", "size"))
                for at in range(0, len(key), 20_000):
                    part = slice(at, at + 20_000)
                    data = [raw[b : b + s] for b, s in zip(begin[part].tolist(), size[part].tolist(), strict=True)]
                    columns = [pa.array(key[part]), pa.array(n[part]), pa.array(np.full(len(data), doc, np.int64)), pa.array(begin[part]), pa.array(data, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "doc_id", "begin", "data"])

    asked = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("key", "n", "begin", "size")).alias("asked"))
    return docs.select("doc_id", "text").join(asked, "doc_id").mapInArrow(rows, "key long, n long, doc_id long, begin long, data binary").withColumn("at", F.lit(-1))


def ordered_repeats(pieces: DataFrame, placed: bool) -> DataFrame:
    """Repeats among passages (key, doc_id, begin, at, data) of a representative, in collections of whole ones.

    ``placed``: the representative stands at ``at``; otherwise it is known by its hash.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(upto: int | None) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            key, doc, begin, at = (np.concatenate([h[i] for h in held]) for i in range(4))
            data = [d for h in held for d in h[4]]
            end = len(key) if upto is None else upto
            for _, found, _ in ordered(key[:end], doc[:end], begin[:end], data[:end], at[:end] if placed else None):
                gone = _merged(*found)
                yield from _batch(np.zeros(len(gone[0]), np.int64), *gone, REPEAT)
            held = [(key[end:], doc[end:], begin[end:], at[end:], data[end:])] if end < len(key) else []
            size = sum(map(len, data[end:]))

        for batch in batches:
            for first in range(0, batch.num_rows, 2_000):
                part = batch.slice(first, 2_000)
                data = part.column("data").to_pylist()
                held.append((*(part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc_id", "begin", "at" if placed else "key")), data))
                size += sum(map(len, data))
                if size >= COLLECTION:
                    keys = np.concatenate([h[0] for h in held])
                    if upto := int(np.searchsorted(keys, keys[-1], "left")):
                        yield from flush(upto)
        if held:
            yield from flush(None)

    own = pieces.select("key", "doc_id", "begin", *(["at"] if placed else []), "data")
    return own.repartition("key").sortWithinPartitions("key").mapInArrow(rows, ROWS)


def _anchors(key: np.ndarray, begin: np.ndarray, at: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of every window of the passages: (passage, its place in all bytes, the place of what it is represented by)."""
    sizes = np.array([len(d) for d in data], np.int64)
    starts = np.cumsum(sizes) - sizes
    count = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(data)), count)
    window = starts[owner] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    if at[0] >= 0:
        return owner, window, (starts + at)[owner]
    # At first the representative is known by its hash alone: the next place of it from the window on.
    places = _places(key, np.frombuffer(b"".join(data), np.uint8), sizes)[1]
    return owner, window, places[np.searchsorted(places, window)]


def refined(crowded: DataFrame, level: int) -> DataFrame:
    """Passages of crowded representatives, cut into those of longer ones and settled within the task.

    A window holds its representative and at least half of the bytes still missing to the next size
    on one side of it; with these it makes the next representative.
    """
    known, size = (GRAM, *CONTEXTS)[level], CONTEXTS[level]
    more = size - known

    def settle(key: np.ndarray, doc: np.ndarray, begin: np.ndarray, at: np.ndarray, data: list[bytes]) -> Iterator[pa.RecordBatch]:
        flat = np.frombuffer(b"".join(data), np.uint8)
        owner, window, anchor = _anchors(key, begin, at, data)
        left = anchor - window >= more
        context = np.where(left, anchor - more, anchor)
        fresh = np.ones(len(window), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (context[1:] != context[:-1]) | (left[1:] != left[:-1])
        first = np.flatnonzero(fresh)
        count = np.diff(np.append(first, len(window)))
        owner, left, context, window = owner[first], left[first], context[first], window[first]
        with np.errstate(over="ignore"):
            mark = Prints(flat).of(context, np.full(len(first), size))
            key = _mixed(mark * _M1 + np.where(left, _M2, _M3))
        start = np.cumsum([0, *map(len, data)])[owner]
        begin, span = begin[owner] + window - start, count + LENGTH - 1
        order = np.lexsort((begin, doc[owner], key))
        owner, key, begin, span, context, window = (c[order] for c in (owner, key, begin, span, context, window))
        strings = [flat[w : w + s].tobytes() for w, s in zip(window.tolist(), span.tolist(), strict=True)]
        goes_on = np.ones(len(key), bool)
        for part, found, whole in ordered(key, doc[owner], begin, strings, context - window):
            goes_on[part[whole]] = False
            gone = _merged(*found)
            yield _pieces(np.zeros(len(gone[0]), np.int64), gone[0], gone[1], np.zeros(len(gone[0])), [None] * len(gone[0]), gone[2], REPEAT)
        for at in range(0, len(key), 20_000):
            kept = np.flatnonzero(goes_on[at : at + 20_000]) + at
            yield _pieces(key[kept], doc[owner[kept]], begin[kept], (context - window)[kept], [strings[i] for i in kept], span[kept], OPEN)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        symbols = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                part = batch.slice(start, 2_000)
                data = part.column("data").to_pylist()
                held.append((*(part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc_id", "begin", "at")), data))
                symbols += sum(map(len, data))
                if symbols >= COLLECTION:
                    yield from settle(*(np.concatenate([h[i] for h in held]) for i in range(4)), [d for h in held for d in h[4]])
                    held, symbols = [], 0
        if held:
            yield from settle(*(np.concatenate([h[i] for h in held]) for i in range(4)), [d for h in held for d in h[4]])

    return crowded.select("key", "doc_id", "begin", "at", "data").mapInArrow(rows, PIECES)


def _pieces(key: np.ndarray, doc: np.ndarray, begin: np.ndarray, at: np.ndarray, data: list, size: np.ndarray, kind: int) -> pa.RecordBatch:
    columns = [pa.array(key.view(np.int64)), pa.array(doc), pa.array(begin), pa.array(at.astype(np.int32)), pa.array(data, pa.binary()), pa.array(size.astype(np.int32)), pa.array(np.full(len(key), kind, np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "begin", "at", "data", "size", "kind"])


def kept_bytes(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed spans."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches):
            out = []
            for key, raw, gone in zip(batch.column("id").to_pylist(), common.utf8(batch.column("text")), batch.column("gone"), strict=True):
                spans = _united(gone)
                digest, at = hashlib.sha256(), 0
                for begin, end in spans:
                    digest.update(raw[at:begin])
                    at = end
                digest.update(raw[at:])
                out.append((key, len(raw), sum(e - b for b, e in spans), len(spans), digest.hexdigest(), [{"begin": b, "end": e} for b, e in spans]))
            span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            types = [pa.int64()] * 4 + [pa.string(), span]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    gone = repeats.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "size")).alias("gone"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:long,end:long>>"
    return docs.join(gone, "doc_id", "left").select("id", "text", "gone").mapInArrow(rows, schema)


def _united(gone: pa.Scalar) -> list[tuple[int, int]]:
    """Removed stretches as maximal runs."""
    if not gone.is_valid:
        return []
    begin, size = (gone.values.field(n).to_numpy(zero_copy_only=False) for n in ("begin", "size"))
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate((begin + size)[order])
    fresh = np.ones(len(begin), bool)
    fresh[1:] = begin[1:] > end[:-1]
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(begin) - 1)
    return list(zip(begin[fresh].tolist(), end[last].tolist(), strict=True))


def numbered(docs: DataFrame) -> DataFrame:
    """Columns id (as given), doc_id (not null, one for each document, in the same order) and text.

    Where ids are unique, which is looked up first, they stay. Otherwise documents are numbered in
    order of their id and then of the hash of their text; the numbers rise but leave gaps, so no task
    sees all documents.
    """
    own = common.only(docs, "doc_id", "text").withColumnRenamed("doc_id", "id").withColumn("id", F.col("id").cast("long"))
    odd = own.groupBy("id").count().where("count > 1 OR id IS NULL")
    if odd.isEmpty():
        return own.withColumn("doc_id", F.col("id"))
    marked = own.withColumn("mark", F.xxhash64("text"))
    distinct = marked.select(F.col("id").alias("r_id"), F.col("mark").alias("r_mark")).distinct()
    ranks = common.written(distinct.orderBy(F.col("r_id").asc_nulls_first(), "r_mark").withColumn("doc_id", F.monotonically_increasing_id()), "ranks")
    return marked.join(ranks, marked["id"].eqNullSafe(ranks["r_id"]) & (marked["mark"] == ranks["r_mark"])).select("id", "doc_id", "text")


def remove_repeats(docs: DataFrame, most_in_group: int = MOST_IN_GROUP) -> DataFrame:
    """What is left of each document once repeated strings are gone; see ``kept_bytes``."""
    own = numbered(docs)
    found = common.written(candidates(own), "passages")
    stretch = ("doc_id", "begin", "size")
    repeats = found.where(F.col("kind") == REPEAT).select(*stretch)
    pieces = common.written(fetched(own, shared(found.where(F.col("kind") == OPEN))), "pieces")
    columns = ("key", "doc_id", "begin", "at", "data")
    ordered_ones = ordered_repeats(pieces.where(F.col("n") <= most_in_group), placed=False).select(*stretch)
    crowded, to_order = pieces.where(F.col("n") > most_in_group), []
    for level in range(len(CONTEXTS)):
        if crowded.isEmpty():
            break
        finer = common.written(refined(crowded, level), "finer")
        repeats = repeats.unionByName(finer.where(F.col("kind") == REPEAT).select(*stretch))
        again = common.written(shared(finer.where(F.col("kind") == OPEN)), "crowded")
        # The last strings are the windows themselves, once from each task: nothing is left to split.
        last = level + 1 == len(CONTEXTS)
        to_order.append(again.where(F.lit(last) | (F.col("n") <= most_in_group)).select(*columns))
        crowded = again.where(~F.lit(last) & (F.col("n") > most_in_group))
    if to_order:
        ordered_ones = ordered_ones.unionByName(ordered_repeats(reduce(DataFrame.unionByName, to_order), placed=True).select(*stretch))
    return kept_bytes(own, repeats.unionByName(ordered_ones))
