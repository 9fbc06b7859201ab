"""Quality rules by compression bands.

A text that zstandard shrinks too well repeats itself; one that it hardly shrinks is noise. The
ratio (compressed bytes over bytes) is taken over the whole document and over fixed chunks of it,
and each is held against limits that depend on the length compressed, since short inputs always
shrink less. Up to 64 bytes nothing can be told, up to 128 only repetition.

Null or empty text, or text of separators only: no words, base rule failed, not kept. Long texts are
compressed whole, and chunk by chunk. A ratio at a limit is within it. A null doc_id is passed on,
repeated rows are judged row by row, an empty table gives an empty one. Other columns of the input
are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from lodestone.llm import common

SYMBOLS = "#*$%&|<>"
WINDOW = 8
NO_LIMIT = 9.0
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_bytes long, ratio double, n_chunks long, n_chunks_out long, reason string"
)


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio by length: rows of (bytes up to, least ratio, greatest ratio)."""

    whole: tuple[tuple[float, float, float], ...] = (
        (64, 0.0, NO_LIMIT),
        (128, 0.55, NO_LIMIT),
        (256, 0.45, 0.95),
        (512, 0.30, 0.85),
        (1024, 0.28, 0.76),
        (4096, 0.25, 0.70),
        (16384, 0.20, 0.65),
        (float("inf"), 0.15, 0.62),
    )
    chunk: tuple[tuple[float, float, float], ...] = (
        (128, 0.0, NO_LIMIT),
        (256, 0.35, 0.95),
        (512, 0.25, 0.85),
        (1024, 0.22, 0.76),
        (float("inf"), 0.20, 0.70),
    )
    chunk_bytes: int = 4096
    #: Rejected if more than this share of its chunks is out of its limits.
    most_chunks_out: float = 0.5
    level: int = 3


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more, the first time included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        mixed = np.zeros(n, np.uint64)
        scattered = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        scattered ^= scattered >> np.uint64(29)
        for k in range(window):
            mixed = mixed * np.uint64(0xBF58476D1CE4E5B9) + scattered[k : k + n]
    order = np.argsort(mixed, kind="stable")
    twin = mixed[order[1:]] == mixed[order[:-1]]
    if not twin.any():
        return 0
    suspects = np.zeros(n, bool)
    suspects[order[1:][twin]] = True
    suspects[order[:-1][twin]] = True
    at = np.flatnonzero(suspects)
    rows = np.lib.stride_tricks.sliding_window_view(ids, window)[at]
    _, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    starts = at[counts[inverse.ravel()] > 1]
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base_counts(text: str, raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = raw.split()
    if not words:
        return 0, 0, sum(text.count(c) for c in SYMBOLS), 0, 0
    chars = len(text) - sum(text.count(c) for c in common.WORD_SEPARATORS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    known: dict[bytes, int] = {}
    number = known.setdefault
    ids = np.fromiter((number(w, len(known)) for w in words), np.int64, len(words))
    repeats = repeated_words(ids) if len(known) < len(words) else 0
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeats


def _limits(bands: tuple[tuple[float, float, float], ...], size: int) -> tuple[float, float]:
    return next((low, high) for most, low, high in bands if size <= most)


def judge(raw: bytes, bands: Bands, press: zstandard.ZstdCompressor) -> tuple[float | None, int, int, str | None]:
    """Ratio of the whole, chunks, chunks out of their limits, and why it is rejected (or null)."""
    if not raw:
        return None, 0, 0, None
    ratio = len(press.compress(raw)) / len(raw)
    chunks = out = 0
    for start in range(0, len(raw), bands.chunk_bytes):
        part = raw[start : start + bands.chunk_bytes]
        low, high = _limits(bands.chunk, len(part))
        chunks += 1
        if low or high < NO_LIMIT:
            out += not low <= len(press.compress(part)) / len(part) <= high
    low, high = _limits(bands.whole, len(raw))
    if ratio < low:
        return ratio, chunks, out, "repetitive"
    if ratio > high:
        return ratio, chunks, out, "incompressible"
    if out > bands.most_chunks_out * chunks:
        return ratio, chunks, out, "chunks"
    return ratio, chunks, out, None


def compression_bands(docs: DataFrame, bands: Bands = Bands(), min_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """One row per document with the base counts, the compression figures and the verdict.

    ``base_failed``: fewer than ``min_words`` words, or over ``most_repeated`` percent of them in
    repeated windows. ``kept``: the base rule held and no band is left.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=bands.level)
        for batch in common.text_slices(batches):
            out = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                raw = text.encode("utf-8", "surrogatepass")
                counts = base_counts(text, raw)
                failed = counts[0] < min_words or 100 * counts[4] > most_repeated * counts[0]
                ratio, chunks, chunks_out, reason = judge(raw, bands, press)
                out.append((key, *counts, failed, not failed and reason is None, len(raw), ratio, chunks, chunks_out, "base" if failed else reason))
            yield _batch(out)

    return common.only(docs, "doc_id", "text").mapInArrow(rows, SCHEMA)


_TYPES = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
_NAMES = re.findall(r"(\w+) (?:long|boolean|double|string)", SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)
