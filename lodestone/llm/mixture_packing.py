"""Packing with a controlled mixture, by deficit round-robin over source queues.

Every source is a queue of tokens. A round gives each queue the tokens that its target share of a
window is worth; what a queue may not send because it is less than a token stays in its deficit and
counts in the next round. As documents may be cut, a queue sends exactly its whole credit, so the
tokens that queue ``s`` has sent before round ``r`` are a plain product, floor((r - r0) * q + base).
A queue that runs dry leaves; the others share its part from that round on, which starts a new
phase. The stream of all rounds is cut into windows. Window and round drift apart by less than one
token for each source, so every window holds the target mixture to within that.

Since the place of any token follows from its place in its queue, partitions pack alone: they need
the phases (one row for each source at most) and where in its queue each slot of documents starts.

Queue order: slots by hash of the id, then doc_id, number of tokens and hash of the ids; rows alike in
all of these are the same to any order. Null sources form one queue with the empty name. Where there
are more than ``MOST_QUEUES`` sources, the smaller ones share a last queue, in which their documents
come in that order. Null texts are empty; every document, the empty one too, ends in the end id. Long
texts are tokenised whole. A null doc_id is passed on. Only the last sequence may be short. Repeated
rows are packed each. An empty table gives no piece. Other columns are not looked at.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from array import array
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import common

WINDOW_TOKENS = 4096
END_ID = 2
#: Shares are kept in parts of a token; 2**38 rounds of a whole window still fit a long.
PARTS = 4096
#: Queues at most; phases are no more, and each queue's turn is still some tokens long.
MOST_QUEUES = 256
SLOT_DOCS = 4_000
#: Bytes of ids that one task places.
TASK_BYTES = 32 << 20
#: Distinct runs of letters or signs that a worker remembers from task to task, and their characters.
CACHE_WORDS, CACHE_CHARACTERS = 300_000, 16 << 20
EXPAND_AT_ONCE = 1 << 20
#: Weights that are all the same, and the name of the queue of the smaller sources.
EVEN, OTHERS = "even", "\x00others"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def default_tokenizer() -> str:
    """Path of the public tokenizer that the packing query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids of texts, each distinct run of letters or signs encoded once.

    The tokenizer drops white space, lower-cases, and parts letters, digits and signs before it
    merges anything. For texts of ASCII and Latin letters the same parts are found here, and only
    parts that are not yet known go to the tokenizer, many in one call: every part ends in a token
    that closes a word, which tells them apart. Any other text is encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(str(path))
        names = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(names.values()) + 1, bool)
        self.closes[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Empties the memory of parts."""
        self.known, self.held = common.Numbers(), 0
        self.ids, self.ends = array("I"), array("q", [0])

    def _learn(self, parts: list[str]) -> None:
        """Puts the ids of newly numbered parts behind those that are known."""
        for at in range(0, len(parts), 2_000):
            some = parts[at : at + 2_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(some) or (len(ids) and ends[-1] != len(ids)):
                each = [x.ids for x in self.tokenizer.encode_batch(some, add_special_tokens=False)]
                ids, ends = np.array([i for x in each for i in x], np.uint32), np.cumsum([len(x) for x in each])
            used = len(self.ids)
            self.ids.frombytes(ids.tobytes())
            self.ends.frombytes((used + ends).astype(np.int64).tobytes())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without end ids."""
        if len(self.known) > CACHE_WORDS or self.held > CACHE_CHARACTERS:
            self.forget()
        whole = {i for i, t in enumerate(texts) if _UNUSUAL.search(t) or "<|" in t}
        split = [[] if i in whole else _PARTS.findall(t.lower()) for i, t in enumerate(texts)]
        number = self.known.of(chain.from_iterable(split), sum(map(len, split)))
        self._learn(self.known.fresh)
        self.held += sum(map(len, self.known.fresh))
        self.known.fresh = []
        ids, ends = np.frombuffer(self.ids, np.uint32) if self.ids else np.zeros(0, np.uint32), np.frombuffer(self.ends, np.int64)
        starts, sizes = ends[number], ends[number + 1] - ends[number]
        reached = np.cumsum(sizes)
        flat = ids[np.repeat(starts - reached + sizes, sizes) + np.arange(reached[-1] if len(number) else 0)]
        del ids, ends
        cuts = np.append(0, reached)[np.cumsum([len(x) for x in split], dtype=np.int64)]
        out = np.split(flat, cuts[:-1]) if texts else []
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out


#: Texts with any of these are encoded whole: all but white space, ASCII signs and Latin letters with a lower case of one letter.
_UNUSUAL = re.compile(r"[^\t-\r\x20-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]")
#: Fixed value: the tokenizer's own parts, for such texts.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u024f]+|[0-9]|[!-/:-@\[-`{-~]+")


@lru_cache(maxsize=1)
def encoder_at(path: str) -> WordEncoder:
    """The encoder of this file, kept from task to task of a worker."""
    return WordEncoder(path)


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Columns doc_id, source, n_tokens, ids (little-endian unsigned 16-bit, or 32-bit if the vocabulary needs it)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_at(tokenizer_path)
        small = encoder.tokenizer.get_vocab_size() <= 1 << 16
        end = np.array([end_id], np.uint32)
        for batch in common.text_slices(batches):
            ids = [np.append(x, end) for x in encoder.encode([t or "" for t in batch.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("source").cast(pa.string()).fill_null(""),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([2 if small else 4] * len(ids), pa.int32()),
                    pa.array([x.astype("<u2" if small else "<u4").tobytes() for x in ids], pa.binary()),
                ],
                names=["doc_id", "source", "n_tokens", "width", "ids"],
            )

    return common.only(docs, "doc_id", "source", "text").mapInArrow(rows, "doc_id long, source string, n_tokens long, width int, ids binary")


@dataclass(frozen=True)
class Phase:
    """From round ``first``: tokens sent so far and parts of a token gained each round, by source."""

    first: int
    base: tuple[int, ...]
    gain: tuple[int, ...]


@dataclass(frozen=True)
class Schedule:
    """All phases of the round-robin over sources in order of name."""

    names: tuple[str, ...]
    totals: tuple[int, ...]
    phases: tuple[Phase, ...]

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens each source has sent before each round [rounds, sources]."""
        firsts = np.array([p.first for p in self.phases])
        phase = np.searchsorted(firsts, rounds, "right") - 1
        base, gain = np.array([p.base for p in self.phases]), np.array([p.gain for p in self.phases])
        return np.minimum(base[phase] + (rounds - firsts[phase])[:, None] * gain[phase] // PARTS, self.totals)

    def round_of(self, source: int, places: np.ndarray) -> np.ndarray:
        """The round in which the token at each place of a queue is sent."""
        base, gain = (np.array([getattr(p, n)[source] for p in self.phases]) for n in ("base", "gain"))
        phase = np.searchsorted(base, places, "right") - 1
        while (idle := gain[phase] == 0).any():
            phase = phase - idle
        return np.array([p.first for p in self.phases])[phase] + ((places - base[phase] + 1) * PARTS + gain[phase] - 1) // gain[phase] - 1


def schedule(totals: Mapping[str, int], weights: Mapping[str, float] | None = None, window: int = WINDOW_TOKENS) -> Schedule:
    """Phases for queues of these lengths; without weights each source has its own share of all tokens.

    A source without a weight, or with one of zero, is sent once all the others are empty.
    """
    names = tuple(sorted(n for n, total in totals.items() if total > 0))
    left = [totals[n] for n in names]
    base = [0] * len(names)
    target = [float(weights.get(n, 0.0)) if weights else float(totals[n]) for n in names]
    if any(not math.isfinite(t) or t < 0 for t in target):
        raise ValueError("weights must be finite and not negative")
    phases, first = [], 0
    while any(left):
        alive = [i for i, n in enumerate(left) if n]
        share = {i: target[i] for i in alive}
        if not sum(share.values()):
            share = {i: float(totals[names[i]]) for i in alive}
        gain = [0] * len(names)
        credit = window * PARTS
        for i in alive:
            gain[i] = int(credit * (share[i] / sum(share.values())))
        if spare := credit - sum(gain):
            gain[max(alive, key=lambda i: (share[i], -i))] += spare
        phases.append(Phase(first, tuple(base), tuple(gain)))
        span = min(-(-left[i] * PARTS // gain[i]) for i in alive if gain[i])
        for i in alive:
            out = min(left[i], span * gain[i] // PARTS)
            base[i] += out
            left[i] -= out
        first += span
    return Schedule(names, tuple(totals[n] for n in names), tuple(phases))


def pieces(plan: Schedule, source: int, begins: np.ndarray, sizes: np.ndarray, window: int = WINDOW_TOKENS) -> tuple[np.ndarray, ...]:
    """Where documents of one queue go: arrays (document, start, length, sequence, offset), in order."""
    first, last = plan.round_of(source, begins), plan.round_of(source, begins + sizes - 1)
    spans = last - first + 1
    doc = np.repeat(np.arange(len(begins)), spans)
    rounds = np.repeat(first, spans) + np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
    distinct, inverse = np.unique(rounds, return_inverse=True)
    low, high, place = (np.empty(len(distinct), np.int64) for _ in range(3))
    step = max(1, EXPAND_AT_ONCE // len(plan.names))
    for at in range(0, len(distinct), step):
        before, after = plan.sent(distinct[at : at + step]), plan.sent(distinct[at : at + step] + 1)
        low[at : at + step], high[at : at + step] = before[:, source], after[:, source]
        place[at : at + step] = before.sum(1) + (after - before)[:, :source].sum(1)
    start, end = np.maximum(begins[doc], low[inverse]), np.minimum((begins + sizes)[doc], high[inverse])
    live = end > start
    doc, start, end = doc[live], start[live], end[live]
    at = place[inverse][live] + start - low[inverse][live]
    cuts = (at + end - start - 1) // window - at // window + 1
    doc, start, end, at = (np.repeat(x, cuts) for x in (doc, start, end, at))
    nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    sequence = at // window + nth
    left = np.maximum(at, sequence * window)
    right = np.minimum(at + end - start, (sequence + 1) * window)
    return doc, start + (left - at) - begins[doc], right - left, sequence, left - sequence * window


def queues(table: DataFrame, most: int = MOST_QUEUES) -> DataFrame:
    """The documents with the queue that each is in: its source, or ``OTHERS`` beyond the ``most - 1`` longest."""
    lengths = table.groupBy("source").agg(F.sum("n_tokens").alias("total"))
    if lengths.limit(most + 1).count() <= most:
        return table.withColumn("queue", F.col("source"))
    longest = lengths.orderBy(F.col("total").desc(), "source").limit(most - 1).select("source", F.col("source").alias("queue"))
    return table.join(F.broadcast(longest), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(OTHERS)))  # most - 1 rows


def queue_weights(table: DataFrame, weights: Mapping[str, float] | str | None) -> Mapping[str, float] | None:
    """The weight of each queue: that of its source, or of all the sources that ``OTHERS`` holds together."""
    if weights is None:
        return None
    own = table.select("queue", "source").distinct()
    if weights != EVEN:
        if any(not math.isfinite(w) or w < 0 for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        given = table.sparkSession.createDataFrame([(n, float(w)) for n, w in weights.items()], "source string, weight double")
        own = own.join(given, "source", "left")
    found = own.groupBy("queue").agg(F.count("*").alias("n") if weights == EVEN else F.coalesce(F.sum("weight"), F.lit(0.0)).alias("n"))
    return {r["queue"]: float(r["n"]) for r in found.collect()}  # a row a queue


def pack(docs: DataFrame, tokenizer_path: str | None = None, weights: Mapping[str, float] | str | None = None, window: int = WINDOW_TOKENS, end_id: int = END_ID, most_queues: int = MOST_QUEUES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    Without weights every window has each source's own share of all tokens; with ``EVEN`` each source
    has the same share as long as it lasts.
    """
    table = queues(common.written(tokenised(docs, tokenizer_path or default_tokenizer(), end_id), "tokens"), most_queues)
    size = table.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    slots = max(64, math.ceil(size["n"] / SLOT_DOCS))
    queued = table.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(slots)))
    sums = common.written(queued.groupBy("queue", "slot").agg(F.sum("n_tokens").alias("slot_tokens")), "slots")
    totals = {r["queue"]: r["total"] for r in sums.groupBy("queue").agg(F.sum("slot_tokens").alias("total")).collect()}  # most_queues rows
    if OTHERS in totals:
        weights = queue_weights(table, weights)
    plan = schedule(totals, dict.fromkeys(totals, 1.0) if weights == EVEN else weights, window)
    earlier = Window.partitionBy("queue").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("queue", "slot", F.coalesce(F.sum("slot_tokens").over(earlier), F.lit(0)).alias("slot_begin"))
    order = ("doc_id", "n_tokens", F.xxhash64("ids"))
    so_far = F.sum("n_tokens").over(Window.partitionBy("queue", "slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(4 * size["tokens"] / TASK_BYTES))
    placed = queued.repartition(tasks, "queue", "slot").withColumn("so_far", so_far).join(starts, ["queue", "slot"])
    placed = placed.select("doc_id", "source", "queue", "n_tokens", "width", "ids", (F.col("slot_begin") + F.col("so_far") - F.col("n_tokens")).alias("begin"))
    numbers = {n: i for i, n in enumerate(plan.names)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("queue").to_pylist()
            begins, sizes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("begin", "n_tokens"))
            keys, sources, raw, width = batch.column("doc_id"), batch.column("source"), batch.column("ids").to_pylist(), batch.column("width").to_pylist()
            by_queue: dict[str, list[int]] = {}
            for row, name in enumerate(names):
                by_queue.setdefault(name, []).append(row)
            for name, own in by_queue.items():
                at = np.array(own)
                doc, start, length, sequence, offset = pieces(plan, numbers[name], begins[at], sizes[at], window)
                crc, held, ids = [], -1, None
                for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True):
                    if d != held:
                        held, ids = d, np.frombuffer(raw[own[d]], "<u2" if width[own[d]] == 2 else "<u4").astype("<u4")
                    crc.append(zlib.crc32(ids[s : s + n]))
                whole = pa.array(at[doc])
                columns = [keys.take(whole), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[at[doc]]), pa.array(sequence), pa.array(offset), sources.take(whole)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    return placed.mapInArrow(rows, SCHEMA)
