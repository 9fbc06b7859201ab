"""Language identification by mixture inference.

Every language has a model of byte trigrams over lower-cased letters. A document is cut into runs
of trigrams; expectation-maximisation finds the proportions in which the languages mix to make its
runs likely, and languages are taken out, weakest first, as long as the penalised likelihood does
not fall. What is left is the document's language set; its largest share is the prediction.

The models are counted on a bounded sample: at most ``TRAIN_DOCS`` labelled documents of each
language, chosen by a hash of the id. Prediction reads nothing but the text.

Null text, or text without a letter: ``und`` with score 0. Exact ties go to the language that comes
first by name. Long texts are judged whole. A null doc_id is passed on and never held out; repeated
rows are judged alike, each by itself; an empty table gives an empty one. With no labelled document
at all, every row is ``und``. Other columns are not looked at, whatever their names. More than
``MOST_LANGUAGES`` labels are refused: that is no column of languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common

BUCKETS = 1 << 16
RUN = 64
#: Documents of each language that the models are counted on, at most.
TRAIN_DOCS = 20_000
#: Labels told apart at most; each costs every executor 256 KB.
MOST_LANGUAGES = 1_000
BLOCK = 4_096
#: Share of a text that its main language has at least, where documents are rejected.
LEAST_SCORE = 0.3
#: Mean log-likelihood of a trigram, over that of chance, of a text that is in any of the languages; asked of texts of so many trigrams.
LEAST_GAIN, LEAST_TRIGRAMS = -0.5, 48
_SPACE = 32
_FOLD = np.full(256, _SPACE, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class LanguageModel:
    """Languages by name, and the log-probability of each trigram bucket in each; the last bucket is void."""

    names: tuple[str, ...]
    log_p: np.ndarray


@dataclass(frozen=True)
class Mixing:
    """How proportions are found: rounds of EM, the price of a language, the weight of a trigram.

    A letter lies in three trigrams, hence the weight of a third.
    """

    rounds: int = 10
    price: float = 2.0
    weight: float = 1 / 3


def is_held_out(doc_id: Column) -> Column:
    """Whether the id's checksum leaves the document out of training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: str | None) -> bool:
    """Whether there is any Unicode letter."""
    return any(any(c.isalpha() for c in m.group()) for m in _LETTER.finditer(text or ""))


def trigrams(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each trigram of the joined texts, and each text's first and number of trigrams.

    Where two texts meet, the trigram that spans both is put into the void bucket.
    """
    joined = np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)
    folded = _FOLD[joined]
    space = folded == _SPACE
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    place = np.cumsum(keep) - 1
    ends = np.cumsum([0, *(len(r) + 1 for r in raws)])
    edges = place[ends]
    own = np.append(folded[keep].astype(np.uint32), np.full(2, _SPACE, np.uint32))
    packed = own[:-2] | own[1:-1] << np.uint32(8) | own[2:] << np.uint32(16)
    buckets = ((packed * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32)
    firsts, counts = edges[:-1], np.maximum(np.diff(edges) - 1, 0)
    void = edges[1:] - 1
    buckets[void[void >= 0]] = BUCKETS
    buckets[edges[-1] :] = BUCKETS
    return buckets, firsts, counts


def train(docs: DataFrame, most_docs: int = TRAIN_DOCS) -> LanguageModel:
    """Counts the trigrams of labelled documents (columns doc_id, text, lang)."""
    labelled = common.only(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} different labels")
    names = tuple(sorted(sizes))
    if not names:
        return LanguageModel((), np.zeros((0, BUCKETS + 1), np.float32))
    share = F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, most_docs / sizes[n]))]), F.col("lang"))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {n: np.zeros(BUCKETS + 1, np.int64) for n in names}
        for batch in common.text_slices(batches):
            raws, langs = common.utf8(batch.column("text")), batch.column("lang").to_pylist()
            for name in set(langs):
                buckets, _, _ = trigrams([r for r, x in zip(raws, langs, strict=True) if x == name])
                sums[name] += np.bincount(buckets, minlength=BUCKETS + 1)
        yield _blocks([(n, b, s[b * BLOCK : (b + 1) * BLOCK]) for n, s in sums.items() if s.any() for b in range(BUCKETS // BLOCK)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, block, raw in zip(*(batch.column(c).to_pylist() for c in ("lang", "block", "counts")), strict=True):
                sums[name, block] = sums.get((name, block), 0) + np.frombuffer(raw, np.int64)
        yield _blocks([(n, b, s) for (n, b), s in sums.items()])

    schema = "lang string, block int, counts binary"
    counted = labelled.where(drawn).select("text", "lang").mapInArrow(count, schema).repartition("lang", "block").mapInArrow(add, schema)
    totals = np.zeros((len(names), BUCKETS), np.int64)
    for row in counted.collect():
        totals[names.index(row["lang"]), row["block"] * BLOCK : (row["block"] + 1) * BLOCK] += np.frombuffer(row["counts"], np.int64)
    smooth = totals + 0.5
    log_p = np.zeros((len(names), BUCKETS + 1), np.float32)
    log_p[:, :BUCKETS] = np.log(smooth / smooth.sum(1, keepdims=True))
    return LanguageModel(names, log_p)


def _blocks(rows: list[tuple[str, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].tobytes() for r in rows], pa.binary())],
        names=["lang", "block", "counts"],
    )


def _mix(fit: np.ndarray, doc: np.ndarray, first: np.ndarray, size: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for all documents at once: proportions [documents, languages] and log-likelihood.

    ``fit``: likelihood of each run in each language, scaled to a greatest of 1; only languages
    that are ``allowed`` take part.
    """
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds):
        joint = share[doc] * fit
        joint /= np.maximum(joint.sum(1, keepdims=True), 1e-300)
        share = np.add.reduceat(joint, first, axis=0) / size[:, None]
    total = np.log(np.maximum((share[doc] * fit).sum(1), 1e-300))
    return share, np.add.reduceat(total, first)


def gains(model: LanguageModel, raws: list[bytes]) -> np.ndarray:
    """Mean log-likelihood of each text's trigrams, each run in its best language, over that of chance; 0 for few trigrams."""
    out = np.zeros(len(raws))
    buckets, firsts, counts = trigrams(raws)
    live = np.flatnonzero(counts >= LEAST_TRIGRAMS)
    if len(live) and model.names:
        size = -(-counts[live] // RUN)
        first = np.cumsum(size) - size
        doc = np.repeat(np.arange(len(live)), size)
        starts = firsts[live][doc] + (np.arange(size.sum()) - first[doc]) * RUN
        ends = np.minimum(starts + RUN, (firsts + counts)[live][doc])
        best = np.max([np.add.reduceat(np.append(p[buckets], np.float32(0)), np.stack([starts, ends], 1).ravel())[::2] for p in model.log_p], 0)
        out[live] = np.add.reduceat(best, first) / counts[live] + np.log(BUCKETS)
    return out


def mixtures(model: LanguageModel, raws: list[bytes], mixing: Mixing = Mixing()) -> np.ndarray:
    """Proportions of the languages in each text [texts, languages]; all zero where there is no trigram."""
    out = np.zeros((len(raws), len(model.names)))
    buckets, firsts, counts = trigrams(raws)
    live = np.flatnonzero(counts > 0)
    if not len(live) or not model.names:
        return out
    size = -(-counts[live] // RUN)
    first = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(live)), size)
    starts = firsts[live][doc] + (np.arange(size.sum()) - first[doc]) * RUN
    ends = np.append(starts[1:], len(buckets))
    scores = np.stack([np.add.reduceat(p[buckets], starts) for p in model.log_p], 1).astype(np.float64)
    assert (ends >= starts).all()
    scores *= mixing.weight
    fit = np.exp(np.maximum(scores - scores.max(1, keepdims=True), -300))
    allowed = np.ones((len(live), len(model.names)), bool)
    share, likelihood = _mix(fit, doc, first, size, allowed, mixing.rounds)
    price = mixing.price * np.log1p(size)
    open_docs = allowed.sum(1) > 1
    while open_docs.any():
        at = np.flatnonzero(open_docs)
        weakest = np.where(allowed[at], share[at], 2.0)
        fewer = allowed[at].copy()
        fewer[np.arange(len(at)), fewer.shape[1] - 1 - np.argmin(weakest[:, ::-1], 1)] = False
        rows = np.isin(doc, at)
        own_size = size[at]
        own_first = np.cumsum(own_size) - own_size
        tried, tried_likelihood = _mix(fit[rows], np.repeat(np.arange(len(at)), own_size), own_first, own_size, fewer, mixing.rounds)
        better = tried_likelihood + price[at] >= likelihood[at]
        taken = at[better]
        allowed[taken], share[taken], likelihood[taken] = fewer[better], tried[better], tried_likelihood[better]
        open_docs[at[~better]] = False
        open_docs &= allowed.sum(1) > 1
    out[live] = share
    return out


def identify(docs: DataFrame, model: LanguageModel, mixing: Mixing = Mixing()) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (its share of the text) and the shares of the set found."""
    handed = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = handed.value
        for batch in common.text_slices(batches):
            texts = batch.column("text").to_pylist()
            shares = mixtures(model, common.utf8(batch.column("text")), mixing)
            named, scores, sets = [], [], []
            for text, share in zip(texts, shares, strict=True):
                known = bool(share.any()) and has_letter(text)
                best = int(np.argmax(share)) if known else -1
                named.append(model.names[best] if known else "und")
                scores.append(float(min(1.0, share[best])) if known else 0.0)
                sets.append([(model.names[i], float(share[i])) for i in np.argsort(-share, kind="stable") if share[i] > 0] if known else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(named, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))],
                names=["doc_id", "lang_pred", "score", "shares"],
            )

    return common.only(docs, "doc_id", "text").mapInArrow(rows, "doc_id long, lang_pred string, score double, shares map<string,double>")


def keep_identified(docs: DataFrame, model: LanguageModel, least_score: float = LEAST_SCORE, mixing: Mixing = Mixing()) -> DataFrame:
    """The same rows and columns without documents in none of the languages.

    Those are documents that have no letter, or no language with ``least_score`` of the text, or that
    every language makes less likely than chance does, by ``LEAST_GAIN`` a trigram.
    """
    handed = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = handed.value
        for batch in common.text_slices(batches):
            raws = common.utf8(batch.column("text"))
            shares, likely = mixtures(model, raws, mixing), gains(model, raws) >= LEAST_GAIN
            kept = [bool(s.any()) and s.max() >= least_score and bool(fits) and has_letter(t) for t, s, fits in zip(batch.column("text").to_pylist(), shares, likely, strict=True)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)
