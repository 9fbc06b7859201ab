"""Quality and toxicity scores learned from weak labels.

Heuristic labellers vote on each document (bad, good, or nothing), and so do the annotators, for
the documents that they have seen. Expectation-maximisation estimates, for each task, how often
each labeller is right on good and on bad documents, without knowing which is which; only the
counts of vote patterns are needed, of which there are at most ``3 ** labellers``. The posterior of
each pattern then labels bounded samples (for each task ``TRAIN_DOCS`` of the documents with a vote on
it, by a hash of the id, for quality the annotated ones first) on which a linear scorer over hashed words, word beginnings and binned
figures is fitted. Every document is scored; it is kept if it is likely good and unlikely toxic.

Null and empty texts have no words: quality is theirs by the labellers' view of short texts, and
the scorer sees only the binned figures. Long texts are read whole; their words count less each, so
that they do not add up to anything. Documents that the annotators saw repeatedly count once, as bad
if any of their rows says so. Of rows that share an id the sample has the one of the least pattern of
votes, then the least text; a null id is never annotated or sampled. Repeated rows are scored each. A
score of one half is good, and toxic. With no documents at all the result is empty. Other columns are
not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common

TRAIN_DOCS = 10_000
DIMENSIONS = 1 << 18
BEGINNINGS = (4, 5, 6, 7)
CACHE_WORDS = 400_000
#: Standard errors by which a feature must tell good from bad documents to be used.
LEAST_Z = 5.0
N_BINS = 8
DOCS_AT_ONCE = 500
#: Distinct words up to which each counts in full.
PLAIN_WORDS = 150
TASKS = ("quality", "toxicity")
BAD, GOOD, NONE = 0, 1, 2
#: Common English insults that mark a toxic text.
INSULTS = frozenset("clown disgusting dumb fool idiot imbecile jerk loser moron pathetic scum stupid trash worthless".split())
_LETTERS = re.compile(r"[^\W\d_]+")
_SIGNS = np.frombuffer(b"#*$%&|<>", np.uint8)


@dataclass(frozen=True)
class Figures:
    """What the labellers look at."""

    n_words: int
    signs: float
    bars: float
    upper: float
    repeats: float
    same_lines: float
    stops: float
    word_length: float
    insults: int


def figures(text: str) -> tuple[Figures, list[str]]:
    """Figures of a text, and its distinct lower-cased runs of letters in order of first place."""
    tokens = text.split()
    n = len(tokens)
    letters = list(dict.fromkeys(_LETTERS.findall(text.lower())))
    lines = [x for x in text.split("\n") if x.strip()]
    bytes_seen = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    upper, small = int(bytes_seen[65:91].sum()), int(bytes_seen[97:123].sum())
    return Figures(
        n,
        int(bytes_seen[_SIGNS].sum()) / max(1, len(text)),
        tokens.count("|") / max(1, n),
        upper / max(1, upper + small),
        sum(map(str.__eq__, tokens, tokens[1:])) / max(1, n),
        1 - len(set(lines)) / max(1, len(lines)) if len(lines) > 2 else 0.0,
        (text.count(". ") + text.count(".\n") + text.count(", ")) / max(1, n),
        (len(text) - n) / max(1, n),
        len(INSULTS.intersection(letters)),
    ), letters


def _band(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NONE


#: The labellers of each task; the annotators' vote is added behind them.
LABELLERS: dict[str, tuple[Callable[[Figures], int], ...]] = {
    "quality": (
        lambda f: _band(f.signs > 0.03, f.signs < 0.005),
        lambda f: _band(f.bars > 0.1, False),
        lambda f: _band(f.upper > 0.5, f.upper < 0.2),
        lambda f: _band(f.repeats > 0.1, f.repeats < 0.02),
        lambda f: _band(f.same_lines > 0.4, False),
        lambda f: _band(f.n_words < 3, f.n_words >= 40),
        lambda f: _band(f.n_words >= 40 and f.stops < 0.005, 0.02 <= f.stops <= 0.4),
        lambda f: _band(f.word_length > 15, 2 <= f.word_length <= 10),
    ),
    "toxicity": (
        lambda f: _band(f.insults >= 1, False),
        lambda f: _band(f.insults >= 3, False),
        lambda f: _band(f.insults >= 2 or f.insults * 50 > f.n_words, False),
    ),
}


def bins(f: Figures) -> list[str]:
    """Names of the binned figures."""
    step = lambda x, *edges: sum(x > e for e in edges)
    return [
        f"\x00n{step(f.n_words, 2, 19, 60, 1000)}",
        f"\x00g{step(f.signs, 0.003, 0.01, 0.03, 0.08)}",
        f"\x00b{step(f.bars, 0.02, 0.1)}",
        f"\x00u{step(f.upper, 0.1, 0.2, 0.5)}",
        f"\x00r{step(f.repeats, 0.02, 0.05, 0.1, 0.3)}",
        f"\x00l{step(f.same_lines, 0.1, 0.4)}",
        f"\x00s{step(f.stops, 0.005, 0.02, 0.4)}",
        f"\x00w{step(f.word_length, 2, 10, 15)}",
    ]


def word_scale(n: int) -> float:
    """What a word counts in a text of ``n`` distinct words, so that long texts do not add up to anything."""
    return min(1.0, math.sqrt(PLAIN_WORDS / max(1, n)))


def document_features(text: str | None) -> np.ndarray:
    """The number of distinct words, the hashed features of these, then those of the ``N_BINS`` binned figures."""
    f, letters = figures(text or "")
    own = np.unique(np.array([p for w in letters for p in places(w)], np.int64))
    return np.concatenate([[len(letters)], own, [p for b in bins(f) for p in places(b)]]).astype(np.int64)


def places(word: str) -> list[int]:
    """Hashed features of a word (itself and its beginnings) or of a binned figure."""
    names = [word] if word[0] == "\x00" else [word + "\x00", *(word[:n] for n in BEGINNINGS if len(word) >= n)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % DIMENSIONS for x in names]


def _pattern(votes: list[int]) -> int:
    return sum(v * 3**i for i, v in enumerate(votes))


def votes_of(pattern: int, labellers: int) -> list[int]:
    """The votes that a pattern stands for."""
    return [pattern // 3**i % 3 for i in range(labellers)]


def voted(docs: DataFrame, annotations: DataFrame) -> DataFrame:
    """Columns doc_id, and a vote pattern for each task, the annotators' vote last."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches):
            seen = [figures(t or "")[0] for t in batch.column("text").to_pylist()]
            patterns = [pa.array([_pattern([vote(f) for vote in LABELLERS[t]]) for f in seen], pa.int32()) for t in TASKS]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *patterns], names=["doc_id", *TASKS])

    own = common.only(docs, "doc_id", "text").mapInArrow(rows, "doc_id long, quality int, toxicity int")
    seen = annotations.groupBy("doc_id").agg(F.min("quality").alias("annotated_quality"), (1 - F.max("toxic")).alias("annotated_toxicity"))
    joined = own.join(seen, "doc_id", "left")
    return joined.select("doc_id", *[(F.col(t) + F.coalesce(f"annotated_{t}", F.lit(NONE)).cast("int") * 3 ** len(LABELLERS[t])).alias(t) for t in TASKS])


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents, and how often each labeller votes bad or good [class, labeller, vote].

    A vote is weighed by how often the labeller casts it on good and on bad documents, silence is
    not: a list of English insults is silent on most toxic texts of other languages, and annotators
    have seen documents without regard to what they are. So an entry for no vote is 1.
    """

    good: float
    says: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability that documents with these votes [patterns, labellers] are good."""
        k = votes.shape[1]
        fit = [np.log(self.says[c, np.arange(k), votes]).sum(1) for c in (BAD, GOOD)]
        return 1 / (1 + np.exp(np.clip(fit[BAD] + math.log(1 - self.good) - fit[GOOD] - math.log(self.good), -50, 50)))


#: Votes (bad, good; 1 for none) as supposed at first, on bad and on good documents: a heuristic sees one
#: fault of many, the annotators nearly all.
HEURISTIC = ((0.30, 0.35, 1.0), (0.02, 0.49, 1.0))
ANNOTATOR = ((0.98, 0.02, 1.0), (0.01, 0.99, 1.0))
#: Weight of that supposition: so many documents, and for the annotators this share of their votes.
PRIOR_DOCS, PRIOR_SHARE = 10, 0.2


def fit_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> VoteModel:
    """EM from the patterns [patterns, labellers] and how many documents have each; the last labeller is the annotators."""
    k = votes.shape[1]
    supposed = np.array([HEURISTIC] * (k - 1) + [ANNOTATOR]).transpose(1, 0, 2)
    model = VoteModel(0.8, supposed)
    cast = np.stack([(votes == v) * counts[:, None] for v in (BAD, GOOD, NONE)], 2)
    for _ in range(rounds):
        good = model.posterior(votes)
        said = np.stack([np.tensordot(w, cast, (0, 0)) for w in (1 - good, good)])
        says = np.ones_like(said)
        says[:, :-1, :NONE] = (said[:, :-1, :NONE] + supposed[:, :-1, :NONE] * PRIOR_DOCS) / (said[:, :-1].sum(2, keepdims=True) + PRIOR_DOCS)
        seen = said[:, -1, :NONE]
        pull = PRIOR_DOCS + PRIOR_SHARE * seen.sum()
        says[:, -1, :NONE] = (seen + supposed[:, -1, :NONE] * pull) / (seen.sum(1, keepdims=True) + pull)
        share = float(np.clip((good * counts).sum() / max(1, counts.sum()), 0.02, 0.98))
        model = VoteModel(share, np.clip(says, 1e-4, 1.0))
    return model


@dataclass(frozen=True)
class Scorer:
    """Weights by hashed feature and task (of good against bad), and their biases."""

    weights: np.ndarray
    bias: np.ndarray


def telling(features: list[np.ndarray], good: np.ndarray, weight: np.ndarray, least: float = LEAST_Z) -> np.ndarray:
    """Mask of the features whose share among good documents and among bad ones differ by ``least`` standard errors."""
    sizes = np.array([((1 - good) * weight).sum(), (good * weight).sum()])
    counts = np.zeros((2, DIMENSIONS))
    for at in range(0, len(features), DOCS_AT_ONCE):
        some = features[at : at + DOCS_AT_ONCE]
        flat, doc = np.concatenate([f[1:] for f in some]), np.repeat(np.arange(at, at + len(some)), [len(f) - 1 for f in some])
        for row, share in zip(counts, (1 - good, good), strict=True):
            row += np.bincount(flat, weights=(share * weight)[doc], minlength=DIMENSIONS)
    shares = counts / np.maximum(sizes, 1)[:, None]
    pooled = counts.sum(0) / max(1.0, sizes.sum())
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / np.maximum(sizes, 1)).sum())
    return np.abs(shares[0] - shares[1]) > least * error


def fit_scorer(features: list[np.ndarray], targets: np.ndarray, known: np.ndarray, rounds: int = 300, ridge: float = 3e-4) -> Scorer:
    """Logistic regression, over the telling features, on soft targets [documents, tasks] where ``known``.

    ``features``: arrays of ``document_features``. They are gone through in portions, so that the
    driver needs little more than the arrays themselves.
    """
    tasks = targets.shape[1]
    weights, bias = np.zeros((DIMENSIONS, tasks), np.float32), np.zeros(tasks)
    for t in range(tasks if features else 0):
        good, weight = targets[:, t], known[:, t].astype(float)
        chosen = telling(features, good, weight)
        used, number = np.flatnonzero(chosen), np.cumsum(chosen) - 1
        kept, docs, values = [], [], []
        for i, f in enumerate(features):
            live = chosen[f[1:]]
            value = np.append(np.full(len(f) - 1 - N_BINS, word_scale(int(f[0]))), np.ones(N_BINS))
            kept.append(number[f[1:][live]])
            docs.append(np.full(len(kept[-1]), i))
            values.append(value[live])
        flat, doc, own = np.concatenate(kept), np.concatenate(docs), np.concatenate(values)
        weight /= max(1.0, weight.sum())
        w, b = np.zeros(len(used)), 0.0
        first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
        for step in range(1, rounds + 1):
            scores = np.bincount(doc, weights=w[flat] * own, minlength=len(features)) + b
            error = (1 / (1 + np.exp(-np.clip(scores, -50, 50))) - good) * weight
            slope = np.append(np.bincount(flat, weights=error[doc] * own, minlength=len(used)) + ridge * w, error.sum())
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
            w, b = w - move[:-1], b - move[-1]
        weights[used, t], bias[t] = w, b
    return Scorer(weights, bias)


def _sampled(docs: DataFrame, labelled: DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Features, soft labels and whether there is a vote, for the sampled documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches):
            found = []
            for text in batch.column("text").to_pylist():
                found.append(document_features(text).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *(batch.column(c) for c in ("q", "t", "q_known", "t_known"))], names=["features", "q", "t", "q_known", "t_known"])

    # The sample is bounded, twice ``TRAIN_DOCS`` rows of numbers; of rows that share an id the least text stands for all.
    drawn = common.only(docs, "doc_id", "text").join(F.broadcast(labelled), "doc_id")
    drawn = drawn.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.first(c).alias(c) for c in ("q", "t", "q_known", "t_known")]).drop("doc_id")
    table = drawn.mapInArrow(rows, "features binary, q double, t double, q_known boolean, t_known boolean").collect()
    return (
        [np.frombuffer(r["features"], np.uint32) for r in table],
        np.array([[r["q"], r["t"]] for r in table]).reshape(-1, 2),
        np.array([[r["q_known"], r["t_known"]] for r in table], bool).reshape(-1, 2),
    )


def train(docs: DataFrame, annotations: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[dict[str, VoteModel], Scorer]:
    """The vote models of both tasks, and the scorer fitted to their posteriors."""
    table = common.written(voted(docs, annotations), "votes")
    models, posteriors, known = {}, {}, {}
    for task in TASKS:
        counted = table.groupBy(task).count().collect()
        votes = np.array([votes_of(r[task], len(LABELLERS[task]) + 1) for r in counted], np.int64).reshape(-1, len(LABELLERS[task]) + 1)
        models[task] = fit_votes(votes, np.array([r["count"] for r in counted], float))
        for r, p, v in zip(counted, models[task].posterior(votes), votes, strict=True):
            posteriors[task, r[task]], known[task, r[task]] = float(p), bool((v != NONE).any())
    spark = docs.sparkSession
    frame = table
    for task, short in zip(TASKS, "qt", strict=True):
        lookup = [(k, p, known[task, k]) for (t, k), p in posteriors.items() if t == task]
        frame = frame.join(F.broadcast(spark.createDataFrame(lookup, f"{task} int, {short} double, {short}_known boolean")), task)
    # For quality nearly every document has some vote: those that annotators saw come first, others fill up.
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20))
    seen = F.floor(F.col("quality") / 3 ** len(LABELLERS["quality"])) != NONE
    tiers = {"q": F.col("q_known") & seen, "q_rest": F.col("q_known") & ~seen, "t": F.col("t_known")}
    sizes = frame.agg(*[F.count_if(c).alias(n) for n, c in tiers.items()]).first()
    wanted = {"q": train_docs, "q_rest": max(0, train_docs - sizes["q"]), "t": train_docs}
    chosen = {n: c & (draw < min(1.0, wanted[n] / max(1, sizes[n])) * (1 << 20)) for n, c in tiers.items()}
    frame = frame.withColumns({"q_known": chosen["q"] | chosen["q_rest"], "t_known": chosen["t"]})
    drawn = frame.where("(q_known OR t_known) AND doc_id IS NOT NULL")
    sample = drawn.groupBy("doc_id").agg(F.min(F.struct(*TASKS, "q", "t", "q_known", "t_known")).alias("s"))
    return models, fit_scorer(*_sampled(docs, sample.select("doc_id", "s.q", "s.t", "s.q_known", "s.t_known")))


class WordPlaces:
    """The used features of words, each distinct one hashed once while it is remembered."""

    def __init__(self, used: np.ndarray):
        self.rows = {int(p): i for i, p in enumerate(used)}
        self.forget()

    def forget(self) -> None:
        """Empties the memory of words."""
        self.known, self.found, self.ends = common.Numbers(), array("q"), array("q", [0])

    def of(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(text, row) of every used feature of the texts' words, each once a text."""
        if len(self.known) > CACHE_WORDS or len(self.found) > CACHE_WORDS:
            self.forget()
        sizes = np.array([len(x) for x in texts], np.int64)
        number = self.known.of(chain.from_iterable(texts), int(sizes.sum()))
        row_of = self.rows.get
        for word in self.known.fresh:
            self.found.extend(r for p in places(word) if (r := row_of(p)) is not None)
            self.ends.append(len(self.found))
        self.known.fresh = []
        found, ends = np.array(self.found, np.int64), np.array(self.ends, np.int64)
        counts = ends[number + 1] - ends[number]
        live = np.flatnonzero(counts)
        counts, number = counts[live], number[live]
        text = np.repeat(np.arange(len(texts)), sizes)[live]
        at = np.repeat(ends[number], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        pairs = np.unique(np.repeat(text, counts) * max(1, len(self.rows)) + found[at])
        return pairs // max(1, len(self.rows)), pairs % max(1, len(self.rows))


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """One row per document: doc_id, quality (probability of good), toxicity (probability of toxic), kept."""
    used = np.flatnonzero(scorer.weights.any(1))
    handed = docs.sparkSession.sparkContext.broadcast((used, scorer.weights[used].astype(float), scorer.bias))  # used features: 10 bytes a dimension at most

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, weights, bias = handed.value
        words, own_bins = WordPlaces(used), WordPlaces(used)
        for batch in common.text_slices(batches):
            seen = [figures(t or "") for t in batch.column("text").to_pylist()]
            scale = np.array([word_scale(len(letters)) for _, letters in seen])
            total = np.tile(bias, (len(seen), 1)).astype(float)
            for (text, row), part in ((words.of([letters for _, letters in seen]), scale), (own_bins.of([bins(f) for f, _ in seen]), np.ones(len(seen)))):
                for task in range(len(TASKS)):
                    total[:, task] += np.bincount(text, weights=weights[row, task], minlength=len(seen)) * part
            good = 1 / (1 + np.exp(-np.clip(total, -50, 50)))
            quality, toxicity = good[:, 0], 1 - good[:, 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(quality), pa.array(toxicity), pa.array((quality >= 0.5) & (toxicity < 0.5))],
                names=["doc_id", "quality", "toxicity", "kept"],
            )

    return common.only(docs, "doc_id", "text").mapInArrow(rows, "doc_id long, quality double, toxicity double, kept boolean")
