"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token (a word with the mark of its white space) is cut into the pieces whose unigram
log-probabilities add up to most; of equal sums the one with fewer pieces counts. The best sum for
a beginning of a word does not depend on what follows, so the distinct pre-tokens of a batch go
into a trie and every node, that is every shared beginning, is scored once: its score is the best
over the pieces that end there. The count stored at a word's last node is its number of tokens, and
a document's is the sum over its words.

The pieces are those of a public vocabulary. It holds merge ranks, not probabilities; they are
given by the rule ``p ~ 1 / (rank + SHIFT)`` (Zipf and Mandelbrot), since no tokenizer is trained
here. A character without a piece is spelt in its UTF-8 bytes, at ``BYTE_COST`` each.

Null and empty texts have no tokens. Repeated rows are counted each; other columns are not looked at.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm import common

MARK = "▁"
SHIFT = 2.7
BYTE_COST = -14.0
#: Scores below this mark pieces that the vocabulary keeps for runs of white space.
UNUSED_SCORE = -1e8
CACHE_WORDS = 400_000
#: Characters of distinct new words that are put into one trie.
TRIE_CHARACTERS = 400_000


def default_vocabulary() -> str:
    """Path of the public vocabulary that the counting query uses."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def piece_scores(path: str) -> dict[str, float]:
    """Unigram log-probability of each piece of a vocabulary file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=str(path))
    ranks = {}
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and model.get_score(i) > UNUSED_SCORE:
            ranks[model.id_to_piece(i)] = -model.get_score(i)
    total = math.log(sum(1 / (r + SHIFT) for r in ranks.values()))
    return {piece: -math.log(r + SHIFT) - total for piece, r in ranks.items()}


@dataclass
class Trie:
    """Nodes with the best score and its number of pieces for the beginning they stand for."""

    scores: dict[str, float]
    longest: int

    def __post_init__(self) -> None:
        self.next: dict[int, int] = {}
        self.best: list[float] = [0.0]
        self.count: list[int] = [0]

    def insert(self, word: str) -> int:
        """Tokens of the word; nodes that other words have made are not scored again."""
        path, node = [0], 0
        scores, best, count, links = self.scores, self.best, self.count, self.next
        for end, c in enumerate(word, 1):
            key = node << 21 | ord(c)
            child = links.get(key)
            if child is None:
                top, tokens = -math.inf, 0
                for start in range(max(0, end - self.longest), end):
                    own = scores.get(word[start:end])
                    if own is not None:
                        value, size = best[path[start]] + own, count[path[start]] + 1
                        if value > top or value == top and size < tokens:
                            top, tokens = value, size
                if c not in scores:
                    spelt = len(c.encode("utf-8", "surrogatepass"))
                    value, size = best[node] + BYTE_COST * spelt, count[node] + spelt
                    if value > top or value == top and size < tokens:
                        top, tokens = value, size
                child = links[key] = len(best)
                best.append(top)
                count.append(tokens)
            node = child
            path.append(node)
        return count[node]


def count_words(words: Iterable[str], scores: dict[str, float]) -> dict[str, int]:
    """Tokens of each distinct word, through tries of bounded size; sorted, so that one trie shares most."""
    longest = max(map(len, scores), default=1)
    out: dict[str, int] = {}
    trie, held = Trie(scores, longest), 0
    for word in sorted(set(words)):
        if held > TRIE_CHARACTERS:
            trie, held = Trie(scores, longest), 0
        out[word] = trie.insert(MARK + word)
        held += len(word)
    return out


class Counter:
    """Counts texts, remembering the words of earlier batches."""

    def __init__(self, path: str):
        self.scores = piece_scores(path)
        self.forget()

    def forget(self) -> None:
        """Empties the memory of words."""
        self.known, self.stored = common.Numbers(), array("q")

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of each text."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        split = [t.split() for t in texts]
        sizes = np.array([len(x) for x in split], np.int64)
        number = self.known.of(chain.from_iterable(split), int(sizes.sum()))
        counted = count_words(self.known.fresh, self.scores)
        self.stored.extend(counted[w] for w in self.known.fresh)
        self.known.fresh = []
        found = np.array(self.stored, np.int64)[number] if len(number) else number
        reached = np.concatenate([[0], np.cumsum(found)])
        ends = np.cumsum(sizes)
        return sizes, reached[ends] - reached[ends - sizes]


@lru_cache(maxsize=1)
def counter_at(path: str) -> Counter:
    """The counter of this vocabulary, kept from task to task of a worker."""
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_pretokens, n_tokens."""
    path = vocabulary or default_vocabulary()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_at(path)
        for batch in common.text_slices(batches):
            words, tokens = counter.count([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(words), pa.array(tokens)], names=["doc_id", "n_pretokens", "n_tokens"])

    return common.only(docs, "doc_id", "text").mapInArrow(rows, "doc_id long, n_pretokens long, n_tokens long")
