"""Periodic runs against brute force over all stretches."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import common, periodic_runs, queries


def brute_runs(words):
    """Every run, by its period: maximal stretches of places equal to that a period on, of which the smallest period is kept."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_row(key, text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (text or "")).split(" ") if w]
    runs = brute_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        key, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def own_runs(documents):
    numbers = common.Numbers()
    ids = np.concatenate([numbers.of(w, len(w)) for w in documents] or [np.zeros(0, np.int64)])
    found = periodic_runs.runs_of(ids, np.array([len(w) for w in documents], np.int64))
    out = [[] for _ in documents]
    for d, *run in zip(*(x.tolist() for x in found), strict=True):
        out[d].append(tuple(run))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), max_size=5))
def test_two_words(documents):
    assert own_runs(documents) == [brute_runs(d) for d in documents]


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9))
def test_planted_periods(seed):
    draw = random.Random(seed)
    documents = []
    for _ in range(draw.randrange(1, 4)):
        words = []
        while len(words) < draw.randrange(20, 400):
            base = [draw.choice("abcdefg"[: draw.randrange(1, 8)]) for _ in range(draw.randrange(1, 30))]
            words += (base * draw.randrange(1, 8))[: draw.randrange(1, 200)]
        documents.append(words)
    assert own_runs(documents) == [brute_runs(d) for d in documents]


def test_least_shared_words():
    assert periodic_runs.shared_words() == 5
    assert periodic_runs.shared_words(5, 20) == 16
    with pytest.raises(ValueError):
        periodic_runs.runs_of(np.zeros(9, np.int64), np.array([9]), exponent=3)


def test_masked_words_are_outside_of_runs():
    words = [*"xyz", *"ab" * 5, *"pqrst", *"ab" * 2]
    ids = common.Numbers().of(words, len(words))
    covered = periodic_runs.repeated_cover(ids, np.array([len(words)]), 5)
    assert covered.tolist() == [False] * 3 + [True] * 10 + [False] * 9


def test_same_gram_in_two_documents_is_no_repeat():
    words = [*"abcdefgh"] * 2
    ids = common.Numbers().of(words, len(words))
    assert not periodic_runs.repeated_cover(ids, np.array([8, 8]), 5).any()


def test_odd_documents(spark, odd_docs, no_docs):
    rows = periodic_runs.digest(periodic_runs.find_runs(odd_docs)).collect()
    texts = {r.doc_id: r.text for r in odd_docs.select("doc_id", "text").collect()}
    assert {tuple(r) for r in rows if r.doc_id != 6} == {brute_row(k, t) for k, t in texts.items() if k != 6}
    assert next(r for r in rows if r.doc_id == 6).n_runs == 1  # 1,261 words around and around
    assert periodic_runs.find_runs(no_docs).count() == 0


def test_collapsed_text(spark):
    frame = spark.createDataFrame([(1, "go go go go go go stop"), (2, "a b\ta b a\nb a b a b end"), (1, "go go go go go go stop")], "doc_id long, text string")
    found = sorted((r.doc_id, r.collapsed, [tuple(x) for x in r.runs], r.exponent_milli) for r in periodic_runs.find_runs(frame).collect())
    assert found == [(1, "go stop", [(0, 6, 1)], 6000)] * 2 + [(2, "a b end", [(0, 10, 2)], 5000)]


def test_a_long_text_of_one_word(spark):
    frame = spark.createDataFrame([(1, "word " * 400_000)], "doc_id long, text string")
    (row,) = periodic_runs.find_runs(frame).collect()
    assert (row.n_runs, row.start, row.length, row.period, row.collapsed) == (1, 0, 400_000, 1, "word")


def test_weaving(spark):
    texts = [(i, " ".join(f"w{j}" for j in range(i % 37))) for i in range(400)] + [(None, "a b"), (7, None), (10, " \n")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", periodic_runs.woven(F.col("text"), F.col("doc_id")).alias("text"))
    for key, text in frame.collect():
        words = [w for k, t in texts[:400] if k == key for w in t.split()] if key != 7 else None
        h = zlib.crc32(str(key).encode()) if key is not None else 1
        if not words or h % 10:
            continue
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert text == " ".join(words[i if i < a else a + (i - a) % p] for i in range(n))


def test_query_against_brute_force(spark, small_dir):
    docs = common.table(spark, small_dir, "documents").select("doc_id", "text").collect()
    expected = set()
    for key, text in docs:
        words = (text or "").split() if text is None or text.isascii() else [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        h = zlib.crc32(str(key).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[i if i < a else a + (i - a) % p] for i in range(n))
        expected.add(brute_row(key, text))
    assert {tuple(r) for r in queries.op12_periodic_runs(spark, small_dir).collect()} == expected
