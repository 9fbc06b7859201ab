"""Repeated strings against brute force, and the column-wise order against sorting."""

import hashlib
import random

import numpy as np
import pytest

from lodestone.llm import suffix_columns


def brute(rows):
    seen, out = set(), {}
    for key, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - 99):
            window = raw[at : at + 100]
            if window in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[key] = (len(raw), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def texts():
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdeé ") for _ in range(draw.randrange(1, 9)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(60):
        own = " ".join(word() for _ in range(draw.randrange(0, 80)))
        cut = draw.randrange(0, 100)
        rows.append((i, own + passage[cut : cut + draw.randrange(80, 200)] + own[::-1] if i % 2 else own))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "ab" * 400), (103, "x" * 300), (104, "abcdefg" * 60), (105, None), (106, ""), (107, "y" * 99), (108, "y" * 100), (109, "y" * 101)]
    return rows


@pytest.mark.parametrize("most_in_group", [8192, 2])
def test_against_brute_force(spark, most_in_group):
    """With small groups crowded representatives are split down to single windows."""
    rows = texts()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_columns.remove_repeats(frame, most_in_group).collect()}
    assert found == brute(rows)


@pytest.mark.parametrize("seed", range(4))
def test_column_order(seed):
    draw = np.random.default_rng(seed)
    strings = [bytes(draw.integers(1, 4, draw.integers(0, 25)).astype(np.uint8)) for _ in range(40)]
    sizes = np.array([len(s) for s in strings])
    columns = np.zeros((int(sizes.max()), len(strings)), np.uint32)
    for i, s in enumerate(strings):
        columns[: len(s), i] = np.frombuffer(s, np.uint8)[::-1]
    transform, prefixes = suffix_columns.column_order(columns, sizes)
    suffixes = sorted(s[i:] for s in strings for i in range(len(s) + 1))

    def shared(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    assert prefixes.tolist() == [0, *(shared(a, b) for a, b in zip(suffixes, suffixes[1:], strict=False))]
    assert sorted(transform.tolist()) == sorted([0] * len(strings) + [c for s in strings for c in s])


@pytest.mark.parametrize(("in_memory", "length"), [(10, 8), (10, 12), (1 << 18, 16), (1 << 18, 20)])
def test_equal_windows_in_files_and_in_memory(monkeypatch, in_memory, length):
    monkeypatch.setattr(suffix_columns, "IN_MEMORY", in_memory)
    draw = random.Random(length)
    strings = [bytes(draw.choices(b"ab", k=draw.randrange(0, 60))) for _ in range(40)]
    phase = np.array([draw.randrange(4) for _ in strings])
    entry, place, group = suffix_columns.equal_windows(strings, np.arange(40), phase, length)
    assert len(entry) == sum(max(0, len(s) - length + 1) for s in strings)
    found, expected = {}, {}
    for e, p, g in zip(entry.tolist(), place.tolist(), group.tolist(), strict=True):
        found.setdefault(g, set()).add((e, p))
        expected.setdefault((strings[e][p : p + length], (p - int(phase[e])) % 4), set()).add((e, p))
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


def test_least_between():
    draw = np.random.default_rng(1)
    values = draw.integers(0, 255, 200).astype(np.uint8)
    low = draw.integers(0, 199, 300)
    high = np.array([draw.integers(a + 1, 201) for a in low])
    assert suffix_columns._least_between(values, low, high).tolist() == [values[a:b].min() for a, b in zip(low, high, strict=True)]


@pytest.mark.parametrize("alphabet", [300, 70_000, 1 << 20])
def test_stable_order(alphabet):
    symbols = np.random.default_rng(alphabet).integers(0, alphabet, 5_000).astype(np.uint32)
    assert suffix_columns._stable_order(symbols, alphabet).tolist() == np.argsort(symbols, kind="stable").tolist()


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1 << 16])
def test_order_does_not_depend_on_chunks(monkeypatch, chunk):
    monkeypatch.setattr(suffix_columns, "CHUNK", chunk)
    for seed in range(3):
        test_column_order(seed)


def test_every_size_of_collection_and_task(spark, monkeypatch):
    """What is held, ordered or hashed together changes nothing (within one process, as workers read the module anew)."""
    rows = [(k, t.encode()) for k, t in texts() if t]
    expected = brute([(k, t.decode()) for k, t in rows])
    for collection in (1, 3_000, 1 << 22):
        monkeypatch.setattr(suffix_columns, "COLLECTION", collection)
        owner, begin, size, key, periodic = suffix_columns.passages([t for _, t in rows])
        goes_on, (doc, start, span) = suffix_columns._settled(owner, begin, size, key, periodic, [t for _, t in rows])
        gone = [bytearray(len(t)) for _, t in rows]
        for d, b, n in zip(doc.tolist(), start.tolist(), span.tolist(), strict=True):
            gone[d][b : b + n] = b"\1" * n
        assert [sum(g) for g in gone] == [expected[k][1] for k, _ in rows]
        assert 0 < goes_on.sum() < len(goes_on)


def test_representatives_do_not_depend_on_the_buffer():
    draw = random.Random(3)
    raws = [bytes(draw.choices(b"abcdef ", k=400)) for _ in range(30)]
    together = suffix_columns.passages(raws)
    for i, raw in enumerate(raws):
        alone = suffix_columns.passages([raw])
        mine = together[0] == i
        for a, b in zip(alone[1:4], together[1:4], strict=True):
            assert a.tolist() == b[mine].tolist()


def test_a_common_line_with_differing_neighbours(spark):
    """One representative with many different passages, in more tasks than one."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefgh", k=9))
    line = " ".join(word() for _ in range(14))
    rows = [(i, " ".join([*(word() for _ in range(12)), line[i % 3 :], *(word() for _ in range(12))])) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for most in (512, 20):
        found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_columns.remove_repeats(frame, most).collect()}
        assert found == brute(rows)


def test_long_texts_are_cut_with_an_overlap(monkeypatch):
    monkeypatch.setattr(suffix_columns, "BLOCK", 150)
    raw = bytes(random.Random(1).choices(range(97, 123), k=1000))
    parts = [(o + a, k) for strings, _, offsets in suffix_columns._cut([raw]) for s, o in zip(strings, offsets, strict=True) for _, a, _, k, _ in zip(*suffix_columns.passages([s]), strict=True)]
    starts = {a + i for a, _ in parts for i in [0]}
    assert min(starts) == 0
    covered = sum(int(z) - 99 for strings, _, _ in suffix_columns._cut([raw]) for s in strings for z in suffix_columns.passages([s])[2])
    assert covered == len(raw) - 99


def test_shared_ids(spark):
    a, b = "q" * 40 + "word " * 30, "other " * 40
    frame = spark.createDataFrame([(1, a), (1, b), (1, a), (None, a), (2, None)], "doc_id long, text string")
    found = suffix_columns.remove_repeats(frame).collect()
    assert len(found) == 5 and sorted(r.doc_id for r in found if r.doc_id is not None) == [1, 1, 1, 2]
    assert next(r for r in found if r.doc_id is None).n_removed < len(a)
    assert sum(r.n_removed == len(a) for r in found) == 2


def test_odd_documents(odd_docs, no_docs):
    assert suffix_columns.remove_repeats(odd_docs).count() == 11
    assert suffix_columns.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_passages_left_out_share_nothing(seed):
    draw = random.Random(seed)
    word = lambda: bytes(draw.choices(b"abcd ", k=draw.randrange(1, 7)))
    shared = b"".join(word() for _ in range(60))
    texts = [b"".join(word() for _ in range(40)) + shared[draw.randrange(60) :][: draw.randrange(60, 160)] + b"".join(word() for _ in range(40)) for _ in range(40)] + [b"abcab" * 60]
    owner, begin, size, key, periodic = suffix_columns.passages(texts)
    strings = [texts[o][b : b + s] for o, b, s in zip(owner, begin, size, strict=True)]
    order = np.argsort(key.view(np.int64), kind="stable")
    strings, key = [strings[i] for i in order], key[order].view(np.int64)
    chosen = suffix_columns.may_share(key, strings)
    seen = {}
    for i, s in enumerate(strings):
        for at in range(len(s) - 99):
            seen.setdefault((key[i], s[at : at + 100]), []).append(i)
    needed = {i for where in seen.values() if len(where) > 1 for i in where}
    assert needed <= set(np.flatnonzero(chosen).tolist()) and chosen.sum() < len(strings)
