"""Greedy string tiling, packing, and the pipeline."""

import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import common, mixture_packing, registry, simhash_pivot, string_tiling


def brute_tiles(item, doc, least):
    marked_item, marked_doc, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in marked_item and j + n not in marked_doc:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        marked_item.update(range(i, i + n))
        marked_doc.update(range(j, j + n))
        covered += n


@pytest.mark.parametrize("seed", range(60))
def test_tiles(seed):
    draw = random.Random(seed)
    item = [draw.randrange(1, 30) for _ in range(draw.randrange(5, 60))]
    doc = [draw.randrange(1, 30) for _ in range(40)]
    cuts = sorted(draw.sample(range(len(item) + 1), 2))
    doc = doc[:10] + item[cuts[1] :] + doc[10:20] + item[cuts[0] : cuts[1]] + doc[20:] + item[: cuts[0]]
    tiles = string_tiling.tile(item, doc, 5)
    places = [p for i, _, n in tiles for p in range(i, i + n)]
    assert len(places) == len(set(places)) and all(item[i : i + n] == doc[j : j + n] and n >= 5 for i, j, n in tiles)
    assert len(places) == brute_tiles(item, doc, 5)


def test_leaks(spark, odd_docs, no_docs):
    words = [f"word{i}" for i in range(40)]
    item = " ".join(words)
    turned = "Before. " + " ".join(words[20:]).upper() + "! and then: " + ", ".join(words[:20]) + " after"
    benchmark = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, item), (5, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, turned), (2, " ".join(words[:12])), (3, "nothing at all " * 9), (4, None), (5, item), (6, item)], "doc_id long, text string")
    found = string_tiling.leaks(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(d, i) for d in (1, 5, 6) for i in (1, 4)}
    assert {(r.n_tiles, r.coverage) for r in found if r.doc_id == 1} == {(2, 1.0)}
    assert string_tiling.leaks(odd_docs, benchmark).count() == 0 == string_tiling.leaks(no_docs, benchmark).count()
    assert string_tiling.leaks(docs, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("most_seeds", [1 << 20, 0])
def test_leaks_against_brute_force(spark, most_seeds):
    """Every document against every item, with and without a shuffle of the seeds; ids are shared and missing."""
    draw = random.Random(8)
    word = lambda: f"w{draw.randrange(40)}"
    items = [(i % 12 or None, " ".join(word() for _ in range(draw.randrange(3, 30)))) for i in range(14)] + [(50, "la " * 12), (51, "la la la di " * 4)]
    docs = [(None, "la " * 300)]
    for i in range(60):
        own = [word() for _ in range(draw.randrange(0, 40))]
        for _ in range(draw.randrange(3)):
            piece = draw.choice(items)[1].split()
            cut = draw.randrange(len(piece))
            own[draw.randrange(len(own) + 1) : 0] = piece[cut:] + piece[:cut]
        docs.append((i // 2, " ".join(own)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = string_tiling.leaks(frame, spark.createDataFrame(items, "item_id long, text string"), most_seeds=most_seeds).collect()
    expected = []
    for key, text in docs:
        for item_id, item in items:
            covered = brute_tiles(item.split(), text.split(), 5)
            if item_id is not None and len(item.split()) >= 5 and covered >= 0.5 * len(item.split()):
                expected.append((key, item_id, round(covered / len(item.split()), 9)))
    order = lambda rows: sorted(rows, key=repr)
    assert order((r.doc_id, r.item_id, round(r.coverage, 9)) for r in found) == order(expected) and len(expected) > 20


@pytest.mark.parametrize("seed", range(30))
def test_repetitive_texts_are_tiled_row_by_row(seed):
    draw = random.Random(seed)
    item, doc = ([draw.randrange(1, 3) for _ in range(draw.randrange(n))] for n in (30, 60))
    tiles = string_tiling.tile(item, doc, 5, most_matches=0)
    places = [p for i, _, n in tiles for p in range(i, i + n)]
    assert len(places) == len(set(places)) == brute_tiles(item, doc, 5)
    assert all(item[i : i + n] == doc[j : j + n] for i, j, n in tiles)


def test_a_long_repetitive_text_takes_little_time():
    import time

    begin = time.monotonic()
    tiles, coverage = string_tiling.tiled("la " * 60, "la " * 200_000)
    assert coverage == 1.0 and tiles == [(0, 0, 60)] and time.monotonic() - begin < 5


def test_encoder():
    path = mixture_packing.default_tokenizer()
    encoder, whole = mixture_packing.WordEncoder(path), Tokenizer.from_file(path)
    texts = ["", "  ", "It's THE cat's 42nd <|endoftext|> day", "don't''s --'re ... 'LL", "é Größe İstanbul ΑΣ ς ½ ①", "日本語 a\x1cb c\x85d e", "a_b-c\td e" * 3, "Ünï" * 200]
    texts += ["".join(random.Random(i).choice("aB'sé1 .,_\n") for _ in range(80)) for i in range(200)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids


def check_packing(rows, tokens):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    lengths = []
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
        lengths.append(at)
    assert sum(n < 4096 for n in lengths) <= 1 and sorted(by_sequence) == list(range(len(by_sequence)))
    for key, ids in tokens.items():
        at = 0
        for r in sorted(by_doc[key], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_packing_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = mixture_packing.pack(docs).collect()
    whole = Tokenizer.from_file(mixture_packing.default_tokenizer())
    tokens = {r.doc_id: [*whole.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    check_packing(rows, tokens)
    total = sum(map(len, tokens.values()))
    share = {}
    for r in rows:
        share.setdefault(r.source, 0)
        share[r.source] += r.length
    for sequence in {r.sequence_id for r in rows if r.sequence_id < total // 4096 - 1}:
        for source, n in share.items():
            own = sum(r.length for r in rows if r.sequence_id == sequence and r.source == source)
            assert abs(own - 4096 * n / total) <= len(share) + 1


@pytest.mark.parametrize("weights", [None, {"a": 3, "b": 1}, {"a": 1, "b": 1, "c": 1}, {"c": 2.5}])
def test_schedule(weights):
    totals = {"a": 50_000, "b": 21_111, "c": 37, "d": 9_999}
    plan = mixture_packing.schedule(totals, weights)
    draw, taken = np.random.default_rng(0), []
    for source, name in enumerate(plan.names):
        sizes = []
        while sum(sizes) < totals[name]:
            sizes.append(min(int(draw.integers(1, 3000)), totals[name] - sum(sizes)))
        sizes = np.array(sizes)
        doc, start, length, sequence, offset = mixture_packing.pieces(plan, source, np.cumsum(sizes) - sizes, sizes)
        for d in range(len(sizes)):
            own = sorted(zip(start[doc == d].tolist(), length[doc == d].tolist(), strict=True))
            assert [s for s, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(n for _, n in own) == sizes[d]
        taken += zip((sequence * 4096 + offset).tolist(), length.tolist(), strict=True)
    at = 0
    for place, length in sorted(taken):
        assert place == at
        at += length
    assert at == sum(totals.values())


@pytest.mark.parametrize(("weights", "most"), [("even", 256), (None, 4), ("even", 2)])
def test_weights_and_many_sources(spark, weights, most):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = mixture_packing.pack(docs, weights=weights, most_queues=most).collect()
    whole = Tokenizer.from_file(mixture_packing.default_tokenizer())
    own = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    check_packing(rows, {r.doc_id: [*whole.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()})
    assert all(r.source == own[r.doc_id] for r in rows)
    if most == 256:  # while all queues last, each has the same part of every window
        first = [sum(r.length for r in rows if r.sequence_id == 0 and r.source == s) for s in set(own.values())]
        assert max(first) - min(first) <= len(first)


def test_repeated_rows_and_ids_are_packed_each(spark):
    rows = [(1, "one two", "a"), (1, "one two", "a"), (1, "three two", "a"), (None, "four", None), (None, "four", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = mixture_packing.pack(docs).collect()
    assert sum(r.length for r in found) == sum(len(Tokenizer.from_file(mixture_packing.default_tokenizer()).encode(t, add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    assert sorted((r.sequence_id, r.offset) for r in found) == [(0, sum(r.length for r in sorted(found, key=lambda r: r.offset)[:i])) for i in range(len(found))]


def test_packing_of_odd_documents(odd_docs, no_docs):
    rows = mixture_packing.pack(odd_docs).collect()
    whole = Tokenizer.from_file(mixture_packing.default_tokenizer())
    check_packing(rows, {r.doc_id: [*whole.encode(r.text or "", add_special_tokens=False).ids, 2] for r in odd_docs.collect()})
    assert mixture_packing.pack(no_docs).count() == 0


def test_pipeline(spark, small_dir):
    docs = common.table(spark, small_dir, "documents")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        tables.append(common.written(stage(spark, tables[-1], small_dir), "test"))
        assert tables[-1].columns == docs.columns
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in tables]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    groups = {r.doc_id: r.component_id for r in simhash_pivot.near_duplicates(tables[1]).collect()}
    assert ids[2] == {d for d, c in groups.items() if d == c}
    leaked = {r.doc_id for r in string_tiling.leaks(tables[2], common.table(spark, small_dir, "benchmark")).collect()}
    assert ids[3] == ids[2] - leaked
    whole = Tokenizer.from_file(mixture_packing.default_tokenizer())
    packed = registry.queries()["pipeline"](spark, small_dir).collect()
    check_packing(packed, {r.doc_id: [*whole.encode(r.text or "", add_special_tokens=False).ids, 2] for r in tables[4].collect()})


def test_rows_with_missing_and_shared_ids_are_told_apart(spark, small_dir):
    item = common.table(spark, small_dir, "benchmark").where("length(text) > 200").orderBy("item_id").first()["text"]
    plain = [f"the {w} of the {v} was as {u} as the rest of it on that day in town" for w, v, u in zip("abcdefg", "hijklmn", "opqrstu", strict=True)]
    rows = [(None, item), (None, plain[0] * 3), (1, item), (1, plain[1] * 3), (2, plain[2] * 3), (2, plain[2] * 3), (None, plain[0] * 3), (3, plain[0] * 3), (4, plain[3] * 3)]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1]), 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row int")
    left = corpus_pipeline.decontamination(spark, common.written(docs, "test"), small_dir)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted((str(k), t) for k, t in rows if t != item)
    single = corpus_pipeline.near_duplicates(spark, common.written(left, "test"), small_dir).collect()
    assert sorted(r.text for r in single) == sorted({t for _, t in rows if t != item})


def test_pipeline_of_odd_documents(spark, odd_docs, no_docs, small_dir):
    for start in (odd_docs, no_docs):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.written(stage(spark, docs, small_dir), "odd")
            assert docs.columns == start.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, small_dir).count() >= 0


@pytest.mark.parametrize("seed", range(400))
def test_both_ways_of_tiling_give_the_same_tiles(seed):
    draw = random.Random(seed)
    kinds = draw.choice([2, 2, 3, 5])
    item, doc = ([draw.randrange(kinds) for _ in range(draw.randrange(5, 60))] for _ in range(2))
    doc = [-1 if draw.random() < 0.02 else t for t in doc]
    least = draw.choice([2, 3, 5])
    tiles = string_tiling.tile(item, doc, least, first=draw.choice([least, 8, 20]))
    assert tiles == string_tiling.longest_runs(item, doc, least)
    assert [n for _, _, n in tiles] == sorted((n for _, _, n in tiles), reverse=True)


@pytest.mark.parametrize("weights", [mixture_packing.EVEN, {"s0": 4.0, "s7": 2.0, "s8": 2.0, "none": 9.0}])
def test_sources_that_share_a_queue_keep_their_joint_share(spark, weights):
    rows = [(100 * s + i, f"word {s} " * (40 + 20 * (s < 3)), f"s{s}") for s in range(9) for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixture_packing.pack(frame, weights=weights, window=256, most_queues=4).where("sequence_id < 3").groupBy("source").agg(F.sum("length").alias("n")).collect()
    sent = {r.source: r.n for r in found}
    small = sum(n for s, n in sent.items() if int(s[1:]) > 2)
    expected = 6 / 9 if weights == mixture_packing.EVEN else 4 / 8
    assert abs(small / sum(sent.values()) - expected) < 0.01
