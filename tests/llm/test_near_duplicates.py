"""SimHash fingerprints and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from lodestone.llm import components, simhash_pivot


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", "a", "a b", "a b c", "A b C d", "a\x0bb\x0cc d e", "é Ü ß " * 40])
def test_fingerprint(text):
    assert simhash_pivot.fingerprint((text or "").encode()) == brute_print(text)


def test_cells_are_complete():
    draw = random.Random(3)
    for _ in range(300):
        a = draw.getrandbits(64)
        b = a
        for _ in range(draw.randrange(3)):
            b ^= 1 << draw.randrange(64)
        frees = [(1 << 64) - 1]
        for _ in range(simhash_pivot.LEVELS):  # on every level some cell of the two holds both
            met = []
            for free in frees:
                keys = simhash_pivot.cell_keys(np.array([a, b], np.uint64), free)
                met += [left for left, same in zip(simhash_pivot.free_after(free), keys[0] == keys[1], strict=True) if same]
            assert met and all((a ^ b) & ~left == 0 for left in met)
            frees = met[:2]


@pytest.mark.parametrize("level", range(simhash_pivot.LEVELS))
def test_keys_tell_blocks_apart(level):
    free = (1 << 64) - 1
    for _ in range(level):
        free = simhash_pivot.free_after(free)[3]
    low = simhash_pivot.blocks_of(free)[0]
    blocks = np.array([sum(1 << bit for i, bit in enumerate(low) if n >> i & 1) for n in range(1 << len(low))], np.uint64)
    assert len(np.unique(simhash_pivot.cell_keys(blocks, free)[:, 0])) == len(blocks)


@pytest.mark.parametrize("most_in_cell", [256, 20, 2])
def test_links(spark, most_in_cell):
    """Chains of near fingerprints, and many that share 40 bits, in cells that are split up to four times."""
    draw = random.Random(5)
    prints = {}
    for _ in range(60):
        prints[len(prints)] = 0x123456789A << 24 | draw.getrandbits(9) << 7
    for base in [draw.getrandbits(64) for _ in range(12)]:
        current = base
        for _ in range(12):
            prints[len(prints)] = current
            for _ in range(draw.randrange(1, 4)):
                current ^= 1 << draw.randrange(64)
    frame = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()], "doc_id long, fp long")
    distinct = frame.groupBy("fp").min("doc_id").withColumnRenamed("min(doc_id)", "rep")
    links = simhash_pivot.links(distinct, most_in_cell)
    settled = {r.node: r.root for r in components.connected_components(links).collect()}
    signed = {i: p - (1 << 64) if p >> 63 else p for i, p in prints.items()}
    least = {}
    for i in sorted(prints):
        least.setdefault(settled.get(signed[i], signed[i]), i)
    assert {i: least[settled.get(signed[i], signed[i])] for i in prints} == brute_components(prints)


def test_components_of_a_chain(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200), (200, 201)]
    found = components.connected_components(spark.createDataFrame(pairs, "u long, v long"))
    assert {(r.node, r.root) for r in found.collect()} == {(i, 0) for i in range(1, 61)} | {(201, 200)}


def test_odd_documents(spark, odd_docs, no_docs):
    found = {r.doc_id: r for r in simhash_pivot.near_duplicates(odd_docs).collect()}
    assert len(found) == 11
    assert {found[i].component_id for i in (1, 2, 3)} == {1} and found[1].fingerprint == "0" * 16
    assert found[5].component_id == 4
    assert simhash_pivot.near_duplicates(no_docs).count() == 0


def brute_groups(texts):
    """Least id of each id's component under a Jaccard similarity of 0.8 on five-word shingles."""
    sets = {}
    for i, text in texts.items():
        words = (text or "").lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    least = {i: i for i in texts}
    for i in sorted(sets):
        for j in sorted(sets):
            shared = len(sets[i] & sets[j])
            if j > i and 10 * shared >= 8 * (len(sets[i]) + len(sets[j]) - shared) and least[i] != least[j]:
                low, high = sorted((least[i], least[j]))
                least = {k: low if c == high else c for k, c in least.items()}
    return least


def edited_copies(seed, families, copies):
    draw = random.Random(seed)
    texts = {}
    for _ in range(families):
        words = [f"w{draw.randrange(5000)}" for _ in range(120)]
        for _ in range(copies):
            texts[len(texts)] = " ".join(words)
            words = list(words)
            for _ in range(draw.randrange(1, 7)):
                words[draw.randrange(len(words))] = f"v{draw.randrange(5000)}"
    return texts


@pytest.mark.parametrize("most_bits", [26, 0])
def test_similar_texts(spark, monkeypatch, most_bits):
    """With no bits hardly a leader is asked, and the differences have to find every pair."""
    monkeypatch.setattr(simhash_pivot, "MOST_BITS", most_bits)
    texts = edited_copies(7, 5, 6) | {1000: "a b c", 1001: "A  b c", 1002: "a b d", 1003: None, 1004: " "}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash_pivot.near_duplicates(docs).collect()}
    assert found == brute_groups(texts)
    assert 5 < len(set(found.values())) < len(texts)


def test_a_large_family_that_drifts(spark):
    """Every copy is edited from the one before, so most are no near copies of their cells' leaders."""
    texts = edited_copies(3, 2, 40) | {k + 500: t for k, t in edited_copies(4, 10, 1).items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in simhash_pivot.near_duplicates(docs).collect()} == brute_groups(texts)


@pytest.mark.parametrize("size", [1, 2, 5, 30, 300])
def test_pairs_at_the_limit_pass_the_filter(size):
    """Fingerprints of sets with a similarity of 0.8 differ by far fewer bits than the filter asks for."""
    draw = np.random.default_rng(size)
    apart = []
    for _ in range(300):
        a = np.unique(draw.integers(0, 1 << 63, 9 * size).astype(np.uint64))
        b = np.append(a[size:], draw.integers(0, 1 << 63, size).astype(np.uint64))
        apart.append((simhash_pivot.majority(a) ^ simhash_pivot.majority(b)).bit_count())
    assert max(apart) <= simhash_pivot.MOST_BITS


@given(st.integers(0, 10**9))
@settings(max_examples=300, deadline=None)
def test_alike_sets_share_differences_from_a_centre(seed):
    """Of two alike sets of which one is not like the centre, the other's first differences hold one that both have."""
    draw = random.Random(seed)
    n = draw.choice([3, 9, 30, 100])
    centre = set(range(n))

    def edited(base, most):
        gone = set(draw.sample(sorted(base), min(len(base) - 1, draw.randrange(most + 1))))
        return base - gone | {draw.randrange(1000, 1000 + 3 * n) for _ in range(draw.randrange(most + 1))}

    first = edited(centre, n // 2 + 1)
    second = edited(first, n // 6 + 1)
    array = lambda x: np.array(sorted(x), np.uint64)
    for x, y in ((first, second), (second, first)):
        if simhash_pivot.alike(array(x), array(y), 0.8) and not simhash_pivot.alike(array(x), array(centre), 0.8):
            parts = [*sorted(y - centre), *sorted(centre - y)]
            least = simhash_pivot.shared_least(len(parts), len(y), n, 0.8)
            assert len((x ^ centre) & (y ^ centre)) >= least
            assert set(parts[: len(parts) - least + 1]) & (x ^ centre)


def test_a_family_of_which_a_third_strays_is_not_paired_up(spark, monkeypatch):
    """The sets that meet grow with the family, not with its square."""
    draw = random.Random(5)
    words = [f"w{i}" for i in range(150)]
    counts = []
    confirmed = simhash_pivot._confirmed
    monkeypatch.setattr(simhash_pivot, "_confirmed", lambda pairs, *rest: counts.append(pairs.count()) or confirmed(pairs, *rest))
    for copies in (60, 120):
        texts = {}
        for i in range(copies):
            own = list(words)
            for _ in range(draw.choice([1, 2, 6])):
                own[draw.randrange(150)] = f"v{draw.randrange(10**6)}"
            texts[i] = " ".join(own)
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        assert {r.doc_id: r.component_id for r in simhash_pivot.near_duplicates(docs).collect()} == brute_groups(texts)
    assert counts[0] <= 60 and counts[1] <= 60 and counts[2] <= 120 and counts[3] <= 120


def brute_entries(members, band):
    """Distances to all pivots of a band's fingerprint, by sorting the members in each of its orders."""
    first = []
    for order in range(band * simhash_pivot.BAND_ROWS, (band + 1) * simhash_pivot.BAND_ROWS):
        mask, factor = int(simhash_pivot._MASKS[order, 0]), int(simhash_pivot._FACTORS[order, 0])
        first.append(min(members, key=lambda m: (m ^ mask) * factor % (1 << 64)))
    print_ = sum(1 << bit for bit in range(64) if 2 * sum(m >> bit & 1 for m in first) > len(first))
    return tuple((print_ ^ int(pivot)).bit_count() for pivot in simhash_pivot.PIVOTS)


def test_cells_of_sets_come_from_the_pivot_table(monkeypatch):
    """Two sets meet in a band's cell where the table has the same distances for their fingerprints, and only there."""
    draw = random.Random(8)
    asked = []
    table = simhash_pivot.distance_table
    monkeypatch.setattr(simhash_pivot, "distance_table", lambda prints, *rest: asked.append(len(prints)) or table(prints, *rest))
    base = [draw.getrandbits(64) for _ in range(40)]
    sets = [sorted({*base[n:], *(draw.getrandbits(64) for _ in range(n))}) for n in (0, 0, 2, 4, 8, 39)] + [base[:1]]
    keys = [simhash_pivot.band_keys(np.array(s, np.uint64)) for s in sets]
    assert asked == [simhash_pivot.BANDS] * len(sets)
    same = 0
    for band in range(simhash_pivot.BANDS):
        entries = [brute_entries(s, band) for s in sets]
        assert [[a == b for b in entries] for a in entries] == [[a[band] == b[band] for b in keys] for a in keys]
        same += entries[0] == entries[3]
    assert 0 < same < simhash_pivot.BANDS


@pytest.mark.parametrize("size", [5, 10, 45, 180])
def test_alike_sets_share_a_cell(size):
    """At the limit: one in five of the smaller set's size is missing from it."""
    draw = np.random.default_rng(size)
    for _ in range(300):
        whole = np.unique(draw.integers(0, 1 << 63, size).astype(np.uint64))
        part = np.sort(draw.permutation(whole)[: -(-size * 4 // 5)])
        assert simhash_pivot.alike(whole, part, 0.8) and (simhash_pivot.band_keys(whole) == simhash_pivot.band_keys(part)).any()


def test_sets_meet_by_what_the_fewest_differ_by(spark):
    """Shingles that all copies lack come last though they are least, on both sides."""
    draw = random.Random(9)
    rare = {node: [draw.randrange(1000, 10**9) * 2 for _ in range(10)] for node in range(60)}
    rare[1] = rare[0][:1] + rare[1][1:]
    rows = [(7, node, node, 0, simhash_pivot.MEETS_BY, part, 20, 36, 11) for node in rare for part in [*range(0, 20, 2), *rare[node]]]
    told = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ("home", "node", "root", "heart", "kind", "part", "apart", "size", "least")))
    first = simhash_pivot._first_parts(told, 0.8).collect()
    assert sorted((r.node, r.part) for r in first if r.met) == [(0, rare[0][0]), (1, rare[0][0])]
    assert sorted((r.node, r.part) for r in first if r.asks) == sorted((n, part) for n in rare for part in rare[n]) and {r.held for r in first} == {10}
    more = simhash_pivot._first_parts(told.withColumn("least", told["least"] - 3), 0.8)  # three places more than there are rare ones
    found = [r.part for r in more.where("met").collect()]
    assert len(found) == 2 + 3 * 60 and set(found) == {0, 2, 4, rare[0][0]}


def test_stage_removes_edited_copies(spark, small_dir):
    texts = edited_copies(11, 20, 2)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, small_dir).collect()}
    assert kept == set(brute_groups(texts).values())
    assert len({r.component_id for r in simhash_pivot.near_duplicates(docs, shingle=3, radius=2).collect()}) > len(kept)


def test_only_what_cells_are_made_for(no_docs):
    for wrong in ({"radius": 11}, {"similarity": 0.5}):
        with pytest.raises(ValueError):
            simhash_pivot.near_duplicates(no_docs, **wrong)
