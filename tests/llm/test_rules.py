"""Compression bands, url rules and token counts."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodestone.llm import compression_bands, trie_counts, url_digest


def brute_repeats(words, window=8):
    windows = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered.update(range(i, i + window))
    return len(covered)


@given(st.lists(st.sampled_from("ab"), max_size=40))
def test_repeated_words(words):
    text = " ".join(words)
    assert compression_bands.base_counts(text, text.encode())[4] == brute_repeats(words)


def test_base_counts():
    text = "é a\nb #*\n\nb #*\n \na<"
    assert compression_bands.base_counts(text, text.encode()) == (7, 10, 5, 1, 0)
    assert compression_bands.base_counts("", b"") == (0, 0, 0, 0, 0)


def test_bands(spark):
    draw = random.Random(2)
    words = ["".join(draw.choice("etaoinshrdlu") for _ in range(draw.randrange(2, 9))) for _ in range(300)]
    clean = " ".join(draw.choice(words) for _ in range(900))
    noise = " ".join("".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(30)) for _ in range(100))
    same = " ".join(f"{i} the very same sentence follows here" for i in range(300))
    frame = spark.createDataFrame([(1, clean), (2, noise), (3, same), (4, None), (5, "few words"), (6, clean)], "doc_id long, text string")
    found = {r.doc_id: (r.base_failed, r.kept, r.reason) for r in compression_bands.compression_bands(frame).collect()}
    assert found[1] == found[6] == (False, True, None)
    assert found[2] == (False, False, "incompressible")
    assert found[3][1] is False
    assert found[4] == found[5] == (True, False, "base")


def brute_verdict(raw, bands):
    """The method's verdict by slicing and comparing, with a compressor made anew for each part."""
    ratio = lambda part: len(compression_bands.zstandard.compress(part, bands.level)) / len(part)
    band = lambda rows, n: [r for r in rows if n <= r[0]][0]
    _, low, high = band(bands.whole, len(raw))
    if not low <= ratio(raw) <= high:
        return False
    parts = [raw[i : i + bands.chunk_bytes] for i in range(0, len(raw), bands.chunk_bytes)]
    outside = [p for p in parts if not band(bands.chunk, len(p))[1] <= ratio(p) <= band(bands.chunk, len(p))[2]]
    return len(outside) <= bands.most_chunks_out * len(parts)


@pytest.mark.parametrize("seed", range(40))
def test_verdict_against_brute_force(seed):
    draw = random.Random(seed)
    bands = compression_bands.Bands()
    press = compression_bands.zstandard.ZstdCompressor(level=bands.level)
    word = lambda letters: "".join(draw.choices(letters, k=draw.randrange(1, 12)))
    words = [word("etaoinshrdlu") for _ in range(draw.choice([3, 40, 400]))]
    text = " ".join(draw.choice(words) if draw.random() < 0.9 else word("ABCDEFGHabcdefgh0123456789+/%$") for _ in range(draw.choice([5, 20, 60, 400, 3000])))
    raw = text.encode()
    assert (compression_bands.judge(raw, bands, press)[3] is None) == brute_verdict(raw, bands)


def test_short_texts_have_limits():
    bands = compression_bands.Bands()
    press = compression_bands.zstandard.ZstdCompressor(level=bands.level)
    draw = random.Random(1)
    noise = bytes(draw.choices(range(33, 127), k=240))
    assert compression_bands.judge(b"word " * 50, bands, press)[3] == "repetitive" == compression_bands.judge(b"ab " * 40, bands, press)[3]
    assert compression_bands.judge(noise, bands, press)[3] == "incompressible"
    assert compression_bands.judge(b"A plain sentence of prose is neither the one nor the other, however short it may be.", bands, press)[3] is None
    assert compression_bands.judge(b"x" * (3 << 20), bands, press)[3] == "repetitive"


def test_bands_of_odd_documents(odd_docs, no_docs):
    assert compression_bands.compression_bands(odd_docs).count() == 11
    assert compression_bands.compression_bands(no_docs).count() == 0


URLS = [
    ("https://a.example.org/es/1", "example.org/es/", "block"),
    ("https://example.org/en/12?x", "example.org/en/1", "block"),
    ("https://EXAMPLE.org/en/2", "org/", "allow"),
    ("http://x.com/de/", "com/de/", "block"),
    ("http://x.com/fr/?q#f", "com/fr/", "allow"),
    ("http://notorg/", None, "allow"),
    ("http://www.spam-farm.example.net/x", None, "block"),
    ("http://myspam-farm.example.net/x", None, "allow"),
    ("http://x.org", None, "allow"),
    ("no scheme", None, "allow"),
    ("", None, "allow"),
    (None, None, "allow"),
]


def test_url_filter(spark):
    frame = spark.createDataFrame([(i, u, "k") for i, (u, _, _) in enumerate(URLS)], "page_id long, url string, rule string")
    hosts = spark.createDataFrame([(h, "x") for h in (*url_digest.BLOCKED_HOSTS, None, url_digest.BLOCKED_HOSTS[0])], "host string, rule string")
    found = url_digest.url_filter(frame).orderBy("page_id").collect()
    for most_bytes in (1 << 20, 0):  # the second time the list is joined
        assert url_digest.url_filter(frame, hosts=hosts, most_bytes=most_bytes).orderBy("page_id").collect() == found
    assert {r.verdict for r in url_digest.url_filter(frame, rules=[], hosts=hosts.limit(0)).collect()} == {"allow"}
    assert [(r.rule, r.verdict) for r in found] == [(rule, verdict) for _, rule, verdict in URLS]
    assert (found[2].host, found[2].path) == ("example.org", "/en/2") and (found[9].host, found[9].path) == ("", "")
    assert url_digest.url_filter(frame.limit(0)).count() == 0


def test_digest_collisions(tmp_path, monkeypatch):
    monkeypatch.setattr(url_digest, "digests", lambda texts: url_digest.np.array([len(t) for t in texts], url_digest.np.uint64))
    texts = ["ab", "cd", "efg", "ab"]
    url_digest.DigestArray.write(tmp_path, "x", texts, [[url_digest.HOST, 2], [url_digest.HOST, 2], [url_digest.RULE_BLOCK, 1], [url_digest.RULE_ALLOW, 1]])
    array = url_digest.DigestArray(tmp_path, "x")
    found = array.find(["cd", "zz", "efg", "ab", "ab", "cd"], url_digest.np.array([True, True, False, True, False, False]))
    assert [(array.string(at), int(array.facts[at, 0])) if at >= 0 else None for at in found] == [("cd", 0), None, ("efg", 2), ("ab", 0), ("ab", 1), None]


PIECES = {"▁": -3.0, "▁a": -2.0, "a": -2.5, "ab": -3.0, "b": -2.0, "▁ab": -5.0, "c": -1.0, "bc": -3.0, "é": -2.0}


def brute_count(word):
    word = trie_counts.MARK + word
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[s][0] + PIECES[word[s:end]], -(best[s][1] + 1)) for s in range(end) if word[s:end] in PIECES]
        if word[end - 1] not in PIECES:
            size = len(word[end - 1].encode())
            options.append((best[end - 1][0] + trie_counts.BYTE_COST * size, -(best[end - 1][1] + size)))
        score, count = max(options)
        best.append((score, -count))
    return best[-1][1]


@given(st.lists(st.text("abcé日", min_size=1, max_size=8), max_size=12))
def test_trie_counts(words):
    assert trie_counts.count_words(words, PIECES) == {w: brute_count(w) for w in words}


def test_trie_is_bounded(monkeypatch):
    monkeypatch.setattr(trie_counts, "TRIE_CHARACTERS", 3)
    words = ["abc", "abd", "b", "bca", "c"]
    assert trie_counts.count_words(words, PIECES) == {w: brute_count(w) for w in words}


def test_token_counts(odd_docs, no_docs):
    found = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in trie_counts.token_counts(odd_docs).collect()}
    assert found[1] == found[2] == found[3] == (0, 0) and found[4] == found[5] and found[6][0] == 30_000
    assert trie_counts.token_counts(no_docs).count() == 0


@pytest.mark.parametrize("text", ["the cat", "ünïcode"])
def test_scores_are_probabilities(text):
    scores = trie_counts.piece_scores(trie_counts.default_vocabulary())
    assert abs(sum(map(trie_counts.math.exp, scores.values())) - 1) < 1e-6 and all(c in scores for c in text.replace(" ", ""))
