"""Language mixtures, weak labels and the personal-data field: accuracy and brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import language_mixture, pii_crf, weak_labels


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(spark, documents):
    held = language_mixture.is_held_out(F.col("doc_id"))
    model = language_mixture.train(documents.where(~held))
    found = language_mixture.identify(documents.where(held), model).join(documents, "doc_id")
    right = found.where("lang = lang_pred").count()
    assert right >= 0.97 * found.count() > 0


def test_mixture_of_two():
    draw = random.Random(1)
    alphabets = {"x": "abcde", "y": "vwxyz", "z": "mnopq"}
    say = lambda lang, n: " ".join("".join(draw.choice(alphabets[lang]) for _ in range(5)) for _ in range(n))
    counts = []
    for lang in "xyz":
        buckets, _, _ = language_mixture.trigrams([say(lang, 2000).encode()])
        counts.append(np.bincount(buckets, minlength=language_mixture.BUCKETS + 1)[:-1] + 0.01)
    log_p = np.zeros((3, language_mixture.BUCKETS + 1), np.float32)
    log_p[:, :-1] = [np.log(c / c.sum()) for c in counts]
    model = language_mixture.LanguageModel(("x", "y", "z"), log_p)
    shares = language_mixture.mixtures(model, [(say("x", 300) + " " + say("y", 100)).encode(), say("z", 50).encode(), b"", b" 12 "])
    assert shares[0][2] == 0 and abs(shares[0][0] - 0.75) < 0.05
    assert shares[1].tolist() == [0, 0, 1] and not shares[2].any() and shares[3].sum() in (0, 1)


def brute_mixture(model, raw, mixing=language_mixture.Mixing()):
    """The same inference written out for one text: every set of languages is found by taking one out at a time."""
    text = bytes(c if c >= 128 else c | 32 if chr(c).isalpha() else 32 for c in b" " + raw + b" ")
    text = re.sub(rb" +", b" ", text)
    grams = [text[i] | text[i + 1] << 8 | text[i + 2] << 16 for i in range(len(text) - 2)]
    places = [(g * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for g in grams]
    cut = [places[i : i + 64] for i in range(0, len(places), 64)]
    if not places:
        return [0.0] * len(model.names)
    fit = []
    for run in cut:
        sums = [sum(float(p[g]) for g in run) * mixing.weight for p in model.log_p]
        fit.append([np.exp(max(s - max(sums), -300)) for s in sums])

    def em(chosen):
        share = {k: 1 / len(chosen) for k in chosen}
        for _ in range(mixing.rounds):
            joint = [{k: share[k] * row[k] for k in chosen} for row in fit]
            share = {k: sum(j[k] / max(sum(j.values()), 1e-300) for j in joint) / len(fit) for k in chosen}
        return share, sum(np.log(max(sum(share[k] * row[k] for k in chosen), 1e-300)) for row in fit)

    chosen = list(range(len(model.names)))
    share, likely = em(chosen)
    while len(chosen) > 1:
        weakest = min(chosen, key=lambda k: (share[k], -k))
        fewer, value = em([k for k in chosen if k != weakest])
        if value + mixing.price * np.log1p(len(fit)) < likely:
            break
        chosen.remove(weakest)
        share, likely = fewer, value
    return [share.get(k, 0.0) for k in range(len(model.names))]


def test_mixtures_against_brute_force(documents):
    draw = random.Random(9)
    model = language_mixture.train(documents)
    some = {r.lang: r.text for r in documents.where("n_chars > 400").orderBy("doc_id").limit(60).collect()}
    raws = []
    for _ in range(25):
        parts = [draw.choice(list(some.values()))[draw.randrange(100) :][: draw.randrange(5, 400)] for _ in range(draw.randrange(1, 4))]
        raws.append(" ".join(parts).encode())
    raws += [b"12 34", b"a", "ça et là".encode(), b"x" * 300]
    found = language_mixture.mixtures(model, raws)
    for raw, share in zip(raws, found, strict=True):
        assert np.allclose(share, brute_mixture(model, raw), atol=2e-3), raw


def test_other_languages_are_rejected(spark, documents):
    model = language_mixture.train(documents)
    draw = random.Random(4)
    strange = ["Это русский текст который модель никогда не видела раньше нигде", "".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=3_000_000))]
    frame = spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string")
    assert language_mixture.keep_identified(frame, model).count() == 0
    assert language_mixture.keep_identified(documents, model).count() == documents.count()


def test_trigrams_do_not_cross_texts():
    together, first, count = language_mixture.trigrams([b"ab cd", b"", b"ef", b" g "])
    for i, raw in enumerate([b"ab cd", b"", b"ef", b" g "]):
        alone, own_first, own_count = language_mixture.trigrams([raw])
        assert together[first[i] : first[i] + count[i]].tolist() == alone[own_first[0] : own_first[0] + own_count[0]].tolist()


def test_language_of_odd_documents(odd_docs, no_docs):
    model = language_mixture.train(odd_docs)
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_mixture.identify(odd_docs, model).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0) and found[7][0] == "de" and len(found) == 11
    assert {r.doc_id for r in language_mixture.keep_identified(odd_docs, model).collect()} & {1, 2, 3} == set()
    assert language_mixture.keep_identified(odd_docs, model).columns == odd_docs.columns
    assert language_mixture.identify(no_docs, model).count() == 0
    nothing = language_mixture.train(no_docs)
    assert {r.lang_pred for r in language_mixture.identify(odd_docs, nothing).collect()} == {"und"}


def test_em_finds_labellers():
    draw = np.random.default_rng(0)
    truth = draw.random(5000) < 0.8
    votes = np.full((5000, 4), weak_labels.NONE)
    for j, (bad, good) in enumerate([(0.5, 0.99), (0.6, 0.98), (0.3, 0.99), (0.97, 0.98)]):
        votes[:, j] = np.where(truth, draw.random(5000) < good, draw.random(5000) >= bad)
    votes[draw.random(5000) < 0.5, 3] = weak_labels.NONE
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_labels.fit_votes(patterns, counts.astype(float))
    guessed = model.posterior(votes) > 0.5
    assert (guessed == truth).mean() > 0.93 and abs(model.good - 0.8) < 0.05


def test_held_out_quality(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    test = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    _, scorer = weak_labels.train(documents, labels.where(~test))
    found = weak_labels.score(documents, scorer).join(labels.where(test).select("doc_id", F.col("quality").alias("good"), "toxic"), "doc_id").collect()
    assert sum((r.quality >= 0.5) == bool(r.good) for r in found) >= 0.95 * len(found)
    clean = [r for r in found if r.good and not r.toxic]
    assert sum(r.kept for r in clean) >= 0.97 * len(clean)


def test_scores_against_brute_force(spark):
    """Every word's and figure's weight looked up and added one by one."""
    draw = np.random.default_rng(3)
    weights = np.where(draw.random((weak_labels.DIMENSIONS, 2)) < 0.2, draw.normal(size=(weak_labels.DIMENSIONS, 2)), 0).astype(np.float32)
    scorer = weak_labels.Scorer(weights, np.array([0.3, -0.2]))
    letters = random.Random(2)
    word = lambda: "".join(letters.choices("abcdeé", k=letters.randrange(1, 9)))
    texts = [None, "", "12 | #", *(" ".join(word() for _ in range(letters.choice([3, 50, 400]))) for _ in range(30))]
    found = weak_labels.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), scorer).orderBy("doc_id").collect()
    for text, row in zip(texts, found, strict=True):
        f, words = weak_labels.figures(text or "")
        held = {p for w in words for p in weak_labels.places(w)}
        total = np.array([0.3, -0.2])
        for p in held:
            total = total + weights[p].astype(float) * weak_labels.word_scale(len(words))
        for b in weak_labels.bins(f):
            total = total + sum(weights[p].astype(float) for p in weak_labels.places(b))
        quality, clean = 1 / (1 + np.exp(-np.clip(total, -50, 50)))
        assert abs(row.quality - quality) < 1e-9 and abs(row.toxicity - (1 - clean)) < 1e-9 and row.kept == (quality >= 0.5 and 1 - clean < 0.5)


def test_votes_against_brute_force():
    """Expectation and maximisation written out document by document."""
    draw = np.random.default_rng(5)
    votes = draw.integers(0, 3, (40, 4))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    supposed = [weak_labels.HEURISTIC] * 3 + [weak_labels.ANNOTATOR]
    share, says = 0.8, [[list(s[c]) for s in supposed] for c in (0, 1)]
    for _ in range(7):
        good = []
        for row in votes:
            fit = [p * np.prod([says[c][j][v] for j, v in enumerate(row)]) for c, p in ((0, 1 - share), (1, share))]
            good.append(fit[1] / sum(fit))
        for c in (0, 1):
            for j in range(4):
                said = [sum((g if c else 1 - g) for g, row in zip(good, votes, strict=True) if row[j] == v) for v in range(3)]
                cast = sum(row[3] != 2 for row in votes)
                pull, whole = (10, sum(said)) if j < 3 else (10 + 0.2 * cast, said[0] + said[1])
                says[c][j] = [min(1.0, max(1e-4, (said[v] + supposed[j][c][v] * pull) / (whole + pull))) for v in (0, 1)] + [1.0]
        share = min(0.98, max(0.02, sum(good) / 40))
    model = weak_labels.fit_votes(patterns, counts.astype(float), rounds=7)
    assert abs(model.good - share) < 1e-9 and np.allclose(model.says, says, atol=1e-9)


def test_weak_labels_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (5, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    _, scorer = weak_labels.train(odd_docs, labels)
    assert weak_labels.score(odd_docs, scorer).count() == 11
    _, empty = weak_labels.train(no_docs, labels.limit(0))
    assert weak_labels.score(odd_docs, empty).count() == 11 and weak_labels.score(no_docs, empty).count() == 0


def brute_base(text):
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        odd = [int(d) for d in digits[-1::-2]]
        even = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
        if 16 <= len(digits) <= 19 and (sum(odd) + sum(even)) % 10 == 0:
            found.append(("card", m))
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [(k, m.start(), m.end()) for k, m in found]


@pytest.mark.parametrize("seed", range(300))
def test_base_patterns(seed):
    draw = random.Random(seed)
    parts = ["a.b@c.de", "@", "x_y", "1.2.3.4", "300.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (301) 555-0346", "+", "..", "- ", " ", "9", "é", "\n", "a@b", ".c", "+49.30.1234567)", "4" * 16, "0" * 17]
    text = "".join(draw.choice(parts) for _ in range(draw.randrange(1, 14)))
    assert sorted(pii_crf.base_spans(text)) == sorted(brute_base(text))


def test_long_runs_are_linear():
    assert pii_crf.base_spans("a" * 300_000 + "@" + "1" * 300_000) == []


def test_viterbi_is_the_best_path():
    field = pii_crf.train()
    (run,) = pii_crf.runs("12 3456-78 a9")
    (labels,) = pii_crf.viterbi(field, [run])
    scores = [field.state[[field.places[f] for f in pii_crf.features(w) if f in field.places]].sum(0) for w in run]
    k = len(pii_crf.LABELS)

    def value(path):
        total = field.step[k][path[0]]
        return total + sum(s[p] for s, p in zip(scores, path, strict=True)) + sum(field.step[a][b] for a, b in zip(path, path[1:], strict=False))

    paths = [(a, b, c) for a in range(k) for b in range(k) for c in range(k)]
    assert abs(max(map(value, paths)) - value(labels)) < 1e-9


def test_field_generalises():
    text = 'then token = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567" and ssn 123-45-6789 but page 4711 of 2024, order 1234567890123456 and version 2.0.'
    ((base, every),) = pii_crf.all_spans([text], pii_crf.train())
    assert base == [] and [(k, text[s:e]) for k, s, e in every] == [("id", "123-45-6789"), ("secret", "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567")]


@pytest.mark.parametrize(
    ("text", "secrets"),
    [
        ("the password = tangerine for it", ["tangerine"]),
        ("password=Bluebird", ["Bluebird"]),
        ('secret = "abcdefghijklmnop" and so on', ["abcdefghijklmnop"]),
        ("Passwd: moonlight.", ["moonlight"]),
        ("ssn 123 45 6789 on file", ["123 45 6789"]),
        ("password: please enter", []),
        ("the secret: never tell", []),
        ("token = null", []),
        ("a secret of the town, a token of thanks and a key to it", []),
        ("token passing: a method; keyword: a word", []),
        ("password =", []),
    ],
)
def test_words_that_a_key_word_is_set_to(text, secrets):
    ((_, every),) = pii_crf.all_spans([text], pii_crf.train())
    assert [text[s:e] for _, s, e in every] == secrets


def test_long_texts_are_searched_whole():
    text = "word " * 500_000 + "password = tangerine and a.b@c.de " + "x" * 2_000_000 + " 1.2.3.4"
    ((_, every),) = pii_crf.all_spans([text], pii_crf.train())
    assert [text[s:e] for _, s, e in every] == ["a.b@c.de", "1.2.3.4", "tangerine"]


def test_pii_of_odd_documents(odd_docs, no_docs):
    found = {r.doc_id: r for r in pii_crf.digest(pii_crf.find_pii(odd_docs)).collect()}
    assert len(found) == 11 and found[1].spans == "" and found[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert found[11].spans == "email:31:48,phone:5:22" and (found[11].n_email, found[11].n_phone) == (1, 1)
    assert found[11].base_sha256 == hashlib.sha256(b"email:31:48,phone:5:22").hexdigest()
    masked = {r.doc_id: r for r in pii_crf.mask_pii(odd_docs).collect()}
    assert masked[11].text == "call [PHONE] or mail [EMAIL] now" and masked[11].n_chars == len(masked[11].text) and masked[1].text is None
    assert pii_crf.mask_pii(odd_docs).columns == odd_docs.columns
    assert pii_crf.find_pii(no_docs).count() == 0
