"""The stored full-text index against reading every text, and cover density against all stretches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import search, text_index
from lodestone.operators.text_index import TextIndex

WORDS = ["an", "and", "ant", "bee", "been", "cat", "Dog", "dogma", "ähre", "ährchen", "x_1"]


def drawn(seed, count):
    draw = random.Random(seed)
    return [(i, draw.choice([" ", "-", "\n", ". "]).join(draw.choice(WORDS) for _ in range(draw.randrange(40)))) for i in range(count)]


def index_of(spark, folder, rows):
    index = TextIndex(spark, str(folder / "index"))
    index.put(spark.createDataFrame(rows, "id long, t string"), "id", search.index_text(F.col("t")))
    return index


def words_of(text):
    return [w.lower() for w in re.findall(r"\w+", text or "")]


def brute_density(text, terms, weight=0.1):
    """All stretches that hold every term and no shorter one that does, by trying them all."""
    words = words_of(text)
    at = [i for i, w in enumerate(words) if any(w.startswith(t) for t in terms)]
    full = [(a, b) for a in at for b in at if a <= b and all(any(w.startswith(t) for w in words[a : b + 1]) for t in terms)]
    least = [(a, b) for a, b in full if not any((c, d) != (a, b) and a <= c and d <= b for c, d in full)]
    return sum(weight / (1 + (b - a + 1) - sum(a <= i <= b for i in at)) for a, b in least)


@pytest.mark.parametrize("query", ["an", "do be", "an and", "äHr x_1 cat", "ant-an/an"])
def test_ranks(spark, tmp_path, query):
    rows = drawn(3, 60)
    index = index_of(spark, tmp_path, rows)
    frame = spark.createDataFrame(rows, "id long, t string")
    scanned = {r[0]: pytest.approx(r[1]) for r in search.fulltext(frame, "id", search.index_text(F.col("t")), query).collect()}
    assert dict(map(tuple, index.matches(query).collect())) == scanned
    terms = [w.lower() for w in re.findall(r"\w+", query)]
    expected = {i: brute_density(t, terms) for i, t in rows}
    assert dict(map(tuple, index.cover_density(query).collect())) == {i: pytest.approx(r) for i, r in expected.items() if r}


def test_a_search_reads_ranges_of_terms(spark, tmp_path):
    index = index_of(spark, tmp_path, drawn(1, 20))
    plan = index.matches("an dog")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[Or\(And\(GreaterThanOrEqual\(term,an\),LessThan\(term,ao\)\),And\(", plan)
    assert "gaps" not in re.search(r"ReadSchema: (\S+)", plan)[1]


def test_generations(spark, tmp_path):
    rows = drawn(2, 40)
    index = index_of(spark, tmp_path, rows)
    now = dict(rows)
    changes = [{3: "and an ant", 5: None, 99: "an"}, {3: "an", 7: "bee"}]
    for change in changes:
        index.put(spark.createDataFrame(list(change.items()), "id long, t string"), "id", F.col("t"))
        now |= change
    index.drop(spark.createDataFrame([(1,), (99,), (None,), (12345,)], "id long"), "id")
    now = {i: t for i, t in now.items() if i not in (1, 99)}
    expected = {i: sum(w.startswith("an") for w in words_of(t)) / len(words_of(t)) for i, t in now.items() if any(w.startswith("an") for w in words_of(t))}
    for _ in range(2):
        assert dict(map(tuple, index.matches("an").collect())) == {i: pytest.approx(r) for i, r in expected.items()}
        index.compact()
    assert len(index.generations()) == 1


def test_a_generation_counts_once_it_is_committed(spark, tmp_path, monkeypatch):
    index = index_of(spark, tmp_path, [(1, "an")])
    fresh = spark.createDataFrame([(1, "bee"), (2, "an")], "id long, t string")
    monkeypatch.setattr(TextIndex, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index.put(fresh, "id", F.col("t"))
    monkeypatch.undo()
    assert [r.key for r in index.matches("an").collect()] == [1]
    index.put(fresh, "id", F.col("t"))  # the same generation again
    assert [r.key for r in index.matches("an").collect()] == [2]


def test_odd_texts(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " - "), (None, "an"), (4, "an " * 90_000), (5, "힣 x"), (6, "An")]
    index = index_of(spark, tmp_path, rows)
    assert dict(map(tuple, index.matches("an").collect())) == {4: 1.0, 6: 1.0}
    assert index.matches(" / ").count() == index.covers("--").count() == 0
    assert [r.key for r in index.matches("힣").collect()] == [5]
    empty = TextIndex(spark, str(tmp_path / "empty"))
    empty.put(spark.createDataFrame([], "id long, t string"), "id", F.col("t"))
    assert empty.matches("an").count() == 0
    assert text_index.folder_state(spark, str(tmp_path))[0] > 0
