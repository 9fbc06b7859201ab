"""Graphs, folds, searches, tables and streams on small inputs."""

import random

import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import duplicates, graph, relational, search
from lodestone.sources import files, tables
from lodestone.streaming import incremental


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src int, dst int")


@pytest.mark.parametrize("at_once", [100, 2, 0])
def test_strong_components(spark, at_once):
    found = graph.strong_components(edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1), (5, 8), (1, 2)]), at_once)
    assert {(r.node, r.component, r.in_cycle) for r in found.collect()} == {(1, 1, True), (2, 1, True), (3, 1, True), (4, 4, True), (5, 4, True), (6, 6, True), (7, 7, False), (8, 8, False)}


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=25))
def test_tarjan(pairs):
    reach = {(a, b) for a, b in pairs}
    for k in range(10):
        reach |= {(a, b) for a in range(10) for b in range(10) if (a, k) in reach and (k, b) in reach}
    found = {frozenset(c) for c in graph.tarjan([a for a, _ in pairs], [b for _, b in pairs])}
    assert found == {frozenset(b for b in range(10) if a == b or (a, b) in reach and (b, a) in reach) for a in {x for p in pairs for x in p}}


def test_strong_components_of_a_random_graph(spark):
    draw = random.Random(2)
    pairs = [(draw.randrange(60), draw.randrange(60)) for _ in range(90)]
    one, many = ({(r.node, r.component, r.in_cycle) for r in graph.strong_components(edges(spark, pairs), n).collect()} for n in (1000, 5))
    assert one == many


def test_strong_components_of_nothing(spark):
    assert graph.strong_components(edges(spark, [])).count() == 0


def test_bounded_cycles(spark):
    found = graph.bounded_cycles(edges(spark, [(1, 2), (2, 1), (2, 3), (3, 1), (4, 4), (3, 4)]), 4)
    assert sorted(r.cycle for r in found.collect()) == [[1, 2], [1, 2, 3], [4]]


def test_or_join_keeps_pairs_once(spark):
    left = spark.createDataFrame([(1, "a", "a"), (2, "b", "c")], "i int, x string, y string")
    right = spark.createDataFrame([(1, "a"), (2, "c")], "j int, z string")
    assert sorted((r.i, r.j) for r in relational.or_join(left, right, [("x", "z"), ("y", "z")], "i", "j").collect()) == [(1, 1), (2, 2)]


def test_sync_plan_with_nulls_and_locks(spark):
    a = spark.createDataFrame([("keep", 1.0, None), ("edit", 1.0, False), ("gone", 1.0, False), ("back", 1.0, True), ("lost", 1.0, True), ("lock", 1.0, False)], "k string, t double, d boolean")
    b = spark.createDataFrame([("keep", 1.05), ("edit", 2.0), ("back", 1.0), ("new", 1.0), ("lock", 9.0)], "k string, t double")
    found = relational.sync_plan(a, b, "k", "t", "d", locked=spark.createDataFrame([("lock",)], "k string"))
    assert {r.k: r.action for r in found.collect()} == {"keep": "keep", "edit": "update", "gone": "delete", "back": "resurrect", "lost": "keep", "new": "insert"}


def test_blocks_by_id(spark):
    frame = spark.range(5)
    assert relational.blocks_by_id(frame, "id", [1, 3]).count() == 2
    with pytest.raises(Exception, match="unknown"):
        relational.blocks_by_id(frame, "id", [1, 9]).collect()


def test_page(spark):
    row = relational.page(spark.range(7), ["id"], 3, block=2).collect()
    assert [(r.id, r.total, r.has_more) for r in row] == [(6, 7, False)]


@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert duplicates.lcs_length(a, b) == best[-1][-1]


def test_first_fit(spark):
    frame = spark.createDataFrame([("p", i, s) for i, s in enumerate([25, 9, 8, 7, 3, 0])], "p string, i int, s int")
    out = duplicates.first_fit(frame, "p", "i", "s", 10).toPandas()
    assert out.groupby("i")["size"].sum().to_dict() == dict(enumerate([25, 9, 8, 7, 3, 0]))
    assert out.groupby("batch")["size"].sum().max() <= 10


@given(st.lists(st.integers(0, 30), max_size=40))
def test_first_fit_is_the_plain_scan(sizes):
    rooms, plain = duplicates._Rooms(), []
    for n in sizes:
        at = next((i for i, r in enumerate(plain) if r >= n), None)
        assert rooms.first(n) == at
        if at is None:
            at = len(plain)
            plain.append(30)
            rooms.set(at, 30)
        plain[at] -= n
        rooms.set(at, rooms[at] - n)


@pytest.mark.parametrize("least", [0.0, 0.5, 0.8])
def test_similar_names(spark, least):
    names = ["abc", "abd", "", "xabcx", "zzz", "cba", "aabbcc", None]
    frame = spark.createDataFrame([(g, n) for g in (1, 2) for n in names], "g int, n string")
    found = {(r.g, r.a, r.b) for r in duplicates.similar_names(frame, "g", "n", least).collect()}
    known = [n for n in names if n is not None]
    assert found == {(g, a, b) for g in (1, 2) for a in known for b in known if a < b and duplicates.lcs_length(a, b) >= least * max(len(a), len(b))}


def test_greedy_pages(spark):
    frame = spark.createDataFrame([("a", i, n) for i, n in enumerate([4, 4, 4, 50, 1, 1, 1, 1])], "s string, i int, n int")
    out = duplicates.greedy_pages(frame, "s", "i", F.col("n"), 10, 3).orderBy("i").collect()
    assert [r.page for r in out] == [0, 0, 1, 2, 3, 3, 3, 4]


def test_hybrid_groups(spark):
    frame = spark.createDataFrame([("s", 1, [1, 2]), ("s", 2, [2, 3]), ("s", 3, [3, 4]), ("s", 4, [4, 5, 6])], "s string, o int, m array<int>")
    assert [(r.o, r.m) for r in duplicates.hybrid_groups(frame, "s", "o", "m").orderBy("o").collect()] == [(1, [1, 2]), (3, [3, 4]), (4, [5, 6])]


def test_fulltext(spark):
    frame = spark.createDataFrame([(1, "Größe zählt sehr"), (2, "gross"), (3, None)], "i int, t string")
    assert [(r.i, r["rank"]) for r in search.fulltext(frame, "i", F.col("t"), "größ zä").collect()] == [(1, 2 / 3)]
    assert search.fulltext(frame, "i", F.col("t"), " - ").count() == 0


def test_semantic_limit_before_minimum(spark):
    frame = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "i int, v array<float>")
    found = search.semantic(frame, "i", "v", [1.0, 0.0], 3, least=0.75)
    assert [r.i for r in found.collect()] == [0, 1]
    with pytest.raises(ValueError, match="backend"):
        search.vector_backend("other")


def test_directory_scan(spark, tmp_path):
    for name in ("a.py", "b.exe", "build/c.py", ".git/d.py", "venv/e.py", "venv/keep.py", "sub/x.md", "build/wanted.py"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    rules = files.ScanRules(allowed_in_environment=("venv/keep.py",), exceptions=("build/wanted.py",))
    found = files.scan_directory(spark, str(tmp_path), rules)
    assert sorted(r.relative_path for r in found.select("relative_path").collect()) == ["a.py", "build/wanted.py", "sub/x.md", "venv/keep.py"]


def test_lines_stop_at_nul(spark):
    frame = spark.createDataFrame([(1, "a\r\nb\rc\n\x00d"), (2, "x" * 50)], "i int, t string")
    assert [(r.i, r.line, r.content) for r in files.lines(frame, "i", "t", 40).orderBy("line").collect()] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (1, 4, "")]


def test_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_groups(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, "k")
    tables.write_groups(spark.createDataFrame([(2, "c")], "k int, v string"), path, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_sql_only_reads(spark):
    with pytest.raises(ValueError, match="SELECT"):
        tables.run_sql(spark, {}, "DROP TABLE x")


def test_renumber(spark):
    frame = spark.createDataFrame([(random.Random(i).random(), i) for i in range(500)], "x double, i int")
    out = relational.renumber(frame, ["x", "i"], "n", 7).toPandas().sort_values("n")
    assert out["n"].tolist() == list(range(500)) and out["x"].is_monotonic_increasing


def test_stream_equals_batch(spark, tmp_path):
    rows = pd.DataFrame({"k": [1, 2, 1, 3, 2, 1], "v": [1, 1, 2, 1, 3, 3], "x": list("abcdef")})
    source, state = tmp_path / "in", tmp_path / "state"
    for at in range(0, 6, 2):
        spark.createDataFrame(rows[at : at + 2]).coalesce(1).write.mode("append").parquet(str(source))
    frame = spark.read.parquet(str(source))
    query = incremental.follow(spark, str(source), frame.schema, incremental.snapshot_writer(str(state), ["k"], "v"), str(tmp_path / "cp"), files_at_once=1)
    query.awaitTermination()
    last = max(int(p.name) for p in state.iterdir())
    streamed = spark.read.parquet(str(state / str(last)))
    batch = tables.upsert(frame.limit(0), frame, ["k"], "v")
    assert sorted(map(tuple, streamed.select("k", "v", "x").collect())) == sorted(map(tuple, batch.select("k", "v", "x").collect())) == [(1, 3, "f"), (2, 3, "e"), (3, 1, "d")]


def test_backoff():
    pauses, streak = [], 0
    for work in (0, 0, 3, 0, 0, 0, 0, 0):
        pause, streak = incremental.next_interval(5, work, streak, 60)
        pauses.append(pause)
    assert pauses == [10, 20, 5, 10, 20, 40, 60, 60]
    assert incremental.next_interval(0, 0, 0) == (2, 1) and incremental.next_interval(0, 1, 9) == (1, 0)
    assert incremental.next_interval(7, 0, 100_000) == (3600, 100_001)


def test_poll_pauses_between_looks():
    work, slept = iter([0, 0, 4, 0]), []
    assert incremental.poll(lambda: next(work), 1, 4, sleep=slept.append) == [2, 4, 1, 2]
    assert slept == [2, 4, 1]


def test_freshness(spark):
    rows = [(False, "a", 1.0, "a", 1.0), (True, None, None, "a", 1.0), (True, "a", None, "b", 1.0), (True, "a", 1.0, "a", 2.0), (True, None, 2.0, "a", 1.0), (True, "a", 1.0, "a", 1.0), (True, "a", None, None, None)]
    frame = spark.createDataFrame(rows, "k boolean, a string, b double, c string, d double")
    found = frame.select(relational.freshness(*map(F.col, "kabcd")).alias("v")).collect()
    assert [r.v for r in found] == ["missing_index", "unavailable_index", "stale", "stale", "fresh", "fresh", "stale"]


def test_grep_bounded(spark):
    frame = spark.createDataFrame([(t, n, "hit" if n % 2 else "no") for t in range(4) for n in range(1, 6)], "t int, line int, c string")
    found = lambda *budget: [(r.t, r.line, r.exceeded) for r in relational.grep_bounded(frame, "t", "c", "hit", *budget).orderBy("t", "line").collect()]
    assert found(2, 10, 1000) == [(t, n, "texts") for t in range(2) for n in (1, 3, 5)]
    assert found(9, 4, 1000) == [(0, 1, "matches"), (0, 3, "matches"), (0, 5, "matches"), (1, 1, "matches")]
    assert found(9, 12, 7) == [(0, 1, "bytes"), (0, 3, "bytes")]
    assert len(found(9, 12, 1000)) == 12 and {e for *_, e in found(9, 12, 1000)} == {None}

def test_windowed_counts_stream(spark, tmp_path):
    frame = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "t string, k string").select(F.col("t").cast("timestamp").alias("t"), "k")
    frame.write.parquet(str(tmp_path / "in"))
    stream = incremental.windowed_counts(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), "t", "k")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, incremental.windowed_counts(frame, "t", "k").collect()))


@pytest.mark.parametrize("block", [2, 3, 512])
def test_similar_pairs(spark, block):
    draw = random.Random(4)
    rows = [(i, i % 3 if i != 7 else None, [draw.uniform(-1, 1) for _ in range(3)]) for i in range(20)] + [(20, 0, [0.0, 0.0, 0.0]), (21, 1, None)]
    found = duplicates.similar_pairs(spark.createDataFrame(rows, "i int, g int, v array<float>"), "i", "v", "g", 0.6, block)
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    usable = [r for r in rows if r[2] and any(r[2]) and r[1] is not None]
    assert sorted((r.g, r.left, r.right) for r in found.where("g IS NOT NULL").collect()) == sorted((a[1], a[0], b[0]) for a in usable for b in usable if a[0] < b[0] and a[1] == b[1] and cosine(a[2], b[2]) >= 0.6)


def test_merged_neighbours(spark):
    frame = spark.createDataFrame([("s", i, i in (2, 5), n) for i, n in enumerate([5, 3, 2, 4, 9, 50, 1])], "s string, o int, bad boolean, n int")
    found = duplicates.merged_neighbours(frame, "s", "o", "bad", "n", 11).orderBy("o").collect()
    assert [(r.o, r["first"], r["last"]) for r in found] == [(2, 0, 2), (5, 5, 5)]


@pytest.mark.parametrize(("rounds", "at_once"), [(0, 0), (1, 0), (40, 0), (40, 60)])
def test_hybrid_groups_in_rounds_are_those_of_the_fold(spark, rounds, at_once):
    draw = random.Random(rounds)
    groups = [(s, o, draw.sample(range(40), draw.randrange(1, 5))) for s in "ab" for o in range(40)]
    groups += [("chain", o, [o, o + 1]) for o in range(12)] + [("none", 1, []), ("none", 2, [1, 1]), ("none", 3, [2, 1, 2])]
    expected, seen = set(), {}
    for s, o, m in sorted(groups):
        left = [x for x in dict.fromkeys(m) if x not in seen.setdefault(s, set())]
        if len(left) >= 2:
            seen[s].update(left)
            expected.add((s, o, tuple(left)))
    frame = spark.createDataFrame(groups, "s string, o int, m array<int>").repartition(3)
    found = [(r.s, r.o, tuple(r.m)) for r in duplicates.hybrid_groups(frame, "s", "o", "m", rounds, at_once).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    assert duplicates.hybrid_groups(frame.limit(0), "s", "o", "m", rounds, at_once).count() == 0


def test_hybrid_groups_of_a_dense_scope_are_folded_in_slices(spark, monkeypatch):
    draw = random.Random(6)
    pairs = [(s, a * 100 + b, [a, b]) for s in "ab" for a in range(60) for b in range(a + 1, 60) if draw.random() < 0.4]
    expected, seen = set(), set()
    for s, o, m in sorted(pairs):
        if not {(s, x) for x in m} & seen:
            seen |= {(s, x) for x in m}
            expected.add((s, o, tuple(m)))
    frame = spark.createDataFrame(pairs, "s string, o int, m array<int>").repartition(3)
    sizes, folded = [], duplicates._folded

    def counted(each, *names):
        sizes.append(each.groupBy("s").count().agg(F.max("count")).first()[0])
        return folded(each, *names)

    monkeypatch.setattr(duplicates, "_folded", counted)
    found = [(r.s, r.o, tuple(r.m)) for r in duplicates.hybrid_groups(frame, "s", "o", "m", at_once=0, slice_members=400).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    assert len(sizes) > 2 and max(n or 0 for n in sizes) < 800
