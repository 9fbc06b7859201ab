"""Exact top-k search against scores of all pairs."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, maxscore, queries

FRAME = "vec_id long, embedding array<float>"


def brute(rows, every, k=5):
    """The k best by sorting all scores; rows are (id, weights)."""
    out = set()
    asked = {}
    for key, w in rows:
        if key is not None and w is not None and key % every == 0:
            asked[key] = min(asked.get(key, w), w)
    for key, q in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(q, w, strict=False)), other) for other, w in rows if other not in (None, key) and w is not None)
        out |= {(key, n + 1, other, -score) for n, (score, other) in enumerate(scored[:k])}
    return out


def own(spark, rows, every, **sizes):
    frame = spark.createDataFrame(rows, "vec_id long, weights array<long>")
    return [tuple(r) for r in maxscore.search(frame, F.col("vec_id") % every == 0, **sizes).collect()]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("empty", [0.0, 0.9])
def test_sparse_and_dense_rows(spark, seed, empty):
    draw = random.Random(seed)
    rows = [(i, [0 if draw.random() < empty else draw.randrange(-40, 41) for _ in range(12)]) for i in range(500)]
    found = own(spark, rows, 7, shard_rows=150, block_queries=20)
    assert len(found) == len(set(found)) and set(found) == brute(rows, 7)


@pytest.mark.parametrize("sign", [1, -1])
def test_bounds_hold_for_each_shard(sign):
    draw = np.random.default_rng(5)
    for _ in range(200):
        n, d = int(draw.integers(1, 400)), int(draw.integers(1, 9))
        table = draw.integers(-3, 4, (n, d)) * (draw.random((n, d)) < draw.random())
        table = np.abs(table) * sign if draw.random() < 0.5 else table
        rows, terms = np.nonzero(table)
        ids = draw.permutation(n)
        query = draw.integers(-3, 4, d)
        shard = maxscore.Shard(ids, rows, terms, table[rows, terms])
        asked = np.flatnonzero(query)
        expected = sorted((-int(s), int(i)) for s, i in zip(table @ query, ids, strict=True) if i != 0)[:5]
        assert shard.best(0, asked.tolist(), query[asked].tolist(), 5) == [(-s, i) for s, i in expected]


def test_ties_and_repeated_rows(spark):
    rows = [(i, [3, -1]) for i in range(200)] + [(3, [3, -1])] * 2 + [(0, [1, 1])]
    found = sorted(own(spark, rows, 100, shard_rows=40))
    assert found == sorted([(0, 1, 1, 2), (0, 2, 2, 2), (0, 3, 3, 2), (0, 4, 3, 2), (0, 5, 3, 2), (100, 1, 0, 10), (100, 2, 1, 10), (100, 3, 2, 10), (100, 4, 3, 10), (100, 5, 3, 10)])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, []), (6, [0.5]), (7, [-0.001, 0.0, 9.0]), (50, [])]
    frame = spark.createDataFrame(rows, FRAME).select("vec_id", maxscore.weights(F.col("embedding")).alias("weights"), F.lit(1).alias("shard"), F.lit(2).alias("block"))
    found = sorted(tuple(r) for r in maxscore.search(frame, F.col("vec_id") % 50 == 0).collect())
    assert found == [(0, 1, 6, 128 * 128), (0, 2, 5, 0), (0, 3, 50, 0), (0, 4, 7, -128), (50, 1, 0, 0), (50, 2, 5, 0), (50, 3, 6, 0), (50, 4, 7, 0)]
    assert maxscore.search(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_scores_beyond_64_bits(spark):
    large = 2**62
    found = own(spark, [(0, [large, 1]), (1, [large, 0]), (2, [-large, 0]), (3, [0, 5])], 50)
    assert found == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 5), (0, 3, 2, -(2**63))]


def test_query_against_brute_force_and_sql(spark, small_dir):
    rows = [(r.vec_id, [int(np.floor(256 * float(x))) for x in r.embedding]) for r in common.table(spark, small_dir, "embeddings").collect()]
    found = [tuple(r) for r in queries.op13_maxscore(spark, small_dir).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, 50)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small_dir}/embeddings.parquet'")
    assert set(duck.execute(maxscore.oracle()).fetchall()) == set(found)
