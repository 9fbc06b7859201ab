"""Every query that SQL can express gives the rows of its DuckDB statement."""

import datetime
import math
import random
from pathlib import Path

import duckdb
import pytest

from lodestone.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="session")
def duck(small_dir):
    connection = duckdb.connect()
    for path in Path(small_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool | str | datetime.date):
        return value
    return round(float(value), 6) + 0.0


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, small_dir, name):
    frame = QUERIES[name](spark, small_dir)
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(frame.columns)
    assert canonical(frame.collect(), frame.columns) == canonical(found.fetchall(), columns)


def odd_embeddings(spark, folder):
    """Pairs whose cosine is 0.25 but for rounding, vectors without a direction, missing ones, and a key that comes twice."""
    draw = random.Random(9)
    vectors = [[draw.choice([0.0, 0.0, 1.0, 2.0, 3.0]) for _ in range(8)] for _ in range(120)]
    rows = [(i, v, i % 3) for i, v in enumerate(vectors)]
    rows += [(200, [0.0] * 8, 0), (201, [float("nan")] + [1.0] * 7, 0), (202, [float("inf")] + [1.0] * 7, 1), (203, None, 0), (204, [1.0] * 8, None)]
    rows += [(205, [1.0, 2.0] * 4, 1), (205, [1.0, 2.0] * 4, 1), (206, [-1.0] * 8, 1), (206, [0.0] * 8, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    frame.coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return connection


def test_pairs_of_odd_vectors_are_those_of_the_sql(spark, tmp_path):
    found = odd_embeddings(spark, tmp_path).execute(ORACLES["semantic_duplicate_pairs"])
    columns = [c[0] for c in found.description]
    frame = QUERIES["semantic_duplicate_pairs"](spark, str(tmp_path))
    assert canonical(frame.collect(), frame.columns) == canonical(found.fetchall(), columns)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 150
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
