"""Window panes with revisions against a fold over rows, and its parts."""

import math
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, queries, window_panes
from lodestone.llm.window_panes import NEVER, Panes, Store

EPOCH = datetime(1970, 1, 1)
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


def brute(rows, batches=12):
    """All records by going through the batches pane by pane; rows are (click_id, ts, arrived_at, kind, value)."""
    dealt, seen = defaultdict(list), {}
    for key, ts, arrived, kind, value in rows:
        if ts is None or key is None:
            continue
        day = ((arrived or ts) - EPOCH).days
        turn = day % batches
        batch = min(batches - 1, turn + max(0, zlib.crc32(str(key).encode()) % 30 - 23))
        hour = (ts - timedelta(days=day - turn) - EPOCH) // timedelta(hours=1)
        cents = 0 if value is None or not math.isfinite(value) else math.floor(100 * value + 0.5)
        row = (batch, hour, "none" if kind is None else kind, cents)
        seen[key] = min(seen.get(key, row), row)
    for key, (batch, hour, kind, cents) in seen.items():
        dealt[batch].append((key, hour, kind, cents))
    out, panes, sent, mark = [], {}, {}, -math.inf
    for batch in range(batches):
        new = set()
        for key, hour, kind, cents in dealt[batch]:
            if mark >= hour + 1 + 72:
                out.append((batch, hour, key, 1, cents, "late", kind))
            else:
                n, c = panes.get((kind, hour), (0, 0))
                panes[kind, hour] = n + 1, c + cents
                new.add((kind, hour))
        for pane in list(panes):
            kind, hour = pane
            if pane in sent and pane in new:
                out.append((batch, hour, -1, *sent[pane], "retract", kind))
                out.append((batch, hour, -1, *panes[pane], "replace", kind))
                sent[pane] = panes[pane]
            elif pane not in sent and mark >= hour + 1 + 2:
                out.append((batch, hour, -1, *panes[pane], "emit", kind))
                sent[pane] = panes[pane]
            if mark >= hour + 1 + 72:
                del panes[pane]
        mark = max([mark, *(hour for _, hour, _, _ in dealt[batch])])
    out += [(batches - 1, hour, -1, *total, "final", kind) for (kind, hour), total in panes.items() if (kind, hour) not in sent]
    return sorted(out)


def drawn(seed, count):
    draw = random.Random(seed)
    rows = []
    for key in range(count):
        arrived = EPOCH + timedelta(days=19723 + draw.choice([0, 0, 3, 5, 7, 8, 11, 12, 30]), seconds=draw.randrange(86400))
        ts = arrived - timedelta(seconds=draw.choice([1, 600, 7200, 90000, 300000, 3000000]) * draw.random())
        rows.append((key, ts, arrived, draw.choice(["a", "a", "a", "b", None]), draw.choice([None, 1.005, -3.335, 2.5, float("nan"), float("inf"), 1e9])))
    return rows + rows[: count // 10]


def found(spark, rows, panes=Panes()):
    frame = spark.createDataFrame([(k, t, a, 1, kind, v, "{}") for k, t, a, kind, v in rows], CLICKS).withColumn("shard", F.lit("x")).withColumn("late", F.lit(3))
    return sorted(tuple(r) for r in window_panes.revisions(frame, panes).collect())


def test_all_records(spark):
    rows = drawn(1, 600)
    got = found(spark, rows, Panes(batches=7, ring=3, shards=4))  # a ring that is too short for most panes
    assert got == brute(rows, 7)
    assert {r[5] for r in got} == {"late", "emit", "retract", "replace", "final"}


def test_odd_rows_and_an_empty_table(spark):
    t = datetime(2024, 1, 2, 3, 4, 5)
    rows = [(1, t, t, "a", 1.0), (1, t, t, "a", 0.5), (2, None, t, "a", 1.0), (None, t, t, "a", 1.0), (3, t, None, None, None), (4, datetime(1960, 5, 6), datetime(1960, 5, 7), "", -0.005)]
    assert found(spark, rows, Panes(batches=3)) == brute(rows, 3)
    assert found(spark, [], Panes(batches=2)) == []
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != window_panes.ROCKSDB


def test_query_against_brute_force_and_sql(spark, small_dir):
    rows = [(r.click_id, r.ts, r.arrived_at, r.kind, r.value) for r in common.table(spark, small_dir, "clicks").collect()]
    got = sorted(tuple(r) for r in queries.op11_window_panes(spark, small_dir).collect())
    assert got == brute(rows)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW clicks AS SELECT * FROM '{small_dir}/clicks.parquet'")
    assert sorted(duck.execute(window_panes.oracle()).fetchall()) == got


@pytest.mark.parametrize("seed", range(30))
def test_a_store_against_a_dictionary(seed):
    draw = random.Random(seed)
    panes = Panes(shards=3, ring=4, due=1, closed=9)
    shard = draw.randrange(3)
    state, totals, sent, mark = (), {}, {}, NEVER
    for _ in range(12):
        store = Store(shard, panes, *state)
        last = mark - panes.closed - 1
        hours = [h for h in (3 * draw.randrange(-15, 30) + shard for _ in range(draw.randrange(8))) if h > last]
        cents = [draw.randrange(-(2**60), 2**60) for _ in hours]
        store.add(np.array(hours, np.int64), np.ones(len(hours), np.int64), np.array(cents, np.int64) // 8)
        for h, c in zip(hours, cents, strict=True):
            n, total = totals.get(h, (0, 0))
            totals[h] = n + 1, total + c // 8
        expected = []
        for h, total in totals.items():
            if h <= mark - panes.due - 1 and sent.get(h) != total:
                expected += [(h, *total, "emit")] if h not in sent else [(h, *sent[h], "retract"), (h, *total, "replace")]
                sent[h] = total
        got = [(*x, record) for h, n, c, record in store.send(mark - panes.due - 1, "emit") for x in zip(h.tolist(), n.tolist(), c.tolist(), strict=True)]
        assert sorted(got) == sorted(expected)
        if mark > NEVER:
            store.forget(last)
            totals = {h: t for h, t in totals.items() if h > last}
        state = store.state()
        mark = max(mark, draw.randrange(-40, 60), *hours) if hours or draw.random() < 0.5 else mark


def test_sums_beyond_the_weights_of_bincount():
    values = np.array([2**62, -(2**61), 2**53 + 1, 1, -1], np.int64)
    assert window_panes.binned(np.array([0, 1, 2, 2, 3]), values, 5).tolist() == [2**62, -(2**61), 2**53 + 2, -1, 0]


def test_batches_of_late_rows_alone_are_combined():
    columns = {"kind": ["a", "a", "a"], "shard": [0, 0, 1], "hour": [5, 5, 6], "click_id": [1, 2, 3], "n": [1, 1, 1], "cents": [7, -2, 4]}
    schema = pa.schema([("kind", pa.string()), ("shard", pa.int32()), *[(c, pa.int64()) for c in ("hour", "click_id", "n", "cents")], ("late", pa.bool_())])
    batch = lambda late: pa.RecordBatch.from_pydict({**columns, "late": late}, schema=schema)
    out = pa.Table.from_batches(list(window_panes.combined(iter([batch([True] * 3), batch([False] * 3)])))).to_pylist()
    assert sorted(r["click_id"] for r in out if r["late"]) == [1, 2, 3]
    assert sorted((r["hour"], r["n"], r["cents"]) for r in out if not r["late"]) == [(5, 2, 5), (6, 1, 4)]


def test_state_lies_in_files_though_the_session_has_rocksdb(spark, tmp_path, monkeypatch):
    provider = "spark.sql.streaming.stateStore.providerClass"
    monkeypatch.setattr(common, "scratch", lambda _, label: f"{tmp_path}/{label}")
    rows = drawn(2, 80)
    spark.conf.set(provider, window_panes.ROCKSDB)
    try:
        assert found(spark, rows, Panes(batches=3)) == brute(rows, 3)
        assert spark.conf.get(provider) == window_panes.ROCKSDB
    finally:
        spark.conf.unset(provider)
    kept = {p.suffix for p in tmp_path.glob("panes/checkpoint/state/0/*/*") if not p.name.startswith(".")}
    assert ".delta" in kept and not kept & {".changelog", ".zip"}  # a store of RocksDB leaves native memory behind whenever it is opened


def test_sums_beyond_doubles_pass_through_the_stream(spark):
    start = datetime(2024, 1, 1)
    values = [2e14, 2e14, 0.01, 0.03, -1e14, 0.05]
    rows = [(6 * day + i, start + timedelta(days=day, hours=i % 3), start + timedelta(days=day), "a", value) for day in range(3) for i, value in enumerate(values)]
    got = found(spark, rows, Panes(batches=4))
    assert got == brute(rows, 4)
    assert any(abs(r[4]) > 2**53 and r[4] % 2 for r in got)
