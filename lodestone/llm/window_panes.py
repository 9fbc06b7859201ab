"""Hourly panes of a stream by kind, with revisions: totals are sent when due and mended while rows still come.

The rows of a table are dealt out into batches, which are written to the shared folder and fed one
after another to a Structured Streaming query that starts anew for each on one checkpoint. Event time
is folded onto the days of one cycle of batches. The watermark of a batch is the greatest event time
of all batches before it. A pane (kind and hour) is due two hours after its end and closed three days
after. Each batch sends the rows of closed panes as ``late`` and adds the others; then it sends panes
that are due for the first time (``emit``), those sent before that have new rows (``retract`` with the
old totals, ``replace`` with the new), and forgets closed ones. The last batch also sends what was never due (``final``).

Before the shuffle each task adds up its rows by pane, so that a pane or kind that holds much of the
input crosses it as one row a task; late rows, which need no state, are dealt out by their ids. A kind
is split into shards by hour. ``applyInPandasWithState`` keeps for each shard a ring of hours (counts and
sums, sent and unsent) from the first open hour on, as NumPy arrays in Arrow's form, and beside it the
panes outside of the ring, by hour. State lies in files of changes in the shared folder and, while a task
runs, its partition's part in the heap. Each start opens a store for each partition, and RocksDB, which
``transformWithState`` would need, leaves native memory behind for every store that is opened. Rows are
added by ``bincount``; what is due or closed is a slice of the ring up to a threshold. Every shard gets a
tick with each batch, so that those without rows send what has become due. The driver sees one maximum a
batch; nothing else leaves the executors.

Rows without a time or an id take no part. Rows that share an id are one: that of the least batch,
then hour, kind and sum. A null time of arrival counts as the day of the event itself, a null kind is
``none``, and a value that is null or no finite number adds nothing. Hours before 1970 are
negative. Batches without rows are run as well; an empty table gives an empty one. Other columns are not looked at. A lost
executor costs its tasks: files, checkpoint and state are in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.llm import common

_STORE = "spark.sql.streaming.stateStore."
_PROVIDERS = "org.apache.spark.sql.execution.streaming.state."
FILES, ROCKSDB = f"{_PROVIDERS}HDFSBackedStateStoreProvider", f"{_PROVIDERS}RocksDBStateStoreProvider"
#: Kept in files whatever the session has. The stores here are small and many, and each start has its own, so they
#: are let go when a batch is done.
SETTINGS = {f"{_STORE}providerClass": FILES, f"{_STORE}unloadOnCommit": "true"}
RECORD = "batch long, hour long, click_id long, n_rows long, cents long, record string, kind string"
ROW = "kind string, shard int, hour long, click_id long, n long, cents long, late boolean"
STATE = "first long, ring binary, overflow binary"
#: Before every hour: the watermark while there is none.
NEVER = -(2**62)


@dataclass(frozen=True)
class Panes:
    """How rows are dealt into batches and when panes are sent."""

    batches: int = 12
    #: Hours from the end of a pane until it is due, and until it is closed.
    due: int = 2
    closed: int = 72
    #: Shards of a kind, by hour, and hours that a shard's ring holds.
    shards: int = 8
    ring: int = 32


def rows_of(clicks: DataFrame, panes: Panes = Panes()) -> DataFrame:
    """Each click once: click_id, its batch, kind, event hour since 1970 and sum in hundredths."""
    named = clicks.select("click_id", "ts", "arrived_at", "kind", F.col("value").cast("double").alias("value")).where("ts IS NOT NULL AND click_id IS NOT NULL")
    day, own = F.unix_date(F.coalesce("arrived_at", "ts").cast("date")), F.unix_date(F.col("ts").cast("date"))
    turn = F.pmod(day, F.lit(panes.batches))
    delay = F.greatest(F.lit(0), F.crc32(F.col("click_id").cast("string").cast("binary")) % 30 - 23)
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    told = named.select(
        "click_id",
        F.least(F.lit(panes.batches - 1), turn + delay).cast("int").alias("batch"),
        ((own - (day - turn)).cast("long") * 24 + F.hour("ts")).alias("hour"),
        F.coalesce("kind", F.lit("none")).alias("kind"),
        F.when(finite, F.floor(100 * F.col("value") + 0.5)).otherwise(0).alias("cents"),
    )
    return told.groupBy("click_id").agg(F.min(F.struct("batch", "hour", "kind", "cents")).alias("row")).select("click_id", "row.*")


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows by pane; rows of closed panes stay as they are."""
    parts: list[pa.Table] = []
    for batch in batches:
        late = batch.column("late")
        yield batch.filter(late)
        parts.append(_added(pa.Table.from_batches([batch.filter(pc.invert(late))])))
        if len(parts) > 64:
            parts = [_added(pa.concat_tables(parts))]
    if parts:
        yield from _added(pa.concat_tables(parts)).to_batches()


def _added(table: pa.Table) -> pa.Table:
    """One row for each kind, shard and hour, with sums."""
    by = ["kind", "shard", "hour"]
    sums = table.group_by(by).aggregate([("n", "sum"), ("cents", "sum")])
    count = len(sums)
    columns = [*(sums.column(c) for c in by), pa.array([-1] * count, pa.int64()), sums.column("n_sum"), sums.column("cents_sum"), pa.array([False] * count, pa.bool_())]
    return pa.table(columns, names=["kind", "shard", "hour", "click_id", "n", "cents", "late"])


def binned(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole numbers by place, exact beyond the 53 bits of ``bincount``'s weights."""
    high, low = values >> 26, values & (2**26 - 1)
    return (np.bincount(at, high, size).astype(np.int64) << 26) + np.bincount(at, low, size).astype(np.int64)


FIELDS = ("n", "cents", "sent_n", "sent_cents", "sent")


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays of one length in Arrow's stream form."""
    batch = pa.RecordBatch.from_arrays([pa.array(a) for a in arrays.values()], names=list(arrays))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    """The arrays again, writable."""
    table = pa.ipc.open_stream(data).read_all()
    return {name: table.column(name).to_numpy().copy() for name in table.column_names}


def _no_panes(size: int) -> dict[str, np.ndarray]:
    return {f: np.zeros(size, np.int64) for f in FIELDS}


class Store:
    """Panes of one shard: a ring of hours, and those outside of it by hour.

    ``first`` is the first slot of the ring (slot s holds hour ``s * shards + shard``); None before
    there is a watermark, when all panes are outside of it.
    """

    def __init__(self, shard: int, panes: Panes, first: int | None = None, ring: bytes | None = None, overflow: bytes | None = None) -> None:
        self.shard, self.panes, self.first = shard, panes, first
        self.ring = _no_panes(panes.ring) if ring is None else unpacked(ring)
        self.overflow = {"hour": np.zeros(0, np.int64), **_no_panes(0)} if overflow is None else unpacked(overflow)

    def state(self) -> tuple[int | None, bytes, bytes]:
        """What ``applyInPandasWithState`` keeps."""
        return self.first, packed(self.ring), packed(self.overflow)

    def _slot(self, hours: np.ndarray) -> np.ndarray:
        return (hours - self.shard) // self.panes.shards

    def _in_ring(self, hours: np.ndarray) -> np.ndarray:
        if self.first is None:
            return np.zeros(len(hours), bool)
        slot = self._slot(hours)
        return (slot >= self.first) & (slot < self.first + self.panes.ring)

    def add(self, hours: np.ndarray, n: np.ndarray, cents: np.ndarray) -> None:
        """Adds rows to their panes."""
        near = self._in_ring(hours)
        at = self._slot(hours[near]) % self.panes.ring
        self.ring["n"] += binned(at, n[near], self.panes.ring)
        self.ring["cents"] += binned(at, cents[near], self.panes.ring)
        if not near.all():
            far = ~near
            every, place = np.unique(np.r_[self.overflow["hour"], hours[far]], return_inverse=True)
            old, new = place[: len(self.overflow["hour"])], place[len(self.overflow["hour"]) :]
            grown = {"hour": every, **_no_panes(len(every))}
            for f in FIELDS:
                grown[f][old] = self.overflow[f]
            grown["n"] += binned(new, n[far], len(every))
            grown["cents"] += binned(new, cents[far], len(every))
            self.overflow = grown

    def _slices(self, last: int) -> list[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
        """Of ring and overflow: the arrays, the places of panes up to an hour, and their hours."""
        out = [(self.overflow, np.arange(np.searchsorted(self.overflow["hour"], last, "right")), self.overflow["hour"])]
        out = [(arrays, at, hours[at]) for arrays, at, hours in out]
        if self.first is not None:
            count = min(max((last - self.shard) // self.panes.shards + 1 - self.first, 0), self.panes.ring)
            slots = self.first + np.arange(count)
            out.append((self.ring, slots % self.panes.ring, slots * self.panes.shards + self.shard))
        return out

    def send(self, last: int, first_time: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, str]]:
        """(hours, counts, sums, record) of panes up to an hour that are new or have changed since they were sent."""
        out = []
        for arrays, at, hours in self._slices(last):
            sent, n = arrays["sent"][at] > 0, arrays["n"][at]
            fresh, dirty = ~sent & (n > 0), sent & (n > arrays["sent_n"][at])
            out.append((hours[fresh], n[fresh], arrays["cents"][at][fresh], first_time))
            out.append((hours[dirty], arrays["sent_n"][at][dirty], arrays["sent_cents"][at][dirty], "retract"))
            out.append((hours[dirty], n[dirty], arrays["cents"][at][dirty], "replace"))
            now = at[fresh | dirty]
            arrays["sent_n"][now], arrays["sent_cents"][now], arrays["sent"][now] = arrays["n"][now], arrays["cents"][now], 1
        return out

    def forget(self, last: int) -> None:
        """Drops panes up to an hour; the ring moves on to the first open one and takes in what now lies in it."""
        for arrays, at, _ in self._slices(last):
            for f in FIELDS:
                arrays[f][at] = 0
        first = (last - self.shard) // self.panes.shards + 1
        if self.first is None:
            self.first = first
        elif first > self.first:
            left = (self.first + np.arange(min(first - self.first, self.panes.ring))) % self.panes.ring
            for f in FIELDS:
                self.ring[f][left] = 0
            self.first = first
        hours = self.overflow["hour"]
        moved = self._in_ring(hours)
        at = self._slot(hours[moved]) % self.panes.ring
        for f in FIELDS:
            self.ring[f][at] = self.overflow[f][moved]
        stays = ~moved & (hours > last)
        self.overflow = {f: a[stays] for f, a in self.overflow.items()}


class Shards:
    """One batch over all shards; ``mark`` is the watermark's hour, and the last batch sends all that is left."""

    def __init__(self, batch: int, mark: int, last: bool, panes: Panes) -> None:
        self.batch, self.mark, self.last, self.panes = batch, mark, last, panes

    def handle(self, key: tuple[str, int], rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kind, shard = key[0], int(key[1])
        store = Store(shard, self.panes, *(state.get if state.exists else ()))
        for part in rows:
            late = part["late"].to_numpy(bool)
            if late.any():
                own = part[late]
                yield self._records(kind, own["hour"].to_numpy(), own["n"].to_numpy(), own["cents"].to_numpy(), "late", own["click_id"].to_numpy())
            there = part[~late & part["n"].gt(0).to_numpy()]
            store.add(there["hour"].to_numpy(np.int64), there["n"].to_numpy(np.int64), there["cents"].to_numpy(np.int64))
        sent = store.send(self.mark - self.panes.due - 1, "emit")
        if self.mark > NEVER:
            store.forget(self.mark - self.panes.closed - 1)
        if self.last:
            sent += store.send(-NEVER, "final")
        state.update(store.state())
        for hours, n, cents, record in sent:
            if len(hours):
                yield self._records(kind, hours, n, cents, record)

    def _records(self, kind: str, hours: np.ndarray, n: np.ndarray, cents: np.ndarray, record: str, ids: np.ndarray | None = None) -> pd.DataFrame:
        ids = np.full(len(hours), -1, np.int64) if ids is None else ids
        return pd.DataFrame({"batch": self.batch, "hour": hours, "click_id": ids, "n_rows": n, "cents": cents, "record": record, "kind": kind})


@contextmanager
def stateful(spark: SparkSession):
    """Has state kept as ``SETTINGS`` say, while this lasts."""
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def revisions(clicks: DataFrame, panes: Panes = Panes()) -> DataFrame:
    """All records of all batches: batch, hour, click_id (-1 but for ``late``), n_rows, cents, record, kind."""
    spark = clicks.sparkSession
    root = common.scratch(spark, "panes")
    rows_of(clicks, panes).write.partitionBy("batch").parquet(f"{root}/batches")
    dealt = spark.read.schema("click_id long, hour long, kind string, cents long, batch int").parquet(f"{root}/batches")
    tops = {r["batch"]: r["top"] for r in dealt.groupBy("batch").agg(F.max("hour").alias("top")).collect()}  # one row a batch
    by_hour = F.pmod("hour", F.lit(panes.shards)).cast("int")
    ticks = dealt.select("kind", by_hour.alias("shard")).distinct()
    ticks = common.written(ticks.selectExpr("kind", "shard", "0L AS hour", "-1L AS click_id", "0L AS n", "0L AS cents", "false AS late"), "ticks")
    mark = NEVER
    with stateful(spark):
        for batch in range(panes.batches):
            late = F.col("hour") <= F.lit(mark - panes.closed - 1)
            shard = F.when(late, F.pmod("click_id", F.lit(panes.shards)).cast("int")).otherwise(by_hour)
            own = dealt.where(F.col("batch") == batch).select("kind", shard.alias("shard"), "hour", "click_id", F.lit(1).cast("long").alias("n"), "cents", late.alias("late"))
            own.unionByName(ticks).write.mode("append").parquet(f"{root}/fed")
            _run(spark, root, Shards(batch, mark, batch == panes.batches - 1, panes))
            mark = max(mark, tops.get(batch, NEVER))
    return spark.read.schema(RECORD).parquet(f"{root}/sent")


def _run(spark: SparkSession, root: str, processor: Shards) -> None:
    """Feeds what is new in the folder to the query, started on its checkpoint, until it is handled."""
    stream = spark.readStream.schema(ROW).parquet(f"{root}/fed").mapInArrow(combined, ROW)
    sent = stream.groupBy("kind", "shard").applyInPandasWithState(processor.handle, RECORD, STATE, "append", GroupStateTimeout.NoTimeout)
    query = sent.writeStream.format("parquet").option("path", f"{root}/sent").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


#: CRC-32 of a decimal number in DuckDB: bytes are folded in one by one, with eight shifts after each.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(t) + 1), lambda i: [ascii(substr(t, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END))"""


def oracle(panes: Panes = Panes()) -> str:
    """DuckDB SQL of the records over ``clicks``: all batches at once, by windows over the watermarks."""
    n = panes.batches
    return f"""
        WITH r AS (
            SELECT *, click_id::VARCHAR AS t, (coalesce(arrived_at, ts)::DATE - DATE '1970-01-01')::BIGINT AS d FROM clicks WHERE ts IS NOT NULL AND click_id IS NOT NULL
        ), q AS (SELECT *, (d % {n} + {n}) % {n} AS turn FROM r), s AS (
            SELECT click_id, least({n - 1}, turn + greatest(0, {_CRC} % 30 - 23)) AS batch,
                ((ts::DATE - DATE '1970-01-01')::BIGINT - (d - turn)) * 24 + hour(ts) AS hour,
                coalesce(kind, 'none') AS kind, CASE WHEN value IS NULL OR NOT isfinite(value) THEN 0 ELSE floor(100 * value + 0.5)::BIGINT END AS cents
            FROM q
        ), p AS (
            SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY batch, hour, kind, cents) = 1
        ), tops AS (SELECT batch, max(hour) AS top FROM p GROUP BY batch), w AS (
            SELECT b.batch, coalesce(max(tops.top), -4611686018427387904) AS mark FROM range({n}) b(batch) LEFT JOIN tops ON tops.batch < b.batch GROUP BY b.batch
        ), a AS (SELECT p.*, w.mark, hour <= mark - {panes.closed + 1} AS is_late FROM p JOIN w USING (batch)), g AS (
            SELECT kind, hour, batch, count(*) AS n, sum(cents) AS c FROM a WHERE NOT is_late GROUP BY ALL
        ), due AS (
            SELECT g.kind, g.hour, min(w.batch) AS due FROM (SELECT kind, hour, min(batch) AS came FROM g GROUP BY ALL) g
            JOIN w ON w.batch >= g.came AND g.hour <= w.mark - {panes.due + 1} GROUP BY ALL
        ), m AS (
            SELECT kind, hour, greatest(batch, coalesce(due, {n})) AS moment, sum(n) AS n, sum(c) AS c FROM g LEFT JOIN due USING (kind, hour) GROUP BY ALL
        ), k AS (
            SELECT kind, hour, moment, sum(n) OVER o AS n, sum(c) OVER o AS c, lag(moment) OVER (PARTITION BY kind, hour ORDER BY moment) AS earlier,
                sum(n) OVER o - n AS old_n, sum(c) OVER o - c AS old_c
            FROM m WINDOW o AS (PARTITION BY kind, hour ORDER BY moment)
        ), u AS (
            SELECT batch, hour, click_id, 1 AS n_rows, cents, 'late' AS record, kind FROM a WHERE is_late
            UNION ALL SELECT least(moment, {n - 1}), hour, -1, n, c, CASE WHEN moment = {n} THEN 'final' WHEN earlier IS NULL THEN 'emit' ELSE 'replace' END, kind FROM k
            UNION ALL SELECT moment, hour, -1, old_n, old_c, 'retract', kind FROM k WHERE earlier IS NOT NULL
        )
        SELECT batch::BIGINT AS batch, hour::BIGINT AS hour, click_id::BIGINT AS click_id, n_rows::BIGINT AS n_rows, cents::BIGINT AS cents, record, kind FROM u"""
