"""State of keys across micro-batches: idle sessions by timers, retries up to dead letters, and totals of cycles.

All run on ``transformWithState`` or on the engine's own figures, start again from their checkpoint, and
write each micro-batch once: a batch that is run again puts the same rows in place of its own.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery, StreamingQueryListener

_STORE = "spark.sql.streaming.stateStore."
#: State in RocksDB, as ``transformWithState`` asks, whose local files are given back after each batch.
SETTINGS = {
    f"{_STORE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}unloadOnCommit": "true",
    f"{_STORE}rocksdb.allowFAllocate": "false",
    f"{_STORE}rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def settings(spark: SparkSession):
    """Has ``SETTINGS`` hold while this lasts."""
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def once(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Handles what is there and ends; ``write`` gets each micro-batch with its number."""
    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def numbered(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch to a folder of its number."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


class Idle(StatefulProcessor):
    """Keeps the last access of a session, and sends it when it has been idle for too long or is lost."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "last bigint, number bigint, terminal boolean, timer bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, number, terminal, timer = self.session.get() if self.session.exists() else (None, None, False, None)
        lost = False
        for part in rows:
            for at, own, done, gone in zip(part["at"].tolist(), part["number"].tolist(), part["terminal"].tolist(), part["lost"].tolist(), strict=True):
                last = at if last is None else max(last, at)
                if number is None or own >= number:
                    number, terminal = own, bool(done)
                lost = lost or bool(gone)
        if timer is not None:
            self.handle.deleteTimer(timer)
            timer = None
        if lost:
            self.session.clear()
            yield pd.DataFrame({"session": [key[0]], "last": [last], "reason": ["lost"]})
            return
        if terminal:  # a running session stays, however idle
            timer = last // 1000 + self.ttl_ms + 1
            self.handle.registerTimer(timer)
        self.session.update((last, number, terminal, timer))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.session.exists():
            last = self.session.get()[0]
            self.session.clear()
            yield pd.DataFrame({"session": [key[0]], "last": [last], "reason": ["ttl_expired"]})

    def close(self) -> None:
        pass


def idle_sessions(accesses: DataFrame, key: str, time: str, number: Column, terminal: Column, lost: Column, ttl_seconds: float, late: str = "0 seconds") -> DataFrame:
    """Sessions (session, last access in microseconds, reason) as they are removed from a stream of accesses.

    Of a session the access of the greatest ``number`` says whether it is terminal. A terminal one is
    removed once the watermark is more than the limit past its last access, a lost one at once; a later
    access begins it anew. Accesses without a key or time are passed over.
    """
    kind = accesses.schema[key].dataType.simpleString()
    own = accesses.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    flag = lambda c: F.coalesce(c, F.lit(False))
    told = own.select(F.col(key).alias("session"), F.col(time).alias("_time"), F.unix_micros(F.col(time)).alias("at"), number.cast("long").alias("number"), flag(terminal).alias("terminal"), flag(lost).alias("lost"))
    return told.groupBy("session").transformWithStateInPandas(Idle(int(ttl_seconds * 1000)), f"session {kind}, last long, reason string", "Update", "EventTime")


class Attempts(StatefulProcessor):
    """Counts the failures of a key in a row, and gives it up at the last one allowed."""

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: Any) -> None:
        self.kept = handle.getValueState("attempts", "failed int, dead boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        failed, dead = self.kept.get() if self.kept.exists() else (0, False)
        tries = pd.concat(list(rows)).sort_values("attempt", kind="stable")
        out = []
        for attempt, ok in zip(tries["attempt"].tolist(), tries["ok"].tolist(), strict=True):
            if dead:
                break  # nothing is tried after it was given up
            failed = 0 if ok else failed + 1
            dead = failed >= self.most
            out.append((key[0], attempt, failed, "done" if ok else "dead" if dead else "again"))
        self.kept.update((failed, dead))
        yield pd.DataFrame(out, columns=["item", "attempt", "failed", "outcome"])

    def close(self) -> None:
        pass


def retried(tries: DataFrame, key: str, attempt: Column, ok: Column, most: int) -> DataFrame:
    """Tries (item, attempt, failed in a row, outcome: done, again or dead) of a stream, with what earlier micro-batches had of each item.

    Tries of one micro-batch go in order of ``attempt``. A dead item is never tried again, so it is marked once.
    """
    kind = tries.schema[key].dataType.simpleString()
    own = tries.where(F.col(key).isNotNull()).select(F.col(key).alias("item"), attempt.cast("long").alias("attempt"), F.coalesce(ok, F.lit(False)).alias("ok"))
    return own.groupBy("item").transformWithStateInPandas(Attempts(most), f"item {kind}, attempt long, failed int, outcome string", "Update", "None")


def parted(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch of outcomes to two folders of its number: ``dead`` letters and ``live`` ones. It is computed once for both."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("what", F.when(F.col("outcome") == "dead", "dead").otherwise("live"))
        batch.write.mode("overwrite").partitionBy("what").parquet(f"{path}/batch={number}")

    return write


class Cycles(StreamingQueryListener):
    """Running totals over the micro-batches of a query, each a cycle, from the figures that the engine observes."""

    def __init__(self, name: str) -> None:
        self.name, self.rows, self.ended = name, [], set()

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802
        figures = event.progress.observedMetrics.get(self.name)
        if figures is not None and figures["cycle"] is not None:
            total, seconds = self.rows[-1][1:3] if self.rows else (0, 0.0)
            total, seconds = total + figures["n"], seconds + figures["seconds"]
            self.rows.append((figures["cycle"], total, seconds, seconds / total if total else None))

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802
        self.ended.add(str(event.runId))


def observed_cycles(stream: DataFrame, cycle: str, seconds: Column, path: str, checkpoint: str, most_wait: float = 60) -> DataFrame:
    """Handles what is there of a stream, micro-batch by micro-batch, and gives totals after each (cycle, total, seconds, average).

    The rows go to ``path`` on the way; their figures come from the engine, so nothing is read again and no window
    runs over all cycles. ``cycle``: a column with one value in a micro-batch.
    """
    spark = stream.sparkSession
    listener = Cycles("cycle")
    spark.streams.addListener(listener)
    try:
        seen = stream.observe("cycle", F.max(cycle).alias("cycle"), F.count("*").alias("n"), F.coalesce(F.sum(seconds), F.lit(0.0)).alias("seconds"))
        query = seen.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        end = time.monotonic() + most_wait
        while str(query.runId) not in listener.ended and time.monotonic() < end:  # events come in order, the last one is its end
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(listener)
    return spark.createDataFrame(listener.rows, f"{cycle} {stream.schema[cycle].dataType.simpleString()}, total long, seconds double, average double")
