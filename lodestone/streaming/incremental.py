"""Change detection, queues and running totals, in batches and as streams."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from lodestone.operators.relational import CHANGE_TOLERANCE
from lodestone.sources.tables import upsert

#: Fixed value: the most seconds between two looks.
MOST_INTERVAL = 3600


def delta(snapshot: DataFrame, current: DataFrame, key: str, time: str, tolerance: float = CHANGE_TOLERANCE) -> DataFrame:
    """Keys that are new, changed or deleted against a snapshot."""
    a = snapshot.select(key, F.col(time).alias("before"))
    b = current.select(key, F.col(time).alias("after"))
    both = a.join(b, key, "full_outer")
    state = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "deleted").when(F.abs(F.col("after") - F.col("before")) > tolerance, "changed")
    return both.withColumn("state", state).where("state IS NOT NULL")


def queue(pending: DataFrame, project: str, fresh: Sequence[Column], batch: int) -> DataFrame:
    """The first ``batch`` pending rows of each project, by an order that begins with the freshest."""
    return pending.withColumn("place", F.row_number().over(Window.partitionBy(project).orderBy(*fresh))).where(F.col("place") <= batch)


def next_interval(base: int, work: int, streak: int, most: int = MOST_INTERVAL) -> tuple[int, int]:
    """Seconds to the next look and the new streak of idle looks.

    Work resets both; each idle look doubles the base (1 second at least) once more, up to ``most``.
    """
    base = max(int(base), 1)
    if work > 0:
        return base, 0
    streak += 1
    return min(base << min(streak, most.bit_length()), most), streak


def poll(look: Callable[[], int], base: int, looks: int | None = None, most: int = MOST_INTERVAL, sleep: Callable[[float], None] = time.sleep) -> list[int]:
    """Calls ``look`` (which returns how much work it found) over and over, with the pauses of ``next_interval``.

    Ends after so many looks, if a number is given, and returns the pauses.
    """
    pauses, streak = [], 0
    while looks is None or len(pauses) < looks:
        pause, streak = next_interval(base, look(), streak, most)
        pauses = [*pauses, pause] if looks is not None else []
        if looks is None or len(pauses) < looks:
            sleep(pause)
    return pauses


def cycle_stats(cycles: DataFrame, cycle: str, processed: str, seconds: str) -> DataFrame:
    """Running totals and the average time per item after each cycle."""
    w = Window.orderBy(cycle).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total, time = F.sum(processed).over(w), F.sum(seconds).over(w)
    return cycles.select(cycle, total.alias("total"), F.round(time, 6).alias("seconds"), F.round(F.when(total > 0, time / total), 6).alias("average"))


def rejected(rows: DataFrame, attempts: str, most: int, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that go on, and those given up after ``most`` attempts."""
    bad = ~F.coalesce(ok, F.lit(False)) & (F.col(attempts) >= most)
    return rows.where(~bad), rows.where(bad)


def signatures(files: DataFrame, project: str, time: str, size: str) -> DataFrame:
    """Count, latest time and total size of each project's files."""
    return files.groupBy(project).agg(F.count("*").alias("n"), F.max(time).alias("latest"), F.sum(size).alias("total_size"))


def signature_changes(before: DataFrame, after: DataFrame, project: str) -> DataFrame:
    """Projects whose signature is new, gone or different."""
    b = before.select(project, F.struct("n", "latest", "total_size").alias("old"))
    a = after.select(project, F.struct("n", "latest", "total_size").alias("new"))
    both = a.join(b, project, "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(project, F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"))


def expired(sessions: DataFrame, last_access: Column, now: Column, ttl_seconds: float, terminal: Column, lost: Column) -> DataFrame:
    """Sessions to remove: terminal ones idle for longer than the limit, and lost ones; running ones stay."""
    idle = now.cast("timestamp").cast("double") - last_access.cast("timestamp").cast("double") > ttl_seconds
    return sessions.where(F.coalesce(lost, F.lit(False)) | (F.coalesce(terminal, F.lit(False)) & idle))


def reconcile(indexed: DataFrame, present: DataFrame, key: str, identity: str) -> DataFrame:
    """Start-up findings: keys that are only indexed (orphan), only present (missing), or whose identity is used twice."""
    orphan = indexed.join(present, key, "left_anti").select(F.col(key).cast("string").alias("key"), F.lit("orphan").alias("finding"))
    missing = present.join(indexed, key, "left_anti").select(F.col(key).cast("string").alias("key"), F.lit("missing").alias("finding"))
    twice = indexed.groupBy(identity).count().where("count > 1").select(F.col(identity).cast("string").alias("key"), F.lit("duplicate").alias("finding"))
    return orphan.unionByName(missing).unionByName(twice)


def follow(spark: SparkSession, folder: str, schema, apply: Callable[[DataFrame, int], None], checkpoint: str, files_at_once: int = 100) -> StreamingQuery:
    """Feeds files of a folder, as they come, to ``apply`` in micro-batches; handles what is there and stops."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot_writer(folder: str, keys: Sequence[str], version: str) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps a table of the latest row per key, a new version of it for each batch.

    A batch that is run again writes the same version from the one before, so retries do no harm.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = upsert(batch.limit(0), batch, keys, version)
        merged = upsert(spark.read.parquet(f"{folder}/{number - 1}"), latest, keys, version) if number else latest
        merged.write.mode("overwrite").parquet(f"{folder}/{number}")

    return apply


def windowed_counts(stream: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and kind, with a watermark for late rows; works on batches as well."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def closed_sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key that end after a gap without events; on a stream each is sent once it can no longer grow."""
    sessions = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("n"))
    return sessions.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
