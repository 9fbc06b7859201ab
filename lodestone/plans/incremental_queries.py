"""Driver queries of change detection, queues and running totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.plans.catalog import register
from lodestone.sources import tables
from lodestone.sources.lineage import scratch
from lodestone.streaming import incremental, keyed


def _snapshots(spark, sf_dir):
    orders = tables.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("t"))
    before = orders.where("key % 13 <> 0")
    after = orders.where("key % 17 <> 0").withColumn("t", F.when(F.col("key") % 5 == 0, F.col("t") + 1).otherwise(F.col("t") + 0.05))
    return before, after


@register("file_delta", """WITH a AS (SELECT o_orderkey AS key, o_totalprice AS t FROM orders WHERE o_orderkey % 13 <> 0), b AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice + 0.05 END AS t FROM orders WHERE o_orderkey % 17 <> 0)
    SELECT key, state FROM (SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'new' WHEN b.key IS NULL THEN 'deleted' WHEN abs(b.t - a.t) > 0.1 THEN 'changed' END AS state FROM a FULL JOIN b ON a.key = b.key) WHERE state IS NOT NULL""")
def file_delta(spark, sf_dir):
    return incremental.delta(*_snapshots(spark, sf_dir), "key", "t").select("key", "state")


@register("index_queue", "SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'P') WHERE place <= 2")
def index_queue(spark, sf_dir):
    pending = tables.read(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return incremental.queue(pending, "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey").asc()], 2).select("o_custkey", "o_orderkey", "place")


@register("cycle_stats", """WITH d AS (SELECT ts::DATE::VARCHAR AS day, count(*) AS n, sum(round(value * 100)::BIGINT) AS s FROM events GROUP BY 1)
    SELECT day, sum(n) OVER w AS total, round(sum(s) OVER w / 100.0, 6) AS seconds, round(sum(s) OVER w / 100.0 / sum(n) OVER w, 6) AS average FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def cycle_stats(spark, sf_dir):
    days = tables.read(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), (F.sum(F.round(F.col("value") * 100).cast("long")) / 100).alias("s"))
    return incremental.cycle_stats(days, "day", "n", "s")


@register("dead_letters", "SELECT event_id, user_id FROM events WHERE event_type = 'error' AND user_id % 5 >= 3")
def dead_letters(spark, sf_dir):
    events = tables.read(spark, sf_dir, "events").withColumn("attempts", F.col("user_id") % 5)
    return incremental.rejected(events, "attempts", 3, F.col("event_type") != "error")[1].select("event_id", "user_id")


@register("signature_changed", """WITH a AS (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS m, sum(o_orderkey) AS s FROM orders WHERE o_orderkey % 10 <> 0 OR o_custkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS m, sum(o_orderkey) AS s FROM orders GROUP BY 1)
    SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE (a.n, a.m, a.s) IS DISTINCT FROM (b.n, b.m, b.s)""")
def signature_changed(spark, sf_dir):
    orders = tables.read(spark, sf_dir, "orders")
    before = incremental.signatures(orders.where("o_orderkey % 10 <> 0 OR o_custkey % 2 = 0"), "o_custkey", "o_orderkey", "o_orderkey")
    return incremental.signature_changes(before, incremental.signatures(orders, "o_custkey", "o_orderkey", "o_orderkey"), "o_custkey")


@register("idle_expired", """WITH s AS (SELECT user_id, max(ts) AS last, max(event_id) AS e FROM events GROUP BY 1) SELECT user_id FROM s WHERE user_id % 29 = 0 OR (e % 2 = 0 AND epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(last) > 43200)""")
def idle_expired(spark, sf_dir):
    sessions = tables.read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.max("event_id").alias("e"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return incremental.expired(sessions, F.col("last"), now, 43_200, F.col("e") % 2 == 0, F.col("user_id") % 29 == 0).select("user_id")


@register("startup_findings", """SELECT doc_id::VARCHAR AS key, 'orphan' AS finding FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) UNION ALL
    SELECT doc_id::VARCHAR, 'missing' FROM documents WHERE doc_id % 3 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT (doc_id // 4)::VARCHAR, 'duplicate' FROM labels GROUP BY doc_id // 4 HAVING count(*) > 1""")
def startup_findings(spark, sf_dir):
    indexed = tables.read(spark, sf_dir, "labels").withColumn("identity", F.floor(F.col("doc_id") / 4).cast("long"))
    present = tables.read(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select("doc_id")
    return incremental.reconcile(indexed, present, "doc_id", "identity")


@register("hourly_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_counts(spark, sf_dir):
    found = incremental.windowed_counts(tables.read(spark, sf_dir, "events"), "ts", "event_type")
    return found.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@register("closed_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def closed_sessions(spark, sf_dir):
    found = incremental.closed_sessions(tables.read(spark, sf_dir, "events"), "user_id", "ts", "6 hours")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return found.select("user_id", shown("start"), shown("end"), "n")


def _fed(spark, parts, handle):
    """Writes parts of a table one after another to a folder that a stream reads, and has each handled by a query that starts anew."""
    root = scratch(spark, "stream")
    with keyed.settings(spark):
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(f"{root}/fed")
            handle(spark.readStream.schema(part.schema).parquet(f"{root}/fed"), root)
    return root


@register("idle_expired_stream", """WITH s AS (SELECT user_id, max(ts) AS last, max(event_id) AS e FROM events GROUP BY 1) SELECT user_id, CASE WHEN user_id % 29 = 0 THEN 'lost' ELSE 'ttl_expired' END AS reason FROM s
    WHERE user_id % 29 = 0 OR (e % 2 = 0 AND epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(last) > 43200)""")
def idle_expired_stream(spark, sf_dir):
    """The sessions of ``idle_expired`` from a stream of accesses in four parts, of which the last only tells the time."""
    events = tables.read(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    day = F.dayofmonth("ts")
    parts = [events.where(day <= 10), events.where(day.between(11, 20)), events.where(day > 20)]
    parts.append(spark.sql("SELECT -1L AS user_id, 1L AS event_id, timestamp'2024-01-31 00:00:00' AS ts"))

    def handle(stream, root):
        number = F.col("event_id")
        gone = keyed.idle_sessions(stream, "user_id", "ts", number, (number % 2 == 0) & (F.col("user_id") >= 0), F.col("user_id") % 29 == 0, 43_200)
        keyed.once(gone, f"{root}/checkpoint", keyed.numbered(f"{root}/gone"))

    root = _fed(spark, parts, handle)
    gone = spark.read.schema("session long, last long, reason string").parquet(f"{root}/gone").groupBy("session").agg(F.max(F.struct("last", "reason")).alias("g"))
    latest = events.groupBy("user_id").agg(F.max(F.unix_micros("ts")).alias("last"))
    return gone.join(latest, (F.col("session") == F.col("user_id")) & (F.col("g.last") == F.col("last"))).select("user_id", F.col("g.reason").alias("reason"))


@register("dead_letters_stream", """WITH t AS (SELECT user_id, event_id, event_type <> 'error' AS ok, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events),
    f AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY user_id, run ORDER BY event_id) AS failed FROM t), d AS (SELECT user_id, min(event_id) AS dead FROM f WHERE failed >= 3 GROUP BY 1)
    SELECT user_id AS item, event_id AS attempt, failed, CASE WHEN ok THEN 'done' WHEN failed >= 3 THEN 'dead' ELSE 'again' END AS outcome FROM f LEFT JOIN d USING (user_id) WHERE dead IS NULL OR event_id <= dead""")
def dead_letters_stream(spark, sf_dir):
    """Errors as failed tries, in three parts; three failures in a row make a dead letter."""
    events = tables.read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")

    def handle(stream, root):
        outcomes = keyed.retried(stream, "user_id", F.col("event_id"), F.col("event_type") != "error", 3)
        keyed.once(outcomes, f"{root}/checkpoint", keyed.parted(f"{root}/outcomes"))

    bounds = events.agg(F.max("event_id")).first()[0] or 0
    third = F.floor(F.col("event_id") * 3 / F.lit(bounds + 1))
    root = _fed(spark, [events.where(third == i) for i in range(3)], handle)
    return spark.read.schema("item long, attempt long, failed int, outcome string").parquet(f"{root}/outcomes").select("item", "attempt", "failed", "outcome")


@register("cycle_stats_stream", """WITH d AS (SELECT (day(ts) - 1) // 6 AS cycle, count(*) AS n, sum(round(value * 100)::BIGINT) AS s FROM events GROUP BY 1)
    SELECT cycle, sum(n) OVER w AS total, round(sum(s) OVER w / 100.0, 6) AS seconds, round(sum(s) OVER w / 100.0 / sum(n) OVER w, 6) AS average FROM d WINDOW w AS (ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def cycle_stats_stream(spark, sf_dir):
    """A micro-batch for each six days, with running totals from the figures that the engine observes."""
    events = tables.read(spark, sf_dir, "events").select(F.floor((F.dayofmonth("ts") - 1) / 6).cast("long").alias("cycle"), (F.round(F.col("value") * 100).cast("long") / 100).alias("spent"))
    root = scratch(spark, "cycles")
    for cycle in range(6):
        part = events.where(F.col("cycle") == cycle)
        if not part.isEmpty():
            part.coalesce(1).write.mode("append").parquet(f"{root}/fed")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/fed")
    found = keyed.observed_cycles(stream, "cycle", F.col("spent"), f"{root}/rows", f"{root}/checkpoint")
    return found.select("cycle", "total", F.round("seconds", 6).alias("seconds"), F.round("average", 6).alias("average"))
