"""Keyed streams: restarts, batches that run again, and sessions that come back."""

from pathlib import Path

from pyspark.sql import functions as F

from lodestone.streaming import keyed

TRIES = "item long, attempt long, ok boolean"


def feed(spark, rows, schema, folder):
    frame = spark.createDataFrame(rows, schema)
    frame.coalesce(1).write.mode("append").parquet(str(folder / "fed"))
    return spark.readStream.schema(frame.schema).parquet(str(folder / "fed"))


def outcomes(spark, folder):
    read = spark.read.schema("item long, attempt long, failed int, outcome string").parquet(str(folder / "out"))
    return sorted(tuple(r) for r in read.select("item", "attempt", "failed", "outcome").collect())


def test_a_batch_that_runs_again_marks_nothing_twice(spark, tmp_path):
    expected = [(1, 1, 1, "again"), (1, 2, 2, "dead"), (2, 1, 1, "again"), (2, 2, 0, "done"), (2, 3, 1, "again")]

    def handle(rows):
        stream = feed(spark, rows, TRIES, tmp_path)
        tried = keyed.retried(stream, "item", F.col("attempt"), F.col("ok"), 2)
        keyed.once(tried, str(tmp_path / "checkpoint"), keyed.parted(str(tmp_path / "out")))

    with keyed.settings(spark):
        handle([(1, 1, False), (2, 1, False), (None, 1, False)])
        handle([(1, 2, None), (1, 3, False), (2, 3, False), (2, 2, True)])
        assert outcomes(spark, tmp_path) == expected
        last = max((p for p in (tmp_path / "checkpoint/commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
        for path in (last, last.with_name(f".{last.name}.crc")):
            path.unlink(missing_ok=True)  # as if the driver had been lost before it could commit
        handle([(1, 4, True)])
    assert outcomes(spark, tmp_path) == expected
    dead = spark.read.parquet(str(tmp_path / "out")).where("what = 'dead'").collect()
    assert [(r.item, r.attempt) for r in dead] == [(1, 2)]


def test_sessions_end_and_begin_anew(spark, tmp_path):
    found = []

    def handle(rows):
        stream = feed(spark, [(u, n, None if t is None else f"2024-01-01 {t}") for u, n, t in rows], "user long, number long, at string", tmp_path).withColumn("at", F.to_timestamp("at"))
        gone = keyed.idle_sessions(stream, "user", "at", F.col("number"), F.col("number") % 2 == 0, F.col("user") == 9, 600)
        keyed.once(gone, str(tmp_path / "checkpoint"), keyed.numbered(str(tmp_path / "gone")))
        rows = spark.read.schema("session long, last long, reason string").parquet(str(tmp_path / "gone")).select("session", "reason").collect()
        found.append(sorted(tuple(r) for r in rows))

    with keyed.settings(spark):
        handle([(1, 2, "10:00:00"), (2, 1, "10:00:00"), (9, 1, "10:00:01"), (None, 2, "10:00:00"), (3, 2, None)])
        handle([(4, 2, "10:10:00")])  # exactly the limit after session 1's last access
        handle([(4, 4, "10:10:01")])
        handle([(1, 5, "10:11:00"), (2, 2, "10:11:00")])  # 1 begins anew and runs, 2 ends
        handle([(5, 1, "11:00:00")])
    assert found[0] == [(9, "lost")] and found[1] == found[0]
    assert found[2] == found[3] == [(1, "ttl_expired"), (9, "lost")]
    assert found[4] == [(1, "ttl_expired"), (2, "ttl_expired"), (4, "ttl_expired"), (9, "lost")]


def test_totals_of_cycles(spark, tmp_path):
    for cycle in (1, 2):
        stream = feed(spark, [(cycle, 0.5 * i) for i in range(cycle * 2)], "cycle long, spent double", tmp_path)
    stream = stream.sparkSession.readStream.schema("cycle long, spent double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "fed"))
    found = keyed.observed_cycles(stream, "cycle", F.col("spent"), str(tmp_path / "rows"), str(tmp_path / "checkpoint"))
    assert [tuple(r) for r in found.orderBy("cycle").collect()] == [(1, 2, 0.5, 0.25), (2, 6, 3.5, 3.5 / 6)]
    assert Path(tmp_path / "rows").is_dir()
