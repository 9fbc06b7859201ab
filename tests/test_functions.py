"""Globs, query text and log lines."""

import fnmatch
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import logs, patterns


@given(st.text("ab/*?.", max_size=6), st.text("ab/.", max_size=6))
def test_glob_is_fnmatch(pattern, path):
    assert bool(re.match(patterns.glob_regex(pattern), path)) == fnmatch.fnmatchcase(path, pattern)


@pytest.mark.parametrize(("pattern", "path", "fits"), [("a[!b]c", "axc", True), ("a[!b]c", "abc", False), ("a[b", "a[b", True), ("[a-c]*.py", "b/x.py", True), ("a[^b]", "a^", True)])
def test_glob_brackets(pattern, path, fits):
    assert bool(re.match(patterns.glob_regex(pattern), path)) is fits


def test_literal_prefix():
    assert patterns.literal_prefix("src/pkg/*.py") == "src/pkg/"
    assert patterns.literal_prefix("src/pkg") == "src/pkg"
    assert patterns.literal_prefix("*.py") == ""


def test_path_without_glob_is_a_prefix(spark):
    frame = spark.createDataFrame([("src",), ("src/a.py",), ("srcs/a.py",)], "p string")
    assert [r.p for r in frame.where(patterns.path_matches(F.col("p"), "src/")).collect()] == ["src", "src/a.py"]


def test_query_text():
    assert patterns.normalise_query("  a/b foo:bar name:x c-d ") == "a b foo bar name:x c d"
    assert patterns.normalise_query(" / - ") is None
    assert patterns.prefix_terms("Größe-x") == ["größe", "x"]


LINES = [
    ("2024-01-02 03:04:05 | ERROR | 12 | broken", ("ERROR", 10, "broken")),
    ("2024-01-02 03:04:05 | info | fine", ("info", 4, "fine")),
    ("2024-01-02 03:04:05 - WARNING - look - out", ("WARNING", 6, "look - out")),
    ("2024-01-02 03:04:05 [DEBUG] deep", ("DEBUG", 2, "2024-01-02 03:04:05 [DEBUG] deep")),
    ("2024-01-02 03:04:05 | ERROR | -3 | low", ("ERROR", 0, "low")),
    ("2024-01-02 03:04:05 | INFO | high | hello | you", ("INFO", 4, "hello | you")),
    ("2024-01-02 03:04:05 | TRACE | x", ("TRACE", 4, "x")),
    ("2024-01-02 03:04:05 what a day", ("UNKNOWN", 4, "2024-01-02 03:04:05 what a day")),
    ("no stamp at all", ("UNKNOWN", 4, "no stamp at all")),
    ("2024-13-02 03:04:05 | INFO | bad month", ("UNKNOWN", 4, "2024-13-02 03:04:05 | INFO | bad month")),
]


def test_log_lines(spark):
    rows = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(LINES)], "i int, line string").select("i", logs.parse_line(F.col("line")).alias("p")).orderBy("i").collect()
    assert [(r.p.level, r.p.importance, r.p.message) for r in rows] == [e for _, e in LINES]
    assert [r.p.stamp is not None for r in rows] == [True] * 8 + [False] * 2
    assert spark.createDataFrame([(" ",), (None,)], "line string").select(logs.parse_line(F.col("line")).alias("p")).where("p IS NOT NULL").count() == 0


def test_timing(spark):
    frame = spark.createDataFrame([("x [TIMING]  load\tduration=1.25s",), ("none",), ("[timing] load duration=1s",), ("a | b | c | [TIMING] q duration=2s",)], "line string")
    assert [(r.t and (r.t.operation, r.t.seconds)) for r in frame.select(logs.timing(F.col("line")).alias("t")).collect()] == [("load", 1.25), None, None, ("q", 2.0)]
