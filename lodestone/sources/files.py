"""Directories, manifests, line streams and logs as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.patterns import glob_regex

MOST_BYTES = 5 << 20
LINE_BREAK = r"\r\n|\n|\r"


@dataclass(frozen=True)
class ScanRules:
    """What a directory scan passes over, in order of precedence.

    Exceptions win over everything but virtual environments; then allowed files of virtual
    environments; then path parts and patterns that are ignored; hidden directories; suffixes.
    """

    suffixes: tuple[str, ...] = (".py", ".json", ".yaml", ".yml", ".md", ".txt")
    ignored_parts: tuple[str, ...] = ("__pycache__", "node_modules", "build", "dist")
    ignored_globs: tuple[str, ...] = ()
    exceptions: tuple[str, ...] = ()
    exception_globs: tuple[str, ...] = ()
    environment_parts: tuple[str, ...] = (".venv", "venv", "site-packages")
    allowed_in_environment: tuple[str, ...] = ()


def _any(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def scan_verdict(path: Column, rules: ScanRules) -> Column:
    """``keep`` or the reason why a relative path is passed over."""
    parts = F.split(path, "/")
    in_environment = _any([F.array_contains(parts, p) for p in rules.environment_parts])
    matches = lambda globs: _any([path.rlike(glob_regex(g)) for g in globs])
    hidden = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.startswith("."))
    return (
        F.when(path.isin(list(rules.exceptions)) if rules.exceptions else F.lit(False), "keep")
        .when(matches(rules.exception_globs) & ~in_environment, "keep")
        .when(in_environment & (path.isin(list(rules.allowed_in_environment)) if rules.allowed_in_environment else F.lit(False)), "keep")
        .when(in_environment, "environment")
        .when(_any([F.array_contains(parts, p) for p in rules.ignored_parts]), "ignored part")
        .when(matches(rules.ignored_globs), "ignored pattern")
        .when(hidden, "hidden")
        .when(~_any([path.endswith(s) for s in rules.suffixes]), "suffix")
        .otherwise("keep")
    )


def scan_directory(spark: SparkSession, root: str, rules: ScanRules = ScanRules()) -> DataFrame:
    """Files below a root (path, relative_path, modified, size, content) that the rules keep.

    Listing and reading are Spark's, so any file system will do; ``content`` is read only if used.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    relative = F.element_at(F.split(F.col("path"), "/" + plain.replace(".", r"\.") + "/", 2), 2)
    named = files.select("path", relative.alias("relative_path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")
    return named.where(scan_verdict(F.col("relative_path"), rules) == "keep")


def manifest(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines, characters, checksum and whether a text begins with a docstring."""
    body = F.col(text)
    return df.select(
        key,
        F.size(F.split(body, "\n", -1)).cast("long").alias("lines"),
        F.length(body).cast("long").alias("chars"),
        F.sha2(body.cast("binary"), 256).alias("checksum"),
        body.rlike(r"^\s*(\"\"\"|''')").alias("has_docstring"),
    )


def lines(df: DataFrame, key: str, text: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Numbered lines (from 1) of texts; a NUL ends a text, and longer ones than ``most_bytes`` have none."""
    body = F.element_at(F.split(F.col(text), "\x00", 2), 1)
    usable = df.where(F.octet_length(F.col(text)) <= most_bytes)
    return usable.select(key, F.posexplode(F.split(body, LINE_BREAK, -1)).alias("line", "content")).withColumn("line", F.col("line") + 1)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain and gzip logs with their file."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def tail(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The last ``n`` rows by an order given from last to first."""
    return df.orderBy(*order).limit(n)
