"""Helpers that the operators of this subpackage share.

Scratch tables and checkpoints go to the folder named by ``spark.checkpoint.dir``; where that is
unset and the session runs on one machine (tests, a laptop) a temporary folder is used instead, and
on a cluster the job fails.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.lineage import scratch, shared_folder

__all__ = ["ARROW_BATCHES", "Numbers", "only", "release", "scratch", "shared_folder", "ship", "table", "text_slices", "utf8", "written"]
WORD_SEPARATORS = " \t\n\x0b\x0c\r"
#: Texts that a Python worker handles at once, by rows and by bytes of text.
SLICE_ROWS, SLICE_BYTES = 1_000, 4 << 20

#: Arrow batches sent to Python workers, where the session sets none.
ARROW_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables, read by Spark only, so that any file system will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers of this application import the package, and bounds the batches they are sent."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        environment["PYTHONPATH"] = f"{root}:{known}" if known else root
    for key, value in ARROW_BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded rows and bytes; one long text is a batch of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for row, size in enumerate(sizes):
            if row > start and (row - start >= SLICE_ROWS or held + size > SLICE_BYTES):
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)
    release()


def release() -> None:
    """Gives memory that is no longer used back to the system, since workers wait for further tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null gives no bytes."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, so that others with clashing names never meet them."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


class Numbers(dict):
    """Numbers for distinct strings in order of first use; ``fresh`` gathers those that are new."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, part: str) -> int:
        number = self[part] = len(self)
        self.fresh.append(part)
        return number

    def of(self, parts: Iterable[str], count: int) -> np.ndarray:
        """The number of each string."""
        return np.fromiter(map(self.__getitem__, parts), np.int64, count)
