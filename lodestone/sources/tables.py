"""Reading, writing and rewriting tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; columns and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def select_rows(
    df: DataFrame,
    where: Mapping[str, Any] | None = None,
    columns: Sequence[str] | None = None,
    order_by: Sequence[str] = (),
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Equality filters, projection, order (``-name``: descending), limit and offset.

    A value of ``None`` asks for null, a list for any of its values, ``False`` for false or null.
    """
    for name, value in (where or {}).items():
        if value is None:
            df = df.where(F.col(name).isNull())
        elif value is False:
            df = df.where(~F.coalesce(F.col(name), F.lit(False)))
        elif isinstance(value, list | tuple | set):
            df = df.where(F.col(name).isin(list(value)))
        else:
            df = df.where(F.col(name) == F.lit(value))
    if order_by:
        df = df.orderBy(*[F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order_by])
    if offset:
        df = df.offset(offset)
    if limit is not None:
        df = df.limit(limit)
    return df.select(*columns) if columns else df


def run_sql(spark: SparkSession, views: Mapping[str, DataFrame], statement: str, args: Mapping[str, Any] | None = None) -> DataFrame:
    """A parameterised statement over the given views; only reading statements are taken."""
    first = statement.lstrip().split(None, 1)[0].lower() if statement.strip() else ""
    if first not in {"select", "with", "values"}:
        raise ValueError("only SELECT, WITH and VALUES statements are run")
    return spark.sql(statement, args=dict(args or {}), **dict(views))


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by ``order`` (which should end in something unique)."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], version: str | None = None) -> DataFrame:
    """Rows of ``base`` with those of ``changes`` put in place of, or beside, equal keys.

    Among several changes of a key the greatest ``version`` wins; a change always beats the base.
    """
    order = [F.col("_change").desc(), *([F.col(version).desc_nulls_last()] if version else [])]
    both = base.withColumn("_change", F.lit(0)).unionByName(changes.withColumn("_change", F.lit(1)), allowMissingColumns=True)
    return keep_latest(both, keys, order).drop("_change")


def insert_only(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``base`` and those changes whose key is new."""
    return base.unionByName(changes.join(base.select(*keys).distinct(), list(keys), "left_anti"))


def update_rows(df: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    """Sets columns where the condition is true."""
    return df.withColumns({name: F.when(condition, value).otherwise(F.col(name)) for name, value in values.items()})


def delete_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true (false or null)."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def replace_groups(base: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in ``fresh`` replaced by those rows: delete, then insert, as one plan."""
    return base.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def write_groups(df: DataFrame, path: str, partition: str) -> None:
    """Overwrites only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
