"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that the one before has kept and decides on those alone; all but the
last return the columns of ``documents``. Between stages the documents are a written table, so a
lost executor costs one stage at most.

What holds for odd documents: a null text has no language and goes in the first stage, as does an
empty one. Documents are told apart by their ids, or by their rows where ids are missing or shared,
so one of them never goes for another. Of copies the one of the least id stays (of those without an
id, or with a shared one, the first in the table). Long texts are read whole in every stage, and an
empty table stays empty through all of them. Columns beyond those of ``documents`` stay as they are,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common, language_mixture, mixture_packing, pii_crf, simhash_pivot, string_tiling


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a column that tells their rows apart, and its name.

    That is the id where ids are there and unique, which is looked up first; otherwise the rows are
    written with a number each.
    """
    name = "row"
    while name in docs.columns:
        name += "_"
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn(name, F.col("doc_id")), name
    return common.written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def judged(docs: DataFrame, key: str) -> DataFrame:
    """What an operator sees of keyed documents: the key as their id, and the text."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), "text")


def without(docs: DataFrame, key: str, gone: DataFrame, label: str) -> DataFrame:
    """Keyed documents without those whose key is among the ids gone.

    These are written first: Spark then knows how large they are before it plans, and does not
    shuffle the texts where the ids are small enough to be sent to them.
    """
    ids = common.written(gone.select(F.col("doc_id").alias(key)).distinct(), label)
    return docs.join(ids, key, "left_anti").drop(key)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in which no language is found (null, empty, without a letter, or in none of the languages learned)."""
    common.ship(spark)
    return language_mixture.keep_identified(docs, language_mixture.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id or row."""
    common.ship(spark)
    rows, key = keyed(docs)
    groups = simhash_pivot.near_duplicates(judged(rows, key))
    return without(rows, key, groups.where("doc_id <> component_id"), "copies").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item; nothing goes where the benchmark is empty."""
    common.ship(spark)
    rows, key = keyed(docs)
    leaks = string_tiling.leaks(judged(rows, key), common.table(spark, sf_dir, "benchmark"))
    return without(rows, key, leaks, "leaks").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data masked; every row stays."""
    common.ship(spark)
    return pii_crf.mask_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences that hold the mixture of sources; a null source is one of its own."""
    common.ship(spark)
    return mixture_packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: No stage but the joins between them is expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
