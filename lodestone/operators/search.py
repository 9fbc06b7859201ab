"""Full-text, vector and combined search, all with one shape of findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.patterns import prefix_terms
from lodestone.operators.containment import smallest_span
from lodestone.operators.relational import renumber

#: Characters of a text that full-text search looks at, as documented for the index.
MOST_CHARACTERS = 200_000
#: Not a letter, digit or underscore; written out, since ``\w`` is ASCII in Java and Unicode elsewhere.
BETWEEN_WORDS = r"[^\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-cased words, without stemming or stop words."""
    return F.filter(F.split(F.lower(text), BETWEEN_WORDS), lambda t: t != "")


def index_text(*parts: Column) -> Column:
    """What is indexed of an entity: its parts, joined by spaces, up to a fixed length."""
    return F.substring(F.concat_ws(" ", *parts), 1, MOST_CHARACTERS)


def fulltext(df: DataFrame, key: str, text: Column, query: str) -> DataFrame:
    """Rows in which every word of the query begins some word, with ``rank``: such words per word of the text."""
    terms = prefix_terms(query)
    if not terms:
        return df.select(key, F.lit(0.0).alias("rank")).limit(0)
    folded = F.lower(text)
    for term in terms:
        df = df.where(F.contains(folded, F.lit(term)))  # cheap, and true of every match
    counts = lambda words: F.struct(F.size(words).alias("n"), *[F.size(F.filter(words, _begins(t))).alias(f"h{i}") for i, t in enumerate(terms)])
    found = df.select(key, F.element_at(F.transform(F.array(tokens(text)), counts), 1).alias("_c"))
    hits = [F.col(f"_c.h{i}") for i in range(len(terms))]
    for count in hits:
        found = found.where(count > 0)
    return found.select(key, (sum(hits, F.lit(0)) / F.col("_c.n")).alias("rank"))


def _begins(term: str):
    return lambda t: t.startswith(term)


def top_by_rank(found: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` best, ties by key."""
    return found.orderBy(F.col("rank").desc(), key).limit(k)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(vector: Column, query: Sequence[float], metric: str = "cosine") -> Column:
    """Cosine distance, or squared distance of the vectors scaled to unit length."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norms = F.sqrt(dot(vector, vector)) * F.lit(sum(float(x) ** 2 for x in query) ** 0.5)
    cosine = 1 - dot(vector, q) / norms
    if metric == "cosine":
        return cosine
    if metric == "l2":
        return 2 * cosine
    raise ValueError(f"unknown metric {metric!r}")


def vector_backend(choice: str = "auto") -> str:
    """The metric that a backend name stands for."""
    known = {"auto": "cosine", "pgvector": "cosine", "cosine": "cosine", "faiss": "l2", "l2": "l2"}
    if choice not in known:
        raise ValueError(f"unknown backend {choice!r}")
    return known[choice]


def semantic(df: DataFrame, key: str, vector: str, query: Sequence[float], k: int, metric: str = "cosine", least: float | None = None) -> DataFrame:
    """The ``k`` nearest vectors with ``score = 1 / (1 + distance)``; ``least`` is applied to those ``k``, so fewer may be left."""
    scored = df.select(key, distance(F.col(vector), query, metric).alias("distance")).orderBy("distance", key).limit(k)
    scored = scored.withColumn("score", 1 / (1 + F.col("distance")))
    return scored.where(F.col("score") >= least) if least is not None else scored


def contract_score(source: str, raw: Column) -> Column:
    """Scores of every producer in 0 to 1: ranks and similarities are clamped, line matches are 1."""
    if source == "grep":
        return F.lit(1.0)
    return F.least(F.greatest(F.coalesce(raw, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def findings(df: DataFrame, source: str, key: str, stable_id: Column, raw: Column) -> DataFrame:
    """Findings (source, key, stable_id, score) of one producer; rows without an identity are left out."""
    own = df.select(F.lit(source).alias("source"), F.col(key).cast("string").alias("key"), stable_id.cast("string").alias("stable_id"), contract_score(source, raw).alias("score"))
    return own.where("key IS NOT NULL AND stable_id IS NOT NULL")


def numbered(*producers: DataFrame) -> DataFrame:
    """Findings of all producers in one table, each with a result_id: its source and its number there by score.

    All are numbered at once (see ``renumber``), so every producer runs a single time.
    """
    every = reduce(DataFrame.unionByName, producers)
    rows = renumber(every.withColumn("_worse", -F.col("score")), ["source", "_worse", "key", "stable_id"], "_n")
    first = rows.groupBy("source").agg(F.min("_n").alias("_first"))
    own = rows.join(F.broadcast(first), "source")  # one row a producer
    return own.select(F.format_string("%s-%06d", "source", F.col("_n") - F.col("_first") + 1).alias("result_id"), "source", "key", "stable_id", "score")


def relevance_order(found: DataFrame) -> DataFrame:
    """Best score first, then by result id."""
    return found.orderBy(F.col("score").desc(), "result_id")


def blocks_of(found: DataFrame, size: int, order: Sequence[str]) -> DataFrame:
    """Findings with the number of the page that they are on in some order."""
    numbered = renumber(found, order, "_n").withColumn("ordinal", F.col("_n") + 1).drop("_n")
    return numbered.withColumn("block", F.floor((F.col("ordinal") - 1) / size).cast("long"))


def overlay(symbols: Column, docstring: Column) -> Column:
    """Distinct words of symbols and docstring in order of first place, joined by spaces."""
    return F.array_join(F.array_distinct(F.filter(F.split(F.concat_ws(" ", symbols, docstring), r"\s+"), lambda t: t != "")), " ")


def enrich(matches: DataFrame, blocks: DataFrame, key: str, line: str, n: int, need_structure: bool = False) -> DataFrame:
    """The first ``n`` matches (by key and line) with the smallest block around them, the others with the line alone."""
    numbered = renumber(matches, [key, line], "_n").withColumn("_n", F.col("_n") + 1)
    near = numbered.where(F.col("_n") <= n)
    held = smallest_span(near, blocks, key, line, "first", "last", F.col("first"), "block", "left")
    joined = held.unionByName(numbered.where(F.col("_n") > n).withColumn("block", F.lit(None).cast(blocks.schema["block"].dataType)))
    out = joined.withColumn("status", F.when(F.col("block").isNotNull(), "block").otherwise("line")).drop("_n")
    return out.where("status = 'block'") if need_structure else out


def vector_statistics(df: DataFrame, vector: str, group: str) -> DataFrame:
    """Vectors, those without values, and the number of dimensions, by group."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(vector).isNull() | (F.size(vector) == 0)).alias("n_missing"), F.max(F.size(vector)).alias("dimensions"))


def vector_index(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The index of an exact search: dense numbers in key order, and vectors of unit length; vectors without length are left out."""
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    unit = df.select(key, vector, norm.alias("norm")).where("norm > 0")
    unit = unit.select(key, "norm", F.transform(vector, lambda x: x.cast("double") / F.col("norm")).alias("unit"))
    return renumber(unit, [key], "dense_id")


def write_vector_index(df: DataFrame, key: str, vector: str, path: str) -> None:
    """Builds the index anew and puts it in place of the one at a path."""
    vector_index(df, key, vector).select("dense_id", F.col(key).alias("key"), "unit").write.mode("overwrite").parquet(path)


def search_vector_index(spark: SparkSession, path: str, query: Sequence[float], k: int, least: float | None = None) -> DataFrame:
    """The ``k`` nearest vectors of a stored index (key, dense_id, distance, score) by squared distance of unit vectors."""
    size = sum(float(x) ** 2 for x in query) ** 0.5
    if not size:
        raise ValueError("a query vector has a length")
    unit = F.array(*[F.lit(float(x) / size) for x in query])
    apart = F.aggregate(F.zip_with("unit", unit, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    near = spark.read.parquet(path).select("key", "dense_id", apart.alias("distance")).orderBy("distance", "key").limit(k)
    scored = near.withColumn("score", 1 / (1 + F.col("distance")))
    return scored.where(F.col("score") >= least) if least is not None else scored
