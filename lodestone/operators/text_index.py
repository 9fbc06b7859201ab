"""A stored full-text index: terms with their positions, in Parquet sorted by term, and ranks from it.

A row holds one term of one document: the number of words of the document, how often the term is there,
and its positions as gaps (the first place, then the differences), which counts do not read. Rows are range-partitioned and sorted by term and key,
in small row groups, so the words that a query's terms begin lie together and a search reads their row
groups alone; a frequent term is cut by key. Documents are put and dropped by generations: each
is a folder of rows and one of keys whose earlier rows no longer count, and counts itself once it is
entered among the commits, so a generation that failed half-way is never read. ``compact`` writes the
rows that count as a new first generation.

Keys are told apart by value and should be unique; a null key or text is not indexed, a text without a
word has no rows. Texts are looked at up to ``search.MOST_CHARACTERS``, which bounds what a document
has in a row or a window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.patterns import prefix_terms
from lodestone.operators.search import tokens

#: Bytes of a row group, the least that a search reads of a file.
ROW_GROUP = 4 << 20
#: Weight of a word without a label in the cover density.
WORD_WEIGHT = 0.1


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """Rows (term, key, n_words, n, gaps) of documents, each task a range of terms and keys, in order."""
    counted = F.element_at(F.transform(F.array(tokens(text)), lambda w: F.struct(F.size(w).alias("n"), w.alias("w"))), 1)
    split = docs.select(F.col(key).alias("key"), counted.alias("_s")).select("key", F.col("_s.n").alias("n_words"), F.col("_s.w").alias("_w"))
    words = split.where("key IS NOT NULL").select("key", "n_words", F.posexplode("_w").alias("at", "term"))
    dealt = words.repartitionByRange(F.col("term"), F.col("key"))
    places = dealt.groupBy("term", "key").agg(F.first("n_words").alias("n_words"), F.array_sort(F.collect_list("at")).alias("at"))
    gaps = F.transform("at", lambda x, i: F.when(i == 0, x).otherwise(x - F.get("at", i - 1)))
    return places.select("term", "key", "n_words", F.size("at").alias("n"), gaps.alias("gaps")).sortWithinPartitions("term", "key")


def _begins(term: str) -> Column:
    """Whether a word begins with a term, as a range, which row groups are skipped by."""
    after = next((term[:i] + chr(ord(term[i]) + 1) for i in range(len(term) - 1, -1, -1) if ord(term[i]) + 1 not in (0xD800, 0x110000)), None)
    at_least = F.col("term") >= term
    return at_least & (F.col("term") < after) if after is not None else at_least


def folder_state(spark: SparkSession, path: str) -> tuple[int, ...]:
    """Bytes, files and time of change of a table's folder, which tell whether an index of it still holds."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = system.getContentSummary(target)
    return held.getLength(), held.getFileCount(), system.getFileStatus(target).getModificationTime()


@dataclass(frozen=True)
class TextIndex:
    """The index in a folder."""

    spark: SparkSession
    path: str

    def _commits(self) -> list[tuple[int, bool]]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return []
        rows = self.spark.read.schema("generation int, first boolean").parquet(f"{self.path}/commits").collect()  # one row a generation
        return sorted((r["generation"], r["first"]) for r in rows)

    def generations(self) -> list[int]:
        """Generations that count: the last first one and those after it."""
        commits = self._commits()
        first = max((g for g, is_first in commits if is_first), default=0)
        return [g for g, _ in commits if g >= first]

    def _commit(self, generation: int, first: bool) -> None:
        self.spark.createDataFrame([(generation, first)], "generation int, first boolean").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def _next(self) -> int:
        return max((g for g, _ in self._commits()), default=-1) + 1

    def _write(self, rows: DataFrame, what: str, generation: int) -> None:
        rows.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(f"{self.path}/{what}/generation={generation}")

    def _read(self, what: str, schema: str) -> DataFrame:
        parts = [f"{self.path}/{what}/generation={g}" for g in self.generations()]
        return self.spark.read.schema(f"{schema}, generation int").option("basePath", f"{self.path}/{what}").parquet(*parts)

    def _key(self) -> str:
        return self.spark.read.parquet(f"{self.path}/gone/generation={self.generations()[0]}").schema["key"].dataType.simpleString()

    def put(self, docs: DataFrame, key: str, text: Column) -> None:
        """Adds documents, in place of those of the same keys."""
        generation = self._next()
        self._write(postings(docs, key, text), "postings", generation)
        self._write(docs.select(F.col(key).alias("key")).where("key IS NOT NULL"), "gone", generation)
        self._commit(generation, generation == 0)

    def drop(self, keys: DataFrame, key: str) -> None:
        """Takes documents out."""
        generation = self._next()
        self._write(self.rows().drop("generation").limit(0), "postings", generation)
        self._write(keys.select(F.col(key).alias("key")).where("key IS NOT NULL"), "gone", generation)
        self._commit(generation, False)

    def compact(self) -> None:
        """Writes what counts as a new first generation; earlier folders are no longer read."""
        generation = self._next()
        live = self.live(self.rows()).drop("generation")
        self._write(live.repartitionByRange(F.col("term"), F.col("key")).sortWithinPartitions("term", "key"), "postings", generation)
        self._write(live.select("key").limit(0), "gone", generation)
        self._commit(generation, True)

    def rows(self) -> DataFrame:
        """Rows of all generations that count: term, key, n_words, n, gaps, generation."""
        return self._read("postings", f"term string, key {self._key()}, n_words int, n int, gaps array<int>")

    def live(self, rows: DataFrame) -> DataFrame:
        """Those of the rows whose documents were not put or dropped later."""
        later = self.generations()[1:]
        if not later:
            return rows
        gone = self._read("gone", f"key {self._key()}").where(F.col("generation").isin(later)).groupBy("key").agg(F.max("generation").alias("gone"))
        return rows.join(gone, "key", "left").where("gone IS NULL OR generation >= gone").drop("gone")

    def hits(self, terms: Sequence[str]) -> DataFrame:
        """Rows whose term begins with one of the terms, read by their row groups."""
        wanted = _begins(terms[0])
        for term in terms[1:]:
            wanted = wanted | _begins(term)
        return self.live(self.rows().where(wanted))

    def matches(self, query: str) -> DataFrame:
        """(key, rank) of documents in which every word of the query begins some word; rank: such words per word."""
        terms = prefix_terms(query)
        if not terms:
            return self.rows().select("key", F.lit(0.0).alias("rank")).limit(0)
        each = [F.sum(F.when(_begins(t), F.col("n")).otherwise(0)).alias(f"h{i}") for i, t in enumerate(terms)]
        counted = self.hits(terms).groupBy("key").agg(F.first("n_words").alias("n_words"), *each)
        for i in range(len(terms)):
            counted = counted.where(F.col(f"h{i}") > 0)
        return counted.select("key", (sum((F.col(f"h{i}") for i in range(len(terms))), F.lit(0)) / F.col("n_words")).alias("rank"))

    def covers(self, query: str) -> DataFrame:
        """(key, first, last, n_words): the least stretches of a document that hold every word of the query.

        For each place the last place of every term up to it is known from one pass over the document's
        places; the earliest of those is where a cover that ends there begins, and of the covers that
        begin at one place the shortest is a least one. ``n_words`` counts its places with a term.
        """
        terms = prefix_terms(query)
        if not terms:
            return self.rows().selectExpr("key", "0 AS first", "0 AS last", "0L AS n_words").limit(0)
        here = self.hits(terms)
        full = here.groupBy("key").agg(*[F.max(_begins(t).cast("int")).alias(f"h{i}") for i, t in enumerate(terms)])
        for i in range(len(terms)):
            full = full.where(F.col(f"h{i}") > 0)
        flags = [_begins(t).alias(f"t{i}") for i, t in enumerate(terms)]
        placed = here.join(full.select("key"), "key", "left_semi").select("key", *flags, F.posexplode("gaps").alias("_i", "_gap"), "term")
        placed = placed.withColumn("at", F.sum("_gap").over(Window.partitionBy("key", "term").orderBy("_i")))
        order = Window.partitionBy("key").orderBy("at")
        placed = placed.withColumn("n", F.row_number().over(order))
        upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        lasts = [F.last(F.when(F.col(f"t{i}"), F.struct("at", "n")), ignorenulls=True).over(upto).alias(f"l{i}") for i in range(len(terms))]
        ends = placed.select("key", "at", "n", *lasts)
        for i in range(len(terms)):
            ends = ends.where(F.col(f"l{i}").isNotNull())
        begin = F.least(*[F.col(f"l{i}") for i in range(len(terms))]) if len(terms) > 1 else F.col("l0")
        least = ends.groupBy("key", begin.alias("b")).agg(F.min(F.struct("at", "n")).alias("e"))
        return least.select("key", F.col("b.at").alias("first"), F.col("e.at").alias("last"), (F.col("e.n") - F.col("b.n") + 1).cast("long").alias("n_words"))

    def cover_density(self, query: str, weight: float = WORD_WEIGHT) -> DataFrame:
        """(key, rank): each least cover counts for the weight of a word over one more than its words without a term."""
        other = F.col("last") - F.col("first") + 1 - F.col("n_words")
        return self.covers(query).groupBy("key").agg(F.sum(F.lit(weight) / (1 + other)).alias("rank"))
