"""Exact top-k search by inner product over postings, pruned by MaxScore.

Rows are bags of terms with whole-number weights, of either sign; a vector's terms are its dimensions.
The rows are dealt out into shards and the queries into blocks, and every shard meets every block in
a group of bounded size. A shard has a posting list for each term, in order of its rows, with the
greatest and least weight. For one query each term then has a bound: the most that it can add to a score.
In order of their bounds, the terms whose bounds together stay below the score to beat are
non-essential: a row with none of the others cannot be among the best. Only the essential postings are
traversed; what a row lacks is probed term by term, from the greatest bound on, and rows are let go
as soon as their score so far and the bounds left fall short. The score to beat is the k-th best of
the shard's first rows, scored in full. The best of each shard are merged by a window, which Spark
limits before it shuffles. Nothing is left out: rows of equal score stay until ids decide.

Weights are those of ``weights``: ``floor(scale * x)`` as 64-bit integers, held at the ends of their
range. A row whose id or vector is null, or that has a null or non-finite component, takes no part; an
empty vector scores zero; of vectors of different lengths the common dimensions count. Rows that share
a query's id are not its candidates; other repeated rows are each a candidate. Where a query's id has
several vectors the least of them asks. Scores that may pass 64 bits are added up as Python integers
and held at the ends of the range. An empty table gives an empty one. Other columns of the input are
not looked at.
"""

from __future__ import annotations

import heapq
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K, SCALE = 5, 256
#: Rows of a shard and queries of a block, which bound what a group holds.
SHARD_ROWS, BLOCK_QUERIES = 4_096, 4_096
#: Rows of a shard that are scored in full for a first score to beat.
PILOT = 128
#: Terms in this share of a shard's rows or more have a weight for every row.
DENSE = 0.5
LEAST, MOST = -(2**63), 2**63 - 1
FOUND = "query_id long, vec_id long, score long"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def weights(vector: Column, scale: int = SCALE) -> Column:
    """Whole-number weights of a vector; null where it is null or has a null or non-finite component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~odd, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _bags(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of what is in lists of weights, without zeros, by row."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    terms = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    there = values != 0
    return rows[there], terms[there], values[there]


class Shard:
    """Posting lists of some rows: for each term its rows (None: all of them) with their weights."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, terms: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.n = ids, len(ids)
        self.postings: dict[int, tuple[np.ndarray | None, np.ndarray]] = {}
        self.range: dict[int, tuple[int, int]] = {}
        order = np.argsort(terms, kind="stable")  # rows stay in order within a term
        rows, terms, values = rows[order], terms[order], values[order]
        cuts = [0, *(np.flatnonzero(terms[1:] != terms[:-1]) + 1).tolist(), len(terms)] if len(terms) else []
        for low, high in pairwise(cuts):
            term, own, weight = int(terms[low]), rows[low:high], values[low:high]
            if high - low >= DENSE * self.n:
                every = np.zeros(self.n, np.int64)
                every[own] = weight
                own, weight = None, every
            self.postings[term] = own, weight
            zero = () if own is None else (0,)  # a row outside the list adds nothing
            self.range[term] = max(int(weight.max()), *zero, LEAST), min(int(weight.min()), *zero, MOST)

    def at(self, term: int, rows: np.ndarray) -> np.ndarray:
        """Weights of a term in these rows: a probe of its posting list."""
        own, weight = self.postings[term]
        if own is None:
            return weight[rows]
        place = np.minimum(np.searchsorted(own, rows), len(own) - 1)
        return np.where(own[place] == rows, weight[place], 0)

    def best(self, query: int | None, terms: list[int], values: list[int], k: int) -> list[tuple[int, int]]:
        """The k best rows (score, id) for one query, without rows of its own id; ties to the smaller id."""
        bounds = sorted((max(q * self.range[t][0], q * self.range[t][1]), t, q) for t, q in zip(terms, values, strict=True) if t in self.postings)
        widest = sum(abs(q) * max(abs(x) for x in self.range[t]) for _, t, q in bounds)
        kind = np.int64 if widest <= MOST else object

        def added(t: int, q: int, rows: np.ndarray) -> np.ndarray:
            return self.at(t, rows).astype(kind) * q

        others = np.flatnonzero(self.ids != query)
        least = None  # the score to beat
        pilot = others[:PILOT]
        if len(pilot) >= k:
            least = heapq.nlargest(k, sum((added(t, q, pilot) for _, t, q in bounds), np.zeros(len(pilot), kind)).tolist())[-1]
        split, rest = 0, 0
        while least is not None and split < len(bounds) and rest + bounds[split][0] < least:
            rest += bounds[split][0]
            split += 1
        score, met = self._traversed(bounds[split:], kind)
        rows = others if least is None or rest >= least else others[met[others]]
        score = score[rows]
        for bound, t, q in reversed(bounds[:split]):
            near = score + rest >= least
            rows, score = rows[near], score[near]
            score = score + added(t, q, rows)
            rest -= bound
        if least is not None:
            near = score >= least
            rows, score = rows[near], score[near]
        top = heapq.nsmallest(k, zip((-score).tolist(), self.ids[rows].tolist(), strict=True))
        return [(-s, i) for s, i in top]

    def _traversed(self, essential: list[tuple[int, int, int]], kind: type) -> tuple[np.ndarray, np.ndarray]:
        """What the essential terms add to each row's score, and which rows their postings hold."""
        score, met = np.zeros(self.n, kind), np.zeros(self.n, bool)
        for _, t, q in reversed(essential):
            own, weight = self.postings[t]
            own = slice(None) if own is None else own
            score[own] += weight.astype(kind, copy=False) * q
            met[own] = True
        return score, met


def _answered(k: int):
    def answered(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        ids = vectors.column("vec_id").to_numpy().astype(np.int64)
        shard = Shard(ids, *_bags(vectors.column("weights")))
        rows, terms, values = _bags(queries.column("weights"))
        edges = np.searchsorted(rows, np.arange(queries.num_rows + 1)).tolist()
        out: list[tuple[int, int, int]] = []
        for number, query in enumerate(queries.column("query_id").to_pylist()):
            low, high = edges[number], edges[number + 1]
            out += [(query, i, min(max(s, LEAST), MOST)) for s, i in shard.best(query, terms[low:high].tolist(), values[low:high].tolist(), k)]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], schema=_FOUND)

    return answered


def search(rows: DataFrame, asked: Column, k: int = K, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The ``k`` best other rows for each row that ``asked`` is true of: query_id, rank from 1, vec_id, score.

    ``rows`` has vec_id and ``weights`` (whole numbers, one for each term; null: takes no part);
    ``asked`` is on vec_id. All rows are candidates, in shards; all queries are asked, in blocks.
    """
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(asked).alias("q")).first()  # of ids alone
    shards, blocks = -(-sizes["n"] // shard_rows) or 1, -(-sizes["q"] // block_queries) or 1
    usable = rows.select("vec_id", "weights").where("vec_id IS NOT NULL AND weights IS NOT NULL")
    vectors = usable.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)))
    vectors = vectors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = usable.where(asked).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("weights").alias("weights"))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    found = vectors.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(_answered(k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def oracle(every: int = 50, k: int = K, scale: int = SCALE) -> str:
    """DuckDB SQL of the search over ``embeddings``."""
    return f"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS w FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
