"""Connected components of a link table by alternating large-star and small-star steps.

Links never leave Spark: every round is two joins against the least neighbour of each node, and its
result goes to the checkpoint folder, so a lost executor costs one round at most. The rounds needed
grow with the logarithm of the longest chain. An empty table gives an empty table; self links and
repeated links change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common

MOST_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(links: DataFrame) -> tuple[int, int | None]:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(links: DataFrame) -> DataFrame:
    """Columns (node, root) for every node of ``links`` (columns u, v) that is not its component's least node."""
    common.shared_folder(links.sparkSession)
    current = links.select("u", "v").where("u <> v").distinct().checkpoint()
    state = _state(current)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        current = _small_star(_large_star(current)).checkpoint()
        before, state = state, _state(current)
        if state == before:
            break
    else:
        raise RuntimeError(f"links did not settle in {MOST_ROUNDS} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
