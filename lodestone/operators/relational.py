"""Filters, joins, aggregates, windows, orders and set operations of the code index."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.sources.lineage import cut

#: Seconds by which modification times may differ: change detection, and coverage.
CHANGE_TOLERANCE, COVERAGE_TOLERANCE = 0.1, 1e-6


def is_active(deleted: Column) -> Column:
    """Rows that are not soft-deleted; null counts as not deleted."""
    return ~F.coalesce(deleted, F.lit(False))


def name_like(df: DataFrame, column: str, pattern: str, order: Sequence[str]) -> DataFrame:
    """SQL LIKE on a name, ordered."""
    return df.where(F.col(column).like(pattern)).orderBy(*order)


def grep(lines: DataFrame, content: str, pattern: str, regex: bool = False, ignore_case: bool = False, most: int | None = None, order: Sequence[str] = (), preview: int = 200) -> DataFrame:
    """Lines with a literal or a regular expression, previews cut to ``preview`` characters."""
    column = F.lower(F.col(content)) if ignore_case and not regex else F.col(content)
    if regex:
        test = column.rlike(("(?iu)" if ignore_case else "") + pattern)
    else:
        test = column.contains(pattern.lower() if ignore_case else pattern)
    found = lines.where(test).withColumn("preview", F.substring(content, 1, preview))
    if most is not None:
        found = found.orderBy(*order).limit(most) if order else found.limit(most)
    return found


def grep_budget(texts: DataFrame, key: str, most_texts: int) -> DataFrame:
    """The first texts by key, for a search that may look at so many."""
    return texts.orderBy(key).limit(most_texts)


def grep_bounded(lines: DataFrame, key: str, content: str, pattern: str, most_texts: int, most_matches: int, most_bytes: int, regex: bool = False, ignore_case: bool = False) -> DataFrame:
    """Matches by key and line within a budget, each with why the search stopped (``exceeded``, null if it did not).

    The budget is the number of texts looked at, of matches, and of bytes of the matched lines; the
    first match that no longer fits ends the list. ``exceeded`` names the first limit met: texts,
    matches or bytes. Only rows within the first two limits meet in one task.
    """
    looked_at = lines.select(key).distinct().orderBy(key).limit(most_texts + 1)
    places = looked_at.withColumn("_place", F.row_number().over(Window.orderBy(key)))
    more = places.agg(F.coalesce(F.max("_place") > most_texts, F.lit(False)).alias("_more_texts"))
    own = lines.join(F.broadcast(places.where(F.col("_place") <= most_texts).select(key)), key, "left_semi")
    found = grep(own, content, pattern, regex, ignore_case, most_matches + 1, [key, "line"])
    order = Window.orderBy(key, "line")
    counted = found.withColumn("_n", F.row_number().over(order)).withColumn("_bytes", F.sum(F.octet_length(content)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    over = counted.agg(F.coalesce(F.max("_n") > most_matches, F.lit(False)).alias("_more_matches"), F.coalesce(F.max(F.when(F.col("_n") <= most_matches, F.col("_bytes"))) > most_bytes, F.lit(False)).alias("_more_bytes"))
    reason = F.when(F.col("_more_bytes"), "bytes").when(F.col("_more_matches"), "matches").when(F.col("_more_texts"), "texts")
    why = over.crossJoin(F.broadcast(more)).select(reason.alias("exceeded"))
    kept = counted.where((F.col("_n") <= most_matches) & (F.col("_bytes") <= most_bytes))
    return kept.drop("_n", "_bytes").crossJoin(F.broadcast(why))


def freshness(known: Column, indexed_sum: Column, indexed_time: Column, disk_sum: Column, disk_time: Column) -> Column:
    """missing_index, unavailable_index, stale or fresh.

    No record: missing; one without checksum and time: unavailable. Stale is a checksum that differs
    from the disk's, or a disk time that is newer, even where the checksums agree.
    """
    return (
        F.when(~F.coalesce(known, F.lit(False)), "missing_index")
        .when(indexed_sum.isNull() & indexed_time.isNull(), "unavailable_index")
        .when(indexed_sum.isNotNull() & ~indexed_sum.eqNullSafe(disk_sum), "stale")
        .when(F.coalesce(disk_time > indexed_time, F.lit(False)), "stale")
        .otherwise("fresh")
    )


def coverage(known: Column, deleted: Column, contents: Column, indexed_time: Column, disk_time: Column) -> Column:
    """not_indexed, deleted, missing_content, changed_since_index or indexed_current.

    Changed is a file that is gone from the disk (no disk time), or newer there; an older one is current.
    """
    newer = disk_time > F.coalesce(indexed_time, F.lit(0.0)) + COVERAGE_TOLERANCE
    return (
        F.when(~F.coalesce(known, F.lit(False)), "not_indexed")
        .when(F.coalesce(deleted, F.lit(False)), "deleted")
        .when(F.coalesce(contents, F.lit(0)) == 0, "missing_content")
        .when(F.coalesce(newer, F.lit(True)), "changed_since_index")
        .otherwise("indexed_current")
    )


def staleness(known: Column, indexed_sum: Column, current_sum: Column, in_session: Column) -> Column:
    """not_in_db, sha_match, skipped_active_session or rebuilt; a current text that cannot be read is not trusted."""
    same = F.coalesce(indexed_sum == current_sum, F.lit(False))
    return (
        F.when(~F.coalesce(known, F.lit(False)), "not_in_db")
        .when(same, "sha_match")
        .when(F.coalesce(in_session, F.lit(False)), "skipped_active_session")
        .otherwise("rebuilt")
    )


def search_candidates(files: DataFrame, allowed: Column, state: Column) -> DataFrame:
    """Files of a search with where to look for them: the index if that is current, else the disk; others are left out."""
    return files.where(allowed).withColumn("look_in", F.when(state == "indexed_current", "index").otherwise("disk"))


def time_gate(seen: Column, disk: Column, tolerance: float = CHANGE_TOLERANCE) -> Column:
    """Why a result has to be made anew (no_record, disk_newer) or not (equal_within_tolerance, disk_older)."""
    return (
        F.when(seen.isNull(), "no_record")
        .when(disk > seen + tolerance, "disk_newer")
        .when(F.abs(disk - seen) <= tolerance, "equal_within_tolerance")
        .when(disk.isNotNull(), "disk_older")
    )


def log_filter(df: DataFrame, stamp: str, level: str, message: str, importance: str, since=None, until=None, levels: Sequence[str] = (), events: Sequence[str] = (), search: str | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    """Conjunction of a time range, a level set, any of some event patterns, a search and an importance range."""
    tests = []
    if since is not None:
        tests.append(F.col(stamp) >= F.lit(since).cast("timestamp"))
    if until is not None:
        tests.append(F.col(stamp) <= F.lit(until).cast("timestamp"))
    if levels:
        tests.append(F.col(level).isin([x.upper() for x in levels]))
    if events:
        tests.append(reduce(Column.__or__, [F.col(message).rlike("(?i)" + e) for e in events]))
    if search:
        tests.append(F.col(message).rlike(search))
    if least is not None:
        tests.append(F.col(importance) >= least)
    if most is not None:
        tests.append(F.col(importance) <= most)
    return reduce(lambda d, t: d.where(t), tests, df)


def longer_than(df: DataFrame, size: str, most: int, order: Sequence[str] = ()) -> DataFrame:
    """Rows over a size, the largest first, with what they exceed it by."""
    return df.where(F.col(size) > most).withColumn("exceeds_by", F.col(size) - most).orderBy(F.col(size).desc(), *order)


def page(df: DataFrame, order: Sequence[Column | str], size: int = 50, offset: int = 0, block: int | None = None, most_size: int = 500) -> DataFrame:
    """A page of rows with ``total`` and ``has_more``; a block number overrides the offset."""
    size = max(1, min(size, most_size))
    offset = max(0, (block * size) if block is not None else offset)
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset(offset).limit(size)
    return rows.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + size)


def structural_gate(checks: Sequence[tuple[Column, str]]) -> Column:
    """The first reason whose test is true, else ``accept``; the order of the checks decides."""
    out = F
    for test, reason in checks:
        out = out.when(F.coalesce(test, F.lit(False)), reason)
    return out.otherwise("accept") if checks else F.lit("accept")


def select_blocks(df: DataFrame, group: Sequence[str], order: Sequence[str], start: int | None = None, stop: int | None = None) -> DataFrame:
    """Blocks of each group by a slice with Python's meaning of negative bounds."""
    w = Window.partitionBy(*group)
    numbered = df.withColumn("_n", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_size", F.count("*").over(w))
    edge = lambda v: F.lit(v) if v >= 0 else F.greatest(F.col("_size") + v, F.lit(0))
    if start is not None:
        numbered = numbered.where(F.col("_n") >= edge(start))
    if stop is not None:
        numbered = numbered.where(F.col("_n") < edge(stop))
    return numbered.drop("_n", "_size")


def blocks_by_id(df: DataFrame, column: str, ids: Sequence) -> DataFrame:
    """The blocks with these ids; running the plan fails if one is missing."""
    found = df.where(F.col(column).isin(list(ids)))
    missing = found.agg((F.countDistinct(column) == len(set(ids))).alias("_all"))
    checked = missing.select(F.assert_true("_all", F.lit("a block id is unknown")).alias("_checked"))
    return found.crossJoin(F.broadcast(checked)).where(F.col("_checked").isNull()).drop("_checked")


def or_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], left_id: str, right_id: str) -> DataFrame:
    """Inner join on any of several equalities, as a union of hash joins that keeps each pair once."""
    joined = [left.join(right, left[a] == right[b]) for a, b in pairs]
    return reduce(DataFrame.unionByName, joined).dropDuplicates([left_id, right_id])


def preferred(left: DataFrame, right: DataFrame, on: tuple[str, str], same: tuple[str, str], right_id: str) -> DataFrame:
    """Left rows with the least id among the right rows of their key, of those that are the same in another column if there are any.

    The least id of each key, and of each key and column, is found first, so a left row meets one row
    of either, however many the key has.
    """
    near = right.groupBy(F.col(on[1]).alias("_near_key"), F.col(same[1]).alias("_near_same")).agg(F.min(right_id).alias("_near"))
    far = near.groupBy(F.col("_near_key").alias("_far_key")).agg(F.min("_near").alias("_far"))
    met = left.join(far, F.col(on[0]) == F.col("_far_key")).join(near, (F.col(on[0]) == F.col("_near_key")) & (F.col(same[0]) == F.col("_near_same")), "left")
    return met.select(*left.columns, F.coalesce("_near", "_far").alias(right_id))


def unique_match(left: DataFrame, right: DataFrame, left_on: str, right_on: str, right_id: str) -> DataFrame:
    """Left rows with the id of their match where there is exactly one."""
    single = right.groupBy(right_on).agg(F.count("*").alias("_n"), F.min(right_id).alias(right_id)).where("_n = 1").drop("_n")
    return left.join(single, left[left_on] == single[right_on])


def chains(edges: DataFrame, depth: int) -> DataFrame:
    """Paths of up to ``depth`` edges from every source, as node arrays that end at the first repeat."""
    e = edges.select("src", "dst").distinct()
    paths = e.select(F.array("src", "dst").alias("path"))
    out = [paths]
    for _ in range(depth - 1):
        open_paths = paths.where(~F.array_contains(F.slice("path", 1, F.size("path") - 1), F.element_at("path", -1)))
        paths = open_paths.join(e, F.element_at("path", -1) == F.col("src")).select(F.concat("path", F.array("dst")).alias("path"))
        out.append(paths)
    return reduce(DataFrame.unionByName, out)


def path_suffix_match(names: DataFrame, files: DataFrame, name: str, path: str) -> DataFrame:
    """Each module path with its file: the same, else one that ends in it after a slash.

    Of several: same first directory, fewer slashes, first by name. Files are exploded into their
    path suffixes, so that the match is an equality.
    """
    parts = F.split(F.col("path"), "/")
    f = files.select(F.col(path).alias("path"))
    tails = f.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))).alias("_tail"))
    found = names.join(tails, F.col(name) == F.col("_tail"))
    top = lambda c: F.element_at(F.split(c, "/"), 1)
    order = F.struct(F.col("path") != F.col(name), top(F.col("path")) != top(F.col(name)), F.size(F.split("path", "/")), F.col("path"))
    return found.groupBy(*names.columns).agg(F.min_by("path", order).alias("resolved"))


def counts_by(df: DataFrame, keys: Sequence[str], **counters: Column) -> DataFrame:
    """Rows per key, and one counter per condition."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(c).alias(n) for n, c in counters.items()])


def roll_up(base: DataFrame, key: str, parts: Sequence[tuple[DataFrame, Mapping[str, Column]]]) -> DataFrame:
    """Aggregates of other tables beside each base row; each table is aggregated by the key once, then joined. No rows: zero."""
    out = base
    for df, aggregates in parts:
        out = out.join(df.groupBy(key).agg(*[a.alias(name) for name, a in aggregates.items()]), key, "left")
    return out.fillna(0, [name for _, aggregates in parts for name in aggregates])


def grouped_lists(df: DataFrame, key: str, item: Column, order: str) -> DataFrame:
    """Per category its size and its items in order."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i")))), lambda x: x["i"]).alias("items"))


def timing_summary(df: DataFrame, operation: str, seconds: str) -> DataFrame:
    """Count, total, average, least and greatest time of each operation, rounded to three places."""
    s = F.col(seconds)
    return df.groupBy(operation).agg(
        F.count("*").alias("n"),
        F.round(F.sum(s), 3).alias("total"),
        F.round(F.avg(s), 3).alias("average"),
        F.round(F.min(s), 3).alias("least"),
        F.round(F.max(s), 3).alias("greatest"),
    )


def renumber(df: DataFrame, order: Sequence[str], name: str, slices: int | None = None) -> DataFrame:
    """Dense numbers from 0 in a global order, without gathering all rows in one task.

    Rows are range-partitioned by the order and cut off there, so that slices stay as they are;
    numbers within a slice start at the count of all rows in the slices before it. ``slices`` is the
    session's number of shuffle partitions if it is not given. The rows are written before (sampling
    the ranges would make them twice) and after they are dealt out, so this runs as it is called.
    """
    df = cut(df)
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = cut(df.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id()))
    sizes = kept.groupBy("_slice").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_slice").orderBy(*order)) - 1
    numbered = kept.withColumn("_own", own).join(F.broadcast(before.select("_slice", "_before")), "_slice")
    return numbered.withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_slice", "_own", "_before")


def union_entities(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of several kinds under one schema; columns that a kind lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("entity", F.lit(kind)) for kind, df in parts.items()])


def split_by_presence(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Keys of the left that the right has, and those that it lacks; each once."""
    keys = left.select(key).distinct()
    return keys.join(right, key, "left_semi"), keys.join(right, key, "left_anti")


def sync_plan(indexed: DataFrame, disk: DataFrame, key: str, time: str, deleted: str, tolerance: float = CHANGE_TOLERANCE, locked: DataFrame | None = None) -> DataFrame:
    """What to do with each key: insert, update, resurrect, delete or keep; locked keys are left out."""
    a = indexed.select(F.col(key), F.col(time).alias("indexed_time"), F.coalesce(F.col(deleted), F.lit(False)).alias("was_deleted"), F.lit(True).alias("known"))
    b = disk.select(F.col(key), F.col(time).alias("disk_time"), F.lit(True).alias("present"))
    both = a.join(b, key, "full_outer")
    action = (
        F.when(F.col("known").isNull(), "insert")
        .when(F.col("present").isNull(), F.when(F.col("was_deleted"), "keep").otherwise("delete"))
        .when(F.col("was_deleted"), "resurrect")
        .when(F.abs(F.col("disk_time") - F.col("indexed_time")) > tolerance, "update")
        .otherwise("keep")
    )
    plan = both.select(key, action.alias("action"), "indexed_time", "disk_time")
    return plan.join(locked.select(key).distinct(), key, "left_anti") if locked is not None else plan
