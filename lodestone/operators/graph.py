"""Edges, hierarchies, cycles, boundaries and unused symbols."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.containment import smallest_span
from lodestone.operators.relational import chains, preferred
from lodestone.sources.lineage import cut

MOST_EDGES = 5_000
#: Edges that one task solves.
EDGES_AT_ONCE = 200_000


def edges_of(kinds: Mapping[str, DataFrame], most: int | None = MOST_EDGES) -> DataFrame:
    """Edges (src, dst, kind, truncated) of several kinds, ordered before they are cut to ``most``; not de-duplicated.

    ``truncated`` says of every edge whether others were cut off; ``None`` cuts nothing.
    """
    every = reduce(DataFrame.unionByName, [df.select("src", "dst", F.lit(kind).alias("kind")) for kind, df in kinds.items()])
    if most is None:
        return every.withColumn("truncated", F.lit(False))
    ahead = every.orderBy("src", "dst", "kind").limit(most + 1)
    size = ahead.agg((F.count("*") > most).alias("truncated"))
    return ahead.orderBy("src", "dst", "kind").limit(most).crossJoin(F.broadcast(size))


def nodes_of(edges: DataFrame) -> DataFrame:
    """The distinct ends of edges."""
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def to_dot(edges: DataFrame, name: str = "graph") -> DataFrame:
    """One row: the graph in DOT, lines in order. A sink for graphs that fit a row; see ``edges_of`` for the bound."""
    line = F.format_string('  "%s" -> "%s" [label="%s"];', F.col("src").cast("string"), F.col("dst").cast("string"), "kind")
    body = edges.agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("body"))
    return body.select(F.concat(F.lit(f"digraph {name} {{\n"), "body", F.lit("\n}")).alias("dot"))


def to_json(edges: DataFrame) -> DataFrame:
    """One row: nodes and edges as JSON. A sink for graphs that fit a row; see ``edges_of`` for the bound."""
    e = edges.agg(F.sort_array(F.collect_list(F.struct("src", "dst", "kind"))).alias("edges"))
    n = nodes_of(edges).agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    return n.crossJoin(e).select(F.to_json(F.struct("nodes", "edges")).alias("json"))


def hierarchy(classes: DataFrame, key: str, name: str, bases: str, by_name_only: bool = False) -> DataFrame:
    """Each class with its bases and its children in order; a base is met by the last part of its dotted name.

    Classes of one name in different files stay apart unless ``by_name_only``.
    """
    own = classes.select(key, name, bases)
    links = own.select(F.col(key), F.col(name).alias("child"), F.explode(F.col(bases)).alias("_base")).select(key, "child", F.element_at(F.split("_base", r"\."), -1).alias("_parent"))
    children = links.groupBy("_parent").agg(F.sort_array(F.collect_set("child")).alias("children"))
    out = own.join(children, own[name] == children["_parent"], "left").drop("_parent")
    out = out.withColumn("children", F.coalesce("children", F.array().cast("array<string>")))
    return out.dropDuplicates([name]) if by_name_only else out


def import_kind(resolved: Column, module: Column, standard: Sequence[str]) -> Column:
    """project, stdlib or third_party."""
    return F.when(resolved.isNotNull(), "project").when(F.element_at(F.split(module, r"\."), 1).isin(list(standard)), "stdlib").otherwise("third_party")


def _propagated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Columns (node, label): the least label among each node (columns node, label) and the nodes that lead to it.

    Each round sends labels from the nodes whose own has just changed, and looks once whether any did.
    """
    current = cut(nodes.select("node", "label", F.lit(True).alias("moved")))
    while not current.where("moved").isEmpty():
        sent = current.where("moved").join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("offered"))
        better = F.coalesce(F.col("offered") < F.col("label"), F.lit(False))
        current = cut(current.join(sent, "node", "left").select("node", F.when(better, F.col("offered")).otherwise(F.col("label")).alias("label"), better.alias("moved")))
    return current.select("node", "label")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have both an edge in and one out; the others are on no cycle."""
    both = edges.select(F.col("src").alias("node")).intersect(edges.select(F.col("dst").alias("node")))
    kept = edges.join(both.withColumnRenamed("node", "src"), "src", "left_semi")
    return kept.join(both.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def tarjan(sources: list, targets: list) -> list[list]:
    """Strong components of the graph of these edges."""
    ahead: dict = {}
    for a, b in zip(sources, targets, strict=True):
        ahead.setdefault(a, []).append(b)
    order: dict = {}
    low: dict = {}
    held: dict = {}
    out: list[list] = []
    for root in ahead:
        if root in order:
            continue
        walk = [(root, iter(ahead[root]))]
        order[root] = low[root] = len(order)
        held[root] = True
        while walk:
            node, rest = walk[-1]
            following = next((x for x in rest if x not in order or x in held), None)
            if following is None:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == order[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(held.popitem()[0])
                    out.append(members)
            elif following in order:
                low[node] = min(low[node], order[following])
            else:
                order[following] = low[following] = len(order)
                held[following] = True
                walk.append((following, iter(ahead.get(following, ()))))
    return out


def _solved(edges: DataFrame) -> DataFrame:
    """Columns (node, component) of a graph that one task holds."""
    kind = edges.schema["src"].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sources: list = []
        targets: list = []
        for frame in batches:
            sources += frame["src"].tolist()
            targets += frame["dst"].tolist()
        out = [(node, min(members)) for members in tarjan(sources, targets) for node in members]
        yield pd.DataFrame(out, columns=["node", "component"])

    return edges.select("src", "dst").coalesce(1).mapInPandas(rows, f"node {kind}, component {kind}")


def strong_components(edges: DataFrame, at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """Columns (node, component, in_cycle): nodes that lead to each other; the component is its least node.

    A graph of up to ``at_once`` edges (counted first) is solved by one task. A larger one is cut down
    to that: nodes without an edge in or out go, round by round while that helps; then every node
    takes the least node that leads to it, and those of its colour that lead back to that one are a
    component, which is taken out. Self loops are cycles.
    """
    e = cut(edges.select("src", "dst").distinct().where("src IS NOT NULL AND dst IS NOT NULL"))
    loops = e.where("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("_loop"))
    inner, done = e.where("src <> dst"), []
    size = inner.count()
    while size > at_once:
        smaller = cut(_trimmed(inner))
        before, inner, size = size, smaller, smaller.count()
        if size <= at_once or size < 0.9 * before:
            continue
        colour = _propagated(nodes_of(inner).select("node", F.col("node").alias("label")), inner)
        of = lambda end: colour.select(F.col("node").alias(end), F.col("label").alias(f"{end}_colour"))
        same = cut(inner.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour"))
        # Along reversed edges of one colour the root's mark, which is least, reaches just its component.
        ends = same.select(F.col("src").alias("node"), "src_colour").union(same.select("dst", "dst_colour")).distinct()
        marks = ends.select("node", F.when(F.col("node") == F.col("src_colour"), 0).otherwise(1).alias("label"))
        reached = _propagated(marks, same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = cut(reached.where("label = 0").join(colour.withColumnRenamed("label", "component"), "node").select("node", "component"))
        done.append(found)
        gone = found.select("node")
        inner = cut(inner.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
        size = inner.count()
    done.append(_solved(inner))
    every = reduce(DataFrame.unionByName, done)
    sizes = every.groupBy("component").agg(F.count("*").alias("_n")).where("_n > 1")
    own = nodes_of(e).join(every, "node", "left").join(sizes, "component", "left").join(loops, "node", "left")
    return own.select("node", F.coalesce("component", "node").alias("component"), (F.col("_n").isNotNull() | F.coalesce("_loop", F.lit(False))).alias("in_cycle"))


def bounded_cycles(edges: DataFrame, depth: int) -> DataFrame:
    """Distinct cycles of at most ``depth`` edges, as node arrays that begin with their least node."""
    paths = chains(edges, depth)
    closed = paths.where((F.element_at("path", 1) == F.element_at("path", -1)) & (F.size("path") > 2) | (F.size("path") == 2) & (F.element_at("path", 1) == F.element_at("path", 2)))
    ring = F.slice("path", 1, F.size("path") - 1)
    at = F.array_position(ring, F.array_min(ring)).cast("int")
    turned = F.concat(F.slice(ring, at, F.size(ring) - at + 1), F.slice(ring, 1, at - 1))
    return closed.select(turned.alias("cycle")).distinct()


def boundary(edges: DataFrame, inside: Column, inside_dst: Column, internal: Sequence[str], external: Sequence[str]) -> DataFrame:
    """One row: a package's outbound edges by kind, its inbound edges, the distinct targets, and a verdict.

    The verdict goes by substrings of the target names: only internal seeds, only external ones, both or none.
    """
    has = lambda c, seeds: reduce(Column.__or__, [c.contains(s) for s in seeds], F.lit(False))
    out = edges.where(inside & ~inside_dst)
    summary = out.agg(
        F.count("*").alias("n_outbound"),
        F.countDistinct("dst").alias("n_targets"),
        F.coalesce(F.max(has(F.col("dst").cast("string"), internal)), F.lit(False)).alias("_internal"),
        F.coalesce(F.max(has(F.col("dst").cast("string"), external)), F.lit(False)).alias("_external"),
    )
    inbound = edges.where(~inside & inside_dst).agg(F.count("*").alias("n_inbound"))
    verdict = F.when(F.col("_internal") & F.col("_external"), "mixed").when(F.col("_internal"), "internal").when(F.col("_external"), "external").otherwise("closed")
    return summary.crossJoin(inbound).select("n_outbound", "n_targets", "n_inbound", verdict.alias("verdict"))


def dependency_split(edges: DataFrame, internal: DataFrame, node: str) -> DataFrame:
    """Edges with whether their target is one of the internal nodes."""
    known = internal.select(F.col(node).alias("dst"), F.lit(True).alias("_in")).distinct()
    return edges.join(known, "dst", "left").select("src", "dst", F.when(F.col("_in"), "internal").otherwise("external").alias("side"))


def dead_code(symbols: DataFrame, usages: DataFrame, key: str, is_test: Column, is_import: Column, file: str | None = None) -> DataFrame:
    """Each symbol's class: live, test_only, import_only or unused, and its place in the report.

    With ``file``, a column of both tables, imports from a symbol's own file do not count; other uses
    there do. A name's importing files are then told apart by their least and greatest, so that no
    usage ever meets a symbol of its name.
    """
    if file:
        least, greatest = F.min(F.when(is_import, F.col(file))), F.max(F.when(is_import, F.col(file)))
        seen = usages.groupBy(key).agg(F.max(~is_test & ~is_import).alias("_live"), F.max(is_test & ~is_import).alias("_test"), least.alias("_low"), greatest.alias("_high"))
        joined = symbols.join(seen, key, "left").withColumn("_import", (F.col("_low") != F.col(file)) | (F.col("_high") != F.col(file)))
        return _dead_code_state(joined, symbols.columns)
    seen = usages.groupBy(key).agg(F.max(~is_test & ~is_import).alias("_live"), F.max(is_test & ~is_import).alias("_test"), F.max(is_import).alias("_import"))
    return _dead_code_state(symbols.join(seen, key, "left"), symbols.columns)


def _dead_code_state(joined: DataFrame, columns: Sequence[str]) -> DataFrame:
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    state = F.when(yes("_live"), "live").when(yes("_test"), "test_only").when(yes("_import"), "import_only").otherwise("unused")
    rank = F.when(yes("_live"), 3).when(yes("_test"), 2).when(yes("_import"), 1).otherwise(0)
    return joined.select(*columns, state.alias("state"), rank.alias("rank"))


def cross_reference(usages: DataFrame, spans: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges caller to callee: the smallest entity around each usage, and the entity of the name used, same file first.

    ``usages``: usage_id, file, line, name. ``spans``: entity, file, first, last, rank.
    ``entities``: entity, file, name. The least entity of each name, and of each name in each file,
    is found first, so a usage meets one row of either however common its name is.
    """
    callers = smallest_span(usages, spans, "file", "line", "first", "last", F.col("rank"), "entity", "left").withColumnRenamed("entity", "caller")
    return preferred(callers, entities.withColumnRenamed("entity", "callee"), ("name", "name"), ("file", "file"), "callee")


def inherit_edges(classes: DataFrame, key: str, name: str, bases: str) -> DataFrame:
    """Edges (src, dst, kind ``inherit``) from each class to its bases, met by the last part of their dotted names.

    A base whose name no class, or more than one, has is left out. As one plan over all classes it
    does not depend on which of them came first, so nothing is filled in later.
    """
    parent = F.element_at(F.split("_base", r"\."), -1)
    wanted = classes.select(F.col(key).alias("src"), F.explode(F.col(bases)).alias("_base")).select("src", parent.alias("_parent")).distinct()
    single = classes.groupBy(F.col(name).alias("_parent")).agg(F.count("*").alias("_n"), F.min(key).alias("dst")).where("_n = 1")
    return wanted.join(single, "_parent").select("src", "dst", F.lit("inherit").alias("kind"))


def find_usages(imports: DataFrame, classes: DataFrame, usages: DataFrame, target: str, target_type: str | None = None, target_class: str | None = None, file: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Where a name is used: imports, classes that inherit from it, and calls; a page by file and line.

    ``imports``: file, line, name, module. ``classes``: file, line, name, bases. ``usages``: file, line,
    name, target_type (class, function or method), target_class, usage. Columns (source, file, line,
    name, target_type, target_class, usage). Imports are asked for classes and functions, bases for
    classes, calls always; pages are cut once, after the union.
    """
    parts = []
    if target_type in ("class", "function", None):
        own = imports.where(F.col("name") == target)
        parts.append(own.select(F.lit("import").alias("source"), "file", "line", "name", F.lit(target_type or "import").alias("target_type"), F.lit(None).cast("string").alias("target_class"), F.lit("import").alias("usage")))
    if target_type in ("class", None):
        own = classes.where(F.array_contains("bases", target))
        parts.append(own.select(F.lit("inheritance").alias("source"), "file", "line", F.lit(target).alias("name"), F.lit("class").alias("target_type"), F.lit(None).cast("string").alias("target_class"), F.lit("inheritance").alias("usage")))
    own = usages.where(F.col("name") == target)
    for column, value in (("target_type", target_type), ("target_class", target_class)):
        own = own.where(F.col(column) == value) if value is not None else own
    parts.append(own.select(F.lit("usage").alias("source"), "file", "line", "name", "target_type", "target_class", "usage"))
    return _page(parts, file, limit, offset)


def find_dependencies(imports: DataFrame, classes: DataFrame, usages: DataFrame, target: str, target_type: str | None = None, target_class: str | None = None, file: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """What depends on a name; as ``find_usages``, but imports also by a part of their module, and modules are asked for imports alone."""
    parts = []
    if target_type in ("class", "function", "module", None):
        own = imports.where((F.col("name") == target) | F.coalesce(F.col("module").contains(target), F.lit(False)))
        parts.append(own.select(F.lit("import").alias("source"), "file", "line", "name", F.lit(None).cast("string").alias("target_type"), F.lit(None).cast("string").alias("target_class")))
    if target_type in ("class", None):
        own = classes.where(F.array_contains("bases", target))
        parts.append(own.select(F.lit("inheritance").alias("source"), "file", "line", "name", F.lit("class").alias("target_type"), F.lit(None).cast("string").alias("target_class")))
    if target_type in ("class", "function", "method", None):
        own = usages.where(F.col("name") == target)
        for column, value in (("target_type", target_type), ("target_class", target_class)):
            own = own.where(F.col(column) == value) if value is not None else own
        parts.append(own.select(F.lit("usage").alias("source"), "file", "line", "name", "target_type", "target_class"))
    return _page(parts, file, limit, offset)


def _page(parts: Sequence[DataFrame], file: str | None, limit: int | None, offset: int) -> DataFrame:
    every = reduce(DataFrame.unionByName, parts)
    every = every.where(F.col("file") == file) if file is not None else every
    if limit is None and not offset:
        return every
    place = F.when(F.col("source") == "import", 0).when(F.col("source") == "inheritance", 1).otherwise(2)
    ordered = every.orderBy(place, "file", "line", "name").offset(offset)
    return ordered.limit(limit) if limit is not None else ordered


def neighbours(edges: DataFrame, node, towards: str = "dependencies") -> DataFrame:
    """What a node refers to, or what refers to it, one edge away."""
    own, other = ("src", "dst") if towards == "dependencies" else ("dst", "src")
    return edges.where(F.col(own) == F.lit(node)).select(F.col(other).alias("node"), "kind").distinct()


def issues(components: DataFrame, kind: str = "import_cycle") -> DataFrame:
    """An issue row per cycle of two nodes or more."""
    sizes = components.groupBy("component").agg(F.count("*").alias("_n")).where("_n >= 2")
    rings = components.join(sizes, "component").groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    return rings.select(F.lit(kind).alias("issue_type"), F.concat_ws(" -> ", F.transform("nodes", lambda n: n.cast("string"))).alias("description"), F.size("nodes").alias("n_nodes"))
