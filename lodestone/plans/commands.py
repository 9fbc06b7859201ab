"""Named commands with checked parameters, and batches of them.

A command is what a client asks for: a name, parameters with types and defaults, and a builder that
turns tables and parameters into a lazy DataFrame. All commands here only read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import patterns
from lodestone.operators import duplicates, graph, python_source, relational, search, trees
from lodestone.operators import selector as select
from lodestone.sources import files, tables


class CommandError(ValueError):
    """An unknown command or parameters that do not fit."""


@dataclass(frozen=True)
class Parameter:
    """Type and default of a parameter; one without a default has to be given."""

    kind: type | tuple[type, ...]
    default: Any = ...


@dataclass(frozen=True)
class Command:
    """A builder with its parameters."""

    name: str
    parameters: Mapping[str, Parameter]
    build: Callable[..., DataFrame]

    def checked(self, given: Mapping[str, Any]) -> dict[str, Any]:
        """The parameters with defaults filled in; unknown, missing and ill-typed ones are refused."""
        if unknown := sorted(set(given) - set(self.parameters)):
            raise CommandError(f"{self.name} has no parameter {', '.join(unknown)}")
        out = {}
        for name, parameter in self.parameters.items():
            value = given.get(name, parameter.default)
            if value is ...:
                raise CommandError(f"{self.name} needs {name}")
            if value is not None and (not isinstance(value, parameter.kind) or isinstance(value, bool) and parameter.kind is int):
                raise CommandError(f"{name} of {self.name} has the wrong type")
            out[name] = value
        return out


COMMANDS: dict[str, Command] = {}
#: A source of tables: a function from a table's name to its DataFrame.
Tables = Callable[[str], DataFrame]


def command(name: str, /, **parameters: Parameter) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Enters a builder ``(tables, **parameters) -> DataFrame`` as a command."""

    def enter(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in COMMANDS:
            raise CommandError(f"{name} is there twice")
        COMMANDS[name] = Command(name, parameters, build)
        return build

    return enter


def run(source: Tables, name: str, /, **given: Any) -> DataFrame:
    """The DataFrame of a command."""
    if name not in COMMANDS:
        raise CommandError(f"unknown command {name}")
    known = COMMANDS[name]
    return known.build(source, **known.checked(given))


def run_batch(source: Tables, calls: Sequence[tuple[str, Mapping[str, Any]]]) -> list[DataFrame]:
    """Several commands; all are checked before any is built."""
    for name, given in calls:
        if name not in COMMANDS:
            raise CommandError(f"unknown command {name}")
        COMMANDS[name].checked(given)
    return [run(source, name, **given) for name, given in calls]


def parquet_tables(spark: SparkSession, folder: str) -> Tables:
    """Tables of a folder of Parquet files."""
    return lambda name: tables.read(spark, folder, name)


TEXT, NUMBER, FLAG, LIST = Parameter(str), Parameter(int), Parameter(bool, False), Parameter((list, tuple), ())


@command("select", table=TEXT, where=Parameter(dict, None), columns=LIST, order_by=LIST, limit=Parameter(int, 100), offset=Parameter(int, 0))
def _select(source, table, where, columns, order_by, limit, offset):
    return tables.select_rows(source(table), where, list(columns) or None, order_by, limit, offset)


@command("fulltext_search", query=TEXT, limit=Parameter(int, 20))
def _fulltext(source, query, limit):
    return search.top_by_rank(search.fulltext(source("documents"), "doc_id", search.index_text(F.col("text")), query), "doc_id", limit)


@command("semantic_search", vector=Parameter((list, tuple)), limit=Parameter(int, 10), backend=Parameter(str, "auto"), min_score=Parameter((int, float), None))
def _semantic(source, vector, limit, backend, min_score):
    return search.semantic(source("embeddings"), "vec_id", "embedding", vector, limit, search.vector_backend(backend), min_score)


@command("grep", pattern=TEXT, regex=FLAG, ignore_case=FLAG, max_matches=Parameter(int, 500))
def _grep(source, pattern, regex, ignore_case, max_matches):
    rows = files.lines(source("documents"), "doc_id", "text")
    return relational.grep(rows, "content", pattern, regex, ignore_case, max_matches, ["doc_id", "line"])


@command("list_pages", pattern=TEXT, page_size=Parameter(int, 50), block_position=Parameter(int, None))
def _list_pages(source, pattern, page_size, block_position):
    found = source("pages").where(patterns.path_matches(F.col("url"), pattern)).select("page_id", "url")
    return relational.page(found, ["url", "page_id"], page_size, block=block_position)


@command("list_long", most=Parameter(int, 5000))
def _list_long(source, most):
    return relational.longer_than(source("documents"), "n_chars", most, ["doc_id"]).select("doc_id", "n_chars", "exceeds_by")


@command("find_duplicates", least=Parameter(int, 2), within_source=FLAG)
def _find_duplicates(source, least, within_source):
    return duplicates.hash_groups(source("documents"), "doc_id", duplicates.normal_form(F.col("text")), least, ["source"] if within_source else [])


@command("similar_vectors", least=Parameter((int, float), duplicates.LEAST_SIMILARITY))
def _similar_vectors(source, least):
    return duplicates.similar_pairs(source("embeddings"), "vec_id", "embedding", "label", least)


@command("check_vectors")
def _check_vectors(source):
    return search.vector_statistics(source("embeddings"), "embedding", "label")


@command("timing_bottlenecks", limit=Parameter(int, 10))
def _timing(source, limit):
    return relational.timing_summary(source("events"), "event_type", "value").orderBy(F.col("total").desc()).limit(limit)


@command("view_logs", since=Parameter(str, None), until=Parameter(str, None), levels=LIST, search_text=Parameter(str, None))
def _logs(source, since, until, levels, search_text):
    events = source("events").withColumn("level", F.upper("event_type"))
    return relational.log_filter(events, "ts", "level", "props", "value", since, until, levels, search=search_text)


def _sources(source: Tables) -> DataFrame:
    """Files of Python code: a table ``sources`` (path, source)."""
    return source("sources").select("path", "source")


def _references(source: Tables) -> list[DataFrame]:
    """Imports, classes and calls of the sources, by file."""
    own = _sources(source)
    found = (python_source.imports(own, "path", "source"), python_source.classes(own, "path", "source"), python_source.usages(own, "path", "source"))
    return [frame.withColumnRenamed("doc", "file") for frame in found]


_TARGET = {"target": TEXT, "target_type": Parameter(str, None), "target_class": Parameter(str, None), "file": Parameter(str, None), "limit": Parameter(int, 100), "offset": Parameter(int, 0)}


@command("find_usages", **_TARGET)
def _find_usages(source, target, target_type, target_class, file, limit, offset):
    return graph.find_usages(*_references(source), target, target_type, target_class, file, limit, offset)


@command("find_dependencies", **_TARGET)
def _find_dependencies(source, target, target_type, target_class, file, limit, offset):
    return graph.find_dependencies(*_references(source), target, target_type, target_class, file, limit, offset)


@command("list_imports", file=Parameter(str, None))
def _list_imports(source, file):
    found = _references(source)[0]
    return found.where(F.col("file") == file) if file is not None else found


@command("select_nodes", selector=TEXT, limit=Parameter(int, 100))
def _select_nodes(source, selector, limit):
    nodes = trees.python_tree(_sources(source), "path", "source")
    return select.select(nodes, selector).orderBy("doc", "pre").limit(limit)


@command("find_nodes", node_type=Parameter(str, None), name=Parameter(str, None), qualname=Parameter(str, None), first_line=Parameter(int, None), last_line=Parameter(int, None))
def _find_nodes(source, node_type, name, qualname, first_line, last_line):
    return select.find_nodes(trees.python_tree(_sources(source), "path", "source"), node_type, name, qualname, first_line, last_line)


@command("node_at_line", line=Parameter(int), last_line=Parameter(int, None))
def _node_at_line(source, line, last_line):
    return select.node_at(trees.python_tree(_sources(source), "path", "source"), line, last_line)


@command("list_complexity", least=Parameter(int, 10))
def _list_complexity(source, least):
    return python_source.complexity(_sources(source), "path", "source", least)


@command("class_hierarchy", by_name_only=FLAG)
def _class_hierarchy(source, by_name_only):
    found = _references(source)[1].withColumn("entity", F.concat_ws("::", "file", "qualname"))
    return graph.hierarchy(found, "entity", "name", "bases", by_name_only)


@command("list_cycles", with_single=FLAG)
def _list_cycles(source, with_single):
    own, (named, _, _) = _sources(source), _references(source)
    wanted = named.where("module IS NOT NULL").select(F.col("file").alias("src"), F.concat(F.regexp_replace(F.concat_ws(".", "module", "name"), r"\.", "/"), F.lit(".py")).alias("module"))
    met = relational.path_suffix_match(wanted, own.select("path"), "module", "path")
    components = graph.strong_components(met.select("src", F.col("resolved").alias("dst")))
    return components.where("in_cycle") if with_single else graph.issues(components)


@command("structural_duplicates", least_lines=Parameter(int, 5), corpus=FLAG)
def _structural_duplicates(source, least_lines, corpus):
    return python_source.structural_duplicates(_sources(source), "path", "source", least_lines, corpus)


@command("docstring_chunks")
def _docstring_chunks(source):
    return python_source.docstring_chunks(_sources(source), "path", "source")


#: Measures of sources that report places, by the kind of their findings.
_MEASURES = {
    "placeholder": lambda own: python_source.placeholders(own, "path", "source").select("doc", "line", F.concat_ws(": ", "kind", "word").alias("what")),
    "stub": lambda own: python_source.stubs(own, "path", "source").select("doc", "line", F.concat_ws(": ", "stub", "qualname").alias("what")),
    "empty_method": lambda own: python_source.empty_methods(own, "path", "source").select("doc", "line", F.concat_ws(".", "class", "name").alias("what")),
    "late_import": lambda own: python_source.late_imports(own, "path", "source").select("doc", "line", F.concat_ws(".", "module", "name").alias("what")),
    "missing_docstring": lambda own: python_source.missing_docstrings(own, "path", "source").select("doc", "line", F.concat_ws(": ", "kind", "name").alias("what")),
}


@command("analyse", kinds=LIST, file=Parameter(str, None), summary=FLAG)
def _analyse(source, kinds, file, summary):
    if unknown := set(kinds) - set(_MEASURES):
        raise CommandError(f"analyse has no kind {', '.join(sorted(unknown))}")
    own = _sources(source)
    own = own.where(F.col("path") == file) if file is not None else own
    found = [_MEASURES[kind](own).withColumn("kind", F.lit(kind)) for kind in (kinds or _MEASURES)]
    every = reduce(DataFrame.unionByName, found)
    return relational.counts_by(every, ["doc", "kind"]) if summary else every


@command("cross_search", query=TEXT, pattern=Parameter(str, None), vector=Parameter((list, tuple), None), page_size=Parameter(int, 50), block=Parameter(int, None))
def _cross_search(source, query, pattern, vector, page_size, block):
    parts = [search.findings(search.fulltext(source("documents"), "doc_id", search.index_text(F.col("text")), query), "fulltext", "doc_id", F.col("doc_id"), F.col("rank"))]
    if pattern is not None:
        lines = relational.grep(files.lines(source("documents"), "doc_id", "text"), "content", pattern)
        parts.append(search.findings(lines, "grep", "doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("line").cast("string")), F.lit(1.0)))
    if vector is not None:
        near = search.semantic(source("embeddings"), "vec_id", "embedding", vector, page_size)
        parts.append(search.findings(near, "semantic", "vec_id", F.col("vec_id"), F.col("score")))
    return relational.page(search.numbered(*parts), [F.col("score").desc(), "result_id"], page_size, block=block)


@command("chunk_search", vector=Parameter((list, tuple)), limit=Parameter(int, 10), label=Parameter(int, None))
def _chunk_search(source, vector, limit, label):
    rows = source("embeddings")
    rows = rows.where(F.col("label") == label) if label is not None else rows
    return search.semantic(rows, "vec_id", "embedding", vector, limit)


@command("count_tokens")
def _count_tokens(source):
    return source("documents").select("doc_id", duplicates.word_count(F.col("text")).alias("words"))


@command("text_blocks", doc_id=Parameter(int))
def _text_blocks(source, doc_id):
    return trees.text_blocks(source("documents").where(F.col("doc_id") == doc_id), "doc_id", "text")


@command("json_value", path=TEXT)
def _json_value(source, path):
    return source("events").select("event_id", trees.json_value(F.col("props"), trees.dotted_path(path)).alias("value"))


@command("html_select", selector=TEXT, limit=Parameter(int, 100))
def _html_select(source, selector, limit):
    return select.select(trees.html_tree(source("pages"), "page_id", "html"), selector).orderBy("doc", "pre").limit(limit)
