"""A small selector language over tree nodes, lowered to windows over one node table.

``step (combinator step)*`` with ``>`` (child), white space or ``//`` (below); a leading ``//`` looks
everywhere, as a leading step does. A step is a type (``*``, a kind such as ``function``, a node
type, or ``Part:*`` for types that begin or end with it), then attribute tests ``[name op value]`` or
``[@name op value]`` with ``= != ~= ^= $= > < >= <=``, then ``:first``, ``:last``, ``:nth(k)`` (from 0)
or ``:not(selector)``. Positions count over all nodes of a document that the step itself matches,
before the combinator is applied, and apply in turn: the second picks from what the first left. The
selector of a ``:not`` sees the node alone, so a combinator in it never fits and excludes nothing.

Nodes are rows (doc, pre, post, parent, depth, node_type, kind, name, qualname, start_line,
end_line, ...) numbered in pre- and post-order from 0, so that the last node below a node is
``post + depth`` and no recursion is needed. A selector reads the node table once: each step is a
window over documents (below: the greatest last node so far; child: the parent's own mark).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Names of kinds that stand for themselves in a step.
KINDS = ("module", "class", "function", "method", "stmt", "smallstmt", "import", "node")


class SelectorError(ValueError):
    """A selector that cannot be read."""


@dataclass(frozen=True)
class Test:
    """An attribute test."""

    name: str
    op: str
    value: str


@dataclass(frozen=True)
class Step:
    """A step with the combinator that leads to it."""

    combinator: str
    kind: str
    tests: tuple[Test, ...] = ()
    positions: tuple[tuple[str, int], ...] = ()
    excluded: tuple[tuple[Step, ...], ...] = ()


_BLANK = re.compile(r"\s*")
_TYPE = re.compile(r"\*|[A-Za-z_]\w*(?:\s*:\*)?")
_TEST = re.compile(r"\[\s*@?\s*(?P<attr>[A-Za-z_]\w*)\s*(?P<op>!=|~=|\^=|\$=|>=|<=|=|>|<)\s*(?P<value>\"(?:[^\"\\]|\\.)*\"|'[^']*'|[^\]\s)]+)\s*\]")
_PLACE = re.compile(r":\s*(?:(?P<edge>first|last)\b(?!\s*\()|nth\s*\(\s*(?P<nth>\d+)\s*\))", re.IGNORECASE)
_NOT = re.compile(r":\s*not\s*\(", re.IGNORECASE)


def parse(text: str) -> list[Step]:
    """Steps of a selector."""
    steps, at = _steps(text, 0, top=True)
    if at < len(text):
        raise SelectorError(f"cannot read {text[at : at + 12]!r}")
    return steps


def _steps(text: str, at: int, top: bool) -> tuple[list[Step], int]:
    """Steps from a place on, up to the end or an unmatched closing bracket, and where they end."""
    steps: list[Step] = []
    while True:
        at = _BLANK.match(text, at).end()
        if at == len(text) or text[at] == ")" and not top:
            if not steps:
                raise SelectorError("empty selector")
            return steps, at
        combinator = " " if steps else ""
        if text.startswith("//", at):
            combinator, at = combinator, at + 2
        elif text[at] == ">":
            if not steps:
                raise SelectorError("a selector cannot begin with >")
            combinator, at = ">", at + 1
        step, at = _step(text, _BLANK.match(text, at).end(), combinator)
        steps.append(step)


def _step(text: str, at: int, combinator: str) -> tuple[Step, int]:
    """One step from a place on, and where it ends: a type, then tests, then positions and exclusions."""
    begin, step = at, Step(combinator, "*")
    if m := _TYPE.match(text, at):
        step, at = replace(step, kind=re.sub(r"\s", "", m.group())), m.end()
    while m := _TEST.match(text, _BLANK.match(text, at).end()):
        value = m["value"]
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = re.sub(r"\\(.)", r"\1", value[1:-1])
        step, at = replace(step, tests=(*step.tests, Test(m["attr"], m["op"], value))), m.end()
    while True:
        ahead = _BLANK.match(text, at).end()
        if m := _PLACE.match(text, ahead):
            place = ("nth", int(m["nth"])) if m["nth"] is not None else (m["edge"].lower(), 0)
            step, at = replace(step, positions=(*step.positions, place)), m.end()
        elif m := _NOT.match(text, ahead):
            inner, at = _steps(text, m.end(), top=False)
            if at == len(text):
                raise SelectorError(":not is not closed")
            step, at = replace(step, excluded=(*step.excluded, tuple(inner))), at + 1
        elif at == begin:
            raise SelectorError(f"cannot read {text[at : at + 12]!r}" if at < len(text) else "a selector cannot end in a combinator")
        else:
            return step, at


def _type_test(kind: str) -> Column:
    part, wild = (kind[:-2].lower(), True) if kind.endswith(":*") else (kind.lower(), False)
    if part == "*":
        return F.lit(True)
    if part in KINDS:
        return F.col("kind") == part
    own = F.lower("node_type")
    return own.startswith(part) | own.endswith(part) if wild else own == part


def _attribute_test(test: Test, columns: list[str]) -> Column:
    name = {"type": "node_type"}.get(test.name.lower(), test.name.lower())
    if name not in columns:
        return F.lit(False)
    own = F.col(name).cast("string")
    if test.op in (">", "<", ">=", "<="):
        if not re.fullmatch(r"[+-]?\d+", test.value):
            return F.lit(False)
        number, value = own.try_cast("bigint"), F.lit(int(test.value))
        result = {">": number > value, "<": number < value, ">=": number >= value, "<=": number <= value}[test.op]
    else:
        result = {"=": own == test.value, "!=": own != test.value, "~=": own.contains(test.value), "^=": own.startswith(test.value), "$=": own.endswith(test.value)}[test.op]
    return F.coalesce(result, F.lit(False))


def _single(step: Step, columns: list[str]) -> Column:
    """Whether a node fits a step, positions aside."""
    out = F.coalesce(_type_test(step.kind), F.lit(False))
    for test in step.tests:
        out = out & _attribute_test(test, columns)
    for inner in step.excluded:
        # Alone, a node is the first and the last of its kind, and neither below nor child of another.
        if len(inner) == 1 and not any(k for _, k in inner[0].positions):
            out = out & ~_single(inner[0], columns)
    return out


def _mark(nodes: DataFrame, step: Step, name: str) -> DataFrame:
    """The nodes with whether a step itself picks them."""
    marked = nodes.withColumn(name, _single(step, nodes.columns))
    if not step.positions:
        return marked
    (edge, k), later = step.positions[0], step.positions[1:]
    if any(at for _, at in later):  # only one node is left to pick from
        return marked.withColumn(name, F.lit(False))
    order = F.col("pre").desc() if edge == "last" else F.col("pre").asc()
    place = F.count_if(F.col(name)).over(Window.partitionBy("doc").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("_place", place).withColumn(name, F.col(name) & (F.col("_place") == k + 1)).drop("_place")


def select(nodes: DataFrame, selector: str) -> DataFrame:
    """The nodes that a selector matches."""
    steps, columns = parse(selector), nodes.columns
    if len(steps) == 1 and not steps[0].positions:
        return nodes.where(_single(steps[0], columns))
    marked, marks = nodes, [f"_step{i}" for i in range(len(steps))]
    for step, mark in zip(steps, marks, strict=True):
        marked = _mark(marked, step, mark)
    marked = marked.withColumn("_in", F.col(marks[0]))
    for at, step in enumerate(steps[1:], 1):
        wanted = F.col("_in")
        for mark in marks[at:]:
            wanted = wanted | F.col(mark)
        marked = marked.where(wanted)
        own = F.col(marks[at])
        if step.combinator == ">":
            parent = F.struct(F.col("pre").alias("node"), F.col("_in").alias("hit"), F.lit(False).alias("child"))
            child = F.struct(F.col("parent").alias("node"), F.lit(False).alias("hit"), F.lit(True).alias("child"))
            later = F.lit(False)
            for mark in marks[at:]:
                later = later | F.col(mark)
            roles = F.filter(F.array(F.when(F.col("_in"), parent), F.when(later, child)), lambda r: r.isNotNull())
            met = marked.withColumn("_role", F.explode(roles)).withColumn("_hit", F.max("_role.hit").over(Window.partitionBy("doc", "_role.node")))
            marked = met.where("_role.child").withColumn("_in", own & F.col("_hit")).drop("_role", "_hit")
        else:
            before = Window.partitionBy("doc").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
            reach = F.max(F.when(F.col("_in"), F.col("post") + F.col("depth"))).over(before)
            marked = marked.withColumn("_reach", reach).withColumn("_in", own & F.coalesce(F.col("_reach") >= F.col("pre"), F.lit(False))).drop("_reach")
    return marked.where("_in").select(*columns)


def require_one(found: DataFrame) -> DataFrame:
    """Per document: no_match, match or not_unique."""
    counted = found.groupBy("doc").agg(F.count("*").alias("n"))
    return counted.select("doc", "n", F.when(F.col("n") == 0, "no_match").when(F.col("n") == 1, "match").otherwise("not_unique").alias("verdict"))


def find_nodes(nodes: DataFrame, node_type: str | None = None, name: str | None = None, qualname: str | None = None, first_line: int | None = None, last_line: int | None = None) -> DataFrame:
    """Nodes by exact type, name and qualified name, and by bounds of their lines."""
    tests = [(F.col("node_type") == node_type, node_type), (F.col("name") == name, name), (F.col("qualname") == qualname, qualname), (F.col("start_line") >= first_line if first_line is not None else None, first_line), (F.col("end_line") <= last_line if last_line is not None else None, last_line)]
    for test, given in tests:
        if given is not None:
            nodes = nodes.where(test)
    return nodes


def node_at(nodes: DataFrame, first_line: int, last_line: int | None = None) -> DataFrame:
    """Per document the node with just these lines, else the smallest that holds them, the earlier start first."""
    last_line = first_line if last_line is None else last_line
    held = nodes.where((F.col("start_line") <= first_line) & (F.col("end_line") >= last_line))
    order = F.struct(~((F.col("start_line") == first_line) & (F.col("end_line") == last_line)), F.col("end_line") - F.col("start_line"), "start_line", "pre")
    return held.groupBy("doc").agg(F.min_by("pre", order).alias("pre"))


def nodes_touching(nodes: DataFrame, first_line: int, last_line: int) -> DataFrame:
    """Nodes whose lines meet the given ones."""
    return nodes.where((F.col("start_line") <= last_line) & (F.col("end_line") >= first_line))
