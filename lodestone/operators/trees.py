"""Node tables of JSON, YAML-like, HTML and Python texts."""

from __future__ import annotations

import ast
import gc
import hashlib
import json
import re
from collections.abc import Callable, Collection, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "pre long, post long, parent long, depth int, node_type string, kind string, name string, qualname string, start_line int, end_line int"
JSON_SCHEMA = "pre long, parent long, pointer string, key string, position long, kind string, value string, node_id string"
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())


#: Rows that a parser's task holds before it sends them on.
ROWS_AT_ONCE = 20_000
#: New objects after which it looks for cycles: trees are freed without, and to look as often as usual takes a third of its time.
OBJECTS_AT_ONCE = 50_000


def exploded(df: DataFrame, key: str, text: str, schema: str, nodes_of: Callable[[str], list[tuple]]) -> DataFrame:
    """The rows that a parser makes of each text, beside the text's key (as ``doc``)."""
    kind = df.schema[key].dataType.simpleString()
    names = ["doc", *[part.split()[0] for part in schema.split(", ")]]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rates = gc.get_threshold()
        gc.set_threshold(OBJECTS_AT_ONCE, *rates[1:])
        try:
            for frame in batches:
                out: list[tuple] = []
                for k, t in zip(frame[key], frame[text], strict=True):
                    if t is not None:
                        out += [(k, *node) for node in nodes_of(t)]
                    if len(out) >= ROWS_AT_ONCE:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                yield pd.DataFrame(out, columns=names)
        finally:
            gc.set_threshold(*rates)

    return df.select(key, text).mapInPandas(rows, f"doc {kind}, {schema}")


def escape(part: str) -> str:
    """A key as a part of a pointer."""
    return part.replace("~", "~0").replace("/", "~1")


def pointer_parts(pointer: str) -> list[str]:
    """The keys of a pointer."""
    return [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]


def dotted_path(path: str) -> str:
    """A Spark variant path of ``a.b.0``; parts of digits are array indices."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("."))


def pointer_path(pointer: str) -> str:
    """A Spark variant path of a pointer."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in pointer_parts(pointer))


def json_value(text: Column, path: str, kind: str = "string") -> Column:
    """A value of a JSON text by variant path; null where text or path do not fit."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)


def json_nodes(text: str) -> list[tuple]:
    """Pre-order nodes of a JSON text; none if it cannot be read."""
    try:
        root = json.loads(text)
    except ValueError:
        return []
    out: list[tuple] = []
    stack: list[tuple] = [(root, None, "", None, None)]
    while stack:
        value, parent, pointer, key, position = stack.pop()
        pre = len(out)
        kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, int | float) else "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"
        plain = None if kind in ("array", "object", "null") else json.dumps(value) if kind != "string" else value
        out.append((pre, parent, pointer, key, position, kind, plain, hashlib.sha256(pointer.encode("utf-8", "surrogatepass")).hexdigest()[:16]))
        if kind == "object":
            stack += [(v, pre, f"{pointer}/{escape(k)}", k, None) for k, v in reversed(value.items())]
        elif kind == "array":
            stack += [(v, pre, f"{pointer}/{i}", None, i) for i, v in reversed(list(enumerate(value)))]
    return out


def flatten_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """Nodes of JSON texts with pointer, kind, parent, key or position, and an id that follows from the pointer."""
    return exploded(df, key, text, JSON_SCHEMA, json_nodes)


def yaml_nodes(text: str) -> list[tuple]:
    """Blocks of simple YAML: mappings, list items and scalars by indentation, with the lines that they span."""
    lines = text.split("\n")
    heads = []
    for number, line in enumerate(lines, 1):
        body = line.strip()
        if body and not body.startswith("#"):
            heads.append((len(line) - len(line.lstrip()), number, body))
    out: list[list] = []
    open_nodes: list[tuple[int, int]] = []
    for at, (indent, number, body) in enumerate(heads):
        item = body.startswith("- ") or body == "-"
        while open_nodes and (open_nodes[-1][0] > indent or open_nodes[-1][0] == indent):
            open_nodes.pop()
        parent = open_nodes[-1][1] if open_nodes else None
        name = None if item else body.split(":", 1)[0].strip() if ":" in body else None
        kind = "item" if item else "pair" if name is not None else "scalar"
        end = next((n - 1 for i, n, _ in heads[at + 1 :] if i <= indent), len(lines))
        out.append([at, 0, parent, len(open_nodes), kind, kind, name, name, number, end])
        open_nodes.append((indent, at))
    return _with_post(out)


def _with_post(rows: list[list]) -> list[tuple]:
    children: dict[int | None, list[int]] = {}
    for row in rows:
        children.setdefault(row[2], []).append(row[0])
    post = 0
    stack = [(r, False) for r in reversed(children.get(None, []))]
    while stack:
        node, closed = stack.pop()
        if closed:
            rows[node][1] = post
            post += 1
        else:
            stack.append((node, True))
            stack += [(c, False) for c in reversed(children.get(node, []))]
    return [tuple(r) for r in rows]


class _Tags(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        pre = len(self.rows)
        line = self.getpos()[0]
        known = dict(attrs)
        self.rows.append([pre, 0, self.open[-1] if self.open else None, len(self.open), tag, "node", known.get("id") or known.get("class") or known.get("href"), None, line, line])
        if tag not in VOID_TAGS:
            self.open.append(pre)

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[at]][4] == tag:
                for pre in self.open[at:]:
                    self.rows[pre][9] = self.getpos()[0]
                del self.open[at:]
                return


def html_nodes(text: str) -> list[tuple]:
    """Nodes of the tags of a page; tags that are never closed end with what is around them."""
    parser = _Tags()
    parser.feed(text)
    parser.close()
    return _with_post(parser.rows)


def html_tree(df: DataFrame, key: str, text: str) -> DataFrame:
    """Tag nodes of pages."""
    return exploded(df, key, text, NODE_SCHEMA, html_nodes)


def _kind(node: ast.AST, parent: ast.AST | None) -> str:
    own = _KINDS.get(type(node))
    if own is None:
        own = _KINDS[type(node)] = _kind_of_type(type(node))
    return "method" if own == "function" and isinstance(parent, ast.ClassDef) else own


#: Kinds of types met so far.
_KINDS: dict[type, str] = {}


def _kind_of_type(kind: type) -> str:
    if issubclass(kind, ast.Module):
        return "module"
    if issubclass(kind, ast.ClassDef):
        return "class"
    if issubclass(kind, ast.FunctionDef | ast.AsyncFunctionDef):
        return "function"
    if issubclass(kind, ast.Import | ast.ImportFrom):
        return "import"
    if issubclass(kind, ast.stmt):
        return "stmt" if "body" in kind._fields else "smallstmt"
    return "node"


def python_nodes(text: str, kinds: Collection[str] | None = None) -> list[tuple]:
    """Nodes of a Python source in pre-order, or those of some kinds with the numbers that they have among all; none if it cannot be parsed."""
    try:
        root = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    return nodes_of_module(root, text.count("\n") + 1, kinds)


def nodes_of_module(root: ast.Module, last_line: int, kinds: Collection[str] | None = None) -> list[tuple]:
    """``python_nodes`` of a source that is parsed already."""
    rows: list[tuple] = []
    parents: list[int | None] = []
    stack: list[tuple[ast.AST, ast.AST | None, int | None, int, tuple[str, ...]]] = [(root, None, None, 0, ())]
    while stack:
        node, parent, above, depth, scope = stack.pop()
        pre = len(parents)
        parents.append(above)
        kind = _kind(node, parent)
        if kind in ("class", "method", "function"):
            scope = (*scope, node.name)
        if kinds is None or kind in kinds:
            name = getattr(node, "name", None)
            qualname = ".".join(scope) if kind in ("class", "method", "function") else None
            rows.append((pre, above, depth, type(node).__name__, kind, name if isinstance(name, str) else getattr(node, "id", None), qualname, getattr(node, "lineno", 1), getattr(node, "end_lineno", None) or last_line))
        for field in reversed(node._fields):
            value = getattr(node, field, None)
            if isinstance(value, ast.AST):
                stack.append((value, node, pre, depth + 1, scope))
            elif isinstance(value, list):
                stack += [(child, node, pre, depth + 1, scope) for child in reversed(value) if isinstance(child, ast.AST)]
    below = [0] * len(parents)
    for pre in range(len(parents) - 1, 0, -1):
        below[parents[pre]] += below[pre] + 1
    return [(pre, pre + below[pre] - depth, above, depth, *rest) for pre, above, depth, *rest in rows]


def python_tree(df: DataFrame, key: str, text: str, kinds: Collection[str] | None = None) -> DataFrame:
    """Syntax nodes of Python sources, of some kinds if given; the others are left out before they leave the parser's task."""
    return exploded(df, key, text, NODE_SCHEMA, python_nodes if kinds is None else lambda source: python_nodes(source, kinds))


def flatten_ast(nodes: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Nodes level by level, of the given types, with the fields that a report shows."""
    found = nodes.where(F.col("node_type").isin(types)) if types else nodes
    return found.select("doc", "depth", "pre", "node_type", "name", "start_line", "end_line").orderBy("doc", "depth", "pre")


#: Fixed value: what ends a line of plain text.
TEXT_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def text_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """A block for every line of plain texts, blank ones too: its reference (lines from 0), the lines it spans (from 1), and itself.

    What follows the last break is a line only if there is something; an empty text is one empty line, a null one has none.
    """
    lines = F.split(F.col(text), TEXT_BREAK, -1)
    lines = F.when((F.size(lines) > 1) & (F.element_at(lines, -1) == ""), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    numbered = df.select(key, F.posexplode(lines).alias("n", "block"))
    place = (F.col("n") + 1).cast("long")
    return numbered.select(key, F.col("n").cast("string").alias("node_ref"), place.alias("first"), place.alias("last"), "block")


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:\s|$)")
_ITEM = re.compile(r"^ {0,3}(?:[-*+]|\d{1,9}[.)])\s")
_RULE = re.compile(r"^ {0,3}(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$")


def markdown_blocks(text: str) -> list[tuple]:
    """Blocks of a Markdown text (number, kind, level, first line, last line, content).

    Fenced code, headings (also underlined ones), rules, quotes, list items and paragraphs; a
    paragraph goes on until a blank line or the start of another block.
    """
    lines = text.split("\n")
    out: list[tuple] = []
    at = 0

    def add(kind: str, level: int, first: int, last: int) -> None:
        out.append((len(out), kind, level, first + 1, last + 1, "\n".join(lines[first : last + 1])))

    def starts_block(line: str) -> bool:
        return bool(_FENCE.match(line) or _HEADING.match(line) or _ITEM.match(line) or _RULE.match(line) or line.lstrip().startswith(">"))

    while at < len(lines):
        line, first = lines[at], at
        if not line.strip():
            at += 1
        elif fence := _FENCE.match(line):
            mark = fence.group(1)
            at += 1
            while at < len(lines) and not (lines[at].strip().startswith(mark) and not lines[at].strip().strip(mark[0])):
                at += 1
            add("fence", 0, first, min(at, len(lines) - 1))
            at += 1
        elif heading := _HEADING.match(line):
            add("heading", len(heading.group(1)), first, first)
            at += 1
        elif _RULE.match(line):
            add("rule", 0, first, first)
            at += 1
        else:
            kind = "quote" if line.lstrip().startswith(">") else "item" if _ITEM.match(line) else "paragraph"
            at += 1
            while at < len(lines) and lines[at].strip():
                under = re.fullmatch(r" {0,3}(=+|-+)\s*", lines[at])
                if kind == "paragraph" and under:
                    kind, level = "heading", 1 if under.group(1)[0] == "=" else 2
                    add(kind, level, first, at)
                    break
                if kind == "quote" and not lines[at].lstrip().startswith(">") and starts_block(lines[at]) or kind != "quote" and starts_block(lines[at]):
                    break
                at += 1
            if kind == "heading":
                at += 1
            else:
                add(kind, 0, first, at - 1)
    return out


def markdown_tree(df: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks of Markdown texts with their lines."""
    return exploded(df, key, text, "ordinal long, kind string, level int, first long, last long, block string", markdown_blocks)
