"""Quality measures and references taken from Python sources."""

from __future__ import annotations

import ast
import hashlib
import io
import re
import tokenize
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.trees import exploded, nodes_of_module
from lodestone.sources.lineage import cut

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _parsed(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError):
        return None


def _definitions(root: ast.AST) -> Iterator[tuple[ast.AST, ast.AST, str]]:
    """Functions and classes with what they stand in and their qualified name."""
    stack: list[tuple[ast.AST, ast.AST, tuple[str, ...]]] = [(child, root, ()) for child in reversed(list(ast.iter_child_nodes(root)))]
    while stack:
        node, parent, scope = stack.pop()
        if isinstance(node, (*FUNCTIONS, ast.ClassDef)):
            scope = (*scope, node.name)
            yield node, parent, ".".join(scope)
            parent = node
        stack += [(child, parent, scope) for child in reversed(list(ast.iter_child_nodes(node)))]


def _branches(node: ast.AST) -> int:
    """What a node itself adds to the complexity of what is around it."""
    if isinstance(node, ast.If | ast.For | ast.While | ast.Try | ast.ExceptHandler | ast.With | ast.IfExp):
        return 1
    if isinstance(node, ast.BoolOp):
        return len(node.values) - 1
    return len(node.cases) if isinstance(node, ast.Match) else 0


def cyclomatic(node: ast.AST) -> int:
    """One, and one for each branch: if, for, while, try, handler, with, conditional, case, and each further operand of and/or.

    Asynchronous loops and the conditions of comprehensions do not count; nested functions count in the outer one.
    """
    return 1 + sum(map(_branches, ast.walk(node)))


#: Nodes with nothing below them.
_PLAIN = (ast.Name, ast.Constant, ast.alias, ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop)


def complexities(root: ast.AST) -> list[tuple[str, int, int]]:
    """Qualified name, line and ``cyclomatic`` of every function, in one walk however deep they are nested."""
    found: list[list] = []
    weight: dict[type, bool] = {}
    stack: list[tuple[ast.AST, tuple[str, ...], tuple[int, ...]]] = [(root, (), ())]
    while stack:
        node, scope, around = stack.pop()
        kind = type(node)
        if kind not in weight:
            weight[kind] = not issubclass(kind, _PLAIN)
        if not weight[kind]:
            continue
        if more := _branches(node):
            for at in around:
                found[at][2] += more
        elif issubclass(kind, (*FUNCTIONS, ast.ClassDef)):
            scope = (*scope, node.name)
            if not issubclass(kind, ast.ClassDef):
                around = (*around, len(found))
                found.append([".".join(scope), node.lineno, 1])
        for field in reversed(node._fields):
            value = getattr(node, field, None)
            if isinstance(value, ast.AST):
                stack.append((value, scope, around))
            elif isinstance(value, list):
                stack += [(child, scope, around) for child in reversed(value) if isinstance(child, ast.AST)]
    return [tuple(f) for f in found]


def complexity(df: DataFrame, key: str, text: str, least: int = 1) -> DataFrame:
    """Complexity of every function at or over ``least``, the greatest first.

    The rows are written before they are put in order: to sample the ranges would parse every source once more.
    """

    def rows(source: str) -> list[tuple]:
        root = _parsed(source)
        return [f for f in complexities(root) if f[2] >= least] if root else []

    return cut(exploded(df, key, text, "qualname string, line int, complexity int", rows)).orderBy(F.col("complexity").desc(), "doc", "line")


def _marked(node: ast.AST, name: str) -> bool:
    """Whether a definition is decorated with a plain name."""
    return any(isinstance(d, ast.Name) and d.id == name for d in node.decorator_list)


def _methods(root: ast.AST) -> dict[ast.AST, ast.ClassDef]:
    """Functions that stand in the body of a class itself, with the class."""
    return {item: node for node in ast.walk(root) if isinstance(node, ast.ClassDef) for item in node.body if isinstance(item, FUNCTIONS)}


def stub_kind(node: ast.AST) -> str | None:
    """What the only statement of a function leaves open: pass, ellipsis, not_implemented (a call) or return_none (spelt out, and not abstract).

    A docstring is a statement like any other.
    """
    match node.body:
        case [ast.Pass()]:
            return "pass"
        case [ast.Expr(value=ast.Constant(value=value))] if value is Ellipsis:
            return "ellipsis"
        case [ast.Raise(exc=ast.Call(func=ast.Name(id="NotImplementedError")))]:
            return "not_implemented"
        case [ast.Return(value=ast.Constant(value=None))] if not _marked(node, "abstractmethod"):
            return "return_none"
    return None


def stubs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Functions and methods that do nothing, by kind; a function in the body of a class itself is a method."""

    def rows(source: str) -> list[tuple]:
        root = _parsed(source)
        methods = _methods(root) if root else {}
        found = [(q, n.lineno, "method" if n in methods else "function", stub_kind(n)) for n, _, q in _definitions(root) if isinstance(n, FUNCTIONS)] if root else []
        return [f for f in found if f[3]]

    return exploded(df, key, text, "qualname string, line int, kind string, stub string", rows)


def empty_methods(df: DataFrame, key: str, text: str, abstract: bool = False) -> DataFrame:
    """Methods whose only statement is pass, an ellipsis or a docstring; abstract ones, and those of classes based on ``ABC``, only if asked for."""

    def rows(source: str) -> list[tuple]:
        root = _parsed(source)
        out = []
        for node, owner in _methods(root).items() if root else ():
            unfinished = _marked(node, "abstractmethod") or any(isinstance(b, ast.Name) and b.id == "ABC" for b in owner.bases)
            words = isinstance(node.body[0], ast.Expr) and isinstance(node.body[0].value, ast.Constant) and isinstance(node.body[0].value.value, str)
            kind = "docstring_only" if len(node.body) == 1 and words else stub_kind(node)
            if kind in ("pass", "ellipsis", "docstring_only") and (abstract or not unfinished):
                out.append((owner.name, node.name, node.lineno, kind))
        return out

    return exploded(df, key, text, "class string, name string, line int, body string", rows)


def late_imports(df: DataFrame, key: str, text: str) -> DataFrame:
    """Names imported by statements of the module itself that do not come before its code, one row a name.

    Strings on their own are no code. A module without code has no place before it, so all of its imports are late.
    """

    def rows(source: str) -> list[tuple]:
        root = _parsed(source)
        body = root.body if root else []
        taken = [n for n in body if isinstance(n, ast.Import | ast.ImportFrom)]
        words = [n for n in body if isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str)]
        code = min((n.lineno for n in body if n not in taken and n not in words), default=0)
        late = [n for n in taken if n.lineno >= code]
        return [(n.lineno, a.name, getattr(n, "module", None), "import" if isinstance(n, ast.Import) else "import_from") for n in late for a in n.names]

    return exploded(df, key, text, "line int, name string, module string, import_type string", rows)


def missing_docstrings(df: DataFrame, key: str, text: str) -> DataFrame:
    """Modules, all classes, methods (but for properties) and the module's own functions without a docstring that says anything."""

    def rows(source: str) -> list[tuple]:
        root = _parsed(source)
        if not root:
            return []
        bare = lambda node: not (ast.get_docstring(node) or "").strip()
        named = [("file", "", 1, root)]
        named += [("class", n.name, n.lineno, n) for n in ast.walk(root) if isinstance(n, ast.ClassDef)]
        named += [("method", f"{c.name}.{n.name}", n.lineno, n) for n, c in _methods(root).items() if not _marked(n, "property")]
        named += [("function", n.name, n.lineno, n) for n in root.body if isinstance(n, FUNCTIONS)]
        return [(kind, name, line) for kind, name, line, node in named if bare(node)]

    return exploded(df, key, text, "kind string, name string, line int", rows)


#: Words that mark unfinished work.
PLACEHOLDERS = ("TODO", "FIXME", "XXX", "HACK", "NOTE", "BUG", "OPTIMIZE", "PLACEHOLDER", "STUB", "NOT IMPLEMENTED")


def placeholders(df: DataFrame, key: str, text: str, words: tuple[str, ...] = PLACEHOLDERS) -> DataFrame:
    """Comments, docstrings and strings with one of the words, whatever its case: kind, line, the first word, text and the line as it stands.

    Docstrings are reported by the line of what they belong to (the module: 1), and once more as
    strings, by their own; texts but those of comments are cut at a hundred characters. Comments are
    found in what can be split into tokens, the others in what can be parsed.
    """
    wanted = re.compile(rf"\b({'|'.join(map(re.escape, words))})\b", re.IGNORECASE)

    def rows(source: str) -> list[tuple]:
        lines, found = source.split("\n"), []
        try:
            tokens = list(tokenize.generate_tokens(io.StringIO(source).readline))
        except (tokenize.TokenError, SyntaxError):
            tokens = []
        found += [("comment", t.start[0], t.string, t.string.strip()) for t in tokens if t.type == tokenize.COMMENT]
        for node in ast.walk(root) if (root := _parsed(source)) else ():
            if isinstance(node, (*FUNCTIONS, ast.ClassDef, ast.Module)):
                found.append(("docstring", getattr(node, "lineno", 1), ast.get_docstring(node, clean=False) or "", None))
            elif isinstance(node, ast.Constant) and isinstance(node.value, str):
                found.append(("string", node.lineno, node.value, None))
        met = [(kind, line, wanted.search(own), own[:100] if shown is None else shown) for kind, line, own, shown in found]
        return [(kind, line, m[1].upper(), shown, lines[line - 1] if line <= len(lines) else "") for kind, line, m, shown in met if m]

    return exploded(df, key, text, "kind string, line int, word string, text string, context string", rows)


def _called_on(value: ast.AST, owner: str | None) -> str | None:
    """The class of a method call: the one around it if the call is on ``self`` or on what hangs from it."""
    while isinstance(value, ast.Attribute):
        value = value.value
    return owner if isinstance(value, ast.Name) and value.id == "self" else None


def usages_of(root: ast.Module) -> list[tuple]:
    """Rows of ``usages`` of one source."""
    out: list[tuple] = []
    stack: list[tuple[ast.AST, str | None, str | None]] = [(root, None, None)]
    while stack:
        node, owner, function = stack.pop()
        if isinstance(node, ast.ClassDef):
            owner = node.name
        elif isinstance(node, FUNCTIONS):
            function = node.name
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name | ast.Attribute):
            f = node.func
            context = " | ".join(f"{kind}:{name}" for kind, name in (("class", owner), ("function", function)) if name) or None
            if isinstance(f, ast.Attribute):
                out.append((f.attr, "method", "call", _called_on(f.value, owner), context, node.lineno))
            else:
                made = f.id[:1].isupper()
                out.append((f.id, "class" if made else "function", "instantiation" if made else "call", None, context, node.lineno))
        for field in node._fields:
            value = getattr(node, field, None)
            for child in value if isinstance(value, list) else (value,):
                if isinstance(child, ast.AST) and not isinstance(child, _PLAIN):
                    stack.append((child, owner, function))
    return sorted(out, key=lambda r: (r[5], r[0]))


def usages(df: DataFrame, key: str, text: str) -> DataFrame:
    """Calls of functions, of classes (a capital first) and of methods, with the class and function around them."""

    def rows(source: str) -> list[tuple]:
        root = _parsed(source)
        return usages_of(root) if root else []

    return exploded(df, key, text, "name string, target_type string, usage string, target_class string, context string, line int", rows)


def definitions_and_usages(df: DataFrame, key: str, text: str) -> DataFrame:
    """Classes, methods and functions (``role`` definition; kind, name, qualname and lines as in ``python_tree``) and ``usages`` (role usage;
    kind is the target's type, owner the target's class) of sources that are parsed once for both."""

    def rows(source: str) -> list[tuple]:
        root = _parsed(source)
        if not root:
            return []
        own = nodes_of_module(root, source.count("\n") + 1, ("class", "method", "function"))
        found = [("definition", kind, name, qualname, None, first, last) for *_, kind, name, qualname, first, last in own]
        return found + [("usage", kind, name, None, owner, line, line) for name, kind, _, owner, _, line in usages_of(root)]

    return exploded(df, key, text, "role string, kind string, name string, qualname string, owner string, start_line int, end_line int", rows)


def imports(df: DataFrame, key: str, text: str) -> DataFrame:
    """Imported names with their module (null for plain imports) and the kind of statement."""

    def rows(source: str) -> list[tuple]:
        root = _parsed(source)
        found = [n for n in ast.walk(root) if isinstance(n, ast.Import | ast.ImportFrom)] if root else []
        return [(a.name, getattr(n, "module", None), "import_from" if isinstance(n, ast.ImportFrom) else "import", n.lineno) for n in sorted(found, key=lambda n: n.lineno) for a in n.names]

    return exploded(df, key, text, "name string, module string, import_type string, line int", rows)


def classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Classes with their bases as written."""

    def rows(source: str) -> list[tuple]:
        root = _parsed(source)
        found = [(n, q) for n, _, q in _definitions(root) if isinstance(n, ast.ClassDef)] if root else []
        return [(n.name, q, [ast.unparse(b) for b in n.bases], n.lineno) for n, q in found]

    return exploded(df, key, text, "name string, qualname string, bases array<string>, line int", rows)


def docstring_chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Docstrings with what they are bound to: 1 module, 2 class, 3 function or method."""

    def rows(source: str) -> list[tuple]:
        root = _parsed(source)
        if not root:
            return []
        bound = [("", 1, 1, root), *((q, 2 if isinstance(n, ast.ClassDef) else 3, n.lineno, n) for n, _, q in _definitions(root))]
        return [(name, level, line, doc) for name, level, line, node in bound if (doc := ast.get_docstring(node))]

    return exploded(df, key, text, "qualname string, binding_level int, line int, chunk string", rows)


class _Normal(ast.NodeTransformer):
    """Variables, arguments and names of functions by first place, and values made alike by their kind.

    ``self``, ``cls``, attributes, keywords, names of classes and ``None`` stay as they are; docstrings
    are strings like any other, decorators and annotations count.
    """

    def __init__(self) -> None:
        self.known: dict[str, str] = {}

    def _alias(self, name: str) -> str:
        return self.known.setdefault(name, f"name{len(self.known)}")

    def visit_Name(self, node: ast.Name) -> ast.Name:
        return node if node.id in ("self", "cls") else ast.Name(self._alias(node.id), node.ctx)

    def visit_arg(self, node: ast.arg) -> ast.arg:
        return ast.arg(self._alias(node.arg), self.visit(node.annotation) if node.annotation else None)

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> ast.AST:
        node.name = self._alias(node.name)
        return self.generic_visit(node)

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Constant(self, node: ast.Constant) -> ast.Constant:
        if node.value is None:
            return node
        return ast.Constant("number" if isinstance(node.value, int | float | complex) else "string")


def normal_source(node: ast.AST) -> str:
    """A definition as text that does not depend on names and values."""
    return ast.dump(_Normal().visit(ast.parse(ast.unparse(node)).body[0]), annotate_fields=False)


def structural_hashes(df: DataFrame, key: str, text: str, least_lines: int = 5) -> DataFrame:
    """Hash of the normal form of every function and method of ``least_lines`` lines or more; the two never share one."""

    def rows(source: str) -> list[tuple]:
        root = _parsed(source)
        out = []
        for node, parent, qualname in _definitions(root) if root else ():
            if isinstance(node, FUNCTIONS) and node.end_lineno - node.lineno + 1 >= least_lines:
                kind = "method" if isinstance(parent, ast.ClassDef) and node in parent.body else "function"
                out.append((qualname, node.lineno, node.end_lineno, f"{kind}:{hashlib.sha256(normal_source(node).encode()).hexdigest()}"))
        return out

    return exploded(df, key, text, "qualname string, start_line int, end_line int, hash string", rows)


def structural_duplicates(df: DataFrame, key: str, text: str, least_lines: int = 5, corpus: bool = False) -> DataFrame:
    """Groups of definitions with one normal form, within each source or across all."""
    hashed = structural_hashes(df, key, text, least_lines)
    scope = [] if corpus else ["doc"]
    members = F.sort_array(F.collect_list(F.struct("doc", "start_line", "end_line", "qualname")))
    return hashed.groupBy(*scope, "hash").agg(F.count("*").alias("n"), members.alias("occurrences")).where("n > 1")
