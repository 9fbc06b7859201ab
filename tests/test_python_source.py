"""Measures of Python sources."""

import ast

import pytest

from lodestone.operators import python_source as source
from lodestone.operators import trees

TEXT = '''"""Module."""
import abc

def branches(a, b):
    """Has branches."""
    if a and b or a:
        return 1
    for x in a:
        while x:
            x -= 1
    try:
        with open(a) as f:
            return f
    except OSError:
        pass
    match b:
        case 1:
            return 2 if a else 3
        case _:
            return 4

async def waits():
    async for x in y:
        pass
    return [z for z in x if z]

class Thing:
    @property
    def value(self):
        return self.compute()

    def empty(self):
        """Nothing."""

    @abc.abstractmethod
    def must(self):
        ...

    def todo(self):
        raise NotImplementedError("later")

    def none(self):
        import json
        return None

import late
Thing().value
'''
TWINS = '''
def first(a, b):
    total = a + 1
    for x in b:
        total += x
    return "done", total

def second(c, d):
    """Doc."""
    out = c + 2
    for item in d:
        out += item
    return "other", out

def fourth(a, b):
    total = a + 2.5
    for x in b:
        total += x
    return "", total

def third(c):
    a = 1
    b = 2
    return a + b + c
'''


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([("m", TEXT), ("t", TWINS), ("broken", "class :"), ("none", None), ("empty", "")], "f string, s string").cache()


def rows(frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.orderBy("doc", "line").collect()] if "line" in frame.columns else [tuple(r[c] for c in columns) for r in frame.collect()]


NESTED = """
def a(x):
    if x and 1 or 2:
        async def b():
            async for i in x:
                y = 1 if i else (2 if x else 3)
            class C:
                def c(self, d=lambda: 1 if 2 else 3):
                    match d:
                        case 1: pass
                        case _: pass
                    with d: return [z for z in d if z]
    try:
        pass
    except E:
        while x: pass
@(g if h else i)
def j(): pass
"""


def test_complexities_are_those_of_each_function_alone():
    from pathlib import Path

    for text in (NESTED, "", *(p.read_text() for p in Path(source.__file__).parent.glob("*.py"))):
        root = ast.parse(text)
        alone = [(q, n.lineno, source.cyclomatic(n)) for n, _, q in source._definitions(root) if isinstance(n, source.FUNCTIONS)]
        assert source.complexities(root) == alone


def test_sources_are_parsed_once(spark, tmp_path):
    frame = spark.createDataFrame([(f"{i}.py", f"def f{i}(x):\n    return x or {i}") for i in range(40)], "f string, s string").repartition(4)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    found = source.complexity(frame.mapInArrow(counted, frame.schema), "f", "s")
    assert [r.doc for r in found.collect()] == sorted(f"{i}.py" for i in range(40)) and seen.value == 40


def test_complexity(sources):
    found = dict(rows(source.complexity(sources, "f", "s").where("doc = 'm'"), "qualname", "complexity"))
    assert found["branches"] == 1 + 1 + 2 + 1 + 1 + 1 + 1 + 1 + 2 + 1
    assert found["waits"] == 1
    assert [c for _, c in rows(source.complexity(sources, "f", "s", 5), "qualname", "complexity")] == [12]


def test_stubs(sources):
    assert ("Thing.must", "ellipsis") in rows(source.stubs(sources, "f", "s"), "qualname", "stub")


def test_abstract_methods_on_request(spark):
    frame = spark.createDataFrame([("a", "class A(ABC):\n  def f(self): pass\nclass B:\n  @abstractmethod\n  def g(self): ...\n")], "f string, s string")
    assert rows(source.empty_methods(frame, "f", "s"), "name") == []
    assert rows(source.empty_methods(frame, "f", "s", abstract=True), "class", "name", "body") == [("A", "f", "pass"), ("B", "g", "ellipsis")]


def test_missing_docstrings(sources):
    assert rows(source.missing_docstrings(sources, "f", "s").where("doc = 'empty'"), "kind") == [("file",)]


def test_placeholders_of_own_words(spark):
    frame = spark.createDataFrame([("a", "x = 1  # later (a+b)\n" + "y = '" + "z" * 200 + " later'")], "f string, s string")
    found = rows(source.placeholders(frame, "f", "s", ("LATER", "a+b")), "kind", "word", "text")
    assert found == [("comment", "LATER", "# later (a+b)"), ("string", "LATER", "z" * 100)]


def test_usages(sources):
    found = rows(source.usages(sources, "f", "s").where("doc = 'm'"), "name", "target_type", "usage", "target_class", "context")
    assert ("compute", "method", "call", "Thing", "class:Thing | function:value") in found
    assert ("Thing", "class", "instantiation", None, None) in found and ("open", "function", "call", None, "function:branches") in found


def test_targets_of_method_calls(spark):
    text = "class A:\n def f(self, obj):\n  self.x.y.go()\n  obj.run()\n  self.own()\n  f().late()\nself.out()\n"
    found = rows(source.usages(spark.createDataFrame([("a", text)], "f string, s string"), "f", "s"), "name", "target_class")
    assert dict(found) == {"go": "A", "run": None, "own": "A", "f": None, "late": None, "out": None}


def test_imports_and_classes(spark):
    frame = spark.createDataFrame([("a", "import os, sys as s\nfrom . import x\nfrom a.b import c\nclass K(p.Q, R[int]): pass\n")], "f string, s string")
    assert rows(source.imports(frame, "f", "s"), "name", "module", "import_type") == [("os", None, "import"), ("sys", None, "import"), ("x", None, "import_from"), ("c", "a.b", "import_from")]
    assert rows(source.classes(frame, "f", "s"), "name", "bases") == [("K", ["p.Q", "R[int]"])]

def test_docstrings(sources):
    assert rows(source.docstring_chunks(sources, "f", "s").where("doc = 'm'"), "qualname", "binding_level") == [("", 1), ("branches", 3), ("Thing.empty", 3)]


def test_structural_duplicates(sources):
    found = source.structural_duplicates(sources, "f", "s").collect()
    assert [[o.qualname for o in r.occurrences] for r in found] == [["first", "fourth"]]


def hash_of(text):
    import ast

    return source.normal_source(ast.parse(text).body[0])


def test_normal_form():
    assert hash_of("def a(self, x):\n return x + 1.5") == hash_of("def b(self, y):\n return y + True")
    assert hash_of("def a(self):\n return self") != hash_of("def a(this):\n return this")
    assert hash_of("def a(x):\n 'doc'\n return x") != hash_of("def a(x):\n return x")
    assert hash_of("@d\ndef a(x): return x") != hash_of("def a(x): return x")
    assert hash_of("async def a(x): return x") != hash_of("def a(x): return x")
    assert hash_of("def a(x): return x.p") != hash_of("def a(x): return x.q")
    assert hash_of("def a(x: int): return x") != hash_of("def a(x): return x")
    assert hash_of("def a(x): return None") != hash_of("def a(x): return 1")
    assert hash_of("def a(x): return ...") == hash_of("def a(x): return b'1'")


def test_definitions_and_usages_are_those_taken_apart(spark):
    frame = spark.createDataFrame([("a.py", TEXT), ("b.py", NESTED), ("c.py", "x = ("), ("d.py", None)], "f string, s string")
    both = source.definitions_and_usages(frame, "f", "s").collect()
    own = trees.python_tree(frame, "f", "s").where("kind IN ('class', 'method', 'function')").collect()
    assert [(r.doc, r.kind, r.qualname, r.start_line, r.end_line) for r in both if r.role == "definition"] == [(r.doc, r.kind, r.qualname, r.start_line, r.end_line) for r in own]
    calls = source.usages(frame, "f", "s").collect()
    assert [(r.doc, r.kind, r.name, r.owner, r.start_line) for r in both if r.role == "usage"] == [(r.doc, r.target_type, r.name, r.target_class, r.line) for r in calls]
