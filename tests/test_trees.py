"""Selectors and node tables."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import selector, trees

SOURCE = '''"""Doc."""
import os

class A:
    """Class."""
    def one(self):
        return 1

    def two(self, x):
        if x:
            return os.path
        return None

async def three():
    pass

class B(A):
    def one(self):
        return 2
'''


@pytest.fixture(scope="module")
def nodes(spark):
    return trees.python_tree(spark.createDataFrame([("a", SOURCE), ("bad", "def ("), ("none", None)], "f string, t string"), "f", "t").cache()


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("class", ["A", "B"]),
        ("class > method", ["one", "two", "one"]),
        ("method:first", ["one"]),
        ("method:nth(1)", ["two"]),
        ("class:last > method", ["one"]),
        ("class[name=A] method", ["one", "two"]),
        ('method[qualname^="B."]', ["one"]),
        ("method[start_line>=9]", ["two", "one"]),
        ("function", ["three"]),
        ("AsyncFunctionDef", ["three"]),
        ("FunctionDef", ["one", "two", "one"]),
        ("Function:*", ["three"]),
        ("Def:*", ["A", "one", "two", "three", "B", "one"]),
        ("class:not(class[name=A])", ["B"]),
        ("class[missing!=x]", []),
        ("method[name!=one]", ["two"]),
        ("module // If", [None]),
        ("class[name~=B]>*[kind=method]", ["one"]),
        ("//FunctionDef[@name='two']", ["two"]),
        ("//ClassDef//FunctionDef[@name=one]", ["one", "one"]),
        ("//class[@name=A] > method", ["one", "two"]),
        ("method:nth(1):first", ["two"]),
        ("method:first:nth(1)", []),
        ("method:last:first", ["one"]),
        ("method:nth(7)", []),
        ("class:not(class > method)", ["A", "B"]),
        ("method:not(method:first)", []),
        ("method:not(method:nth(1))", ["one", "two", "one"]),
        ("class:not(class:not([name=A]))", ["A"]),
        ("class [name=A]", ["A"]),
        ("class:first [name=one]", ["one"]),
        ("class > method[name=two] return", [None, None]),
        ("class > method[name=two] Return", [None, None]),
        ("module class > method > stmt smallstmt", [None]),
        ("*[type=If]", [None]),
        ("node:first", [None]),
        ("Function:*[kind=method]", []),
    ],
)
def test_select(nodes, text, names):
    assert [r["name"] for r in selector.select(nodes, text).orderBy("doc", "pre").collect()] == names


@pytest.mark.parametrize("text", ["", "class >", "> class", "class > > method", "class:not(a", "class:not()", "class[", "class !", "class:nth", "class:first(1)", "class)", "class:last("])
def test_unreadable(text):
    with pytest.raises(selector.SelectorError):
        selector.parse(text)


def test_intervals(nodes):
    rows = {r.pre: r for r in nodes.collect()}
    for r in rows.values():
        if r.parent is not None:
            above = rows[r.parent]
            assert above.pre < r.pre and r.post < above.post
    assert sorted(r.post for r in rows.values()) == sorted(rows)


def test_node_at(nodes):
    at = selector.node_at(nodes, 9, 12).collect()
    assert [nodes.where(f"pre = {r.pre}").first()["name"] for r in at] == ["two"]


def test_json_nodes():
    rows = trees.json_nodes('{"a/b": [1, null, {"~": true}], "c": "x"}')
    assert [(r[2], r[5], r[6]) for r in rows] == [("", "object", None), ("/a~1b", "array", None), ("/a~1b/0", "number", "1"), ("/a~1b/1", "null", None), ("/a~1b/2", "object", None), ("/a~1b/2/~0", "boolean", "true"), ("/c", "string", "x")]
    assert trees.pointer_parts("/a~1b/2/~0") == ["a/b", "2", "~"]
    assert trees.json_nodes("{") == []
    assert trees.dotted_path("a.b.0") == "$['a']['b'][0]"


def test_yaml_and_html():
    rows = trees.yaml_nodes("a:\n  - x\n  - y\nb: 1\n")
    assert [(r[5], r[6], r[8], r[9]) for r in rows] == [("pair", "a", 1, 3), ("item", None, 2, 2), ("item", None, 3, 3), ("pair", "b", 4, 5)]
    tags = trees.html_nodes("<div id=x><p>a<br>b</p><li>c</div><p>d")
    assert [(r[4], r[2]) for r in tags] == [("div", None), ("p", 0), ("br", 1), ("li", 0), ("p", None)]


def test_markdown_blocks():
    text = "# Title\n\nTwo lines\nof text\n- one\n- two\n  more\n\n```py\n# no heading\n```\nUnder\n=====\n> quoted\n> on\n***\nlast\n~~~\nopen"
    assert [(r[1], r[2], r[3], r[4]) for r in trees.markdown_blocks(text)] == [
        ("heading", 1, 1, 1), ("paragraph", 0, 3, 4), ("item", 0, 5, 5), ("item", 0, 6, 7), ("fence", 0, 9, 11),
        ("heading", 1, 12, 13), ("quote", 0, 14, 15), ("rule", 0, 16, 16), ("paragraph", 0, 17, 17), ("fence", 0, 18, 19),
    ]
    assert trees.markdown_blocks("") == []


def test_text_blocks_are_all_lines(spark):
    texts = ["", "a", "a\n", "\n\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g\u2028h\u2029", " \n\tx \n", "\x1fa b"]
    frame = spark.createDataFrame([*enumerate(texts), (99, None)], "i int, t string")
    found = sorted((r.i, r.first, r.last, r.node_ref, r.block) for r in trees.text_blocks(frame, "i", "t").collect())
    assert found == [(i, n + 1, n + 1, str(n), line) for i, t in enumerate(texts) for n, line in enumerate(t.splitlines() or [""])]


def test_nodes_of_some_kinds_keep_their_numbers(spark):
    every = trees.python_nodes(SOURCE_OF_KINDS)
    for kinds in (["class", "method"], ["import", "stmt"], []):
        assert trees.python_nodes(SOURCE_OF_KINDS, kinds) == [r for r in every if r[5] in kinds]
    frame = spark.createDataFrame([(1, SOURCE_OF_KINDS), (2, "x = ("), (3, None)], "i int, s string")
    found = trees.python_tree(frame, "i", "s", ["method"])
    assert [(r.doc, r.qualname, r.pre) for r in found.collect()] == [(1, r[7], r[0]) for r in every if r[5] == "method"]


def test_sources_are_dealt_out(spark, small_dir):
    from lodestone.plans import source_queries

    assert source_queries._sources(spark, small_dir).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_selectors_on_nodes_of_some_kinds(spark):
    frame = spark.createDataFrame([(i, SOURCE_OF_KINDS) for i in range(3)], "i int, s string")
    kinds = ["module", "class", "method", "function"]
    every = trees.python_tree(frame, "i", "s").where(F.col("kind").isin(kinds))
    some = trees.python_tree(frame, "i", "s", kinds)
    for form in ("class > method", "class//function", "method:last", "//ClassDef//FunctionDef"):
        found = [sorted((r.doc, r.pre, r.post) for r in selector.select(nodes, form).collect()) for nodes in (every, some)]
        assert found[0] == found[1] and found[0]


SOURCE_OF_KINDS = """import a
class A:
    def one(self):
        if a:
            def two(): pass
        return [x for x in a]
    class B:
        async def three(self): ...
"""
