"""Commands, and the queries over the sources kept with them."""

import pytest

from lodestone.plans import commands


@pytest.fixture(scope="module")
def source(spark, small_dir):
    stored = commands.parquet_tables(spark, small_dir)
    texts = [
        ("pkg/a.py", '"""Doc."""\nfrom pkg import b\n\nclass A(Base):\n    def run(self, x):\n        return b.go(x) if x else self.stop()\n    def stop(self):\n        pass\n'),
        ("pkg/b.py", "from pkg import a\ndef go(x):\n    y = a.A()\n    for i in x:\n        y.run(i)\n    return y  # TODO\nimport late\ndef gone(x):\n    z = a.A()\n    for i in x:\n        z.run(i)\n    return z\n"),
        ("pkg/c.py", "class Base:\n    \"\"\"Doc.\"\"\"\n"),
    ]
    sources = spark.createDataFrame(texts, "path string, source string")
    return lambda name: sources if name == "sources" else stored(name)


def test_commands_run(source):
    calls = [
        ("select", {"table": "nation", "where": {"n_regionkey": 1}, "order_by": ["n_name"], "limit": 3}),
        ("fulltext_search", {"query": "the"}),
        ("semantic_search", {"vector": [0.1] * 64, "limit": 3}),
        ("grep", {"pattern": "token =", "max_matches": 5}),
        ("list_pages", {"pattern": "https://*", "page_size": 2}),
        ("list_long", {}),
        ("find_duplicates", {"within_source": True}),
        ("similar_vectors", {"least": 0.3}),
        ("check_vectors", {}),
        ("timing_bottlenecks", {"limit": 2}),
        ("view_logs", {"levels": ["error"]}),
        ("find_usages", {"target": "A"}),
        ("find_dependencies", {"target": "pkg", "target_type": "module"}),
        ("list_imports", {"file": "pkg/b.py"}),
        ("select_nodes", {"selector": "class > method[name=run]"}),
        ("find_nodes", {"name": "go"}),
        ("node_at_line", {"line": 6}),
        ("list_complexity", {"least": 2}),
        ("class_hierarchy", {}),
        ("list_cycles", {}),
        ("structural_duplicates", {"corpus": True}),
        ("docstring_chunks", {}),
        ("analyse", {"kinds": ["stub", "placeholder", "late_import"]}),
        ("cross_search", {"query": "the", "pattern": "token =", "vector": [0.1] * 64, "page_size": 7, "block": 0}),
        ("chunk_search", {"vector": [0.1] * 64, "limit": 2, "label": 1}),
        ("count_tokens", {}),
        ("text_blocks", {"doc_id": 3}),
        ("json_value", {"path": "k"}),
        ("html_select", {"selector": "//p", "limit": 4}),
    ]
    assert {name for name, _ in calls} == set(commands.COMMANDS)
    counts = [frame.count() for frame in commands.run_batch(source, calls)]
    assert counts[0] == 3 and counts[2] == 3 and counts[4] == 2 and counts[9] == 2
    named = dict(zip([name for name, _ in calls], counts, strict=True))
    assert {n: named[n] for n in ("find_usages", "find_dependencies", "list_imports", "select_nodes", "find_nodes")} == {"find_usages": 2, "find_dependencies": 2, "list_imports": 2, "select_nodes": 1, "find_nodes": 1}
    assert {n: named[n] for n in ("list_complexity", "list_cycles", "structural_duplicates", "docstring_chunks")} == {"list_complexity": 3, "list_cycles": 1, "structural_duplicates": 1, "docstring_chunks": 2}
    assert {n: named[n] for n in ("analyse", "cross_search", "chunk_search", "html_select")} == {"analyse": 3, "cross_search": 7, "chunk_search": 2, "html_select": 4}


def test_findings_of_one_file(source):
    found = commands.run(source, "analyse", file="pkg/a.py").collect()
    assert {(r.kind, r.line) for r in found} == {("stub", 7), ("empty_method", 7), ("missing_docstring", 4), ("missing_docstring", 5), ("missing_docstring", 7)}
    assert {(r.kind, r.n) for r in commands.run(source, "analyse", file="pkg/a.py", summary=True).collect()} == {("stub", 1), ("empty_method", 1), ("missing_docstring", 3)}


@pytest.mark.parametrize(("name", "given"), [("drop", {}), ("grep", {}), ("grep", {"pattern": 3}), ("list_long", {"most": True}), ("list_long", {"other": 1}), ("find_usages", {}), ("analyse", {"kinds": ["none"]}), ("select_nodes", {"selector": 1}), ("cross_search", {"query": "x", "block": "1"}), ("list_cycles", {"with_single": 1})])
def test_commands_are_checked(source, name, given):
    with pytest.raises(commands.CommandError):
        commands.run(source, name, **given)
