"""Driver queries of the measures of Python sources, over sources generated from the table of parts.

Every part gives one source by a formula of its key, with all that the measures look for, on fixed
lines; so the number of sources grows with the table and SQL knows the rows to expect.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import graph, python_source, relational, selector, trees
from lodestone.plans.catalog import register
from lodestone.sources import tables
from lodestone.sources.lineage import cut

#: Lines of a source: each a text, or texts by a remainder of the key k. {k} is the key, {n} the next one, {t} the key of the module used.
_LINES: list[str | tuple[str, ...]] = [
    ('"""Module {k}."""', "# plain"),
    "import os",
    "from pkg{u} import mod{t}",
    "",
    ("class C{k}(Base):", "class C{k}(Base, C{n}):", "class C{k}(Base):", "class C{k}(Base):"),
    ('    """Class."""', "    size = 1", "    size = 1"),
    "    def run(self, x):",
    "        if x and self.ok or x > {k}:",
    "            return mod{t}.go(x)",
    "        return self.inner.stub(x)",
    "",
    "    def stub(self):",
    ("        pass", "        ...", "        raise NotImplementedError", "        return None"),
    "",
    "def go(x):",
    "    total = {k}",
    "    for i in x:",
    "        total += i",
    "    return C{k}(total)",
    "",
    ("async def twin(y):", *["def twin(y):"] * 6),
    "    out = 7",
    "    for j in y:",
    "        out += j",
    ("    return out", *["    return D(out)"] * 4),
    ("x = 1", "import late", "x = 1"),
]
#: The module that a source uses: the next one; in even tens the last uses the first, in odd ones none but itself.
_USED = "CASE WHEN p_partkey % 10 < 9 THEN p_partkey + 1 WHEN p_partkey // 10 % 2 = 0 THEN p_partkey - 9 ELSE p_partkey END"
_P = f"WITH p AS (SELECT p_partkey AS k, 'pkg' || (p_partkey % 10) || '/mod' || p_partkey || '.py' AS doc, {_USED} AS t FROM part)"


#: Parts whose sources one task parses; reading a part takes next to nothing of the time that parsing its source does.
PARTS_A_TASK = 4_000


def _parts(spark, sf_dir):
    """Keys of the parts, dealt out for parsing: in their file they are so small that one task would read most of them."""
    parts = tables.read(spark, sf_dir, "part").select("p_partkey")
    return parts.repartition(max(spark.sparkContext.defaultParallelism, -(-parts.count() // PARTS_A_TASK)))


def _sources(spark, sf_dir):
    k = F.col("p_partkey")
    tens = F.floor(k / 10)
    used = F.when(k % 10 < 9, k + 1).when(tens % 2 == 0, k - 9).otherwise(k)
    values = {"{k}": k, "{n}": k + 1, "{t}": used, "{u}": used % 10}

    def filled(line: str):
        out = F.lit(line)
        for mark, value in values.items():
            if mark in line:
                out = F.replace(out, F.lit(mark), value.cast("string"))
        return out

    lines = []
    for line in _LINES:
        forms = [line] if isinstance(line, str) else line
        column = filled(forms[0])
        for remainder, form in enumerate(forms[1:], 1):
            column = F.when(k % len(forms) == remainder, filled(form)).otherwise(column)
        lines.append(column)
    path = F.concat(F.lit("pkg"), (k % 10).cast("string"), F.lit("/mod"), k.cast("string"), F.lit(".py"))
    return _parts(spark, sf_dir).select(path.alias("path"), F.concat_ws("\n", *lines).alias("source"))


_DEFINITIONS = """(SELECT doc, 'class' AS kind, 'C' || k AS name, 'C' || k AS qualname, 5 AS start_line, 13 AS end_line FROM p UNION ALL SELECT doc, 'method', 'run', 'C' || k || '.run', 7, 10 FROM p
    UNION ALL SELECT doc, 'method', 'stub', 'C' || k || '.stub', 12, 13 FROM p UNION ALL SELECT doc, 'function', 'go', 'go', 15, 19 FROM p UNION ALL SELECT doc, 'function', 'twin', 'twin', 21, 25 FROM p)"""


def _nodes(spark, sf_dir, kinds=None):
    return trees.python_tree(_sources(spark, sf_dir), "path", "source", kinds)


@register("python_nodes", _P + f""" SELECT * FROM {_DEFINITIONS} UNION ALL SELECT doc, 'module', NULL, NULL, 1, 26 FROM p UNION ALL SELECT doc, 'import', NULL, NULL, 2, 2 FROM p
    UNION ALL SELECT doc, 'import', NULL, NULL, 3, 3 FROM p UNION ALL SELECT doc, 'import', NULL, NULL, 26, 26 FROM p WHERE k % 3 = 1""")
def python_nodes(spark, sf_dir):
    kinds = ["module", "class", "method", "function", "import"]
    return _nodes(spark, sf_dir, kinds).select("doc", "kind", "name", "qualname", "start_line", "end_line")


@register("python_node_counts", _P + " SELECT doc, 2 AS n_loops, 1 AS n_tests, 2 + (k % 3 <> 0)::INT + (k % 3 <> 1)::INT AS n_assigned FROM p")
def python_node_counts(spark, sf_dir):
    count = lambda name, *types: F.count_if(F.col("node_type").isin(*types)).alias(name)
    return _nodes(spark, sf_dir).groupBy("doc").agg(count("n_loops", "For"), count("n_tests", "If"), count("n_assigned", "Assign"))


@register("python_select", _P + f" SELECT doc, qualname, start_line, end_line FROM {_DEFINITIONS} WHERE kind = 'method'")
def python_select(spark, sf_dir):
    return selector.select(_nodes(spark, sf_dir), "class > method").select("doc", "qualname", "start_line", "end_line")


#: Selectors with the definitions that they pick.
_FORMS = {
    "//FunctionDef[@name='stub']": "name = 'stub'",
    "//ClassDef//FunctionDef": "kind = 'method'",
    "class[@name^=C] > method[@start_line>=12]": "name = 'stub'",
    "method:nth(1):first": "name = 'stub'",
    "method:last:first": "name = 'stub'",
    "method:first:nth(1)": "false",
    "class:not(class > method)": "kind = 'class'",
    "method:not(method[name=run])": "name = 'stub'",
    "method:not(method:first)": "false",
    "Class:* method:first": "name = 'run'",
    "Def:*[name~=wi]": "name = 'twin'",
}


@register("select_forms", _P + " " + " UNION ALL ".join(f"""SELECT '{form.replace("'", "''")}' AS form, doc, qualname FROM {_DEFINITIONS} WHERE {test}""" for form, test in _FORMS.items()))
def select_forms(spark, sf_dir):
    """Every form of selector over one written node table."""
    nodes = cut(_nodes(spark, sf_dir, ["module", "class", "method", "function"]))
    found = [selector.select(nodes, form).select(F.lit(form).alias("form"), "doc", "qualname") for form in _FORMS]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


@register("complexity_report", _P + " SELECT doc, 'C' || k || '.run' AS qualname, 7 AS line, 4 AS complexity FROM p UNION ALL SELECT doc, 'go', 15, 2 FROM p UNION ALL SELECT doc, 'twin', 21, 2 FROM p")
def complexity_report(spark, sf_dir):
    return python_source.complexity(_sources(spark, sf_dir), "path", "source", 2)


@register("stub_functions", _P + " SELECT doc, 'C' || k || '.stub' AS qualname, 12 AS line, 'method' AS kind, CASE k % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'ellipsis' ELSE 'return_none' END AS stub FROM p WHERE k % 4 <> 2")
def stub_functions(spark, sf_dir):
    return python_source.stubs(_sources(spark, sf_dir), "path", "source")


@register("empty_methods", _P + " SELECT doc, 'C' || k AS class, 'stub' AS name, 12 AS line, CASE k % 4 WHEN 0 THEN 'pass' ELSE 'ellipsis' END AS body FROM p WHERE k % 4 < 2")
def empty_methods(spark, sf_dir):
    return python_source.empty_methods(_sources(spark, sf_dir), "path", "source")


@register("late_imports", _P + " SELECT doc, 26 AS line, 'late' AS name, NULL AS module, 'import' AS import_type FROM p WHERE k % 3 = 1")
def late_imports(spark, sf_dir):
    return python_source.late_imports(_sources(spark, sf_dir), "path", "source")


@register("missing_docstrings", _P + f""" SELECT doc, 'file' AS kind, '' AS name, 1 AS line FROM p WHERE k % 2 = 1 UNION ALL SELECT doc, 'class', 'C' || k, 5 FROM p WHERE k % 3 <> 0
    UNION ALL SELECT doc, kind, qualname, start_line FROM {_DEFINITIONS} WHERE kind <> 'class'""")
def missing_docstrings(spark, sf_dir):
    return python_source.missing_docstrings(_sources(spark, sf_dir), "path", "source")


#: Sources that take every branch of the measures: a part with key k has the form of its remainder, with its key for {k}.
_FORMS_OF_SOURCE = (
    '''class A(ABC):
    """Doc."""
    @abstractmethod
    def one(self):
        return None
    def two(self):
        pass
    def three(self):
        """Only words {k}."""
        pass''',
    '''"""Top {k}."""
import os
"loose"
import sys, re as r
def outer():
    """Says {k}."""
    import json
    def inner():
        ...
    return inner
from pkg{k} import b, c as d
class B:
    @property
    def p(self):
        return 1
    def q(self):
        "words"
    class N:
        def m(self):
            raise NotImplementedError
        def n(self):
            raise NotImplementedError("no")''',
    '''import a
"text"
from . import z{k}''',
    '''def f():
    return
def g():
    return None
async def h():
    pass
class E:
    pass
class D(E):
    """ """
    def one(self):
        ...
    async def two(self):
        """Text."""
    def three(self): pass
    if True:
        def four(self):
            pass
    @staticmethod
    def five():
        x = {k}''',
    '''"""A stub of {k}; todo"""
x = "fix me, no bug"  # note {k}
def f():
    """Hack
    XXX"""
    # todos, notes and NOTE_1 are other words
    return f"{x} not implemented"  #FIXME''',
    "x = = {k}  # TODO twice: todo",
    "def broken(:  # TODO {k}",
    "",
)
_B = f"WITH p AS (SELECT p_partkey AS k, p_partkey % {len(_FORMS_OF_SOURCE)} AS form, 'b/mod' || p_partkey || '.py' AS doc FROM part)"


def _expected(columns: str, rows: str) -> str:
    """SQL of the rows that the sources of a form give; texts may have the key for {k}."""
    names = columns.split(", ")
    filled = ", ".join(f"replace({n}, '{{k}}', k::VARCHAR) AS {n}" if n not in ("line", "binding_level") else n for n in names)
    return f"{_B} SELECT doc, {filled} FROM p JOIN (VALUES {rows}) AS v(form, {columns}) USING (form)"


def _branches(spark, sf_dir):
    k = F.col("p_partkey")
    source = F.lit(None).cast("string")
    for remainder, form in enumerate(_FORMS_OF_SOURCE):
        source = F.when(k % len(_FORMS_OF_SOURCE) == remainder, F.replace(F.lit(form), F.lit("{k}"), k.cast("string"))).otherwise(source)
    return _parts(spark, sf_dir).select(F.concat(F.lit("b/mod"), k.cast("string"), F.lit(".py")).alias("path"), source.alias("source"))


@register("stub_branches", _expected("qualname, line, kind, stub", """(0, 'A.two', 6, 'method', 'pass'), (1, 'outer.inner', 8, 'function', 'ellipsis'), (1, 'B.N.n', 21, 'method', 'not_implemented'),
    (3, 'g', 3, 'function', 'return_none'), (3, 'h', 5, 'function', 'pass'), (3, 'D.one', 11, 'method', 'ellipsis'), (3, 'D.three', 15, 'method', 'pass'), (3, 'D.four', 17, 'function', 'pass')"""))
def stub_branches(spark, sf_dir):
    return python_source.stubs(_branches(spark, sf_dir), "path", "source")


@register("empty_method_branches", _expected("class, name, line, body", "(1, 'B', 'q', 16, 'docstring_only'), (3, 'D', 'one', 11, 'ellipsis'), (3, 'D', 'two', 13, 'docstring_only'), (3, 'D', 'three', 15, 'pass')"))
def empty_method_branches(spark, sf_dir):
    return python_source.empty_methods(_branches(spark, sf_dir), "path", "source")


@register("late_import_branches", _expected("line, name, module, import_type", "(1, 11, 'b', 'pkg{k}', 'import_from'), (1, 11, 'c', 'pkg{k}', 'import_from'), (2, 1, 'a', NULL, 'import'), (2, 3, 'z{k}', NULL, 'import_from')"))
def late_import_branches(spark, sf_dir):
    return python_source.late_imports(_branches(spark, sf_dir), "path", "source")


@register("missing_docstring_branches", _expected("kind, name, line", """(0, 'file', '', 1), (0, 'method', 'A.one', 4), (0, 'method', 'A.two', 6), (1, 'class', 'B', 12), (1, 'class', 'N', 18), (1, 'method', 'N.m', 19), (1, 'method', 'N.n', 21),
    (2, 'file', '', 1), (3, 'file', '', 1), (3, 'function', 'f', 1), (3, 'function', 'g', 3), (3, 'function', 'h', 5), (3, 'class', 'E', 7), (3, 'class', 'D', 9), (3, 'method', 'D.one', 11), (3, 'method', 'D.three', 15), (3, 'method', 'D.five', 20), (7, 'file', '', 1)"""))
def missing_docstring_branches(spark, sf_dir):
    return python_source.missing_docstrings(_branches(spark, sf_dir), "path", "source")


@register("docstring_chunk_branches", _expected("qualname, binding_level, line, chunk", """(0, 'A', 2, 1, 'Doc.'), (0, 'A.three', 3, 8, 'Only words {k}.'), (1, '', 1, 1, 'Top {k}.'), (1, 'outer', 3, 5, 'Says {k}.'), (1, 'B.q', 3, 16, 'words'),
    (3, 'D.two', 3, 13, 'Text.'), (4, '', 1, 1, 'A stub of {k}; todo'), (4, 'f', 3, 3, 'Hack' || chr(10) || 'XXX')"""))
def docstring_chunk_branches(spark, sf_dir):
    return python_source.docstring_chunks(_branches(spark, sf_dir), "path", "source")


@register("source_placeholders", _expected("kind, line, word, text, context", """(4, 'comment', 2, 'NOTE', '# note {k}', 'x = "fix me, no bug"  # note {k}'), (4, 'comment', 7, 'FIXME', '#FIXME', '    return f"{x} not implemented"  #FIXME'),
    (4, 'docstring', 1, 'STUB', 'A stub of {k}; todo', 'QQQA stub of {k}; todoQQQ'), (4, 'docstring', 3, 'HACK', 'Hack' || chr(10) || '    XXX', 'def f():'), (4, 'string', 1, 'STUB', 'A stub of {k}; todo', 'QQQA stub of {k}; todoQQQ'),
    (4, 'string', 2, 'BUG', 'fix me, no bug', 'x = "fix me, no bug"  # note {k}'), (4, 'string', 4, 'HACK', 'Hack' || chr(10) || '    XXX', '    QQQHack'), (4, 'string', 7, 'NOT IMPLEMENTED', ' not implemented', '    return f"{x} not implemented"  #FIXME'),
    (5, 'comment', 1, 'TODO', '# TODO twice: todo', 'x = = {k}  # TODO twice: todo')""".replace("QQQ", 3 * '"')))
def source_placeholders(spark, sf_dir):
    return python_source.placeholders(_branches(spark, sf_dir), "path", "source")


_USAGES = """(SELECT doc, k, 'go' AS name, 'method' AS target_type, 'call' AS usage, NULL AS target_class, 'class:C' || k || ' | function:run' AS context, 9 AS line FROM p
    UNION ALL SELECT doc, k, 'stub', 'method', 'call', 'C' || k, 'class:C' || k || ' | function:run', 10 FROM p UNION ALL SELECT doc, k, 'C' || k, 'class', 'instantiation', NULL, 'function:go', 19 FROM p
    UNION ALL SELECT doc, k, 'D', 'class', 'instantiation', NULL, 'function:twin', 25 FROM p WHERE k % 5 <> 0)"""
_IMPORTS = """(SELECT doc, 2 AS line, 'os' AS name, NULL AS module FROM p UNION ALL SELECT doc, 3, 'mod' || t, 'pkg' || (t % 10) FROM p UNION ALL SELECT doc, 26, 'late', NULL FROM p WHERE k % 3 = 1)"""


def _usages(spark, sf_dir):
    return python_source.usages(_sources(spark, sf_dir), "path", "source")


def _references(spark, sf_dir):
    """Imports, classes and usages under the names that the searches take."""
    own = _sources(spark, sf_dir)
    parts = (python_source.imports(own, "path", "source"), python_source.classes(own, "path", "source"), _usages(spark, sf_dir))
    return [p.withColumnRenamed("doc", "file") for p in parts]


@register("usage_extraction", _P + f" SELECT doc, name, target_type, usage, target_class, context, line FROM {_USAGES}")
def usage_extraction(spark, sf_dir):
    return _usages(spark, sf_dir)


@register("find_usages", _P + f""" SELECT 'inheritance' AS source, doc AS file, 5 AS line, 'C2' AS name, 'class' AS target_type, NULL AS target_class, 'inheritance' AS usage FROM p WHERE k % 4 = 1 AND k + 1 = 2
    UNION ALL SELECT 'usage', doc, line, name, target_type, target_class, usage FROM {_USAGES} WHERE name = 'C2'""")
def find_usages(spark, sf_dir):
    return graph.find_usages(*_references(spark, sf_dir), "C2")


@register("find_usages_page", _P + f" SELECT source, file, line, name, target_type FROM (SELECT 0 AS n, 'import' AS source, doc AS file, line, name, 'import' AS target_type FROM {_IMPORTS} WHERE name = 'late' UNION ALL SELECT 2, 'usage', doc, line, name, target_type FROM {_USAGES} WHERE name = 'late') ORDER BY n, file, line, name LIMIT 15 OFFSET 3")
def find_usages_page(spark, sf_dir):
    return graph.find_usages(*_references(spark, sf_dir), "late", limit=15, offset=3).select("source", "file", "line", "name", "target_type")


@register("find_method_usages", _P + f" SELECT doc AS file, line, target_class FROM {_USAGES} WHERE name = 'stub' AND target_class = 'C7'")
def find_method_usages(spark, sf_dir):
    return graph.find_usages(*_references(spark, sf_dir), "stub", "method", "C7").select("file", "line", "target_class")


@register("find_dependencies", _P + f""" SELECT 'import' AS source, doc AS file, line, name, NULL AS target_type, NULL AS target_class FROM {_IMPORTS} WHERE name = 'pkg3' OR contains(module, 'pkg3')
    UNION ALL SELECT 'usage', doc, line, name, target_type, target_class FROM {_USAGES} WHERE name = 'pkg3'""")
def find_dependencies(spark, sf_dir):
    return graph.find_dependencies(*_references(spark, sf_dir), "pkg3")


@register("docstring_chunks", _P + " SELECT doc, '' AS qualname, 1 AS binding_level, 1 AS line, 'Module ' || k || '.' AS chunk FROM p WHERE k % 2 = 0 UNION ALL SELECT doc, 'C' || k, 2, 5, 'Class.' FROM p WHERE k % 3 = 0")
def docstring_chunks(spark, sf_dir):
    return python_source.docstring_chunks(_sources(spark, sf_dir), "path", "source")


@register("structural_duplicates", _P + " SELECT doc, 2 AS n, 'go,twin' AS names FROM p WHERE k % 5 <> 0 AND k % 7 <> 0")
def structural_duplicates(spark, sf_dir):
    found = python_source.structural_duplicates(_sources(spark, sf_dir), "path", "source")
    return found.select("doc", "n", F.array_join(F.transform("occurrences", lambda o: o["qualname"]), ",").alias("names"))


@register("structural_duplicate_groups", _P + """, f AS (SELECT k, 'loop' AS form FROM p UNION ALL SELECT k, CASE WHEN k % 7 = 0 THEN 'async ' ELSE '' END || CASE WHEN k % 5 = 0 THEN 'plain' ELSE 'loop' END FROM p)
    SELECT count(*) AS n FROM f GROUP BY form HAVING count(*) > 1""")
def structural_duplicate_groups(spark, sf_dir):
    """Sizes of the groups over all sources, counted without listing their members."""
    hashed = python_source.structural_hashes(_sources(spark, sf_dir), "path", "source")
    return hashed.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("n")


_IMPORT_EDGES = _P + ", e AS (SELECT a.doc AS src, b.doc AS dst FROM p a JOIN p b ON a.t = b.k), whole AS (SELECT k // 10 AS ten FROM p WHERE k // 10 % 2 = 0 GROUP BY 1 HAVING count(*) = 10)"


@register("import_cycles", _IMPORT_EDGES + """ SELECT doc AS node, CASE WHEN k // 10 IN (SELECT ten FROM whole) THEN 'pkg0/mod' || (k // 10 * 10) || '.py' ELSE doc END AS component, k // 10 IN (SELECT ten FROM whole) OR k = t AS in_cycle
    FROM p WHERE doc IN (SELECT src FROM e UNION SELECT dst FROM e)""")
def import_cycles(spark, sf_dir):
    """Imports resolved to files by their path suffix, then the components of the import graph."""
    own = _sources(spark, sf_dir)
    names = python_source.imports(own, "path", "source")
    wanted = names.where("module IS NOT NULL").select(F.col("doc").alias("src"), F.concat(F.regexp_replace(F.concat_ws(".", "module", "name"), r"\.", "/"), F.lit(".py")).alias("module"))
    resolved = relational.path_suffix_match(wanted, own.select("path"), "module", "path")
    return graph.strong_components(resolved.select("src", F.col("resolved").alias("dst")))


@register("inherit_edges", _P + " SELECT a.doc || '::C' || a.k AS src, b.doc || '::C' || b.k AS dst, 'inherit' AS kind FROM p a JOIN p b ON a.k + 1 = b.k WHERE a.k % 4 = 1")
def inherit_edges(spark, sf_dir):
    found = python_source.classes(_sources(spark, sf_dir), "path", "source").withColumn("entity", F.concat_ws("::", "doc", "qualname"))
    return graph.inherit_edges(found, "entity", "name", "bases")


@register("build_cross_reference", _P + """ SELECT doc || ':10:stub' AS usage_id, doc AS file, 10 AS line, 'method:C' || k || '.stub' AS name, doc || '::C' || k || '.run' AS caller, doc || '::C' || k || '.stub' AS callee FROM p
    UNION ALL SELECT doc || ':19:C' || k, doc, 19, 'class:C' || k, doc || '::go', doc || '::C' || k FROM p""")
def build_cross_reference(spark, sf_dir):
    """Calls with the smallest definition around them and the definition that they name, same file first; methods are named with their class."""
    found = cut(python_source.definitions_and_usages(_sources(spark, sf_dir), "path", "source"))
    nodes, usages = found.where("role = 'definition'"), found.where("role = 'usage'")
    rank = F.when(F.col("kind") == "method", 0).when(F.col("kind") == "function", 1).otherwise(2)
    entity = F.concat_ws("::", "doc", "qualname")
    spans = nodes.select(entity.alias("entity"), F.col("doc").alias("file"), F.col("start_line").alias("first"), F.col("end_line").alias("last"), rank.alias("rank"))
    owned = F.when(F.col("kind") == "method", F.element_at(F.slice(F.reverse(F.split("qualname", r"\.")), 2, 1), 1))
    entities = nodes.select(entity.alias("entity"), F.col("doc").alias("file"), F.concat(F.col("kind"), F.lit(":"), F.concat_ws(".", owned, "name")).alias("name"))
    named = F.when((F.col("kind") != "method") | F.col("owner").isNotNull(), F.concat(F.col("kind"), F.lit(":"), F.concat_ws(".", "owner", "name")))
    used = usages.select(F.concat_ws(":", "doc", "start_line", "name").alias("usage_id"), F.col("doc").alias("file"), F.col("start_line").alias("line"), named.alias("name")).where("name IS NOT NULL").distinct()
    return graph.cross_reference(used, spans, entities)
