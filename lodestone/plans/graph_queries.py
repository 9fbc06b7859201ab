"""Driver queries of the graph operators, over a graph of nations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators import graph, relational
from lodestone.plans.catalog import register
from lodestone.sources import tables

#: Each nation's two heaviest targets: customers of the source nation that buy from suppliers of the target.
_EDGES = """WITH weights AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE c_nationkey <> s_nationkey GROUP BY 1, 2), edges AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS rn FROM weights) WHERE rn <= 2)"""


def _edges(spark, sf_dir):
    li, o, c, s = (tables.read(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier"))
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, li["l_suppkey"] == s["s_suppkey"])
    weights = joined.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    w = Window.partitionBy("src").orderBy(F.col("n").desc(), "dst")
    return weights.withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("src", "dst")


def _regions(spark, sf_dir):
    return tables.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"), (F.col("n_regionkey") + 100).alias("dst"))


@register("graph_edges", _EDGES + " SELECT src, dst, 'trade' AS kind, false AS truncated FROM edges UNION ALL SELECT n_nationkey, n_regionkey + 100, 'region', false FROM nation")
def graph_edges(spark, sf_dir):
    return graph.edges_of({"trade": _edges(spark, sf_dir), "region": _regions(spark, sf_dir)})


@register("graph_nodes", _EDGES + " SELECT src AS node FROM edges UNION SELECT dst FROM edges UNION SELECT n_nationkey FROM nation UNION SELECT n_regionkey + 100 FROM nation")
def graph_nodes(spark, sf_dir):
    return graph.nodes_of(graph.edges_of({"trade": _edges(spark, sf_dir), "region": _regions(spark, sf_dir)}))


@register("graph_dot", """SELECT 'digraph regions {' || chr(10) || string_agg('  "' || n_nationkey || '" -> "' || (n_regionkey + 100) || '" [label="region"];', chr(10) ORDER BY '  "' || n_nationkey || '" -> "' || (n_regionkey + 100) || '" [label="region"];') || chr(10) || '}' AS dot FROM nation""")
def graph_dot(spark, sf_dir):
    return graph.to_dot(_regions(spark, sf_dir).withColumn("kind", F.lit("region")), "regions")


@register("graph_edges_cut", "SELECT o_custkey AS src, o_orderkey AS dst, 'order' AS kind, (SELECT count(*) FROM orders) > 500 AS truncated FROM orders ORDER BY src, dst LIMIT 500")
def graph_edges_cut(spark, sf_dir):
    """The first edges of a graph that is larger than asked for, which every edge then says."""
    return graph.edges_of({"order": tables.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))}, 500)


@register("graph_json", _EDGES + """ SELECT '{"nodes":[' || (SELECT string_agg(node, ',' ORDER BY node) FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges)) || '],"edges":['
    || (SELECT string_agg('{"src":' || src || ',"dst":' || dst || ',"kind":"trade"}', ',' ORDER BY src, dst) FROM edges) || ']}' AS json""")
def graph_json(spark, sf_dir):
    return graph.to_json(_edges(spark, sf_dir).withColumn("kind", F.lit("trade")))


@register("hierarchy_children", """SELECT n_name AS name, array_to_string(children, ',') AS children FROM nation LEFT JOIN (SELECT 'NATION_' || r_regionkey AS parent, list_sort(list(DISTINCT n_name)) AS children FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1) ON parent = n_name WHERE children IS NOT NULL""")
def hierarchy_children(spark, sf_dir):
    nation = tables.read(spark, sf_dir, "nation")
    classes = nation.select(F.col("n_nationkey").alias("file"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("pkg.NATION_"), F.col("n_regionkey").cast("string"))).alias("bases"))
    return graph.hierarchy(classes, "file", "name", "bases").where(F.size("children") > 0).select("name", F.array_join("children", ",").alias("children"))


@register("import_kinds", """SELECT page_id, CASE WHEN host IN (SELECT host FROM (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, count(*) AS n FROM pages GROUP BY 1) WHERE n > 5) THEN 'project' WHEN split_part(host, '.', 1) IN ('www', 'm') THEN 'stdlib' ELSE 'third_party' END AS kind FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages)""")
def import_kinds(spark, sf_dir):
    pages = tables.read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    known = pages.groupBy("host").count().where("count > 5").select(F.col("host").alias("resolved"))
    return pages.join(known, pages["host"] == known["resolved"], "left").select("page_id", graph.import_kind(F.col("resolved"), F.col("host"), ["www", "m"]).alias("kind"))


_WALK = _EDGES.replace("WITH weights", "WITH RECURSIVE weights")
_REACHES = """, reach(src, dst) AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src),
    nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)"""


@register("scc_components", _WALK + _REACHES + """ SELECT n.node, coalesce(least(n.node, min(a.dst)), n.node) AS component, count(a.dst) > 0 AS in_cycle
    FROM nodes n LEFT JOIN (SELECT x.src, x.dst FROM reach x JOIN reach y ON x.src = y.dst AND x.dst = y.src) a ON a.src = n.node GROUP BY n.node""")
def scc_components(spark, sf_dir):
    return graph.strong_components(_edges(spark, sf_dir))


@register("cycle_issues", _WALK + _REACHES + """, comp AS (SELECT n.node, coalesce(least(n.node, min(a.dst)), n.node) AS component FROM nodes n LEFT JOIN (SELECT x.src, x.dst FROM reach x JOIN reach y ON x.src = y.dst AND x.dst = y.src) a ON a.src = n.node GROUP BY n.node)
    SELECT 'import_cycle' AS issue_type, string_agg(node::VARCHAR, ' -> ' ORDER BY node) AS description, count(*) AS n_nodes FROM comp GROUP BY component HAVING count(*) >= 2""")
def cycle_issues(spark, sf_dir):
    return graph.issues(graph.strong_components(_edges(spark, sf_dir)))


@register("bounded_cycles", _WALK + """, walk(path, last) AS (SELECT [src, dst], dst FROM edges UNION ALL SELECT list_append(path, e.dst), e.dst FROM walk w JOIN edges e ON w.last = e.src
      WHERE len(path) < 5 AND NOT list_contains(path[1:len(path) - 1], w.last)),
    ring AS (SELECT path[1:len(path) - 1] AS r FROM walk WHERE path[1] = path[len(path)])
    SELECT DISTINCT array_to_string(list_concat(r[list_position(r, list_min(r)):], r[1:list_position(r, list_min(r)) - 1]), '>') AS cycle FROM ring""")
def bounded_cycles(spark, sf_dir):
    return graph.bounded_cycles(_edges(spark, sf_dir), 4).select(F.array_join("cycle", ">").alias("cycle"))


@register("bounded_chains", _WALK + """, walk(path, last) AS (SELECT [src, dst], dst FROM edges UNION ALL SELECT list_append(path, e.dst), e.dst FROM walk w JOIN edges e ON w.last = e.src
      WHERE len(path) < 4 AND NOT list_contains(path[1:len(path) - 1], w.last)) SELECT array_to_string(path, '>') AS path FROM walk""")
def bounded_chains(spark, sf_dir):
    return relational.chains(_edges(spark, sf_dir), 3).select(F.array_join("path", ">").alias("path"))


@register("package_boundary", _EDGES + """, e AS (SELECT src, dst, src < 10 AS a, dst < 10 AS b FROM edges) SELECT count(*) FILTER (a AND NOT b) AS n_outbound, count(DISTINCT dst) FILTER (a AND NOT b) AS n_targets, count(*) FILTER (NOT a AND b) AS n_inbound,
    CASE WHEN count(*) FILTER (a AND NOT b AND contains(dst::VARCHAR, '1')) > 0 AND count(*) FILTER (a AND NOT b AND contains(dst::VARCHAR, '2')) > 0 THEN 'mixed' WHEN count(*) FILTER (a AND NOT b AND contains(dst::VARCHAR, '1')) > 0 THEN 'internal'
    WHEN count(*) FILTER (a AND NOT b AND contains(dst::VARCHAR, '2')) > 0 THEN 'external' ELSE 'closed' END AS verdict FROM e""")
def package_boundary(spark, sf_dir):
    return graph.boundary(_edges(spark, sf_dir), F.col("src") < 10, F.col("dst") < 10, ["1"], ["2"])


@register("dependency_split", _EDGES + " SELECT src, dst, CASE WHEN dst IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN 'internal' ELSE 'external' END AS side FROM edges")
def dependency_split(spark, sf_dir):
    return graph.dependency_split(_edges(spark, sf_dir), tables.read(spark, sf_dir, "nation").where("n_regionkey = 1"), "n_nationkey")


@register("dead_code_classes", """WITH seen AS (SELECT l_partkey, max((l_returnflag <> 'R' AND l_linestatus = 'O')::INT) AS live, max((l_returnflag = 'R' AND l_linestatus = 'O')::INT) AS test, count(DISTINCT l_suppkey) FILTER (l_linestatus = 'F') AS files, max(l_suppkey) FILTER (l_linestatus = 'F') AS one FROM lineitem WHERE l_quantity > 45 GROUP BY 1),
    own AS (SELECT p_partkey, p_partkey % 50 + 1 AS file FROM part), j AS (SELECT p_partkey, live, test, coalesce(files > 1 OR one <> file, false)::INT AS imp FROM own LEFT JOIN seen ON p_partkey = l_partkey)
    SELECT p_partkey, CASE WHEN live = 1 THEN 'live' WHEN test = 1 THEN 'test_only' WHEN imp = 1 THEN 'import_only' ELSE 'unused' END AS state, CASE WHEN live = 1 THEN 3 WHEN test = 1 THEN 2 WHEN imp = 1 THEN 1 ELSE 0 END AS rank FROM j""")
def dead_code_classes(spark, sf_dir):
    """Parts as symbols, lines as uses; a supplier is a file, and imports from a symbol's own do not count."""
    part = tables.read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 50 + 1).alias("l_suppkey"))
    li = tables.read(spark, sf_dir, "lineitem").where("l_quantity > 45").withColumnRenamed("l_partkey", "p_partkey")
    found = graph.dead_code(part, li, "p_partkey", F.col("l_returnflag") == "R", F.col("l_linestatus") == "F", "l_suppkey")
    return found.drop("l_suppkey").orderBy("rank", "p_partkey")


@register("entity_neighbours", _EDGES + " SELECT DISTINCT dst AS node, 'dependency' AS side FROM edges WHERE src = 3 UNION ALL SELECT DISTINCT src, 'dependent' FROM edges WHERE dst = 3")
def entity_neighbours(spark, sf_dir):
    edges = _edges(spark, sf_dir).withColumn("kind", F.lit("trade"))
    out = graph.neighbours(edges, 3).select("node", F.lit("dependency").alias("side"))
    return out.unionByName(graph.neighbours(edges, 3, "dependents").select("node", F.lit("dependent").alias("side")))


@register("cross_reference", """WITH spans AS (SELECT user_id AS file, event_id AS entity, floor(value)::BIGINT AS a, floor(value)::BIGINT + 15 AS b, event_id % 3 AS rank FROM events WHERE event_type = 'view'),
    usages AS (SELECT event_id AS usage_id, user_id AS file, floor(value)::BIGINT AS line, event_id % 40 AS name FROM events WHERE event_type = 'click'),
    callers AS (SELECT * FROM (SELECT u.*, entity AS caller, row_number() OVER (PARTITION BY usage_id ORDER BY entity IS NULL, b - a, rank, a DESC, entity) AS rn FROM usages u LEFT JOIN spans s ON u.file = s.file AND line BETWEEN a AND b) WHERE rn = 1),
    entities AS (SELECT event_id AS callee, user_id AS f, event_id % 40 AS n FROM events WHERE event_type = 'view')
    SELECT usage_id, file, line, name, caller, callee FROM (SELECT c.*, callee, row_number() OVER (PARTITION BY usage_id ORDER BY file <> f, callee) AS k FROM callers c JOIN entities ON n = name) WHERE k = 1""")
def cross_reference(spark, sf_dir):
    events = tables.read(spark, sf_dir, "events").withColumn("x", F.floor("value").cast("long"))
    views = events.where("event_type = 'view'")
    spans = views.select(F.col("event_id").alias("entity"), F.col("user_id").alias("file"), F.col("x").alias("first"), (F.col("x") + 15).alias("last"), (F.col("event_id") % 3).alias("rank"))
    used = events.where("event_type = 'click'").select(F.col("event_id").alias("usage_id"), F.col("user_id").alias("file"), F.col("x").alias("line"), (F.col("event_id") % 40).alias("name"))
    entities = views.select(F.col("event_id").alias("entity"), F.col("user_id").alias("file"), (F.col("event_id") % 40).alias("name"))
    return graph.cross_reference(used, spans, entities)
