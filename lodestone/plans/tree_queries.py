"""Driver queries of the tree and selector operators, over conversations, pages and event properties."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators import selector, trees
from lodestone.plans.catalog import register
from lodestone.sources import tables


def _turns(spark, sf_dir):
    """Conversations as trees: a root, and below it the turns in order."""
    rows = tables.read(spark, sf_dir, "conversations")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = rows.select(F.col("conv_id").alias("doc"), n.cast("long").alias("pre"), (n - 1).cast("long").alias("post"), F.lit(0).cast("long").alias("parent"), F.lit(1).alias("depth"), F.col("role").alias("node_type"), F.lit("stmt").alias("kind"), F.substring("text", 1, 10).alias("name"), F.lit(None).cast("string").alias("qualname"), F.col("turn").alias("start_line"), F.col("turn").alias("end_line"))
    roots = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("t")).select(F.col("conv_id").alias("doc"), F.lit(0).cast("long").alias("pre"), F.col("n").alias("post"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth"), F.lit("Conversation").alias("node_type"), F.lit("module").alias("kind"), F.lit("root").alias("name"), F.lit(None).cast("string").alias("qualname"), F.lit(0).cast("long").alias("start_line"), F.col("t").alias("end_line"))
    return roots.unionByName(turns)


_TURNS = "(SELECT conv_id AS doc, role, turn, substr(text, 1, 10) AS name, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pre, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS back FROM conversations)"


@register("select_children", f"SELECT doc, pre FROM {_TURNS} WHERE role = 'assistant'")
def select_children(spark, sf_dir):
    return selector.select(_turns(spark, sf_dir), "module > assistant").select("doc", "pre")


@register("select_positions", f"SELECT doc, pre, 'second' AS which FROM {_TURNS} WHERE role = 'user' AND k = 2 UNION ALL SELECT doc, pre, 'last' FROM {_TURNS} WHERE role = 'user' AND back = 1")
def select_positions(spark, sf_dir):
    nodes = _turns(spark, sf_dir)
    second = selector.select(nodes, "module user:nth(1)").select("doc", "pre", F.lit("second").alias("which"))
    return second.unionByName(selector.select(nodes, "Conversation // user:last").select("doc", "pre", F.lit("last").alias("which")))


@register("select_predicates", f"SELECT doc, pre FROM {_TURNS} WHERE name LIKE 'Th%' AND turn >= 1 AND role <> 'system' AND NOT contains(name, 'on')")
def select_predicates(spark, sf_dir):
    return selector.select(_turns(spark, sf_dir), 'module > *[name^="Th"][start_line>=1]:not(system):not(*[name~="on"])').select("doc", "pre")


@register("select_wildcard", f"SELECT doc, pre FROM {_TURNS} WHERE role LIKE 'ass%' OR role LIKE '%ass'")
def select_wildcard(spark, sf_dir):
    return selector.select(_turns(spark, sf_dir), "Ass:*").select("doc", "pre")


@register("require_one", f"SELECT doc, count(*) AS n, CASE count(*) WHEN 1 THEN 'match' ELSE 'not_unique' END AS verdict FROM {_TURNS} WHERE role = 'user' GROUP BY 1")
def require_one(spark, sf_dir):
    return selector.require_one(selector.select(_turns(spark, sf_dir), "user"))


@register("simple_node_search", f"SELECT doc, pre FROM {_TURNS} WHERE role = 'user' AND turn >= 2 AND turn <= 4")
def simple_node_search(spark, sf_dir):
    return selector.find_nodes(_turns(spark, sf_dir), node_type="user", first_line=2, last_line=4).select("doc", "pre")


@register("node_at_line", f"SELECT doc, pre FROM {_TURNS} WHERE turn = 1 UNION ALL SELECT conv_id, 0 FROM conversations GROUP BY 1 HAVING max(turn) >= 1 AND count(*) FILTER (turn = 1) = 0")
def node_at_line(spark, sf_dir):
    return selector.node_at(_turns(spark, sf_dir), 1)


@register("nodes_touching", f"SELECT doc, count(*) + 1 AS n FROM {_TURNS} WHERE turn BETWEEN 1 AND 2 GROUP BY 1")
def nodes_touching(spark, sf_dir):
    return selector.nodes_touching(_turns(spark, sf_dir), 1, 2).groupBy("doc").agg(F.count("*").alias("n"))


@register("html_blocks", r"""SELECT page_id, n, block FROM (SELECT page_id, generate_subscripts(l, 1) AS n, unnest(l) AS block FROM (SELECT page_id, regexp_extract_all(html, '<(?:h1|p)>([^<]+)', 1) AS l FROM pages))""")
def html_blocks(spark, sf_dir):
    pages = tables.read(spark, sf_dir, "pages")
    found = F.posexplode(F.regexp_extract_all("html", F.lit("<(?:h1|p)>([^<]+)"), F.lit(1))).alias("n", "block")
    return pages.select("page_id", found).withColumn("n", (F.col("n") + 1).cast("long"))


@register("html_tags", r"""SELECT page_id AS doc, (length(html) - length(replace(html, '<h1>', ''))) // 4 AS n_h1, (length(html) - length(replace(html, '<li>', ''))) // 4 AS n_li FROM pages""")
def html_tags(spark, sf_dir):
    nodes = trees.html_tree(tables.read(spark, sf_dir, "pages"), "page_id", "html")
    return nodes.groupBy("doc").agg(F.count_if(F.col("node_type") == "h1").alias("n_h1"), F.count_if(F.col("node_type") == "li").alias("n_li"))


@register("html_select", r"""SELECT page_id AS doc, (length(html) - length(replace(html, '<li><a ', ''))) // 7 AS n FROM pages""")
def html_select(spark, sf_dir):
    nodes = trees.html_tree(tables.read(spark, sf_dir, "pages"), "page_id", "html")
    return selector.select(nodes, "nav // li > a").groupBy("doc").agg(F.count("*").alias("n"))


@register("html_levels", r"""WITH t AS (SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)(<(?:script|style)[^>]*>).*?(</(?:script|style)>)', '\1\2', 'g'), '<(/?[a-zA-Z][a-zA-Z0-9]*)[^>]*>', 1) AS l FROM pages),
    u AS (SELECT page_id, generate_subscripts(l, 1) AS i, unnest(l) AS tag FROM t),
    s AS (SELECT page_id, tag, sum(CASE WHEN starts_with(tag, '/') THEN 0 ELSE 1 END) OVER w - 1 AS pre, sum(CASE WHEN starts_with(tag, '/') THEN -1 WHEN tag IN ('meta', 'link', 'br', 'img', 'hr', 'input') THEN 0 ELSE 1 END) OVER w - CASE WHEN tag IN ('meta', 'link', 'br', 'img', 'hr', 'input') THEN 0 ELSE 1 END AS depth FROM u WINDOW w AS (PARTITION BY page_id ORDER BY i))
    SELECT page_id AS doc, depth, pre, tag AS node_type FROM s WHERE tag IN ('h1', 'h2', 'p')""")
def html_levels(spark, sf_dir):
    found = trees.flatten_ast(trees.html_tree(tables.read(spark, sf_dir, "pages"), "page_id", "html"), ["h1", "h2", "p"])
    return found.select("doc", "depth", "pre", "node_type")


@register("json_pointer_find", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_pointer_find(spark, sf_dir):
    return tables.read(spark, sf_dir, "events").select("event_id", trees.json_value(F.col("props"), trees.pointer_path("/k"), "bigint").alias("k"))


@register("json_dotted_find", "SELECT event_id, event_id % 7 AS found FROM events")
def json_dotted_find(spark, sf_dir):
    nested = F.format_string('{"a": {"b": [1, {"c": %d}]}}', F.col("event_id") % 7)
    return tables.read(spark, sf_dir, "events").select("event_id", trees.json_value(nested, trees.dotted_path("a.b.1.c"), "bigint").alias("found"))


@register("json_nodes", "SELECT event_id AS doc, 0 AS pre, '' AS pointer, 'object' AS kind, NULL AS value FROM events UNION ALL SELECT event_id, 1, '/k', 'number', json_extract_string(props, '$.k') FROM events")
def json_nodes(spark, sf_dir):
    return trees.flatten_json(tables.read(spark, sf_dir, "events"), "event_id", "props").select("doc", "pre", "pointer", "kind", "value")


@register("text_blocks", r"""SELECT doc_id, (n - 1)::VARCHAR AS node_ref, n AS first, n AS last, block FROM (SELECT doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS block
    FROM (SELECT doc_id, CASE WHEN len(l) > 1 AND l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS l FROM documents)))""")
def text_blocks(spark, sf_dir):
    return trees.text_blocks(tables.read(spark, sf_dir, "documents"), "doc_id", "text")


@register("markdown_blocks", r"""SELECT doc_id AS doc, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '[#*>`~=+_|-]|[0-9]', 'x', 'g'), '\n\s*\n')) AS block FROM documents) WHERE trim(regexp_replace(block, '\s', '', 'g')) <> '' GROUP BY 1""")
def markdown_blocks(spark, sf_dir):
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[#*>`~=+_|-]|[0-9]", "x").alias("text"))
    return trees.markdown_tree(docs, "doc_id", "text").groupBy("doc").agg(F.count("*").alias("n"))
