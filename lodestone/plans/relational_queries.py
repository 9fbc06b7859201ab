"""Driver queries of the relational operators, each beside its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import logs, patterns
from lodestone.operators import containment, duplicates, relational
from lodestone.plans.catalog import register
from lodestone.sources import files, tables
from lodestone.sources.lineage import scratch


def _t(spark, sf_dir, *names):
    found = [tables.read(spark, sf_dir, n) for n in names]
    return found[0] if len(found) == 1 else found


@register("select_rows", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def select_rows(spark, sf_dir):
    return tables.select_rows(_t(spark, sf_dir, "orders"), {"o_orderstatus": "O"}, ["o_orderkey", "o_custkey", "o_totalprice"], ["-o_totalprice", "o_orderkey"], 20, 5)


@register("sql_by_segment", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_mktsegment = 'HOUSEHOLD' GROUP BY 1")
def sql_by_segment(spark, sf_dir):
    statement = "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM {customer} WHERE c_mktsegment = :segment GROUP BY 1"
    return tables.run_sql(spark, {"customer": _t(spark, sf_dir, "customer")}, statement, {"segment": "HOUSEHOLD"})


@register("disk_manifest", """SELECT doc_id, len(string_split(text, chr(10))) AS lines, length(text) AS chars, sha256(text) AS checksum, false AS has_docstring FROM documents""")
def disk_manifest(spark, sf_dir):
    return files.manifest(_t(spark, sf_dir, "documents"), "doc_id", "text")


@register("document_lines", r"""SELECT doc_id, count(*) AS n_lines, count(*) FILTER (trim(content) <> '') AS n_filled, max(length(content)) AS longest
    FROM (SELECT doc_id, unnest(string_split_regex(text, '\r\n|\n|\r')) AS content FROM documents) GROUP BY 1""")
def document_lines(spark, sf_dir):
    rows = files.lines(_t(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.trim("content") != "").alias("n_filled"), F.max(F.length("content")).cast("long").alias("longest"))


@register("log_tail", "SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def log_tail(spark, sf_dir):
    return files.tail(_t(spark, sf_dir, "events"), [F.col("ts").desc(), F.col("event_id").desc()], 10).select("event_id", "event_type", "user_id")


@register("rewrite_rows", """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1.0 ELSE o_totalprice END AS price
    FROM orders WHERE o_orderstatus <> 'P'""")
def rewrite_rows(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    kept = tables.delete_rows(orders, F.col("o_orderstatus") == "P")
    return tables.update_rows(kept, F.col("o_orderstatus") == "F", {"price": F.col("price") + 1.0})


@register("upsert_latest", """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def upsert_latest(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return tables.upsert(events.limit(0), events, ["user_id", "event_type"], "event_id")


@register("insert_only", "SELECT s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def insert_only(spark, sf_dir):
    s, c = _t(spark, sf_dir, "supplier", "customer")
    return tables.insert_only(s.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")), c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")), ["key"])


@register("replace_groups", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 10 <> 0
    UNION ALL SELECT l_orderkey, 0, sum(l_quantity) FROM lineitem WHERE l_orderkey % 10 = 0 GROUP BY 1""")
def replace_groups(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    fresh = rows.where("l_orderkey % 10 = 0").groupBy("l_orderkey").agg(F.lit(0).alias("l_linenumber"), F.sum("l_quantity").alias("l_quantity"))
    return tables.replace_groups(rows, fresh, "l_orderkey")


@register("chunk_upsert", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'changed' ELSE lang END AS lang, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS version FROM documents""")
def chunk_upsert(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(1).alias("version"))
    changed = docs.where("doc_id % 5 = 0").select("doc_id", F.lit("changed").alias("lang"), F.lit(2).alias("version"))
    return tables.upsert(docs, changed, ["doc_id"], "version")


@register("active_rows", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def active_rows(spark, sf_dir):
    return _t(spark, sf_dir, "orders").where(relational.is_active(F.col("o_orderstatus") == "F")).select("o_orderkey")


@register("like_search", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%red%' ORDER BY p_name, p_partkey")
def like_search(spark, sf_dir):
    return relational.name_like(_t(spark, sf_dir, "part"), "p_name", "%red%", ["p_name", "p_partkey"]).select("p_partkey", "p_name")


@register("glob_url", "SELECT page_id, url FROM pages WHERE url GLOB 'https://*.example.org/en/*[0-9].html'")
def glob_url(spark, sf_dir):
    return _t(spark, sf_dir, "pages").where(patterns.path_matches(F.col("url"), "https://*.example.org/en/*[0-9].html")).select("page_id", "url")


@register("path_below", "SELECT page_id FROM (SELECT page_id, regexp_extract(url, '://(.*)$', 1) AS path FROM pages) WHERE path = 'thther.example.org/en' OR starts_with(path, 'thther.example.org/en/')")
def path_below(spark, sf_dir):
    path = F.regexp_extract("url", "://(.*)$", 1)
    return _t(spark, sf_dir, "pages").where(patterns.path_matches(path, "thther.example.org/en/")).select("page_id")


@register("prefix_pruned", "SELECT count(*) AS n FROM pages WHERE starts_with(url, 'https://www.')")
def prefix_pruned(spark, sf_dir):
    prefix = "https://www."
    return _t(spark, sf_dir, "pages").where(F.col("url").startswith(prefix)).agg(F.count("*").alias("n"))


@register("allowed_paths", """SELECT page_id FROM pages WHERE (url LIKE '%.html' OR url LIKE '%#top') AND NOT list_contains(string_split(url, '/'), 'de')""")
def allowed_paths(spark, sf_dir):
    return _t(spark, sf_dir, "pages").where(patterns.allowed_path(F.col("url"), [".html", "#top"], ["de"])).select("page_id")


_LINES = r"(SELECT doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS content FROM (SELECT doc_id, string_split_regex(text, '\r\n|\n|\r') AS l FROM documents))"


@register("grep_lines_literal", f"SELECT doc_id, line, substr(content, 1, 80) AS preview FROM {_LINES} WHERE contains(content, 'thing')")
def grep_lines_literal(spark, sf_dir):
    rows = files.lines(_t(spark, sf_dir, "documents"), "doc_id", "text")
    return relational.grep(rows, "content", "thing", preview=80).select("doc_id", F.col("line").cast("long").alias("line"), "preview")


@register("grep_lines_regex", f"SELECT doc_id, line, substr(content, 1, 80) AS preview FROM {_LINES} WHERE regexp_matches(content, '(?i)\\+1 \\([0-9]{{3}}\\) 555') ORDER BY doc_id, line LIMIT 500")
def grep_lines_regex(spark, sf_dir):
    rows = files.lines(_t(spark, sf_dir, "documents"), "doc_id", "text")
    return relational.grep(rows, "content", r"\+1 \([0-9]{3}\) 555", regex=True, ignore_case=True, most=500, order=["doc_id", "line"], preview=80).select("doc_id", F.col("line").cast("long").alias("line"), "preview")


@register("grep_fold_case", f"SELECT doc_id, count(*) AS n FROM {_LINES} WHERE contains(lower(content), 'license') GROUP BY 1")
def grep_fold_case(spark, sf_dir):
    rows = files.lines(_t(spark, sf_dir, "documents"), "doc_id", "text")
    return relational.grep(rows, "content", "License", ignore_case=True).groupBy("doc_id").agg(F.count("*").alias("n"))


@register("grep_budget", "SELECT doc_id, length(text) AS chars FROM documents ORDER BY doc_id LIMIT 100")
def grep_budget(spark, sf_dir):
    return relational.grep_budget(_t(spark, sf_dir, "documents"), "doc_id", 100).select("doc_id", F.length("text").alias("chars"))


@register("grep_bounded", f"""WITH looked AS (SELECT DISTINCT doc_id FROM documents ORDER BY doc_id LIMIT 400), m AS (SELECT doc_id, line, octet_length(encode(content)) AS size FROM {_LINES} WHERE doc_id IN (SELECT doc_id FROM looked) AND contains(content, 'thing')),
    c AS (SELECT doc_id, line, row_number() OVER w AS n, sum(size) OVER w AS bytes FROM m WINDOW w AS (ORDER BY doc_id, line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT doc_id, line, CASE WHEN (SELECT max(bytes) FILTER (n <= 200) FROM c) > 60000 THEN 'bytes' WHEN (SELECT count(*) FROM c) > 200 THEN 'matches' WHEN (SELECT count(DISTINCT doc_id) FROM documents) > 400 THEN 'texts' END AS exceeded FROM c WHERE n <= 200 AND bytes <= 60000""")
def grep_bounded(spark, sf_dir):
    rows = files.lines(_t(spark, sf_dir, "documents"), "doc_id", "text")
    found = relational.grep_bounded(rows, "doc_id", "content", "thing", 400, 200, 60_000)
    return found.select("doc_id", F.col("line").cast("long").alias("line"), "exceeded")


@register("freshness_verdict", """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing_index' WHEN d.doc_id % 5 = 0 AND d.doc_id % 3 = 0 THEN 'unavailable_index' WHEN d.doc_id % 5 = 1 THEN 'stale'
    WHEN d.doc_id % 3 <> 0 AND d.doc_id % 7 > 3 THEN 'stale' ELSE 'fresh' END AS verdict FROM documents d LEFT JOIN labels l USING (doc_id)""")
def freshness_verdict(spark, sf_dir):
    """Records without a checksum, without a time, with neither; disk times that are older, equal and newer."""
    docs, labels = _t(spark, sf_dir, "documents", "labels")
    both = docs.join(labels.withColumn("known", F.lit(True)), "doc_id", "left")
    now = F.sha2("text", 256)
    seen = F.when(F.col("doc_id") % 5 == 1, "other").when(F.col("doc_id") % 5 != 0, now)
    verdict = relational.freshness(F.col("known"), seen, F.when(F.col("doc_id") % 3 != 0, 103.0), now, (100 + F.col("doc_id") % 7).cast("double"))
    return both.select("doc_id", verdict.alias("verdict"))


@register("coverage_classify", """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'not_indexed' WHEN l.toxic = 1 THEN 'deleted' WHEN d.n_chars < 200 THEN 'missing_content'
    WHEN d.doc_id % 5 = 0 OR d.doc_id % 5 = 4 OR (d.doc_id % 5 = 1 AND d.doc_id % 11 = 7) OR (d.doc_id % 5 IN (2, 3) AND d.doc_id % 11 = 7) THEN 'changed_since_index' ELSE 'indexed_current' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)""")
def coverage_classify(spark, sf_dir):
    """Files that are gone (0), older than the index (1), as old (2), newer within the tolerance (3) and newer (4); some without a time in the index."""
    docs, labels = _t(spark, sf_dir, "documents", "labels")
    both = docs.join(labels.withColumn("known", F.lit(True)), "doc_id", "left")
    kind = F.col("doc_id") % 5
    disk = F.when(kind == 1, 0.5).when(kind == 2, 1.0).when(kind == 3, 1.0 + 5e-7).when(kind == 4, 1.1)
    state = relational.coverage(F.col("known"), F.col("toxic") == 1, F.when(F.col("n_chars") >= 200, 1).otherwise(0), F.when(F.col("doc_id") % 11 != 7, 1.0), disk)
    return both.select("doc_id", state.alias("state"))


@register("mtime_gate_verdict", """WITH last AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
    gate AS (SELECT a.user_id, a.value AS current, b.value AS seen FROM last a LEFT JOIN last b ON a.user_id = b.user_id AND b.rn = 2 WHERE a.rn = 1)
    SELECT user_id, CASE WHEN seen IS NULL THEN 'no_record' WHEN current > seen + 0.1 THEN 'disk_newer' WHEN abs(current - seen) <= 0.1 THEN 'equal_within_tolerance' ELSE 'disk_older' END AS reason FROM gate""")
def mtime_gate_verdict(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    last = _t(spark, sf_dir, "events").withColumn("rn", F.row_number().over(w)).withColumn("seen", F.lead("value").over(w)).where("rn = 1")
    return last.select("user_id", relational.time_gate(F.col("seen"), F.col("value")).alias("reason"))


@register("log_filter", """SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' AND upper(event_type) IN ('ERROR', 'VIEW')
    AND (regexp_matches(props, '(?i)"K": 1') OR regexp_matches(props, '(?i)"k": 2')) AND value >= 1""")
def log_filter(spark, sf_dir):
    events = _t(spark, sf_dir, "events").withColumn("level", F.upper("event_type"))
    return relational.log_filter(events, "ts", "level", "props", "value", "2024-01-05 00:00:00", "2024-01-20 00:00:00", ["error", "view"], ['"K": 1', '"k": 2'], least=1).select("event_id")


@register("long_documents", "SELECT doc_id, n_chars, n_chars - 5000 AS exceeds_by FROM documents WHERE n_chars > 5000 ORDER BY n_chars DESC, doc_id")
def long_documents(spark, sf_dir):
    return relational.longer_than(_t(spark, sf_dir, "documents"), "n_chars", 5000, ["doc_id"]).select("doc_id", "n_chars", "exceeds_by")


@register("page_of_rows", """SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total, (SELECT count(*) FROM customer) > 80 AS has_more FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 60""")
def page_of_rows(spark, sf_dir):
    return relational.page(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], 20, block=3)


@register("saved_results_page", """WITH f AS (SELECT d.doc_id, (l.quality = 0)::INT + (l.toxic = 1)::INT AS n_findings FROM documents d JOIN labels l USING (doc_id))
    SELECT doc_id, n_findings, (SELECT count(*) FROM f WHERE n_findings > 0) AS total, (SELECT count(*) FROM f WHERE n_findings > 0) > 25 AS has_more FROM f WHERE n_findings > 0 ORDER BY doc_id LIMIT 25""")
def saved_results_page(spark, sf_dir):
    docs, labels = _t(spark, sf_dir, "documents", "labels")
    results = docs.join(labels, "doc_id").select("doc_id", F.to_json(F.struct(F.filter(F.array(F.when(F.col("quality") == 0, "quality"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull()).alias("findings"))).alias("json"))
    counted = results.select("doc_id", F.size(F.try_variant_get(F.parse_json("json"), "$.findings", "array<string>")).alias("n_findings"))
    return relational.page(counted.where("n_findings > 0"), ["doc_id"], 25)


@register("structural_gate", """SELECT event_id, CASE WHEN value < 1 THEN 'too small' WHEN event_type = 'error' THEN 'error' WHEN user_id % 3 = 0 THEN 'no evidence' ELSE 'accept' END AS verdict FROM events""")
def structural_gate(spark, sf_dir):
    checks = [(F.col("value") < 1, "too small"), (F.col("event_type") == "error", "error"), (F.col("user_id") % 3 == 0, "no evidence")]
    return _t(spark, sf_dir, "events").select("event_id", relational.structural_gate(checks).alias("verdict"))


#: Line forms of a log by remainder of the event's id, with what they parse to: (line, has a stamp, level, importance, message).
_LOG_FORMS = [
    ("{s} | {e} | {i} | user {u}", True, "{e}", "stated", "user {u}"),
    ("{s} | {e} | user {u}", True, "{e}", "usual", "user {u}"),
    ("{s} - {e} - user {u}", True, "{e}", "usual", "user {u}"),
    ("{s} | INFO | high | user {u}", True, "INFO", "4", "user {u}"),
    ("free text {u}", False, "UNKNOWN", "4", "free text {u}"),
    ("{s} worker {u} got ERROR, then INFO", True, "ERROR", "8", "{s} worker {u} got ERROR, then INFO"),
    ("{s} nothing {u}", True, "UNKNOWN", "4", "{s} nothing {u}"),
    ("not a stamp | INFO | 3 | user {u}", False, "UNKNOWN", "4", "not a stamp | INFO | 3 | user {u}"),
    ("{s} |  debug | +7 |  user | {u} ", True, "debug", "7", "user | {u}"),
    ("{s} | CRITICAL | -3 | user {u}", True, "CRITICAL", "0", "user {u}"),
    ("{s}: user {u} - WARNING - x", True, "WARNING", "6", "{s}: user {u} - WARNING - x"),
]


def _log_sql(text: str) -> str:
    parts = {"{s}": "strftime(ts, '%Y-%m-%d %H:%M:%S')", "{e}": "event_type", "{u}": "user_id", "{i}": "event_id % 13"}
    out = "'" + text + "'"
    for mark, column in parts.items():
        out = out.replace(mark, f"' || ({column})::VARCHAR || '")
    return out


def _log_case(values: list[str]) -> str:
    return f"CASE event_id % {len(_LOG_FORMS)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _log_line():
    parts = {"{s}": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "{e}": F.col("event_type"), "{u}": F.col("user_id").cast("string"), "{i}": (F.col("event_id") % 13).cast("string")}
    line = F.lit(None).cast("string")
    for at, (form, *_) in enumerate(_LOG_FORMS):
        own = F.lit(form)
        for mark, column in parts.items():
            own = F.replace(own, F.lit(mark), column) if mark in form else own
        line = F.when(F.col("event_id") % len(_LOG_FORMS) == at, own).otherwise(line)
    return line


_USUAL = "CASE upper(event_type) WHEN 'DEBUG' THEN 2 WHEN 'INFO' THEN 4 WHEN 'WARNING' THEN 6 WHEN 'ERROR' THEN 8 WHEN 'CRITICAL' THEN 10 ELSE 4 END"
_IMPORTANCE = _log_case([{"stated": "least(event_id % 13, 10)", "usual": _USUAL}.get(f[3], f[3]) for f in _LOG_FORMS])
_STAMPED = ", ".join(str(i) for i, f in enumerate(_LOG_FORMS) if f[1])


@register("log_grammar", f"""SELECT event_id, CASE WHEN event_id % {len(_LOG_FORMS)} IN ({_STAMPED}) THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS stamp, {_log_case([_log_sql(f[2]) for f in _LOG_FORMS])} AS level,
    {_IMPORTANCE} AS importance, {_log_case([_log_sql(f[4]) for f in _LOG_FORMS])} AS message FROM events""")
def log_grammar(spark, sf_dir):
    parsed = _t(spark, sf_dir, "events").select("event_id", logs.parse_line(_log_line()).alias("p"))
    return parsed.select("event_id", F.date_format("p.stamp", "yyyy-MM-dd HH:mm:ss").alias("stamp"), "p.level", F.col("p.importance").cast("long").alias("importance"), "p.message")


@register("log_files", f"""SELECT level, count(*) AS n, sum(importance)::BIGINT AS importance FROM (SELECT {_log_case([_log_sql(f[2]) for f in _LOG_FORMS])} AS level, {_IMPORTANCE} AS importance FROM events) GROUP BY 1""")
def log_files(spark, sf_dir):
    """The same lines from plain and from gzip files of one folder."""
    lines = _t(spark, sf_dir, "events").select((F.col("event_id") % 2).alias("half"), _log_line().alias("value"))
    folder = scratch(spark, "logs")
    for half, codec in ((0, "none"), (1, "gzip")):
        lines.where(F.col("half") == half).select("value").write.mode("append").option("compression", codec).text(folder)
    parsed = files.log_lines(spark, folder).select(logs.parse_line(F.col("text")).alias("p"))
    return parsed.groupBy("p.level").agg(F.count("*").alias("n"), F.sum("p.importance").alias("importance"))


@register("directory_scan", """SELECT 'kind=' || n_regionkey || '/' AS folder, count(*) AS n_lines FROM nation WHERE n_regionkey NOT IN (2, 3) GROUP BY 1""")
def directory_scan(spark, sf_dir):
    """Files of a written folder: one directory is ignored by its name, another by a pattern; marker files by their suffix."""
    folder = scratch(spark, "scan")
    _t(spark, sf_dir, "nation").select("n_name", F.col("n_regionkey").alias("kind")).write.partitionBy("kind").text(folder)
    rules = files.ScanRules(suffixes=(".txt",), ignored_parts=("kind=2",), ignored_globs=("kind=3/*",))
    found = files.scan_directory(spark, folder, rules)
    rows = F.size(F.filter(F.split(F.decode("content", "UTF-8"), "\n", -1), lambda x: x != ""))
    return found.select(F.regexp_extract("relative_path", "^[^/]*/", 0).alias("folder"), rows.alias("n")).groupBy("folder").agg(F.sum("n").alias("n_lines"))


@register("block_slice", """SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations) WHERE n >= 1 AND n < greatest(c - 1, 0)""")
def block_slice(spark, sf_dir):
    return relational.select_blocks(_t(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 1, -1).select("conv_id", "turn")


@register("blocks_by_id", "SELECT DISTINCT n_nationkey, n_name FROM nation WHERE n_nationkey IN (1, 5, 9)")
def blocks_by_id(spark, sf_dir):
    return relational.blocks_by_id(_t(spark, sf_dir, "nation"), "n_nationkey", [1, 5, 9]).select("n_nationkey", "n_name")


@register("join_two", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'")
def join_two(spark, sf_dir):
    o, c = _t(spark, sf_dir, "orders", "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).where("c_mktsegment = 'MACHINERY'").select("o_orderkey", "c_name")


@register("join_three", """SELECT c_mktsegment, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def join_three(spark, sf_dir):
    li, o, c = _t(spark, sf_dir, "lineitem", "orders", "customer")
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@register("left_join_residual", """SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' WHERE o_orderkey IS NULL OR o_totalprice > 400000""")
def left_join_residual(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.join(o, (c["c_custkey"] == o["o_custkey"]) & (o["o_orderstatus"] == "P"), "left").where("o_orderkey IS NULL OR o_totalprice > 400000").select("c_custkey", "o_orderkey")


@register("exists_any", """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000) OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def exists_any(spark, sf_dir):
    views = dict(zip(("customer", "orders"), _t(spark, sf_dir, "customer", "orders"), strict=True))
    statement = "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 490000) OR NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)"
    return tables.run_sql(spark, views, statement)


@register("semi_join", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_returnflag = 'R')")
def semi_join(spark, sf_dir):
    s, li = _t(spark, sf_dir, "supplier", "lineitem")
    return s.join(li.where("l_quantity >= 50 AND l_returnflag = 'R'"), s["s_suppkey"] == li["l_suppkey"], "left_semi").select("s_suppkey")


@register("or_join_pairs", "SELECT DISTINCT l_orderkey, l_linenumber, s_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey OR l_partkey = s_suppkey")
def or_join_pairs(spark, sf_dir):
    li, s = _t(spark, sf_dir, "lineitem", "supplier")
    lines = li.withColumn("row", F.struct("l_orderkey", "l_linenumber"))
    return relational.or_join(lines, s, [("l_suppkey", "s_suppkey"), ("l_partkey", "s_suppkey")], "row", "s_suppkey").select("l_orderkey", "l_linenumber", "s_suppkey")


_PLAN = """WITH indexed AS (SELECT o_orderkey AS key, o_totalprice AS t, o_orderstatus = 'F' AS deleted FROM orders WHERE o_orderkey % 11 <> 0),
    disk AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice + 0.05 END AS t FROM orders WHERE o_orderkey % 7 <> 0),
    plan AS (SELECT coalesce(i.key, d.key) AS key, CASE WHEN i.key IS NULL THEN 'insert' WHEN d.key IS NULL THEN CASE WHEN deleted THEN 'keep' ELSE 'delete' END
    WHEN deleted THEN 'resurrect' WHEN abs(d.t - i.t) > 0.1 THEN 'update' ELSE 'keep' END AS action FROM indexed i FULL JOIN disk d ON i.key = d.key)"""


def _plan(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    indexed = orders.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("t"), (F.col("o_orderstatus") == "F").alias("deleted"))
    disk = orders.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice") + 0.05).alias("t"))
    return relational.sync_plan(indexed, disk, "key", "t", "deleted", locked=orders.where("o_orderkey % 101 = 0").select(F.col("o_orderkey").alias("key")))


@register("sync_plan", _PLAN + " SELECT key, action FROM plan WHERE key % 101 <> 0")
def sync_plan(spark, sf_dir):
    return _plan(spark, sf_dir).select("key", "action")


@register("sync_summary", _PLAN + " SELECT action, count(*) AS n FROM plan WHERE key % 101 <> 0 AND action <> 'keep' GROUP BY 1")
def sync_summary(spark, sf_dir):
    return relational.counts_by(_plan(spark, sf_dir).where("action <> 'keep'"), ["action"])


@register("containment_smallest_span", """WITH spans AS (SELECT user_id, event_id AS span, floor(value)::BIGINT AS a, floor(value)::BIGINT + 10 + event_id % 7 AS b, event_id % 3 AS rank FROM events WHERE event_type = 'view'),
    points AS (SELECT event_id, user_id, floor(value)::BIGINT AS x FROM events WHERE event_type = 'click')
    SELECT event_id, user_id, x, span FROM (SELECT p.*, span, row_number() OVER (PARTITION BY event_id ORDER BY b - a, rank, a DESC, span) AS rn FROM points p JOIN spans s ON p.user_id = s.user_id AND x BETWEEN a AND b) WHERE rn = 1""")
def containment_smallest_span(spark, sf_dir):
    events = _t(spark, sf_dir, "events").withColumn("x", F.floor("value").cast("long"))
    spans = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("span"), F.col("x").alias("a"), (F.col("x") + 10 + F.col("event_id") % 7).alias("b"), (F.col("event_id") % 3).alias("rank"))
    points = events.where("event_type = 'click'").select("event_id", "user_id", "x")
    return containment.smallest_span(points, spans, "user_id", "x", "a", "b", F.col("rank"), "span")


@register("preferred_match", """SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY (c_nationkey = s_nationkey) DESC, s_suppkey) AS rn
    FROM customer JOIN supplier ON c_custkey % 10 = s_suppkey % 10) WHERE rn = 1""")
def preferred_match(spark, sf_dir):
    c, s = _t(spark, sf_dir, "customer", "supplier")
    found = relational.preferred(c.withColumn("key", F.col("c_custkey") % 10), s.withColumn("key", F.col("s_suppkey") % 10), ("key", "key"), ("c_nationkey", "s_nationkey"), "s_suppkey")
    return found.select("c_custkey", "s_suppkey")


@register("unique_match", """SELECT o_orderkey, s_suppkey FROM orders JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1 HAVING count(*) = 1) ON o_custkey % 25 = s_nationkey""")
def unique_match(spark, sf_dir):
    o, s = _t(spark, sf_dir, "orders", "supplier")
    return relational.unique_match(o.withColumn("nation", F.col("o_custkey") % 25), s, "nation", "s_nationkey", "s_suppkey").select("o_orderkey", "s_suppkey")


@register("path_suffix_match", """WITH files AS (SELECT DISTINCT regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages),
    names AS (SELECT DISTINCT regexp_extract(path, '[^/]*/[^/]*$') AS name FROM files WHERE path LIKE '%.html')
    SELECT name, path AS resolved FROM (SELECT name, path, row_number() OVER (PARTITION BY name ORDER BY path <> name, split_part(path, '/', 1) <> split_part(name, '/', 1), len(string_split(path, '/')), path) AS rn
    FROM names JOIN files ON path = name OR path LIKE '%/' || name) WHERE rn = 1""")
def path_suffix_match(spark, sf_dir):
    found = _t(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path")).distinct()
    names = found.where("path LIKE '%.html'").select(F.regexp_extract("path", "[^/]*/[^/]*$", 0).alias("name")).distinct()
    return relational.path_suffix_match(names, found, "name", "path")


@register("count_distinct", "SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'error') AS errors FROM events")
def count_distinct(spark, sf_dir):
    return _t(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("event_type") == "error").alias("errors"))


@register("rollup_customer_activity", """SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders,
    (SELECT count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = c_custkey) AS n_lines,
    (SELECT count(DISTINCT l_partkey) FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = c_custkey) AS n_parts,
    (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS n_open FROM customer""")
def rollup_customer_activity(spark, sf_dir):
    c, o, li = _t(spark, sf_dir, "customer", "orders", "lineitem")
    orders = o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    lines = orders.join(li.select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    parts = [
        (orders, {"n_orders": F.count("*"), "n_open": F.count_if(F.col("o_orderstatus") == "O")}),
        (lines, {"n_lines": F.count("*"), "n_parts": F.countDistinct("l_partkey")}),
    ]
    return relational.roll_up(c.select("c_custkey", "c_name"), "c_custkey", parts)


@register("pending_backlog", """SELECT c_custkey, coalesce(a, 0) AS n_open, coalesce(b, 0) AS n_urgent, coalesce(d, 0) AS n_large, coalesce(a, 0) + coalesce(b, 0) + coalesce(d, 0) AS total, latest FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS a, count(*) FILTER (o_orderpriority = '1-URGENT') AS b, count(*) FILTER (o_totalprice > 450000) AS d, max(o_orderkey) AS latest FROM orders GROUP BY 1) ON c_custkey = o_custkey
    WHERE coalesce(a, 0) + coalesce(b, 0) + coalesce(d, 0) > 0""")
def pending_backlog(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer", "orders")
    work = relational.counts_by(o, ["o_custkey"], n_open=F.col("o_orderstatus") == "P", n_urgent=F.col("o_orderpriority") == "1-URGENT", n_large=F.col("o_totalprice") > 450000).drop("n")
    work = work.join(o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("latest")), "o_custkey")
    joined = c.join(work, c["c_custkey"] == work["o_custkey"], "left").fillna(0, ["n_open", "n_urgent", "n_large"])
    total = F.col("n_open") + F.col("n_urgent") + F.col("n_large")
    return joined.withColumn("total", total).where("total > 0").select("c_custkey", "n_open", "n_urgent", "n_large", "total", "latest").orderBy(F.col("total").desc(), F.col("latest").desc(), "c_custkey")


@register("fresh_first", "SELECT o_custkey, max(o_orderdate)::DATE::VARCHAR AS latest, count(*) AS n FROM orders GROUP BY 1 ORDER BY latest DESC, o_custkey LIMIT 50")
def fresh_first(spark, sf_dir):
    grouped = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("latest"), F.count("*").alias("n"))
    return grouped.orderBy(F.col("latest").desc(), "o_custkey").limit(50)


@register("lines_per_order", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def lines_per_order(spark, sf_dir):
    li, o = _t(spark, sf_dir, "lineitem", "orders")
    wanted = li.join(o.where("o_orderstatus = 'P'"), li["l_orderkey"] == o["o_orderkey"], "left_semi")
    return relational.counts_by(wanted, ["l_orderkey"])


@register("issue_categories", """SELECT event_type, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events WHERE value > 150 GROUP BY 1""")
def issue_categories(spark, sf_dir):
    grouped = relational.grouped_lists(_t(spark, sf_dir, "events").where("value > 150"), "event_type", F.col("event_id").cast("string"), "event_id")
    return grouped.select("event_type", "n", F.array_join("items", ",").alias("ids"))


@register("category_totals", "SELECT event_type, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), ())")
def category_totals(spark, sf_dir):
    return _t(spark, sf_dir, "events").rollup("event_type").agg(F.count("*").alias("n"))


@register("timing_bottlenecks", """SELECT event_type, count(*) AS n, round(sum(value), 3) AS total, round(avg(value), 3) AS average, round(min(value), 3) AS least, round(max(value), 3) AS greatest FROM events GROUP BY 1 ORDER BY total DESC LIMIT 3""")
def timing_bottlenecks(spark, sf_dir):
    return relational.timing_summary(_t(spark, sf_dir, "events"), "event_type", "value").orderBy(F.col("total").desc()).limit(3)


@register("timing_lines", """SELECT event_type AS operation, count(*) AS n, round(sum(round(value, 2)), 3) AS total, round(avg(round(value, 2)), 3) AS average, round(min(round(value, 2)), 3) AS least, round(max(round(value, 2)), 3) AS greatest FROM events WHERE event_id % 6 < 4 GROUP BY 1""")
def timing_lines(spark, sf_dir):
    """Timings after one blank, two, a tab, and in the last part of a line; not in small letters, nor in another part."""
    spent = F.concat(F.lit("duration="), F.round("value", 2).cast("string"), F.lit("s"))
    bars = lambda *parts: F.concat_ws(" | ", *parts)
    timing = lambda tag, gap: F.concat(F.lit(tag + gap), "event_type", F.lit(gap), spent)
    kind = F.col("event_id") % 6
    line = (
        F.when(kind == 0, timing("[TIMING]", " "))
        .when(kind == 1, timing("[TIMING]", "  "))
        .when(kind == 2, F.concat(F.lit("then "), timing("[TIMING]", "\t"), F.lit(" done")))
        .when(kind == 3, bars(F.lit("2024-01-01 00:00:00"), F.lit("INFO"), F.lit("4"), timing("[TIMING]", " ")))
        .when(kind == 4, timing("[timing]", " "))
        .otherwise(bars(timing("[TIMING]", " "), F.lit("a"), F.lit("b"), F.lit("c")))
    )
    parsed = _t(spark, sf_dir, "events").select(logs.timing(line).alias("t")).where("t IS NOT NULL").select("t.operation", "t.seconds")
    return relational.timing_summary(parsed, "operation", "seconds")


@register("quality_summary", """SELECT count(*) AS n_documents, count(l.doc_id) AS n_labelled, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (quality = 0) AS n_bad, count(*) FILTER (toxic = 1) AS n_toxic,
    count(*) FILTER (n_chars > 5000) AS n_long, count(*) FILTER (n_chars < 100) AS n_short, count(*) FILTER (quality = 0 AND toxic = 1) AS n_both, sum(n_chars) AS chars, count(DISTINCT source) AS n_sources FROM documents d LEFT JOIN labels l USING (doc_id)""")
def quality_summary(spark, sf_dir):
    docs, labels = _t(spark, sf_dir, "documents", "labels")
    both = docs.join(labels.withColumn("known", F.lit(True)), "doc_id", "left")
    count = lambda condition, name: F.count_if(condition).alias(name)
    return both.agg(
        F.count("*").alias("n_documents"),
        count(F.col("known"), "n_labelled"),
        count(F.col("quality") == 1, "n_good"),
        count(F.col("quality") == 0, "n_bad"),
        count(F.col("toxic") == 1, "n_toxic"),
        count(F.col("n_chars") > 5000, "n_long"),
        count(F.col("n_chars") < 100, "n_short"),
        count((F.col("quality") == 0) & (F.col("toxic") == 1), "n_both"),
        F.sum("n_chars").alias("chars"),
        F.countDistinct("source").alias("n_sources"),
    )


@register("structure_totals", """SELECT r_name, count(DISTINCT n_nationkey) AS n_nations, count(c_custkey) AS n_customers FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1""")
def structure_totals(spark, sf_dir):
    r, n, c = _t(spark, sf_dir, "region", "nation", "customer")
    joined = r.join(n, r["r_regionkey"] == n["n_regionkey"]).join(c, n["n_nationkey"] == c["c_nationkey"], "left")
    return joined.groupBy("r_name").agg(F.countDistinct("n_nationkey").alias("n_nations"), F.count("c_custkey").alias("n_customers"))


@register("index_health", "SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM labels WHERE quality > 1) AS entities, (SELECT count(*) FROM documents) > 0 AND (SELECT count(*) FROM labels WHERE quality > 1) = 0 AS broken")
def index_health(spark, sf_dir):
    docs, labels = _t(spark, sf_dir, "documents", "labels")
    both = docs.agg(F.count("*").alias("files")).crossJoin(labels.where("quality > 1").agg(F.count("*").alias("entities")))
    return both.withColumn("broken", (F.col("files") > 0) & (F.col("entities") == 0))


@register("latest_event_per_user", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_event_per_user(spark, sf_dir):
    return tables.keep_latest(_t(spark, sf_dir, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


@register("latest_single", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_single(spark, sf_dir):
    return files.tail(_t(spark, sf_dir, "events"), [F.col("ts").desc(), F.col("event_id").desc()], 1).select("event_id", "user_id")


@register("renumber_dense", "SELECT vec_id, row_number() OVER (ORDER BY label, vec_id) - 1 AS dense_id FROM embeddings")
def renumber_dense(spark, sf_dir):
    return relational.renumber(_t(spark, sf_dir, "embeddings").select("label", "vec_id"), ["label", "vec_id"], "dense_id").select("vec_id", "dense_id")


@register("dedupe_keep_highest", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def dedupe_keep_highest(spark, sf_dir):
    return tables.keep_latest(_t(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("event_id").desc()]).select("user_id", "event_type", "event_id")


@register("ordered_page", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 40 OFFSET 100")
def ordered_page(spark, sf_dir):
    return tables.select_rows(_t(spark, sf_dir, "lineitem"), columns=["l_orderkey", "l_linenumber", "l_partkey"], order_by=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], limit=40, offset=100)


_ENTITIES = """(SELECT 'customer' AS entity, c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL::INT AS size FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal, NULL FROM supplier
    UNION ALL SELECT 'part', p_partkey, p_name, NULL, p_size FROM part)"""


def _entities(spark, sf_dir):
    c, s, p = _t(spark, sf_dir, "customer", "supplier", "part")
    return relational.union_entities({
        "customer": c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")),
        "supplier": s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
        "part": p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size")),
    })


@register("entity_union_page", f"SELECT entity, id, name, balance, size FROM {_ENTITIES} ORDER BY name, entity, id LIMIT 50 OFFSET 10")
def entity_union_page(spark, sf_dir):
    return _entities(spark, sf_dir).orderBy("name", "entity", "id").offset(10).limit(50)


@register("entity_counts", f"SELECT entity, count(*) AS n FROM {_ENTITIES} GROUP BY 1")
def entity_counts(spark, sf_dir):
    return relational.counts_by(_entities(spark, sf_dir), ["entity"])


@register("usages_union", """SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS id, o_custkey AS target FROM orders UNION ALL SELECT 'line', l_orderkey, l_suppkey FROM lineitem
    UNION ALL SELECT 'event', event_id, user_id FROM events) ORDER BY target, kind, id LIMIT 100 OFFSET 20""")
def usages_union(spark, sf_dir):
    o, li, e = _t(spark, sf_dir, "orders", "lineitem", "events")
    parts = {
        "order": o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("target")),
        "line": li.select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("target")),
        "event": e.select(F.col("event_id").alias("id"), F.col("user_id").alias("target")),
    }
    return relational.union_entities(parts).withColumnRenamed("entity", "kind").orderBy("target", "kind", "id").offset(20).limit(100)


@register("set_difference", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS present FROM (SELECT DISTINCT doc_id FROM documents)")
def set_difference(spark, sf_dir):
    docs, labels = _t(spark, sf_dir, "documents", "labels")
    present, absent = relational.split_by_presence(docs, labels, "doc_id")
    return present.withColumn("present", F.lit(True)).unionByName(absent.withColumn("present", F.lit(False)))


@register("distinct_edges", "SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey")
def distinct_edges(spark, sf_dir):
    o, c, li, s = _t(spark, sf_dir, "orders", "customer", "lineitem", "supplier")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(li, o["o_orderkey"] == li["l_orderkey"]).join(s, li["l_suppkey"] == s["s_suppkey"])
    return joined.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()


@register("token_counts", r"SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END AS n_words FROM documents")
def token_counts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", duplicates.word_count(F.col("text")).alias("n_words"))


@register("staleness_buckets", """SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'not_in_db' WHEN d.doc_id % 9 <> 0 AND l.quality = 1 THEN 'sha_match' WHEN d.doc_id % 4 = 0 THEN 'skipped_active_session' ELSE 'rebuilt' END AS bucket
    FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1""")
def staleness_buckets(spark, sf_dir):
    docs, labels = _t(spark, sf_dir, "documents", "labels")
    both = docs.join(labels.withColumn("known", F.lit(True)), "doc_id", "left")
    now = F.when(F.col("doc_id") % 9 != 0, F.sha2("text", 256))
    seen = F.when(F.col("quality") == 1, F.sha2("text", 256)).otherwise("old")
    bucket = relational.staleness(F.col("known"), seen, now, F.col("doc_id") % 4 == 0)
    return relational.counts_by(both.select(bucket.alias("bucket")), ["bucket"])


@register("search_candidates", """SELECT page_id, CASE WHEN page_id % 3 <> 2 THEN 'index' ELSE 'disk' END AS look_in FROM pages WHERE url LIKE '%.html' AND NOT list_contains(string_split(url, '/'), 'fr')""")
def search_candidates(spark, sf_dir):
    allowed = patterns.allowed_path(F.col("url"), [".html"], ["fr"])
    state = relational.coverage(F.lit(True), F.lit(False), F.lit(1), F.lit(1.0), (F.col("page_id") % 3).cast("double"))
    return relational.search_candidates(_t(spark, sf_dir, "pages"), allowed, state).select("page_id", "look_in")
