"""Driver queries of full-text, vector and combined search, and of duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import duplicates, relational, search, text_index, vector_clusters
from lodestone.plans.catalog import register
from lodestone.sources import files, tables
from lodestone.sources.lineage import scratch

QUERY = "thing-re/ou"
#: A fixed query vector of 64 values.
VECTOR = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
_VECTOR_SQL = "[" + ", ".join(map(str, VECTOR)) + "]::DOUBLE[]"
_TOKENS = r"list_filter(string_split_regex(lower(substr(text, 1, 200000)), '[^\p{L}\p{N}_]+'), lambda t: t <> '')"
_TERMS = ("thing", "re", "ou")
_ALL = " AND ".join(f"len(list_filter(w, lambda t: starts_with(t, '{t}'))) > 0" for t in _TERMS)
_HITS = " + ".join(f"len(list_filter(w, lambda t: starts_with(t, '{t}')))" for t in _TERMS)
_FULLTEXT = f"SELECT doc_id, ({_HITS})::DOUBLE / len(w) AS rank FROM (SELECT doc_id, {_TOKENS} AS w FROM documents) WHERE {_ALL}"
_COSINE = f"""(SELECT vec_id, 1 - list_dot_product(e, {_VECTOR_SQL}) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product({_VECTOR_SQL}, {_VECTOR_SQL}))) AS distance
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))"""


#: Indexes built so far, by application, table and the state of its folder.
_INDEXES: dict[tuple, text_index.TextIndex] = {}


def _index(spark, sf_dir):
    """The stored index of the documents, built with the first search that asks for it."""
    path = f"{sf_dir}/documents.parquet"
    known = (spark.sparkContext.applicationId, path, *text_index.folder_state(spark, path))
    if known not in _INDEXES:
        index = text_index.TextIndex(spark, scratch(spark, "words"))
        index.put(tables.read(spark, sf_dir, "documents"), "doc_id", search.index_text(F.col("text")))
        _INDEXES[known] = index
    return _INDEXES[known]


def _fulltext(spark, sf_dir):
    return _index(spark, sf_dir).matches(QUERY).withColumnRenamed("key", "doc_id")


@register("fulltext_matches", f"SELECT doc_id, round(rank, 6) AS rank FROM ({_FULLTEXT})")
def fulltext_matches(spark, sf_dir):
    """By reading every text, without an index."""
    docs = tables.read(spark, sf_dir, "documents")
    return search.fulltext(docs, "doc_id", search.index_text(F.col("text")), QUERY).select("doc_id", F.round("rank", 6).alias("rank"))


@register("fulltext_indexed", f"SELECT doc_id, round(rank, 6) AS rank FROM ({_FULLTEXT})")
def fulltext_indexed(spark, sf_dir):
    return _fulltext(spark, sf_dir).select("doc_id", F.round("rank", 6).alias("rank"))


_NEXT = ", ".join(f"min(CASE WHEN starts_with(t, '{t}') THEN place END) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n{i}" for i, t in enumerate(_TERMS))


@register("fulltext_cover", f"""WITH places AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS place, unnest(w) AS t FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)),
    held AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS n FROM places WHERE {" OR ".join(f"starts_with(t, '{t}')" for t in _TERMS)}),
    ends AS (SELECT doc_id, place, n, CASE WHEN {" AND ".join(f"n{i} IS NOT NULL" for i in range(len(_TERMS)))} THEN greatest({", ".join(f"n{i}" for i in range(len(_TERMS)))}) END AS upto FROM (SELECT doc_id, place, n, {_NEXT} FROM held)),
    least AS (SELECT *, lead(upto) OVER (PARTITION BY doc_id ORDER BY place) AS following FROM ends)
    SELECT l.doc_id, count(*) AS covers, round(sum(0.1 / (1 + l.upto - l.place - (h.n - l.n))), 6) AS rank FROM least l JOIN held h ON h.doc_id = l.doc_id AND h.place = l.upto
    WHERE l.upto IS NOT NULL AND (following IS NULL OR following > l.upto) GROUP BY 1""")
def fulltext_cover(spark, sf_dir):
    found = _index(spark, sf_dir)
    covers = found.covers(QUERY).groupBy("key").agg(F.count("*").alias("covers"))
    return found.cover_density(QUERY).join(covers, "key").select(F.col("key").alias("doc_id"), "covers", F.round("rank", 6).alias("rank"))


_CHANGED = "(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Thing ' || coalesce(text, '') || ' out-rest' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0 OR doc_id % 7 = 0)"


@register("fulltext_updated", f"SELECT doc_id, round(rank, 6) AS rank FROM ({_FULLTEXT.replace('FROM documents', f'FROM {_CHANGED}')})")
def fulltext_updated(spark, sf_dir):
    """Documents dropped, others put anew, and the generations made one."""
    docs, text = tables.read(spark, sf_dir, "documents"), search.index_text(F.col("text"))
    index = text_index.TextIndex(spark, scratch(spark, "words"))
    index.put(docs, "doc_id", text)
    index.drop(docs.where("doc_id % 11 = 0"), "doc_id")
    index.put(docs.where("doc_id % 7 = 0").withColumn("text", F.concat(F.lit("Thing "), F.coalesce("text", F.lit("")), F.lit(" out-rest"))), "doc_id", text)
    index.compact()
    return index.matches(QUERY).select(F.col("key").alias("doc_id"), F.round("rank", 6).alias("rank"))


@register("fulltext_topk", f"SELECT doc_id, round(rank, 6) AS rank FROM ({_FULLTEXT}) ORDER BY round(rank, 6) DESC, doc_id LIMIT 10")
def fulltext_topk(spark, sf_dir):
    return search.top_by_rank(_fulltext(spark, sf_dir).select("doc_id", F.round("rank", 6).alias("rank")), "doc_id", 10)


@register("semantic_topk_cosine", f"SELECT vec_id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS score FROM (SELECT * FROM {_COSINE} ORDER BY distance, vec_id LIMIT 20) WHERE 1 / (1 + distance) >= 0.5")
def semantic_topk_cosine(spark, sf_dir):
    found = search.semantic(tables.read(spark, sf_dir, "embeddings"), "vec_id", "embedding", VECTOR, 20, search.vector_backend("auto"), 0.5)
    return found.select("vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@register("semantic_topk_l2", f"SELECT vec_id, round(2 * distance, 6) AS distance, round(1 / (1 + 2 * distance), 6) AS score FROM {_COSINE} ORDER BY distance, vec_id LIMIT 20")
def semantic_topk_l2(spark, sf_dir):
    found = search.semantic(tables.read(spark, sf_dir, "embeddings"), "vec_id", "embedding", VECTOR, 20, search.vector_backend("faiss"))
    return found.select("vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


_FINDINGS = f"""WITH fulltext AS ({_FULLTEXT}), semantic AS (SELECT vec_id, 1 / (1 + distance) AS score FROM (SELECT * FROM {_COSINE} ORDER BY distance, vec_id LIMIT 20)),
    grep AS (SELECT doc_id, line FROM (SELECT doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS content FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\n|\\r') AS l FROM documents)) WHERE contains(content, 'token =')),
    every AS (SELECT 'fulltext' AS source, doc_id::VARCHAR AS key, doc_id::VARCHAR AS stable_id, least(greatest(rank, 0), 1) AS score FROM fulltext
      UNION ALL SELECT 'semantic', vec_id::VARCHAR, vec_id::VARCHAR, score FROM semantic UNION ALL SELECT 'grep', doc_id::VARCHAR, doc_id || ':' || line, 1.0 FROM grep),
    numbered AS (SELECT printf('%s-%06d', source, row_number() OVER (PARTITION BY source ORDER BY round(score, 6) DESC, key, stable_id)) AS result_id, source, key, stable_id, round(score, 6) AS score FROM every)"""


def _findings(spark, sf_dir):
    docs, vectors = tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "embeddings")
    full = search.findings(_fulltext(spark, sf_dir), "fulltext", "doc_id", F.col("doc_id"), F.round("rank", 6))
    near = search.semantic(vectors, "vec_id", "embedding", VECTOR, 20)
    near = search.findings(near, "semantic", "vec_id", F.col("vec_id"), F.round("score", 6))
    lines = relational.grep(files.lines(docs, "doc_id", "text"), "content", "token =")
    lines = search.findings(lines, "grep", "doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("line").cast("string")), F.lit(1.0))
    return search.numbered(full, near, lines)


@register("hybrid_search", _FINDINGS + " SELECT * FROM numbered")
def hybrid_search(spark, sf_dir):
    return _findings(spark, sf_dir)


@register("hybrid_relevance", _FINDINGS + " SELECT result_id, score FROM numbered ORDER BY score DESC, result_id LIMIT 25")
def hybrid_relevance(spark, sf_dir):
    return search.relevance_order(_findings(spark, sf_dir)).limit(25).select("result_id", "score")


@register("hybrid_page", _FINDINGS + " SELECT result_id, ordinal, block FROM (SELECT result_id, row_number() OVER (ORDER BY result_id) AS ordinal, floor((row_number() OVER (ORDER BY result_id) - 1) / 10)::BIGINT AS block FROM numbered) WHERE block = 1")
def hybrid_page(spark, sf_dir):
    return search.blocks_of(_findings(spark, sf_dir), 10, ["result_id"]).where("block = 1").select("result_id", "ordinal", "block")


@register("symbol_overlay", r"SELECT part_id AS p_partkey, text FROM (SELECT p_partkey AS part_id, array_to_string(list_distinct_ordered, ' ') AS text FROM (SELECT p_partkey, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_ordered FROM (SELECT p_partkey, list_filter(string_split_regex(p_name || ' ' || p_type || ' ' || p_name || ' ' || p_brand, '\s+'), lambda t: t <> '') AS w FROM part)))")
def symbol_overlay(spark, sf_dir):
    text = search.overlay(F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_name", "p_brand"))
    return tables.read(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


_LINES = r"(SELECT doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS content FROM (SELECT doc_id, string_split_regex(text, '\r\n|\n|\r') AS l FROM documents))"


@register("grep_enriched", f"""WITH m AS (SELECT doc_id, line, row_number() OVER (ORDER BY doc_id, line) AS n FROM {_LINES} WHERE contains(content, 'token ='))
    SELECT doc_id, line, CASE WHEN n <= 30 THEN doc_id || '/' || (line - line % 4) END AS block, CASE WHEN n <= 30 THEN 'block' ELSE 'line' END AS status FROM m""")
def grep_enriched(spark, sf_dir):
    docs = tables.read(spark, sf_dir, "documents")
    lines = files.lines(docs, "doc_id", "text").withColumn("line", F.col("line").cast("long"))
    blocks = lines.select("doc_id", (F.col("line") - F.col("line") % 4).alias("first")).distinct()
    wide = blocks.select("doc_id", F.lit(0).cast("long").alias("first"), F.lit(1 << 30).cast("long").alias("last"), F.lit("whole").alias("block")).distinct()
    blocks = blocks.select("doc_id", "first", (F.col("first") + 3).alias("last"), F.concat_ws("/", F.col("doc_id").cast("string"), F.col("first").cast("string")).alias("block")).unionByName(wide)
    matches = relational.grep(lines, "content", "token =").select("doc_id", "line")
    return search.enrich(matches, blocks, "doc_id", "line", 30)


@register("vector_statistics", "SELECT label, count(*) AS n, count(*) FILTER (embedding IS NULL OR len(embedding) = 0) AS n_missing, max(len(embedding)) AS dimensions FROM embeddings GROUP BY 1")
def vector_statistics(spark, sf_dir):
    return search.vector_statistics(tables.read(spark, sf_dir, "embeddings"), "embedding", "label")


@register("exact_duplicate_groups", r"""SELECT hash, count(*) AS n, min(doc_id) AS first_key FROM (SELECT doc_id, sha256(lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '"[^"\n]*"|''[^''\n]*''', ' string ', 'g'), '[0-9]+(\.[0-9]+)?', ' number ', 'g'), '[ \t\r\n]+', ' ', 'g')))) AS hash FROM documents) GROUP BY 1 HAVING count(*) >= 2""")
def exact_duplicate_groups(spark, sf_dir):
    return duplicates.hash_groups(tables.read(spark, sf_dir, "documents"), "doc_id", duplicates.normal_form(F.col("text")))


@register("duplicates_in_source", "SELECT source, sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_key FROM documents GROUP BY 1, 2 HAVING count(*) >= 2")
def duplicates_in_source(spark, sf_dir):
    return duplicates.hash_groups(tables.read(spark, sf_dir, "documents"), "doc_id", F.col("text"), scope=["source"])


_PAIRS = """(SELECT a.label, a.vec_id AS "left", b.vec_id AS "right", list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS similarity
    FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) b ON a.label = b.label AND a.vec_id < b.vec_id)"""


def _similar(spark, sf_dir):
    """Pairs at 0.25 or over, and those without a similarity, which SQL has over every number."""
    vectors = tables.read(spark, sf_dir, "embeddings")
    pairs = duplicates.similar_pairs(vectors, "vec_id", "embedding", "label", 0.25)
    return pairs.unionByName(duplicates.undirected_pairs(vectors, "vec_id", "embedding", "label"))


@register("semantic_duplicate_pairs", f'SELECT label, "left", "right", round(similarity, 6) AS similarity FROM {_PAIRS} WHERE similarity >= 0.25')
def semantic_duplicate_pairs(spark, sf_dir):
    pairs = _similar(spark, sf_dir)
    return pairs.select("label", "left", "right", F.round("similarity", 6).alias("similarity"))


@register("hybrid_duplicate_groups", f"""WITH RECURSIVE pairs AS (SELECT label, "left" AS a, "right" AS b, row_number() OVER (PARTITION BY label ORDER BY "left", "right") AS k FROM {_PAIRS} WHERE similarity >= 0.25),
    fold(label, k, pair, members, fits, seen) AS (SELECT label, 0, 0, [0, 0], false, []::BIGINT[] FROM pairs GROUP BY 1
      UNION ALL SELECT p.label, p.k, p.a * 1000000 + p.b, [p.a, p.b], NOT list_contains(seen, p.a) AND NOT list_contains(seen, p.b), CASE WHEN list_contains(seen, p.a) OR list_contains(seen, p.b) THEN seen ELSE list_concat(seen, [p.a, p.b]) END FROM fold f JOIN pairs p ON p.label = f.label AND p.k = f.k + 1)
    SELECT label, pair, array_to_string(members, ',') AS members FROM fold WHERE fits""")
def hybrid_duplicate_groups(spark, sf_dir):
    groups = _similar(spark, sf_dir).select("label", (F.col("left") * 1_000_000 + F.col("right")).alias("pair"), F.array("left", "right").alias("members"))
    return duplicates.hybrid_groups(groups, "label", "pair", "members").select("label", "pair", F.array_join("members", ",").alias("members"))


@register("name_similarity", """WITH RECURSIVE names AS (SELECT DISTINCT p_brand, p_name FROM part), pairs AS (SELECT a.p_brand, a.p_name AS a, b.p_name AS b FROM names a JOIN names b ON a.p_brand = b.p_brand AND a.p_name < b.p_name),
    lcs(a, b, i, r) AS (SELECT DISTINCT a, b, 0, list_transform(range(length(b) + 1), lambda x: 0) FROM pairs
      UNION ALL SELECT a, b, i + 1, list_transform(range(1, length(b) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda q: greatest(r[q], CASE WHEN q > 1 AND substr(a, i + 1, 1) = substr(b, q - 1, 1) THEN r[q - 1] + 1 ELSE 0 END)))) FROM lcs WHERE i < length(a))
    SELECT p_brand, a, b, round(r[length(b) + 1]::DOUBLE / greatest(length(a), length(b)), 6) AS similarity FROM pairs JOIN lcs USING (a, b) WHERE i = length(a) AND r[length(b) + 1]::DOUBLE / greatest(length(a), length(b)) >= 0.6""")
def name_similarity(spark, sf_dir):
    found = duplicates.similar_names(tables.read(spark, sf_dir, "part"), "p_brand", "p_name", 0.6)
    return found.select("p_brand", "a", "b", F.round("similarity", 6).alias("similarity"))


@register("greedy_pages", """WITH RECURSIVE d AS (SELECT source, doc_id, octet_length(encode(text)) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
    fold(source, k, doc_id, size, page, held, n) AS (SELECT source, k, doc_id, size, 0, size, 1 FROM d WHERE k = 1 UNION ALL SELECT d.source, d.k, d.doc_id, d.size, CASE WHEN held + d.size > 20000 OR n >= 10 THEN page + 1 ELSE page END,
      CASE WHEN held + d.size > 20000 OR n >= 10 THEN d.size ELSE held + d.size END, CASE WHEN held + d.size > 20000 OR n >= 10 THEN 1 ELSE n + 1 END FROM fold f JOIN d ON d.source = f.source AND d.k = f.k + 1)
    SELECT source, doc_id, size, page FROM fold""")
def greedy_pages(spark, sf_dir):
    return duplicates.greedy_pages(tables.read(spark, sf_dir, "documents"), "source", "doc_id", F.octet_length("text"), 20_000, 10)


@register("first_fit_batches", """WITH RECURSIVE items AS (SELECT l_suppkey, l_orderkey, sum(l_quantity)::BIGINT AS size FROM lineitem GROUP BY 1, 2),
    parts AS (SELECT l_suppkey, l_orderkey, part, CASE WHEN size - part * 60 > 60 THEN 60 ELSE size - part * 60 END AS size, size - part * 60 > 60 AS whole, row_number() OVER (PARTITION BY l_suppkey ORDER BY items.size DESC, l_orderkey, part) AS k FROM (SELECT *, unnest(range(greatest(((size - 1) // 60)::BIGINT, 0) + 1)) AS part FROM items) items),
    fold(l_suppkey, k, l_orderkey, part, size, place, room) AS (SELECT l_suppkey, 0, 0, 0, 0, 0, []::BIGINT[] FROM parts GROUP BY 1
      UNION ALL SELECT p.l_suppkey, p.k, p.l_orderkey, p.part, p.size, CASE WHEN p.whole THEN len(room) + 1 ELSE coalesce(list_position(list_transform(room, lambda r: r >= p.size), true), len(room) + 1) END,
      CASE WHEN p.whole THEN list_append(room, 0) WHEN list_position(list_transform(room, lambda r: r >= p.size), true) IS NULL THEN list_append(room, 60 - p.size) ELSE list_transform(room, lambda r, i: CASE WHEN i = list_position(list_transform(room, lambda q: q >= p.size), true) THEN r - p.size ELSE r END) END
      FROM fold f JOIN parts p ON p.l_suppkey = f.l_suppkey AND p.k = f.k + 1)
    SELECT l_suppkey, l_orderkey, part, size, place - 1 AS batch FROM fold WHERE k > 0""")
def first_fit_batches(spark, sf_dir):
    sized = tables.read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.sum("l_quantity").cast("long").alias("size"))
    return duplicates.first_fit(sized, "l_suppkey", "l_orderkey", "size", 60)


@register("paragraph_chunks", r"""SELECT doc_id, ordinal, chunk, CASE WHEN ordinal = 0 THEN 1 WHEN regexp_matches(chunk, '^#|:$') THEN 2 ELSE 3 END AS binding_level
    FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS ordinal, unnest(l) AS chunk FROM (SELECT doc_id, string_split_regex(text, '\n\s*\n') AS l FROM documents)) WHERE trim(chunk) <> ''""")
def paragraph_chunks(spark, sf_dir):
    return duplicates.paragraphs(tables.read(spark, sf_dir, "documents"), "doc_id", "text")


@register("placeholder_lines", rf"""SELECT doc_id, line, upper(regexp_extract(content, '(?i)\b(stupid|license|licensed|token)\b', 1)) AS word FROM {_LINES} WHERE regexp_matches(content, '(?i)\b(stupid|license|licensed|token)\b')""")
def placeholder_lines(spark, sf_dir):
    rows = files.lines(tables.read(spark, sf_dir, "documents"), "doc_id", "text")
    return duplicates.placeholders(rows, "content", ["stupid", "license", "licensed", "token"]).select("doc_id", F.col("line").cast("long").alias("line"), "word")


@register("missing_rows", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 500)")
def missing_rows(spark, sf_dir):
    present = tables.read(spark, sf_dir, "documents").where("n_chars > 500")
    return tables.read(spark, sf_dir, "labels").join(present, "doc_id", "left_anti").select("doc_id")


@register("vector_index", "SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS dense_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def vector_index(spark, sf_dir):
    found = search.vector_index(tables.read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return found.select("vec_id", "dense_id", F.round("norm", 6).alias("norm"), F.round(F.element_at("unit", 1), 6).alias("first"))


@register("stored_vector_search", f"SELECT vec_id, dense_id, round(2 * distance, 6) AS distance, round(1 / (1 + 2 * distance), 6) AS score FROM {_COSINE} JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS dense_id FROM embeddings) USING (vec_id) ORDER BY distance, vec_id LIMIT 15")
def stored_vector_search(spark, sf_dir):
    path = scratch(spark, "vectors")
    search.write_vector_index(tables.read(spark, sf_dir, "embeddings"), "vec_id", "embedding", path)
    found = search.search_vector_index(spark, path, VECTOR, 15)
    return found.select(F.col("key").alias("vec_id"), "dense_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@register("clustered_vector_search", f"SELECT vec_id, round(2 * distance, 6) AS distance, round(1 / (1 + 2 * distance), 6) AS score FROM {_COSINE} ORDER BY distance, vec_id LIMIT 15")
def clustered_vector_search(spark, sf_dir):
    index = vector_clusters.ClusterIndex(spark, scratch(spark, "clusters"))
    index.build(tables.read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return index.search(VECTOR, 15).select(F.col("key").alias("vec_id"), F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


_GROWN = """WITH t AS (SELECT conv_id, turn, length(text) AS size, length(text) % 3 = 0 AS failed, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations),
    l AS (SELECT a.conv_id, a.turn, a.size, a.upto, coalesce(min(b.turn) FILTER (a.upto - b.upto + b.size <= 1000), any_value(a.turn)) AS first FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn <= a.turn WHERE a.failed GROUP BY a.conv_id, a.turn, a.size, a.upto),
    w AS (SELECT l.*, l.upto - f.upto + f.size AS held FROM l JOIN t f ON l.conv_id = f.conv_id AND f.turn = l.first)"""


@register("merged_neighbours", _GROWN + """ SELECT w.conv_id, w.turn, any_value(w.first) AS first, coalesce(max(b.turn) FILTER (w.held + b.upto - w.upto <= 1000), any_value(w.turn)) AS last
    FROM w LEFT JOIN t b ON w.conv_id = b.conv_id AND b.turn > w.turn GROUP BY w.conv_id, w.turn""")
def merged_neighbours(spark, sf_dir):
    turns = tables.read(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 3 == 0).alias("failed"), F.length("text").alias("size"))
    return duplicates.merged_neighbours(turns, "conv_id", "turn", "failed", "size", 1_000)
