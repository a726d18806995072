"""Vector, hybrid and text queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from codequarry import fixed_values as fixed
from codequarry.functions import names, vectors
from codequarry.operators import formatting, search, symbols, text_index, vector_index
from codequarry.registered import views
from codequarry.session import cut, shared_folder

QUESTION = "the order data flow to api"
CHUNK_CTE = f"chunks AS ({views.cte(views.CHUNKS)})"


def _round(column: str = "score"):
    return F.round(column, 6).alias(column)


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of item 0 is the question; one bounded row."""
    row = views.read(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]]


# ---- vectors -------------------------------------------------------------------


def vector_topk(spark, sf_dir):
    items = views.read(spark, sf_dir, "embeddings")
    return search.nearest(items, _query_vector(spark, sf_dir), 20, key="vec_id").select("vec_id", "label", _round())


def vector_topk_filtered(spark, sf_dir):
    items = views.read(spark, sf_dir, "embeddings").where("label = 3")
    return search.nearest(items, _query_vector(spark, sf_dir), 10, fixed.SIMILARITY_THRESHOLD, "vec_id").select("vec_id", "label", _round())


def vector_topk_per_label(spark, sf_dir):
    """Best three of every label: the rank limit runs before the shuffle."""
    items = views.read(spark, sf_dir, "embeddings")
    scored = items.select("vec_id", "label", vectors.similarity_to(F.col("embedding"), _query_vector(spark, sf_dir)).alias("score"))
    ranked = scored.withColumn("rank", F.expr("row_number() over (partition by label order by score desc, vec_id)"))
    return ranked.where("rank <= 3").select("label", "rank", "vec_id", _round())


def _vector_index(spark, sf_dir) -> vector_index.VectorIndex:
    folder = shared_folder(spark, f"vector-index-{uuid.uuid4().hex}")
    return vector_index.VectorIndex.build(views.read(spark, sf_dir, "embeddings"), folder, "vec_id")


def _query_set(spark, sf_dir) -> DataFrame:
    return views.read(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "embedding")


def vector_index_topk(spark, sf_dir):
    """The rows of ``vector_topk`` from inverted lists, reading only those that may hold one of them."""
    found = _vector_index(spark, sf_dir).nearest(_query_vector(spark, sf_dir), 20, probes=4, exact=True)
    return found.select("vec_id", "label", _round())


def vector_index_many(spark, sf_dir):
    """The ten nearest vectors of each query of a set, exact, from inverted lists."""
    return _vector_index(spark, sf_dir).nearest_many(_query_set(spark, sf_dir), 10, probes=4, exact=True).select("query", "rank", "vec_id", _round())


def vector_index_recall(spark, sf_dir):
    """Whether every vector lies in one list, and whether the search without proof, with the fewest lists that reach it on
    the set, finds nine of ten of what a full scan finds."""
    items, queries, index = views.read(spark, sf_dir, "embeddings"), _query_set(spark, sf_dir), _vector_index(spark, sf_dir)
    truth = cut(vector_index.exact_many(items, queries, 10, "vec_id"))
    probes = index.probes_for(items, queries, 10, 0.9, truth)
    found = vector_index.recall(index.nearest_many(queries, 10, probes), truth, "vec_id")
    stored = index.vectors.agg(F.count("*").alias("vectors"), (F.count("*") == F.countDistinct("vec_id")).alias("one_list_each"))
    return found.select("queries", "wanted", (F.col("recall") >= 0.9).alias("recall_reached")).join(stored, how="cross")


VECTOR_MANY_SQL = """
WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query, vec_id, greatest(0, 1 - (1 - list_cosine_similarity(embedding::DOUBLE[], v)) / 2) AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10
"""

VECTOR_SQL = """
WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, label, greatest(0, 1 - (1 - list_cosine_similarity(embedding::DOUBLE[], v)) / 2) AS score FROM embeddings, q)
"""


# ---- chunks ----------------------------------------------------------------------


def chunk_embeddings(spark, sf_dir):
    """The first four components of each chunk's hash vector, with its length."""
    vector = search.embed_chunks(views.chunks(spark, sf_dir, heavy=True), "mock")
    return vector.select(
        "id", F.size("embedding").cast("bigint").alias("dimension"),
        *[F.round(F.get("embedding", F.lit(i)).cast("double"), 4).alias(f"v{i}") for i in (0, 1, 31, 32)],
    )


def _text_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in fixed.NAME_STOP_WORDS)
    return f"""
WITH {CHUNK_CTE},
w AS (SELECT *, list_filter(CASE WHEN contains(name, '_') THEN string_split(name, '_')
        ELSE regexp_extract_all(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+') END,
        lambda x: length(x) > 1 AND lower(x) NOT IN ({stop})) AS kw0 FROM chunks),
k AS (SELECT *, list_transform(kw0, lambda x: lower(x)) AS kw FROM w),
t AS (SELECT *, CASE WHEN len(kw) = 0 THEN name ELSE array_to_string(kw, ' ') END AS readable, nullif(parent_name, '') AS p FROM k),
u AS (SELECT *, CASE chunk_type WHEN 'function' THEN 'Function that handles ' || readable
        WHEN 'method' THEN 'Method for ' || readable || coalesce(' in ' || p, '')
        WHEN 'class' THEN 'Class representing ' || readable
        WHEN 'interface' THEN 'Interface defining ' || readable
        WHEN 'constructor' THEN 'Constructor for ' || coalesce(p, readable) END AS purpose FROM t)
"""


EMBEDDING_TEXT_SQL = """concat_ws(chr(10), purpose,
   CASE WHEN docstring <> '' THEN 'Description: ' || trim(docstring, ' ' || chr(9) || chr(10) || chr(13)) END,
   'Signature: ' || nullif(signature, ''),
   'Keywords: ' || nullif(array_to_string(kw, ' '), ''), 'File: ' || split_part(file_path, '/', -1), 'Language: ' || language,
   'Code:' || chr(10) || content)"""


def chunk_texts(spark, sf_dir):
    """Keywords, purpose and the hash of the embedding text of every chunk."""
    c = views.chunks(spark, sf_dir, heavy=True)
    text = names.embedding_text(*[F.col(x) for x in ("chunk_type", "name", "parent_name", "docstring", "signature", "summary", "file_path", "language", "content")])
    return c.select(
        "id", names.qualified_name(F.col("parent_name"), F.col("name")).alias("qualified_name"),
        F.array_join(names.keywords(F.col("name")), " ").alias("keywords"),
        names.purpose(F.col("chunk_type"), F.col("name"), F.col("parent_name")).alias("purpose"),
        F.length(text).cast("bigint").alias("text_length"), F.sha2(text, 256).alias("text_hash"),
    )


def chunk_id_hash(spark, sf_dir):
    c = views.chunks(spark, sf_dir)
    return c.select("id", names.short_hash(*[F.col(x) for x in ("repo_name", "file_path", "name", "chunk_type", "start_line")]).alias("chunk_id"))


def keyword_boost(spark, sf_dir):
    c = views.chunks(spark, sf_dir, heavy=True)
    boost = search.keyword_boost(QUESTION, F.col("name"), F.col("docstring"), F.col("content"))
    return c.select("id", F.round(boost, 6).alias("boost"))


def _boost_sql() -> str:
    def in_(text, word):
        return f"contains(lower({text}), '{word}')"

    doc = "coalesce(docstring, '')"
    phrase = " + ".join(
        f"CASE WHEN {in_('name', w)} THEN 0.15 WHEN {in_(doc, w)} THEN 0.10 WHEN {in_('content', w)} THEN 0.05 ELSE 0 END"
        for w in search.query_windows(QUESTION)
    )

    def hits(text):
        return " + ".join(f"{in_(text, w)}::INT" for w in search.query_keywords(QUESTION))

    return f"""least(0.35::DOUBLE, ({phrase})::DOUBLE + (({hits('name')}) * 2.0::DOUBLE + ({hits(doc)}) * 1.0::DOUBLE + ({hits('content')}) *
      (CASE WHEN ({hits('name')}) = 0 AND ({hits(doc)}) = 0 THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END)) * 0.03::DOUBLE)"""


def hybrid_search(spark, sf_dir):
    """Question against all documents that have a vector; texts are read for the re-ranked hits only."""
    c = views.chunks(spark, sf_dir)
    e = views.read(spark, sf_dir, "embeddings").select(F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("id"), "embedding")
    found = search.hybrid(c, e, _query_vector(spark, sf_dir), n_results=10, query_text=QUESTION)
    return formatting.view(found, "summary", ["id", "score"]).withColumn("score", F.round("score", 6))


def hybrid_search_filtered(spark, sf_dir):
    """The same with language and type filters, preview level."""
    c = views.chunks(spark, sf_dir)
    e = views.read(spark, sf_dir, "embeddings").select(F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("id"), "embedding")
    found = search.hybrid(c, e, _query_vector(spark, sf_dir), n_results=5, chunk_type="class", language="python", query_text=QUESTION)
    return formatting.view(found, "preview", ["id", "score"]).drop("parent").withColumn("score", F.round("score", 6))


def _hybrid_sql(where: str | None, n: int, fetch: int, columns: str) -> str:
    """Best vectors first, of chunks that are there and pass the filter: what has no chunk takes no place."""
    allowed = f"WHERE e.id IN (SELECT id FROM chunks WHERE {where or 'true'})"
    return f"""
WITH {CHUNK_CTE}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
e AS (SELECT 'd' || vec_id::VARCHAR AS id, greatest(0, 1 - (1 - list_cosine_similarity(embedding::DOUBLE[], v)) / 2) AS sim FROM embeddings, q),
best AS (SELECT * FROM e {allowed} ORDER BY sim DESC, id LIMIT {fetch}),
b AS (SELECT c.*, least(1, sim + {_boost_sql()}) AS score0 FROM best JOIN chunks c USING (id))
SELECT {columns}, round(score0, 6) AS score FROM b WHERE score0 >= 0.35 ORDER BY score0 DESC, id LIMIT {n}
"""


SUMMARY_SQL = """id, name, CASE WHEN nullif(parent_name, '') IS NULL THEN name ELSE parent_name || '.' || name END AS qualified_name,
 chunk_type AS type, coalesce(signature, chunk_type || ' ' || name) AS signature,
 file_path || ':' || start_line || '-' || end_line AS location, repo_name AS repo, language"""

PREVIEW_SQL = """, docstring[1:500] AS docstring,
 CASE WHEN len(string_split(content, chr(10))) > 10 THEN array_to_string(string_split(content, chr(10))[1:10], chr(10)) || chr(10) ||
  '... (' || (len(string_split(content, chr(10))) - 10) || ' more lines)' ELSE content END AS preview"""


def chunk_views(spark, sf_dir):
    """Preview of every chunk."""
    return formatting.view(views.chunks(spark, sf_dir, heavy=True), "preview", ["id"]).drop("parent").withColumn("preview", F.sha2("preview", 256))


def query_expansion(spark, sf_dir):
    """Expanded query text for every page path taken as a query."""
    p = views.view(spark, sf_dir, views.ROUTES)
    text = F.concat_ws(" ", F.lower("method"), F.lit("ui to api"), F.col("language"), F.translate("path", "/", " "))
    return p.select("page_id", search.expand_column(text).alias("expanded"))


def _expansion_sql() -> str:
    phrases = list(fixed.QUERY_PHRASES)
    parts = [f"CASE WHEN contains(l, '{p}') THEN '{t}' END" for p, t in fixed.QUERY_PHRASES.items()]
    for term, text in fixed.QUERY_TERMS.items():
        covering = [f"contains(l, '{p}')" for p in phrases if term in p]
        hidden = " OR ".join(covering) or "false"
        parts.append(f"CASE WHEN contains(l, '{term}') AND NOT ({hidden}) THEN '{text}' END")
    return f"""
WITH r AS ({views.cte(views.ROUTES)}),
t AS (SELECT page_id, concat_ws(' ', lower(method), 'ui to api', language, replace(path, '/', ' ')) AS q FROM r),
x AS (SELECT page_id, q, lower(q) AS l FROM t),
y AS (SELECT page_id, q, concat_ws(' ', {', '.join(parts)}) AS extra FROM x)
SELECT page_id, CASE WHEN extra = '' THEN q ELSE q || ' (' || extra || ')' END AS expanded FROM y
"""


# ---- symbols --------------------------------------------------------------------------


def _symbols(spark, sf_dir) -> DataFrame:
    return symbols.symbols(views.chunks(spark, sf_dir))


SYMBOL_CTE = CHUNK_CTE + """, symbols AS (SELECT name, CASE WHEN nullif(parent_name, '') IS NULL THEN name ELSE parent_name || '.' || name END
 AS qualified_name, chunk_type AS symbol_type, file_path, repo_name, start_line, end_line, signature, parent_name, language, id AS chunk_id FROM chunks)"""
SYMBOL_COLUMNS = "chunk_id, name, qualified_name, symbol_type, repo_name, file_path, start_line"
_COLS = SYMBOL_COLUMNS.split(", ")


def symbol_lookup_exact(spark, sf_dir):
    return symbols.lookup(_symbols(spark, sf_dir), "main").select(_COLS)


def symbol_prefix_search(spark, sf_dir):
    return symbols.prefix_search(_symbols(spark, sf_dir), "fetch*").select(*_COLS, F.col("token_count").cast("bigint").alias("token_count"))


TOKENS_SQL = "list_filter(string_split_regex(lower(name), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') || list_filter(string_split_regex(lower(qualified_name), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


def symbol_text_search(spark, sf_dir):
    return symbols.text_search(_symbols(spark, sf_dir), 'fetch order OR "the record"', symbol_type="method").select(_COLS)


INDEX_QUERY = "fetch AND order OR NEAR(save record, 1) NOT qualified_name:class0*"


def _indexed(spark, sf_dir):
    table = _symbols(spark, sf_dir)
    return table, text_index.TextIndex.build(table, shared_folder(spark, f"text-index-{uuid.uuid4().hex}"), "chunk_id", ["name", "qualified_name"])


def symbol_index_search(spark, sf_dir):
    """All symbols that match a query with AND, OR, NOT, NEAR and a field, with their scores."""
    table, index = _indexed(spark, sf_dir)
    return text_index.indexed_search(table, index, INDEX_QUERY, None).select("chunk_id", "name", _round())


def symbol_index_phrases(spark, sf_dir):
    """The fifty best for a prefix, or a phrase in brackets with a word."""
    table, index = _indexed(spark, sf_dir)
    return text_index.indexed_search(table, index, '(("the record" class1) OR hand*)', 50, symbol_type="method").select("chunk_id", "name", _round())


def _bm25_sql(leaves: dict[str, str], where: str) -> str:
    """``leaves``: a name for each phrase and how often it occurs in a token list ``x``."""
    counts = ", ".join(f"{expr.replace('@x', 'tn')} + {expr.replace('@x', 'tq')} AS {name}" for name, expr in leaves.items())
    idf = ", ".join(f"greatest(ln((count(*) - count(*) FILTER ({n} > 0) + 0.5) / (count(*) FILTER ({n} > 0) + 0.5)), 1e-6) AS i_{n}" for n in leaves)
    score = " + ".join(f"i_{n} * {n} * 2.2 / ({n} + 1.2 * (0.25 + 0.75 * size / mean))" for n in leaves)
    listed = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    return f"""WITH {SYMBOL_CTE}, t AS (SELECT *, {listed('name')} AS tn, {listed('qualified_name')} AS tq FROM symbols),
f AS (SELECT *, len(tn) + len(tq) AS size, {counts} FROM t), g AS (SELECT avg(size) AS mean, {idf} FROM f)
SELECT chunk_id, name, round({score}, 6) AS score FROM f, g WHERE {where}"""


def _times(word: str) -> str:
    return f"len(list_filter(@x, lambda x: x = '{word}'))"


INDEX_SQL = _bm25_sql(
    {f"w_{w}": _times(w) for w in ("fetch", "order", "save", "record")},
    "w_fetch > 0 AND w_order > 0 OR (list_position(tn, 'record') - list_position(tn, 'save') BETWEEN 0 AND 2 OR list_position(tq, 'record') - list_position(tq, 'save') BETWEEN 0 AND 2)"
    " AND len(list_filter(tq, lambda x: starts_with(x, 'class0'))) = 0",
)
PHRASE_SQL = _bm25_sql(
    {"p": "(contains(' ' || array_to_string(@x, ' ') || ' ', ' the record '))::INT", "c": _times("class1"), "h": "len(list_filter(@x, lambda x: starts_with(x, 'hand')))"},
    "symbol_type = 'method' AND (p > 0 AND c > 0 OR h > 0) ORDER BY score DESC, chunk_id LIMIT 50",
)


def symbol_children(spark, sf_dir):
    return symbols.children(_symbols(spark, sf_dir), "Class0").select(_COLS)


def symbol_by_type(spark, sf_dir):
    return symbols.by_type(_symbols(spark, sf_dir), "interface", limit=100).select(_COLS)


def symbol_by_file(spark, sf_dir):
    t = _symbols(spark, sf_dir)
    return symbols.by_file(t, "src1", "src/en/test_mod_0.py").select(_COLS)


def chunk_by_id(spark, sf_dir):
    return symbols.chunk_by_id(views.chunks(spark, sf_dir), "d17").select("id", "name", F.length("content").cast("bigint").alias("length"))


def chunks_by_file(spark, sf_dir):
    return symbols.chunks_by_file(views.chunks(spark, sf_dir), "src2", "src/en/mod_0.py").select("id", "name", "start_line")


def vector_metadata(spark, sf_dir):
    return formatting.vector_metadata(views.chunks(spark, sf_dir))


def symbol_fuzzy(spark, sf_dir):
    return symbols.fuzzy(_symbols(spark, sf_dir), "userdata1").select(_COLS)


def file_suffix_lookup(spark, sf_dir):
    return symbols.files_ending_with(_symbols(spark, sf_dir), "fr/mod_0.ts")


def class_members(spark, sf_dir):
    return symbols.class_members(_symbols(spark, sf_dir))


def related_chunks(spark, sf_dir):
    c = views.chunks(spark, sf_dir)
    return symbols.related(c, c.where("chunk_type = 'method'")).select("target_id", "relation", F.col("rank").cast("bigint").alias("rank"), "id", "name")


QUERIES = {
    "vector_topk": (vector_topk, VECTOR_SQL + "SELECT vec_id, label, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 20"),
    "vector_index_topk": (vector_index_topk, VECTOR_SQL + "SELECT vec_id, label, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 20"),
    "vector_index_many": (vector_index_many, VECTOR_MANY_SQL),
    "vector_index_recall": (vector_index_recall, "SELECT count(*) FILTER (WHERE vec_id % 50 = 0) AS queries, 10 * count(*) FILTER (WHERE vec_id % 50 = 0) AS wanted, true AS recall_reached, count(*) AS vectors, true AS one_list_each FROM embeddings"),
    "vector_topk_filtered": (vector_topk_filtered, VECTOR_SQL + "SELECT vec_id, label, round(score, 6) AS score FROM s WHERE label = 3 AND s.score >= 0.35 ORDER BY s.score DESC, vec_id LIMIT 10"),
    "vector_topk_per_label": (vector_topk_per_label, VECTOR_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT label, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 3"),
    "hybrid_search": (hybrid_search, _hybrid_sql(None, 10, 30, SUMMARY_SQL)),
    "hybrid_search_filtered": (hybrid_search_filtered, _hybrid_sql("chunk_type = 'class' AND language = 'python'", 5, 15, SUMMARY_SQL + PREVIEW_SQL)),
    "keyword_boost": (keyword_boost, f"WITH {CHUNK_CTE} SELECT id, round({_boost_sql()}, 6) AS boost FROM chunks"),
    "query_expansion": (query_expansion, _expansion_sql()),
    "chunk_texts": (chunk_texts, _text_sql() + f", x AS (SELECT *, {EMBEDDING_TEXT_SQL} AS txt FROM u) SELECT id, coalesce(p || '.', '') || name AS qualified_name, array_to_string(kw, ' ') AS keywords, purpose, length(txt) AS text_length, sha256(txt) AS text_hash FROM x"),
    "chunk_embeddings": (chunk_embeddings, _text_sql() + f", x AS (SELECT id, sha256({EMBEDDING_TEXT_SQL}) AS h FROM u) SELECT id, 768::BIGINT AS dimension, " + ", ".join(f"round((('0x' || h[{2 * (i % 32) + 1}:{2 * (i % 32) + 2}])::INT / 255.0::DOUBLE * 2 - 1)::FLOAT::DOUBLE, 4) AS v{i}" for i in (0, 1, 31, 32)) + " FROM x"),
    "chunk_id_hash": (chunk_id_hash, f"WITH {CHUNK_CTE} SELECT id, sha256(concat_ws(':', repo_name, file_path, name, chunk_type, start_line))[1:16] AS chunk_id FROM chunks"),
    "chunk_views": (chunk_views, f"WITH {CHUNK_CTE}, v AS (SELECT {SUMMARY_SQL} {PREVIEW_SQL} FROM chunks) SELECT * REPLACE (sha256(preview) AS preview) FROM v"),
    "symbol_lookup_exact": (symbol_lookup_exact, f"WITH {SYMBOL_CTE} SELECT {SYMBOL_COLUMNS} FROM symbols WHERE name = 'main' OR qualified_name = 'main'"),
    "symbol_prefix_search": (symbol_prefix_search, f"WITH {SYMBOL_CTE}, t AS (SELECT *, {TOKENS_SQL} AS tk FROM symbols) SELECT {SYMBOL_COLUMNS}, len(tk) AS token_count FROM t WHERE len(list_filter(tk, lambda x: starts_with(x, 'fetch'))) > 0 ORDER BY list_contains(tk, 'fetch') DESC, len(tk), qualified_name, repo_name, file_path, start_line LIMIT 50"),
    "symbol_index_search": (symbol_index_search, INDEX_SQL),
    "symbol_index_phrases": (symbol_index_phrases, PHRASE_SQL),
    "symbol_text_search": (symbol_text_search, f"WITH {SYMBOL_CTE}, t AS (SELECT *, {TOKENS_SQL} AS tk FROM symbols) SELECT {SYMBOL_COLUMNS} FROM t WHERE symbol_type = 'method' AND ((list_contains(tk, 'fetch') AND list_contains(tk, 'order')) OR contains(' ' || array_to_string(tk, ' ') || ' ', ' the record ')) ORDER BY len(tk), qualified_name, repo_name, file_path, start_line LIMIT 50"),
    "symbol_children": (symbol_children, f"WITH {SYMBOL_CTE} SELECT {SYMBOL_COLUMNS} FROM symbols WHERE parent_name = 'Class0'"),
    "symbol_by_type": (symbol_by_type, f"WITH {SYMBOL_CTE} SELECT {SYMBOL_COLUMNS} FROM symbols WHERE symbol_type = 'interface' ORDER BY name, repo_name, file_path, start_line LIMIT 100"),
    "symbol_by_file": (symbol_by_file, f"WITH {SYMBOL_CTE} SELECT {SYMBOL_COLUMNS} FROM symbols WHERE repo_name = 'src1' AND file_path = 'src/en/test_mod_0.py'"),
    "chunk_by_id": (chunk_by_id, f"WITH {CHUNK_CTE} SELECT id, name, length(content) AS length FROM chunks WHERE id = 'd17'"),
    "chunks_by_file": (chunks_by_file, f"WITH {CHUNK_CTE} SELECT id, name, start_line FROM chunks WHERE repo_name = 'src2' AND file_path = 'src/en/mod_0.py'"),
    "vector_metadata": (vector_metadata, f"WITH {CHUNK_CTE} SELECT id, repo_name, file_path, start_line, end_line, chunk_type, name, coalesce(parent_name, '') AS parent_name, language, coalesce(docstring <> '', false) AS has_docstring FROM chunks"),
    "symbol_fuzzy": (symbol_fuzzy, f"WITH {SYMBOL_CTE} SELECT {SYMBOL_COLUMNS} FROM symbols WHERE name = 'userdata1' OR qualified_name = 'userdata1' OR contains(lower(name), 'userdata1') ORDER BY name <> 'userdata1', qualified_name <> 'userdata1', qualified_name, repo_name, file_path, start_line LIMIT 5"),
    "file_suffix_lookup": (file_suffix_lookup, f"WITH {SYMBOL_CTE} SELECT DISTINCT repo_name, file_path FROM symbols WHERE ends_with(file_path, 'fr/mod_0.ts') ORDER BY repo_name, file_path LIMIT 1"),
    "class_members": (class_members, f"WITH {SYMBOL_CTE} SELECT t.repo_name, t.file_path, t.name AS class_name, t.start_line AS class_line, t.symbol_type AS class_type, m.name AS member_name, m.symbol_type AS member_type, m.start_line AS member_line FROM symbols t LEFT JOIN symbols m ON nullif(m.parent_name, '') IS NOT NULL AND m.repo_name = t.repo_name AND m.file_path = t.file_path AND m.parent_name = t.name WHERE t.symbol_type IN ('class', 'interface')"),
    "related_chunks": (related_chunks, f"""WITH {CHUNK_CTE}, t AS (SELECT * FROM chunks WHERE chunk_type = 'method'),
r AS (SELECT t.id AS target_id, c.*, CASE WHEN nullif(t.parent_name, '') IS NOT NULL AND c.name = t.parent_name THEN 'parent' WHEN nullif(t.parent_name, '') IS NOT NULL AND c.parent_name = t.parent_name AND c.name <> t.name THEN 'sibling'
  WHEN nullif(t.parent_name, '') IS NULL AND nullif(c.parent_name, '') IS NULL THEN 'same_file' END AS relation
 FROM t JOIN chunks c ON c.repo_name = t.repo_name AND c.file_path = t.file_path AND c.id <> t.id),
n AS (SELECT *, row_number() OVER (PARTITION BY target_id, relation ORDER BY start_line, name, id) AS rank FROM r WHERE relation IS NOT NULL)
SELECT target_id, relation, rank, id, name FROM n"""),
}
