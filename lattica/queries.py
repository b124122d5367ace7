"""Every registered query of the library's own operators, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import html as H
from .functions import metrics as M
from .functions import text as T
from .functions.filters import apply_filter
from .operators import chunking, embed, index, pairs, retrieval, search, stats
from .operators.chunking import ChunkConfig
from .operators.embed import VectorizerConfig
from .sources import catalog, documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# vectors

_QUERY = "(SELECT embedding::DOUBLE[] AS query FROM embeddings WHERE vec_id = 0)"
_SIMILARITY = {
    "cosine": "list_cosine_similarity(embedding::DOUBLE[], query)", "euclidean": "1 / (1 + list_distance(embedding::DOUBLE[], query))", "dot_product": "list_inner_product(embedding::DOUBLE[], query)",
    "manhattan": "1 / (1 + list_sum(list_transform(list_zip(embedding::DOUBLE[], query), lambda x: abs(x[1] - x[2]))))",
}
_DISTANCE = {
    "cosine": "1 - list_cosine_similarity(embedding::DOUBLE[], query)", "euclidean": "list_distance(embedding::DOUBLE[], query)", "dot_product": "-list_inner_product(embedding::DOUBLE[], query)",
    "manhattan": "list_sum(list_transform(list_zip(embedding::DOUBLE[], query), lambda x: abs(x[1] - x[2])))",
}


def _with_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings beside vec_id 0's vector, which is one row by its key."""
    rows = _table(spark, sf_dir, "embeddings")
    return rows.crossJoin(F.broadcast(rows.where("vec_id = 0").select(F.col("embedding").cast("array<double>").alias("query"))))


def _page(rows: DataFrame, limit: int, offset: int = 0, ascending: bool = False) -> DataFrame:
    """``vec_id, score, rank`` of a page."""
    top = search.ranked(rows.select("vec_id", "score"), limit, offset, id_col="vec_id", ascending=ascending)
    order = F.col("score").asc() if ascending else F.col("score").desc()
    return top.select("vec_id", M.rounded(F.col("score"), 6).alias("score"), (F.row_number().over(Window.orderBy(order, "vec_id")) + offset).alias("rank"))


def _knn(metric: str, limit: int = 10, offset: int = 0, spec: dict | None = None, min_score: float | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = search.scored(apply_filter(_with_query(spark, sf_dir), spec), F.col("query"), metric, "embedding")
        return _page(rows if min_score is None else rows.where(F.col("score") >= min_score), limit, offset)

    return run


def _knn_sql(metric: str, limit: int = 10, offset: int = 0, where: str = "true") -> str:
    return f"""SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id)::INT + {offset} AS rank FROM (
SELECT * FROM (SELECT vec_id, label, {_SIMILARITY[metric]} AS score FROM embeddings, {_QUERY}) WHERE {where} ORDER BY score DESC, vec_id LIMIT {limit} OFFSET {offset})"""


for _m in _SIMILARITY:
    _register(f"knn_{_m}", _knn(_m), _knn_sql(_m))
_register("knn_filtered", _knn("cosine", spec={"field": "label", "operator": "in", "value": [0, 2, 4, 6, 8]}), _knn_sql("cosine", where="label IN (0, 2, 4, 6, 8)"))
_register("knn_offset", _knn("cosine", 10, 20), _knn_sql("cosine", 10, 20))
_register("knn_min_score", _knn("cosine", 10, min_score=0.3), _knn_sql("cosine", where="score >= 0.3"))
_register(
    "knn_total", lambda s, d: search.candidates(_table(s, d, "embeddings"), {"field": "label", "operator": "lt", "value": 5}), "SELECT count(*) AS total FROM embeddings WHERE label < 5"
)


def _index(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _page(_with_query(spark, sf_dir).withColumn("score", M.index_distance(metric, F.col("embedding"), F.col("query"))), 10, ascending=True)

    return run


for _m in _DISTANCE:
    _register(
        f"index_distance_{_m}", _index(_m),
        f"""SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score, vec_id)::INT AS rank FROM (
SELECT vec_id, {_DISTANCE[_m]} AS score FROM embeddings, {_QUERY} ORDER BY score, vec_id LIMIT 10)""",
    )

_NORM = "sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))"
_register("vec_norm", lambda s, d: _table(s, d, "embeddings").select("vec_id", M.rounded(M.norm(F.col("embedding")), 6).alias("norm")), f"SELECT vec_id, round({_NORM}, 6) AS norm FROM embeddings")
_register(
    "vec_normalize",
    lambda s, d: _table(s, d, "embeddings").select("vec_id", F.transform(M.normalize(F.col("embedding")), lambda x: M.rounded(x, 6)).alias("unit")),
    f"SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x / {_NORM}, 6)) AS unit FROM embeddings",
)
_register(
    "vec_parse",
    lambda s, d: _table(s, d, "embeddings").select("vec_id", F.to_json("embedding").alias("written")).select("vec_id", F.size(M.parse_vector_column(F.col("written"))).alias("dims"), M.rounded(M.norm(M.parse_vector_column(F.col("written"))), 5).alias("norm")),
    f"SELECT vec_id, len(embedding)::INT AS dims, round({_NORM}, 5) AS norm FROM embeddings",
)


def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest rows of every row, itself among them."""
    rows = _table(spark, sf_dir, "embeddings")
    queries = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.knn_join(rows, queries, 10).withColumn("score", M.rounded(F.col("score"), 6))


_register(
    "knn_batch", knn_batch,
    """SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, e.vec_id)::INT AS rank
FROM embeddings e, embeddings q) WHERE rank <= 10""",
)


def knn_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest to vec_id 0 in each label."""
    rows = search.scored(_with_query(spark, sf_dir), F.col("query"), "cosine", "embedding").select("label", "vec_id", "score")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where("rank <= 3").withColumn("score", M.rounded(F.col("score"), 6))


_register(
    "knn_by_label", knn_by_label,
    f"""SELECT label, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id)::INT AS rank FROM (
SELECT label, vec_id, {_SIMILARITY["cosine"]} AS score FROM embeddings, {_QUERY})) WHERE rank <= 3""",
)
_PAIRS = "SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id"
_register("pairwise_matrix", lambda s, d: pairs.pairwise(_table(s, d, "embeddings")).withColumn("score", M.rounded(F.col("score"), 6)), f"SELECT a, b, round(score, 6) AS score FROM ({_PAIRS})")
_register(
    "score_histogram",
    lambda s, d: pairs.pairwise_histogram(_table(s, d, "embeddings")).select("bucket", "n", *[M.rounded(F.col(c), 6).alias(c) for c in ("min_score", "max_score", "avg_score")]),
    f"""SELECT CASE WHEN score > 0.5 THEN 'high' WHEN score >= 0.2 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n,
round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, round(avg(score), 6) AS avg_score FROM ({_PAIRS}) GROUP BY 1""",
)

# filters: on JSON metadata, on columns

_K = "TRY_CAST(json_extract(props, '$.k') AS DOUBLE)"
_FILTERS = {
    "eq": ({"field": "k", "operator": "eq", "value": 42}, f"{_K} = 42"),
    "ne": ({"field": "k", "operator": "ne", "value": 42}, f"{_K} IS DISTINCT FROM 42"),
    "gt": ({"field": "k", "operator": "gt", "value": 90}, f"{_K} > 90"),
    "gte": ({"field": "k", "operator": "gte", "value": 90}, f"{_K} >= 90"),
    "lt": ({"field": "k", "operator": "lt", "value": 10}, f"{_K} < 10"),
    "lte": ({"field": "k", "operator": "lte", "value": 10}, f"{_K} <= 10"),
    "in": ({"field": "k", "operator": "in", "value": [1, 2, 3]}, f"{_K} IN (1, 2, 3)"),
    "not_in": ({"field": "k", "operator": "not_in", "value": [1, 2, 3]}, f"({_K} IN (1, 2, 3)) IS NOT TRUE"),
    "contains": ({"field": "event_type", "operator": "contains", "value": "c"}, "contains(event_type, 'c')"),
    "exists": ({"field": "k", "operator": "exists", "value": True}, f"{_K} IS NOT NULL"),
    "missing": ({"field": "nowhere", "operator": "exists", "value": True}, "json_extract(props, '$.nowhere') IS NOT NULL"),
    "and": ({"and": [{"field": "k", "operator": "gte", "value": 20}, {"field": "value", "operator": "gt", "value": 50}]}, f"{_K} >= 20 AND value > 50"),
    "or": ({"or": [{"field": "k", "operator": "lt", "value": 5}, {"field": "event_type", "operator": "eq", "value": "click"}]}, f"{_K} < 5 OR event_type = 'click'"),
    "not": ({"not": {"field": "k", "operator": "gt", "value": 10}}, f"NOT coalesce({_K} > 10, false)"),
    "nested": ({"and": [{"or": [{"field": "k", "operator": "lt", "value": 10}, {"not": {"field": "k", "operator": "lte", "value": 80}}]}, {"user_id": 7}]}, f"({_K} < 10 OR NOT coalesce({_K} <= 80, false)) AND user_id = 7"),
    "shorthand": ({"event_type": "click", "k": 7}, f"event_type = 'click' AND {_K} = 7"),
    "wrong_type": ({"field": "k", "operator": "eq", "value": "42"}, "json_type(props, '$.k') = 'VARCHAR' AND json_extract_string(props, '$.k') = '42'"),
}
for _name, (_spec, _where) in _FILTERS.items():
    _register(f"filter_{_name}", lambda s, d, spec=_spec: apply_filter(_table(s, d, "events"), spec, "props").select("event_id", "event_type", "props"), f"SELECT event_id, event_type, props FROM events WHERE {_where}")
_register(
    "filter_typed_pushdown",
    lambda s, d: apply_filter(_table(s, d, "lineitem"), {"and": [{"l_quantity": {"gte": 45}}, {"l_returnflag": ["A", "R"]}]}).groupBy("l_returnflag").agg(F.count("*").alias("n")),
    "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity >= 45 AND l_returnflag IN ('A', 'R') GROUP BY 1",
)
_register(
    "filter_joined_metadata",
    lambda s, d: apply_filter(_table(s, d, "documents").select("doc_id", "lang", "source").join(_table(s, d, "labels"), "doc_id"), {"quality": 1, "toxic": 0, "lang": ["en", "de"]}).select("doc_id", "lang", "source"),
    "SELECT doc_id, lang, source FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0 AND lang IN ('en', 'de')",
)

# tables

def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of the building segment, with a higher balance: what is to be written over the table."""
    return _table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").withColumn("c_acctbal", F.col("c_acctbal") + 1000)


_register(
    "upsert_replace", lambda s, d: catalog.upsert(_table(s, d, "customer"), _changed(s, d), "c_custkey").select("c_custkey", M.rounded(F.col("c_acctbal"), 2).alias("c_acctbal")),
    "SELECT c_custkey, round(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1000 ELSE c_acctbal END, 2) AS c_acctbal FROM customer",
)
_register(
    "upsert_last_wins", lambda s, d: catalog.latest(_table(s, d, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type"),
    "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
)
_register(
    "delete_anti", lambda s, d: _table(s, d, "documents").select("doc_id", "source").join(_table(s, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti"),
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
_register("get_by_id", lambda s, d: _table(s, d, "documents").where("doc_id = 7").select("doc_id", "text", "lang"), "SELECT doc_id, text, lang FROM documents WHERE doc_id = 7")
_register(
    "collection_info", lambda s, d: stats.collection_info(_table(s, d, "embeddings"), "vec_id", "embedding"),
    "SELECT count(*) AS vector_count, max(len(embedding))::INT AS dimensions, sum(4 * len(embedding) + strlen(vec_id::VARCHAR))::BIGINT AS bytes FROM embeddings",
)
_register(
    "database_stats",
    lambda s, d: stats.stats_by(_table(s, d, "embeddings"), F.concat(F.lit("label_"), F.col("label")), "vec_id", "embedding"),
    "SELECT 'label_' || label AS collection, count(*) AS vector_count, max(len(embedding))::INT AS dimensions, sum(4 * len(embedding) + strlen(vec_id::VARCHAR))::BIGINT AS bytes FROM embeddings GROUP BY label",
)
_register(
    "memory_estimate",
    lambda s, d: _table(s, d, "embeddings").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims")).select(*[stats.memory_estimate(F.col("n"), F.col("dims"), k).alias(k) for k in ("flat", "hnsw", "ivf")]),
    "SELECT n * dims * 4 + 64 * n AS flat, n * dims * 4 + 192 * n + 128 * n AS hnsw, n * dims * 4 AS ivf FROM (SELECT count(*) AS n, max(len(embedding)) AS dims FROM embeddings)",
)

# text

_CLEAN = r"trim(regexp_replace(regexp_replace(text, '[\t\n\f\r ]+', ' ', 'g'), '[^\p{L}\p{M}\p{N}\p{P}\p{S} \n\t]', '', 'g'), E' \t\n\f\r')"
_SPLIT = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?]+)[\t\n\f\r ]+', E'\\1\x01', 'g'), E'\x01'), lambda s: trim(s, E' \t\n\f\r')), lambda s: s <> '')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


_register("clean_text", lambda s, d: _docs(s, d).select("doc_id", T.clean_text(F.col("text")).alias("cleaned")), f"SELECT doc_id, {_CLEAN} AS cleaned FROM documents")
_register(
    "text_counts",
    lambda s, d: _docs(s, d).select("doc_id", T.count_words(F.col("text")).alias("words"), T.count_bytes(F.col("text")).alias("bytes"), T.count_lines(F.col("text")).alias("lines"), T.count_sentences(F.col("text")).alias("sentences"), T.estimated_tokens(F.col("text")).alias("tokens")),
    r"""SELECT doc_id, len(regexp_extract_all(text, '[^\t\n\f\r ]+'))::INT AS words, strlen(text)::INT AS bytes, (length(text) - length(replace(text, E'\n', '')) + 1)::INT AS lines,
len(regexp_extract_all(text, '[.!?]+'))::INT AS sentences, length(text) // 4 AS tokens FROM documents""",
)
_register("sentence_split", lambda s, d: _docs(s, d).select("doc_id", T.split_sentences(F.col("text")).alias("sentences")), f"SELECT doc_id, {_SPLIT} AS sentences FROM documents")
_register(
    "documents_by_language",
    lambda s, d: stats.documents_by_type(_docs(s, d).withColumn("size", F.octet_length("text")), "lang").withColumn("avg_size", M.rounded(F.col("avg_size"), 6)),
    "SELECT lang AS type, count(*) AS documents, sum(strlen(text))::BIGINT AS total_size, round(avg(strlen(text)), 6) AS avg_size FROM documents GROUP BY lang",
)
_register(
    "document_titles",
    lambda s, d: _docs(s, d).select("doc_id", T.text_title(F.col("text"), F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".txt"))).alias("title")),
    r"""SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, E'\n'), lambda l: trim(l, E' \t\n\f\r')), lambda l: l <> '' AND strlen(l) < 100 AND NOT contains(l, E'\t'))[1], 'doc-' || doc_id) AS title FROM documents""",
)
_register(
    "repository_stats",
    lambda s, d: stats.repository_stats(_docs(s, d).select(F.octet_length("text").alias("size"), F.col("lang").alias("language"))),
    "SELECT count(*) AS files, sum(strlen(text))::BIGINT AS total_size, list_sort(list(DISTINCT lang)) AS languages FROM documents",
)

# pages

_DECODED = "h3"
for _e, _c in H.ENTITIES.items():
    _DECODED = f"replace({_DECODED}, '{_e}', '{_c.replace(chr(39), chr(39) * 2)}')"
_PAGE_TEXT = rf"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g') AS h1 FROM pages),
b AS (SELECT page_id, regexp_replace(h1, '(?is)<style[^>]*>.*?</style>', '', 'g') AS h2 FROM a), c AS (SELECT page_id, regexp_replace(h2, '(?is)<!--.*?-->', '', 'g') AS h3 FROM b),
e AS (SELECT page_id, regexp_replace({_DECODED}, '<[^>]+>', ' ', 'g') AS text FROM c)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages")


_register("html_text", lambda s, d: _pages(s, d).select("page_id", H.html_text(F.col("html")).alias("content")), f"{_PAGE_TEXT} SELECT page_id, {_CLEAN} AS content FROM e")
_register(
    "html_title", lambda s, d: _pages(s, d).select("page_id", H.html_title(F.col("html")).alias("title")),
    rf"WITH t AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), E' \t\n\f\r') AS h3 FROM pages) SELECT page_id, {_DECODED} AS title FROM t",
)
_register(
    "html_counts", lambda s, d: _pages(s, d).select("page_id", *[v.alias(k) for k, v in H.html_counts(F.col("html")).items()]),
    r"""SELECT page_id, len(regexp_extract_all(html, '(?i)<a\s+[^>]*href'))::INT AS link_count, len(regexp_extract_all(html, '(?i)<img\s+[^>]*src'))::INT AS image_count,
len(regexp_extract_all(html, '(?i)<h[1-6][^>]*>'))::INT AS heading_count FROM pages""",
)
_register(
    "html_language", lambda s, d: _pages(s, d).select("page_id", H.html_lang(F.col("html")).alias("lang"), H.html_charset(F.col("html")).alias("charset")),
    r"""SELECT page_id, nullif(regexp_extract(html, '(?i)<html[^>]+lang=["'']([^"'']+)["'']', 1), '') AS lang, nullif(regexp_extract(html, '(?i)<meta[^>]+charset=["'']?([A-Za-z0-9_-]+)', 1), '') AS charset FROM pages""",
)
_register("html_meta", lambda s, d: _pages(s, d).select("page_id", F.sort_array(F.map_entries(H.html_meta(F.col("html")))).alias("meta")).select("page_id", F.to_json("meta").alias("meta")))
_register(
    "url_domain", lambda s, d: _pages(s, d).groupBy(T.url_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages")),
    r"SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)) AS domain, count(*) AS pages FROM pages GROUP BY 1",
)
_register("main_content", lambda s, d: _pages(s, d).select("page_id", H.main_content(F.col("html")).alias("content")))

# chunks

_SMALL = ChunkConfig(512, 64, 50)


def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _docs(spark, sf_dir).select("doc_id", F.explode(chunking.fixed_chunk_columns(F.col("text"))).alias("c"))
    return pieces.select("doc_id", "c.position", "c.start_pos", "c.end_pos", "c.content")


_register(
    "chunk_fixed", chunk_fixed,
    """SELECT doc_id, i::INT AS position, (i * 896)::INT AS start_pos, least(i * 896 + 1024, length(text))::INT AS end_pos, substring(text, (i * 896 + 1)::INT, 1024) AS content FROM (
SELECT doc_id, text, unnest(range(greatest(0, ceil((length(text) - 1024) / 896.0))::INT + 1)) AS i FROM documents WHERE length(text) > 0)""",
)
for _strategy in ("sentence", "paragraph", "smart", "token", "tail_overlap"):
    _register(f"chunk_{_strategy}", lambda s, d, k=_strategy: chunking.chunk_documents(_docs(s, d), k, _SMALL).select("doc_id", "position", "content", "size"))


def number_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = chunk_fixed(spark, sf_dir).select("doc_id", "position")
    return retrieval.number_chunks(pieces).select("original_doc_id", "chunk_index", "total_chunks", "is_chunk")


_register(
    "number_chunks", number_chunks,
    """SELECT doc_id AS original_doc_id, unnest(range(n))::INT AS chunk_index, n AS total_chunks, n > 1 AS is_chunk FROM (
SELECT doc_id, greatest(0, ceil((length(text) - 1024) / 896.0))::BIGINT + 1 AS n FROM documents WHERE length(text) > 0)""",
)


def group_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = chunk_fixed(spark, sf_dir).withColumn("document_id", F.col("doc_id").cast("string"))
    return retrieval.group_chunks(pieces).select("document", "total_chunks", "total_size", F.col("chunks")[0]["preview"].alias("first_preview"))


_register(
    "group_chunks", group_chunks,
    f"SELECT doc_id::VARCHAR AS document, count(*) AS total_chunks, sum(length(content))::BIGINT AS total_size, left(arg_min(content, position), 200) AS first_preview FROM ({ORACLE_SQL['chunk_fixed']}) GROUP BY doc_id",
)

# embedding and text search

_HASH = VectorizerConfig("hash", dimensions=128)


def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = embed.embed_column(_table(spark, sf_dir, "benchmark"), _HASH)
    return made.select("item_id", F.size("vector").alias("dims"), M.rounded(M.norm(F.col("vector")), 4).alias("norm"))


_register("embed_hash", embed_hash)


def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents nearest to each benchmark passage."""
    queries = embed.embed_column(_table(spark, sf_dir, "benchmark").select("item_id", "text"), _HASH).select(F.col("item_id").alias("query_id"), F.col("vector").alias("query"))
    rows = embed.embed_column(_docs(spark, sf_dir).select("doc_id", "text"), _HASH).select(F.col("doc_id").alias("id"), "vector")
    return search.knn_join(rows, queries, 10, "cosine", "id", "vector").withColumn("score", M.rounded(F.col("score"), 6))


def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _pages(spark, sf_dir).select(F.concat(F.lit("page-"), F.col("page_id"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    return documents.ingest(documents.process_documents(files), _HASH, "sentence").select("id", "metadata", "content", F.size("vector").alias("dims"), "error")


_register("search_text", search_text)
_register("ingest_documents", ingest_documents)

# retrieval

def _scored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scored(_with_query(spark, sf_dir), F.col("query"), "cosine", "embedding").drop("query", "embedding").withColumnRenamed("vec_id", "id")


def multi_collection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even and odd labels as collections: each one's top ten of at least 0.1, the best ten of all."""
    rows = _with_query(spark, sf_dir).withColumnRenamed("vec_id", "id")
    parts = {name: rows.where(f"label % 2 {sign} 0") for name, sign in (("even", "="), ("odd", "!="))}
    found = retrieval.multi_search(parts, F.col("query"), "cosine", 10, 0.1, vector_col="embedding", dedup=False)
    return found.select("collection", "id", M.rounded(F.col("score"), 6).alias("score"))


_register(
    "multi_collection_search", multi_collection_search,
    f"""SELECT CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS collection, vec_id AS id, round(score, 6) AS score FROM (
SELECT vec_id, label, {_SIMILARITY["cosine"]} AS score FROM embeddings, {_QUERY}) WHERE score >= 0.1 ORDER BY score DESC, vec_id LIMIT 10""",
)


def multi_source_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored_table(spark, sf_dir)
    found = retrieval.multi_source({"web": rows.where("label % 2 = 0"), "documents": rows.where("label % 2 = 1")}, 10, 0.3)
    return found.select("source_type", "id", M.rounded(F.col("score"), 6).alias("score"), "rank")


_register(
    "multi_source_search", multi_source_search,
    f"""SELECT source_type, id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM (SELECT * FROM (
SELECT CASE WHEN label % 2 = 0 THEN 'web' ELSE 'documents' END AS source_type, vec_id AS id, {_SIMILARITY["cosine"]} AS score FROM embeddings, {_QUERY}) ORDER BY score DESC, id LIMIT 10) WHERE score >= 0.3""",
)
_register(
    "dedup_best", lambda s, d: retrieval.dedup_best(_scored_table(s, d), F.col("label")).select("id", "label", M.rounded(F.col("score"), 6).alias("score")),
    f"""SELECT id, label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS n FROM (
SELECT vec_id AS id, label, {_SIMILARITY["cosine"]} AS score FROM embeddings, {_QUERY})) WHERE n = 1""",
)


def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation the newest messages that fit 200 tokens."""
    rows = _table(spark, sf_dir, "conversations").withColumn("recency", F.col("turn").cast("double"))
    return retrieval.fit_context(rows, 200, "conv_id", "text", "recency", "turn").select("conv_id", "turn", "tokens", "running_tokens")


_register(
    "context_window", context_window,
    """SELECT * FROM (SELECT conv_id, turn, length(text) // 4 AS tokens, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS running_tokens FROM conversations)
WHERE running_tokens <= 200""",
)
_register(
    "chat_history_page", lambda s, d: retrieval.history(_table(s, d, "conversations"), 1, 1, 3).select("conv_id", "turn", "role", "text"),
    "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 1 ORDER BY turn LIMIT 3 OFFSET 1",
)
_register(
    "chat_last5", lambda s, d: retrieval.last_messages(_table(s, d, "conversations")).select("conv_id", "turn", "role"),
    "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 5",
)
_register(
    "chat_sessions", lambda s, d: retrieval.sessions(_table(s, d, "conversations")),
    "SELECT conv_id, count(*) AS messages, arg_min(text, turn) FILTER (role = 'user') AS opening, max(turn) AS last_turn FROM conversations GROUP BY conv_id",
)


def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("item "), F.col("item_id")).alias("title"), F.col("text").alias("content"), (1.0 / (F.col("item_id") + 1)).alias("score"))
    return retrieval.prompt_context(rows)


_register(
    "prompt_context", prompt_context,
    r"SELECT string_agg('--- Source: item ' || item_id || ' (Score: ' || printf('%.3f', 1.0::DOUBLE / (item_id + 1)) || E') ---\n' || text, E'\n\n' ORDER BY item_id) AS context FROM benchmark",
)
_register(
    "new_urls", lambda s, d: retrieval.new_urls(_pages(s, d).select("url"), _pages(s, d).where("page_id % 2 = 0").select("url")),
    r"""WITH k AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') AS key FROM pages)
SELECT min(url) AS url FROM k WHERE key NOT IN (SELECT key FROM k WHERE page_id % 2 = 0) GROUP BY key""",
)

# indexes

def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))


def _held_out(n: int = 20, dims: int = 64) -> list[list[float]]:
    """Query vectors that are in no table."""
    import random

    draw = random.Random(5)
    return [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(n)]


def hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index.HnswIndex("cosine").build(_vectors(spark, sf_dir)).search_many(_held_out(), 10)
    return found.withColumn("distance", M.rounded(F.col("distance"), 6))


def hnsw_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at ten against exact search, for vectors that aren't in the index."""
    q = _held_out()
    exact = search.batch_search(_table(spark, sf_dir, "embeddings"), list(range(len(q))), q, 10).select(F.col("query_id").cast("int").alias("query_id"), F.col("id").cast("string").alias("id"))
    return index.recall(hnsw_search(spark, sf_dir), exact)


_register("hnsw_search", hnsw_search)
_register("hnsw_recall", hnsw_recall)
_register("hnsw_stats", lambda s, d: stats.index_stats(index.HnswIndex("cosine").build(_vectors(s, d)).nodes).select("vectors", "edges", "max_layer", "bytes"))
_register("ivf_search", lambda s, d: index.IvfIndex("cosine", 16, 8).build(_vectors(s, d)).search(_held_out(1)[0], 10).withColumn("distance", M.rounded(F.col("distance"), 6)))
_register("supported_formats", lambda s, d: documents.supported_formats(s).select("type", "supported"))
