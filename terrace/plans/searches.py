"""Queries of search, fusion, funnel and merge over chapters and documents, with their SQL.

The evaluation passages serve as questions, whole; a share of common terms stands for a model's judgement. The index
holds the cold documents. As the tables store no chapters for these, their plain text is cut into the store's windows,
which SQL can follow; ``cold_index_search`` searches chapters cut from their Markdown instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.markdown import Piece
from terrace.functions.vectors import hash_counts
from terrace.operators import retrieval as r
from terrace.operators.chunking import last_by_path, split_chapters
from terrace.operators.tiering import accessed
from terrace.plans.catalogue import as_of, sql_strip
from terrace.plans.expressions import sql_prefix
from terrace.plans.lineage import shared_folder, written
from terrace.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
K = 10


def query(sql: str | None = None):
    """Registers a function as the query of its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def sql_terms(x: str) -> str:
    return rf"regexp_extract_all(regexp_replace(lower({x}), '([\x{{4E00}}-\x{{9FFF}}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"


# Inputs -------------------------------------------------------------------------------------------------------


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    """``question_id, text``: the passages."""
    return table(spark, folder, "eval_items").select(F.col("item_id").cast("string").alias("question_id"), F.col("passage").alias("text"))


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return r.question_terms(_questions(spark, folder), "question_id", "text")


def _chapters(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chapters", spread=True).select("id", "document_id", "path", F.coalesce("title", F.lit("")).alias("title"), "summary", F.coalesce("content", F.lit("")).alias("content"))


def _one_piece(text: str | None, budget: int) -> list[Piece]:
    return [Piece([], text, "")] if text and text.strip() else []


_indexes: dict[tuple, DataFrame] = {}


def _index(spark: SparkSession, folder: str, markdown: bool = False) -> DataFrame:
    """``key, document_id, path, title, content, t, v``: the cold documents' chapters with their terms and hashed counts.

    It is written once for a state of the table of documents and serves all searches of the session.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/documents.parquet")
    state = at.getFileSystem(conf).getFileStatus(at)
    name = (shared_folder(spark), folder, markdown, state.getModificationTime(), state.getLen())
    if name not in _indexes:
        cold = table(spark, folder, "documents", spread=True).filter("status = 'cold'")
        cut = last_by_path(split_chapters(cold, "id", "title", "content")) if markdown else split_chapters(cold, "id", "title", "text", splitter=_one_piece)
        rows = cut.select("document_id", "path", F.coalesce("title", F.lit("")).alias("title"), "content")
        _indexes[name] = written(r.index_rows(rows, "path", ["title", "content"], "content"), "index")
    return _indexes[name]


_INPUT = rf"""
WITH ask AS (SELECT item_id::VARCHAR AS question_id, unnest(list_distinct({sql_terms("passage")})) AS term FROM eval_items),
w1 AS (SELECT id, coalesce(title, '') AS title, {sql_strip("coalesce(text, '')")} AS s FROM documents WHERE status = 'cold'),
w2 AS (SELECT *, len(s) AS n, len(regexp_extract_all(s, '[\p{{Han}}\x{{3040}}-\x{{30FF}}\x{{AC00}}-\x{{D7AF}}\x{{3000}}-\x{{303F}}\x{{FF00}}-\x{{FFEF}}]')) AS h, translate({sql_strip("title")}, '/\', '--') AS part FROM w1),
w3 AS (SELECT *, CASE WHEN h + ceil((n - h) / 4.0) <= 512 OR n <= 2048 THEN 1 ELSE 1 + ceil((n - 2048) / 400.0) END::INT AS windows FROM w2),
w4 AS (SELECT *, unnest(range(1, windows + 1))::INT AS k FROM w3),
cold AS (SELECT id AS document_id, title, {sql_strip("CASE WHEN windows = 1 THEN s ELSE substring(s, (k - 1) * 400 + 1, 2048) END")} AS content,
         id || '/' || CASE WHEN windows > 1 THEN '__root__/' || k WHEN part = '' THEN 'body' ELSE {sql_prefix("part", 120)} END AS key FROM w4),
c AS (SELECT key, {sql_terms("title || ' ' || content")} AS t FROM cold),
n AS (SELECT key, len(t) AS length, t FROM c),
e AS (SELECT count(*) AS rows, avg(length) AS usual FROM n),
p AS (SELECT key, term, length, count(*) AS tf FROM (SELECT key, length, unnest(t) AS term FROM n) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term)"""
_LEXICAL = (
    _INPUT
    + """,
s AS (SELECT question_id, key, round(sum(ln(1 + (rows - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / usual))), 6) AS score
      FROM ask JOIN df USING (term) JOIN p USING (term), e GROUP BY ALL),
l AS (SELECT question_id, key, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key) AS k FROM s) WHERE k <= 20)"""
)


def sql_hashed(rows: str) -> str:
    """SQL for the hashed embeddings of rows ``key, text``, as ``key, bucket, w``."""
    return f"""
(SELECT key, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY key)) AS w FROM (SELECT key, bucket, count(*) AS n FROM (
   SELECT key, unnest(list_transform(range(1, greatest(least(len(b) - 3, 10000), 0) + 1), lambda i: (((b[i] * 31 + b[i + 1]) * 31 + b[i + 2]) * 31 + b[i + 3]) % 384)) AS bucket FROM (
   SELECT key, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::INT) AS b FROM (SELECT key, hex(encode(text)) AS x FROM ({rows})))) GROUP BY ALL))"""


_VECTOR = (
    ",\nqv AS " + sql_hashed("SELECT item_id::VARCHAR AS key, passage AS text FROM eval_items") + ",\ncv AS " + sql_hashed("SELECT key, content AS text FROM cold")
    + """,
dots AS (SELECT q.key AS question_id, c.key, sum(q.w * c.w) AS dot FROM qv q JOIN cv c USING (bucket) GROUP BY ALL),
alls AS (SELECT i.item_id::VARCHAR AS question_id, c.key, round(coalesce(d.dot, 0), 6) AS score FROM eval_items i CROSS JOIN cold c LEFT JOIN dots d ON d.question_id = i.item_id::VARCHAR AND d.key = c.key),
v AS (SELECT question_id, key, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key) AS k FROM alls) WHERE k <= 20)"""
)
_FUSED = """,
f AS (SELECT question_id, key, floor((coalesce(max(a), 0) + coalesce(max(b), 0)) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS score, CASE WHEN max(a) IS NOT NULL AND max(b) IS NOT NULL THEN 'hybrid' WHEN max(a) IS NOT NULL THEN 'bm25' ELSE 'vector' END AS source FROM (
      SELECT question_id, key, CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE 0 END * 0.5::DOUBLE AS a, NULL::DOUBLE AS b FROM l WINDOW w AS (PARTITION BY question_id)
      UNION ALL SELECT question_id, key, NULL, score * 0.5::DOUBLE FROM v) GROUP BY ALL),
h AS (SELECT question_id, key, score, source FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key) AS k FROM f) WHERE k <= 10)"""


@query(_INPUT + " SELECT key, term, tf, length FROM p")
def build_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Which terms stand how often in each chapter of the index."""
    each = _index(spark, folder).select("key", F.size("t").cast("bigint").alias("length"), F.explode("t").alias("term"))
    return each.groupBy("key", "term", "length").agg(F.count("*").alias("tf"))


def _lexical(spark: SparkSession, folder: str, **options) -> DataFrame:
    index = _index(spark, folder)
    return r.lexical_search(index, "key", ["title", "content"], _asked(spark, folder), index=index, **options)


def _vector(spark: SparkSession, folder: str) -> DataFrame:
    questions = _questions(spark, folder).select("question_id", hash_counts(F.col("text")).alias("v"))
    return r.vector_search(_index(spark, folder), "key", "v", questions, "question_id", "v", k=20, dim=384, clamp=True)


@query(_LEXICAL + " SELECT question_id, key, score FROM l")
def lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return _lexical(spark, folder)


QUERIES["topk_lexical"], ORACLE["topk_lexical"] = (lambda s, d: r.ranked(_lexical(s, d), 5).select("question_id", "key", "rank")), _LEXICAL + " SELECT question_id, key, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key) AS k FROM l) WHERE k <= 5"


@query(_INPUT + ", t AS (SELECT question_id, key, round(sum(sqrt(tf) * pow(1 + ln(rows / (df + 1)::DOUBLE), 2) / sqrt(length)), 6) AS score FROM ask JOIN df USING (term) JOIN p USING (term), e GROUP BY ALL) SELECT question_id, key, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key) AS k FROM t) WHERE k <= 20")
def lexical_search_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    return _lexical(spark, folder, scoring="tfidf")


_CLEAN = "len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


@query(
    f"""
WITH d AS (SELECT doc_id, embedding::DOUBLE[] AS e FROM documents WHERE {_CLEAN} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.doc_id::VARCHAR AS question_id, c.doc_id::VARCHAR AS key, round(list_cosine_similarity(q.e, c.e), 6) AS score FROM d q JOIN d c ON q.doc_id % 50 = 0 AND q.doc_id <> c.doc_id)
SELECT question_id, key, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key) AS k FROM p) WHERE k <= 10"""
)
def vector_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest documents of every document whose id is divisible by 50."""
    documents = table(spark, folder, "documents").select("doc_id", "embedding").filter(F.exists("embedding", lambda x: x != 0))
    return r.vector_search(documents, "doc_id", "embedding", documents.filter("doc_id % 50 = 0"), "doc_id", "embedding", k=K, dim=384, skip_self=True)


@query(
    """
WITH p AS (SELECT q.vec_id::VARCHAR AS question_id, c.vec_id::VARCHAR AS key, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0)
SELECT question_id, key, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key) AS k FROM p) WHERE k <= 5"""
)
def topk_vector(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return r.vector_search(vectors, "vec_id", "embedding", vectors.filter("vec_id % 50 = 0"), "vec_id", "embedding", k=5, dim=64)


@query(_LEXICAL + " SELECT question_id, key, round(CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE 0 END, 6) AS score FROM l WINDOW w AS (PARTITION BY question_id)")
def max_norm(spark: SparkSession, folder: str) -> DataFrame:
    return r.max_normalized(_lexical(spark, folder)).select("question_id", "key", F.round("score", 6).alias("score"))


@query(_LEXICAL + _VECTOR + _FUSED + " SELECT question_id, key, score, source FROM f")
def fuse_full_outer(spark: SparkSession, folder: str) -> DataFrame:
    return r.fused(_lexical(spark, folder), _vector(spark, folder))


def _hybrid(spark: SparkSession, folder: str) -> DataFrame:
    return r.fused(_lexical(spark, folder), _vector(spark, folder), K)


@query(_LEXICAL + _VECTOR + _FUSED + " SELECT question_id, key, score, source FROM h")
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best chapters of each question by BM25 and hashed vectors together."""
    return _hybrid(spark, folder)


QUERIES["topk_fused"], ORACLE["topk_fused"] = (lambda s, d: r.ranked(_hybrid(s, d), 3).select("question_id", "key", "rank")), _LEXICAL + _VECTOR + _FUSED + " SELECT question_id, key, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key) AS k FROM h) WHERE k <= 3"


def _cold_hits(spark: SparkSession, folder: str) -> DataFrame:
    stored = _index(spark, folder).select("key", "document_id", "path", "title", "content")
    return stored.join(_hybrid(spark, folder), "key").select("question_id", "key", "document_id", "path", "title", "content", "score", "source")


@query(_LEXICAL + _VECTOR + _FUSED + " SELECT h.question_id, c.document_id, c.key AS path, c.title, md5(c.content) AS content_md5, h.score FROM h JOIN cold c USING (key)")
def chapter_hits(spark: SparkSession, folder: str) -> DataFrame:
    """The hits of hybrid search with what they show; of the content a hash, to be compared."""
    return _cold_hits(spark, folder).select("question_id", "document_id", "path", "title", F.md5(F.encode("content", "UTF-8")).alias("content_md5"), "score")


@query(_LEXICAL + " SELECT l.question_id, c.key AS path, c.document_id, len(c.content)::INT AS characters FROM l JOIN cold c USING (key)")
def join_hits_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Lexical hits joined to their chapters."""
    chapters = _index(spark, folder).select("key", "path", "document_id", F.char_length("content").alias("characters"))
    return chapters.join(_lexical(spark, folder), "key").select("question_id", "path", "document_id", "characters")


@query()
def cold_index_search(spark: SparkSession, folder: str) -> DataFrame:
    """Hybrid search over the chapters that ``cold_load`` cuts from the Markdown of cold documents."""
    index = _index(spark, folder, markdown=True)
    lexical = r.lexical_search(index, "key", ["title", "content"], _asked(spark, folder), index=index)
    questions = _questions(spark, folder).select("question_id", hash_counts(F.col("text")).alias("v"))
    vector = r.vector_search(index, "key", "v", questions, "question_id", "v", k=20, dim=384, clamp=True)
    return index.select("key", "document_id", "path", "title", "content").join(r.fused(lexical, vector, K), "key").select("question_id", "document_id", "path", "title", "content", "score", "source")


# Funnel -------------------------------------------------------------------------------------------------------


def _catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """``name, topic_id``: the stored tags and, without topic, those that documents bear."""
    stored = table(spark, folder, "tags").select("name", "topic_id")
    borne = table(spark, folder, "documents").select(F.explode("tags").alias("name")).distinct()
    return stored.unionByName(borne.join(stored, "name", "left_anti").withColumn("topic_id", F.lit(None).cast("string"))).filter("trim(name) <> ''")


def _tag_scores(spark: SparkSession, folder: str) -> DataFrame:
    return r.overlap_scores(_asked(spark, folder), _catalogue(spark, folder).select("name").distinct(), "name", F.col("name"))


def _document_scores(spark: SparkSession, folder: str) -> DataFrame:
    return r.overlap_scores(_asked(spark, folder), table(spark, folder, "documents").filter("status IN ('hot', 'warming')"), "id", F.col("title"))


def _chapter_scores(spark: SparkSession, folder: str) -> DataFrame:
    body = F.coalesce(F.when(F.trim("summary") != "", F.col("summary")), F.col("content"))
    return r.held_scores(_asked(spark, folder), _chapters(spark, folder), "id", body)


def sql_overlap(rows: str) -> str:
    return f"(SELECT question_id, key, round(count(*) / n::DOUBLE, 6) AS score FROM (SELECT key, len(t) AS n, unnest(t) AS term FROM (SELECT key, list_distinct({sql_terms('text')}) AS t FROM ({rows}))) JOIN ask USING (term) GROUP BY question_id, key, n)"


_BODY = "coalesce(CASE WHEN trim(summary) <> '' THEN summary END, content, '')"
_SCORES = (
    f"WITH ask AS (SELECT item_id::VARCHAR AS question_id, unnest(list_distinct({sql_terms('passage')})) AS term FROM eval_items),\n"
    "names AS (SELECT DISTINCT name FROM (SELECT unnest(tags) AS name FROM documents UNION ALL SELECT name FROM tags) WHERE trim(name) <> ''),\n"
    f"ts AS {sql_overlap('SELECT name AS key, name AS text FROM names')},\n"
    f"tp AS (SELECT question_id, key FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key) AS k FROM {sql_overlap('SELECT id AS key, name AS text FROM topics')} WHERE score >= 0.5) WHERE k <= 3),\n"
    "rt AS (SELECT question_id, key, score FROM ts WHERE score >= 0.5 AND ((SELECT count(*) FROM names) < 200 OR (question_id, key) IN (SELECT tp.question_id, g.name FROM tp JOIN tags g ON g.topic_id = tp.key))),\n"
    f"ds AS {sql_overlap("SELECT id AS key, coalesce(title, '') AS text FROM documents WHERE status IN ('hot', 'warming')")},\n"
    "asked AS (SELECT question_id, count(*) AS n FROM ask GROUP BY question_id),\n"
    f"cs AS (SELECT question_id, key, round(count(*) / max(n)::DOUBLE, 6) AS score FROM (SELECT id AS key, unnest(list_distinct({sql_terms(_BODY)})) AS term FROM chapters) JOIN ask USING (term) JOIN asked USING (question_id) GROUP BY question_id, key)"
)
_FUNNEL = f""",
reached AS (SELECT DISTINCT rt.question_id, x.id AS document_id FROM rt JOIN (SELECT id, unnest(tags) AS tag FROM documents WHERE status IN ('hot', 'warming')) x ON x.tag = rt.key),
wanted AS (SELECT r.* FROM reached r JOIN ds ON ds.question_id = r.question_id AND ds.key = r.document_id WHERE ds.score >= 0.5),
told AS (SELECT id, document_id, path, coalesce(title, '') AS title, trim({_BODY}) AS body FROM chapters WHERE trim({_BODY}) <> ''),
b AS (SELECT w.question_id, c.document_id, c.path, max(cs.score) AS score, arg_min((c.title, c.body), (-cs.score, c.id)) AS told FROM cs JOIN told c ON c.id = cs.key JOIN wanted w ON w.question_id = cs.question_id AND w.document_id = c.document_id
      WHERE cs.score >= 0.5 GROUP BY ALL),
hot AS (SELECT question_id, document_id, path, score, told[1] AS title, told[2] AS content FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id || '/' || path) AS k FROM b) WHERE k <= 50)"""


@query(_SCORES + " SELECT question_id, key, score FROM ts WHERE score >= 0.5")
def relevance_cut(spark: SparkSession, folder: str) -> DataFrame:
    return r.relevant(_tag_scores(spark, folder))


@query(_SCORES + " SELECT ds.question_id, d.id, d.title, ds.score FROM ds JOIN documents d ON d.id = ds.key WHERE ds.score >= 0.5")
def join_scores_docs(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("id", "title")
    return r.relevant(_document_scores(spark, folder)).join(documents, F.col("key") == F.col("id")).select("question_id", "id", "title", "score")


@query(_SCORES + " SELECT cs.question_id, c.id, c.path, cs.score FROM cs JOIN chapters c ON c.id = cs.key WHERE cs.score >= 0.5")
def join_scores_chapters(spark: SparkSession, folder: str) -> DataFrame:
    chapters = _chapters(spark, folder).select("id", "path")
    return r.relevant(_chapter_scores(spark, folder)).join(chapters, F.col("key") == F.col("id")).select("question_id", "id", "path", "score")



@query(_SCORES + f" SELECT question_id, key, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key) AS k FROM {sql_overlap('SELECT id AS key, name AS text FROM topics')} WHERE score >= 0.5) WHERE k <= 3")
def topk_topics(spark: SparkSession, folder: str) -> DataFrame:
    topics = table(spark, folder, "topics")
    return r.ranked(r.relevant(r.overlap_scores(_asked(spark, folder), topics, "id", F.col("name"))), 3).drop("rank")


def _routed(spark: SparkSession, folder: str) -> DataFrame:
    return r.routed_tags(_asked(spark, folder), _catalogue(spark, folder), table(spark, folder, "topics"))


@query(_SCORES + " SELECT question_id, key FROM rt")
def adaptive_tag_route(spark: SparkSession, folder: str) -> DataFrame:
    """With fewer than 200 tags all are judged, else those that point to one of the three topics most relevant to the question."""
    return _routed(spark, folder).select("question_id", "key")


def _funnel(spark: SparkSession, folder: str, tags: DataFrame | None = None) -> DataFrame:
    return r.hot_funnel(_routed(spark, folder) if tags is None else tags, table(spark, folder, "documents"), _document_scores(spark, folder), _chapters(spark, folder), _chapter_scores(spark, folder))


@query(_SCORES + _FUNNEL + " SELECT h.question_id, h.document_id, h.path, h.title, md5(h.content) AS content_md5, h.score, d.status, d.query_count::INT AS query_count FROM hot h JOIN documents d ON d.id = h.document_id")
def hot_funnel(spark: SparkSession, folder: str) -> DataFrame:
    """The funnel's hits with what they show; of the content a hash, to be compared."""
    return _funnel(spark, folder).withColumn("content_md5", F.md5(F.encode("content", "UTF-8"))).drop("content")


def _progressive(spark: SparkSession, folder: str) -> DataFrame:
    return r.merged_hits(_funnel(spark, folder), _cold_hits(spark, folder), 15)


_MERGED = (
    _LEXICAL + _VECTOR + _FUSED + _SCORES.replace("WITH ask AS", ",\nask2 AS") + _FUNNEL
    + """,
far AS (SELECT h.question_id, c.document_id, c.key AS path, h.score FROM h JOIN cold c USING (key)),
u AS (SELECT question_id, document_id, path, score, 'hot_progressive' AS source FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id || '/' || path) AS k FROM hot) WHERE k <= 7
      UNION ALL SELECT question_id, document_id, path, score, 'cold_index' FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id || '/' || path) AS k FROM far) WHERE k <= 7),
best AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY question_id, document_id, path ORDER BY score DESC, source DESC) AS k FROM u) WHERE k = 1),
merged AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id || '/' || path) AS k FROM best) WHERE k <= 15)"""
)


@query(_MERGED + " SELECT question_id, document_id, path, score, source FROM merged")
def progressive_query(spark: SparkSession, folder: str) -> DataFrame:
    """Hot and cold hits of each question in one list."""
    return _progressive(spark, folder)


@query(_MERGED + " SELECT question_id, document_id, path, source FROM best")
def best_per_key(spark: SparkSession, folder: str) -> DataFrame:
    hot, cold = _funnel(spark, folder), _cold_hits(spark, folder)
    key = F.concat_ws("/", "document_id", "path")
    halves = [r.ranked(x.withColumn("key", key), 7).select("question_id", "document_id", "path", "score", F.lit(n).alias("source")) for x, n in ((hot, "hot_progressive"), (cold, "cold_index"))]
    return r.best_per_key(halves[0].unionByName(halves[1])).select("question_id", "document_id", "path", "source")


@query(_MERGED + " SELECT document_id, count(DISTINCT question_id) AS queries FROM merged GROUP BY document_id")
def distinct_docs(spark: SparkSession, folder: str) -> DataFrame:
    return r.accesses(_progressive(spark, folder))


QUERIES["topk_merged"], ORACLE["topk_merged"] = (lambda s, d: r.ranked(_progressive(s, d).withColumn("key", F.concat_ws("/", "document_id", "path")), 5).select("question_id", "document_id", "path", "rank")), _MERGED + " SELECT question_id, document_id, path, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id || '/' || path) AS k FROM merged) WHERE k <= 5"


@query(_MERGED + ", acc AS (SELECT document_id, count(DISTINCT question_id) AS queries FROM merged GROUP BY document_id) SELECT d.id, (coalesce(d.query_count, 0) + coalesce(acc.queries, 0))::INT AS query_count, acc.queries IS NOT NULL AS asked FROM documents d LEFT JOIN acc ON acc.document_id = d.id")
def track_access(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("id", "query_count", F.lit(None).cast("timestamp").alias("last_query_at"))
    return accessed(documents, r.accesses(_progressive(spark, folder)), as_of()).select("id", "query_count", F.col("last_query_at").isNotNull().alias("asked"))
