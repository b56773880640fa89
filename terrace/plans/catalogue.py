"""Queries of documents, chapters, tags and topics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.markdown import Piece
from terrace.operators import catalog as c
from terrace.operators.chunking import last_by_path, split_chapters
from terrace.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Fixed value: the moment that stands for now, so that results repeat.
AS_OF = "2026-01-01 00:00:00"
TAGS = ["treasury", "genomics", "audit-log"]
WS = r"[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def query(sql: str | None = None):
    """Registers a function as the query of its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def moment(utc: str):
    """A moment given in universal time, whatever zone the session has."""
    return F.lit(f"{utc}+00:00").cast("timestamp")


def as_of():
    return moment(AS_OF)


def micros(*names: str):
    return [F.unix_micros(n).alias(n) for n in names]


@query("SELECT id, title, status, query_count, len(content) AS characters FROM documents WHERE id = (SELECT max(id) FROM documents)")
def scan_document_by_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    asked = documents.agg(F.max("id")).first()[0]
    return documents.filter(F.col("id") == asked).select("id", "title", "status", "query_count", F.char_length("content").alias("characters"))


@query("SELECT id, title, epoch_us(created_at) AS created_at FROM documents ORDER BY documents.created_at DESC NULLS LAST, id LIMIT 200")
def scan_recent_documents(spark: SparkSession, folder: str) -> DataFrame:
    return c.recent_documents(table(spark, folder, "documents")).select("id", "title", *micros("created_at"))


@query("SELECT id, title, query_count FROM documents WHERE status = 'hot' ORDER BY id LIMIT 100")
def scan_documents_by_status(spark: SparkSession, folder: str) -> DataFrame:
    return c.documents_by_status(table(spark, folder, "documents"), "hot").select("id", "title", "query_count")


@query("SELECT id, title, lang, source, format, status, hot_score, query_count, coalesce(n_chars, -1) AS n_chars FROM documents")
def scan_all_documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("id", "title", "lang", "source", "format", "status", "hot_score", "query_count", F.coalesce("n_chars", F.lit(-1)).alias("n_chars"))


@query("SELECT id, path, title, epoch_us(created_at) AS created_at FROM chapters WHERE document_id = (SELECT max(document_id) FROM chapters)")
def scan_chapters_by_document(spark: SparkSession, folder: str) -> DataFrame:
    chapters = table(spark, folder, "chapters")
    asked = chapters.agg(F.max("document_id")).first()[0]
    return chapters.filter(F.col("document_id") == asked).orderBy("created_at", "id").select("id", "path", "title", *micros("created_at"))


@query("SELECT d.id, count(c.id) AS chapters, coalesce(string_agg(c.path, '|' ORDER BY c.created_at, c.id), '') AS paths FROM (SELECT DISTINCT id FROM documents) d LEFT JOIN chapters c ON c.document_id = d.id GROUP BY d.id")
def scan_chapters_by_documents(spark: SparkSession, folder: str) -> DataFrame:
    lists = c.chapters_of(table(spark, folder, "chapters"), table(spark, folder, "documents"))
    return lists.select("id", F.size("chapters").cast("bigint").alias("chapters"), F.array_join(F.transform("chapters", lambda x: x["path"]), "|").alias("paths"))


@query("SELECT id, document_id, path FROM chapters WHERE id IN (SELECT min(id) FROM chapters GROUP BY document_id)")
def scan_chapters_by_ids(spark: SparkSession, folder: str) -> DataFrame:
    chapters = table(spark, folder, "chapters")
    asked = chapters.groupBy("document_id").agg(F.min("id").alias("id")).select("id")
    return chapters.join(asked, "id", "left_semi").select("id", "document_id", "path")


@query("SELECT id, name, topic_id, coalesce(document_count, -1) AS document_count FROM tags ORDER BY name")
def scan_tags(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tags").orderBy("name").select("id", "name", "topic_id", F.coalesce("document_count", F.lit(-1)).alias("document_count"))


@query("SELECT id, name, topic_id FROM tags WHERE name = 'genomics'")
def scan_tag_by_name(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tags").filter(F.col("name") == "genomics").select("id", "name", "topic_id")


@query("SELECT id, name, description, coalesce(len(tag_names), -1)::BIGINT AS tags FROM topics ORDER BY name")
def scan_topics(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "topics").orderBy("name").select("id", "name", "description", F.coalesce(F.size("tag_names"), F.lit(-1)).cast("bigint").alias("tags"))


@query("SELECT id, name, description FROM topics WHERE id = (SELECT min(id) FROM topics)")
def scan_topic_by_id(spark: SparkSession, folder: str) -> DataFrame:
    topics = table(spark, folder, "topics")
    return topics.filter(F.col("id") == topics.agg(F.min("id")).first()[0]).select("id", "name", "description")


@query("SELECT document_id, epoch_us(created_at) AS created_at FROM deleted_documents WHERE created_at > TIMESTAMPTZ '2024-06-01 00:00:00+00'")
def scan_tombstones_since(spark: SparkSession, folder: str) -> DataFrame:
    gone = table(spark, folder, "deleted_documents")
    return gone.filter(F.col("created_at") > moment("2024-06-01 00:00:00")).orderBy("created_at", "id").select("document_id", *micros("created_at"))


@query("SELECT CASE WHEN lower(trim(format)) IN ('markdown', 'md') THEN 'markdown' ELSE 'other' END AS format, count(*) AS documents, sum(octet_length(encode(coalesce(content, ''))))::BIGINT AS bytes, count(*) FILTER (WHERE octet_length(encode(coalesce(content, ''))) > 10000) AS long FROM documents GROUP BY 1")
def format_markdown(spark: SparkSession, folder: str) -> DataFrame:
    size = F.octet_length(F.coalesce("content", F.lit("")))
    kind = F.when(F.lower(F.trim("format")).isin("markdown", "md"), "markdown").otherwise("other").alias("format")
    return table(spark, folder, "documents").groupBy(kind).agg(F.count("*").alias("documents"), F.sum(size).cast("bigint").alias("bytes"), F.count_if(size > 10_000).alias("long"))


@query("SELECT id, title FROM documents WHERE list_has_any(tags, ['treasury', 'genomics', 'audit-log'])")
def filter_tags_any(spark: SparkSession, folder: str) -> DataFrame:
    return c.with_any_tag(table(spark, folder, "documents"), TAGS).select("id", "title")


@query("SELECT id, title FROM documents WHERE len(list_filter(tags, lambda t: contains(t, 'audit') OR contains(t, 'design'))) > 0")
def filter_tags_substring(spark: SparkSession, folder: str) -> DataFrame:
    return c.with_any_tag(table(spark, folder, "documents"), ["audit", "design"], substring=True).select("id", "title")


@query("SELECT id, title, '' AS content FROM documents WHERE list_has_any(tags, ['treasury', 'genomics', 'audit-log']) AND status IN ('hot', 'warming')")
def filter_tags_and_status(spark: SparkSession, folder: str) -> DataFrame:
    return c.with_any_tag(table(spark, folder, "documents"), TAGS).filter(F.col("status").isin(*c.ACTIVE)).select("id", "title", F.lit("").alias("content"))


@query("SELECT id, title, summary, status, query_count FROM documents WHERE list_has_any(tags, ['treasury', 'genomics']) AND status IN ('hot', 'warming')")
def doc_summaries_by_tags(spark: SparkSession, folder: str) -> DataFrame:
    return c.summaries_by_tags(table(spark, folder, "documents"), [" treasury", "Treasury", "genomics", " "], limit=None).select("id", "title", "summary", "status", "query_count")


@query("SELECT name, topic_id FROM tags WHERE topic_id = (SELECT min(id) FROM topics) ORDER BY name")
def tags_by_topic(spark: SparkSession, folder: str) -> DataFrame:
    tags, topics = table(spark, folder, "tags"), table(spark, folder, "topics")
    return c.tags_by_topics(tags, topics.agg(F.min("id").alias("id"))).select("name", "topic_id")


@query("SELECT name, topic_id FROM tags WHERE topic_id IN (SELECT id FROM topics WHERE description IS NOT NULL)")
def tags_by_topics(spark: SparkSession, folder: str) -> DataFrame:
    return c.tags_by_topics(table(spark, folder, "tags"), table(spark, folder, "topics").filter("description IS NOT NULL")).select("name", "topic_id")


@query("SELECT name, coalesce(document_count, -1) AS document_count FROM tags ORDER BY name LIMIT 10000")
def list_tags_capped(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tags").orderBy("name").limit(10_000).select("name", F.coalesce("document_count", F.lit(-1)).alias("document_count"))


@query(
    f"""
WITH m AS (SELECT DISTINCT name, unnest(tag_names) AS tag FROM topics),
d AS (SELECT id, status, list_filter(coalesce(tags, []), lambda t: {sql_strip('t')} <> '') AS tags FROM documents
      WHERE contains(lower(coalesce(title, '')), 'guide') OR len(list_filter(coalesce(tags, []), lambda t: contains(lower(t), 'guide'))) > 0)
SELECT id, 'cold' AS bucket FROM d WHERE status = 'cold'
UNION ALL SELECT id, 'untagged' FROM d WHERE status <> 'cold' AND len(tags) = 0
UNION ALL SELECT DISTINCT e.id, 'topic:' || m.name FROM (SELECT id, unnest(tags) AS tag FROM d WHERE status <> 'cold') e JOIN m ON m.tag = e.tag"""
)
def browse_filter(spark: SparkSession, folder: str) -> DataFrame:
    return c.browse(table(spark, folder, "documents"), table(spark, folder, "topics"), "Guide")


@query("SELECT id, status FROM documents WHERE created_at >= TIMESTAMPTZ '2025-03-01 00:00:00+00' OR updated_at >= TIMESTAMPTZ '2025-03-01 00:00:00+00'")
def incremental_filter(spark: SparkSession, folder: str) -> DataFrame:
    from terrace.operators.tiering import changed_since

    return changed_since(table(spark, folder, "documents"), moment("2025-03-01 00:00:00")).select("id", "status")


@query("SELECT c.id, c.path, d.status, d.query_count FROM chapters c LEFT JOIN documents d ON d.id = c.document_id")
def join_chapter_doc_status(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(F.col("id").alias("document_id"), "status", "query_count")
    return table(spark, folder, "chapters").select("id", "path", "document_id").join(documents, "document_id", "left").select("id", "path", "status", "query_count")


@query("SELECT DISTINCT g.id AS tag_id, g.name FROM tags g JOIN topics t ON t.id = g.topic_id WHERE t.description IS NOT NULL")
def join_topic_tags_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return c.distinct_tags_of(table(spark, folder, "tags"), table(spark, folder, "topics").filter("description IS NOT NULL"))


@query("SELECT id, document_id FROM chapters WHERE document_id NOT IN (SELECT document_id FROM deleted_documents WHERE document_id IS NOT NULL)")
def anti_tombstones(spark: SparkSession, folder: str) -> DataFrame:
    return c.without_deleted(table(spark, folder, "chapters"), table(spark, folder, "deleted_documents")).select("id", "document_id")


@query(
    """
WITH p AS (SELECT DISTINCT list_filter(string_split(path, '/'), lambda s: s <> '') AS parts FROM chapters WHERE path IS NOT NULL),
e AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS depth FROM p WHERE len(parts) > 0)
SELECT array_to_string(parts[1:depth], '/') AS node, CASE WHEN depth > 1 THEN array_to_string(parts[1:depth - 1], '/') END AS parent, parts[depth] AS name, depth::INT AS depth,
       bool_or(depth = len(parts)) AS path, NOT bool_or(depth <> len(parts)) AS leaf FROM e GROUP BY ALL"""
)
def chapter_nav_tree(spark: SparkSession, folder: str) -> DataFrame:
    return c.navigation(table(spark, folder, "chapters"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE status = 'hot') AS hot, count(*) FILTER (WHERE status = 'cold') AS cold, count(*) FILTER (WHERE status = 'warming') AS warming FROM documents")
def agg_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return c.status_counts(table(spark, folder, "documents"))


@query("SELECT (SELECT count(*) FROM tags) AS tags, (SELECT count(*) FROM topics) AS topics")
def agg_catalog_counts(spark: SparkSession, folder: str) -> DataFrame:
    each = table(spark, folder, "tags").select(F.lit("tags").alias("t")).unionByName(table(spark, folder, "topics").select(F.lit("topics").alias("t")))
    return each.agg(F.count_if(F.col("t") == "tags").alias("tags"), F.count_if(F.col("t") == "topics").alias("topics"))


@query(f"SELECT name, count(*) AS document_count FROM (SELECT unnest(list_distinct(list_transform(tags, lambda t: {sql_strip('t')}))) AS name FROM documents) WHERE name <> '' GROUP BY name")
def agg_tag_document_count(spark: SparkSession, folder: str) -> DataFrame:
    return c.tag_document_counts(table(spark, folder, "documents"))


@query("SELECT (SELECT count(*) FROM chapters) AS chapters, (SELECT count(DISTINCT document_id) FROM chapters) AS documents, (SELECT count(*) FROM documents WHERE len(embedding) = 384) AS vectors, (SELECT sum(len(coalesce(content, '')))::BIGINT FROM chapters) AS characters")
def agg_corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    chapters = table(spark, folder, "chapters").agg(F.count("*").alias("chapters"), F.countDistinct("document_id").alias("documents"), F.sum(F.char_length(F.coalesce("content", F.lit("")))).alias("characters"))
    vectors = table(spark, folder, "documents").agg(F.count_if(F.size("embedding") == 384).alias("vectors"))
    return chapters.join(vectors)  # one row each


# Snapshots


@query(
    """
SELECT id, status, query_count::INT AS query_count, hot_score FROM documents
UNION ALL SELECT 'chapter:' || id, 'cold', 0, 0.0 FROM chapters WHERE document_id NOT IN (SELECT id FROM documents WHERE status = 'hot')"""
)
def sink_create_document(spark: SparkSession, folder: str) -> DataFrame:
    """Warming chapters become documents of their own."""
    documents = table(spark, folder, "documents")
    hot = documents.filter("status = 'hot'").select(F.col("id").alias("document_id"))
    chapters = table(spark, folder, "chapters").join(hot, "document_id", "left_anti")
    incoming = chapters.select(F.concat(F.lit("chapter:"), "id").alias("id"), "title", "content", F.lit(None).cast("string").alias("status"))
    return c.created(documents, incoming, as_of()).select("id", "status", "query_count", "hot_score")


@query("SELECT id, document_id, path FROM chapters WHERE document_id NOT IN (SELECT id FROM documents WHERE status = 'warming') UNION ALL SELECT 'new:' || id, id, id || '/full' FROM documents WHERE status = 'warming'")
def sink_replace_chapters(spark: SparkSession, folder: str) -> DataFrame:
    warming = table(spark, folder, "documents").filter("status = 'warming'")
    incoming = warming.select(F.concat(F.lit("new:"), "id").alias("id"), F.col("id").alias("document_id"), F.concat("id", F.lit("/full")).alias("path"))
    return c.replaced_chapters(table(spark, folder, "chapters"), incoming)


@query(
    """
SELECT id, CASE WHEN trim(title) = '' OR title IS NULL THEN 'Untitled' ELSE title END AS title, CASE WHEN trim(title) = '' OR title IS NULL THEN 1767225600000000 ELSE epoch_us(updated_at) END AS updated_at FROM documents"""
)
def sink_update_document(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("id", "title", "updated_at")
    changes = documents.filter("title IS NULL OR trim(title) = ''").select("id", F.lit("Untitled").alias("title"))
    return c.updated(documents, changes, "id", as_of()).select("id", "title", *micros("updated_at"))


@query(
    f"""
WITH n AS (SELECT DISTINCT name FROM (SELECT {sql_strip('t')} AS name FROM (SELECT unnest(tags) AS t FROM documents)) WHERE name <> '')
SELECT coalesce(t.name, n.name) AS name, t.id IS NULL AS added, CASE WHEN n.name IS NOT NULL THEN 1767225600000000 ELSE epoch_us(t.updated_at) END AS updated_at FROM tags t FULL JOIN n ON n.name = t.name"""
)
def sink_upsert_tag(spark: SparkSession, folder: str) -> DataFrame:
    tags = table(spark, folder, "tags")
    names = table(spark, folder, "documents").select(F.explode("tags").alias("name"))
    made = c.upserted_tags(tags, names, as_of())
    return made.join(tags.select("name", F.lit(False).alias("known")), "name", "left").select("name", F.coalesce("known", F.lit(True)).alias("added"), *micros("updated_at"))


@query("SELECT DISTINCT 'All tags' AS topic, name AS tag FROM tags WHERE name IS NOT NULL")
def sink_catalog_reset(spark: SparkSession, folder: str) -> DataFrame:
    return c.regrouped_topics(table(spark, folder, "tags"))


@query("SELECT document_id FROM deleted_documents UNION ALL SELECT id FROM documents WHERE status = 'archived'")
def sink_tombstone(spark: SparkSession, folder: str) -> DataFrame:
    return c.entombed(table(spark, folder, "deleted_documents"), table(spark, folder, "documents").filter("status = 'archived'"), as_of()).select("document_id")


_MERGED = f"list_filter(list_transform(coalesce(tags, []) || [source, lang], lambda t: {sql_strip('t')}), lambda t: t <> '' AND t IS NOT NULL)"


@query(
    f"""
WITH m AS (SELECT id, status, tags, {_MERGED} AS all_tags FROM documents),
u AS (SELECT id, t, k FROM (SELECT id, unnest(all_tags) AS t, unnest(range(1, len(all_tags) + 1)) AS k FROM m WHERE status = 'hot')),
f AS (SELECT id, t, k FROM (SELECT *, row_number() OVER (PARTITION BY id, lower(t) ORDER BY k) AS n FROM u) WHERE n = 1)
SELECT m.id, CASE WHEN m.status = 'hot' THEN coalesce((SELECT string_agg(t, '|' ORDER BY k) FROM f WHERE f.id = m.id), '') ELSE coalesce(array_to_string(m.tags, '|'), '') END AS tags FROM m"""
)
def hot_ingest_process(spark: SparkSession, folder: str) -> DataFrame:
    """Source and language stand for what an analysis of a hot document adds to its tags."""
    documents = table(spark, folder, "documents").select("id", "status", "tags", "summary", "source", "lang")
    analyses = documents.select("id", F.array("source", "lang").alias("tags"), F.lit(None).cast("string").alias("summary"))
    return c.ingested(documents, analyses).select("id", F.coalesce(F.array_join("tags", "|"), F.lit("")).alias("tags"))


# Chapters


def split_chapters_query(spark: SparkSession, folder: str) -> DataFrame:
    """Every document cut into chapters."""
    return split_chapters(table(spark, folder, "documents", spread=True), "id", "title", "content").select("document_id", "path", "title", "content", "tokens")


QUERIES["split_chapters"] = split_chapters_query


@query()
def splitter_plugin(spark: SparkSession, folder: str) -> DataFrame:
    """Documents cut by another splitter: a chapter for each block between blank lines."""

    def by_paragraph(text: str | None, budget: int) -> list[Piece]:
        parts = [p.strip() for p in (text or "").split("\n\n")]
        return [Piece([f"p{k}"], p, "") for k, p in enumerate(parts) if p]

    return split_chapters(table(spark, folder, "documents", spread=True), "id", "title", "content", splitter=by_paragraph).select("document_id", "path", "content")


@query()
def cold_load(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters of cold documents, one for each path: what the index is loaded with."""
    return last_by_path(split_chapters(table(spark, folder, "documents", spread=True).filter("status = 'cold'"), "id", "title", "content"))


@query()
def chapters_view(spark: SparkSession, folder: str) -> DataFrame:
    """Stored chapters of documents that have some and aren't cold, and chapters cut anew of all others."""
    documents, chapters = table(spark, folder, "documents", spread=True), table(spark, folder, "chapters")
    warm = documents.filter("status <> 'cold'").select(F.col("id").alias("document_id"))
    stored = chapters.join(warm, "document_id", "left_semi")
    anew = documents.join(stored.select(F.col("document_id").alias("id")).distinct(), "id", "left_anti")
    cut = split_chapters(anew, "id", "title", "content").select("document_id", "path", "title", F.lit("").alias("summary"), "content")
    return stored.select("document_id", "path", "title", "summary", "content").unionByName(cut)


_WINDOWS = f"""
WITH t AS (SELECT id, {sql_strip("coalesce(text, '')")} AS s FROM documents),
e AS (SELECT id, s, len(s) AS n, len(regexp_extract_all(s, '[\\p{{Han}}\\x{{3040}}-\\x{{30FF}}\\x{{AC00}}-\\x{{D7AF}}\\x{{3000}}-\\x{{303F}}\\x{{FF00}}-\\x{{FFEF}}]')) AS h FROM t WHERE s <> ''),
w AS (SELECT *, CASE WHEN h + ceil((n - h) / 4.0) <= 512 OR n <= 2048 THEN 1 ELSE 1 + ceil((n - 2048) / 400.0) END::INT AS windows FROM e),
x AS (SELECT *, unnest(range(1, windows + 1))::INT AS k FROM w)
"""


@query(_WINDOWS + "SELECT id, k AS \"window\", windows, len(CASE WHEN windows = 1 THEN s ELSE substring(s, (k - 1) * 400 + 1, 2048) END) AS characters, md5(CASE WHEN windows = 1 THEN s ELSE substring(s, (k - 1) * 400 + 1, 2048) END) AS md5 FROM x")
def sliding_windows(spark: SparkSession, folder: str) -> DataFrame:
    from terrace.operators.chunking import sliding_windows as cut

    return cut(table(spark, folder, "documents").select("id", "text"), "text").select("id", "window", "windows", F.char_length("chunk").cast("bigint").alias("characters"), F.md5(F.encode("chunk", "UTF-8")).alias("md5"))


