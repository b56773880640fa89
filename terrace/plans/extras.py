"""Queries of per-text parsing, of ingest checks and of streams."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions import markdown
from terrace.functions import text as t
from terrace.functions.vectors import dot, embedded
from terrace.operators.chunking import split_chapters
from terrace.plans.catalogue import sql_strip
from terrace.plans.expressions import sql_prefix
from terrace.plans.lineage import shared_folder
from terrace.plans.searches import sql_hashed
from terrace.sources.store import conformed, ensured
from terrace.sources.tables import table
from terrace.streaming import jobs

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as the query of its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _headings(spark: SparkSession, folder: str) -> DataFrame:
    """``id, place, first, last, level, title, parent, numbered`` for every heading of every document, in order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"id": pa.string(), "place": pa.int32(), "first": pa.int64(), "last": pa.int64(), "level": pa.int64(), "title": pa.string(), "parent": pa.int32(), "numbered": pa.bool_()}
        for b in batches:
            rows = []
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                marks = markdown.headings(markdown.without_front_matter((x.as_py() or "").replace("\r\n", "\n")))
                rows += [(i, k, *h, up, markdown.chinese(h)) for k, (h, up) in enumerate(zip(marks, markdown.parents(marks)))]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))

    source = table(spark, folder, "documents", spread=True).select("id", "content")
    return source.mapInArrow(scan, "id string, place int, first bigint, last bigint, level bigint, title string, parent int, numbered boolean")


@query()
def heading_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Every heading of every document: place, level, title. Numbered Chinese lines count as headings."""
    return _headings(spark, folder).select("id", "first", "last", "level", "title")


@query()
def chinese_heading_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The numbered Chinese lines that serve as headings, outside of code, quotes, lists and tables."""
    return _headings(spark, folder).filter("numbered").select("id", "first", "last", "level", "title")


@query()
def merge_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Of each document the headings of both kinds in one sequence: how many, the deepest level, and whether none begins before another ends."""
    from pyspark.sql import Window

    before = F.lag("last").over(Window.partitionBy("id").orderBy("place"))
    marks = _headings(spark, folder).withColumn("apart", F.coalesce(F.col("first") >= before, F.lit(True)))
    return marks.groupBy("id").agg(F.count("*").alias("headings"), F.count_if("numbered").alias("numbered"), F.max("level").alias("deepest"), F.bool_and("apart").alias("apart"))


@query()
def split_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The tree of each document's headings: for each its place, level and title, and the place of the heading above it, -1 for none."""
    return _headings(spark, folder).select("id", "place", "level", "title", "parent")


@query()
def strip_frontmatter(spark: SparkSession, folder: str) -> DataFrame:
    """Documents' contents without front matter, and how many characters that took."""

    @F.pandas_udf("string")
    def strip(x: pd.Series) -> pd.Series:
        return x.map(markdown.without_front_matter, na_action="ignore")

    return table(spark, folder, "documents").select("id", strip("content").alias("body"), "content").select("id", "body", (F.char_length("content") - F.char_length("body")).alias("removed"))


@query()
def chapters_from_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters with content as summary; a document without any text has a chapter ``body``."""
    cut = split_chapters(table(spark, folder, "documents", spread=True), "id", "title", "content").filter("content <> ''")
    none = table(spark, folder, "documents").select(F.col("id").alias("document_id")).join(cut.select("document_id"), "document_id", "left_anti")
    blank = none.select("document_id", F.concat("document_id", F.lit("/body")).alias("path"), F.lit("").alias("summary"))
    return cut.select("document_id", "path", F.col("content").alias("summary")).unionByName(blank)


@query()
def merge_bottom_up(spark: SparkSession, folder: str) -> DataFrame:
    """How many chapters each document is cut into at three budgets."""
    parts = [split_chapters(table(spark, folder, "documents", spread=True), "id", "title", "content", budget=b).groupBy("document_id").agg(F.count("*").alias("chapters"), F.max("tokens").alias("largest")).withColumn("budget", F.lit(b)) for b in (128, 512, 2048)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    f"""
WITH r AS (SELECT document_id, translate({sql_strip("coalesce(title, '')")}, '/\', '--') AS title, row_number() OVER (PARTITION BY document_id ORDER BY created_at, id) AS k FROM chapters)
SELECT document_id, CASE WHEN title = '' THEN document_id || '/chapter/' || k ELSE document_id || '/' || {sql_prefix("title", 100)} END AS path FROM r"""
)
def materialize_path(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of chapters from their titles, cut at 100 bytes, or from their place where they have none."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("document_id").orderBy("created_at", "id"))
    rows = table(spark, folder, "chapters").select("document_id", t.sanitize_path(F.coalesce("title", F.lit(""))).alias("title"), place.alias("k"))
    return rows.select("document_id", F.when(F.col("title") == "", F.concat_ws("/", "document_id", F.lit("chapter"), "k")).otherwise(F.concat_ws("/", "document_id", "title")).alias("path"))


_WIDTHS = {"documents": 13, "chapters": 8, "topics": 6, "tags": 6, "otel_spans": 12, "deleted_documents": 3}


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, {width} AS width, count(*) AS held FROM {name}" for name, width in _WIDTHS.items()))
def src_schema_init(spark: SparkSession, folder: str) -> DataFrame:
    """The store's tables, made empty in a new folder, with the given rows brought to their columns and added: name, columns and rows of each."""
    made = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    parts = []
    for name in ensured(spark, made):
        rows = table(spark, made, name).unionByName(conformed(table(spark, folder, name), name))
        parts.append(rows.agg(F.count("*").alias("held")).select(F.lit(name).alias("name"), F.lit(len(rows.columns)).alias("width"), "held"))
    return reduce(DataFrame.unionByName, parts)


@query("SELECT id, CASE WHEN lower(trim(coalesce(format, ''))) NOT IN ('markdown', 'md') THEN 'format' WHEN octet_length(encode(coalesce(content, ''))) > 20000 THEN 'bytes' WHEN len(content) > 10000 THEN 'characters' ELSE 'ok' END AS verdict FROM documents")
def validate_ingest(spark: SparkSession, folder: str) -> DataFrame:
    size = F.octet_length(F.coalesce("content", F.lit("")))
    verdict = F.when(~F.lower(F.trim(F.coalesce("format", F.lit("")))).isin("markdown", "md"), "format").when(size > 20_000, "bytes").when(F.char_length("content") > 10_000, "characters").otherwise("ok")
    return table(spark, folder, "documents").select("id", verdict.alias("verdict"))


_BODY = "coalesce(content, '')"


@query(
    f"""
WITH r AS (SELECT c.*, d.status, d.hot_score, row_number() OVER (PARTITION BY c.document_id ORDER BY c.created_at, c.id) AS k FROM chapters c LEFT JOIN documents d ON d.id = c.document_id),
x AS (SELECT *, CASE WHEN octet_length(encode({_BODY})) <= 3500 THEN {_BODY} ELSE {sql_prefix(_BODY, 3500)} || chr(10) || '…(truncated)' END AS excerpt FROM r WHERE k <= 12)
SELECT document_id, '--- References ---' || chr(10) || string_agg(chr(10) || '### Reference [^' || k || '^]' || chr(10) || 'Title: ' || coalesce(title, '') || chr(10) || 'Document ID: ' || document_id || chr(10) || 'Path: ' || coalesce(path, '') || chr(10)
       || CASE WHEN status <> '' THEN 'Document status: ' || status || chr(10) ELSE '' END || 'Relevance (0-1): ' || printf('%.4f', least(1, greatest(0, coalesce(hot_score, 0)))) || chr(10) || 'Excerpt:' || chr(10) || excerpt || chr(10), '' ORDER BY k) AS block FROM x GROUP BY document_id"""
)
def build_reference_block(spark: SparkSession, folder: str) -> DataFrame:
    """The first twelve chapters of each document as numbered references with excerpts of at most 3,500 bytes; the hot score, cut to 0 .. 1, stands for the relevance."""
    from pyspark.sql import Window

    documents = table(spark, folder, "documents").select(F.col("id").alias("document_id"), "status", F.least(F.greatest(F.coalesce("hot_score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("relevance"))
    ranked = table(spark, folder, "chapters").withColumn("k", F.row_number().over(Window.partitionBy("document_id").orderBy("created_at", "id"))).filter("k <= 12")
    ranked = ranked.join(documents, "document_id", "left")
    entry = t.reference_entry(F.col("k"), F.col("title"), F.col("document_id"), F.col("path"), F.col("status"), F.coalesce("relevance", F.lit(0.0)), F.col("content"))
    lists = ranked.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("k", entry.alias("entry")))).alias("l"))  # twelve at most
    return lists.select("document_id", F.concat(F.lit("--- References ---\n"), F.array_join(F.transform("l", lambda x: x["entry"]), "")).alias("block"))


_USABLE = "len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


@query(
    f"""
WITH d AS (SELECT doc_id AS key, embedding, coalesce(content, '') AS text, coalesce({_USABLE}, false) AS stored FROM documents),
h AS {sql_hashed("SELECT key, text FROM d WHERE NOT stored")},
v AS (SELECT key, unnest(range(0, 384)) AS bucket, unnest(embedding)::DOUBLE AS w FROM d WHERE stored UNION ALL SELECT key, bucket, w FROM h)
SELECT d.key AS doc_id, NOT any_value(stored) AS hashed, round(coalesce(sum(w * w), 0), 4) AS square, round(coalesce(sum(w * (bucket + 1)), 0), 3) AS moment FROM d LEFT JOIN v USING (key) GROUP BY d.key"""
)
def embed_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """The stored embedding of each document, or the hashed one of its content where that can't be used; two sums stand for the 384 values."""
    made = embedded(table(spark, folder, "documents", spread=True).select("doc_id", "embedding", "content"), "embedding", "content")
    ramp = F.transform(F.sequence(F.lit(1), F.lit(384)), lambda k: k.cast("double"))
    return made.select("doc_id", "hashed", F.round(dot(F.col("v"), F.col("v")), 4).alias("square"), F.round(dot(F.col("v"), ramp), 3).alias("moment"))


def first_object(text: str | None) -> str | None:
    """The first balanced pair of braces that is JSON, strings and fences heeded; null without one."""
    decoder, at = json.JSONDecoder(), (text or "").find("{")
    while at >= 0:
        try:
            return json.dumps(decoder.raw_decode(text, at)[0], ensure_ascii=False, sort_keys=True)
        except ValueError:
            at = text.find("{", at + 1)
    return None


@query("SELECT id, title, coalesce(title, '') || ' {x}' AS summary FROM documents")
def json_extract_object(spark: SparkSession, folder: str) -> DataFrame:
    """Titles and summaries written as fenced JSON inside prose, then read."""

    @F.pandas_udf("string")
    def find(x: pd.Series) -> pd.Series:
        return x.map(first_object)

    entry = F.to_json(F.struct("title", F.concat(F.coalesce("title", F.lit("")), F.lit(" {x}")).alias("summary")))
    told = F.concat(F.lit("Here {it} is:\n```json\n"), entry, F.lit("\n```\nDone {}"))
    return table(spark, folder, "documents").select("id", F.from_json(find(told), "title string, summary string").alias("o")).select("id", "o.title", "o.summary")


# Streams ------------------------------------------------------------------------------------------------------


def _replayed(spark: SparkSession, folder: str, name: str, time_col: str, **options) -> DataFrame:
    return jobs.replay(spark, folder, name, time_col, f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}", **options)


def _streamed(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    jobs.run_to_table(df, f"{path}/rows", f"{path}/progress")
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


@query("SELECT trace_id, span_id, count(*) AS n FROM (SELECT DISTINCT trace_id, span_id FROM otel_spans) GROUP BY ALL")
def stream_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans as they arrive, each once."""
    return _streamed(spark, jobs.arriving_spans(jobs.stream(spark, folder, "otel_spans"), "3650 days").select("trace_id", "span_id")).groupBy("trace_id", "span_id").agg(F.count("*").alias("n"))


@query("SELECT epoch_us(date_trunc('hour', ts)) AS start, event_type AS key, count(*) AS calls FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each type in each hour, the last ones included."""
    made = _streamed(spark, jobs.calls_in_windows(_replayed(spark, folder, "events", "ts", close="2 hours"), "ts", "event_type"))
    return made.select(F.unix_micros("start").alias("start"), "key", "calls")


@query()
def stream_index(spark: SparkSession, folder: str) -> DataFrame:
    """The chapters of cold documents as a stream of documents leaves them."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    jobs.follow_documents(jobs.stream(spark, folder, "documents"), f"{path}/batches", f"{path}/progress").awaitTermination()
    return jobs.current_index(spark, f"{path}/batches")
