"""Queries of traces, access logs and tier maintenance, with their SQL.

Events stand for sessions and calls, customers for users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.operators import catalog as c
from terrace.operators import tiering
from terrace.operators import traces as t
from terrace.operators.chunking import last_by_path, split_chapters
from terrace.plans.catalogue import AS_OF, as_of, moment
from terrace.sources.tables import table

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


_LAST = "WITH s AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, span_id ORDER BY created_at DESC NULLS LAST, id DESC) AS k FROM otel_spans) WHERE k = 1)"


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    return c.upserted_spans(table(spark, folder, "otel_spans"))


@query(_LAST + " SELECT id, trace_id, span_id, CASE WHEN trim(parent_span_id) <> '' THEN parent_span_id END AS parent_span_id, status_code, end_time_unix_nano FROM s")
def sink_upsert_span(spark: SparkSession, folder: str) -> DataFrame:
    return _spans(spark, folder).select("id", "trace_id", "span_id", "parent_span_id", "status_code", "end_time_unix_nano")


@query("SELECT id, span_id, coalesce(parent_span_id, '') AS parent_span_id, name, start_time_unix_nano, coalesce(status_message, '') AS status_message, coalesce(attributes_json, '') AS attributes_json FROM otel_spans WHERE trace_id = (SELECT max(trace_id) FROM otel_spans)")
def scan_trace_spans(spark: SparkSession, folder: str) -> DataFrame:
    spans = table(spark, folder, "otel_spans")
    asked = spans.agg(F.max("trace_id")).first()[0]
    told = [F.coalesce(x, F.lit("")).alias(x) for x in ("parent_span_id", "status_message", "attributes_json")]
    return spans.filter(F.col("trace_id") == asked).orderBy("start_time_unix_nano", "id").select("id", "span_id", told[0], "name", "start_time_unix_nano", *told[1:])


@query("SELECT id, trace_id, span_id FROM otel_spans WHERE trace_id IN (SELECT trace_id FROM otel_spans WHERE coalesce(trim(parent_span_id), '') = '')")
def semi_rooted_traces(spark: SparkSession, folder: str) -> DataFrame:
    return t.rooted(table(spark, folder, "otel_spans")).select("id", "trace_id", "span_id")


@query(_LAST + " SELECT trace_id, arg_min(name, (start_time_unix_nano, span_id)) AS root_name FROM s WHERE coalesce(trim(parent_span_id), '') = '' GROUP BY trace_id")
def scalar_sub_root_name(spark: SparkSession, folder: str) -> DataFrame:
    return t.root_names(_spans(spark, folder))


_SUMMARY = (
    _LAST
    + """,
k AS (SELECT *, coalesce(trim(parent_span_id), '') = '' AS root FROM s WHERE contains(coalesce(attributes_json, ''), '"service.name":"kb-api"')),
sums AS (SELECT trace_id, min(start_time_unix_nano) AS started, max(end_time_unix_nano) AS ended, count(*) AS spans, count(*) FILTER (WHERE lower(status_code) = 'error') AS errors,
         arg_min(name, (start_time_unix_nano, span_id)) FILTER (WHERE root) AS root_name FROM k GROUP BY trace_id HAVING bool_or(root))"""
)


@query(_SUMMARY + " SELECT * FROM sums")
def agg_trace_summary(spark: SparkSession, folder: str) -> DataFrame:
    return t.trace_summaries(_spans(spark, folder), "kb-api")


@query(_SUMMARY + " SELECT * FROM sums ORDER BY started DESC, trace_id LIMIT 50 OFFSET 20")
def offset_page(spark: SparkSession, folder: str) -> DataFrame:
    return t.page(t.trace_summaries(_spans(spark, folder), "kb-api"), [F.desc("started"), F.asc("trace_id")], 20, 0)


@query(_SUMMARY + " SELECT trace_id, root_name FROM sums WHERE contains(lower(trace_id), 'ab') OR contains(lower(root_name), 'query')")
def trace_list_filter(spark: SparkSession, folder: str) -> DataFrame:
    sums = t.trace_summaries(_spans(spark, folder), "kb-api")
    return sums.filter(F.contains(F.lower("trace_id"), F.lit("ab")) | F.contains(F.lower("root_name"), F.lit("query"))).select("trace_id", "root_name")


@query("SELECT trace_id, count(*) FILTER (WHERE lower(status_code) = 'error') AS errors, count(*) AS spans FROM otel_spans GROUP BY trace_id")
def agg_trace_errors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "otel_spans").groupBy("trace_id").agg(F.count_if(F.lower("status_code") == "error").alias("errors"), F.count("*").alias("spans"))


@query("SELECT id, (end_time_unix_nano - start_time_unix_nano) / 1e6::DOUBLE AS duration_ms FROM otel_spans WHERE lower(status_code) = 'error' AND end_time_unix_nano >= start_time_unix_nano AND (end_time_unix_nano - start_time_unix_nano) / 1e6::DOUBLE >= 10 AND contains(lower(concat_ws(chr(10), name, span_id, parent_span_id, attributes_json)), 'kb-api')")
def span_filter(spark: SparkSession, folder: str) -> DataFrame:
    kept = t.filtered_spans(table(spark, folder, "otel_spans"), text="KB-api", errors_only=True, slow_ms=10)
    return kept.orderBy(F.desc_nulls_last("duration_ms"), "id").select("id", "duration_ms")


@query(
    f"""
WITH p AS (SELECT lower(name) AS label, (end_time_unix_nano - start_time_unix_nano) / 1e9::DOUBLE AS s FROM otel_spans WHERE end_time_unix_nano >= start_time_unix_nano),
b AS (SELECT unnest([0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60, 120, 300]::DOUBLE[]) AS bound)
SELECT label, bound, count(*) FILTER (WHERE s <= bound) AS n FROM p, b GROUP BY ALL UNION ALL SELECT label, -1, count(*) FROM p GROUP BY label"""
)
def metrics_histogram(spark: SparkSession, folder: str) -> DataFrame:
    spans = table(spark, folder, "otel_spans").withColumn("label", F.lower("name")).filter("end_time_unix_nano >= start_time_unix_nano")
    made = t.histogram(spans, "label", (F.col("end_time_unix_nano") - F.col("start_time_unix_nano")) / F.lit(1e9))
    return made.select("label", F.coalesce("bound", F.lit(-1.0)).alias("bound"), "n")


@query(
    """
WITH RECURSIVE s AS (SELECT trace_id, span_id, min(CASE WHEN trim(parent_span_id) <> '' THEN lower(trim(parent_span_id)) END) AS parent, min(start_time_unix_nano) AS started FROM (SELECT lower(trim(trace_id)) AS trace_id, lower(trim(span_id)) AS span_id, parent_span_id, start_time_unix_nano FROM otel_spans) GROUP BY ALL),
l AS (SELECT s.*, p.span_id IS NULL AS root FROM s LEFT JOIN s p ON p.trace_id = s.trace_id AND p.span_id = s.parent)
SELECT trace_id, count(*) AS spans, count(*) FILTER (WHERE root) AS roots, count(*) FILTER (WHERE root AND parent IS NOT NULL) AS orphans FROM l GROUP BY trace_id"""
)
def span_parent_child(spark: SparkSession, folder: str) -> DataFrame:
    """Of each trace the spans, the roots, and those roots whose parent isn't there."""
    from terrace.operators.hierarchy import tidy

    spans = table(spark, folder, "otel_spans").select(tidy("trace_id").alias("trace_id"), tidy("span_id").alias("span_id"), tidy("parent_span_id").alias("parent"))
    spans = spans.groupBy("trace_id", "span_id").agg(F.min("parent").alias("parent"))
    parents = spans.select("trace_id", F.col("span_id").alias("parent"), F.lit(True).alias("known"))
    root = F.col("known").isNull()
    return spans.join(parents, ["trace_id", "parent"], "left").groupBy("trace_id").agg(F.count("*").alias("spans"), F.count_if(root).alias("roots"), F.count_if(root & F.col("parent").isNotNull()).alias("orphans"))


# Access logs --------------------------------------------------------------------------------------------------


@query("SELECT user_id, count(*) AS calls, count(DISTINCT event_type) AS kinds FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY user_id")
def agg_api_usage(spark: SparkSession, folder: str) -> DataFrame:
    kept = table(spark, folder, "events").filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    return kept.groupBy("user_id").agg(F.count("*").alias("calls"), F.countDistinct("event_type").alias("kinds"))


@query("SELECT user_id, count(*) AS sessions, count(DISTINCT event_type) AS fingerprints, count(*) > 0 AS active FROM events WHERE ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-20' GROUP BY user_id")
def agg_distinct_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions that a week after their start are still open, and their distinct kinds."""
    live = table(spark, folder, "events").filter(F.col("ts") > F.lit("2024-01-13").cast("timestamp_ntz"))
    return live.groupBy("user_id").agg(F.count("*").alias("sessions"), F.countDistinct("event_type").alias("fingerprints"), (F.count("*") > 0).alias("active"))


@query("SELECT user_id, count(*) AS sessions FROM events GROUP BY user_id")
def agg_session_count(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND ts > TIMESTAMP '2024-01-13') AS active FROM customer")
def has_active_session(spark: SparkSession, folder: str) -> DataFrame:
    live = table(spark, folder, "events").filter(F.col("ts") > F.lit("2024-01-13").cast("timestamp_ntz")).select(F.col("user_id").alias("c_custkey")).distinct().withColumn("active", F.lit(True))
    return table(spark, folder, "customer").select("c_custkey").join(live, "c_custkey", "left").select("c_custkey", F.coalesce("active", F.lit(False)).alias("active"))


@query("SELECT e.event_id, c.c_name, e.event_type FROM events e JOIN customer c ON c.c_custkey = e.user_id")
def join_sessions_users(spark: SparkSession, folder: str) -> DataFrame:
    users = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return table(spark, folder, "events").join(users, "user_id").select("event_id", "c_name", "event_type")


# Tiers --------------------------------------------------------------------------------------------------------


@query(f"SELECT id, CASE WHEN coalesce(query_count, 0) = 0 THEN 0 ELSE floor(query_count / (1 + ln(1 + greatest(0, coalesce((epoch_us(TIMESTAMPTZ '{AS_OF}+00') - epoch_us(last_query_at)) / 3.6e9::DOUBLE, 168)))) * 100 + 0.5) / 100 END AS hot_score, status FROM documents")
def recalc_hot_scores(spark: SparkSession, folder: str) -> DataFrame:
    return tiering.rescored(table(spark, folder, "documents"), as_of()).select("id", "hot_score", "status")


@query("SELECT id, query_count::INT AS query_count FROM documents WHERE status = 'cold' AND query_count >= 3")
def promotion_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return tiering.much_asked(table(spark, folder, "documents")).select("id", "query_count")


@query(
    """
WITH gone AS (SELECT document_id FROM deleted_documents WHERE document_id IS NOT NULL),
changed AS (SELECT id FROM documents WHERE status = 'hot' AND (created_at >= TIMESTAMPTZ '2025-03-01 00:00:00+00' OR updated_at >= TIMESTAMPTZ '2025-03-01 00:00:00+00'))
SELECT document_id, path, 'old' AS version FROM chapters WHERE document_id NOT IN (SELECT document_id FROM gone) AND document_id NOT IN (SELECT id FROM changed)
UNION ALL SELECT document_id, path, 'new' FROM chapters WHERE document_id NOT IN (SELECT document_id FROM gone) AND document_id IN (SELECT id FROM changed)"""
)
def refresh_index(spark: SparkSession, folder: str) -> DataFrame:
    """Hot documents changed since March 2025 get their chapters anew."""
    chapters, documents, gone = (table(spark, folder, n) for n in ("chapters", "documents", "deleted_documents"))
    rows = chapters.select("document_id", "path")
    since = moment("2025-03-01 00:00:00")
    gone = gone.withColumn("created_at", since)
    return tiering.refreshed(rows.withColumn("version", F.lit("old")), rows.withColumn("version", F.lit("new")), documents, gone, since, "hot")


@query()
def refresh_cold_index(spark: SparkSession, folder: str) -> DataFrame:
    """The chapters of cold documents that weren't changed since March 2025, and those cut anew of the changed ones."""
    documents, gone = table(spark, folder, "documents", spread=True), table(spark, folder, "deleted_documents")
    since = moment("2025-03-01 00:00:00")
    rows = last_by_path(split_chapters(documents.filter("status = 'cold'"), "id", "title", "content")).select("document_id", "path", "title", "content")
    return tiering.refreshed(rows.withColumn("version", F.lit("old")), rows.withColumn("version", F.lit("new")), documents, gone, since)


@query("SELECT 'All tags' AS topic, count(DISTINCT name) AS tags FROM tags")
def regroup_topics(spark: SparkSession, folder: str) -> DataFrame:
    return c.regrouped_topics(table(spark, folder, "tags")).groupBy("topic").agg(F.count("*").alias("tags"))
