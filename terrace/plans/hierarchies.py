"""Queries of the span hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.operators.hierarchy import counted_below, descendant_pairs, hierarchy, tidy
from terrace.plans.lineage import written
from terrace.sources.tables import table


def _spans(spark: SparkSession, folder: str, **options) -> DataFrame:
    return hierarchy(table(spark, folder, "otel_spans"), "trace_id", "span_id", "parent_span_id", **options)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each span's root and depth; -1 for spans that no root reaches, with the smallest id on their cycle."""
    return _spans(spark, folder).select(F.col("grp").alias("trace_id"), F.col("node").alias("span_id"), F.col("root").alias("root_span_id"), "depth")


def p3_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Each span with parent, root, path, depth, subtree size, preorder number, and whether it is on a cycle."""
    return _spans(spark, folder, paths=True).select(
        F.col("grp").alias("trace_id"), F.col("node").alias("span_id"), F.col("parent").alias("parent_span_id"), F.col("root").alias("root_span_id"), "depth", "size", "first", "cyclic", "path"
    )


def p3_subtree_errors(spark: SparkSession, folder: str) -> DataFrame:
    """How many spans of each span's subtree, itself included, have failed in their last delivery."""
    nodes = written(_spans(spark, folder), "spans")
    last = table(spark, folder, "otel_spans").groupBy(tidy("trace_id").alias("grp"), tidy("span_id").alias("node")).agg(F.max_by(F.lower("status_code"), F.struct("created_at", "id")).alias("status"))
    marked = nodes.join(last, ["grp", "node"], "left")
    return counted_below(marked, F.col("status") == "error").select(F.col("grp").alias("trace_id"), F.col("node").alias("span_id"), F.col("n").alias("errors"))


def p3_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """All descendants of every span, a row each."""
    nodes = written(_spans(spark, folder), "spans")
    pairs = descendant_pairs(nodes)
    return pairs.select(F.col("grp").alias("trace_id"), F.col("ancestor").alias("span_id"), F.col("node").alias("descendant_span_id"))


QUERIES = {"p3_found": p3_found, "p3_hierarchy": p3_hierarchy, "p3_subtree_errors": p3_subtree_errors, "p3_descendants": p3_descendants}
_TREE = """
WITH RECURSIVE raw AS (SELECT lower(regexp_replace(trace_id, '^\\s+|\\s+$', '', 'g')) AS t, lower(regexp_replace(span_id, '^\\s+|\\s+$', '', 'g')) AS s, nullif(lower(regexp_replace(parent_span_id, '^\\s+|\\s+$', '', 'g')), '') AS p FROM otel_spans),
one AS (SELECT t, s, min(p) AS p FROM raw WHERE t <> '' AND s <> '' GROUP BY t, s),
l AS (SELECT a.t, a.s, b.s AS p FROM one a LEFT JOIN one b ON b.t = a.t AND b.s = a.p),
down AS (SELECT t, s, s AS root, 0::BIGINT AS depth, [s] AS line FROM l WHERE p IS NULL UNION ALL SELECT l.t, l.s, d.root, d.depth + 1, list_append(d.line, l.s) FROM down d JOIN l ON l.t = d.t AND l.p = d.s),
rest AS (SELECT l.t, l.s, l.p FROM l LEFT JOIN down d ON d.t = l.t AND d.s = l.s WHERE d.s IS NULL),
walk AS (SELECT t, s AS start, s AS at, [s] AS way, false AS done FROM rest
         UNION ALL SELECT w.t, w.start, r.p, CASE WHEN list_contains(w.way, r.p) THEN w.way[list_position(w.way, r.p):] ELSE list_append(w.way, r.p) END, list_contains(w.way, r.p) FROM walk w JOIN rest r ON r.t = w.t AND r.s = w.at WHERE NOT w.done),
up AS (SELECT t, s, s AS above FROM down UNION ALL SELECT u.t, u.s, l.p FROM up u JOIN l ON l.t = u.t AND l.s = u.above WHERE l.p IS NOT NULL)
"""
_LAST = "last AS (SELECT t, s, arg_max(status, (created_at, id)) AS status FROM (SELECT lower(regexp_replace(trace_id, '^\\s+|\\s+$', '', 'g')) AS t, lower(regexp_replace(span_id, '^\\s+|\\s+$', '', 'g')) AS s, lower(status_code) AS status, created_at, id FROM otel_spans) GROUP BY t, s)"
ORACLE: dict[str, str] = {
    "p3_found": _TREE + "SELECT t AS trace_id, s AS span_id, root AS root_span_id, depth FROM down UNION ALL SELECT t, start, list_min(way), -1 FROM walk WHERE done",
    "p3_hierarchy": _TREE
    + """, sizes AS (SELECT t, above AS s, count(*) AS size FROM up GROUP BY ALL)
SELECT d.t AS trace_id, d.s AS span_id, l.p AS parent_span_id, d.root AS root_span_id, d.depth, z.size, row_number() OVER (PARTITION BY d.t, d.root ORDER BY d.line) - 1 AS first, false AS cyclic, array_to_string(d.line, '/') AS path
FROM down d JOIN l ON l.t = d.t AND l.s = d.s JOIN sizes z ON z.t = d.t AND z.s = d.s
UNION ALL SELECT w.t, w.start, l.p, list_min(way), -1, -1, -1, list_contains(way, w.start), NULL FROM walk w JOIN l ON l.t = w.t AND l.s = w.start WHERE done""",
    "p3_subtree_errors": _TREE + ", " + _LAST + ", n AS (SELECT u.t, u.above AS s, count(*) AS errors FROM up u JOIN last ON last.t = u.t AND last.s = u.s WHERE status = 'error' GROUP BY ALL) SELECT l.t AS trace_id, l.s AS span_id, coalesce(n.errors, 0) AS errors FROM l LEFT JOIN n ON n.t = l.t AND n.s = l.s",
    "p3_descendants": _TREE + "SELECT t AS trace_id, above AS span_id, s AS descendant_span_id FROM up WHERE s <> above",
}
