"""Traces of spans: summaries, errors, filters, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.text import span_duration_ms

#: Upper bounds of the histograms' buckets, in seconds.
BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)


def is_root() -> Column:
    return F.coalesce(F.trim("parent_span_id"), F.lit("")) == ""


def rooted(spans: DataFrame) -> DataFrame:
    """Spans of traces that own a span without parent."""
    return spans.join(spans.filter(is_root()).select("trace_id").distinct(), "trace_id", "left_semi")


def root_names(spans: DataFrame) -> DataFrame:
    """``trace_id, root_name``: the name of each trace's earliest span without parent."""
    first = F.struct("start_time_unix_nano", "span_id")
    return spans.filter(is_root()).groupBy("trace_id").agg(F.min_by("name", first).alias("root_name"))


def trace_summaries(spans: DataFrame, service: str = "") -> DataFrame:
    """``trace_id, started, ended, spans, errors, root_name`` of traces that own a root, over the spans of the service, or all without one.

    The service is looked for in the attributes as they are written: ``"service.name":"<service>"``.
    """
    told = '"service.name":"' + service.strip().replace('"', '\\"') + '"'
    kept = spans.filter(F.contains(F.coalesce("attributes_json", F.lit("")), F.lit(told))) if service.strip() else spans
    root, first = is_root(), F.struct("start_time_unix_nano", "span_id")
    sums = kept.groupBy("trace_id").agg(
        F.min("start_time_unix_nano").alias("started"),
        F.max("end_time_unix_nano").alias("ended"),
        F.count("*").alias("spans"),
        F.count_if(F.lower("status_code") == "error").alias("errors"),
        F.min_by(F.when(root, F.col("name")), F.when(root, first)).alias("root_name"),
        F.count_if(root).alias("roots"),
    )
    return sums.filter("roots > 0").drop("roots")


def page(rows: DataFrame, order: list[Column], offset: int, limit: int, most: int = 200) -> DataFrame:
    """Rows ``offset .. offset + limit - 1`` of an ordering; a limit below one means 50, one above ``most`` that."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(limit if limit >= 1 else 50, most))


def filtered_spans(spans: DataFrame, *, text: str = "", status: str = "", kind: str = "", errors_only: bool = False, slow_ms: float | None = None) -> DataFrame:
    """Spans that meet all that is asked for, with ``duration_ms``; ``text`` is looked for in name, own and parent's id and attributes."""
    out = spans.withColumn("duration_ms", span_duration_ms(F.col("start_time_unix_nano"), F.col("end_time_unix_nano")))
    if status:
        out = out.filter(F.lower("status_code") == status.lower())
    if kind:
        out = out.filter(F.lower("kind") == kind.lower())
    if errors_only:
        out = out.filter(F.lower("status_code") == "error")
    if slow_ms is not None:
        out = out.filter(F.col("duration_ms") >= slow_ms)
    if text:
        places = F.concat_ws("\n", "name", "span_id", "parent_span_id", "attributes_json")
        out = out.filter(F.contains(F.lower(places), F.lit(text.lower())))
    return out


def histogram(rows: DataFrame, label: str, seconds: Column) -> DataFrame:
    """``label, bound, n``: how many observations are at most each bound, for each label; the bound of all is null."""
    bucketed = rows.select(F.col(label).alias("label"), seconds.alias("s")).filter("s IS NOT NULL")
    sums = bucketed.groupBy("label").agg(*[F.count_if(F.col("s") <= b).alias(f"b{k}") for k, b in enumerate(BUCKETS)], F.count("*").alias("all"))
    pairs = F.array(*[F.struct(F.lit(b).alias("bound"), F.col(f"b{k}").alias("n")) for k, b in enumerate(BUCKETS)], F.struct(F.lit(None).cast("double").alias("bound"), F.col("all").alias("n")))
    return sums.select("label", F.explode(pairs).alias("p")).select("label", "p.bound", "p.n")
