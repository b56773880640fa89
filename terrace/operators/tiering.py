"""Keeping the tiers: hot scores, access counts, and the index that follows its documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.text import hot_score
from terrace.operators.catalog import without_deleted


def rescored(documents: DataFrame, as_of: Column) -> DataFrame:
    """Documents with their hot scores as of a moment."""
    return documents.withColumn("hot_score", hot_score(F.col("query_count"), F.col("last_query_at"), as_of))


def much_asked(documents: DataFrame, least: int = 3) -> DataFrame:
    """Cold documents with ``least`` queries or more."""
    return documents.filter((F.col("status") == "cold") & (F.col("query_count") >= least))


def accessed(documents: DataFrame, counts: DataFrame, as_of: Column) -> DataFrame:
    """Documents with ``counts (document_id, queries)`` added to theirs, and the moment as their last query."""
    joined = documents.join(counts.select(F.col("document_id").alias("id"), "queries"), "id", "left")
    hit = F.col("queries").isNotNull()
    return joined.withColumn("query_count", (F.coalesce("query_count", F.lit(0)) + F.coalesce("queries", F.lit(0))).cast("int")).withColumn("last_query_at", F.when(hit, as_of).otherwise(F.col("last_query_at"))).drop("queries")


def changed_since(rows: DataFrame, since: Column) -> DataFrame:
    """Rows created or updated at the moment or later."""
    return rows.filter((F.col("created_at") >= since) | (F.col("updated_at") >= since))


def refreshed(index: DataFrame, chapters: DataFrame, documents: DataFrame, tombstones: DataFrame, since: Column, status: str = "cold") -> DataFrame:
    """The index without deleted documents and with the chapters of changed documents in the place of theirs.

    ``index`` and ``chapters`` have the same columns, ``document_id`` among them; ``chapters`` need only hold those of
    changed documents of the status.
    """
    gone = tombstones.filter(F.col("created_at") >= since)
    changed = changed_since(documents, since).filter(F.col("status") == status).select(F.col("id").alias("document_id"))
    kept = without_deleted(index, gone).join(changed, "document_id", "left_anti")
    new = without_deleted(chapters, gone).join(changed, "document_id", "left_semi")
    return kept.unionByName(new)
