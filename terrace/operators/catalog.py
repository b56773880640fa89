"""Documents, chapters, tags and topics: lookups, listings, filters, counts, and new snapshots of tables.

Tables have no updates in place: what changes a table takes the old snapshot and the changes and gives the new one.
Listings always have a total order. Where a limit is part of a listing, it is a parameter; None means all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.text import merge_tags, strip_text

ACTIVE = ("hot", "warming")


def _first(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def recent_documents(documents: DataFrame, limit: int | None = 200) -> DataFrame:
    """The documents created last; those without a date come last."""
    return _first(documents.orderBy(F.desc_nulls_last("created_at"), "id"), limit)


def documents_by_status(documents: DataFrame, status: str, limit: int | None = 100) -> DataFrame:
    """Documents of one status by id; a limit of zero or less means 100."""
    return _first(documents.filter(F.col("status") == status).orderBy("id"), 100 if limit is not None and limit <= 0 else limit)


def chapters_of(chapters: DataFrame, document_ids: DataFrame) -> DataFrame:
    """``id, chapters`` for every id asked for, with an empty list where there are none; chapters by date, then id."""
    item = F.struct("created_at", F.col("id").alias("chapter_id"), "path", "title")
    lists = chapters.groupBy(F.col("document_id").alias("id")).agg(F.sort_array(F.collect_list(item)).alias("chapters"))
    asked = document_ids.select("id").distinct().join(lists, "id", "left")
    return asked.withColumn("chapters", F.coalesce("chapters", F.array().cast(lists.schema["chapters"].dataType)))


def with_any_tag(documents: DataFrame, tags: list[str], *, substring: bool = False) -> DataFrame:
    """Documents that hold one of the tags; with ``substring`` also those with a tag that contains one. Null tags hold none."""
    wanted = F.array(*[F.lit(t) for t in tags]).cast("array<string>")
    if substring:
        return documents.filter(F.exists("tags", lambda held: F.exists(wanted, lambda t: F.contains(held, t))))
    return documents.filter(F.arrays_overlap(F.col("tags"), wanted))


def summaries_by_tags(documents: DataFrame, tags: list[str], statuses: tuple[str, ...] = ACTIVE, limit: int | None = 1000) -> DataFrame:
    """Documents of the statuses that hold one of the tags, without their contents; no tags, no documents."""
    wanted = list({t.strip().lower(): t.strip() for t in reversed(tags) if t.strip()}.values())
    kept = with_any_tag(documents, wanted).filter(F.col("status").isin(*statuses)) if wanted else documents.filter(F.lit(False))
    return _first(kept.select("id", "title", "summary", "tags", "status", "hot_score", "query_count").orderBy("id"), limit)


def tags_by_topics(tags: DataFrame, topic_ids: DataFrame, limit: int | None = None) -> DataFrame:
    """Tags of the topics asked for, by topic and name."""
    return _first(tags.join(topic_ids.select(F.col("id").alias("topic_id")).distinct(), "topic_id", "left_semi").orderBy("topic_id", "name"), limit)


def distinct_tags_of(tags: DataFrame, topics: DataFrame) -> DataFrame:
    """``tag_id, name`` of each tag that points to one of the topics, once."""
    pointed = tags.join(topics.select(F.col("id").alias("topic_id")).distinct(), "topic_id", "left_semi")
    return pointed.select(F.col("id").alias("tag_id"), "name").distinct()


def browse(documents: DataFrame, topics: DataFrame, text: str = "") -> DataFrame:
    """``id, bucket``: documents whose title or tags contain ``text``, in the buckets cold, untagged, or a topic's name for each topic that lists one of their tags."""
    low = text.lower()
    hit = F.lit(True) if not low else F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(low)) | F.coalesce(F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(low))), F.lit(False))
    kept = documents.filter(hit)
    tags = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: strip_text(t) != "")
    cold = kept.filter(F.col("status") == "cold").select("id", F.lit("cold").alias("bucket"))
    warm = kept.filter(F.col("status") != "cold").withColumn("tags", tags)
    untagged = warm.filter(F.size("tags") == 0).select("id", F.lit("untagged").alias("bucket"))
    members = topics.select("name", F.explode("tag_names").alias("tag")).distinct()
    by_topic = warm.select("id", F.explode(F.array_distinct("tags")).alias("tag")).join(members, "tag").select("id", F.concat(F.lit("topic:"), "name").alias("bucket")).distinct()
    return cold.unionByName(untagged).unionByName(by_topic)


def status_counts(documents: DataFrame) -> DataFrame:
    """``total, hot, cold, warming``; other statuses count in the total only."""
    return documents.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("hot", "cold", "warming")])


def tag_document_counts(documents: DataFrame) -> DataFrame:
    """``name, document_count``: in how many documents each tag stands, tags trimmed."""
    each = documents.select("id", F.explode(F.array_distinct(F.transform("tags", strip_text))).alias("name")).filter("name <> ''")
    return each.groupBy("name").agg(F.count("*").alias("document_count"))


# New snapshots ------------------------------------------------------------------------------------------------


def created(documents: DataFrame, incoming: DataFrame, as_of: Column) -> DataFrame:
    """The documents and the incoming ones, these without status as cold, without queries, dated ``as_of``; ids that exist already stay as they are."""
    new = incoming.join(documents.select("id"), "id", "left_anti").select(
        "id", "title", "content", F.coalesce("status", F.lit("cold")).alias("status"), F.lit(0).alias("query_count"), F.lit(0.0).alias("hot_score"), as_of.alias("created_at"), as_of.alias("updated_at")
    )
    return documents.select(*new.columns).unionByName(new)


def replaced_chapters(chapters: DataFrame, incoming: DataFrame) -> DataFrame:
    """The chapters with those of the incoming documents in the place of theirs."""
    return chapters.join(incoming.select("document_id").distinct(), "document_id", "left_anti").select(*incoming.columns).unionByName(incoming)


def updated(table: DataFrame, changes: DataFrame, key: str, as_of: Column) -> DataFrame:
    """The table with the changed values in place of the old where they aren't null; changed rows get ``updated_at``. Unknown keys are ignored."""
    fields = [c for c in changes.columns if c != key]
    delta = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in fields], F.lit(True).alias("changed"))
    joined = table.join(delta, key, "left")
    value = {c: F.coalesce(f"new_{c}", c) for c in fields} | {"updated_at": F.when(F.col("changed"), as_of).otherwise(F.col("updated_at"))}
    return joined.select(*[value.get(c, F.col(c)).alias(c) for c in table.columns])


def upserted_tags(tags: DataFrame, names: DataFrame, as_of: Column) -> DataFrame:
    """``name, id, topic_id, updated_at``: known tags that are named again are touched, unknown ones added without topic."""
    seen = names.select(strip_text(F.col("name")).alias("name")).filter("name <> ''").distinct().withColumn("seen", F.lit(True))
    both = tags.select("name", "id", "topic_id", "updated_at").join(seen, "name", "full_outer")
    return both.select("name", F.coalesce("id", F.sha2("name", 256)).alias("id"), "topic_id", F.when(F.col("seen"), as_of).otherwise(F.col("updated_at")).alias("updated_at"))


def upserted_spans(spans: DataFrame) -> DataFrame:
    """Each span once as it was delivered last; empty parents are null."""
    last = Window.partitionBy("trace_id", "span_id").orderBy(F.desc_nulls_last("created_at"), F.desc("id"))
    kept = spans.withColumn("place", F.row_number().over(last)).filter("place = 1").drop("place")
    return kept.withColumn("parent_span_id", F.when(F.trim("parent_span_id") != "", F.col("parent_span_id")))


def regrouped_topics(tags: DataFrame, name: str = "All tags") -> DataFrame:
    """``topic, tag``: one topic with all tags, a row for each, so that no list of unknown length is gathered."""
    return tags.filter("name IS NOT NULL").select(F.lit(name).alias("topic"), F.col("name").alias("tag")).distinct()


def entombed(tombstones: DataFrame, documents: DataFrame, as_of: Column) -> DataFrame:
    """The tombstones and one more for each of the documents."""
    new = documents.select(F.sha2(F.concat(F.lit("tombstone:"), "id"), 256).alias("id"), F.col("id").alias("document_id"), as_of.alias("created_at"))
    return tombstones.select("id", "document_id", "created_at").unionByName(new)


def without_deleted(rows: DataFrame, tombstones: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows of documents that have no tombstone."""
    return rows.join(tombstones.select(F.col("document_id").alias(key)), key, "left_anti")


def ingested(documents: DataFrame, analyses: DataFrame) -> DataFrame:
    """``id, status, tags, summary`` of hot documents after analysis: tags of both merged, summary of the analysis if any; documents that aren't hot stay as they are."""
    joined = documents.join(analyses.select("id", F.col("tags").alias("more"), F.col("summary").alias("made")), "id", "left")
    hot = F.col("status") == "hot"
    return joined.select("id", "status", F.when(hot, merge_tags(F.col("tags"), F.col("more"))).otherwise(F.col("tags")).alias("tags"), F.when(hot, F.coalesce("made", "summary")).otherwise(F.col("summary")).alias("summary"))


def navigation(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """``node, parent, name, depth, leaf``: the tree of all prefixes of slash-separated paths; empty segments are skipped."""
    parts = paths.select(F.filter(F.split(path_col, "/"), lambda s: s != "").alias("parts")).filter("size(parts) > 0").distinct()
    each = parts.select("parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    nodes = each.select(F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("node"), F.when(F.col("depth") > 1, F.array_join(F.slice("parts", F.lit(1), F.col("depth") - 1), "/")).alias("parent"), F.element_at("parts", F.col("depth")).alias("name"), "depth", (F.col("depth") == F.size("parts")).alias("end"))
    return nodes.groupBy("node", "parent", "name", "depth").agg(F.bool_or("end").alias("path"), (~F.bool_or(~F.col("end"))).alias("leaf"))
