"""Queries of the problems of training text over the store's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.containers import fill, filled_containers, kept_whole
from terrace.llm.cooccurrence import basket, cooccurrence, found_together, with_lift
from terrace.llm.leaks import leaked_spans
from terrace.llm.near_duplicates import NearDuplicates
from terrace.llm.similar_vectors import similar_pairs, similar_vectors
from terrace.llm.stuffed_pages import page_shares, stuffed_pages
from terrace.llm.subjects import document_subjects
from terrace.operators.retrieval import vector_search
from terrace.plans.lineage import written
from terrace.sources.tables import table

#: Topics of the store that are shelves, not subjects.
SHELVES = ["All tags", "Untriaged", "Empty shelf"]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents of cosine 0.80 at least, one among the ten nearest of the other."""
    return similar_pairs(table(spark, folder, "documents", spread=True), "doc_id", "embedding", 0.8, 10)


def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar documents of every document that has a usable embedding."""
    return similar_vectors(table(spark, folder, "documents", spread=True), "doc_id", "embedding", k=10).withColumn("cosine", F.round("cosine", 6))


def p1_recall(spark: SparkSession, folder: str) -> DataFrame:
    """``pairs, found, recall``: of the ten nearest, by brute force, of every document whose id is divisible by 50, how many the forest finds."""
    documents = table(spark, folder, "documents", spread=True).select("doc_id", "embedding").filter(F.exists("embedding", lambda x: x != 0))
    asked = documents.filter("doc_id % 50 = 0")
    exact = vector_search(documents, "doc_id", "embedding", asked, "doc_id", "embedding", k=10, dim=384, skip_self=True)
    exact = exact.select(F.col("question_id").cast("bigint").alias("id"), F.col("key").cast("bigint").alias("neighbour"))
    found = similar_vectors(documents, "doc_id", "embedding", k=10).filter("id % 50 = 0").select("id", "neighbour", F.lit(1).alias("hit"))
    counted = exact.join(found, ["id", "neighbour"], "left").agg(F.count("*").alias("pairs"), F.count("hit").alias("found"))
    return counted.withColumn("recall", F.round(F.col("found") / F.col("pairs"), 6))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the subjects that they treat in a whole section; pages of keywords have none."""
    documents = table(spark, folder, "documents", spread=True)
    labels, topics = table(spark, folder, "subject_labels"), table(spark, folder, "topics")
    return document_subjects(documents, labels, topics, SHELVES, stuffed=stuffed_pages(documents, "doc_id", "text"))


def p2_composition(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents, and what share of all documents with a subject, treat each subject."""
    found = written(p2_found(spark, folder), "subjects")
    every = found.agg(F.countDistinct("doc_id").alias("n"))
    counted = found.groupBy("topic_id").agg(F.count("*").alias("documents")).join(F.broadcast(every)).withColumn("share", F.round(F.col("documents") / F.col("n"), 6)).drop("n")  # one row
    return table(spark, folder, "topics").select(F.col("id").alias("topic_id"), "name").join(counted, "topic_id")


def _title_and_content():
    return F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that share half at least of their runs of five words."""
    return NearDuplicates(table(spark, folder, "documents", spread=True), "doc_id", _title_and_content(), similarity=0.5).all_pairs()


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each document with its class of copies and its group of near duplicates of similarity 0.8 at least."""
    return NearDuplicates(table(spark, folder, "documents", spread=True), "doc_id", _title_and_content()).groups()


def _baskets(spark: SparkSession, folder: str) -> DataFrame:
    documents, topics = table(spark, folder, "documents"), table(spark, folder, "topics")
    return documents.select(basket("tags").alias("items")).unionByName(topics.select(basket("tag_names").alias("items")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of tags in four documents or topics at least, three times as often together as by chance."""
    return found_together(_baskets(spark, folder))


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of tags that stand together, with counts and lift."""
    pairs = with_lift(cooccurrence(_baskets(spark, folder))).drop("baskets")
    return pairs.withColumn("lift", F.round("lift", 6)).withColumnsRenamed({"item_a": "tag_a", "item_b": "tag_b"})


_BASKET_SQL = """
WITH raw AS (SELECT tags AS t FROM documents UNION ALL SELECT tag_names FROM topics),
b AS (SELECT row_number() OVER () AS id, list_distinct(list_filter(list_transform(list_filter(t, lambda x: x IS NOT NULL), lambda x: lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), lambda x: x <> '')) AS items FROM raw),
k AS (SELECT id, items FROM b WHERE len(items) > 0),
i AS (SELECT id, unnest(items) AS item FROM k),
n AS (SELECT item, count(*) AS n FROM i GROUP BY item),
p AS (SELECT x.item AS tag_a, y.item AS tag_b, count(*) AS n_ab FROM i x JOIN i y ON x.id = y.id AND x.item < y.item GROUP BY ALL),
s AS (SELECT p.*, a.n AS n_a, c.n AS n_b, (SELECT count(*) FROM k) AS baskets FROM p JOIN n a ON a.item = tag_a JOIN n c ON c.item = tag_b)
"""


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text, or piece of it, with its container of 2,048 tokens."""
    return filled_containers(table(spark, folder, "documents", spread=True), "doc_id", "text")


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How many containers the documents take and how full these are."""
    return fill(p6_containers(spark, folder))


def p6_kept_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces follow each other, and no container holds more than 2,048 tokens."""
    return kept_whole(written(p6_containers(spark, folder), "containers"))


_WORDS = r"regexp_extract_all(regexp_replace(lower({}), '([\x{{4E00}}-\x{{9FFF}}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"
_USABLE = "len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_NEAREST = f"""
WITH d AS (SELECT doc_id, embedding::DOUBLE[] AS e FROM documents WHERE {_USABLE}),
c AS (SELECT a.doc_id AS id, b.doc_id AS neighbour, list_cosine_similarity(a.e, b.e) AS cosine FROM d a JOIN d b ON a.doc_id <> b.doc_id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(cosine, 9) DESC, neighbour) AS k FROM c) WHERE k <= 10)
"""
_SHINGLED = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(title, '') || ' ' || coalesce(content, '')")} AS w FROM documents),
r AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM w WHERE len(w) >= 20)),
n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id),
p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS shared FROM r a JOIN r b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT doc_a, doc_b FROM p JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b WHERE 2 * shared >= x.n + y.n - shared
"""
_GROUPS = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("coalesce(title, '') || ' ' || coalesce(content, '')")} AS w FROM documents),
r AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM w WHERE len(w) >= 20)),
m AS (SELECT doc_id, md5(string_agg(run, '|' ORDER BY run)) AS mark, count(*) AS n FROM r GROUP BY doc_id),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY mark) AS class_id, n FROM m),
q AS (SELECT r.* FROM r JOIN c USING (doc_id) WHERE doc_id = class_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM q a JOIN q b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 10 * shared >= 8 * (cx.n + cy.n - shared)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT DISTINCT x AS s, x AS t FROM b UNION SELECT reach.s, b.y FROM reach JOIN b ON b.x = reach.t),
g AS (SELECT s, min(t) AS group_id FROM reach GROUP BY s),
l AS (SELECT x, count(*) AS links FROM b GROUP BY x)
SELECT c.doc_id, c.class_id, coalesce(g.group_id, c.class_id) AS group_id, coalesce(l.links, 0) AS links FROM c LEFT JOIN g ON g.s = c.class_id LEFT JOIN l ON l.x = c.class_id
"""
_LEAKED = f"""
WITH i AS (SELECT item_id, {_WORDS.format("passage")} AS w FROM eval_items WHERE passage IS NOT NULL),
g AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 11], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, k - 1 AS place, array_to_string(w[k : k + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d))
"""
_SPANS = (
    _LEAKED
    + """, s AS (SELECT DISTINCT doc_id, item_id, place FROM h JOIN g USING (run)),
n AS (SELECT *, CASE WHEN place <= lag(place) OVER (PARTITION BY doc_id, item_id ORDER BY place) + 12 THEN 0 ELSE 1 END AS new FROM s),
p AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY place) AS part FROM n)
SELECT doc_id, item_id, min(place) AS first_word, max(place) + 11 AS last_word FROM p GROUP BY doc_id, item_id, part"""
)


def p7_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Where passages of the evaluation items stand in documents, as spans of words to remove."""
    return leaked_spans(table(spark, folder, "documents", spread=True), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "passage")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold twelve consecutive words of an item's passage, with the item."""
    return p7_spans(spark, folder).select("doc_id", "item_id").distinct()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents made of keywords, links or product tags instead of sentences."""
    return stuffed_pages(table(spark, folder, "documents", spread=True), "doc_id", "text")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """How many words each document has, and how many of them stand outside prose."""
    return page_shares(table(spark, folder, "documents", spread=True), "doc_id", "text")


QUERIES = {"p1_found": p1_found, "p1_neighbours": p1_neighbours, "p1_recall": p1_recall, "p2_found": p2_found, "p2_composition": p2_composition, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_pairs": p5_pairs, "p6_containers": p6_containers, "p6_fill": p6_fill, "p6_kept_whole": p6_kept_whole, "p7_found": p7_found, "p7_spans": p7_spans, "p8_found": p8_found, "p8_shares": p8_shares}

ORACLE: dict[str, str] = {
    "p1_found": _NEAREST + "SELECT DISTINCT least(id, neighbour) AS doc_a, greatest(id, neighbour) AS doc_b FROM k WHERE cosine >= 0.8",
    "p1_neighbours": _NEAREST + "SELECT id, neighbour, round(round(cosine, 9), 6) AS cosine FROM k",
    "p4_found": _SHINGLED,
    "p4_groups": _GROUPS,
    "p6_kept_whole": "SELECT doc_id, true AS whole, 0 AS overfull FROM documents",
    "p7_found": _LEAKED + "SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (run)",
    "p7_spans": _SPANS,
    "p5_found": _BASKET_SQL + "SELECT tag_a, tag_b FROM s WHERE n_ab >= 4 AND n_ab * baskets >= 3 * n_a * n_b",
    "p5_pairs": _BASKET_SQL + "SELECT tag_a, tag_b, n_ab, n_a, n_b, round(n_ab * baskets::DOUBLE / (n_a * n_b), 6) AS lift FROM s",
}
