from pyspark.sql import functions as F

from terrace.operators import retrieval as r
from terrace.plans import searches

FAR = "plain opening words that say nothing at all about it, "


def store(spark, folder):
    make = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    make("eval_items", [(1, FAR + "zebra quagga okapi"), (2, "tapir")], "item_id bigint, passage string")
    cold = [("e1", "Far", "cold", None, 0, "x" * 50 + " " + FAR), ("e2", None, "cold", None, 0, "y" * 3000 + " okapi quagga"), ("e3", "okapi", "COLD", None, 0, "okapi"), ("e4", "/", "cold", None, 0, None)]
    make("documents", [("d", "opening words", "hot", ["words"], 0, "zebra okapi"), *cold], "id string, title string, status string, tags array<string>, query_count int, text string")
    make("tags", [], "name string, topic_id string")
    make("topics", [], "id string, name string")
    chapters = [("c1", "d", "far", None, None, "x" * 50 + " " + FAR), ("c2", "d", "summary", None, FAR + "zebra", "none"), ("c3", "d", "beast", None, " ", "y" * 50 + " okapi quagga"), ("c4", "d", "other", None, "nothing", FAR)]
    make("chapters", chapters, "id string, document_id string, path string, title string, summary string, content string")
    return str(folder)


def test_whole_passages_are_asked_and_whole_chapters_judged(spark, tmp_path):
    folder = store(spark, tmp_path)
    hits = {(x.question_id, x.key) for x in searches.lexical_search(spark, folder).collect()}
    assert hits == {("1", "e1/Far"), *[("1", f"e2/__root__/{k}") for k in (4,)]}  # no hot document, no other question
    shown = {(x.question_id, x.path, x.title) for x in searches.chapter_hits(spark, folder).collect()}
    assert ("1", "e2/__root__/4", "") in shown and ("2", "e4/-", "/") in shown
    judged = {(x.question_id, x.id): x.score for x in searches.join_scores_chapters(spark, folder).collect()}
    n = len((FAR + "zebra quagga okapi").replace(",", "").split())
    assert judged == {("1", "c1"): round((n - 3) / n, 6), ("1", "c2"): round((n - 2) / n, 6)}
    assert {x.path for x in searches.hot_funnel(spark, folder).collect()} == {"far", "summary"}


def test_held_scores_in_blocks(spark):
    asked = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), ("b", "y"), ("c", "w")], "question_id string, term string")
    rows = spark.createDataFrame([("k1", "y y z"), ("k2", "x"), ("k3", None), ("k4", "")], "key string, text string")
    want = {("a", "k1", 0.666667), ("b", "k1", 1.0)}
    for block in (1, 4096):
        assert {tuple(x) for x in r.held_scores(asked, rows, "key", F.col("text"), block=block).collect()} == want
    assert r.held_scores(asked.limit(0), rows, "key", F.col("text")).collect() == []
    assert r.held_scores(asked, rows.limit(0), "key", F.col("text")).collect() == []
