import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from terrace.operators import catalog as c
from terrace.operators import retrieval as r
from terrace.operators.tiering import accessed, changed_since, rescored
from terrace.operators.traces import filtered_spans, histogram, trace_summaries

HITS = "question_id string, document_id string, path string, score double"


def test_fusion_and_ties(spark):
    lexical = spark.createDataFrame([("q", "a", 4.0), ("q", "b", 2.0), ("z", "a", 0.0)], "question_id string, key string, score double")
    vector = spark.createDataFrame([("q", "b", 0.5), ("q", "c", 0.5), ("q", "d", 0.0)], "question_id string, key string, score double")
    got = {(x.question_id, x.key): (x.score, x.source) for x in r.fused(lexical, vector).collect()}
    assert got == {("q", "a"): (0.5, "bm25"), ("q", "b"): (0.5, "hybrid"), ("q", "c"): (0.25, "vector"), ("q", "d"): (0.0, "vector"), ("z", "a"): (0.0, "bm25")}
    assert [x.key for x in r.fused(lexical, vector, 1).filter("question_id = 'q'").collect()] == ["a"]


def test_merge_keeps_the_best_and_prefers_hot(spark):
    hot = spark.createDataFrame([("q", "d1", "p1", 0.6), ("q", "d2", "p", 0.9), ("q", "d3", "p", 0.5)], HITS)
    cold = spark.createDataFrame([("q", "d1", "p1", 0.95), ("q", "d3", "p", 0.5)], HITS)
    rows = sorted(r.merged_hits(hot, cold, 15).collect(), key=lambda x: -x.score)
    assert [(x.document_id, x.score, x.source) for x in rows] == [("d1", 0.95, "cold_index"), ("d2", 0.9, "hot_progressive"), ("d3", 0.5, "hot_progressive")]
    assert [(x.document_id, x.queries) for x in r.accesses(hot.unionByName(cold)).orderBy("document_id").collect()] == [("d1", 1), ("d2", 1), ("d3", 1)]


def test_vector_search_leaves_out_what_is_no_vector(spark):
    rows = [("a", [1.0, 0.0]), ("b", [float("nan"), 1.0]), ("c", [1.0]), ("d", None), ("e", [1.0, 0.0]), ("f", [0.0, 0.0]), ("g", [None, 1.0])]
    df = spark.createDataFrame(rows, "key string, v array<double>")
    got = r.vector_search(df, "key", "v", df.filter("key IN ('a', 'd')"), "key", "v", k=2, dim=2, skip_self=True).orderBy("score").collect()
    assert [(x.question_id, x.key, x.score) for x in got] == [("a", "f", 0.0), ("a", "e", 1.0)]
    small = r.vector_search(df, "key", "v", df.filter("key IN ('a', 'e')"), "key", "v", k=1, dim=2, skip_self=True, block_mb=0.00001).collect()
    assert {(x.question_id, x.key) for x in small} == {("a", "e"), ("e", "a")}
    assert r.vector_search(df.limit(0), "key", "v", df, "key", "v", dim=2).collect() == []
    assert r.vector_search(df, "key", "v", df.limit(0), "key", "v", dim=2).collect() == []


def test_lexical_search(spark):
    rows = spark.createDataFrame([("a", "alpha beta beta"), ("b", "beta"), ("c", None), ("d", "")], "key string, t string")
    asked = r.question_terms(spark.createDataFrame([("q", "BETA beta"), ("n", None)], "id string, t string"), "id", "t")
    assert [x.key for x in r.lexical_search(rows, "key", ["t"], asked).orderBy(F.desc("score")).collect()] == ["b", "a"]
    assert r.lexical_search(rows.limit(0), "key", ["t"], asked).collect() == [] and r.lexical_search(rows, "key", ["t"], asked.limit(0)).collect() == []


def test_scores_in_blocks_and_by_hand(spark):
    from math import log

    texts = {"a": "x y y z", "b": "x", "c": "y " * 50, "d": None, "e": "w"}
    rows = spark.createDataFrame(list(texts.items()), "key string, t string")
    asked = [("q", "x"), ("q", "y"), ("p", "z"), ("p", "v"), ("o", "w")]
    questions = spark.createDataFrame(asked, "question_id string, term string")
    split = {k: (t or "").split() for k, t in texts.items()}
    usual = sum(map(len, split.values())) / len(split)
    want = {"bm25": {}, "tfidf": {}}
    for q, term in asked:
        df = sum(term in t for t in split.values())
        for k, t in split.items():
            if n := t.count(term):
                part = log(1 + (5 - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(t) / usual)), n**0.5 * (1 + log(5 / (df + 1))) ** 2 / len(t) ** 0.5
                for name, x in zip(want, part):
                    want[name][q, k] = want[name].get((q, k), 0) + x
    for scoring in want:
        for options in ({}, {"block": 1}, {"block_terms": 2}):
            got = {(x.question_id, x.key): x.score for x in r.lexical_search(rows, "key", ["t"], questions, scoring=scoring, **options).collect()}
            assert got == {k: round(x, 6) for k, x in want[scoring].items()}
    assert {(x.question_id, x.key) for x in r.lexical_search(rows, "key", ["t"], questions, k=1).collect()} == {max((score, k) for k, score in want["bm25"].items() if k[0] == q)[1] for q in "qpo"}


def test_funnel_cuts_at_every_stage(spark):
    docs = spark.createDataFrame([("d1", "hot", 1, ["x"]), ("d2", "cold", 1, ["x"]), ("d3", "warming", 1, ["y"]), ("d4", "hot", 1, None)], "id string, status string, query_count int, tags array<string>")
    chapters = spark.createDataFrame([("c1", "d1", "p", "s", ""), ("c2", "d2", "p", "s", ""), ("c3", "d3", "p", "s", ""), ("c4", "d1", "q", " ", " "), ("c5", "d1", "p", None, " text")], "id string, document_id string, path string, summary string, content string").withColumn("title", F.lit("T"))
    score = lambda *rows: spark.createDataFrame([("q", *x) for x in rows], "question_id string, key string, score double")
    got = r.hot_funnel(score(("x", 0.5), ("y", 0.49)), docs, score(("d1", 1.0), ("d2", 1.0), ("d3", 1.0)), chapters, score(*[(f"c{k}", 0.5 + k / 10) for k in range(1, 6)])).collect()
    assert [(x.document_id, x.path, x.title, x.content, round(x.score, 6)) for x in got] == [("d1", "p", "T", "text", 1.0)]


def test_snapshots(spark):
    now = F.to_timestamp(F.lit("2026-01-01"))
    base = spark.createDataFrame([("a", "t", None), ("b", "u", None)], "id string, title string, updated_at timestamp")
    new = {x.id: x for x in c.updated(base, spark.createDataFrame([("a", "T"), ("z", "Z")], "id string, title string"), "id", now).collect()}
    assert new["a"].title == "T" and new["a"].updated_at and new["b"].updated_at is None and set(new) == {"a", "b"}
    docs = spark.createDataFrame([("a", 1, None)], "id string, query_count int, last_query_at timestamp")
    assert accessed(docs, spark.createDataFrame([("a", 2)], "document_id string, queries bigint"), now).first().query_count == 3
    assert rescored(docs, now).first().hot_score == 0.16
    rows = spark.sql("SELECT 1 AS id, timestamp'2024-01-01' AS created_at, cast(null AS timestamp) AS updated_at UNION ALL SELECT 2, null, timestamp'2026-01-01' UNION ALL SELECT 3, null, null")
    assert [x.id for x in changed_since(rows, F.to_timestamp(F.lit("2025-01-01"))).collect()] == [2]
    assert c.chapters_of(spark.createDataFrame([], "id string, document_id string, path string, title string, created_at timestamp"), spark.createDataFrame([("d",)], "id string")).first().chapters == []


def test_topics_and_their_tags(spark):
    tags = spark.createDataFrame([("1", "red", "t"), ("2", "blue", "u"), ("3", "red", "t"), ("4", None, None)], "id string, name string, topic_id string")
    topics = spark.createDataFrame([("t", ["blue"])], "id string, tag_names array<string>")
    assert {tuple(x) for x in c.distinct_tags_of(tags, topics).collect()} == {("1", "red"), ("3", "red")}
    assert {tuple(x) for x in c.regrouped_topics(tags).collect()} == {("All tags", "red"), ("All tags", "blue")}


def test_routes_of_tags(spark):
    asked = spark.createDataFrame([("q", x) for x in ("law", "court", "red")] + [("z", "red")], "question_id string, term string")
    tags = spark.createDataFrame([("court", "t1"), ("red", "t2"), ("court", None), ("other", "t1")], "name string, topic_id string")
    topics = spark.createDataFrame([("t1", "Law"), ("t2", "Paint"), ("t3", "Law"), ("t4", "law law")], "id string, name string")
    routed = lambda **o: {(x.question_id, x.key) for x in r.routed_tags(asked, tags, topics, **o).collect()}
    assert routed() == {("q", "court"), ("q", "red"), ("z", "red")}
    assert routed(threshold=3) == {("q", "court")} and routed(threshold=3, most_topics=0) == set()


def test_navigation(spark):
    nodes = {x.node: x for x in c.navigation(spark.createDataFrame([("a/b",), ("a//b/c",), ("/x",), (None,), ("",)], "path string")).collect()}
    assert set(nodes) == {"a", "a/b", "a/b/c", "x"} and nodes["a/b"].path and not nodes["a/b"].leaf and nodes["a/b/c"].leaf and nodes["a"].parent is None


def test_trace_summaries(spark):
    rows = [("t", "a", None, "root", 5, 9, "Ok", "{}"), ("t", "b", " ", "first", 1, 20, "ERROR", None), ("t", "c", "a", "x", 0, 1, None, "{}"), ("u", "d", "gone", "y", 1, 2, "Ok", "{}")]
    spans = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, name string, start_time_unix_nano bigint, end_time_unix_nano bigint, status_code string, attributes_json string")
    got = trace_summaries(spans).collect()
    assert [(x.trace_id, x.started, x.ended, x.spans, x.errors, x.root_name) for x in got] == [("t", 0, 20, 3, 1, "first")]
    assert trace_summaries(spans.limit(0)).collect() == []
    served = spans.withColumn("attributes_json", F.when(F.col("span_id") != "c", F.lit('{"rows":1,"service.name":"kb-api"}')).otherwise('{"note":"kb-api"}'))
    assert [(x.trace_id, x.started, x.spans) for x in trace_summaries(served, " kb-api ").collect()] == [("t", 1, 2)] and trace_summaries(served, "kb").collect() == []
    found = lambda text: {x.span_id for x in filtered_spans(spans, text=text).collect()}
    assert found("A") == {"a", "c"} and found("GONE") == {"d"} and found("zzz") == set()
    counted = histogram(spans, "trace_id", F.lit(0.2)).filter("bound IS NULL OR bound = 0.1 OR bound = 0.25").filter("label = 't'").orderBy("bound").collect()
    assert [(x.bound, x.n) for x in counted] == [(None, 3), (0.1, 0), (0.25, 3)]


BLOCKED = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == "terrace.llm" or name.startswith("terrace.llm."):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as entry
names = entry.queries()
assert "p3_found" in names and not any(n.startswith(("p1", "p2", "p4")) for n in names) and set(entry.oracle_sql()) <= set(names)
"""


def test_the_core_runs_without_the_subpackage_for_training_text():
    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", BLOCKED], cwd=root, check=True, timeout=100)


def test_every_expected_result_has_its_query():
    root = Path(__file__).resolve().parent.parent
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=100)
