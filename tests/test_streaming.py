from pyspark.sql import functions as F

from terrace.plans import extras
from terrace.plans.lineage import shared_folder
from terrace.streaming import jobs


def test_an_index_follows_its_documents(spark):
    folder = f"{shared_folder(spark)}/follow"
    now = F.timestamp_seconds("s")
    make = lambda *rows: spark.createDataFrame(rows, "id string, title string, content string, status string, s int").withColumn("updated_at", now).drop("s").coalesce(1)
    run = lambda: jobs.follow_documents(jobs.stream(spark, folder, "documents"), f"{folder}/index", f"{folder}/progress").awaitTermination()
    make(("a", "A", "# x\n\none", "cold", 1), ("b", "B", "two", "cold", 1), ("a", "A", "# x\n\nnewer", "cold", 2), ("h", "H", "hot", "hot", 1)).write.parquet(f"{folder}/documents.parquet")
    run()
    assert {(r.path, r.content) for r in jobs.current_index(spark, f"{folder}/index").collect()} == {("a/x", "#\n\nnewer"), ("b/B", "two")}
    make(("a", "A", "# y\n\nthree", "cold", 3), ("b", "B", "two", "hot", 3), ("c", "C", None, "cold", 3)).write.mode("append").parquet(f"{folder}/documents.parquet")
    run()
    assert {r.path for r in jobs.current_index(spark, f"{folder}/index").collect()} == {"a/y", "c/C"}


def test_spans_once_and_windows(spark):
    folder = f"{shared_folder(spark)}/spans"
    spans = spark.createDataFrame([("t", "a", 1), ("t", "a", 5), ("t", "b", 3), ("u", "a", 4)], "trace_id string, span_id string, s int").withColumn("created_at", F.timestamp_seconds("s"))
    spans.coalesce(1).write.parquet(f"{folder}/spans.parquet")
    jobs.run_to_table(jobs.arriving_spans(jobs.stream(spark, folder, "spans")), f"{folder}/out", f"{folder}/progress")
    assert {(r.trace_id, r.span_id) for r in spark.read.parquet(f"{folder}/out").collect()} == {("t", "a"), ("t", "b"), ("u", "a")} and spark.read.parquet(f"{folder}/out").count() == 3


def test_replays_do_not_depend_on_the_files_of_a_table(spark, tmp_path):
    """Thirty files, each of which covers all of the time, come in several batches."""
    spread = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.col("id") * 7919, F.lit(40_000)))
    columns = [F.col("id").alias("event_id"), (F.col("id") % 3).alias("user_id"), spread.alias("ts"), F.concat(F.lit("t"), F.col("id") % 2).alias("event_type")]
    rows = spark.range(600).select(*columns).unionByName(spark.createDataFrame([(700, 1, None, "t0")], "event_id bigint, user_id bigint, ts timestamp, event_type string"))
    folder = str(tmp_path)
    rows.repartition(30).write.parquet(f"{folder}/events.parquet")
    assert len(list((tmp_path / "events.parquet").glob("part-*"))) > 8
    hours = rows.filter("ts IS NOT NULL").groupBy(F.unix_micros(F.date_trunc("hour", "ts")).alias("start"), "event_type").count()
    got = sorted(map(tuple, extras.stream_usage(spark, folder).collect()))
    assert got == sorted(map(tuple, hours.collect())) and sum(n for _, _, n in got) == 600


def test_a_replay_takes_files_in_the_order_of_time(spark, tmp_path):
    rows = spark.range(100).select("id", F.timestamp_seconds(F.pmod(F.col("id") * 37, F.lit(100))).alias("ts"))
    rows.repartition(12).write.parquet(f"{tmp_path}/calls.parquet")
    seen = []
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else ranges as small as these are put together
    try:
        source = jobs.replay(spark, str(tmp_path), "calls", "ts", f"{tmp_path}/copy", close="1 hour", files=1)
        note = lambda batch, _: seen.append(sorted(r.ts for r in batch.collect()))
        source.writeStream.foreachBatch(note).option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(seen) > 3 and sum(map(len, seen)) == 101 and all(a[-1] < b[0] for a, b in zip(seen, seen[1:]))
