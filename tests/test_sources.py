from terrace.plans.lineage import dropped, shared_folder, written
from terrace.sources.store import TABLES, conformed, ensured, schema
from terrace.sources.tables import table


def test_missing_tables_are_made_once(spark):
    folder = f"{shared_folder(spark)}/store"
    assert ensured(spark, folder) == list(TABLES) and ensured(spark, folder) == []
    assert table(spark, folder, "tags").schema.fieldNames() == schema("tags").fieldNames() and table(spark, folder, "tags").count() == 0


def test_rows_are_brought_to_the_store_s_columns(spark):
    df = spark.createDataFrame([("t", "x", "12"), ("u", None, "no")], "name string, other string, document_count string")
    assert [(r.name, r.document_count, r.topic_id) for r in conformed(df, "tags").orderBy("name").collect()] == [("t", 12, None), ("u", None, None)]


def test_written_tables_cut_lineage_and_can_be_dropped(spark):
    df = written(spark.range(10).selectExpr("id", "id % 3 AS k"), "test")
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
    files = df.inputFiles()
    dropped(df)
    assert files and written(spark.range(0), "none").count() == 0


def test_tables_of_few_row_groups_are_dealt_out(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = pa.table({"x": list(range(1000))})
    pq.write_table(rows, f"{tmp_path}/few.parquet")
    pq.write_table(rows, f"{tmp_path}/many.parquet", row_group_size=100)
    spark.range(3).write.parquet(f"{tmp_path}/files.parquet")
    spread = {n: "REPARTITION" in table(spark, str(tmp_path), n, spread=True)._jdf.queryExecution().executedPlan().toString() for n in ("few", "many", "files")}
    assert spread == {"few": True, "many": False, "files": False} and table(spark, str(tmp_path), "few", spread=True).count() == 1000
