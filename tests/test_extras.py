from terrace.plans import extras


def test_excerpts_are_cut_at_3500_bytes_on_whole_characters(spark, tmp_path):
    texts = ["a" * 3500, "b" * 3501, "字" * 1200, None]
    rows = [(f"c{k}", "d", f"t{k}", f"d/{k}", x, k) for k, x in enumerate(texts)]
    spark.createDataFrame(rows, "id string, document_id string, title string, path string, content string, created_at int").write.parquet(f"{tmp_path}/chapters.parquet")
    spark.createDataFrame([("d", "hot", 3.7)], "id string, status string, hot_score double").write.parquet(f"{tmp_path}/documents.parquet")
    more = "\n…(truncated)"
    want = ["a" * 3500, "b" * 3500 + more, "字" * 1166 + more, ""]
    entries = [f"\n### Reference [^{k + 1}^]\nTitle: t{k}\nDocument ID: d\nPath: d/{k}\nDocument status: hot\nRelevance (0-1): 1.0000\nExcerpt:\n{x}\n" for k, x in enumerate(want)]
    assert extras.build_reference_block(spark, str(tmp_path)).first().block == "--- References ---\n" + "".join(entries)


def test_every_chapter_has_a_path_long_titles_too(spark, tmp_path):
    titles = ["short", "字" * 40, None, "x" * 101]
    rows = [(f"c{k}", "d", x, k) for k, x in enumerate(titles)]
    spark.createDataFrame(rows, "id string, document_id string, title string, created_at int").write.parquet(f"{tmp_path}/chapters.parquet")
    got = {x.path for x in extras.materialize_path(spark, str(tmp_path)).collect()}
    assert got == {"d/short", "d/" + "字" * 33, "d/chapter/3", "d/" + "x" * 100}
