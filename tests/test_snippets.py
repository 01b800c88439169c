from bindery.plans.report_queries import grep_snippets


def test_contexts_may_overlap(spark, tmp_path):
    near = "a harbour, a Harbour; " + "x" * 60 + " HARBOUR harbour"
    rows = [("p", "b", 1, near), ("q", "b", 2, "no port"), ("r", "b", 3, None), ("s", "b", 4, "é\n" * 60 + "harbour")]
    spark.createDataFrame(rows, "_docid string, book_id string, page_num int, ocr_markdown string").write.parquet(str(tmp_path / "page.parquet"))
    got = {(r["_docid"], r["n"]): r["snippet"] for r in grep_snippets(spark, str(tmp_path)).collect()}
    assert got == {
        ("p", 0): "..." + near[: 9 + 50] + "...",
        ("p", 1): "..." + near[: 20 + 50] + "...",
        ("p", 2): "..." + near[83 - 50 :].strip() + "...",
        ("s", 0): "..." + "é " * 25 + "harbour...",
    }
