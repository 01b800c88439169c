from bindery.plans.chapter_queries import chapter_classify_lines


def test_whole_lines(spark, tmp_path):
    rows = [
        ("b:1", "e1", "The 100% Sea", 1, "chapter", 3, 9, 0, 200, " one two\n\nthree " + "x" * 200 + "\n"),
        ("b:2", "e2", None, None, None, 5, 5, None, 100, " \n"),
        ("b:3", "e3", "C", 2, "part", 7, None, 12, 300, "é" * 100),
    ]
    kinds = "unique_key string, entry_id string, title string, level int, level_name string, start_page int, end_page int, word_count int, sort_order int, mechanical_text string"
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "chapter.parquet"))
    got = {r["unique_key"]: r["prompt_line"] for r in chapter_classify_lines(spark, str(tmp_path)).collect()}
    assert got == {
        "b:2": '1. "" (page 5, level 0 , word_count 0) [id: e2]\n   text: [no text]',
        "b:1": '2. "The 100% Sea" (pages 3-9, level 1 chapter, word_count 4) [id: e1]\n   text: one two  three ' + "x" * 185 + "...",
        "b:3": '3. "C" (page 7, level 2 part, word_count 12) [id: e3]\n   text: ' + "é" * 100,
    }
