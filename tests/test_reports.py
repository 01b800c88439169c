"""Reports of searches, and checks of JSON against a schema."""

from pyspark.sql import functions as F

from bindery.functions import json as J
from bindery.operators import reports as R


def frames(spark):
    text = {1: "Table of Contents", 2: "Chapter 1\nChapter 2", 4: "Chapter 3", 6: "Part IV", 7: None, 8: "Preface"} | {n: "Notes" for n in range(10, 17)}
    pages = [("b", n, text.get(n, ""), 60) for n in range(1, 55)] + [("c", 1, "nothing", 2), ("d", 1, "Preface", 3), ("d", 2, "Index", 3), ("d", 3, "Chapter 9", 3)]
    books = [("b", 60), ("c", 2), ("d", 3), ("e", 0)]
    return spark.createDataFrame(books, "book_id string, page_count int"), spark.createDataFrame(pages, "book_id string, page_num int, ocr_markdown string, page_count int")


def test_keyword_report(spark):
    b, p = frames(spark)
    report = R.keyword_report(b, p, R.keyword_pages(p))
    got = {r["book_id"]: r for r in report.collect()}
    assert (got["b"]["searched"], got["b"]["with_data"], got["b"]["failed"], got["b"]["toc"], got["b"]["structure"]) == (50, 49, [7], [1], [2, 4, 6])
    assert [tuple(x) for x in got["b"]["clusters"]] == [(2, 6, 3)] and got["b"]["back_matter"] == list(range(10, 17)) and got["e"]["failed"] == []
    said = {r["book_id"]: r["summary"] for r in R.keyword_summary(report).collect()}
    assert said["b"] == """Searched: 1-50 (49 pages with OCR data)

⚠️  WARNING: 1 pages missing OCR data: [7]
   These pages could not be searched - ToC might be on an unsearched page!

✓ TOC KEYWORDS: pages [1]
  → Check these pages first (direct ToC indicators)

✓ STRUCTURE CLUSTERING: 1 cluster(s) found
  → Pages 2-6 (3 pages)
  Note: Dense clustering of Chapter/Part = likely ToC listing

• Front matter: pages [8]

• Back matter: pages [10 11 12 13 14]
  (+2 more)

RECOMMENDATION:
  Start with TOC keyword pages"""
    assert said["c"].endswith("No keywords found in searchable pages.\nConsider visually checking failed pages - they may contain ToC.")
    assert said["d"].endswith("scattered across 1 pages (not clustered)\n\n• Front matter: pages [1]\n\n• Back matter: pages [2]\n\nRECOMMENDATION:")


def test_search_report(spark):
    m = spark.createDataFrame([("b", n, 2) for n in (1, 4, 8, 20, 21)] + [("c", 5, 1), ("d", 9, 1)], "book_id string, page_num int, matches int")
    x = spark.createDataFrame([("b", 20, 20), ("c", 1, 9)], "book_id string, start_page int, end_page int")
    got = {r["book_id"]: r for r in R.search_report(m, x).collect()}
    assert (got["b"]["pages"], got["b"]["matches"], got["b"]["excluded"], got["b"]["clusters"]) == (5, 10, 1, 1)
    assert got["b"]["summary"] == "CLUSTERS DETECTED: 1 dense cluster(s)\n  → Pages 1-4 (2 pages) - first page is likely chapter start\n\n⚠️ NOTE: 1 of 5 matches are in EXCLUDED ranges (back matter) - ignore those"
    assert got["c"]["summary"].endswith("All matches are in excluded ranges. Try different query variations.\n\nSingle match is in excluded range - likely not the chapter start")
    assert got["d"]["summary"] == "\nSingle isolated match - verify with OCR/vision" and got["d"]["message"] == "Found 1 matches across 1 pages"


def test_schema(spark):
    schema = {"type": "json_schema", "json_schema": {"schema": {"type": "object", "required": ["a"], "properties": {"a": {"type": "string", "enum": ["x", "y"]}, "b": {"type": ["integer", "null"]}, "c": {"type": "object", "properties": {"d": {"type": "boolean"}}}}}}}
    cases = {'{"a":"x"}': "", '{"a":"z"}': "$.a: not listed", '{"b":1}': "$.a: missing", "[1]": "$: not object", "oops": "no JSON", '{"a":"y","b":null}': "", '{"a":"y","b":1.5}': "$.b: not integer or null", '{"a":"x","c":{"d":1}}': "$.c.d: not boolean", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "j string")
    assert {r["j"]: r["f"] for r in df.select("j", J.schema_fault(F.col("j"), schema).alias("f")).collect()} == cases
