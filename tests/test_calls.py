"""Priorities, lists of jobs and calls, retries."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bindery.operators import calls as C

HIGH = ["metadata", "toc_finder", "toc_extract", "link_toc", "pattern_analysis", "classify_matter", "link_entry_3", "entry_a", "discover_1", "gap_1_2", "polish_x"]
NORMAL = ["ocr", "extract", "page_0001", "unknown", "", "lin", "link", None]


def test_priorities(spark, rows):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(HIGH + NORMAL)], "key string, at int")
    got = {r["at"]: (r["p"], r["b"]) for r in df.select("at", C.priority(F.col("key")).alias("p")).withColumn("b", C.band(F.col("p"))).collect()}
    assert [got[i] for i in range(len(got))] == [(20, "high")] * len(HIGH) + [(10, "normal")] * len(NORMAL)
    assert rows(spark.range(1).select(C.band(F.lit(9)))) == [("low",)]


def test_work_order(spark):
    units = [("j", "page_1", 1), ("j", "gap_1", 3), ("j", "page_0", 0), ("j", "metadata", 2), ("k", None, 5)]
    df = spark.createDataFrame(units, "job string, key string, seq int")
    got = {(r["job"], r["key"]): r["place"] for r in C.work_order(df, ["job"], "key", ["seq"]).collect()}
    assert got == {("j", "metadata"): 1, ("j", "gap_1"): 2, ("j", "page_0"): 3, ("j", "page_1"): 4, ("k", None): 1}


def test_job_list(spark):
    jobs = [("a", "failed", "x", "b", datetime(2025, 1, 2)), ("b", "failed", "y", "b", None), ("c", "running", "x", "c", datetime(2025, 1, 3)), ("d", "failed", "x", "c", datetime(2025, 1, 3))]
    df = spark.createDataFrame(jobs, "job_id string, status string, job_type string, book_id string, created_at timestamp")
    names = lambda **k: [r["job_id"] for r in C.job_list(df, **k).collect()]
    assert names() == ["c", "d", "a", "b"] and names(status="failed") == ["d", "a", "b"] and names(job_type="x", book_id="c", limit=1) == ["c"]


def test_agent_logs(spark):
    df = spark.createDataFrame([("toc_finder",), ("toc_extract",), ("chapter_finder",), (None,)], "agent_type string")
    assert C.agent_logs(df, "toc", "chapter_finder").count() == 2 and C.agent_logs(df, agent_type="chapter_finder").count() == 1
    assert C.agent_logs(df, "nothing").count() == C.agent_logs(df).count() == 4


def test_retries(spark):
    errors = {"status 503": True, "status 429 now": True, "context deadline exceeded": True, "unexpected EOF": True, "schema_validation": True, "status 400": False, "": False, None: False}
    df = spark.createDataFrame([(k,) for k in errors], "e string")
    assert {r["e"]: r["a"] for r in df.select("e", C.retriable(F.col("e")).alias("a")).collect()} == errors
    waits = spark.range(7).select(C.backoff_ms(F.col("id"), F.lit(500)).alias("w"), C.backoff_ms(F.col("id"), F.lit(5), F.lit(7)).alias("a")).collect()
    assert [r["w"] for r in waits] == [1500, 2500, 4500, 8500, 16500, 30500, 30500] and {r["a"] for r in waits} == {7}


def test_calls_by_anything(spark):
    rows = [(str(i), datetime(2025, 1, 1 + i), "b" if i % 2 else "c", "k", i % 3 == 0) for i in range(9)]
    df = spark.createDataFrame(rows, "id string, timestamp timestamp, book_id string, prompt_key string, success boolean")
    ids = lambda *a, **k: [r["id"] for r in C.matching_calls(df, *a, **k).collect()]
    assert ids("2025-01-02", "2025-01-05") == ["2", "3"] and ids(success=True) == ["0", "3", "6"] and ids(book_id="b", limit=2, offset=1) == ["3", "5"]
    assert len(ids(book_id="", prompt_key="k")) == 9
    with pytest.raises(ValueError):
        ids(stage="x")
