"""Endpoints name queries; streams are flushed and drained; refusals empty the bucket."""

import __spark_entry__ as entry
from bindery.plans.endpoints import ENDPOINTS
from bindery.streaming import sinks as S
from bindery.streaming.limits import rate_limited


def test_endpoints_name_queries():
    known = {name for m in entry.CORE for name in m.QUERIES}
    assert {n for names in ENDPOINTS.values() for n in names} <= known


def test_flush_and_stop(spark, tmp_path):
    schema = "collection string, op string, id int"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([("book", "update", 1), ("book", "create", 2)])
    seen = []
    query = S.batched(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda c, op, rows, n: seen.extend((op, r["id"]) for r in rows.collect()), str(tmp_path / "state"), 1).start()
    S.flush(query)
    assert seen == [("create", 2), ("update", 1)]
    put([("book", "delete", 3)])
    S.stopped(query)
    S.stopped(query)
    assert seen[2:] == [("delete", 3)] and not query.isActive


def test_refusals(spark, tmp_path):
    rows = [("k", f"2025-01-01 00:00:00.00{n}", n == 1) for n in range(3)]
    df = spark.createDataFrame(rows, "key string, at string, refused boolean").selectExpr("key", "cast(at as timestamp) as at", "refused")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for column, last in (("refused", 0.332), (None, 0.0)):
        name = f"limited_{column}"
        q = rate_limited(stream, "key", "at", 3.0, column).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        got = [r["delay_seconds"] for r in spark.sql(f"select * from {name} order by at").collect()]
        assert got[:2] == [0.0, 0.0] and abs(got[2] - last) < 0.002


def test_small_requests(spark, tmp_path):
    rows = [("book", "create", n) for n in range(7)] + [("book", "delete", 9)]
    spark.createDataFrame(rows, "collection string, op string, id int").coalesce(1).write.parquet(str(tmp_path / "in"))
    calls = []
    stream = spark.readStream.schema("collection string, op string, id int").parquet(str(tmp_path / "in"))
    S.batched(stream, lambda c, op, df, n: calls.append((op, sorted(r["id"] for r in df.collect()))), str(tmp_path / "state"), most=3).start().awaitTermination()
    assert calls == [("create", [0, 1, 2]), ("create", [3, 4, 5]), ("create", [6]), ("delete", [9])]


def test_settings_are_read_again(tmp_path):
    import os

    from bindery.sources.files import Watched

    path = tmp_path / "s.json"
    path.write_text('{"a": "${X}"}')
    watched = Watched(str(path), {"X": "1"})
    assert watched.get() == {"a": "1"}
    path.write_text('{"a": 2}')
    os.utime(path, ns=(1, 1))
    assert watched.get() == {"a": 2}
    path.unlink()
    assert watched.get() == {"a": 2}


def test_collections(spark, tmp_path):
    import pytest

    from bindery.sources import collections as C

    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    rows = lambda *x: spark.createDataFrame(list(x), "_docid string, title string, n int")
    C.create(rows(("a", "A", 1)), old, "book")
    assert C.create(rows(("b", "B", 2), ("c", None, None)), old, "book").count() == 2
    changes = spark.createDataFrame([("a", "Z"), ("d", "D")], "_docid string, title string")
    got = C.changed(spark, old, "book", changes, rows(("b", "", 0)), new)
    assert sorted(map(tuple, got.collect())) == [("a", "Z", 1), ("c", None, None), ("d", "D", None)]
    assert C.changed(spark, old, "book", None, None, new + "2").count() == 3
    with pytest.raises(ValueError):
        C.changed(spark, old, "book", None, None, old + "/")
