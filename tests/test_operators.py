import json
import random
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from bindery.operators import metrics as M
from bindery.operators import pages as P
from bindery.operators import versions as V
from bindery.operators import windows as W
from bindery.operators.query import Query, by_id, valid_id
from bindery.sources import files, sinks
from bindery.streaming import sinks as S
from bindery.streaming.limits import rate_limited

CALL = "cost_usd double, total_tokens int, prompt_tokens int, completion_tokens int, reasoning_tokens int, total_seconds double, success boolean, stage string, provider string"


def test_details_ignore_calls_without_time(spark):
    df = spark.createDataFrame([(0.1, 5, 1, 1, None, t, s, "ocr", "p") for t, s in ((0.0, True), (2.0, None), (4.0, True), (None, False))], CALL)
    r = M.details(df, F.col("stage")).first()
    assert (r["count"], r["success_count"], r["error_count"]) == (4, 2, 2)
    assert (r["latency_min"], r["latency_avg"], r["latency_p50"], r["latency_p95"]) == (2.0, 3.0, 3.0, 3.9)
    assert r["total_cost_usd"] == 0.4 and r["avg_tokens"] == 5.0
    still = M.details(df.withColumn("total_seconds", F.lit(None).cast("double")), F.col("stage")).first()
    assert still["latency_p99"] == still["latency_max"] == 0
    assert M.details(df.limit(0), F.col("stage")).count() == 0
    assert df.limit(0).agg(*M.summary()).first()["avg_cost_usd"] == 0


@pytest.mark.parametrize("seed", range(3))
def test_percentiles_are_exact(spark, seed):
    r = random.Random(seed)
    data = [(r.choice("aaab"), r.choice([0.0, -1.0, 0.5, 2.0, round(r.lognormvariate(0, 3), 3), None])) for _ in range(3000)] + [("one", 7.0), ("none", 0.0)]
    df = spark.createDataFrame(data, "k string, x double")
    probs = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    want = df.where("x > 0").groupBy("k").agg(*[F.percentile("x", F.lit(p)).alias(f"p{i}") for i, p in enumerate(probs)])
    got = {x["k"]: tuple(x)[1:] for x in M.percentiles(df, ["k"], "x", probs).collect()}
    assert {x["k"]: pytest.approx(tuple(x)[1:]) for x in want.collect()} == got


def test_stage_keys_and_filters(spark, rows):
    df = spark.createDataFrame([("ocr", "m"), ("ocr", ""), ("", "x"), ("toc", "y"), ("ocr", None)], "stage string, provider string")
    assert rows(df.select(M.stage_key())) == [("",), ("ocr",), ("ocr",), ("ocr:m",), ("toc",)]
    with pytest.raises(ValueError):
        M.matching(df, nothing="x")


def test_skeleton_and_parents(spark, rows):
    df = spark.createDataFrame([("b", 1, 5), ("b", 2, 5), ("b", 3, 9)], "g string, o int, s int")
    got = W.skeleton(df, "g", ["o"], F.col("s"), F.lit(12)).select("entry", "end")
    assert rows(got) == [("ch_001", 5), ("ch_002", 8), ("ch_003", 12)]
    levels = [1, 2, 3, 2, 1, 3, 2, 3]
    df = spark.createDataFrame([("b", i, v, str(i)) for i, v in enumerate(levels, 1)], "g string, o int, l int, e string")
    got = {r["o"]: r["parent"] for r in W.parent_by_level(df, "g", ["o"], "l", "e").collect()}
    assert [got[i] for i in range(1, 9)] == [None, "1", "2", "1", None, None, "5", "7"]


def test_gaps_islands_offsets(spark, rows):
    df = spark.createDataFrame([("b", p) for p in (10, 26, 41, None)], "g string, p int")
    assert rows(W.gaps(df, "g", "p", F.lit(10), F.lit(60))) == [("b", 11, 25, 15), ("b", 42, 60, 19)]
    df = spark.createDataFrame([("b", p) for p in (1, 4, 8, 20, 21, 21)], "g string, p int")
    assert rows(W.islands(df, ["g"], "p", 3, 2)) == [("b", 1, 4, 2), ("b", 20, 21, 2)]
    df = spark.createDataFrame([("b", p) for p in (1, 3, 5, 9)], "g string, p int")
    assert rows(W.islands(df, ["g"], "p", 2, 3)) == [("b", 1, 5, 3)]
    df = spark.createDataFrame([("c", 1, 10), ("c", 2, 20), ("c", 3, 5), ("c", 4, None)], "c string, i int, d int")
    for cell in (None, F.floor(F.col("i") / 2), F.lit(None).cast("int")):
        assert [r["offset"] for r in W.offsets(df, ["c"], ["i"], "d", cell).orderBy("i").collect()] == [0, 10, 30, 35]


def test_merged_text(spark):
    def merge(*texts):
        df = spark.createDataFrame([("k", i, t) for i, t in enumerate(texts)], "k string, i int, t string")
        got = P.merged_text(df, ["k"], "i", "t").collect()
        return got[0]["merged"] if got else None

    assert merge("exam-", "ple") == "example" and merge("End.", "Next") == "End.\n\nNext" and merge("mid", "dle") == "mid dle"
    assert merge("exam-", " ", None, "ple") == "example" and merge(None, "") is None and merge("cut-") == "cut-"


def test_priority_and_keywords(spark, rows):
    df = spark.createDataFrame([("p", "b", "B"), ("p", "a", ""), ("q", "c", "C"), ("q", "a", None), ("q", "d", "D")], "k string, s string, t string")
    assert rows(P.by_priority(df, "k", "s", "t", ["a", "b"])) == [("p", "b", "B"), ("q", "c", "C")]
    hit = spark.range(1).select(P.keyword_hits(F.lit("A PREFACE, éChapter 1 and Chapter 2é. Contents")).alias("h")).first()["h"]
    assert {h["category"]: list(h["keywords"]) for h in hit} == {"toc": ["Contents"], "front_matter": ["PREFACE"], "structure": ["Chapter 1", "Chapter 2"]}


def test_versions(spark, rows):
    log = spark.createDataFrame(
        [("a", 1, "upsert", 1, 1), ("a", 2, "patch", 2, None), ("b", 1, "upsert", 1, 1), ("b", 2, "delete", None, None), ("b", 3, "patch", None, 7), ("c", 1, "upsert", 1, 1), ("c", 2, "upsert", None, 3), ("d", 1, "delete", None, None)],
        "k string, n int, op string, x int, y int",
    )
    assert rows(V.replay(log.where("not (k = 'b' and n = 3)"), ["k"], "n", "op", ["x", "y"])) == [("a", 2, 1), ("c", None, 3)]
    assert ("b", None, 7) in rows(V.replay(log, ["k"], "n", "op", ["x", "y"]))
    old = spark.createDataFrame([("1", "Old", 5), ("2", "Keep", None)], "k string, t string, n int")
    new = spark.createDataFrame([("1", "New"), ("3", "Add")], "k string, t string")
    assert rows(V.merge(old, new, ["k"])) == [("1", "New", 5), ("2", "Keep", None), ("3", "Add", None)]
    with pytest.raises(Exception, match="more than one row"):
        V.merge(old, new.unionAll(new), ["k"]).collect()
    digest = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    stored = spark.createDataFrame([("u", "", digest), ("n", "", digest), ("s", "edited", digest)], "k string, text string, digest string")
    made = spark.createDataFrame([("i", "x"), ("u", "x"), ("n", ""), ("s", "x")], "k string, text string")
    assert rows(V.sync_action(stored, made, "k")) == [("i", "insert"), ("n", "none"), ("s", "skip"), ("u", "update")]
    conf = spark.createDataFrame([("p.ocr.m.type", "1"), ("p.ocr.m.a.b", "2"), ("p.llm.x.type", "3"), ("p.ocr.none", "4")], "name string, v string")
    assert rows(V.pivot_keys(conf, "name", "v", "p.ocr.")) == [("m", "a.b", "2"), ("m", "type", "1")]


def test_builder(spark, data):
    assert valid_id("a-B_9") and not valid_id("") and not valid_id("a b") and not valid_id("x" * 501)
    q = Query("book").filter_gte("page_count", 24).fields("_docid", "page_count").order_by("page_count", True).limit(3)
    got = [r["page_count"] for r in q.build(spark, data).collect()]
    assert len(got) == 3 and got == sorted(got, reverse=True)
    assert Query("book").build(spark, data).columns == ["_docid"]
    assert q.offset(1).build(spark, data).first()["page_count"] == got[1]
    with pytest.raises(ValueError):
        by_id(spark, data, "book", "a/b")
    assert by_id(spark, data, "book", "bk-none").count() == 0


def test_files(spark, tmp_path, rows):
    for n in ("book-10.pdf", "book-2.pdf", "book.pdf"):
        (tmp_path / n).write_bytes(b"x")
    got = files.originals(spark, str(tmp_path)).orderBy("place").collect()
    assert [r["path"].rsplit("/")[-1] for r in got] == ["book.pdf", "book-2.pdf", "book-10.pdf"]
    ranges = files.page_ranges(files.originals(spark, str(tmp_path)).withColumn("page_count", F.lit(10)))
    assert rows(ranges.select("place", "first_page", "last_page")) == [(1, 1, 10), (2, 11, 20), (3, 21, 30)]
    (tmp_path / "a.tmpl").write_text("Hi {{ .Name }}")
    t = files.templates(spark, str(tmp_path)).first()
    assert (t["key"], list(t["variables"]), len(t["digest"])) == ("a", ["Name"], 64)
    (tmp_path / "s.json").write_text(json.dumps({"key": "${K}", "n": [1, "${NO}x"]}))
    assert files.settings(str(tmp_path / "s.json"), {"K": "v"}) == {"key": "v", "n": [1, "x"]}
    df = spark.createDataFrame([("p", "a data:image/png;base64,aGk= b")], "k string, t string")
    assert rows(files.inline_images(df, "k", "t")) == [("p", 0, "png", bytearray(b"hi"))]


def test_epub():
    parts = [
        {"id": "c1", "title": "One & two", "body": "<p>x</p>", "level": 1, "level_name": "part", "segments": [{"paragraph_idx": 0, "start_offset_ms": 0, "duration_ms": 1500}, {"paragraph_idx": 1, "start_offset_ms": 1500, "duration_ms": 60_000}], "audio": b"mp3"},
        {"id": "c2", "title": "Below", "body": "<p>y</p>", "level": 2, "level_name": "chapter"},
        {"id": "c3", "title": None, "body": "<p>z</p>", "level": 1, "level_name": "chapter"},
    ]
    made = lambda: sinks.epub("T<", "A", "id", parts, "de", "2025-01-02T03:04:05Z", "N", b"jpg")
    data = made()
    z = zipfile.ZipFile(BytesIO(data))
    assert z.namelist()[0] == "mimetype" and z.read("mimetype") == b"application/epub+zip" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    opf, nav, overlay = (z.read(f"OEBPS/{n}").decode() for n in ("content.opf", "nav.xhtml", "c1.smil"))
    assert "<dc:title>T&lt;</dc:title>" in opf and "<dc:language>de</dc:language>" in opf and '<meta property="dcterms:modified">2025-01-02T03:04:05Z</meta>' in opf
    assert '<meta property="media:duration">00:01:01.500</meta>' in opf and "media:narrator" in opf and 'media-overlay="c1_smil"' in opf and "cover-image" in opf
    assert '<li><a href="c1.xhtml">One &amp; two</a><ol><li><a href="c2.xhtml">Below</a></li></ol></li><li><a href="c3.xhtml"></a></li>' in nav
    assert '<text src="c1.xhtml#p1"/><audio src="c1.mp3" clipBegin="1.500s" clipEnd="61.500s"/>' in overlay and z.read("OEBPS/c1.mp3") == b"mp3"
    plain = zipfile.ZipFile(BytesIO(sinks.epub("T", "A", "id", parts[1:]))).read("OEBPS/content.opf").decode()
    assert "<dc:language>en</dc:language>" in plain and "media:" not in plain
    assert data == made()



def test_batched_sink(spark, tmp_path, rows):
    schema = "collection string, op string, id int"
    spark.createDataFrame([("m", "delete", 1), ("m", "create", 1), ("b", "create", 2), ("m", "update", 3)], schema).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = S.batched(stream, lambda c, op, df, n: seen.append((op, c, df.count())), str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert seen == [("create", "b", 1), ("create", "m", 1), ("update", "m", 1), ("delete", "m", 1)]


def test_once_and_limits(spark, tmp_path, rows):
    schema = "k string, t timestamp"
    spark.sql("select 'a' as k, timestamp'2025-01-01 00:00:00' + make_interval(0,0,0,0,0,0,i div 2) as t from range(6) r(i)").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = S.once(stream, "k", "t").writeStream.format("memory").queryName("once_out").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once_out").count() == 1
    q = rate_limited(stream, "k", "t", 1.0).writeStream.format("memory").queryName("rate_out").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["delay_seconds"] for r in spark.table("rate_out").collect()) == [0.0, 1.0, 1.0, 2.0, 2.0, 3.0]
