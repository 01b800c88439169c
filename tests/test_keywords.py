from pyspark.sql import functions as F

from bindery.operators import pages as P


def test_each_pattern_by_itself(spark):
    text = "Table of Contents\nChapter IV\nsee Chapter V and part ii\nPART XX\nChapter 12a"
    hit = spark.range(1).select(P.keyword_hits(F.lit(text)).alias("h")).first()["h"]
    assert {h["category"]: list(h["keywords"]) for h in hit} == {
        "toc": ["Contents", "Table of Contents"],
        "structure": ["Chapter 12", "Chapter IV", "PART XX"],
    }
