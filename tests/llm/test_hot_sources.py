"""One source with a third of all rows is spread over the partitions: none holds more than twice as many as the middle one."""

import statistics

import pytest
from pyspark.sql import functions as F

from bindery.llm import boilerplate as B
from bindery.llm.tokens import ranked


@pytest.fixture
def spread(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def check(df):
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2 * statistics.median(sizes), sizes

    yield check
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ranks(spark, spread):
    source = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 50).cast("string")))
    spread(ranked(spark.range(12_000).select(source.alias("s"), (F.col("id") % 40).alias("size"), "id"), ["s"], ["size"], ["id"]))


def test_hubs_of_one_source(spark, spread):
    """Pieces of a source's hubs, by which lines meet them, lie by their hashes and not by source."""
    hubs = spark.range(600).select(F.lit("hot").alias("source"), F.translate(F.sha2(F.col("id").cast("string"), 256), "0123456789", "ghijklmnop").alias("hub"), F.lit(9).alias("pages"))
    spread(B.hub_pieces(B.numbered(hubs)).repartition("piece"))
