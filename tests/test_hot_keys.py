"""One entity with a third of all rows is spread over the partitions: none holds more than twice as many as the middle one."""

import statistics

import pytest
from pyspark.sql import functions as F

from bindery.operators import windows as W
from bindery.operators.intervals import runs_and_gaps


@pytest.fixture
def spread(spark):
    """Rows of a result in each partition, as the shuffles left them."""
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


def entities(spark, n=12_000):
    name = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("e"), (F.col("id") % 400).cast("string")))
    return spark.range(n).select(name.alias("e"), (F.col("id") * 10).alias("at"))


def test_intervals(spark, spread):
    df = entities(spark).withColumn("to", F.col("at") + 3)
    spread(runs_and_gaps(df, "e", "at", "to", 512))


def test_ranges_by_blocks(spark, spread):
    df = entities(spark)
    ranges = df.select("e", F.col("at").alias("a"), (F.col("at") + 5).alias("z"))
    spread(W.in_ranges(df, "at", ranges, "a", "z", ["e"]))


def test_running_sums_by_cells(spark, spread):
    df = entities(spark).withColumn("n", F.lit(1))
    spread(W.offsets(df, ["e"], ["at"], "n", F.floor(F.col("at") / 1000)))
