from bindery.plans.session import settings


def test_settings(spark):
    small = settings(10**6, 8, 8 << 30, "file:///tmp/x")
    large = settings(10**14, 4000, 16000 << 30, "hdfs:///x")
    assert small["spark.sql.shuffle.partitions"] == "16" and int(large["spark.sql.shuffle.partitions"]) == 200_000
    for k in small:
        if k.startswith("spark.sql"):
            assert spark.conf.get(k) is not None
