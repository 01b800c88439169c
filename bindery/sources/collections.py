"""Collections kept as Parquet: rows are added in place, changed and removed by writing the collection anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.versions import merge


def create(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Add rows to a collection, which is made if there is none; returns them as they were given, so that callers may tell which
    of theirs they are. Each needs a ``_docid`` of its own; that none is taken yet isn't looked up."""
    df.write.mode("append").parquet(f"{folder}/{name}.parquet")
    return df


def changed(spark: SparkSession, folder: str, name: str, changes: DataFrame | None, gone: DataFrame | None, into: str) -> DataFrame:
    """Write a collection anew into the folder ``into``: ``changes(_docid, …)`` put in as ``merge`` does, the rows of ``gone(_docid)`` left out.
    Readers of the old folder aren't disturbed; executors that are lost leave no half-changed collection behind."""
    if into.rstrip("/") == folder.rstrip("/"):
        raise ValueError("a collection can't be written over while it is read")
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    df = df if changes is None else merge(df, changes, ["_docid"]).select(*df.columns)
    df = df if gone is None else df.join(gone.select("_docid").distinct(), "_docid", "left_anti").select(*[F.col(c) for c in df.columns])
    df.write.mode("overwrite").parquet(f"{into}/{name}.parquet")
    return spark.read.parquet(f"{into}/{name}.parquet")
