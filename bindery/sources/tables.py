"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One table of a folder, narrowed to the named columns so that the scan reads no others."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def metrics(spark: SparkSession, folder: str, where=None) -> DataFrame:
    """The call log, or what of it meets a condition, with each delivered call counted once.

    Calls delivered twice are identical, so any of the copies stands for both, and a condition may be put
    before they are told apart, where it reaches the scan. NULL and zero mean the same in the log
    (writers leave zeros out), which is why readers of numbers use ``zero``.
    """
    log = table(spark, folder, "metric")
    return (log if where is None else log.where(where)).dropDuplicates(["_docid"])


def zero(name: str):
    """A number of the log, with the zeros that writers leave out put back."""
    return F.coalesce(F.col(name), F.lit(0))


def blank(name: str):
    """A string of the log, with NULL read as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))
