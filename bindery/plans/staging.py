"""Cutting lineage with tables written to the cluster's shared folder."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_kept_for: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset, a temporary folder is set for local masters (tests); on a cluster that is an
    error, since executors on other machines couldn't read a folder of this one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="bindery-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the engine has them."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, which goes when the application ends."""
    path = f"{shared_folder(spark)}/bindery/{spark.sparkContext.applicationId}"
    if path not in _kept_for:
        files, at = _files(spark, path)
        files.mkdirs(at)
        files.deleteOnExit(at)
        _kept_for.add(path)
    return path


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the result no longer depends on its inputs,
    so losing an executor later recomputes nothing before this point, and loops keep short plans."""
    return _staged(df, df)


def _staged(df: DataFrame, written: DataFrame) -> DataFrame:
    path = f"{own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    written.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def counted(df: DataFrame, **counts) -> tuple[DataFrame, dict[str, int]]:
    """``staged``, and the values of some aggregates over its rows, by name, worked out in the same job. Each
    must be null or 0 for a table without rows."""
    seen = Observation()
    out = _staged(df, df.observe(seen, *[c.alias(k) for k, c in (counts or {"rows": F.count(F.lit(1))}).items()]))
    return out, {k: v or 0 for k, v in seen.get.items()}


def dropped(*frames: DataFrame) -> None:
    """Delete staged tables that nothing will read any more."""
    for df in frames:
        if path := getattr(df, "_staged_at", None):
            files, at = _files(df.sparkSession, path)
            files.delete(at, True)


def once(spark: SparkSession, name: str, made_from: bytes, make: Callable[[], bytes]) -> bytes:
    """What ``make`` gives, made once for each ``name`` and input in an application and kept in its part of the shared folder."""
    path = f"{own_folder(spark)}/once-{hashlib.sha256(name.encode() + b'|' + made_from).hexdigest()}"
    files, at = _files(spark, path + "/_SUCCESS")
    if files.exists(at):
        return bytes(spark.read.parquet(path).first()["data"])
    data = make()
    spark.createDataFrame([(bytearray(data),)], "data binary").coalesce(1).write.mode("overwrite").parquet(path)
    return data
