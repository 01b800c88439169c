"""Token counts and distributed ranks, shared by packing (p7) and mixing (p8)."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file, read once in each Python worker. The vocabulary is the public
    byte-level one with the pattern published beside it."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = DEFAULT_TOKENIZER) -> Column:
    """Tokens of a text; 0 for null and empty texts."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(path)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def default_salts(spark: SparkSession, least: int, share: int) -> int:
    """Buckets for a hot group: so many at least, and a share of the shuffle's partitions, so that a group
    with a third of all rows keeps a large cluster busy."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")) // share)


def ranked(df: DataFrame, groups: list[str], coarse: list[str], ids: list[str], salts: int | None = None) -> DataFrame:
    """``rank`` (from 0) of each row in its group, ordered by ``coarse`` and then by a hash of ``ids``.

    No task holds a group: rows are counted by group, coarse value and hash bucket (combined before
    the shuffle), the counts are summed up into offsets, and a row's rank is its bucket's offset plus
    its place in the bucket. The offsets of coarse values in a group come first, then those of buckets in a coarse value, so
    neither is as long as all buckets of a group. ``df`` is read twice and should be staged.
    """
    salts = salts or default_salts(df.sparkSession, 16, 4)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*ids), F.lit(salts)).cast("int"))
    bucket = [*groups, *coarse, "_salt"]
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy(*bucket).agg(F.count("*").alias("_n"))
    inner = upto(Window.partitionBy(*groups, *coarse).orderBy("_salt"))
    offsets = counts.select(*bucket, F.coalesce(F.sum("_n").over(inner), F.lit(0)).alias("_offset"))
    if coarse:
        outer = upto(Window.partitionBy(*groups).orderBy(*coarse))
        sums = counts.groupBy(*groups, *coarse).agg(F.sum("_n").alias("_n"))
        starts = sums.select(*groups, *coarse, F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_start"))
        offsets = offsets.join(starts, [*groups, *coarse]).withColumn("_offset", F.col("_offset") + F.col("_start")).drop("_start")
    place = F.row_number().over(Window.partitionBy(*bucket).orderBy(*ids))
    return (
        salted.join(offsets, bucket)
        .withColumn("rank", F.col("_offset") + place - 1)
        .drop("_salt", "_offset")
    )
