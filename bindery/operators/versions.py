"""Versions of records: replay of a change log, reading as of a time, merges and synchronisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import latest


def as_of(df: DataFrame, keys: list[str], version: str, at: Column, ties: list[str]) -> DataFrame:
    """The state of every key at a version: its latest row not after ``at``."""
    return latest(df.where(F.col(version) <= at), keys, [version, *ties])


def replay(log: DataFrame, keys: list[str], seq: str, op: str, fields: list[str]) -> DataFrame:
    """State after a log of operations ``upsert``, ``patch`` and ``delete`` in the order of ``seq``.

    An upsert sets all fields, a patch those that aren't null, a delete removes the row; a later
    upsert or patch makes it anew. Each field is its last value after the last upsert or delete, so one
    aggregation by key is enough, however many changes a key has.
    """
    s = F.col(seq)
    ends = log.groupBy(*keys).agg(F.max(F.when(F.col(op).isin("upsert", "delete"), s)).alias("_reset"), F.max_by(op, seq).alias("_last"))
    alive = log.join(ends, keys).where((F.col("_last") != "delete") & (F.col("_reset").isNull() | (s >= F.col("_reset"))) & (F.col(op) != "delete"))
    picks = [F.max_by(f, F.when((F.col(op) == "upsert") | F.col(f).isNotNull(), s)).alias(f) for f in fields]
    return alive.groupBy(*keys).agg(*picks)


def merge(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the rows of ``source`` put in: new keys are added, known ones take the new values
    where these aren't null. More than one source row for a key is an error."""
    fields = [c for c in target.columns if c not in keys]
    checked = source.groupBy(*keys).agg(
        *[F.first(f).alias(f"_{f}") for f in fields if f in source.columns],
        F.assert_true(F.count("*") == 1, F.lit("more than one row for a key")).alias("_ok"),
    )
    joined = target.join(checked, keys, "full").where(F.col("_ok").isNull())
    return joined.select(*keys, *[F.coalesce(f"_{f}", f).alias(f) if f in source.columns else F.col(f) for f in fields])


def overridden(defaults: DataFrame, overrides: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Defaults with overrides in their place, and ``is_override``."""
    o = overrides.select(*keys, F.col(text).alias("_o"), F.lit(True).alias("_is"))
    joined = defaults.join(o, keys, "left")
    return joined.withColumn(text, F.coalesce("_o", text)).withColumn("is_override", F.coalesce("_is", F.lit(False))).drop("_o", "_is")


def sync_action(stored: DataFrame, embedded: DataFrame, key: str) -> DataFrame:
    """What to do with each embedded text: ``insert`` if none is stored, ``skip`` if the stored one was
    edited (its digest isn't the one noted when it was stored), ``update`` if the embedded one is new, else
    ``none``."""
    e = embedded.select(key, F.col("text").alias("new"))
    joined = e.join(stored.select(key, "text", "digest"), key, "left")
    action = (
        F.when(F.col("text").isNull(), "insert")
        .when(F.sha2("text", 256) != F.col("digest"), "skip")
        .when(F.col("text") != F.col("new"), "update")
        .otherwise("none")
    )
    return joined.select(key, action.alias("action"))


def pivot_keys(df: DataFrame, name: str, value: str, prefix: str) -> DataFrame:
    """Entries ``prefix.item.field`` as ``item, field, value``; others, and those without a field, are left out."""
    rest = F.substring(F.col(name), F.lit(len(prefix) + 1), F.length(name))
    item, field = F.substring_index(rest, ".", 1), F.regexp_extract(rest, r"^[^.]+\.(.+)$", 1)
    return df.where(F.startswith(F.col(name), F.lit(prefix)) & (field != "")).select(item.alias("item"), field.alias("field"), F.col(value).alias("value"))
