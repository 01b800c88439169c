"""Mixing sources to target weights (p8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ranked


def rates(items: DataFrame, targets: DataFrame, source: str, size: str, total: float | None = None, seed: int = 7) -> DataFrame:
    """One row per listed source that has items: ``source, share, max_repeats, available, copies, offset``.

    Shares are scaled to one over the sources that exist. ``copies``, the expected copies of each item
    of the source, is share x total / available; without ``total``, the mix is made as large as the
    repeat limits allow at exactly these shares. A source given several times counts with the sum of
    its shares and its least limit; null or negative shares and limits count as 0. The result has a
    row per line of ``targets``, a list given by hand, and is worked out on the driver.
    """
    given = targets.groupBy("source").agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"),
        F.min(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"),
    )
    totals = items.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("available"))
    rows = [r for r in given.join(totals, "source").collect() if r["available"] and r["share"] > 0 and r["max_repeats"] > 0]
    scale = sum(r["share"] for r in rows)
    most = min((r["max_repeats"] * r["available"] * scale / r["share"] for r in rows), default=0.0)
    size_of_mix = most if total is None else total
    import xxhash

    out = []
    for r in sorted(rows, key=lambda r: r["source"]):
        copies = min(r["share"] / scale * size_of_mix / r["available"], float(r["max_repeats"]))
        offset = xxhash.xxh64_intdigest(r["source"].encode(), seed) / 2.0**64
        out.append((r["source"], r["share"] / scale, r["max_repeats"], r["available"], copies, offset))
    return items.sparkSession.createDataFrame(
        out, "source string, share double, max_repeats int, available long, copies double, offset double"
    )


def mix(items: DataFrame, chosen: DataFrame, source: str, size: str, ids: list[str], salts: int | None = None) -> DataFrame:
    """``repeats`` of each item of the mix, by systematic sampling at the rates of ``rates``.

    Items of a source stand in the order of their size. Each takes a stretch as long as its expected
    copies, the stretches lie end to end, and after one random offset an item is used once for each
    whole number its stretch crosses: its repeats are the expected copies rounded down or up, and each
    range of sizes gets its share. Items not used, of unlisted sources, or of no or null size, are left
    out. ``items`` is read twice and should be staged. Repeated rows are items of their own; columns
    with the names of the result's are replaced.
    """
    items = items.drop("repeats", "copies", "offset", "max_repeats", "rank", "_salt", "_offset", "_n")
    listed = items.where(F.col(size) > 0).join(chosen.select(F.col("source").alias(source)), source, "left_semi")
    placed = ranked(listed, [source], [size], ids, salts).join(
        chosen.select(F.col("source").alias(source), "copies", "offset", "max_repeats"), source
    )
    start = F.col("rank") * F.col("copies") + F.col("offset")
    repeats = F.floor(start + F.col("copies")) - F.floor(start)
    return (
        placed.withColumn("repeats", F.least(repeats, F.col("max_repeats")).cast("int"))
        .where("repeats > 0")
        .select(*items.columns, "repeats")
    )
