"""Micro-batched writing and streaming aggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..operators import metrics as M
from ..sources.tables import blank

#: Within a micro-batch, operations are applied in this order.
ORDER = ("create", "update", "delete")


def batched(
    stream: DataFrame, write: Callable[[str, str, DataFrame, int], None], checkpoint: str, seconds: int | None = None, most: int = 0
) -> DataStreamWriter:
    """Write a stream of operations (columns ``collection`` and ``op``) batch by batch and group by group.

    ``write(collection, op, rows, batch_id)`` gets the rows of each group: creates first, then updates,
    then deletes. A batch may come again after a failure with the same id, so ``write`` must not mind
    repetition (a path named by the id, overwritten, does not). With ``seconds`` batches are made at
    that interval, else what is there is written and the query ends. With ``most`` a call gets so many rows at most, which suits
    services that take small requests: the rows of a group are numbered in one task then, so batches must be small too.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            groups = batch.select("collection", "op").distinct().collect()  # as many as there are collections
            for g in sorted(groups, key=lambda g: (ORDER.index(g["op"]) if g["op"] in ORDER else len(ORDER), g["collection"])):
                own = (F.col("collection") == g["collection"]) & (F.col("op") == g["op"])
                rows = batch.where(own)
                if not most:
                    write(g["collection"], g["op"], rows, batch_id)
                    continue
                order = Window.orderBy(*batch.columns)
                numbered = rows.withColumn("_slice", F.floor((F.row_number().over(order) - 1) / F.lit(most)))
                for i in range(-(-rows.count() // most)):
                    write(g["collection"], g["op"], numbered.where(F.col("_slice") == i).drop("_slice"), batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)


def flush(query: StreamingQuery) -> None:
    """Wait until all that had come when this was called is written."""
    query.processAllAvailable()


def stopped(query: StreamingQuery) -> None:
    """Write what is there, then stop; what comes later isn't taken any more."""
    if query.isActive:
        query.processAllAvailable()
        query.stop()


def once(stream: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """Each key once, however often it is delivered within ``late`` of its first time."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, time: str, width: str, late: str | None, *keys: str) -> DataFrame:
    """Calls and cost by event-time window and keys; a window is final when ``late`` has passed after it. Without ``late`` the
    watermark that the stream has already counts."""
    return (
        (stream.withWatermark(time, late) if late else stream)
        .groupBy(F.window(time, width), *[blank(k).alias(k) for k in keys])
        .agg(F.count("*").alias("calls"), M.exact_sum("cost_usd").alias("cost_usd"))
        .select(F.col("window.start").alias("window_start"), *keys, "calls", "cost_usd")
    )


def fresh(df: DataFrame, time: str, ttl: str, now) -> DataFrame:
    """Rows younger than a time to live."""
    return df.where(F.col(time) > F.lit(now).cast("timestamp") - F.expr(f"interval {ttl}"))
