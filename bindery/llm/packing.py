"""Filling fixed-capacity containers (p7)."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ranked


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit over counts of lengths, longest first: slots and the number of containers.

    Containers that are filled alike are one group (remaining space, first number, how many), so the
    work depends on the number of different lengths, not of items. A slot row says: items of
    ``length`` with ranks from ``rank_from`` up to (not including) ``rank_to`` go to the containers
    from ``container_from`` on, ``per_container`` to each.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    spaces: list[int] = []  # sorted, without repetition
    groups: dict[int, list[tuple[int, int]]] = {}
    made = 0

    def keep(space: int, first: int, count: int) -> None:
        if not count or not space:
            return
        if space not in groups:
            insort(spaces, space)
            groups[space] = []
        groups[space].append((first, count))

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(spaces, length)
            if k == len(spaces):
                per = capacity // length
                for many, count in ((per, left // per), (left % per, 1)):
                    if many and count:
                        slots.append((length, rank, rank + many * count, made, many))
                        keep(capacity - many * length, made, count)
                        rank, made, left = rank + many * count, made + count, left - many * count
                continue
            space = spaces[k]
            first, count = groups[space].pop()
            if not groups[space]:
                del groups[space], spaces[k]
            per = min(space // length, left)
            use = min(count, left // per)
            slots.append((length, rank, rank + per * use, first, per))
            rank, left = rank + per * use, left - per * use
            keep(space - per * length, first, use)
            keep(space, first + use, count - use)
    return slots, made


def pack(items: DataFrame, size: str, ids: list[str], capacity: int = 2048, salts: int | None = None) -> DataFrame:
    """Put every item into a container: the columns of ``items`` plus ``part``, ``part_start``,
    ``part_size`` and ``container``.

    Items larger than ``capacity`` (and only those) are cut into parts of ``capacity`` and a rest.
    The histogram of part sizes, of at most ``capacity`` + 1 rows, is planned on the driver; parts
    take their slots by size and rank within the size. Items of size 0, or of null size (read as 0),
    take no space; they are spread over the containers. ``items`` is read several times and should be
    staged. Repeated rows are
    items of their own. Columns with the names of the result's are replaced. An empty table gives no
    rows.
    """
    items = items.drop("part", "part_start", "part_size", "container", "rank", "rank_from", "rank_to", "container_from", "per_container", "_salt", "_offset", "_n")
    length = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    count = F.greatest(F.ceil(length / F.lit(capacity)), F.lit(1)).cast("int")
    parts = items.select("*", F.explode(F.sequence(F.lit(1), count)).alias("part")).select(
        "*",
        ((F.col("part") - 1).cast("long") * capacity).alias("part_start"),
        F.least(F.lit(capacity), length - (F.col("part") - 1) * capacity).cast("long").alias("part_size"),
    )
    histogram = {r["part_size"]: r["n"] for r in parts.groupBy("part_size").agg(F.count("*").alias("n")).collect()}
    slots, made = plan(histogram, capacity)
    slots += [(0, 0, histogram[0], 0, -1)] if histogram.get(0) else []
    spark = items.sparkSession
    planned = spark.createDataFrame(
        slots, "part_size long, rank_from long, rank_to long, container_from long, per_container long"
    )
    places = ranked(parts, ["part_size"], [], [*ids, "part"], salts)
    taken = places.join(planned, "part_size").where("rank >= rank_from and rank < rank_to")
    return taken.select(
        *items.columns,
        "part",
        "part_start",
        "part_size",
        F.when(F.col("per_container") < 0, F.col("rank") % max(made, 1))
        .otherwise(F.col("container_from") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("per_container")))
        .cast("long")
        .alias("container"),
    )
