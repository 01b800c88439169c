"""Overlapping, nested and gapped intervals, by run bitmaps per entity and shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs_and_gaps(df: DataFrame, entity: str, start: str, end: str, shard_units: int = 1 << 20) -> DataFrame:
    """Maximal covered runs and the gaps between them, for each entity.

    Units are integers and both bounds are inclusive; runs that touch are one run. The line of units
    is cut into shards of ``shard_units``, and each shard's bitmap is kept as its runs. An interval sets a run of bits in
    the first and the last shard it meets; whole shards between them stay one long run, so an interval costs at most three
    rows however long it is. Runs with the same first bit are reduced to the longest before the shuffle, so a
    shard holds at most ``shard_units`` of them. They are united shard by shard; what a shard needs from those before it is
    how far they reach, and from those after it how far their first new run is from all before: one row a shard. So
    no task holds an entity, but for its rows of one shard and one row for each of its shards.

    Returns ``entity, kind, start, end`` named ``entity, kind, run_start, run_end`` with kind
    ``period`` or ``gap``. Rows with a null entity or bound, or whose end is before the start, cover
    nothing. Repeated rows, ties and columns besides the three named ones change nothing; an empty
    table gives no rows.
    """
    e, s, t = F.col(entity), F.col(start).cast("long"), F.col(end).cast("long")
    size = F.lit(shard_units).cast("long")
    base = df.select(e.alias("entity"), s.alias("s"), t.alias("t")).where(
        F.col("entity").isNotNull() & F.col("s").isNotNull() & (F.col("t") >= F.col("s"))
    )
    first, last = (F.expr(f"({c} - pmod({c}, {shard_units})) div {shard_units}") for c in "st")
    run = lambda shard, lo, hi: F.struct(shard.alias("shard"), lo.alias("lo"), hi.alias("hi"))
    left, right = run(first, F.col("s"), (first + 1) * size - 1), run(last, last * size, F.col("t"))
    middle = run(first + 1, (first + 1) * size, last * size - 1)
    pieces = (
        F.when(first == last, F.array(run(first, F.col("s"), F.col("t"))))
        .when(last == first + 1, F.array(left, right))
        .otherwise(F.array(left, right, middle))
    )
    bits = (
        base.select("entity", F.explode(pieces).alias("r"))
        .select("entity", "r.*")
        .groupBy("entity", "shard", "lo")
        .agg(F.max("hi").alias("hi"))
    )
    shard, shards = Window.partitionBy("entity", "shard").orderBy("lo"), Window.partitionBy("entity").orderBy("shard")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    reach = bits.groupBy("entity", "shard").agg(F.max("hi").alias("top")).select(
        "entity", "shard", F.max("top").over(earlier(shards)).alias("carried"), F.max("top").over(Window.partitionBy("entity")).alias("end")
    )
    placed = bits.select("entity", "shard", "lo", F.max("hi").over(earlier(shard)).alias("inside")).join(reach, ["entity", "shard"])
    before = F.greatest("inside", "carried")
    begins = placed.select("entity", "shard", "lo", before.alias("before"), "end").where("before is null or lo > before + 1")
    following = begins.groupBy("entity", "shard").agg(F.min_by("before", "lo").alias("first")).select(
        "entity", "shard", F.lead("first").over(shards).alias("next")
    )
    ends = F.coalesce(F.lead("before").over(shard), "next", "end")
    whole = begins.join(following, ["entity", "shard"]).select("entity", "lo", "before", ends.alias("hi"))
    both = whole.select(
        "entity",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("period").alias("kind"), F.col("lo"), F.col("hi")),
                    F.struct(F.lit("gap").alias("kind"), (F.col("before") + 1).alias("lo"), (F.col("lo") - 1).alias("hi")),
                ),
                lambda x: x["lo"].isNotNull(),
            )
        ).alias("x"),
    )
    return both.select("entity", "x.kind", F.col("x.lo").alias("run_start"), F.col("x.hi").alias("run_end"))
