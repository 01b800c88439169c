"""Sums, averages, exact percentiles and breakdowns of the call log.

NULL and zero mean the same in the log, so sums and averages read NULL as 0 and averages divide by
all rows. Money and times are added as decimals, which makes sums independent of their order.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged
from ..sources.tables import blank, zero

EQUAL = ("job_id", "book_id", "stage", "item_key", "provider", "model", "output_type")


def matching(df: DataFrame, after=None, before=None, success: bool | None = None, **equal: str) -> DataFrame:
    """Calls with the given values and times strictly between the bounds; what isn't given isn't asked."""
    if unknown := set(equal) - set(EQUAL):
        raise ValueError(f"no such filter: {sorted(unknown)}")
    tests = [F.col(k) == v for k, v in equal.items()]
    tests += [F.col("created_at") > F.lit(after).cast("timestamp")] * (after is not None)
    tests += [F.col("created_at") < F.lit(before).cast("timestamp")] * (before is not None)
    tests += [F.coalesce("success", F.lit(False)) == success] * (success is not None)
    return df.where(reduce(and_, tests)) if tests else df


def exact_sum(name: str) -> Column:
    return F.coalesce(F.sum(zero(name).cast("decimal(18,6)")), F.lit(0)).cast("double")


def mean(total: Column) -> Column:
    """A sum over the number of rows, 0 for no rows."""
    return F.when(F.count("*") > 0, F.round(total / F.count("*"), 6)).otherwise(0.0)


def _tokens(name: str) -> Column:
    return F.coalesce(F.sum(zero(name)), F.lit(0)).cast("long")


def totals() -> list[Column]:
    return [
        exact_sum("cost_usd").alias("total_cost_usd"),
        _tokens("total_tokens").alias("total_tokens"),
        exact_sum("total_seconds").alias("total_time_seconds"),
    ]


def summary() -> list[Column]:
    good = F.count_if(F.coalesce("success", F.lit(False)))
    return [
        F.count("*").alias("count"),
        *totals(),
        good.alias("success_count"),
        (F.count("*") - good).alias("error_count"),
        mean(exact_sum("cost_usd")).alias("avg_cost_usd"),
        mean(_tokens("total_tokens").cast("double")).alias("avg_tokens"),
        mean(exact_sum("total_seconds")).alias("avg_time_seconds"),
    ]


def percentiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact percentiles of the positive values of each group, with linear interpolation: ``*keys, p0, p1 …``
    in the order of ``probs``. Other values aren't counted; groups without any have no row. Keys
    mustn't be null.

    A group of any size is no burden for one task: equal values are counted before the shuffle, the
    counts of cells of 1/256 of a power of two are summed up, and only the few cells that hold a wanted
    rank are sorted.
    """
    v = F.col(value)
    cell = F.floor(F.log2(v) * 256)
    values = df.where(v > 0).select(*keys, cell.alias("_cell"), v.alias("_v")).groupBy(*keys, "_cell", "_v").agg(F.count("*").alias("_n"))
    own = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_c").over(own.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = values.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_c")).select(
        *keys, "_cell", "_c", before.alias("_off"), F.sum("_c").over(own).alias("_all")
    )
    at = lambda p: F.lit(p) * (F.col("_all") - 1)
    ranks = F.array_distinct(F.array(*[f(at(p)).cast("long") for p in probs for f in (F.floor, F.ceil)]))
    wanted = cells.withColumn(
        "_ranks", F.filter(ranks, lambda r: (r >= F.col("_off")) & (r < F.col("_off") + F.col("_c")))
    ).where(F.size("_ranks") > 0)
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    picked = (
        values.join(wanted, [*keys, "_cell"])
        .withColumn("_end", F.col("_off") + upto)
        .select(*keys, "_v", "_n", "_all", "_end", F.explode("_ranks").alias("_rank"))
        .where((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_n")))
    )
    value_at = lambda f, p: F.max(F.when(F.col("_rank") == f(at(p)).cast("long"), F.col("_v")))
    parts = [g.alias(f"_{k}{i}") for i, p in enumerate(probs) for k, g in (("a", value_at(F.floor, p)), ("b", value_at(F.ceil, p)))]
    found = picked.groupBy(*keys).agg(*parts, F.max("_all").alias("_all"))
    low, high = lambda i: F.col(f"_a{i}"), lambda i: F.col(f"_b{i}")
    return found.select(*keys, *[(low(i) + (high(i) - low(i)) * (at(p) - F.floor(at(p)))).alias(f"p{i}") for i, p in enumerate(probs)])


#: Percentiles of the latency that the details give.
LATENCY = (50, 95, 99)


def details(df: DataFrame, *keys: Column) -> DataFrame:
    """The summary of each group, all kinds of tokens, and the latency of its calls that took any time:
    exact percentiles with linear interpolation, 0 where no call took time. Keys mustn't be null."""
    spent = F.when(F.col("total_seconds") > 0, F.col("total_seconds"))
    shown = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    rest = ["cost_usd", "success", "total_seconds", *[f"{k}_tokens" for k in ("total", "prompt", "completion", "reasoning")]]
    keyed = staged(df.select(*keys, *rest))  # the log is read, and its copies told apart, once for all that follows
    names = keyed.columns[: len(keys)]
    main = keyed.groupBy(*names).agg(
        *summary(),
        *[_tokens(f"{k}_tokens").alias(f"sum_{k}_tokens") for k in ("prompt", "completion", "reasoning")],
        shown(F.min(spent)).alias("latency_min"),
        shown(F.max(spent)).alias("latency_max"),
        shown(F.sum(spent.cast("decimal(18,6)")).cast("double") / F.count(spent)).alias("latency_avg"),
    )
    exact = percentiles(keyed, names, "total_seconds", [p / 100 for p in LATENCY])
    joined = main.join(exact, names, "left")
    return joined.select(*main.columns, *[shown(F.col(f"p{i}")).alias(f"latency_p{p}") for i, p in enumerate(LATENCY)])


def stage_key() -> Column:
    """Stage, with recognition told apart by provider."""
    return F.when((F.col("stage") == "ocr") & (blank("provider") != ""), F.concat_ws(":", "stage", "provider")).otherwise(F.col("stage"))


def breakdown(df: DataFrame, *keys: str) -> DataFrame:
    """Cost and number of calls by each key apart and in total, in one pass: ``breakdown, value``."""
    named = df.select(*[blank(k).alias(k) for k in keys], "cost_usd")
    sets = named.groupingSets([[F.col(k)] for k in keys] + [[]], *keys).agg(
        exact_sum("cost_usd").alias("cost_usd"), F.count("*").alias("calls"), *[F.grouping(k).alias(f"_{k}") for k in keys]
    )
    label, value = F.lit("total"), F.lit("")
    for k in keys:
        label = F.when(F.col(f"_{k}") == 0, k).otherwise(label)
        value = F.when(F.col(f"_{k}") == 0, F.col(k)).otherwise(value)
    return sets.select(label.alias("breakdown"), value.alias("value"), "cost_usd", "calls")
