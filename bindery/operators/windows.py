"""Window-style operators: skeletons, islands, offsets, latest versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def skeleton(df: DataFrame, group: str, order: list, start: Column, total: Column) -> DataFrame:
    """Numbered sections with their ends: ``entry`` (ch_001 …) in order, and ``end``: one before the next
    start, the group's total for the last, never before the own start."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("entry", F.format_string("ch_%03d", F.row_number().over(w))).withColumn(
        "end", F.greatest(start, F.coalesce(F.lead(start).over(w) - 1, total))
    )


def parent_by_level(df: DataFrame, group: str, order: list, level: str, entry: str, deepest: int = 5) -> DataFrame:
    """``parent``: the last section one level up, unless a still shallower one has come since.

    For each level the last section and its place are carried along; sections without a valid parent
    get null. Levels over ``deepest`` neither have parents nor are any.
    """
    w = Window.partitionBy(group).orderBy(*order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    numbered = df.withColumn("_no", F.row_number().over(w))
    parent = F.lit(None).cast("string")
    own = F.col(level)
    for n in range(2, deepest + 1):
        last = F.last(F.when(own == n - 1, F.col(entry)), ignorenulls=True).over(past)
        at = F.max(F.when(own == n - 1, F.col("_no"))).over(past)
        shallower = F.max(F.when(own < n - 1, F.col("_no"))).over(past)
        parent = F.when((own == n) & (at > F.coalesce(shallower, F.lit(0))), last).otherwise(parent)
    return numbered.withColumn("parent", parent).drop("_no")


def islands(df: DataFrame, group: list[str], value: str, max_gap: int, min_size: int) -> DataFrame:
    """Runs of distinct values with steps of at most ``max_gap``: ``*group, first, last, size``, of at
    least ``min_size`` values."""
    w = Window.partitionBy(*group).orderBy(value)
    marked = (
        df.select(*group, value)
        .where(F.col(value).isNotNull())
        .distinct()
        .withColumn("_new", F.coalesce((F.col(value) - F.lag(value).over(w) > max_gap).cast("int"), F.lit(0)))
        .withColumn("_run", F.sum("_new").over(w))
    )
    return (
        marked.groupBy(*group, "_run")
        .agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("size"))
        .where(F.col("size") >= min_size)
        .drop("_run")
    )


def offsets(df: DataFrame, group: list[str], order: list[str], length: str, cell: Column | None = None) -> DataFrame:
    """``offset``: the sum of the lengths before, 0 for the first; null lengths count 0.

    With ``cell``, which must grow with the order, a group of any size is no burden for one task: the
    lengths of cells are summed up first, and rows are ordered in their cell only.
    """
    own = F.coalesce(length, F.lit(0))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    if cell is None:
        past = before(Window.partitionBy(*group).orderBy(*order))
        return df.withColumn("offset", F.coalesce(F.sum(own).over(past), F.lit(0)).cast("long"))
    celled = df.withColumn("_cell", cell)
    sums = celled.groupBy(*group, "_cell").agg(F.sum(own).alias("_sum"))
    past = before(Window.partitionBy(*group).orderBy(F.col("_cell").asc_nulls_first()))
    starts = sums.select(*group, "_cell", F.coalesce(F.sum("_sum").over(past), F.lit(0)).alias("_start"))
    same = [celled[c].eqNullSafe(starts[c]) for c in [*group, "_cell"]]
    inside = before(Window.partitionBy(*[celled[c] for c in [*group, "_cell"]]).orderBy(*[celled[c] for c in order]))
    return celled.join(starts, same).select(
        *[celled[c] for c in df.columns if c.lower() != "offset"],
        (F.col("_start") + F.coalesce(F.sum(F.coalesce(celled[length], F.lit(0))).over(inside), F.lit(0))).cast("long").alias("offset"),
    )


def in_ranges(points: DataFrame, at: str, ranges: DataFrame, start: str, end: str, on: list[str], how: str = "inner", block: int = 64) -> DataFrame:
    """``points`` joined with the ``ranges`` of the same ``on`` that hold them, both bounds inclusive.

    Ranges are cut into blocks, and points meet them by ``on`` and block, so that a group with very many points and ranges
    is spread over its blocks, and no point meets a range that is far from it. Null bounds and ends before the start hold
    nothing. ``ranges`` mustn't share other columns with ``points``; ``how`` may be any join that keeps the left side whole.
    """
    number = lambda c: F.floor(F.col(c) / F.lit(block))
    cut = ranges.where(F.col(end) >= F.col(start)).withColumn("_block", F.explode(F.sequence(number(start), number(end))))
    cut = cut.withColumnsRenamed({c: f"_on_{c}" for c in on})
    placed = points.withColumn("_at", number(at))
    same = [placed[c] == cut[f"_on_{c}"] for c in on] + [placed["_at"] == cut["_block"], placed[at].between(cut[start], cut[end])]
    return placed.join(cut, same, how).drop("_at", "_block", *[f"_on_{c}" for c in on])


def latest(df: DataFrame, keys: list[str], version: list) -> DataFrame:
    """One row per key, the one whose version columns are greatest. The rows are combined before the
    shuffle, so a key with very many versions is no burden."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*version))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def gaps(df: DataFrame, group: str, page: str, first: Column, last: Column, longest: int = 15, title: str | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Stretches without a section: between consecutive pages more than ``longest`` apart, and before the
    first and after the last: ``group, gap_start, gap_end, size``. ``first`` and ``last`` bound the body.

    With ``title`` also ``gap_key, prev_title, prev_page, next_title, next_page`` (of several sections on a page the least
    title; '' and 0 where there is none). ``excluded(group, start_page, end_page)`` are ranges of pages: a stretch that begins in one
    is left out, unless it is the one before the first section.
    """
    w = Window.partitionBy(group).orderBy(page)
    named = F.col(title) if title else F.lit("")
    base = df.where(F.col(page).isNotNull()).groupBy(group, page).agg(F.max(first).alias("_a"), F.max(last).alias("_b"), F.min(named).alias("_t"))
    near = [f(c).over(w).alias(f"_{k}_{c.strip('_')}") for k, f in (("before", F.lag), ("next", F.lead)) for c in (page, "_t")]
    placed = base.select("*", *near)
    p, n, b = F.col(page), F.col(f"_next_{page}"), F.col(f"_before_{page}")

    def gap(a: Column, z: Column, size: Column, head: bool, prev: bool, follows: bool) -> Column:
        own = F.col("_t")
        return F.struct(
            a.cast("int").alias("gap_start"), z.cast("int").alias("gap_end"), size.cast("int").alias("size"), F.lit(head).alias("_head"),
            (own if prev else F.lit("")).alias("prev_title"), (p if prev else F.lit(0)).alias("prev_page"),
            (F.lit("") if not follows else F.col("_next_t") if prev else own).alias("next_title"), (F.lit(0) if not follows else n if prev else p).alias("next_page"),
        )

    found = F.array(
        F.when(b.isNull() & (p - F.col("_a") > longest), gap(F.col("_a"), p - 1, p - F.col("_a"), True, False, True)),
        F.when(n - p > longest, gap(p + 1, n - 1, n - p - 1, False, True, True)),
        F.when(n.isNull() & (F.col("_b") - p > longest), gap(p + 1, F.col("_b"), F.col("_b") - p, False, True, False)),
    )
    each = placed.select(group, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_gap")).select(group, "_gap.*")
    if excluded is not None:
        inside = in_ranges(each.where("not _head"), "gap_start", excluded, "start_page", "end_page", [group], "left_anti")
        each = each.where("_head").unionByName(inside)
    if not title:
        return each.select(group, "gap_start", "gap_end", "size")
    names = [F.coalesce(c, F.lit("")).alias(c) for c in ("prev_title", "next_title")]
    return each.select(group, F.format_string("gap_%d_%d", "gap_start", "gap_end").alias("gap_key"), "gap_start", "gap_end", "size", *names, "prev_page", "next_page")
