"""Entries of contents that a book's patterns promise: which are missing, where they may stand, and what is read of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numerals as N

#: Pages to search before and after the place where an entry is expected.
REACH = 20


def kind(identifier: Column) -> Column:
    """int, roman or text: identifiers of one kind, but for text, are compared by value, all others by name."""
    return F.when(identifier.rlike(r"^\d{1,9}$"), "int").when(N.roman_to_int(identifier) > 0, "roman").otherwise("text")


def entries_to_find(patterns: DataFrame, entries: DataFrame, bodies: DataFrame) -> DataFrame:
    """Entries that ``patterns(book_id, level_name, range_start, range_end)`` promise and a book lacks.

    ``entries(book_id, level_name, entry_number, page)`` are those with a page, ``bodies(book_id, body_start, body_end)``
    bound the search. An entry is expected half way between the last page of those before it and the first of those
    after it in its level, ten pages after or before the one of them there is, or else in proportion to its place in the
    pattern; it is looked for ``REACH`` pages on both sides. Running extremes over the identifiers' values and names stand
    for comparing each with each. Returns ``book_id, key, level_name, identifier, expected_page, search_start, search_end``.
    """
    made = patterns.withColumn("_all", N.sequence_of(F.col("range_start"), F.col("range_end")))
    wanted = made.select(
        "book_id", "level_name", F.size("_all").alias("total"), F.posexplode("_all").alias("index", "identifier")
    ).withColumn("key", F.lower(F.concat_ws("_", "level_name", "identifier")))
    have = entries.where("level_name <> '' and entry_number <> ''").select("book_id", F.lower(F.concat_ws("_", "level_name", "entry_number")).alias("key"))
    missing = wanted.join(have.distinct(), ["book_id", "key"], "left_anti").withColumns({"kind": kind(F.col("identifier")), "value": N.number_of(F.col("identifier"))})
    number = F.coalesce("entry_number", F.lit(""))
    known = entries.where("level_name is not null and page is not null").select(
        "book_id", "level_name", number.alias("name"), kind(number).alias("kind"), N.number_of(number).alias("value"), "page"
    )
    group = ["book_id", "level_name"]
    pages = [F.min("page").alias("low"), F.max("page").alias("high")]
    # Of the same kind, by value.
    valued = known.where("kind <> 'text'").groupBy(*group, "kind", "value").agg(*pages)
    slots = valued.unionByName(missing.where("kind <> 'text'").select(*group, "kind", "value").distinct(), allowMissingColumns=True)
    w = Window.partitionBy(*group, "kind").orderBy("value")
    below, above = w.rangeBetween(Window.unboundedPreceding, -1), w.rangeBetween(1, Window.unboundedFollowing)
    by_value = slots.select(*group, "kind", "value", F.max("high").over(below).alias("v_before"), F.min("low").over(above).alias("v_after")).distinct()
    # Of another kind, by name.
    named = known.withColumn("name", F.lower("name")).groupBy(*group, "name", "kind").agg(*pages)
    names = missing.select(*group, F.lower("identifier").alias("name"), F.col("kind").alias("asks")).distinct()
    line = named.unionByName(names, allowMissingColumns=True)
    v = Window.partitionBy(*group).orderBy("name")
    # Rows of the same name stand together: their own are left out by what is known of the name alone.
    earlier, later = v.rowsBetween(Window.unboundedPreceding, -1), v.rowsBetween(1, Window.unboundedFollowing)
    one = line.groupBy(*group, "name").agg(
        *[F.max(F.when(F.col("kind") != k, F.col("high"))).alias(f"high_{k}") for k in ("int", "roman")],
        *[F.min(F.when(F.col("kind") != k, F.col("low"))).alias(f"low_{k}") for k in ("int", "roman")],
        F.max("high").alias("high_text"),
        F.min("low").alias("low_text"),
    )
    by_name = one.select(
        *group,
        "name",
        *[F.max(f"high_{k}").over(earlier).alias(f"n_before_{k}") for k in ("int", "roman", "text")],
        *[F.min(f"low_{k}").over(later).alias(f"n_after_{k}") for k in ("int", "roman", "text")],
    )
    placed = missing.join(by_value, [*group, "kind", "value"], "left").withColumn("name", F.lower("identifier")).join(by_name, [*group, "name"], "left").join(bodies, "book_id")
    pick = lambda side: reduce(lambda c, k: c.when(F.col("kind") == k, F.col(f"n_{side}_{k}")), ("roman", "text"), F.when(F.col("kind") == "int", F.col(f"n_{side}_int")))
    before, after = F.greatest("v_before", pick("before")), F.least("v_after", pick("after"))
    near = placed.withColumns({"b": before, "a": after})
    expected = (
        F.when(F.col("b").isNotNull() & F.col("a").isNotNull(), F.expr("b + cast((a - b) / 2 as int)"))
        .when(F.col("b").isNotNull(), F.col("b") + 10)
        .when(F.col("a").isNotNull(), F.col("a") - 10)
        .otherwise(F.expr("body_start + cast((body_end - body_start) * index / total as int)"))
    )
    return near.withColumn("expected_page", expected.cast("int")).select(
        "book_id",
        "key",
        "level_name",
        "identifier",
        "expected_page",
        F.greatest(F.col("expected_page") - REACH, F.col("body_start")).cast("int").alias("search_start"),
        F.least(F.col("expected_page") + REACH, F.col("body_end")).cast("int").alias("search_end"),
    )


def chapter_key(book: Column, toc_entry: Column, sort_order: Column) -> Column:
    """Key of a chapter: its entry of contents in its book, or its place among those without one."""
    orphan = F.concat_ws(":", book, F.lit("orphan"), F.coalesce(sort_order, F.lit(0)).cast("string"))
    return F.when(F.coalesce(toc_entry, F.lit("")) != "", F.concat_ws(":", book, toc_entry)).otherwise(orphan)


def entry_key(toc: Column, how: str, key: Column) -> Column:
    """Key of an entry that was discovered or validated."""
    return F.concat_ws(":", toc, F.lit(how), key)


def classified(chapters: DataFrame, results: DataFrame, entry: str = "entry_id") -> DataFrame:
    """``chapters`` of each book with the four maps of ``results(book_id, json)`` put in: matter_type, content_type and
    audio_include by the entry's id, what a map lacks staying as it was, and ``reasoning``, '' where there is none."""
    maps = {"classifications": "string", "content_types": "string", "audio_include": "boolean", "reasoning": "string"}
    schema = ", ".join(f"{k} map<string,{t}>" for k, t in maps.items())
    read = results.select("book_id", F.from_json("json", schema).alias("j"))
    keys = F.array_distinct(F.flatten(F.array(*[F.coalesce(F.map_keys(f"j.{k}"), F.array().cast("array<string>")) for k in maps])))
    each = read.select("book_id", "j", F.explode(keys).alias("_key"))
    new = each.select("book_id", F.col("_key").alias(entry), *[F.element_at(f"j.{k}", F.col("_key")).alias(f"_{k}") for k in maps])
    joined = chapters.join(new, ["book_id", entry], "left")
    return joined.withColumns(
        {
            "matter_type": F.coalesce("_classifications", "matter_type"),
            "content_type": F.coalesce("_content_types", "content_type"),
            "audio_include": F.coalesce("_audio_include", "audio_include"),
            "reasoning": F.coalesce("_reasoning", F.lit("")),
        }
    ).drop(*[f"_{k}" for k in maps])


def with_metadata(books: DataFrame, results: DataFrame) -> DataFrame:
    """``books`` with what ``results(book_id, title, authors array, publisher, …)`` say put in: the title, the first author, other
    columns of both where they aren't null; ``metadata_complete`` tells which books had a result."""
    fields = [c for c in results.columns if c in books.columns and c not in ("book_id", "title", "author")]
    r = results.select("book_id", F.lit(True).alias("_has"), F.col("title").alias("_title"), F.get("authors", F.lit(0)).alias("_author"), *[F.col(c).alias(f"_{c}") for c in fields])
    joined = books.join(r, "book_id", "left")
    put = {"title": F.when(F.col("_has"), F.col("_title")).otherwise(F.col("title")), "author": F.coalesce("_author", "author")}
    put |= {c: F.coalesce(f"_{c}", c) for c in fields}
    return joined.withColumns(put | {"metadata_complete": F.coalesce("_has", F.lit(False))}).drop("_has", "_title", "_author", *[f"_{c}" for c in fields])
