"""Queries over running text that need a scanner; they have no SQL and are tested against examples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import prose
from ..functions import text as T
from ..sources import sinks
from ..sources.tables import blank, table
from ..operators.windows import offsets
from .chapter_queries import chapters
from .record_queries import segments

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def sentence_split(spark, folder):
    """Sentences of every polished chapter."""
    c = chapters(spark, folder, "polished_text").where("polished_text <> ''")
    return c.select("unique_key", F.posexplode(prose.sentence_list(F.col("polished_text"))).alias("sentence_no", "sentence"))


@query
def xhtml(spark, folder):
    """Markup of every polished chapter."""
    c = chapters(spark, folder, "polished_text", "title").where("polished_text <> ''")
    return c.select("unique_key", prose.as_xhtml(F.col("polished_text"), F.col("title"), ids=True).alias("xhtml"))


@query
def epub_archives(spark, folder):
    """An EPUB archive of every book with polished chapters: its language and date, nested navigation, and overlays for chapters whose
    place in the book has audio."""
    c = chapters(spark, folder, "polished_text", "title", "level", "level_name", "entry_number", "sort_order", "entry_id").where("polished_text <> ''")
    order = Window.partitionBy("book_id").orderBy(F.col("sort_order").asc_nulls_last(), "unique_key")
    placed = c.withColumn("idx", F.row_number().over(order) - 1)
    s = segments(spark, folder, "book_id", "chapter_idx", "paragraph_idx")
    timed = offsets(s, ["book_id", "chapter_idx"], ["paragraph_idx", "unique_key"], "duration_ms", F.floor(F.col("paragraph_idx") / 256))
    part = F.struct("paragraph_idx", F.col("offset").alias("start_offset_ms"), F.coalesce("duration_ms", F.lit(0)).cast("long").alias("duration_ms"))
    overlays = timed.groupBy("book_id", F.col("chapter_idx").alias("idx")).agg(F.array_sort(F.collect_list(part)).alias("segments"))
    shown = T.numbered_title(F.col("level_name"), F.col("entry_number"), F.col("title"))
    body = placed.join(overlays, ["book_id", "idx"], "left").select(
        "book_id", "idx", F.col("entry_id").alias("id"), shown.alias("title"), "level", "level_name", "segments", prose.as_xhtml(F.col("polished_text"), F.col("title"), ids=True).alias("body")
    )
    fields = ("id", "title", "level", "level_name", "segments", "body")
    ordered = F.array_sort(F.collect_list(F.struct("idx", *fields)))
    own = body.groupBy("book_id").agg(F.transform(ordered, lambda x: F.struct(*[x[k].alias(k) for k in fields])).alias("chapters"))
    code = F.lower(F.substring(F.coalesce(F.nullif("language", F.lit("")), F.lit("en")), 1, 2))
    modified = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    b = table(spark, folder, "book", F.col("_docid").alias("book_id"), "title", blank("author").alias("author"), code.alias("language"), modified.alias("modified"))
    return sinks.epubs(b.join(own, "book_id")).select("book_id", F.length("archive").alias("bytes"), F.sha2("archive", 256).alias("digest"))
