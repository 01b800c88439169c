"""Reports of searches through a book: which pages hold words of a category or match a pattern, and what to make of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .pages import keyword_hits

#: Pages a keyword report looks through, and pages a list shows before it is cut short.
SEARCHED, SHOWN, REGION = 50, 5, 3


def listed(numbers: Column) -> Column:
    """Numbers in brackets: [1 2 3]."""
    return F.concat(F.lit("["), F.array_join(numbers.cast("array<string>"), " "), F.lit("]"))


def shortened(numbers: Column, most: int = SHOWN) -> Column:
    """The first of some numbers in brackets, and how many more there are, if any."""
    more = F.when(F.size(numbers) > most, F.format_string("\n  (+%d more)", F.size(numbers) - most)).otherwise("")
    return F.concat(listed(F.slice(numbers, 1, most)), more)


def keyword_pages(pages: DataFrame, text: str = "ocr_markdown") -> DataFrame:
    """``book_id, page_num, category, keywords`` of the pages of each book that a report looks through; ``pages`` has ``page_count``."""
    searched = pages.where(F.col("page_num").between(1, F.least(F.lit(SEARCHED), F.col("page_count"))) & F.col(text).isNotNull())
    hits = searched.select("book_id", "page_num", F.explode(keyword_hits(F.col(text))).alias("h"))
    return hits.select("book_id", "page_num", "h.category", "h.keywords")


def keyword_report(books: DataFrame, pages: DataFrame, hits: DataFrame, text: str = "ocr_markdown") -> DataFrame:
    """One row a book: ``searched``, the pages ``with_data`` and ``failed``, the pages of each category (arrays ``toc, structure,
    front_matter, back_matter``, in order) and the ``clusters`` of structure: runs of three pages or more, two apart at most."""
    searched = F.least(F.lit(SEARCHED), F.col("page_count"))
    have = pages.where(F.col("page_num").between(1, searched) & F.col(text).isNotNull()).select("book_id", "page_num").distinct()
    with_data = have.groupBy("book_id").agg(F.array_sort(F.collect_list("page_num")).alias("have"))  # fifty at most
    names = ("toc", "structure", "front_matter", "back_matter")
    by = hits.groupBy("book_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("category") == c, F.col("page_num")))).alias(c) for c in names])
    runs = W.islands(hits.where("category = 'structure'"), ["book_id"], "page_num", 2, 3)
    clusters = runs.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("first", "last", "size"))).alias("clusters"))
    all_ = books.withColumn("searched", searched).join(with_data, "book_id", "left").join(by, "book_id", "left").join(clusters, "book_id", "left")
    wanted = F.when(F.col("searched") > 0, F.sequence(F.lit(1), F.col("searched"))).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<int>")
    out = all_.withColumns({c: F.coalesce(c, none) for c in ("have", *names)}).withColumn("failed", F.array_except(wanted, "have"))
    return out.select("book_id", "searched", F.size("have").alias("with_data"), "failed", *names, "clusters")


def keyword_summary(report: DataFrame) -> DataFrame:
    """``book_id, summary`` of each row of ``keyword_report``: what was found, and where to look first."""
    # The words of the summary.
    size = F.size
    found = lambda c: size(c) > 0
    clustered = F.coalesce(size("clusters") > 0, F.lit(False))
    run = F.transform("clusters", lambda c: F.format_string("  → Pages %d-%d (%d pages)", c["first"], c["last"], c["size"]))
    head = [
        F.format_string("Searched: 1-%d (%d pages with OCR data)", "searched", "with_data"),
        F.when(found("failed"), F.concat(F.lit("\n"), F.format_string("⚠️  WARNING: %d pages missing OCR data: ", size("failed")), listed(F.col("failed")), F.lit("\n   These pages could not be searched - ToC might be on an unsearched page!"))),
        F.lit(""),
    ]
    nothing = F.concat_ws("\n", *head, F.lit("No keywords found in searchable pages."), F.when(found("failed"), "Consider visually checking failed pages - they may contain ToC."))
    body = [
        F.when(found("toc"), F.concat(F.lit("✓ TOC KEYWORDS: pages "), listed(F.col("toc")), F.lit("\n  → Check these pages first (direct ToC indicators)\n"))),
        F.when(
            found("structure"),
            F.when(
                clustered,
                F.concat(
                    F.format_string("✓ STRUCTURE CLUSTERING: %d cluster(s) found\n", size("clusters")),
                    F.array_join(run, "\n"),
                    F.lit("\n  Note: Dense clustering of Chapter/Part = likely ToC listing\n"),
                ),
            ).otherwise(F.format_string("• Structure keywords: scattered across %d pages (not clustered)\n", size("structure"))),
        ),
        *[F.when(found(c), F.concat(F.lit(f"• {name}: pages "), shortened(F.col(c)), F.lit("\n"))) for c, name in (("front_matter", "Front matter"), ("back_matter", "Back matter"))],
        F.lit("RECOMMENDATION:"),
        F.when(found("toc"), "  Start with TOC keyword pages")
        .when(found("structure"), F.when(clustered, F.format_string("  Check structure cluster: pages %d-%d", F.get("clusters", F.lit(0))["first"], F.get("clusters", F.lit(0))["last"])))
        .when(found("front_matter"), F.concat(F.lit("  Scan front matter region around pages "), listed(F.slice("front_matter", 1, REGION))))
        .otherwise("  Sequential scan of front matter (pages 1-20)"),
    ]
    any_ = found("toc") | found("structure") | found("front_matter") | found("back_matter")
    return report.select("book_id", F.when(any_, F.concat_ws("\n", *head, *body)).otherwise(nothing).alias("summary"))


def search_report(matches: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row for each book of ``matches(book_id, page_num, matches)``: pages and matches in all, pages in the ``excluded(book_id,
    start_page, end_page)`` ranges, clusters of the other pages (two or more, three apart at most), and a summary."""
    marked = W.in_ranges(matches.select("book_id", "page_num"), "page_num", excluded, "start_page", "end_page", ["book_id"], "left_semi").distinct()
    each = matches.join(marked.withColumn("_x", F.lit(True)), ["book_id", "page_num"], "left").withColumn("excluded", F.coalesce("_x", F.lit(False)))
    ranges = excluded.select("book_id").distinct().withColumn("has_ranges", F.lit(True))
    runs = W.islands(each.where("not excluded"), ["book_id"], "page_num", 3, 2)
    clusters = runs.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("first", "last", "size"))).alias("clusters"))
    totals = each.groupBy("book_id").agg(F.count("*").alias("pages"), F.sum("matches").alias("matches"), F.count_if("excluded").alias("excluded"))
    all_ = totals.join(clusters, "book_id", "left").join(ranges, "book_id", "left")
    # The words of the summary.
    run = F.transform("clusters", lambda c: F.format_string("  → Pages %d-%d (%d pages) - first page is likely chapter start", c["first"], c["last"], c["size"]))
    single = F.when(F.col("excluded") > 0, "Single match is in excluded range - likely not the chapter start").otherwise("Single isolated match - verify with OCR/vision")
    parts = F.concat_ws(
        "\n",
        F.when(F.size("clusters") > 0, F.concat(F.format_string("CLUSTERS DETECTED: %d dense cluster(s)\n", F.size("clusters")), F.array_join(run, "\n"))),
        F.when(F.col("excluded") > 0, F.format_string("\n⚠️ NOTE: %d of %d matches are in EXCLUDED ranges (back matter) - ignore those", "excluded", "pages")),
        F.when((F.col("excluded") == F.col("pages")) & F.coalesce("has_ranges", F.lit(False)), "\nAll matches are in excluded ranges. Try different query variations."),
        F.when(F.col("pages") == 1, F.concat(F.lit("\n"), single)),
    )
    message = F.format_string("Found %d matches across %d pages", "matches", "pages")
    return all_.select("book_id", "pages", "matches", "excluded", F.coalesce(F.size("clusters"), F.lit(0)).alias("clusters"), parts.alias("summary"), message.alias("message"))
