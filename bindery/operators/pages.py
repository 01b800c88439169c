"""Joining pages into texts, keyword reports and readings by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Words that tell the parts of a book.
KEYWORDS = {
    "toc": ["Table of Contents", "Contents", "Order of Battle", "List of Chapters", "Chapter Overview", "Synopsis"],
    "front_matter": [
        "Preface", "Author's Note", "Foreword", "Introduction", "Prologue", "Acknowledgments", "Acknowledgements",
        "Dedication", "Dedicated to", "About the Author",
    ],
    "structure": [r"Chapter\s+\d+", r"Part\s+\d+", r"Section\s+\d+"],
    "back_matter": [
        "Appendix", "Bibliography", "Works Cited", "References", "Index", "Epilogue", "Afterword", "Endnotes", "Notes",
    ],
}

#: Those that count at the beginning of a line only.
LINE_KEYWORDS = {"structure": [r"Chapter\s+[IVX]+", r"Part\s+[IVX]+"]}


def keyword_hits(text: Column, categories: dict[str, list[str]] = KEYWORDS) -> Column:
    """``array<struct<category, keywords>>``: distinct words of each category found in a text, sorted.

    Each word is a pattern by itself, so one inside another is found too. Words begin and end where ASCII
    letters, digits or underscores do, but may go on after a number. Null for texts without any.
    """

    def patterns(name: str, words: list[str]) -> list[str]:
        edged = [f"(?i){T.EDGE_A}{w}{'' if w.endswith(chr(92) + 'd+') else T.EDGE_B}" for w in words]
        return edged + [f"(?mid)^{w}" for w in LINE_KEYWORDS.get(name, [])]

    # One look for all words at once comes first: most pages hold none.
    some = "(?mid)" + "|".join(x.replace("(?i)", "").replace("(?mid)", "") for name, words in categories.items() for x in patterns(name, words))
    found = [
        F.struct(
            F.lit(name).alias("category"),
            F.array_sort(
                F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(x), 0) for x in patterns(name, words)])))
            ).alias("keywords"),
        )
        for name, words in categories.items()
    ]
    hits = F.filter(F.array(*found), lambda x: F.size(x["keywords"]) > 0)
    return F.when(text.rlike(some), hits)


def merged_text(df: DataFrame, group: list[str], order: str, text: str) -> DataFrame:
    """``*group, merged``: the group's texts in order as one.

    How a text is joined depends only on the last one before it that isn't blank, so each row works
    out its own join with a window and the group is put together in one step: a cut word loses its
    hyphen and goes on at once, after the end of a sentence comes a blank line, else a blank.
    """
    w = Window.partitionBy(*group).orderBy(order)
    trimmed = df.withColumn("_t", F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")).where("_t <> ''")
    kind = T.join_kind(F.lag("_t").over(w))
    next_kind = F.when(F.lead("_t").over(w).isNotNull(), T.join_kind(F.col("_t")))
    body = F.when(next_kind == "glue", F.regexp_replace("_t", "-$", "")).otherwise(F.col("_t"))
    prefix = F.when(kind == "break", "\n\n").when(kind == "space", " ").otherwise("")
    parts = trimmed.select(*group, F.col(order).alias("_o"), F.concat(prefix, body).alias("_p"))
    return parts.groupBy(*group).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_p"))), lambda x: x["_p"]), "").alias("merged")
    )


def by_priority(df: DataFrame, key: str, source: str, text: str, order: list[str]) -> DataFrame:
    """``key, source, text``: of each key the first text that isn't empty, sources in the given order
    (others after them by name)."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(source)), F.lit(0)), F.lit(len(order) + 1))
    best = F.min_by(F.struct(source, text), F.struct(rank.alias("r"), F.col(source), F.col(text)))
    return df.where(F.coalesce(text, F.lit("")) != "").groupBy(key).agg(best.alias("_b")).select(key, "_b.*")
