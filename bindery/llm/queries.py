"""The pN_ queries of the training-text operators, with SQL where SQL can say the same."""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.staging import once, staged
from ..sources.tables import blank, metrics, table, zero
from . import abuse, boilerplate, mixing, packing, quantiles, scans, tokens
from .splitting import split_long

LIMIT, OVERLAP, CAPACITY = 4096, 200, 2048
PROBS = [0.5, 0.9, 0.95, 0.99]


def _once(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the same keys and text once. Rows are told apart by the keys and two numbers made of the text, so
    that texts are neither shuffled nor compared as keys."""
    seen = [*keys, "_h", "_n"]
    numbered = texts.withColumns({"_h": F.xxhash64("text"), "_n": F.length("text")})
    place = F.row_number().over(Window.partitionBy(*seen).orderBy("_h"))
    return numbered.withColumn("_k", place).where("_k = 1").drop("_h", "_n", "_k")


# p1: oversized texts


def _long_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts over the limit of all three fields, by field and key."""
    parts = [
        table(spark, folder, name, "unique_key", field)
        .where(F.length(field) > LIMIT)
        .select(F.lit(field).alias("field"), F.col("unique_key").alias("row_key"), F.col(field).alias("text"))
        for name, field in (("chapter", "mechanical_text"), ("chapter", "polished_text"), ("audio_segment", "source_text"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that come out as more than one piece."""
    pieces = split_long(_long_texts(spark, folder), "text", LIMIT, OVERLAP)
    return pieces.where("piece_no = 2").select("field", "row_key").distinct()


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The ordered pieces of every oversized text; rows stored twice give their pieces once."""
    return split_long(_once(_long_texts(spark, folder), ["field", "row_key"]), "text", LIMIT, OVERLAP)


def p1_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every oversized text put together again, held against the text: its length and digest, and whether all pieces
    are within the limit and the overlaps within theirs."""
    pieces = p1_pieces(spark, folder)
    fresh = F.substring("text", F.col("piece_fresh") - F.col("piece_start") + 1, F.col("piece_end") - F.col("piece_fresh"))
    own = pieces.select("field", "row_key", "piece_no", fresh.alias("part"), F.length("text").alias("size"), (F.col("piece_fresh") - F.col("piece_start")).alias("again"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "part"))), lambda x: x["part"]), "")
    return own.groupBy("field", "row_key").agg(
        whole.alias("whole"), (F.max("size") <= LIMIT).alias("within_limit"), (F.max("again") <= OVERLAP).alias("within_overlap"), (F.count("*") > 1).alias("cut")
    ).select("field", "row_key", F.length("whole").alias("characters"), F.md5("whole").alias("digest"), "within_limit", "within_overlap", "cut")


P1_REJOINED_SQL = """
with t as (select 'mechanical_text' as field, unique_key as row_key, mechanical_text as text from chapter where length(mechanical_text) > 4096
 union select 'polished_text', unique_key, polished_text from chapter where length(polished_text) > 4096
 union select 'source_text', unique_key, source_text from audio_segment where length(source_text) > 4096)
select field, row_key, length(text)::int as characters, md5(text) as digest, true as within_limit, true as within_overlap, true as cut from t
"""

P1_SQL = """
select 'mechanical_text' as field, unique_key as row_key from chapter where length(mechanical_text) > 4096
union
select 'polished_text', unique_key from chapter where length(polished_text) > 4096
union
select 'source_text', unique_key from audio_segment where length(source_text) > 4096
"""


# p3: percentiles


def _daily_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches by day, provider and stage, of calls counted once. Copies of a call have the same
    time, so one shuffle by day (salted, since a day may be hot) both drops copies and gathers days."""
    calls = table(
        spark, folder, "metric", "_docid", "provider", "stage", "cost_usd", "execution_seconds", "created_at"
    ).select(
        "_docid",
        F.to_date("created_at").alias("day"),
        F.pmod(F.xxhash64("_docid"), F.lit(tokens.default_salts(spark, 4, 8))).alias("salt"),
        blank("provider").alias("provider"),
        blank("stage").alias("stage"),
        zero("cost_usd").alias("cost_usd"),
        zero("execution_seconds").alias("execution_seconds"),
    )
    once = calls.repartition("day", "salt").dropDuplicates(["day", "salt", "_docid"])
    return quantiles.sketches(once, ["day", "provider", "stage"], ["cost_usd", "execution_seconds"])


def _percentiles(parts: DataFrame, *keys: str) -> DataFrame:
    found = quantiles.read_quantiles(quantiles.merged(parts, [*keys, "provider", "stage"], 1 if keys else 16), PROBS)
    return found.select(
        *(keys or [F.lit(None).cast("date").alias("day")]),
        "provider",
        "stage",
        "measure",
        "n",
        *[F.col("quantiles")[i].alias(f"p{round(p * 100)}") for i, p in enumerate(PROBS)],
        *[F.lit(quantiles.RELATIVE_ERROR * (1 - p)).alias(f"p{round(p * 100)}_rank_error") for p in PROBS],
    )


def p3_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Median, 90th, 95th and 99th percentiles of cost and execution time by provider and stage, with
    the stated rank error as a part of n: for every day, and, with day null, for all days, whose
    sketches are those of the days put together."""
    parts = staged(_daily_sketches(spark, folder))
    return _percentiles(parts, "day").unionByName(_percentiles(parts))


def p3_within_error(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the percentiles of all days lie as near to the true ranks as stated: of each the calls below and up to it are
    counted. Answers are one standard deviation off on average, so no more than three is a promise with rare exceptions."""
    found = _percentiles(staged(_daily_sketches(spark, folder))).drop("day")
    names = [f"p{round(p * 100)}" for p in PROBS]
    asked = found.select("provider", "stage", "measure", "n", F.explode(F.array(*[F.struct(F.lit(p).alias("prob"), F.col(k).alias("answer")) for k, p in zip(names, PROBS)])).alias("q"))
    asked = asked.select("provider", "stage", "measure", "n", "q.prob", "q.answer")
    values = _calls_once(spark, folder).select("provider", "stage", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in ("cost_usd", "execution_seconds")])).alias("m"))
    by_value = values.select("provider", "stage", "m.measure", "m.v").groupBy("provider", "stage", "measure", "v").agg(F.count("*").alias("c"))
    ranks = asked.join(by_value, ["provider", "stage", "measure"]).groupBy("provider", "stage", "measure", "n", "prob").agg(
        F.sum(F.when(F.col("v") < F.col("answer"), F.col("c")).otherwise(0)).alias("below"), F.sum(F.when(F.col("v") <= F.col("answer"), F.col("c")).otherwise(0)).alias("upto")
    )
    wanted, slack = F.ceil(F.col("prob") * F.col("n")), F.lit(quantiles.RELATIVE_ERROR) * (1 - F.col("prob")) * F.col("n") + 1
    good = (F.col("below") < wanted + slack) & (F.col("upto") >= wanted - slack)
    return ranks.groupBy("provider", "stage", "measure", "n").agg(F.bool_and(good).alias("within_error")).select("provider", "stage", "measure", "n", "within_error")


P3_WITHIN_SQL = """
with m as (select distinct _docid, coalesce(provider, '') as provider, coalesce(stage, '') as stage from metric)
select provider, stage, measure, count(*) as n, true as within_error from m, (select unnest(['cost_usd', 'execution_seconds']) as measure) group by 1, 2, 3
"""


def _calls_once(spark: SparkSession, folder: str) -> DataFrame:
    calls = table(spark, folder, "metric", "_docid", "provider", "stage", "cost_usd", "execution_seconds").dropDuplicates(["_docid"])
    return calls.select(blank("provider").alias("provider"), blank("stage").alias("stage"), zero("cost_usd").alias("cost_usd"), zero("execution_seconds").alias("execution_seconds"))


def p3_daily_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """The sketch of each day, provider, stage and measure, to be stored and put together later."""
    return quantiles.merged(_daily_sketches(spark, folder), ["day", "provider", "stage"], 1)


def p3_percentiles_of_mondays(spark: SparkSession, folder: str) -> DataFrame:
    """The same percentiles from the sketches of some days only."""
    return _percentiles(_daily_sketches(spark, folder).where("weekday(day) = 0"))


def p3_file_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """The sketch of each file of the log, to be put together for any files. A call that is in several files
    counts in the first of them by name only, so that it counts once in all of them together."""
    calls = table(spark, folder, "metric", "*").select(
        "_docid",
        F.struct(
            F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"),
            blank("provider").alias("provider"),
            blank("stage").alias("stage"),
            zero("cost_usd").alias("cost_usd"),
            zero("execution_seconds").alias("execution_seconds"),
        ).alias("call"),
    )
    once = calls.groupBy("_docid").agg(F.min("call").alias("call")).select("call.*")
    parts = quantiles.sketches(once, ["file", "provider", "stage"], ["cost_usd", "execution_seconds"])
    return quantiles.merged(parts, ["file", "provider", "stage"])


# p6: repeated lines

FIELDS = ["header", "footer", "ocr_markdown"]


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "page", "_docid", "book_id", *FIELDS).withColumnsRenamed({"_docid": "page", "book_id": "book"})


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every appearance of a line that recurs in its book. A block of repeated lines may be a single one, so no line of a block
    is left out, and blocks needn't be put together for this."""
    found = boilerplate.repeated_lines(_pages(spark, folder), FIELDS)[0]
    return found.select(F.col("page").alias("page_id"), "field", "line_no").distinct()


def p6_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of repeated lines of every book, with the pages each line appears on."""
    found = staged(boilerplate.repeated_lines(_pages(spark, folder), FIELDS)[0])
    pages = found.select("book", "hub", "page").distinct().groupBy("book", "hub").agg(F.count("*").alias("pages"))
    return boilerplate.blocks(found).join(pages, ["book", "hub"]).select(
        F.col("book").alias("book_id"), "block", F.col("hub").alias("line_key"), "pages"
    )


def p6_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Every page without the blocks of repeated lines of its book."""
    once = _pages(spark, folder).dropDuplicates(["page"])
    found = staged(boilerplate.repeated_lines(_pages(spark, folder), FIELDS)[0])
    return boilerplate.without_lines(once, boilerplate.block_lines(found), FIELDS).withColumnsRenamed(
        {"page": "page_id", "book": "book_id"}
    )


# p4: text read from scans


def _scans(spark: SparkSession, folder: str) -> DataFrame:
    """All texts read from scans, with the book each belongs to, and where they follow each other: a page, or its reading by one
    provider, follows the page before it, and a chapter the page before its first."""
    pages = table(spark, folder, "page", "_docid", "book_id", "page_num", "ocr_markdown")
    chapters = table(spark, folder, "chapter", "_docid", "unique_key", "start_page", "mechanical_text").withColumn(
        "book", F.substring_index("unique_key", ":", 1)
    )
    readings = table(spark, folder, "ocr_result", "page_id", "provider", "text")
    paragraphs = table(spark, folder, "paragraph", "_docid", "chapter_id", "raw_text")
    book_of_page = pages.groupBy(F.col("_docid").alias("page_id")).agg(F.max("book_id").alias("book"), F.max("page_num").alias("no"))
    book_of_chapter = chapters.groupBy(F.col("_docid").alias("chapter_id")).agg(F.max("book").alias("book"))

    def part(df: DataFrame, tab: str, key, text: str, by, no, goes_on: bool) -> DataFrame:
        at = lambda n: F.concat_ws("|", by, "book", n) if n is not None else F.lit(None).cast("string")
        place = F.when(no.isNotNull() & F.col("book").isNotNull(), at(no)) if no is not None else at(None)
        following = F.when(no.isNotNull() & F.col("book").isNotNull(), at(no + 1)) if goes_on else at(None)
        return df.select(F.lit(tab).alias("tab"), key.alias("row_key"), "book", F.col(text).alias("text"), place.alias("place"), following.alias("following"))

    read = readings.where("text <> ''").join(book_of_page, "page_id", "left")
    page, provider = F.lit("page"), blank("provider")
    parts = [
        part(pages.withColumnRenamed("book_id", "book"), "page", F.col("_docid"), "ocr_markdown", page, F.col("page_num"), True),
        part(read, "ocr_result", F.concat("page_id", F.lit("|"), provider), "text", F.concat(F.lit("by "), provider), F.col("no"), True),
        part(chapters, "chapter", F.col("unique_key"), "mechanical_text", page, F.col("start_page"), False),
        part(paragraphs.join(book_of_chapter, "chapter_id", "left"), "paragraph", F.col("_docid"), "raw_text", page, None, False),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).where("text <> ''")


def _reading_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that two providers read from the same page."""
    once = table(spark, folder, "ocr_result", "page_id", "provider", "text").where("text <> ''").groupBy("page_id", "provider").agg(F.max("text").alias("text"))
    both = once.groupBy("page_id").agg(F.min_by("text", "provider").alias("one"), F.max_by("text", "provider").alias("other"))
    return both.where("one <> other").select("one", "other")


def _noise(spark: SparkSession, folder: str, contexts: bool) -> tuple[DataFrame, tuple[DataFrame, DataFrame, DataFrame | None]]:
    found, hubs = boilerplate.repeated_lines(_pages(spark, folder), FIELDS)
    texts = _scans(spark, folder)
    # Lines of pages are known; those of the other tables are running lines if they are copies of a hub of the book.
    strong = hubs.withColumnsRenamed({"book": "source", "key": "hub"})
    others = boilerplate.keyed_lines(texts.where("tab <> 'page'"), ["book", "tab", "row_key"], ["text"], strong)
    copies = boilerplate.copies(staged(others), strong)
    pages = found.where("field = 'ocr_markdown'").select(F.lit("page").alias("tab"), F.col("page").alias("row_key"), "line_no")
    running = pages.unionByName(copies.select("tab", "row_key", "line_no"))
    return texts, scans.findings(texts, running, _reading_pairs(spark, folder), contexts)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with cut words, misread characters, running lines and page numbers."""
    _, (furniture, marked, _) = _noise(spark, folder, False)
    return scans.found_lines(furniture, marked)


def p4_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Every text as continuous clean paragraphs; rows stored twice come out once."""
    texts, noise = _noise(spark, folder, True)
    # One shuffle of the texts serves to tell them apart and to meet their notes.
    together = texts.select("tab", "row_key", "text").repartition("tab", "row_key")
    return scans.repaired(_once(together, ["tab", "row_key"]), *noise)


# p7 and p8: containers and mixes


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, counted once and kept, since ranks read them twice."""
    return staged(
        table(spark, folder, "documents", "doc_id", "source", "text").select(
            "doc_id", "source", tokens.token_count(F.col("text")).alias("tokens")
        )
    )


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document, or of every part of a document over the capacity."""
    return packing.pack(_sizes(spark, folder).select("doc_id", "tokens"), "tokens", ["doc_id"], CAPACITY)


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Members, tokens and fill of every container."""
    packed = p7_packed(spark, folder)
    return packed.groupBy("container").agg(
        F.count("*").alias("members"),
        F.sum("part_size").alias("tokens"),
        F.round(F.sum("part_size") / F.lit(CAPACITY), 6).alias("fill"),
        F.array_sort(F.collect_list(F.struct("doc_id", "part"))).alias("items"),
    )


def p7_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and what must be none: those lost, containers over the capacity, documents cut that would have fitted, parts of a
    document that don't add up to it; and whether the containers are within a hundredth of the least number that could do."""
    packed = staged(p7_packed(spark, folder))
    fill = packed.groupBy("container").agg(F.sum("part_size").alias("fill"))
    docs = packed.groupBy("doc_id").agg(F.max("tokens").alias("tokens"), F.sum("part_size").alias("sum"), F.count("*").alias("parts"))
    all_docs = table(spark, folder, "documents", "doc_id")
    lost = all_docs.join(docs, "doc_id", "left_anti").agg(F.count("*").alias("lost"))
    d = docs.agg(
        F.count("*").alias("documents"),
        F.count_if((F.col("parts") > 1) & (F.col("tokens") <= CAPACITY)).alias("wrongly_cut"),
        F.count_if(F.col("sum") != F.col("tokens")).alias("incomplete"),
    )
    c = fill.agg(
        F.count_if(F.col("fill") > CAPACITY).alias("overfull"),
        (F.count_if(F.col("fill") > 0) <= F.ceil(F.sum("fill") / CAPACITY) * 1.01 + 1).alias("nearly_least"),
    )
    facts = d.unionByName(c, allowMissingColumns=True).unionByName(lost, allowMissingColumns=True)  # three rows, each with some of the columns
    return facts.agg(*[F.max(x).alias(x) for x in facts.columns])


P7_CHECKED_SQL = "select count(*) as documents, 0::bigint as wrongly_cut, 0::bigint as incomplete, 0::bigint as overfull, true as nearly_least, 0::bigint as lost from documents"


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sizes = _sizes(spark, folder)
    chosen = mixing.rates(sizes, table(spark, folder, "mix_target"), "source", "tokens")
    return mixing.mix(sizes, chosen, "source", "tokens", ["doc_id"]), chosen


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mix with their repeats."""
    return _mix(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of every source in the mix."""
    used, chosen = _mix(spark, folder)
    totals = used.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.max("repeats").alias("most_repeats"),
        F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"),
    )
    whole = totals.agg(F.sum("tokens").alias("t")).first()["t"] or 1
    return chosen.join(totals, "source", "left").select(
        "source",
        F.round("share", 6).alias("target_share"),
        F.round(F.coalesce("tokens", F.lit(0)) / F.lit(whole), 6).alias("actual_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        "max_repeats",
    )


def p8_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Of each source of the mix: whether no document is used more often than allowed, whether the documents used are as many as
    expected but for one, and whether its share of all tokens is as near to the target as its longest document and that of
    the source with the longest allow."""
    used, chosen = _mix(spark, folder)
    used = staged(used)
    own = used.groupBy("source").agg(F.sum("repeats").alias("copies_used"), F.max("repeats").alias("most"), F.sum(F.col("tokens") * F.col("repeats")).alias("size"), F.max("tokens").alias("longest"))
    counts = table(spark, folder, "documents", "source", "doc_id", "text").where("text <> ''").groupBy("source").agg(F.count("*").alias("documents"))
    whole, slack = own.agg(F.sum("size")).scalar(), own.agg(F.sum("longest")).scalar()
    j = chosen.join(own, "source", "left").join(counts, "source", "left").withColumns({"whole": whole, "slack": slack})
    near = F.abs(F.coalesce("size", F.lit(0)) / F.col("whole") - F.col("share")) <= F.col("slack") / F.col("whole")
    as_many = F.abs(F.coalesce("copies_used", F.lit(0)) - F.col("copies") * F.col("documents")) <= 1
    return j.select("source", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), as_many.alias("as_many"), near.alias("near_target"))


P8_CHECKED_SQL = """
select source, true as within_repeats, true as as_many, true as near_target from (select distinct source from mix_target where target_share > 0 and max_repeats > 0)
where source in (select source from documents where coalesce(text, '') <> '')
"""


# p9: abusive content


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document, and whether it is over the threshold."""
    docs = table(spark, folder, "documents", "doc_id", "source", "text")
    sample = abuse.labelled(docs, table(spark, folder, "doc_label"))
    made_from = repr([(xxhash.xxh3_128_hexdigest(t), y) for t, y in sample]).encode()
    # Fitted once for all queries of an application over a folder, as long as the sample is the same.
    model = abuse.Model.unpack(once(spark, f"p9 {folder}", made_from, lambda: abuse.fit(sample).pack()))
    shared = spark.sparkContext.broadcast(model)  # one weight for each of 2**20 subsequences
    return docs.select("doc_id", "source", abuse.score(F.col("text"), shared).alias("s")).select(
        "doc_id", "source", "s.score", "s.abusive"
    )


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with at least one abusive, hateful or sexually explicit passage."""
    return p9_scores(spark, folder).where("abusive").select("doc_id").distinct()


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, abusive documents and their rate by source."""
    return p9_scores(spark, folder).groupBy(blank("source").alias("source")).agg(
        F.count("*").alias("documents"),
        F.count_if("abusive").alias("abusive"),
        F.round(F.count_if("abusive") / F.count("*"), 6).alias("rate"),
    )


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p1_rejoined": p1_rejoined,
    "p3_percentiles": p3_percentiles,
    "p3_within_error": p3_within_error,
    "p3_daily_sketches": p3_daily_sketches,
    "p3_file_sketches": p3_file_sketches,
    "p3_percentiles_of_mondays": p3_percentiles_of_mondays,
    "p4_found": p4_found,
    "p4_repaired": p4_repaired,
    "p6_found": p6_found,
    "p6_blocks": p6_blocks,
    "p6_clean": p6_clean,
    "p7_packed": p7_packed,
    "p7_containers": p7_containers,
    "p7_checked": p7_checked,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_checked": p8_checked,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
    "p9_rates": p9_rates,
}
SQL = {
    "p1_found": P1_SQL,
    "p1_rejoined": P1_REJOINED_SQL,
    "p3_within_error": P3_WITHIN_SQL,
    "p7_checked": P7_CHECKED_SQL,
    "p8_checked": P8_CHECKED_SQL,
}
