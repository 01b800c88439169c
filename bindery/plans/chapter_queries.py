"""Queries over chapters: skeleton, parents, gaps, joins with pages and paragraphs; with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numerals as N
from ..functions import text as T
from ..operators import windows as W
from ..sources.tables import blank, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Chapters once each, with their book.
_CH = "c as (select distinct * replace (split_part(unique_key, ':', 1) as book_id) from chapter)"
_BK = "b as (select _docid as book_id, page_count from book)"


def chapters(spark, folder, *columns):
    names = dict.fromkeys(["unique_key", *columns])
    once = table(spark, folder, "chapter", *names).dropDuplicates(["unique_key"])
    return once.withColumn("book_id", F.substring_index("unique_key", ":", 1))


def books(spark, folder):
    return table(spark, folder, "book", F.col("_docid").alias("book_id"), "page_count")


def pages(spark, folder, *columns):
    names = dict.fromkeys(["_docid", "book_id", "page_num", *columns])
    return table(spark, folder, "page", *names).dropDuplicates(["_docid"])


def _order() -> list:
    return [F.col("sort_order").asc_nulls_last(), F.col("unique_key")]


@query(f"""with {_CH}, {_BK} select book_id, unique_key, printf('ch_%03d', row_number() over w) as entry,
  start_page, greatest(start_page, coalesce(lead(start_page) over w - 1, page_count)) as end_page
from c join b using (book_id) where start_page is not null window w as (partition by book_id order by sort_order nulls last, unique_key)""")
def chapter_skeleton(spark, folder):
    """Chapters with a start page, numbered, with the end page that follows from the next start."""
    c = chapters(spark, folder, "sort_order", "start_page").where("start_page is not null").join(books(spark, folder), "book_id")
    out = W.skeleton(c, "book_id", _order(), F.col("start_page"), F.col("page_count"))
    return out.select("book_id", "unique_key", "entry", "start_page", F.col("end").alias("end_page"))


_LEVELS = ", ".join(
    f"""last_value(case when level = {n - 1} then entry_id end ignore nulls) over p as e{n},
  max(case when level = {n - 1} then no end) over p as a{n}, max(case when level < {n - 1} then no end) over p as s{n}"""
    for n in range(2, 6)
)


@query(f"""with {_CH}, o as (select *, row_number() over (partition by book_id order by sort_order nulls last, unique_key) as no from c),
  x as (select *, {_LEVELS} from o window p as (partition by book_id order by no rows between unbounded preceding and 1 preceding))
select book_id, unique_key, level, case {' '.join(f"when level = {n} and a{n} > coalesce(s{n}, 0) then e{n}" for n in range(2, 6))} end as parent from x""")
def chapter_parent(spark, folder):
    """Parent of every chapter as its level and order say."""
    c = chapters(spark, folder, "sort_order", "level", "entry_id")
    return W.parent_by_level(c, "book_id", _order(), "level", "entry_id").select("book_id", "unique_key", "level", "parent")


@query(f"""with {_CH}, {_BK}, p as (select distinct book_id, start_page as p, page_count as b from c join b using (book_id) where start_page is not null),
  n as (select *, lead(p) over w as nx, lag(p) over w as bf from p window w as (partition by book_id order by p))
select book_id, 1 as gap_start, p - 1 as gap_end, p - 1 as size from n where bf is null and p - 1 > 5
union all select book_id, p + 1, nx - 1, nx - p - 1 from n where nx - p > 5
union all select book_id, p + 1, b, b - p from n where nx is null and b - p > 5""")
def page_gaps(spark, folder):
    """Stretches of more than five pages in which no chapter starts, up to both ends of the book."""
    c = chapters(spark, folder, "start_page").join(books(spark, folder), "book_id")
    return W.gaps(c, "book_id", "start_page", F.lit(1), F.col("page_count"), 5)


@query(f"""with {_CH}, {_BK}, p as (select distinct book_id, start_page as p, page_count as b from c join b using (book_id) where start_page is not null),
  n as (select *, lead(p) over w as nx, lag(p) over w as bf from p window w as (partition by book_id order by p)),
  g as (select book_id, 1 as a, p - 1 as z from n where bf is null and p - 1 > 5
        union all select book_id, p + 1, nx - 1 from n where nx - p > 5
        union all select book_id, p + 1, b from n where nx is null and b - p > 5)
select g.book_id, a as gap_start, z as gap_end, c.unique_key, c.start_page from g join c on c.book_id = g.book_id and c.start_page between a - 20 and z + 20""")
def gap_neighbourhood(spark, folder):
    """Chapters that start within twenty pages of a gap."""
    c = chapters(spark, folder, "start_page")
    g = W.gaps(c.join(books(spark, folder), "book_id"), "book_id", "start_page", F.lit(1), F.col("page_count"), 5).drop("size")
    wide = g.withColumns({"a": F.col("gap_start") - 20, "z": F.col("gap_end") + 20})
    near = W.in_ranges(c.where("start_page is not null"), "start_page", wide, "a", "z", ["book_id"])
    return near.select("book_id", "gap_start", "gap_end", "unique_key", "start_page")


@query(f"""with {_CH}, r as (select book_id, unique_key, coalesce(sort_order, -1) as old_order,
  (row_number() over (partition by book_id order by start_page nulls last, sort_order nulls last, unique_key) * 100)::int as new_order from c)
select * from r where old_order <> new_order""")
def resort_entries(spark, folder):
    """New order by page for the chapters whose order changes by it, in steps of a hundred."""
    w = Window.partitionBy("book_id").orderBy(F.col("start_page").asc_nulls_last(), *_order())
    c = chapters(spark, folder, "sort_order", "start_page")
    return (
        c.select("book_id", "unique_key", F.coalesce("sort_order", F.lit(-1)).alias("old_order"), (F.row_number().over(w) * 100).cast("int").alias("new_order"))
        .where("old_order <> new_order")
    )


@query(f"""with {_CH}, p as (select distinct _docid, book_id, page_num, ocr_markdown from page)
select c.book_id, c.unique_key, count(*) as pages, min(page_num) as first_page, max(page_num) as last_page,
  sum(len(regexp_extract_all(coalesce(ocr_markdown, ''), '\\S+')))::bigint as words
from c join p on p.book_id = c.book_id and p.page_num between c.start_page and c.end_page group by 1, 2""")
def chapter_pages_range_join(spark, folder):
    """Pages of every chapter, by book, block of pages and range."""
    c = chapters(spark, folder, "start_page", "end_page")
    p = pages(spark, folder, "ocr_markdown").select("book_id", "page_num", T.word_count(F.coalesce("ocr_markdown", F.lit(""))).alias("words"))
    joined = W.in_ranges(p, "page_num", c, "start_page", "end_page", ["book_id"])
    return joined.groupBy("book_id", "unique_key").agg(
        F.count("*").alias("pages"), F.min("page_num").alias("first_page"), F.max("page_num").alias("last_page"), F.sum("words").alias("words")
    )


@query(f"""with {_CH}, x as (select chapter_id, count(*) as paragraphs, sum(coalesce(word_count, 0))::bigint as words,
  string_agg(_docid, ',' order by sort_order, _docid) as ids from (select distinct * from paragraph) group by 1)
select c.unique_key, coalesce(paragraphs, 0) as paragraphs, coalesce(words, 0) as words, coalesce(ids, '') as ids from c left join x on x.chapter_id = c._docid""")
def chapter_paragraphs(spark, folder):
    """Every chapter with its paragraphs in order; chapters without any stay."""
    x = (
        table(spark, folder, "paragraph", "_docid", "chapter_id", "sort_order", "word_count")
        .distinct()
        .groupBy("chapter_id")
        .agg(
            F.count("*").alias("paragraphs"),
            F.sum(F.coalesce("word_count", F.lit(0))).alias("words"),
            F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "_docid"))), lambda r: r["_docid"])).alias("ids"),
        )
    )
    c = chapters(spark, folder, "_docid")
    return c.join(x, c["_docid"] == x["chapter_id"], "left").select(
        "unique_key", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("paragraphs", "words")], F.coalesce("ids", F.lit("")).alias("ids")
    )


@query(f"with {_CH} select book_id, coalesce(nullif(matter_type, ''), 'unknown') as matter_type, count(*) as chapters, count(*) filter (coalesce(polish_complete, false)) as polished, count(*) filter (not coalesce(polish_complete, false) and coalesce(polish_failed, false)) as failed, count(*) filter (not coalesce(polish_complete, false) and not coalesce(polish_failed, false)) as pending, count(*) filter (audio_include) as included, count(*) filter (not audio_include) as excluded from c group by 1, 2")
def matter_histogram(spark, folder):
    c = chapters(spark, folder, "matter_type", "polish_complete", "polish_failed", "audio_include")
    done, failed = F.coalesce("polish_complete", F.lit(False)), F.coalesce("polish_failed", F.lit(False))
    return c.groupBy("book_id", F.coalesce(F.nullif("matter_type", F.lit("")), F.lit("unknown")).alias("matter_type")).agg(
        F.count("*").alias("chapters"), F.count_if(done).alias("polished"), F.count_if(~done & failed).alias("failed"),
        F.count_if(~done & ~failed).alias("pending"), F.count_if("audio_include").alias("included"), F.count_if(~F.col("audio_include")).alias("excluded"),
    )


@query(f"""with {_CH}, {_BK} select b.book_id, coalesce(min(start_page), 1) as body_start, coalesce(max(start_page), page_count) as body_end,
  count(unique_key) as entries, count(start_page) as linked, count(*) filter (unique_key like '%:orphan:%') as orphans
from b left join c on c.book_id = b.book_id group by b.book_id, page_count""")
def body_range(spark, folder):
    """First and last page with a chapter, the whole book where none is known; counts of entries."""
    c = chapters(spark, folder, "start_page")
    return books(spark, folder).join(c, "book_id", "left").groupBy("book_id", "page_count").agg(
        F.coalesce(F.min("start_page"), F.lit(1)).alias("body_start"),
        F.coalesce(F.max("start_page"), F.col("page_count")).alias("body_end"),
        F.count("unique_key").alias("entries"),
        F.count("start_page").alias("linked"),
        F.count_if(F.col("unique_key").contains(":orphan:")).alias("orphans"),
    ).drop("page_count")


@query(f"""with {_CH}, o as (select *, row_number() over (partition by book_id order by sort_order nulls last, unique_key) as no from c),
  g as (select *, sum(case when level_name = 'part' or level <= 1 then 1 else 0 end) over (partition by book_id order by no) as grp from o)
select book_id, grp::bigint as nav_group, count(*) as chapters, string_agg(entry_id, ',' order by no) as members from g group by 1, 2""")
def nav_groups(spark, folder):
    """Navigation groups: each part or first-level chapter with all deeper ones up to the next."""
    c = chapters(spark, folder, "sort_order", "level", "level_name", "entry_id")
    w = Window.partitionBy("book_id").orderBy(*_order())
    opens = F.coalesce(F.col("level_name") == "part", F.lit(False)) | F.coalesce(F.col("level") <= 1, F.lit(False))
    g = c.withColumn("no", F.row_number().over(w)).withColumn("nav_group", F.sum(opens.cast("long")).over(w))
    return g.groupBy("book_id", "nav_group").agg(
        F.count("*").alias("chapters"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("no", "entry_id"))), lambda r: r["entry_id"])).alias("members"),
    )


@query(f"""with {_CH}, p as (select distinct _docid, book_id, page_num, ocr_complete from page)
select c.unique_key, coalesce(c.start_page, 0) as start_page, coalesce(p._docid, '') as page_id, coalesce(p.ocr_complete, false) as ocr_complete from c left join p on p.book_id = c.book_id and p.page_num = c.start_page""")
def toc_page_left_join(spark, folder):
    """Every chapter with the page it starts on, if there is one."""
    c = chapters(spark, folder, "start_page")
    p = pages(spark, folder, "ocr_complete").select("book_id", F.col("page_num").alias("start_page"), F.col("_docid").alias("page_id"), "ocr_complete")
    return c.join(p, ["book_id", "start_page"], "left").select("unique_key", F.coalesce("start_page", F.lit(0)).alias("start_page"), blank("page_id").alias("page_id"), F.coalesce("ocr_complete", F.lit(False)).alias("ocr_complete"))


@query(f"""with {_CH}, x as (select *, case when level_name in ('chapter', 'part') and coalesce(entry_number, '') <> ''
  and coalesce(title, '') not in ('Chapter ' || entry_number, 'Part ' || entry_number)
  then upper(left(level_name, 1)) || level_name[2:] || ' ' || entry_number || ': ' || coalesce(title, '') else coalesce(title, '') end as shown from c)
select unique_key, shown as title_shown, trim(left(trim(regexp_replace(shown, '[/\\\\:*?"<>|]', '_', 'g'), ' .'), 100)) as file_name,
  regexp_replace('/scans/' || lower(coalesce(title, '')) || '-' || coalesce(level, 0) || '.pdf', '^.*/|(-\\d+)?\\.[^.]*$', '', 'g') as file_title from x""")
def titles(spark, folder):
    """Shown titles, safe file names and titles taken from file names."""
    c = chapters(spark, folder, "level_name", "entry_number", "title", "level")
    shown = T.numbered_title(F.col("level_name"), F.col("entry_number"), F.col("title"))
    path = F.concat(F.lit("/scans/"), F.lower(F.coalesce("title", F.lit(""))), F.lit("-"), F.coalesce("level", F.lit(0)).cast("string"), F.lit(".pdf"))
    return c.select("unique_key", shown.alias("title_shown"), F.trim(T.safe_filename(shown)).alias("file_name"), T.file_title(path).alias("file_title"))


_NUM = """case when x ~ '^[0-9]{1,9}$' then x::int else null end"""


@query(f"""with {_CH}, e as (select book_id, level_name, start_page as page, regexp_extract(entry_id, '(\\d+)$', 1)::int as no from c where start_page is not null and level_name is not null),
 s as (select book_id, level_name, min(no) as a, max(no) as z from e group by 1, 2),
 want as (select book_id, level_name, unnest(range(a, z + 1)) as no from s)
select w.book_id, w.level_name, w.no, coalesce(max(e.page) filter (e.no < w.no), 0) as page_before, coalesce(min(e.page) filter (e.no > w.no), 0) as page_after,
  (case when max(e.page) filter (e.no < w.no) is not null and min(e.page) filter (e.no > w.no) is not null
   then max(e.page) filter (e.no < w.no) + (min(e.page) filter (e.no > w.no) - max(e.page) filter (e.no < w.no)) // 2
   when max(e.page) filter (e.no < w.no) is not null then max(e.page) filter (e.no < w.no) + 10
   when min(e.page) filter (e.no > w.no) is not null then min(e.page) filter (e.no > w.no) - 10 end)::bigint as estimate
from want w join e on e.book_id = w.book_id and e.level_name = w.level_name
where not exists (select 1 from e x where x.book_id = w.book_id and x.level_name = w.level_name and x.no = w.no) group by 1, 2, 3""")
def nearest_neighbour_pages(spark, folder):
    """Chapter numbers missing from a book's sequence of one level name, with the nearest pages of lower
    and higher numbers and the page that may be expected. Running extremes over the numbers replace
    comparing every pair."""
    c = chapters(spark, folder, "entry_id", "level_name", "start_page").where("start_page is not null and level_name is not null")
    e = c.select("book_id", "level_name", F.col("start_page").alias("page"), F.regexp_extract("entry_id", r"(\d+)$", 1).cast("int").alias("no"))
    by_no = e.groupBy("book_id", "level_name", "no").agg(F.min("page").alias("low"), F.max("page").alias("high"))
    span = e.groupBy("book_id", "level_name").agg(F.min("no").alias("a"), F.max("no").alias("z"))
    want = span.select("book_id", "level_name", F.explode(F.sequence("a", "z")).alias("no"))
    w = Window.partitionBy("book_id", "level_name").orderBy("no")
    before = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("low").over(w.rowsBetween(1, Window.unboundedFollowing))
    every = want.join(by_no, ["book_id", "level_name", "no"], "left").select("*", before.alias("page_before"), after.alias("page_after"))
    b, a = F.col("page_before"), F.col("page_after")
    estimate = F.when(b.isNotNull() & a.isNotNull(), b + ((a - b) / 2).cast("long")).when(b.isNotNull(), b + 10).otherwise(a - 10)
    return every.where("low is null").select("book_id", "level_name", "no", F.coalesce(b, F.lit(0)).alias("page_before"), F.coalesce(a, F.lit(0)).alias("page_after"), estimate.cast("long").alias("estimate"))


@query(f"""with {_CH}, r as (select distinct book_id, lower(coalesce(level_name, '') || '_' || regexp_extract(entry_id, '(\\d+)$', 1)::int) as k from c),
 n as (select book_id, max(regexp_extract(entry_id, '(\\d+)$', 1)::int) as z from c group by 1),
 w as (select book_id, 'chapter_' || unnest(range(1, z + 1)) as identifier from n)
select w.* from w anti join r on r.book_id = w.book_id and r.k = w.identifier""")
def missing_identifiers_anti(spark, folder):
    """Identifiers of chapters, from the first to the highest number, that a book lacks."""
    c = chapters(spark, folder, "entry_id", "level_name")
    no = F.regexp_extract("entry_id", r"(\d+)$", 1).cast("int")
    have = c.select("book_id", F.lower(F.concat(blank("level_name"), F.lit("_"), no.cast("string"))).alias("identifier"))
    last = c.groupBy("book_id").agg(F.max(no).cast("string").alias("z"))
    want = last.select("book_id", F.explode(N.sequence_of(F.lit("1"), F.col("z"))).alias("n")).select(
        "book_id", F.concat(F.lit("chapter_"), "n").alias("identifier")
    )
    return want.join(have, ["book_id", "identifier"], "left_anti")


@query(f"""with {_CH}, {_BK}, h as (select distinct _docid, book_id, page_num from page)
select h.book_id, h.page_num, page_num >= floor(page_count * 0.8) as back_matter from h join b using (book_id)
anti join (select book_id, start_page, end_page from c where matter_type = 'front_matter') x on x.book_id = h.book_id and h.page_num between x.start_page and x.end_page""")
def excluded_range_anti(spark, folder):
    """Pages outside all front matter, with a mark for the last fifth of the book."""
    p = pages(spark, folder).join(books(spark, folder), "book_id")
    x = chapters(spark, folder, "matter_type", "start_page", "end_page").where("matter_type = 'front_matter'").select("book_id", "start_page", "end_page")
    left = W.in_ranges(p, "page_num", x, "start_page", "end_page", ["book_id"], "left_anti")
    return left.select("book_id", "page_num", (F.col("page_num") >= F.floor(F.col("page_count") * 0.8)).alias("back_matter"))


@query(f"""with {_CH} select unique_key, coalesce(level, 0) as level, '[id: ' || entry_id || '] level ' || coalesce(level, 0) || ' ' || coalesce(nullif(level_name, ''), 'section') || ', pages ' ||
  coalesce(start_page, 0) || '-' || coalesce(end_page, 0) || ', word_count ' || coalesce(word_count, 0) as prompt_line from c""")
def chapter_prompt_lines(spark, folder):
    """One line of description for every chapter."""
    c = chapters(spark, folder, "entry_id", "level", "level_name", "start_page", "end_page", "word_count")
    n = lambda k: F.coalesce(k, F.lit(0)).cast("string")
    line = F.concat(F.lit("[id: "), "entry_id", F.lit("] level "), n("level"), F.lit(" "), F.coalesce(F.nullif("level_name", F.lit("")), F.lit("section")),
                    F.lit(", pages "), n("start_page"), F.lit("-"), n("end_page"), F.lit(", word_count "), n("word_count"))
    return c.select("unique_key", F.coalesce("level", F.lit(0)).alias("level"), line.alias("prompt_line"))


@query(f"""with {_CH}, a as (select *, row_number() over (partition by book_id order by sort_order nulls last, unique_key) as number, regexp_replace(coalesce(mechanical_text, ''), '^\\s+|\\s+$', '', 'g') as t from c),
 f as (select *, replace(t, chr(10), ' ') as flat from a), n as (select *, case when strlen(flat) > 200 then list_max(list_filter(range(1, 201), lambda i: strlen(left(flat, i)) <= 200)) end as fit from f)
select unique_key, number, number || '. "' || coalesce(title, '') || '" (' || case when coalesce(end_page, 0) = 0 or coalesce(end_page, 0) = coalesce(start_page, 0) then 'page ' || coalesce(start_page, 0) else 'pages ' || coalesce(start_page, 0) || '-' || end_page end
 || ', level ' || coalesce(level, 0) || ' ' || coalesce(level_name, '') || ', word_count ' || case when coalesce(word_count, 0) <> 0 then word_count else len(regexp_extract_all(coalesce(mechanical_text, ''), '\\S+')) end
 || ') [id: ' || coalesce(entry_id, '') || ']' || chr(10) || '   text: ' || case when flat = '' then '[no text]' when strlen(flat) > 200 then left(flat, fit) || case when strlen(left(flat, fit)) < 200 then chr(65533) else '' end || '...' else flat end as prompt_line from n""")
def chapter_classify_lines(spark, folder):
    """The whole entry of every chapter in a prompt for its classification: number in its book, title, pages, level, words
    (counted where none are stored) and the first 200 bytes of its text."""
    c = chapters(spark, folder, "entry_id", "title", "level", "level_name", "start_page", "end_page", "word_count", "sort_order", "mechanical_text")
    number = F.row_number().over(Window.partitionBy("book_id").orderBy(*_order()))
    n = lambda k: F.coalesce(k, F.lit(0))
    text = blank("mechanical_text")
    words = F.when(n("word_count") != 0, F.col("word_count")).otherwise(F.regexp_count(text, F.lit(r"(?U)\S+")))
    flat = F.encode(F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+\z", ""), "\n", " "), "UTF-8")
    # A character that the cut halves is shown as U+FFFD.
    cut = F.concat(F.make_valid_utf8(F.substring(flat, 1, 200).cast("string")), F.lit("..."))
    snippet = F.when(F.length(flat) == 0, "[no text]").when(F.length(flat) > 200, cut).otherwise(flat.cast("string"))
    one = (n("end_page") == 0) | (n("end_page") == n("start_page"))
    place = F.when(one, F.format_string("page %d", n("start_page"))).otherwise(F.format_string("pages %d-%d", n("start_page"), n("end_page")))
    line = F.format_string('%d. "%s" (%s, level %d %s, word_count %d) [id: %s]\n   text: %s', "number", blank("title"), "place", n("level"), blank("level_name"), "words", blank("entry_id"), "snippet")
    made = c.withColumns({"number": number, "place": place, "words": words, "snippet": snippet})
    return made.select("unique_key", F.col("number").cast("long").alias("number"), line.alias("prompt_line"))


@query(f"""with {_CH}, m as (select book_id, unique_key, coalesce(try_cast(json_extract_string(j, '$.' || entry_id) as varchar), matter_type) as matter_type from c
 join (select book_id as jb, '{{' || string_agg('"' || entry_id || '":"back_matter"', ',') || '}}' as j from (select distinct book_id, entry_id from c where start_page > 20) group by 1) on jb = book_id)
select * from m""")
def classification_apply(spark, folder):
    """A JSON map of new kinds by chapter, merged into the chapters of its book: absent keys keep the old."""
    c = chapters(spark, folder, "entry_id", "matter_type", "start_page")
    made = c.where("start_page > 20").groupBy("book_id").agg(
        F.to_json(F.map_from_entries(F.collect_set(F.struct("entry_id", F.lit("back_matter"))))).alias("j")
    )
    new = made.select("book_id", F.explode(F.from_json("j", "map<string,string>")).alias("entry_id", "new"))
    return c.join(made.select("book_id"), "book_id", "left_semi").join(new, ["book_id", "entry_id"], "left").select(
        "book_id", "unique_key", F.coalesce("new", "matter_type").alias("matter_type")
    )


@query(f"""with {_CH}, {_BK} select b.book_id, page_count, count(distinct p._docid) as pages, count(distinct case when p.ocr_complete then p._docid end) as ocr_pages,
  (select count(*) from c where c.book_id = b.book_id) as chapters, (select count(distinct unique_key) from audio_segment s where s.book_id = b.book_id) as segments
from b left join page p on p.book_id = b.book_id group by b.book_id, page_count""")
def book_state(spark, folder):
    """Everything known of a book, counted: each table is reduced to a row per book before it is joined."""
    p = pages(spark, folder, "ocr_complete").groupBy("book_id").agg(F.count("*").alias("pages"), F.count_if("ocr_complete").alias("ocr_pages"))
    c = chapters(spark, folder).groupBy("book_id").agg(F.count("*").alias("chapters"))
    s = table(spark, folder, "audio_segment", "book_id", "unique_key").distinct().groupBy("book_id").agg(F.count("*").alias("segments"))
    out = books(spark, folder).join(p, "book_id", "left").join(c, "book_id", "left").join(s, "book_id", "left")
    return out.na.fill(0, ["pages", "ocr_pages", "chapters", "segments"])
