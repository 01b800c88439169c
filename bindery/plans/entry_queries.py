"""Queries over entries of contents: what is missing, where it may stand, and what is put in; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numerals as N
from ..functions import text as T
from ..operators import entries as E
from ..operators import windows as W
from ..sources.tables import blank, table
from .chapter_queries import _BK, _CH, books, chapters, pages

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_DIGIT = "case c when 'I' then 1 when 'V' then 5 when 'X' then 10 when 'L' then 50 when 'C' then 100 when 'D' then 500 when 'M' then 1000 end"
#: The value of a Roman numeral, 0 for anything else, as DuckDB has it.
_ROMAN = """case when regexp_matches(upper({0}), '^[IVXLCDM]+$') then list_sum(list_transform(range(1, length({0}) + 1), lambda i:
  case when """ + _DIGIT.replace("case c", "case upper({0})[i]") + " < coalesce(" + _DIGIT.replace("case c", "case upper({0})[i + 1]") + ", 0) then -("
_ROMAN += _DIGIT.replace("case c", "case upper({0})[i]") + ") else " + _DIGIT.replace("case c", "case upper({0})[i]") + " end))::int else 0 end"
_TO_ROMAN = "repeat('M', n // 1000) || " + " || ".join(
    f"case n // {u} % 10 when 9 then '{a}{c}' when 4 then '{a}{b}' else repeat('{b}', (n // {u} % 10) // 5) || repeat('{a}', (n // {u} % 10) % 5) end"
    for u, a, b, c in ((100, "C", "D", "M"), (10, "X", "L", "C"), (1, "I", "V", "X"))
)


@query(f"""with {_CH}, k as (select unique_key, book_id, coalesce(nullif(entry_number, ''), entry_id) as ident from c),
 v as (select *, try_cast(regexp_extract(ident, '^(\\d{{1,9}})$', 1) as int) as a, {_ROMAN.format('ident')} as r from k)
select unique_key, row_number() over (partition by book_id order by case when a is not null then 0 when r > 0 then 1 else 2 end, coalesce(a, nullif(r, 0)), lower(ident), unique_key) as place from v""")
def identifier_order_by_value(spark, folder):
    """Chapters by their identifiers: arabic numbers by value, then Roman ones by value, then others by name."""
    from pyspark.sql import Window

    c = chapters(spark, folder, "entry_number", "entry_id")
    ident = F.coalesce(F.nullif("entry_number", F.lit("")), F.col("entry_id"))
    kind = F.when(ident.rlike(r"^\d{1,9}$"), 0).when(N.number_of(ident).isNotNull(), 1).otherwise(2)
    w = Window.partitionBy("book_id").orderBy(kind, N.number_of(ident), F.lower(ident), "unique_key")
    return c.select("unique_key", F.row_number().over(w).cast("long").alias("place"))


@query(f"""with {_CH}, {_BK}, e as (select book_id, level_name, coalesce(entry_number, '') as num, start_page as page from c where start_page is not null),
 x as (select *, case when regexp_matches(num, '^[0-9]{{1,9}}$') then 'int' when {_ROMAN.format('num')} > 0 then 'roman' else 'text' end as kind,
   case when regexp_matches(num, '^[0-9]{{1,9}}$') then num::int else nullif({_ROMAN.format('num')}, 0) end as val from e),
 g as (select book_id, level_name, max(val) filter (kind = 'int') as top_int, max(val) filter (kind = 'roman') as top_roman from x where level_name is not null group by 1, 2),
 p as (select book_id, level_name, top_int + 1 as top, 'int' as kind from g where top_int is not null
   union all select book_id, level_name, top_roman + 1, 'roman' from g where top_int is null and top_roman is not null
   union all select book_id, 'appendix', 3, 'int' from b),
 s as (select book_id, level_name, kind, top as total, unnest(range(1, top + 1)) as n from p),
 i as (select *, case when kind = 'int' then n::varchar else {_TO_ROMAN} end as identifier, n - 1 as idx from s),
 m as (select *, lower(level_name || '_' || identifier) as key from i where not exists (select 1 from e where e.book_id = i.book_id and e.level_name <> '' and e.num <> '' and lower(e.level_name || '_' || e.num) = lower(i.level_name || '_' || i.identifier))),
 f as (select m.book_id, m.key, m.level_name, m.identifier, m.idx, m.total,
   max(x.page) filter (case when x.kind = m.kind then x.val < m.n else lower(x.num) < lower(m.identifier) end) as bf,
   min(x.page) filter (case when x.kind = m.kind then x.val > m.n else lower(x.num) > lower(m.identifier) end) as af
   from m left join x on x.book_id = m.book_id and x.level_name = m.level_name group by all),
 y as (select b.book_id, coalesce(min(start_page), 1) as a, coalesce(max(start_page), page_count) as z from b left join c on c.book_id = b.book_id group by b.book_id, page_count),
 q as (select f.*, y.a, y.z, case when bf is not null and af is not null then bf + trunc((af - bf) / 2)::int when bf is not null then bf + 10 when af is not null then af - 10 else y.a + (y.z - y.a) * idx // total end as ex from f join y using (book_id))
select book_id, key, level_name, identifier, ex::int as expected_page, greatest(ex - 20, a)::int as search_start, least(ex + 20, z)::int as search_end from q""")
def entries_to_find(spark, folder):
    """Entries that the numbers of each level of a book promise up to one more than its highest, and three appendices of every
    book, where there are none; with the pages to search."""
    c = chapters(spark, folder, "level_name", "entry_number", "start_page")
    entries = c.where("start_page is not null").select("book_id", "level_name", "entry_number", F.col("start_page").alias("page"))
    number = blank("entry_number")
    top = lambda k: F.max(F.when(E.kind(number) == k, N.number_of(number))).alias(f"top_{k}")
    tops = entries.where("level_name is not null").groupBy("book_id", "level_name").agg(top("int"), top("roman"))
    some = tops.where("top_int is not null or top_roman is not null")
    ranges = some.select(
        "book_id",
        "level_name",
        F.when(F.col("top_int").isNotNull(), "1").otherwise("I").alias("range_start"),
        F.when(F.col("top_int").isNotNull(), (F.col("top_int") + 1).cast("string")).otherwise(N.int_to_roman(F.col("top_roman") + 1)).alias("range_end"),
    )
    more = books(spark, folder).select("book_id", F.lit("appendix").alias("level_name"), F.lit("1").alias("range_start"), F.lit("3").alias("range_end"))
    bodies = books(spark, folder).join(c, "book_id", "left").groupBy("book_id", "page_count").agg(
        F.coalesce(F.min("start_page"), F.lit(1)).alias("body_start"), F.coalesce(F.max("start_page"), F.col("page_count")).alias("body_end")
    ).drop("page_count")
    return E.entries_to_find(ranges.unionByName(more), entries, bodies)


@query(f"""with {_CH}, {_BK}, p as (select book_id, start_page as p, min(coalesce(title, '')) as t, max(page_count) as b from c join b using (book_id) where start_page is not null group by 1, 2),
  n as (select *, lead(p) over w as nx, lag(p) over w as bf, lead(t) over w as nt from p window w as (partition by book_id order by p)),
  x as (select book_id, start_page as xs, end_page as xe from c where matter_type = 'back_matter' and end_page >= start_page),
  g as (select book_id, true as head, 1 as a, p - 1 as z, p - 1 as size, '' as pt, 0 as pp, t as nt, p as np from n where bf is null and p - 1 > 6
    union all select book_id, false, p + 1, nx - 1, nx - p - 1, t, p, nt, nx from n where nx - p > 6
    union all select book_id, false, p + 1, b, b - p, t, p, '', 0 from n where nx is null and b - p > 6)
select book_id, 'gap_' || a || '_' || z as gap_key, a as gap_start, z as gap_end, size, pt as prev_title, nt as next_title, pp as prev_page, np as next_page
from g where head or not exists (select 1 from x where x.book_id = g.book_id and g.a between xs and xe)""")
def page_gaps_with_neighbours(spark, folder):
    """Stretches of more than six pages in which no chapter starts, with the chapters on both sides; those that begin in back
    matter are left out, unless no chapter is before them."""
    c = chapters(spark, folder, "start_page", "end_page", "matter_type", "title").withColumn("title", blank("title"))
    excluded = c.where("matter_type = 'back_matter'").select("book_id", "start_page", "end_page")
    own = c.select("book_id", "start_page", "title").join(books(spark, folder), "book_id")
    return W.gaps(own.withColumnRenamed("start_page", "page"), "book_id", "page", F.lit(1), F.col("page_count"), 6, "title", excluded)


@query(f"""with {_CH}, {_BK}, p as (select distinct _docid, book_id, page_num from page)
select b.book_id, c.unique_key, coalesce(c.entry_number, '') as entry_number, coalesce(c.level, 0) as level, coalesce(c.sort_order, 0) as sort_order, case when c.unique_key like '%:orphan:%' then 'discovered' else '' end as source,
 coalesce(p.page_num, 0) as actual_page, p.page_num is not null as is_linked from b join c on c.book_id = b.book_id left join p on p.book_id = c.book_id and p.page_num = c.start_page""")
def toc_entries_linked(spark, folder):
    """Books with the entries of their contents and the page each is linked to: three hops."""
    c = chapters(spark, folder, "entry_number", "level", "sort_order", "start_page")
    toc = books(spark, folder).select("book_id").join(c, "book_id")
    p = pages(spark, folder).select("book_id", F.col("page_num").alias("start_page"), F.col("page_num").alias("actual"))
    j = toc.join(p, ["book_id", "start_page"], "left")
    source = F.when(F.col("unique_key").contains(":orphan:"), "discovered").otherwise("")
    n = lambda k: F.coalesce(k, F.lit(0)).alias(k)
    return j.select(
        "book_id", "unique_key", blank("entry_number").alias("entry_number"), n("level"), n("sort_order"), source.alias("source"),
        F.coalesce("actual", F.lit(0)).alias("actual_page"), F.col("actual").isNotNull().alias("is_linked"),
    )


_TOC = "t as (select book_id, min(start_page) as a, max(end_page) as z from c where matter_type = 'front_matter' and start_page > 0 and end_page > 0 group by 1)"


@query(f"""with {_CH}, p as (select distinct _docid, book_id, page_num, ocr_markdown, ocr_complete from page), {_TOC}
select p.book_id, p.page_num, p.ocr_markdown as text from p join t on t.book_id = p.book_id and p.page_num between a and z where coalesce(ocr_complete, false) and coalesce(ocr_markdown, '') <> ''""")
def toc_pages(spark, folder):
    """Pages with text in the range of pages that the book's contents have."""
    p = pages(spark, folder, "ocr_markdown", "ocr_complete").where("ocr_complete and ocr_markdown <> ''")
    return W.in_ranges(p, "page_num", _toc_ranges(spark, folder), "toc_start", "toc_end", ["book_id"]).select("book_id", "page_num", F.col("ocr_markdown").alias("text"))


def _toc_ranges(spark, folder):
    front = chapters(spark, folder, "matter_type", "start_page", "end_page").where("matter_type = 'front_matter' and start_page > 0 and end_page > 0")
    return front.groupBy("book_id").agg(F.min("start_page").alias("toc_start"), F.max("end_page").alias("toc_end"))


@query(f"""with {_CH}, p as (select _docid, any_value(book_id) as book_id, any_value(page_num) as page_num, any_value(headings) as h from page group by 1), {_TOC},
 f as (select book_id, page_num, list_filter(h, lambda x: x.level <= 2)[1] as h from p where len(list_filter(h, lambda x: x.level <= 2)) > 0),
 x as (select book_id, start_page as xs, end_page as xe from c where matter_type = 'back_matter')
select f.book_id, f.page_num, f.h.text as heading, f.h.level as level, case when f.h.level = 2 then 0.7 else 0.9 end as confidence,
 exists (select 1 from x where x.book_id = f.book_id and f.page_num between xs and xe) as excluded
from f where not exists (select 1 from t where t.book_id = f.book_id and f.page_num between a and z)""")
def heading_pages(spark, folder):
    """The first heading of the upper two levels of every page outside the contents, and whether the page is back matter."""
    p = table(spark, folder, "page", "_docid", "book_id", "page_num", "headings").groupBy("_docid").agg(*[F.any_value(c).alias(c) for c in ("book_id", "page_num", "headings")])
    first = F.get(F.filter("headings", lambda h: h["level"] <= 2), F.lit(0))
    h = p.select("book_id", "page_num", first.alias("h")).where("h is not null")
    own = W.in_ranges(h, "page_num", _toc_ranges(spark, folder), "toc_start", "toc_end", ["book_id"], "left_anti")
    back = chapters(spark, folder, "matter_type", "start_page", "end_page").where("matter_type = 'back_matter'").select("book_id", "start_page", "end_page")
    mark = W.in_ranges(own.select("book_id", "page_num"), "page_num", back, "start_page", "end_page", ["book_id"], "left_semi").distinct().withColumn("x", F.lit(True))
    confidence = F.when(F.col("h.level") == 2, 0.7).otherwise(0.9)
    return own.join(mark, ["book_id", "page_num"], "left").select(
        "book_id", "page_num", F.col("h.text").alias("heading"), F.col("h.level").alias("level"), confidence.alias("confidence"), F.coalesce("x", F.lit(False)).alias("excluded")
    )


@query(f"""with {_CH} select unique_key, book_id || ':' || case when coalesce(toc_entry_id, '') <> '' then toc_entry_id else 'orphan:' || coalesce(sort_order, 0) end as built,
 book_id || ':discovered:' || lower(coalesce(level_name, '') || '_' || coalesce(entry_number, '')) as discovered, coalesce(start_page, 0) * 1000 as discovered_order,
 book_id || ':validated:gap_' || coalesce(start_page, 0) || '_' || coalesce(end_page, 0) as validated, upper(coalesce(level_name, '')[1]) || coalesce(level_name, '')[2:] || ' ' || coalesce(entry_number, '') as title from c""")
def built_keys(spark, folder):
    """Keys of every chapter: as an entry of contents or an orphan, as discovered, and as found in a gap; with their title and order."""
    c = chapters(spark, folder, "toc_entry_id", "sort_order", "level_name", "entry_number", "start_page", "end_page")
    n = lambda k: F.coalesce(k, F.lit(0))
    book, name = F.col("book_id"), F.concat_ws("_", blank("level_name"), blank("entry_number"))
    gap = F.format_string("gap_%d_%d", n("start_page"), n("end_page"))
    return c.select(
        "unique_key",
        E.chapter_key(book, F.col("toc_entry_id"), F.col("sort_order")).alias("built"),
        E.entry_key(book, "discovered", F.lower(name)).alias("discovered"),
        (n("start_page") * 1000).alias("discovered_order"),
        E.entry_key(book, "validated", gap).alias("validated"),
        F.concat(T.title_case(blank("level_name")), F.lit(" "), blank("entry_number")).alias("title"),
    )


@query(f"""with {_CH} select book_id, unique_key, coalesce(case when start_page > 20 then 'back_matter' else matter_type end, '') as matter_type, coalesce(case when start_page % 2 = 0 then 'essay' else content_type end, '') as content_type,
 coalesce(case when start_page % 3 = 0 then true else audio_include end, false) as audio_include, case when start_page % 5 = 0 then 'page ' || start_page else '' end as reasoning from c""")
def classification_maps(spark, folder):
    """Four JSON maps of a book, by entry, put into its chapters: kinds of matter and content, whether to read aloud, and why."""
    c = chapters(spark, folder, "entry_id", "matter_type", "content_type", "audio_include", "start_page")
    some = lambda when, value: F.map_from_entries(F.collect_set(F.when(when, F.struct("entry_id", value))))
    p = F.col("start_page")
    maps = F.struct(
        some(p > 20, F.lit("back_matter")).alias("classifications"),
        some(p % 2 == 0, F.lit("essay")).alias("content_types"),
        some(p % 3 == 0, F.lit(True)).alias("audio_include"),
        some(p % 5 == 0, F.concat(F.lit("page "), p.cast("string"))).alias("reasoning"),
    )
    results = c.groupBy("book_id").agg(F.to_json(maps).alias("json"))
    done = E.classified(c, results)
    return done.select("book_id", "unique_key", blank("matter_type").alias("matter_type"), blank("content_type").alias("content_type"), F.coalesce("audio_include", F.lit(False)).alias("audio_include"), "reasoning")


@query("""with b as (select _docid as book_id, title, author, publisher, publication_year from book)
select book_id, case when page_count > 40 then 'The ' || title else title end as title, coalesce(case when page_count > 40 and coalesce(author, '') <> '' then split_part(author, ' ', 1) end, author, '') as author,
 coalesce(case when page_count > 40 then nullif('Press of ' || status, 'Press of failed') end, publisher, '') as publisher, page_count > 40 as metadata_complete
from (select _docid as book_id, title, author, publisher, status, page_count from book)""")
def metadata_applied(spark, folder):
    """Books with what was found out about them: new titles, the first of their authors, publishers where known."""
    b = table(spark, folder, "book", F.col("_docid").alias("book_id"), "title", "author", "publisher", "status", "page_count")
    results = b.where("page_count > 40").select(
        "book_id",
        F.concat(F.lit("The "), "title").alias("title"),
        F.when(blank("author") != "", F.split("author", " ")).alias("authors"),
        F.when(F.col("status") != "failed", F.concat(F.lit("Press of "), "status")).alias("publisher"),
    )
    done = E.with_metadata(b, results)
    return done.select("book_id", "title", blank("author").alias("author"), blank("publisher").alias("publisher"), "metadata_complete")


@query(f"""with {_CH}, {_BK}, p as (select distinct _docid, book_id, page_num, ocr_complete from page), o as (select distinct page_id, provider from ocr_result)
select b.book_id, coalesce((select string_agg(page_num || case when coalesce(ocr_complete, false) then '+' else '-' end, ' ' order by page_num) from p where p.book_id = b.book_id), '') as pages,
 coalesce((select string_agg(provider, ' ' order by provider) from (select distinct provider from o join p on p._docid = o.page_id where p.book_id = b.book_id)), '') as providers,
 coalesce((select string_agg(entry_id || '@' || coalesce(start_page, 0), ' ' order by coalesce(sort_order, 2000000000), unique_key) from c where c.book_id = b.book_id), '') as chapters from b""")
def book_state_lists(spark, folder):
    """Everything known of a book in one row: its pages and whether they are read, who read them, its chapters in order."""
    joined = lambda x, sep=" ": F.array_join(F.transform(F.array_sort(x), lambda r: r["t"]), sep)
    p = pages(spark, folder, "ocr_complete")
    mark = F.concat(F.col("page_num").cast("string"), F.when(F.coalesce("ocr_complete", F.lit(False)), "+").otherwise("-"))
    listed = p.groupBy("book_id").agg(joined(F.collect_list(F.struct("page_num", mark.alias("t")))).alias("pages"))
    o = table(spark, folder, "ocr_result", "page_id", "provider").distinct().join(p.select(F.col("_docid").alias("page_id"), "book_id"), "page_id")
    who = o.select("book_id", "provider").distinct().groupBy("book_id").agg(F.array_join(F.array_sort(F.collect_list("provider")), " ").alias("providers"))
    c = chapters(spark, folder, "entry_id", "start_page", "sort_order")
    own = F.concat("entry_id", F.lit("@"), F.coalesce("start_page", F.lit(0)).cast("string"))
    entries = c.groupBy("book_id").agg(joined(F.collect_list(F.struct(F.coalesce("sort_order", F.lit(2_000_000_000)).alias("o"), "unique_key", own.alias("t")))).alias("chapters"))
    out = books(spark, folder).select("book_id").join(listed, "book_id", "left").join(who, "book_id", "left").join(entries, "book_id", "left")
    return out.na.fill("")
