"""Queries over pages and their readings, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pages as P
from ..operators import windows as W
from ..sources.tables import blank, table
from .chapter_queries import books, chapters, pages

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_P = "p as (select distinct _docid, book_id, page_num, ocr_markdown, header, footer, ocr_complete from page)"
_O = "o as (select distinct page_id, provider, text, created_at from ocr_result)"
_B = "b as (select _docid as book_id, page_count from book)"
_NORM = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
_WORDS = "len(regexp_extract_all(coalesce({0}, ''), '\\S+'))"


@query(f"""with {_P}, {_O}, {_B}, s as (select p.book_id, o.provider, count(distinct o.page_id) as done from o join p on p._docid = o.page_id where coalesce(o.text, '') <> '' group by 1, 2)
select b.book_id, coalesce(provider, '') as provider, coalesce(done, 0) as done, page_count, round(coalesce(done, 0) / greatest(page_count, 1), 6) as share, page_count - coalesce(done, 0) as remaining,
  case when page_count = 0 then 0 else round(coalesce(done, 0) * 100.0 / page_count, 6) end as percent from b left join s on s.book_id = b.book_id""")
def ocr_progress(spark, folder):
    """Pages read by each provider of each book, of all its pages."""
    good = table(spark, folder, "ocr_result", "page_id", "provider", "text").where("text <> ''").select("page_id", "provider").distinct()
    done = good.join(pages(spark, folder).select(F.col("_docid").alias("page_id"), "book_id"), "page_id").groupBy("book_id", "provider").agg(F.count("*").alias("done"))
    out = books(spark, folder).join(done, "book_id", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    return out.select("book_id", blank("provider").alias("provider"), "done", "page_count", F.round(F.col("done") / F.greatest("page_count", F.lit(1)), 6).alias("share"),
                      (F.col("page_count") - F.col("done")).alias("remaining"), F.when(F.col("page_count") == 0, 0.0).otherwise(F.round(F.col("done") * 100.0 / F.col("page_count"), 6)).alias("percent"))


@query(f"""with {_P}, {_B} select b.book_id, count(*) filter (coalesce(ocr_complete, false)) as done,
  count(*) filter (coalesce(ocr_complete, false)) >= page_count as all_complete,
  count(*) filter (coalesce(ocr_complete, false) and page_num <= least(30, page_count)) = least(30, page_count) as front_ready
from b left join p on p.book_id = b.book_id group by b.book_id, page_count""")
def pages_all_complete(spark, folder):
    """Whether all pages of a book are read, and whether its first thirty are."""
    done = F.coalesce("ocr_complete", F.lit(False))
    first = F.least(F.lit(30), F.col("page_count"))
    return books(spark, folder).join(pages(spark, folder, "ocr_complete"), "book_id", "left").groupBy("book_id", "page_count").agg(
        F.count_if(done).alias("done"), F.count_if(done & (F.col("page_num") <= first)).alias("front")
    ).select("book_id", "done", (F.col("done") >= F.col("page_count")).alias("all_complete"), (F.col("front") == first).alias("front_ready"))


@query(f"""with {_P}, {_B}, w as (select book_id, unnest(range(1, page_count + 1)) as page_num from b)
select w.book_id, w.page_num::int as page_num from w anti join p on p.book_id = w.book_id and p.page_num = w.page_num and coalesce(p.ocr_markdown, '') <> ''""")
def missing_pages(spark, folder):
    """Pages of every book without text."""
    want = books(spark, folder).where("page_count > 0").select("book_id", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page_num"))
    have = table(spark, folder, "page", "book_id", "page_num", "ocr_markdown").where("ocr_markdown <> ''")
    return want.join(have, ["book_id", "page_num"], "left_anti")


@query(f"""with {_O}, f as (select page_id, provider, max(text) as text from o where coalesce(text, '') <> '' group by 1, 2)
select page_id, min_by(provider, r) as provider, min_by(text, r) as text from (select *, (case provider when 'inkscan' then 1 when 'lumenread' then 2 else 3 end, provider, text) as r from f) group by 1""")
def priority_text(spark, folder):
    """The first reading of every page that isn't empty, by order of providers."""
    o = table(spark, folder, "ocr_result", "page_id", "provider", "text").where("text <> ''").groupBy("page_id", "provider").agg(F.max("text").alias("text"))
    return P.by_priority(o, "page_id", "provider", "text", ["inkscan", "lumenread"])


@query(f"""with {_P}, {_O}, f as (select page_id, provider, max_by(text, created_at) as text from o group by 1, 2)
select p._docid as page_id, coalesce(string_agg(f.provider || '=' || coalesce(length(f.text), -1), ',' order by f.provider), '') as readings, count(f.provider) as count from p left join f on f.page_id = p._docid group by 1""")
def page_ocr_nested(spark, folder):
    """Every page with its readings: each provider's latest, here shown by its length."""
    o = W.latest(table(spark, folder, "ocr_result", "page_id", "provider", "text", "created_at"), ["page_id", "provider"], ["created_at"])
    nested = o.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("provider", "text", "created_at"))).alias("readings"))
    shown = F.transform("readings", lambda r: F.concat(r["provider"], F.lit("="), F.coalesce(F.length(r["text"]), F.lit(-1)).cast("string")))
    p = pages(spark, folder).select(F.col("_docid").alias("page_id"))
    return p.join(nested, "page_id", "left").select(
        "page_id", F.coalesce(F.array_join(shown, ","), F.lit("")).alias("readings"), F.coalesce(F.size("readings"), F.lit(0)).cast("long").alias("count")
    )


@query(f"""with {_P}, l as (select _docid, {_NORM.format('x')} as line from (select _docid, unnest(string_split(ocr_markdown, chr(10))) as x from p where ocr_markdown is not null))
select line, count(*) as times, count(distinct _docid) as pages from l where line <> '' group by 1 having count(*) > 1""")
def normalize_line(spark, folder):
    """Lines in normal form that stand more than once."""
    p = pages(spark, folder, "ocr_markdown").select("_docid", F.explode(T.lines(F.col("ocr_markdown"))).alias("x"))
    lines = p.select("_docid", T.normalize_line(F.col("x")).alias("line")).where("line <> ''")
    return lines.groupBy("line", "_docid").agg(F.count("*").alias("n")).groupBy("line").agg(F.sum("n").alias("times"), F.count("*").alias("pages")).where("times > 1")


@query(f"""with {_P} select _docid, array_to_string(list_filter(string_split(ocr_markdown, chr(10)), lambda x:
  not ((coalesce(header, '') <> '' and {_NORM.format("coalesce(header, '')")} <> '' and {_NORM.format('x')} = {_NORM.format("coalesce(header, '')")})
    or (coalesce(footer, '') <> '' and {_NORM.format("coalesce(footer, '')")} <> '' and {_NORM.format('x')} = {_NORM.format("coalesce(footer, '')")}))), chr(10)) as body from p where ocr_markdown is not null""")
def strip_header_footer(spark, folder):
    """Texts of pages without the lines that equal their header or footer."""
    p = pages(spark, folder, "ocr_markdown", "header", "footer").where("ocr_markdown is not null")
    return p.select("_docid", T.strip_header_footer(F.col("ocr_markdown"), F.col("header"), F.col("footer")).alias("body"))


_FURN = "(strlen(trim(x)) < 50 and trim(x) <> '' and (contains(x, '/') or regexp_matches(trim(replace(x, '*', '')), '^[0-9]{1,4}$')))"


@query(f"""with {_P}, s as (select _docid, string_split(ocr_markdown, chr(10)) as l from p where ocr_markdown is not null),
 f as (select _docid, l, list_position(list_transform(l[1:3], lambda x: {_FURN}), true) as k from s)
select _docid, regexp_replace(array_to_string(case when k > 0 then list_concat(l[1:k-1], l[k+1:]) else l end, chr(10)), '^\\s+|\\s+$', '', 'g') as body from f""")
def clean_page_text(spark, folder):
    """Texts of pages without a short line of furniture among the first three."""
    p = pages(spark, folder, "ocr_markdown").where("ocr_markdown is not null")
    return p.select("_docid", T.clean_page_text(F.col("ocr_markdown")).alias("body"))


@query(f"with {_P} select book_id, sum({_WORDS.format('ocr_markdown')})::bigint as words, sum(strlen(coalesce(ocr_markdown, '')))::bigint as bytes, count(*) filter (trim(coalesce(ocr_markdown, ''), ' ' || chr(10)) = '') as blank_pages from p group by 1")
def word_count(spark, folder):
    """Words and bytes of every book, and its blank pages."""
    text = blank("ocr_markdown")
    return pages(spark, folder, "ocr_markdown").groupBy("book_id").agg(
        F.sum(T.word_count(text)).cast("long").alias("words"),
        F.sum(F.octet_length(text)).alias("bytes"),
        F.count_if(F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "") == "").alias("blank_pages"),
    )


@query(f"""with {_P}, l as (select _docid, unnest(string_split(ocr_markdown, chr(10))) as x, generate_subscripts(string_split(ocr_markdown, chr(10)), 1) as no from p where ocr_markdown is not null)
select _docid, no::int as line_number, length(regexp_extract(trim(x), '^(#{{1,6}})', 1))::int as level, trim(regexp_extract(trim(x), '^#{{1,6}}\\s+(.+)$', 1)) as heading
from l where regexp_matches(trim(x), '^#{{1,6}}\\s+.*[A-Za-z0-9]')""")
def headings(spark, folder):
    """Headings of all pages with level and line."""
    p = pages(spark, folder, "ocr_markdown").select("_docid", F.explode(T.headings(F.col("ocr_markdown"))).alias("h"))
    return p.select("_docid", "h.line_number", "h.level", F.col("h.text").alias("heading"))


@query("""with p as (select _docid, any_value(headings) as headings from page group by 1)
select _docid, list_filter(headings, lambda h: h.level <= 2)[1].text as heading, list_filter(headings, lambda h: h.level <= 2)[1].level as level,
  case when list_filter(headings, lambda h: h.level <= 2)[1].level = 1 then 0.9 else 0.7 end as confidence,
  len(headings) as stored from p where len(list_filter(headings, lambda h: h.level <= 2)) > 0""")
def first_heading(spark, folder):
    """The first heading of the upper two levels stored with each page."""
    p = table(spark, folder, "page", "_docid", "headings").groupBy("_docid").agg(F.any_value("headings").alias("headings"))
    first = F.get(F.filter("headings", lambda h: h["level"] <= 2), F.lit(0))
    return p.withColumn("h", first).where("h is not null").select(
        "_docid", F.col("h.text").alias("heading"), F.col("h.level").alias("level"), F.when(F.col("h.level") == 1, 0.9).otherwise(0.7).alias("confidence"),
        F.size("headings").cast("long").alias("stored"),
    )


_GREP = "select book_id, page_num, len(regexp_extract_all(ocr_markdown, '(?i)harbour')) as matches from p where regexp_matches(ocr_markdown, '(?i)harbour')"


@query(f"with {_P}, {_B}, g as ({_GREP}) select g.book_id, g.page_num, matches, page_num >= floor(page_count * 0.8) as back_matter from g join b using (book_id)")
def grep_counts(spark, folder):
    """Pages that match a pattern, with the number of matches."""
    p = pages(spark, folder, "ocr_markdown").select("book_id", "page_num", F.regexp_count("ocr_markdown", F.lit("(?i)harbour")).cast("long").alias("matches")).where("matches > 0")
    return p.join(books(spark, folder), "book_id").select("book_id", "page_num", "matches", (F.col("page_num") >= F.floor(F.col("page_count") * 0.8)).alias("back_matter"))


def _islands(name: str, gap: int, size: int):
    @query(f"""with {_P}, g as (select distinct book_id, page_num from ({_GREP})),
     f as (select *, case when page_num - lag(page_num) over (partition by book_id order by page_num) > {gap} then 1 else 0 end as n from g),
     r as (select *, sum(n) over (partition by book_id order by page_num) as run from f)
    select book_id, min(page_num) as first, max(page_num) as last, count(*) as size from r group by book_id, run having count(*) >= {size}""")
    def clusters(spark, folder):
        p = pages(spark, folder, "ocr_markdown").where(F.col("ocr_markdown").rlike("(?i)harbour"))
        return W.islands(p, ["book_id"], "page_num", gap, size)

    QUERIES[name], SQL[name] = QUERIES.pop("clusters"), SQL.pop("clusters")


_islands("match_clusters", 3, 2)
_islands("dense_clusters", 2, 3)


_C = "c as (select distinct unique_key, split_part(unique_key, ':', 1) as book_id, start_page, end_page from chapter)"


@query(f"""with {_P}, {_C}, x as (select c.unique_key, p.page_num, regexp_replace(coalesce(ocr_markdown, ''), '^\\s+|\\s+$', '', 'g') as t from c join p on p.book_id = c.book_id and p.page_num between start_page and end_page),
 y as (select *, lag(t) over w as before, lead(t) over w as after from x where t <> '' window w as (partition by unique_key order by page_num)),
 z as (select *, case when before is null then '' when regexp_matches(before, '[a-z]-$') then '' when regexp_matches(before, '[.!?"'']$') then chr(10) || chr(10) else ' ' end as pre,
   case when after is not null and regexp_matches(t, '[a-z]-$') then left(t, length(t) - 1) else t end as body from y)
select unique_key, string_agg(pre || body, '' order by page_num) as merged from z group by 1""")
def merge_pages(spark, folder):
    """The text of every chapter put together from its pages."""
    c = chapters(spark, folder, "start_page", "end_page")
    joined = W.in_ranges(pages(spark, folder, "ocr_markdown"), "page_num", c, "start_page", "end_page", ["book_id"])
    return P.merged_text(joined, ["unique_key"], "page_num", "ocr_markdown")


@query(f"""with {_P}, r as (select *, row_number() over (partition by book_id order by page_num) as n from p where trim(coalesce(ocr_markdown, ''), ' ' || chr(10)) <> '')
select book_id, string_agg('--- Page ' || page_num || ' ---' || chr(10) || ocr_markdown, chr(10) || chr(10) order by page_num) as book_text from r where n <= 20 group by 1""")
def front_text(spark, folder):
    """The first twenty pages with text of every book as one text with page marks."""
    p = pages(spark, folder, "ocr_markdown").where(F.regexp_replace(blank("ocr_markdown"), r"^[ \n]+|[ \n]+$", "") != "")
    first = p.withColumn("n", F.row_number().over(Window.partitionBy("book_id").orderBy("page_num"))).where("n <= 20")
    mark = F.concat(F.lit("--- Page "), F.col("page_num").cast("string"), F.lit(" ---\n"), "ocr_markdown")
    return first.groupBy("book_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", mark.alias("t")))), lambda x: x["t"]), "\n\n").alias("book_text")
    )


@query(f"""with {_P},
 a as (select _docid, ocr_markdown as t from p where ocr_markdown is not null),
 b as (select _docid, case when instr(t, 'the') > 0 then left(t, instr(t, 'the') - 1) || 'THE' || substr(t, instr(t, 'the') + 3) else t end as t from a),
 c as (select _docid, case when instr(t, 'crowns') > 0 then left(t, instr(t, 'crowns') - 1) || 'coins' || substr(t, instr(t, 'crowns') + 6) else t end as t from b)
select _docid, case when instr(t, 'THE') > 0 then left(t, instr(t, 'THE') - 1) || '' || substr(t, instr(t, 'THE') + 3) else t end as edited from c""")
def apply_edits(spark, folder):
    """A list of edits, each to the first occurrence of its old text, applied in order."""
    edits = F.array(*[F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for a, b in (("the", "THE"), ("", "x"), ("crowns", "coins"), ("THE", ""))])
    p = pages(spark, folder, "ocr_markdown").where("ocr_markdown is not null")
    return p.select("_docid", T.apply_edits(F.col("ocr_markdown"), edits).alias("edited"))


@query("""with c as (select distinct unique_key, polished_text from chapter where polished_text is not null)
select unique_key, len(list_filter(list_transform(string_split(replace(replace(polished_text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10) || chr(10)), lambda x: trim(replace(x, chr(10), ' '))), lambda x: x <> ''))::int as paragraphs from c""")
def paragraph_split(spark, folder):
    """Paragraphs of every polished chapter."""
    c = table(spark, folder, "chapter", "unique_key", "polished_text").where("polished_text is not null").distinct()
    return c.select("unique_key", F.size(T.paragraphs(F.col("polished_text"))).alias("paragraphs"))


@query(f"""with {_P}, c as (select distinct chapter_id, raw_text, _docid from paragraph)
select _docid, sha256(coalesce(raw_text, '')) as digest, case when length(raw_text) > 200 then left(raw_text, 200) || '...' else raw_text end as shown,
  replace(replace(replace(replace(replace(coalesce(raw_text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') as escaped from c""")
def paragraph_forms(spark, folder):
    """Digest, shortened and escaped text of every paragraph."""
    c = table(spark, folder, "paragraph", "_docid", "raw_text").distinct()
    t = F.col("raw_text")
    return c.select("_docid", F.sha2(F.coalesce(t, F.lit("")), 256).alias("digest"), T.shortened(t, 200).alias("shown"), T.escape_xml(F.coalesce(t, F.lit(""))).alias("escaped"))
