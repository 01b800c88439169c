"""Smaller queries: searches, ranges, orders, parsing and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numerals as N
from ..functions import text as T
from ..sources.tables import blank, metrics, table, zero
from .chapter_queries import books, chapters, pages
from .page_queries import _B, _P

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_CH = "c as (select distinct * replace (split_part(unique_key, ':', 1) as book_id) from chapter)"


@query("select distinct unique_key, book_id, chapter_idx from audio_segment where starts_with(unique_key, 'bk-1')")
def prefix_scan(spark, folder):
    """Segments by the beginning of their key, which reaches the scan as a filter."""
    return table(spark, folder, "audio_segment", "unique_key", "book_id", "chapter_idx").where(F.col("unique_key").startswith("bk-1")).distinct()


@query(f"with {_P}, {_B} select p.book_id, p.page_num from p join b using (book_id) where p.page_num between greatest(-3, 1) and least(12, page_count)")
def page_range_clamped(spark, folder):
    """Pages of a range cut to the book."""
    p = pages(spark, folder).join(books(spark, folder), "book_id")
    return p.where(F.col("page_num").between(F.greatest(F.lit(-3), F.lit(1)), F.least(F.lit(12), F.col("page_count")))).select("book_id", "page_num")


@query(f"""with {_CH} select unique_key, coalesce(title, '') as title from c where (contains(lower(coalesce(title, '')), 'harbour') or contains(lower(coalesce(level_name, '')), 'harbour')
  or contains(lower(coalesce(entry_number, '')), 'harbour')) and start_page is not null""")
def search_chapters(spark, folder):
    """Linked chapters with a word in one of three columns, whatever its case."""
    c = chapters(spark, folder, "title", "level_name", "entry_number", "start_page").where("start_page is not null")
    hit = F.lit(False)
    for k in ("title", "level_name", "entry_number"):
        hit = hit | F.lower(blank(k)).contains("harbour")
    return c.where(hit).select("unique_key", blank("title").alias("title"))


@query(f"""with {_CH} select unique_key, coalesce(title, '') as title, start_page is not null as linked from c where contains(lower(coalesce(title, '')), 'the') and unique_key like '%:orphan:%'""")
def search_discovered(spark, folder):
    """Chapters outside the contents with a word in their title, linked or not."""
    c = chapters(spark, folder, "title", "start_page").where(F.col("unique_key").contains(":orphan:") & F.lower(blank("title")).contains("the"))
    return c.select("unique_key", blank("title").alias("title"), F.col("start_page").isNotNull().alias("linked"))


@query("select coalesce(status, '') as status, count(*) as books, count(*) filter (status in ('complete', 'failed')) as finished, sum(page_count)::bigint as pages from book group by 1")
def unfinished_books(spark, folder):
    """Books by status, and how many of them are finished."""
    b = table(spark, folder, "book", "status", "page_count")
    return b.groupBy(blank("status").alias("status")).agg(
        F.count("*").alias("books"), F.count_if(F.col("status").isin("complete", "failed")).alias("finished"), F.sum("page_count").alias("pages")
    )


@query(f"with {_P} select book_id, sum(len(regexp_extract_all(ocr_markdown, '(?i)harbour')))::bigint as matches, count(*) filter (regexp_matches(ocr_markdown, '(?i)harbour')) as pages from p where ocr_markdown is not null group by 1")
def grep_totals(spark, folder):
    n = F.regexp_count("ocr_markdown", F.lit("(?i)harbour"))
    return pages(spark, folder, "ocr_markdown").where("ocr_markdown is not null").groupBy("book_id").agg(F.sum(n).cast("long").alias("matches"), F.count_if(n > 0).alias("pages"))


@query("""with t as (select unique_key, printf('%04d-%02d-%02dT10:00:00Z', 2025, coalesce(start_page, 0), greatest(coalesce(level, 1), 1)) as raw from (select distinct unique_key, start_page, level from chapter))
select unique_key, raw, coalesce(strftime(try_cast(raw as timestamp), '%Y-%m-%d'), '') as parsed from t""")
def timestamps_parsed(spark, folder):
    """Times from texts; what is no time gives '' instead of an error."""
    c = table(spark, folder, "chapter", "unique_key", "start_page", "level").distinct()
    raw = F.format_string("%04d-%02d-%02dT10:00:00Z", F.lit(2025), F.coalesce("start_page", F.lit(0)), F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)))
    t = c.select("unique_key", raw.alias("raw"))
    return t.select("unique_key", "raw", F.coalesce(F.date_format(F.try_to_timestamp("raw"), "yyyy-MM-dd"), F.lit("")).alias("parsed"))


@query("""select unique_key, epoch_us(created_at) as created_us, coalesce(duration_ms, -1) as duration_ms, row_number() over (partition by unique_key order by created_at, coalesce(duration_ms, -1)) as version,
  lead(created_at) over (partition by unique_key order by created_at, coalesce(duration_ms, -1)) is null as current from audio_segment""")
def version_numbers(spark, folder):
    """Every version of every segment, numbered."""
    s = table(spark, folder, "audio_segment", "unique_key", F.unix_micros("created_at").alias("created_us"), F.coalesce("duration_ms", F.lit(-1)).alias("duration_ms"))
    w = Window.partitionBy("unique_key").orderBy("created_us", "duration_ms")
    return s.select("*", F.row_number().over(w).cast("long").alias("version"), F.lead("created_us").over(w).isNull().alias("current"))


@query("""select page_id, provider, case when confidence >= 0.9 then 'high' when confidence >= 0.8 then 'medium' else 'low' end as level from (select distinct page_id, provider, confidence from ocr_result)""")
def confidence_levels(spark, folder):
    """Confidence in words; null is low."""
    o = table(spark, folder, "ocr_result", "page_id", "provider", "confidence").distinct()
    return o.select("page_id", "provider", F.when(F.col("confidence") >= 0.9, "high").when(F.col("confidence") >= 0.8, "medium").otherwise("low").alias("level"))


@query("""with r as (select distinct page_id, provider, '```json' || chr(10) || provider_metadata || chr(10) || '```' as raw from ocr_result where provider_metadata is not null)
select page_id, provider, regexp_extract(raw, '(?s)(\\{.*\\})', 1) as json from r""")
def json_repaired(spark, folder):
    """JSON taken out of code fences."""
    r = table(spark, folder, "ocr_result", "page_id", "provider", "provider_metadata").where("provider_metadata is not null").distinct()
    return r.select("page_id", "provider", T.unfenced_json(F.concat(F.lit("```json\n"), "provider_metadata", F.lit("\n```"))).alias("json"))


@query(f"""with {_CH}, k as (select unique_key, book_id, coalesce(nullif(entry_number, ''), entry_id) as ident, try_cast(regexp_extract(coalesce(nullif(entry_number, ''), entry_id), '^(\\d{{1,9}})$', 1) as int) as n from c)
select unique_key, row_number() over (partition by book_id order by case when n is null then 1 else 0 end, n, lower(ident), unique_key) as place from k""")
def identifier_order(spark, folder):
    """Chapters by their identifiers: numbers by value, then others by name."""
    c = chapters(spark, folder, "entry_number", "entry_id")
    ident = F.coalesce(F.nullif("entry_number", F.lit("")), F.col("entry_id"))
    n = F.when(ident.rlike(r"^\d{1,9}$"), N.number_of(ident))
    w = Window.partitionBy("book_id").orderBy(n.isNull().cast("int"), n.asc_nulls_last(), F.lower(ident), "unique_key")
    return c.select("unique_key", F.row_number().over(w).cast("long").alias("place"))


@query("""select stage, calls, row_number() over (order by case stage when 'ocr' then 1 when 'toc' then 2 when 'metadata' then 3 else 4 end, calls desc, stage) as place
from (select coalesce(stage, '') as stage, count(*) as calls from metric group by 1)""")
def custom_order(spark, folder):
    """Stages in an order given by hand, the rest by their number of calls."""
    m = table(spark, folder, "metric", "stage").groupBy(blank("stage").alias("stage")).agg(F.count("*").alias("calls"))
    rank = F.when(F.col("stage") == "ocr", 1).when(F.col("stage") == "toc", 2).when(F.col("stage") == "metadata", 3).otherwise(4)
    return m.select("stage", "calls", F.row_number().over(Window.orderBy(rank, F.desc("calls"), "stage")).cast("long").alias("place"))  # a row a stage


@query("""with p as (select _docid, any_value(headings) as h from page group by 1) select _docid, len(h) as headings, array_to_string(list_transform(h, lambda x: x.level || ':' || x.line_number || ':' || x.text), '|') as listed from p where len(h) > 0""")
def headings_listed(spark, folder):
    """Stored headings of every page as one text."""
    p = table(spark, folder, "page", "_docid", "headings").groupBy("_docid").agg(F.any_value("headings").alias("h")).where("size(h) > 0")
    listed = F.array_join(F.transform("h", lambda x: F.concat_ws(":", x["level"].cast("string"), x["line_number"].cast("string"), x["text"])), "|")
    return p.select("_docid", F.size("h").cast("long").alias("headings"), listed.alias("listed"))


@query("""with b as (select _docid as book_id, coalesce(status, '') as stored from book), l as (select book_id, max_by(stage, (created_at, _docid)) as live from metric
  where book_id is not null and coalesce(stage, '') <> '' and created_at > timestamptz '2025-09-01 00:00:00+00' group by 1)
select b.book_id, case when live is not null then 'running:' || live else stored end as status, live is not null as is_live from b left join l on l.book_id = b.book_id""")
def live_overlay(spark, folder):
    """Stored status of every book, with the stage of its latest call in its place where there is a recent one."""
    b = table(spark, folder, "book", F.col("_docid").alias("book_id"), blank("status").alias("stored"))
    recent = table(spark, folder, "metric", "_docid", "book_id", "stage", "created_at").where(
        (F.col("created_at") > F.lit("2025-09-01T00:00:00Z").cast("timestamp")) & F.col("book_id").isNotNull() & (F.col("stage") != "")
    )
    live = recent.groupBy("book_id").agg(F.max_by("stage", F.struct("created_at", "_docid")).alias("live"))
    j = b.join(live, "book_id", "left")
    return j.select("book_id", F.coalesce(F.concat(F.lit("running:"), "live"), "stored").alias("status"), F.col("live").isNotNull().alias("is_live"))


@query(f"""with {_CH} select unique_key, (row_number() over (partition by book_id order by sort_order nulls last, unique_key) - 1)::int as position from c where start_page is not null""")
def resort_stable(spark, folder):
    """Places of linked chapters from 0 in their present order."""
    c = chapters(spark, folder, "sort_order", "start_page").where("start_page is not null")
    w = Window.partitionBy("book_id").orderBy(F.col("sort_order").asc_nulls_last(), "unique_key")
    return c.select("unique_key", (F.row_number().over(w) - 1).alias("position"))


@query("""select coalesce(output_type, '') as category, count(*) as calls, count(*) filter (coalesce(success, false)) as good, count(*) filter (not coalesce(success, false)) as bad,
  count(distinct job_id) as jobs, coalesce(sum(completion_tokens), 0)::bigint as produced from (select distinct * from metric) group by 1""")
def log_summary(spark, folder):
    """Calls by kind of output: good, bad, jobs and tokens made. Jobs are told apart by a second grouping, so
    that a hot kind holds no set of them in one task."""
    m = metrics(spark, folder).select(blank("output_type").alias("category"), "job_id", F.coalesce("success", F.lit(False)).alias("ok"), zero("completion_tokens").alias("t"))
    by_job = m.groupBy("category", "job_id").agg(F.count("*").alias("calls"), F.count_if("ok").alias("good"), F.sum("t").alias("t"))
    return by_job.groupBy("category").agg(
        F.sum("calls").alias("calls"), F.sum("good").alias("good"), (F.sum("calls") - F.sum("good")).alias("bad"), F.count("job_id").alias("jobs"), F.sum("t").alias("produced")
    )


_PRINTED = r"^[\[(*\- ]*([0-9]{1,4})[\])*\- ]*$"


@query(f"""with {_P}, n as (select book_id, page_num, regexp_extract(coalesce(nullif(footer, ''), header, ''), '{_PRINTED}', 1) as printed from p),
 d as (select book_id, page_num, printed::int - page_num as shift from n where printed <> ''),
 f as (select *, case when lag(shift) over w is distinct from shift then 1 else 0 end as new from d window w as (partition by book_id order by page_num)),
 r as (select *, sum(new) over (partition by book_id order by page_num) as run from f)
select book_id, min(page_num) as first_page, max(page_num) as last_page, max(shift) as shift, count(*) as pages from r group by book_id, run""")
def page_number_sequences(spark, folder):
    """Runs of pages whose printed number stays as far from their place in the scan."""
    at = F.coalesce(F.nullif("footer", F.lit("")), F.col("header"), F.lit(""))
    n = pages(spark, folder, "footer", "header").select("book_id", "page_num", F.regexp_extract(at, _PRINTED, 1).alias("printed")).where("printed <> ''")
    d = n.select("book_id", "page_num", (F.col("printed").cast("int") - F.col("page_num")).alias("shift"))
    w = Window.partitionBy("book_id").orderBy("page_num")
    new = (~F.lag("shift").over(w).eqNullSafe(F.col("shift"))).cast("int")
    r = d.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return r.groupBy("book_id", "run").agg(
        F.min("page_num").alias("first_page"), F.max("page_num").alias("last_page"), F.max("shift").alias("shift"), F.count("*").alias("pages")
    ).drop("run")
