"""Queries over audio segments, versions of records, numerals and settings, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numerals as N
from ..functions import text as T
from ..operators import versions as V
from ..operators import windows as W
from ..sources.tables import blank, table
from .chapter_queries import chapters

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_SEG = "s as (select unique_key, max_by(struct_pack(b := book_id, c := chapter_idx, p := paragraph_idx, d := duration_ms, t := source_text, n := char_count, u := cost_usd, i := chapter_id), (created_at, coalesce(duration_ms, -1))) as r from audio_segment group by 1)"
_S = _SEG + ", a as (select unique_key, r.b as book_id, r.c as chapter_idx, r.p as paragraph_idx, r.d as duration_ms, r.t as source_text, r.n as char_count, r.u as cost_usd, r.i as chapter_id from s)"


def segments(spark, folder, *columns):
    """The latest rendering of every segment."""
    names = dict.fromkeys(["unique_key", "created_at", "duration_ms", *columns])
    s = table(spark, folder, "audio_segment", *names).withColumn("_d", F.coalesce("duration_ms", F.lit(-1)))
    return W.latest(s, ["unique_key"], ["created_at", "_d"]).drop("_d", "created_at")


@query(f"with {_S} select unique_key, coalesce(duration_ms, 0) as duration_ms, coalesce(char_count, 0) as char_count from a")
def latest_per_key(spark, folder):
    return segments(spark, folder, "char_count").select("unique_key", F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"), F.coalesce("char_count", F.lit(0)).alias("char_count"))


@query("""select unique_key, max_by(coalesce(duration_ms, 0), (created_at, coalesce(duration_ms, -1))) as duration_ms, epoch_us(max(created_at)) as created_us
from audio_segment where created_at <= timestamptz '2025-06-30 00:00:00+00' group by 1""")
def time_travel(spark, folder):
    """Segments as they were at a time."""
    s = table(spark, folder, "audio_segment", "unique_key", "duration_ms", "created_at").withColumn("_d", F.coalesce("duration_ms", F.lit(-1)))
    out = V.as_of(s, ["unique_key"], "created_at", F.lit("2025-06-30T00:00:00Z").cast("timestamp"), ["_d"])
    return out.select("unique_key", F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"), F.unix_micros("created_at").alias("created_us"))


@query(f"""with {_S} select unique_key, book_id, chapter_idx, paragraph_idx,
  coalesce(sum(coalesce(duration_ms, 0)) over (partition by book_id, chapter_idx order by paragraph_idx, unique_key rows between unbounded preceding and 1 preceding), 0)::bigint as start_ms from a""")
def audio_offsets(spark, folder):
    """Where each segment starts in its chapter."""
    s = segments(spark, folder, "book_id", "chapter_idx", "paragraph_idx")
    return W.offsets(s, ["book_id", "chapter_idx"], ["paragraph_idx", "unique_key"], "duration_ms", F.floor(F.col("paragraph_idx") / 256)).select(
        "unique_key", "book_id", "chapter_idx", "paragraph_idx", F.col("offset").alias("start_ms")
    )


@query(f"""with {_S} select case when grouping(chapter_idx) = 1 then 'book' else 'chapter' end as grain, book_id, coalesce(chapter_idx, -1) as chapter_idx, count(*) as segments,
  sum(coalesce(duration_ms, 0))::bigint as duration_ms, sum(cast(coalesce(cost_usd, 0) as decimal(18,6)))::double as cost_usd, sum(coalesce(char_count, 0))::bigint as chars
from a group by grouping sets ((book_id, chapter_idx), (book_id))""")
def audio_rollup(spark, folder):
    """Duration, cost and characters by chapter and by book, of the latest renderings."""
    s = segments(spark, folder, "book_id", "chapter_idx", "cost_usd", "char_count")
    g = s.groupingSets([[F.col("book_id"), F.col("chapter_idx")], [F.col("book_id")]], "book_id", "chapter_idx").agg(
        F.grouping("chapter_idx").alias("g"),
        F.count("*").alias("segments"),
        F.sum(F.coalesce("duration_ms", F.lit(0))).cast("long").alias("duration_ms"),
        F.sum(F.coalesce("cost_usd", F.lit(0)).cast("decimal(18,6)")).cast("double").alias("cost_usd"),
        F.sum(F.coalesce("char_count", F.lit(0))).cast("long").alias("chars"),
    )
    return g.select(F.when(F.col("g") == 1, "book").otherwise("chapter").alias("grain"), "book_id", F.coalesce("chapter_idx", F.lit(-1)).alias("chapter_idx"), "segments", "duration_ms", "cost_usd", "chars")


_CH = "c as (select distinct * replace (split_part(unique_key, ':', 1) as book_id) from chapter)"


@query(f"""with {_S}, {_CH}, o as (select book_id, unique_key as chapter_key, title, row_number() over (partition by book_id order by sort_order nulls last, unique_key) - 1 as idx from c where coalesce(polish_complete, false)),
 x as (select book_id, chapter_idx, count(*) as segments, string_agg(unique_key, ',' order by paragraph_idx, unique_key) as keys from a group by 1, 2)
select o.book_id, o.chapter_key, o.idx::int as idx, coalesce(x.segments, 0) as segments, coalesce(x.keys, '') as keys from o left join x on x.book_id = o.book_id and x.chapter_idx = o.idx""")
def chapter_audio_ordinal_join(spark, folder):
    """Polished chapters by their place in the book with the segments of that place, in order."""
    c = chapters(spark, folder, "sort_order", "polish_complete").where("polish_complete")
    w = Window.partitionBy("book_id").orderBy(F.col("sort_order").asc_nulls_last(), "unique_key")
    o = c.select("book_id", F.col("unique_key").alias("chapter_key"), (F.row_number().over(w) - 1).alias("idx"))
    x = segments(spark, folder, "book_id", "chapter_idx", "paragraph_idx").groupBy("book_id", F.col("chapter_idx").alias("idx")).agg(
        F.count("*").alias("segments"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_idx", "unique_key"))), lambda r: r["unique_key"]), ",").alias("keys"),
    )
    return o.join(x, ["book_id", "idx"], "left").select("book_id", "chapter_key", "idx", F.coalesce("segments", F.lit(0)).alias("segments"), F.coalesce("keys", F.lit("")).alias("keys"))


@query(f"""with {_S}, o as (select *, coalesce(sum(coalesce(duration_ms, 0)) over (partition by book_id, chapter_idx order by paragraph_idx, unique_key rows between unbounded preceding and 1 preceding), 0)::bigint as st from a)
select book_id, chapter_idx, string_agg(printf('<par id="p%d"><audio clipBegin="%.3fs" clipEnd="%.3fs"/></par>', paragraph_idx, st / 1000.0, (st + coalesce(duration_ms, 0)) / 1000.0), chr(10) order by paragraph_idx, unique_key) as smil,
 printf('%02d:%02d:%02d.%03d', max(st + coalesce(duration_ms, 0)) // 3600000, max(st + coalesce(duration_ms, 0)) // 60000 % 60, max(st + coalesce(duration_ms, 0)) // 1000 % 60, max(st + coalesce(duration_ms, 0)) % 1000) as clock
from o group by 1, 2""")
def smil_lines(spark, folder):
    """Media overlay of every chapter and its length on the clock."""
    s = W.offsets(segments(spark, folder, "book_id", "chapter_idx", "paragraph_idx"), ["book_id", "chapter_idx"], ["paragraph_idx", "unique_key"], "duration_ms", F.floor(F.col("paragraph_idx") / 256))
    end = F.col("offset") + F.coalesce("duration_ms", F.lit(0)).cast("long")
    line = F.concat(F.format_string('<par id="p%d"><audio clipBegin="', "paragraph_idx"), T.smil_time(F.col("offset")), F.lit('" clipEnd="'), T.smil_time(end), F.lit('"/></par>'))
    parts = F.array_sort(F.collect_list(F.struct("paragraph_idx", "unique_key", line.alias("l"))))
    return s.groupBy("book_id", "chapter_idx").agg(F.array_join(F.transform(parts, lambda x: x["l"]), "\n").alias("smil"), T.clock_time(F.max(end)).alias("clock"))


@query("""with m as (select max(created_at) as now from audio_segment), f as (select *, row_number() over (partition by chapter_id order by created_at desc, unique_key desc, coalesce(duration_ms, -1) desc) as n
  from audio_segment, m where created_at > now - interval 60 day)
select chapter_id, string_agg(unique_key, ',' order by n desc) as last_keys, count(*) as fresh from f where n <= 3 group by 1""")
def last3_fresh(spark, folder):
    """The last three fresh segments of every chapter, oldest first; older than sixty days counts as stale."""
    s = table(spark, folder, "audio_segment", "chapter_id", "unique_key", "duration_ms", "created_at")
    now = s.agg(F.max("created_at")).scalar()
    w = Window.partitionBy("chapter_id").orderBy(F.desc("created_at"), F.desc("unique_key"), F.desc(F.coalesce("duration_ms", F.lit(-1))))
    fresh = s.where(F.col("created_at") > now - F.expr("interval 60 days")).withColumn("n", F.row_number().over(w)).where("n <= 3")
    return fresh.groupBy("chapter_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "unique_key"))), lambda x: x["unique_key"]), ",").alias("last_keys"),
        F.count("*").alias("fresh"),
    )


@query(f"""with {_S} select unique_key, ceil(length(coalesce(source_text, '')) / 4.0)::bigint as text_tokens, (strlen(coalesce(source_text, '')) * 60000 // 750)::bigint as expected_ms,
  ((coalesce(duration_ms, 0)::bigint * 50 + 999) // 1000)::bigint as audio_tokens from a""")
def token_estimate(spark, folder):
    """Tokens of text and audio, and the expected length, of every segment."""
    s = segments(spark, folder, "source_text")
    t = blank("source_text")
    return s.select(
        "unique_key",
        F.ceil(F.length(t) / F.lit(4)).alias("text_tokens"),
        F.floor(F.octet_length(t).cast("long") * 60000 / 750).alias("expected_ms"),
        F.floor((F.coalesce("duration_ms", F.lit(0)).cast("long") * 50 + 999) / 1000).alias("audio_tokens"),
    )


_LOG = """log as (select unique_key as k, epoch_us(created_at) * 2 as seq, case when duration_ms is null then 'patch' else 'upsert' end as op, duration_ms as d, char_count as n from audio_segment
  union all select unique_key, epoch_us(created_at) * 2 + 1, 'delete', null, null from audio_segment where duration_ms % 10 = 0 and char_count = 0)"""


@query(f"""with {_LOG}, e as (select k, max(seq) filter (op in ('upsert', 'delete')) as reset, max_by(op, seq) as last from log group by 1)
select log.k as unique_key, coalesce(max_by(d, case when op = 'upsert' or d is not null then seq end), -1) as duration_ms, coalesce(max_by(n, case when op = 'upsert' or n is not null then seq end), -1) as char_count
from log join e using (k) where last <> 'delete' and (reset is null or seq >= reset) and op <> 'delete' group by 1""")
def upsert_replay(spark, folder):
    """State after replaying a log of upserts, patches and deletes."""
    s = table(spark, folder, "audio_segment", "unique_key", "created_at", "duration_ms", "char_count")
    seq = F.unix_micros("created_at") * 2
    log = s.select("unique_key", seq.alias("seq"), F.when(F.col("duration_ms").isNull(), "patch").otherwise("upsert").alias("op"), "duration_ms", "char_count").unionByName(
        s.where("duration_ms % 10 = 0 and char_count = 0").select("unique_key", (seq + 1).alias("seq"), F.lit("delete").alias("op"), F.lit(None).cast("int").alias("duration_ms"), F.lit(None).cast("int").alias("char_count"))
    )
    out = V.replay(log, ["unique_key"], "seq", "op", ["duration_ms", "char_count"])
    return out.select("unique_key", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("duration_ms", "char_count")])


@query("""with b as (select _docid as book_id, page_count, publisher from book), x as (select book_id, max(page_num)::int as page_count from page where book_id is not null group by 1)
select coalesce(b.book_id, x.book_id) as book_id, coalesce(x.page_count, b.page_count) as page_count, coalesce(b.publisher, '') as publisher from b full join x on x.book_id = b.book_id""")
def upsert_merge(spark, folder):
    """Books with the page counts that their pages show put in."""
    b = table(spark, folder, "book", F.col("_docid").alias("book_id"), "page_count", "publisher")
    x = table(spark, folder, "page", "book_id", "page_num").where("book_id is not null").groupBy("book_id").agg(F.max("page_num").alias("page_count"))
    return V.merge(b, x, ["book_id"]).select("book_id", "page_count", blank("publisher").alias("publisher"))


@query("""with d as (select distinct book_id, stage from metric where book_id is not null and coalesce(stage, '') <> ''), t as (select book_id, stage, 'default ' || stage as text from d),
 o as (select t.book_id, stage, 'own ' || publisher as text from t join book on book._docid = t.book_id where publisher is not null and stage like 'toc%')
select t.book_id, t.stage, coalesce(o.text, t.text) as text, o.text is not null as is_override from t left join o on o.book_id = t.book_id and o.stage = t.stage""")
def override_coalesce(spark, folder):
    """Texts by book and stage, a book's own in place of the default."""
    d = table(spark, folder, "metric", "book_id", "stage").where("book_id is not null and stage <> ''").distinct()
    t = d.withColumn("text", F.concat(F.lit("default "), "stage"))
    b = table(spark, folder, "book", F.col("_docid").alias("book_id"), "publisher").where("publisher is not null")
    o = t.where("stage like 'toc%'").join(b, "book_id").select("book_id", "stage", F.concat(F.lit("own "), "publisher").alias("text"))
    return V.overridden(t, o, ["book_id", "stage"], "text").select("book_id", "stage", "text", "is_override")


@query(f"""with {_CH}, e as (select unique_key, coalesce(polished_text, '') as new from c),
 s as (select unique_key, coalesce(mechanical_text, '') as text, case when level = 2 then 'edited' else sha256(coalesce(mechanical_text, '')) end as digest from c where level is not null and start_page is not null)
select e.unique_key, case when s.text is null then 'insert' when sha256(s.text) <> digest then 'skip' when s.text <> new then 'update' else 'none' end as action from e left join s using (unique_key)""")
def prompt_sync_action(spark, folder):
    """Whether a stored text is to be inserted, updated, or left as it was edited."""
    c = chapters(spark, folder, "polished_text", "mechanical_text", "level", "start_page")
    text = blank("mechanical_text")
    stored = c.where("level is not null and start_page is not null").select("unique_key", text.alias("text"), F.when(F.col("level") == 2, "edited").otherwise(F.sha2(text, 256)).alias("digest"))
    return V.sync_action(stored, c.select("unique_key", blank("polished_text").alias("text")), "unique_key")


@query("""with m as (select distinct provider, model from metric where coalesce(provider, '') <> ''), k as (select 'providers.' || provider || '.model' as name, coalesce(model, '') as value from m
  union all select 'providers.' || provider || '.type.kind', 'api' from (select distinct provider from m) union all select 'scheduler.workers', '4')
select split_part(substr(name, 11), '.', 1) as item, regexp_extract(substr(name, 11), '^[^.]+\\.(.+)$', 1) as field, max(value) as value from k where starts_with(name, 'providers.') group by 1, 2""")
def key_pivot(spark, folder):
    """Dotted settings of one prefix by item and field."""
    m = table(spark, folder, "metric", "provider", "model").where("provider <> ''").distinct()
    name = lambda tail: F.concat(F.lit("providers."), "provider", F.lit(tail))
    k = m.select(name(".model").alias("name"), blank("model").alias("value")).unionByName(
        m.select("provider").distinct().select(name(".type.kind").alias("name"), F.lit("api").alias("value"))
    ).unionByName(spark.range(1).select(F.lit("scheduler.workers").alias("name"), F.lit("4").alias("value")))
    return V.pivot_keys(k, "name", "value", "providers.").groupBy("item", "field").agg(F.max("value").alias("value"))


_ROMAN = "case when n <= 0 then '' else repeat('M', n // 1000) || " + " || ".join(
    f"""case n // {u} % 10 when 9 then '{a}{c}' when 4 then '{a}{b}' else repeat('{b}', (n // {u} % 10) // 5) || repeat('{a}', (n // {u} % 10) % 5) end"""
    for u, a, b, c in ((100, "C", "D", "M"), (10, "X", "L", "C"), (1, "I", "V", "X"))
) + " end"


@query(f"with p as (select distinct page_num as n from page where page_num is not null) select n, {_ROMAN} as numeral, n as back from p")
def roman_sequence(spark, folder):
    """Page numbers as Roman numerals and back."""
    p = table(spark, folder, "page", F.col("page_num").alias("n")).where("n is not null").distinct()
    return p.withColumn("numeral", N.int_to_roman(F.col("n"))).withColumn("back", N.roman_to_int(F.col("numeral")))


@query("""select page_id, provider, json_extract_string(provider_metadata, '$.dpi')::int as dpi, count(*) as readings from (select distinct * from ocr_result)
where provider_metadata is not null and json_extract_string(provider_metadata, '$.dpi') is not null group by 1, 2, 3""")
def json_fields(spark, folder):
    """A field of the JSON that providers send."""
    o = table(spark, folder, "ocr_result").distinct().select("page_id", "provider", F.get_json_object("provider_metadata", "$.dpi").cast("int").alias("dpi"))
    return o.where("dpi is not null").groupBy("page_id", "provider", "dpi").agg(F.count("*").alias("readings"))


@query("""with f as (select 'book-' || page_num || '.pdf' as path, page_num from (select distinct page_num from page where page_num is not null))
select path, row_number() over (order by page_num, path) as place, 'book' as file_title from f""")
def natural_sort(spark, folder):
    """Numbered files in the order of their numbers, and their title."""
    f = table(spark, folder, "page", "page_num").where("page_num is not null").distinct().select(F.concat(F.lit("book-"), F.col("page_num").cast("string"), F.lit(".pdf")).alias("path"))
    n = F.regexp_extract("path", r"-(\d+)\.[^.]*$", 1)
    w = Window.orderBy(F.nullif(n, F.lit("")).cast("int").asc_nulls_first(), "path")  # one row for each page number
    return f.select("path", F.row_number().over(w).cast("long").alias("place"), T.file_title(F.col("path")).alias("file_title"))


@query("""with f as (select _docid as book_id, 1 + row_number() over (partition by status order by _docid) as k, status, page_count from book)
select status, book_id, (1 + coalesce(sum(page_count) over (partition by status order by book_id rows between unbounded preceding and 1 preceding), 0))::bigint as first_page,
 (sum(page_count) over (partition by status order by book_id rows unbounded preceding))::bigint as last_page from f""")
def cumulative_ranges(spark, folder):
    """Books of each status laid end to end: the range of pages each takes."""
    b = table(spark, folder, "book", F.col("_docid").alias("book_id"), "status", "page_count")
    # Statuses are few: books are laid end to end by the beginnings of their ids.
    o = W.offsets(b, ["status"], ["book_id"], "page_count", F.left("book_id", F.lit(6)))
    return o.select("status", "book_id", (F.col("offset") + 1).alias("first_page"), (F.col("offset") + F.col("page_count")).cast("long").alias("last_page"))


@query("""with f as (select _docid as book_id, status, page_count, (1 + coalesce(sum(page_count) over (partition by status order by _docid rows between unbounded preceding and 1 preceding), 0))::bigint as a,
 (sum(page_count) over (partition by status order by _docid rows unbounded preceding))::bigint as z from book), q as (select distinct page_num * 10 as page from page where page_num is not null)
select q.page, f.status, f.book_id, q.page - f.a + 1 as page_in_book from q join f on q.page between f.a and f.z""")
def pdf_range_lookup(spark, folder):
    """The book, and the page in it, of pages counted through all books of a status. Ranges are cut into
    blocks of a hundred pages, so pages meet them by equality."""
    b = cumulative_ranges(spark, folder)
    block = lambda c: F.floor(c / F.lit(100))
    r = b.withColumn("block", F.explode(F.sequence(block(F.col("first_page")), block(F.col("last_page")))))
    q = table(spark, folder, "page", "page_num").where("page_num is not null").select((F.col("page_num") * 10).alias("page")).distinct()
    hit = q.withColumn("block", block(F.col("page"))).join(r, "block").where(F.col("page").between(F.col("first_page"), F.col("last_page")))
    return hit.select("page", "status", "book_id", (F.col("page") - F.col("first_page") + 1).alias("page_in_book"))
