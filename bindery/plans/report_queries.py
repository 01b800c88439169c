"""Reports of searches, texts of chapters, and texts and structures as JSON; with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import text as T
from ..operators import pages as P
from ..operators import reports as R
from ..operators import windows as W
from ..sources import files, sinks
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


_P = "p as (select distinct _docid, book_id, page_num, ocr_markdown, header, footer, ocr_complete from page)"


def _patterns(category: str) -> list[str]:
    """The patterns of a category as DuckDB's engine reads them."""
    edged = [rf"\b{w}" + ("" if w.endswith(r"\d+") else r"\b") for w in P.KEYWORDS[category]]
    return [f"(?mi){x}".replace("'", "''") for x in edged + [f"^{w}" for w in P.LINE_KEYWORDS.get(category, [])]]


def _hits(where: str) -> str:
    one = lambda c: "list_sort(list_distinct(flatten([" + ", ".join(f"regexp_extract_all(ocr_markdown, '{x}')" for x in _patterns(c)) + "])))"
    parts = " union all ".join(f"select book_id, page_num, '{c}' as category, {one(c)} as words from p join b using (book_id) where {where}" for c in P.KEYWORDS)
    return f"k as (select * from ({parts}) where len(words) > 0)"


_FIRST = "ocr_markdown is not null and page_num between 1 and least(50, page_count)"


@query(f"with {_P}, {_BK}, {_hits('ocr_markdown is not null')} select book_id, page_num, category, array_to_string(words, '|') as keywords from k")
def keyword_categories(spark, folder):
    """Words that tell the parts of a book, by page and category."""
    p = pages(spark, folder, "ocr_markdown").where("ocr_markdown is not null").join(books(spark, folder).select("book_id"), "book_id", "left_semi")
    hits = p.select("book_id", "page_num", F.explode(P.keyword_hits(F.col("ocr_markdown"))).alias("h"))
    return hits.select("book_id", "page_num", "h.category", F.array_join("h.keywords", "|").alias("keywords"))


def _keyword_report(spark, folder):
    b = books(spark, folder)
    p = pages(spark, folder, "ocr_markdown").join(b, "book_id")
    return R.keyword_report(b, p, R.keyword_pages(p))


_FACTS = f"""{_hits(_FIRST)},
 h as (select distinct book_id, page_num from p join b using (book_id) where {_FIRST}),
 w as (select book_id, unnest(range(1, least(50, page_count) + 1)) as page_num from b),
 s as (select distinct book_id, page_num from k where category = 'structure'),
 g as (select *, case when page_num - lag(page_num) over (partition by book_id order by page_num) > 2 then 1 else 0 end as n from s),
 r as (select *, sum(n) over (partition by book_id order by page_num) as run from g),
 cl as (select book_id, min(page_num) as a, max(page_num) as z, count(*) as n from r group by book_id, run having count(*) >= 3),
 cs as (select book_id, list(struct_pack(a := a, z := z, n := n) order by a) as cl from cl group by 1),
 f as (select b.book_id, least(50, page_count) as searched, (select count(*) from h where h.book_id = b.book_id) as with_data,
   coalesce((select list(w.page_num order by w.page_num) from w anti join h on h.book_id = w.book_id and h.page_num = w.page_num where w.book_id = b.book_id), []) as failed,
   {', '.join(f"coalesce((select list(page_num order by page_num) from (select distinct book_id, page_num from k where category = '{c}') x where x.book_id = b.book_id), []) as {c}" for c in P.KEYWORDS)},
   coalesce(cs.cl, []) as cl from b left join cs on cs.book_id = b.book_id)"""
_LISTS = f"{_P}, {_BK}, {_FACTS}"
_SHOW = "'[' || array_to_string({0}, ' ') || ']'"


@query(f"""with {_LISTS} select book_id, searched, with_data, {_SHOW.format('failed')} as failed, {', '.join(f"{_SHOW.format(c)} as {c}" for c in P.KEYWORDS)},
 array_to_string(list_transform(cl, lambda x: x.a || '-' || x.z || ':' || x.n), ' ') as clusters from f""")
def keyword_report(spark, folder):
    """What a search of the first fifty pages of every book for words of its parts finds, and which pages can't be searched."""
    r = _keyword_report(spark, folder)
    clusters = F.array_join(F.transform("clusters", lambda c: F.format_string("%d-%d:%d", c["first"], c["last"], c["size"])), " ")
    return r.select("book_id", "searched", F.col("with_data").cast("long").alias("with_data"), *[R.listed(F.col(c)).alias(c) for c in ("failed", *P.KEYWORDS)], F.coalesce(clusters, F.lit("")).alias("clusters"))


_MORE = _SHOW.format("{0}[1:5]") + " || case when len({0}) > 5 then chr(10) || '  (+' || (len({0}) - 5) || ' more)' else '' end"


_SUMMARY = f"""select book_id, 'Searched: 1-' || searched || ' (' || with_data || ' pages with OCR data)' || chr(10)
 || case when len(failed) > 0 then chr(10) || '⚠️  WARNING: ' || len(failed) || ' pages missing OCR data: ' || {_SHOW.format('failed')} || chr(10) || '   These pages could not be searched - ToC might be on an unsearched page!' || chr(10) else '' end
 || chr(10) || case when len(toc) + len(structure) + len(front_matter) + len(back_matter) = 0 then 'No keywords found in searchable pages.'
   || case when len(failed) > 0 then chr(10) || 'Consider visually checking failed pages - they may contain ToC.' else '' end
 else case when len(toc) > 0 then '✓ TOC KEYWORDS: pages ' || {_SHOW.format('toc')} || chr(10) || '  → Check these pages first (direct ToC indicators)' || chr(10) || chr(10) else '' end
 || case when len(structure) > 0 and len(cl) > 0 then '✓ STRUCTURE CLUSTERING: ' || len(cl) || ' cluster(s) found' || chr(10) || array_to_string(list_transform(cl, lambda x: '  → Pages ' || x.a || '-' || x.z || ' (' || x.n || ' pages)'), chr(10))
     || chr(10) || '  Note: Dense clustering of Chapter/Part = likely ToC listing' || chr(10) || chr(10)
   when len(structure) > 0 then '• Structure keywords: scattered across ' || len(structure) || ' pages (not clustered)' || chr(10) || chr(10) else '' end
 || case when len(front_matter) > 0 then '• Front matter: pages ' || {_MORE.format('front_matter')} || chr(10) || chr(10) else '' end
 || case when len(back_matter) > 0 then '• Back matter: pages ' || {_MORE.format('back_matter')} || chr(10) || chr(10) else '' end
 || 'RECOMMENDATION:' || case when len(toc) > 0 then chr(10) || '  Start with TOC keyword pages' when len(structure) > 0 then case when len(cl) > 0 then chr(10) || '  Check structure cluster: pages ' || cl[1].a || '-' || cl[1].z else '' end
   when len(front_matter) > 0 then chr(10) || '  Scan front matter region around pages ' || {_SHOW.format('front_matter[1:3]')} else chr(10) || '  Sequential scan of front matter (pages 1-20)' end end as summary from f"""


@query(f"with {_LISTS} {_SUMMARY}")
def keyword_summary(spark, folder):
    """The report in words, with what to look at first."""
    return R.keyword_summary(_keyword_report(spark, folder))


_NOTES = """p as (select book_id, row_number() over (partition by book_id order by doc_id)::int as page_num, text as ocr_markdown from documents where book_id is not null),
 b as (select book_id, count(*)::int as page_count from documents where book_id is not null group by 1)"""


def _notes(spark, folder):
    """The documents of a book as if they were its pages."""
    d = table(spark, folder, "documents", "doc_id", "book_id", F.col("text").alias("ocr_markdown")).where("book_id is not null")
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("doc_id"))
    b = d.groupBy("book_id").agg(F.count("*").cast("int").alias("page_count"))
    return b, d.select("book_id", place.alias("page_num"), "ocr_markdown").join(b, "book_id")


@query(f"with {_NOTES}, {_hits('ocr_markdown is not null')} select book_id, page_num, category, array_to_string(words, '|') as keywords from k")
def document_keywords(spark, folder):
    """Words that tell the parts of a book, in the documents of every book."""
    _, p = _notes(spark, folder)
    hits = p.select("book_id", "page_num", F.explode(P.keyword_hits(F.col("ocr_markdown"))).alias("h"))
    return hits.select("book_id", "page_num", "h.category", F.array_join("h.keywords", "|").alias("keywords"))


@query(f"with {_NOTES}, {_FACTS} {_SUMMARY}")
def document_keyword_summary(spark, folder):
    """The report in words over the documents of every book."""
    b, p = _notes(spark, folder)
    return R.keyword_summary(R.keyword_report(b, p, R.keyword_pages(p)))


_MATCHES = "g as (select book_id, page_num, len(regexp_extract_all(ocr_markdown, '(?i)harbour')) as n from p where regexp_matches(ocr_markdown, '(?i)harbour'))"


@query(f"""with {_P}, {_CH}, {_MATCHES}, x as (select book_id, start_page as xs, end_page as xe from c where matter_type = 'back_matter' and end_page >= start_page),
 e as (select g.*, exists (select 1 from x where x.book_id = g.book_id and g.page_num between xs and xe) as ex from g),
 f as (select *, case when page_num - lag(page_num) over (partition by book_id order by page_num) > 3 then 1 else 0 end as nw from (select distinct book_id, page_num from e where not ex)),
 r as (select *, sum(nw) over (partition by book_id order by page_num) as run from f),
 cl as (select book_id, min(page_num) as a, max(page_num) as z, count(*) as n from r group by book_id, run having count(*) >= 2),
 cs as (select book_id, list(struct_pack(a := a, z := z, n := n) order by a) as cl from cl group by 1),
 t as (select e.book_id, count(*) as pages, sum(n)::bigint as matches, count(*) filter (ex) as excluded from e group by 1)
select t.book_id, pages, matches, excluded, coalesce(len(cl), 0)::int as clusters,
 array_to_string(list_filter([case when len(cl) > 0 then 'CLUSTERS DETECTED: ' || len(cl) || ' dense cluster(s)' || chr(10) || array_to_string(list_transform(cl, lambda x: '  → Pages ' || x.a || '-' || x.z || ' (' || x.n || ' pages) - first page is likely chapter start'), chr(10)) end,
  case when excluded > 0 then chr(10) || '⚠️ NOTE: ' || excluded || ' of ' || pages || ' matches are in EXCLUDED ranges (back matter) - ignore those' end,
  case when excluded = pages then chr(10) || 'All matches are in excluded ranges. Try different query variations.' end,
  case when pages = 1 then chr(10) || case when excluded > 0 then 'Single match is in excluded range - likely not the chapter start' else 'Single isolated match - verify with OCR/vision' end end], lambda x: x is not null), chr(10)) as summary,
 'Found ' || matches || ' matches across ' || pages || ' pages' as message from t left join cs on cs.book_id = t.book_id""")
def search_summary(spark, folder):
    """What a search of every book for a pattern finds, in numbers and words, matches in back matter apart."""
    p = pages(spark, folder, "ocr_markdown").select("book_id", "page_num", F.regexp_count("ocr_markdown", F.lit("(?i)harbour")).cast("long").alias("matches")).where("matches > 0")
    back = chapters(spark, folder, "matter_type", "start_page", "end_page").where("matter_type = 'back_matter' and end_page >= start_page")
    return R.search_report(p, back.select("book_id", "start_page", "end_page"))


_LENGTHS = "list_sum(list_transform(parts[1:{0}], lambda x: length(x))) + 7 * ({0} - 1)"


@query(f"""with {_P}, s as (select _docid, ocr_markdown as t, string_split_regex(ocr_markdown, '(?i)harbour') as parts from p where regexp_matches(ocr_markdown, '(?i)harbour')),
 e as (select _docid, t, parts, unnest(range(1, least(4, len(parts)))) as n from s), x as (select _docid, n, t, ({_LENGTHS.format('n')})::int as pos from e)
select _docid, (n - 1)::int as n, '...' || trim(regexp_replace(t[greatest(pos - 50, 0) + 1 : pos + 57], '\\s+', ' ', 'g')) || '...' as snippet from x""")
def grep_snippets(spark, folder):
    """Up to three snippets on each page: the matches of a pattern with fifty characters on both sides."""
    p = pages(spark, folder, "ocr_markdown").where(F.col("ocr_markdown").rlike("(?i)harbour"))
    near = T.snippets(F.col("ocr_markdown"), "(?i)harbour")
    shown = F.transform(near, lambda x: F.concat(F.lit("..."), F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit("...")))
    return p.select("_docid", F.posexplode(shown).alias("n", "snippet"))


_NORM = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
_FURN = "(strlen(trim(x)) < 50 and trim(x) <> '' and (contains(x, '/') or regexp_matches(trim(replace(x, '*', '')), '^[0-9]{1,4}$')))"


@query(f"""with {_P}, {_CH}, s as (select *, string_split(array_to_string(list_filter(string_split(ocr_markdown, chr(10)), lambda x:
  not (({_NORM.format("coalesce(header, '')")} <> '' and {_NORM.format('x')} = {_NORM.format("coalesce(header, '')")})
    or ({_NORM.format("coalesce(footer, '')")} <> '' and {_NORM.format('x')} = {_NORM.format("coalesce(footer, '')")}))), chr(10)), chr(10)) as l from p),
 f as (select *, list_position(list_transform(l[1:3], lambda x: {_FURN}), true) as k from s),
 d as (select *, regexp_replace(array_to_string(case when k > 0 then list_concat(l[1:k-1], l[k+1:]) else l end, chr(10)), '^\\s+|\\s+$', '', 'g') as body from f),
 x as (select c.unique_key, d.page_num, regexp_replace(coalesce(case when coalesce(body, '') = '' then ocr_markdown else body end, ''), '^\\s+|\\s+$', '', 'g') as t from c join d on d.book_id = c.book_id and d.page_num between start_page and end_page),
 y as (select *, lag(t) over w as before, lead(t) over w as after from x where t <> '' window w as (partition by unique_key order by page_num)),
 z as (select *, case when before is null then '' when regexp_matches(before, '[a-z]-$') then '' when regexp_matches(before, '[.!?"'']$') then chr(10) || chr(10) else ' ' end as pre,
   case when after is not null and regexp_matches(t, '[a-z]-$') then left(t, length(t) - 1) else t end as body2 from y)
select unique_key, string_agg(pre || body2, '' order by page_num) as text from z group by 1""")
def chapter_texts(spark, folder):
    """The text of every chapter from its pages: headers and footers off, then the furniture of the first lines; the page as it was
    if nothing is left; joined."""
    c = chapters(spark, folder, "start_page", "end_page").select("unique_key", F.col("book_id"), "start_page", "end_page")
    p = pages(spark, folder, "ocr_markdown", "header", "footer")
    clean = T.clean_page_text(T.strip_header_footer(F.col("ocr_markdown"), F.col("header"), F.col("footer")))
    cleaned = p.select("book_id", "page_num", F.coalesce(F.nullif(clean, F.lit("")), "ocr_markdown").alias("t"))
    joined = W.in_ranges(cleaned, "page_num", c, "start_page", "end_page", ["book_id"])
    return P.merged_text(joined, ["unique_key"], "page_num", "t").withColumnRenamed("merged", "text")


@query("""with p as (select _docid, any_value(headings) as h from page group by 1) select _docid, coalesce(to_json(h)::varchar, '') as json from p""")
def headings_json(spark, folder):
    """The headings stored with every page as JSON."""
    p = table(spark, folder, "page", "_docid", "headings").groupBy("_docid").agg(F.any_value("headings").alias("h"))
    return p.select("_docid", F.coalesce(F.to_json("h", {"ignoreNullFields": "false"}), F.lit("")).alias("json"))


@query("""with o as (select distinct page_id, provider, provider_metadata as j from ocr_result)
select page_id, provider, case when j is null then 'nothing to check' when not json_valid(j) then 'no JSON' when json_type(j, '$.dpi') is null then '$.dpi: missing'
 when json_type(j, '$.dpi') not in ('UBIGINT', 'BIGINT') then '$.dpi: not integer' when json_type(j, '$.leaf') is not null and json_type(j, '$.leaf') not in ('UBIGINT', 'BIGINT') then '$.leaf: not integer' else '' end as fault from o""")
def schema_faults(spark, folder):
    """The first fault of what providers send against a schema, '' if there is none."""
    o = table(spark, folder, "ocr_result", "page_id", "provider", "provider_metadata").distinct()
    schema = {"name": "reading", "schema": {"type": "object", "required": ["dpi"], "properties": {"dpi": {"type": "integer"}, "leaf": {"type": "integer"}}}}
    fault = J.schema_fault(F.col("provider_metadata"), schema)
    return o.select("page_id", "provider", F.when(F.col("provider_metadata").isNull(), "nothing to check").otherwise(fault).alias("fault"))


@query("""select to_json({'_docid': _docid, 'title': title, 'author': coalesce(author, ''), 'page_count': page_count, 'status': status})::varchar as json from book""")
def books_json(spark, folder):
    """Every book as one JSON text."""
    return sinks.as_json(table(spark, folder, "book", "_docid", "title", blank("author").alias("author"), "page_count", "status"))


@query("""with s as (select distinct book_id, chapter_idx, paragraph_idx from audio_segment where paragraph_idx is not null)
select book_id, chapter_idx, string_agg(printf('segment_%04d.mp3', paragraph_idx), ' ' order by printf('segment_%04d.mp3', paragraph_idx)) as files, max(paragraph_idx) + 1 = count(*) and min(paragraph_idx) = 0 as complete from s group by 1, 2""")
def segment_files(spark, folder):
    """The files of every chapter's segments in the order in which they are put together, and whether none is missing."""
    s = table(spark, folder, "audio_segment", "book_id", "chapter_idx", "paragraph_idx").where("paragraph_idx is not null").distinct()
    name = F.format_string("segment_%04d.mp3", "paragraph_idx")
    return s.groupBy("book_id", "chapter_idx").agg(
        F.array_join(F.array_sort(F.collect_list(name)), " ").alias("files"), ((F.max("paragraph_idx") + 1 == F.count("*")) & (F.min("paragraph_idx") == 0)).alias("complete")
    )


@query(f"""with {_P}, t as (select _docid, '![a](img-0.jpeg) ' || coalesce(ocr_markdown, '') || ' ![b](img-0.jpeg) ![c](img-1.png)' as x from p)
select _docid, replace(replace(regexp_replace(regexp_replace(x, '\\(img-0\\.jpeg\\)', '(/out/' || _docid || '/img-0.jpeg)'), '\\(img-1\\.png\\)', '(/out/' || _docid || '/img-1.png)'), '', ''), '', '') as text from t""")
def images_placed(spark, folder):
    """Texts whose images were saved: the first reference to each image names its file."""
    t = F.concat(F.lit("![a](img-0.jpeg) "), blank("ocr_markdown"), F.lit(" ![b](img-0.jpeg) ![c](img-1.png)"))
    p = pages(spark, folder, "ocr_markdown").select("_docid", t.alias("text"), F.array(F.lit("img-0.jpeg"), F.lit("img-1.png")).alias("images"))
    return p.select("_docid", files.image_paths(F.col("text"), F.col("images"), F.concat(F.lit("/out/"), "_docid")).alias("text"))


@query("""with c as (select distinct unique_key, title, level_name from chapter), t as (select unique_key, '{{ .' || replace(coalesce(level_name, 'none'), ' ', '_') || ' }} of {{.Title}} {{- .Title }} {{ x }} {{.Book.Name}}' as body from c)
select unique_key, array_to_string(list_sort(list_distinct(regexp_extract_all(body, '\\{\\{-?\\s*\\.([A-Za-z_][A-Za-z0-9_]*)', 1))), ',') as names, sha256(body) as digest from t""")
def template_names(spark, folder):
    """Names that templates ask for, and their digests."""
    name = F.replace(F.coalesce("level_name", F.lit("none")), F.lit(" "), F.lit("_"))
    body = F.concat(F.lit("{{ ."), name, F.lit(" }} of {{.Title}} {{- .Title }} {{ x }} {{.Book.Name}}"))
    c = table(spark, folder, "chapter", "unique_key", "title", "level_name").distinct().select("unique_key", body.alias("body"))
    return c.select("unique_key", F.array_join(T.template_variables(F.col("body")), ",").alias("names"), F.sha2("body", 256).alias("digest"))


@query("""select page_id, provider, case when raw in ('high', 'medium') then raw else 'low' end as level from (select distinct page_id, provider,
 case when confidence is null then 'unknown' when confidence >= 0.9 then 'high' when confidence >= 0.8 then 'medium' when confidence >= 0.7 then 'HIGH' else 'low' end as raw from ocr_result)""")
def confidence_words(spark, folder):
    """Confidence as said in words; whatever isn't known is low."""
    c = F.col("confidence")
    raw = F.when(c.isNull(), "unknown").when(c >= 0.9, "high").when(c >= 0.8, "medium").when(c >= 0.7, "HIGH").otherwise("low")
    return table(spark, folder, "ocr_result", "page_id", "provider", raw.alias("raw")).distinct().select("page_id", "provider", T.confidence(F.col("raw")).alias("level"))
