"""Queries over the call log, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from ..sources.tables import blank, metrics, table, zero

QUERIES, SQL = {}, {}

_ONCE = "with m as (select distinct * from metric)\n"
_MONEY = "coalesce(sum(cast(coalesce({0}, 0) as decimal(18,6))), 0)::double"
_COST, _TIME = _MONEY.format("cost_usd"), _MONEY.format("total_seconds")
_TOKENS = "coalesce(sum(coalesce({0}, 0)), 0)::bigint"
_SUMMARY = f"""count(*) as count, {_COST} as total_cost_usd, {_TOKENS.format("total_tokens")} as total_tokens,
  {_TIME} as total_time_seconds, count(*) filter (coalesce(success, false)) as success_count,
  count(*) filter (not coalesce(success, false)) as error_count, round({_COST} / count(*), 6) as avg_cost_usd,
  round({_TOKENS.format("total_tokens")}::double / count(*), 6) as avg_tokens, round({_TIME} / count(*), 6) as avg_time_seconds"""
_DETAILS = f"""{_SUMMARY}, {', '.join(f"{_TOKENS.format(k + '_tokens')} as sum_{k}_tokens" for k in ('prompt', 'completion', 'reasoning'))},
  coalesce(round(min(t), 6), 0) as latency_min, coalesce(round(max(t), 6), 0) as latency_max,
  coalesce(round(sum(cast(t as decimal(18,6)))::double / count(t), 6), 0) as latency_avg,
  {', '.join(f"coalesce(round(quantile_cont(t, {p / 100}), 6), 0) as latency_p{p}" for p in (50, 95, 99))}"""
_TIMED = "select *, case when total_seconds > 0 then total_seconds end as t from m"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(_ONCE + """select _docid, book_id, stage, provider, coalesce(cost_usd, 0) as cost_usd, epoch_us(created_at) as created_us from m
where stage = 'ocr' and provider = 'inkscan' and coalesce(success, false)
  and created_at > timestamptz '2025-03-01 00:00:00+00' and created_at < timestamptz '2025-09-01 00:00:00+00'""")
def metric_list_filtered(spark, folder):
    """Calls by equality filters, success and strict time bounds."""
    log = table(spark, folder, "metric")
    found = M.matching(log, "2025-03-01T00:00:00Z", "2025-09-01T00:00:00Z", True, stage="ocr", provider="inkscan").dropDuplicates(["_docid"])
    return found.select("_docid", "book_id", "stage", "provider", zero("cost_usd").alias("cost_usd"), F.unix_micros("created_at").alias("created_us"))


@query(_ONCE + "select _docid, epoch_us(created_at) as created_us, coalesce(cost_usd, 0) as cost_usd from m order by created_at desc, _docid limit 100 offset 50")
def llmcall_page(spark, folder):
    """One page of the log, newest first, with limit and offset over a total order."""
    m = metrics(spark, folder).select("_docid", F.unix_micros("created_at").alias("created_us"), zero("cost_usd").alias("cost_usd"))
    return m.orderBy(F.desc("created_us"), "_docid").offset(50).limit(100)


@query("""select blank as stage, epoch_us(min(created_at)) as first_us, epoch_us(max(created_at)) as last_us
from (select coalesce(stage, '') as blank, created_at from metric) group by blank""")
def metric_time_bounds(spark, folder):
    m = table(spark, folder, "metric", "stage", "created_at")
    return m.groupBy(blank("stage").alias("stage")).agg(F.unix_micros(F.min("created_at")).alias("first_us"), F.unix_micros(F.max("created_at")).alias("last_us"))


@query(_ONCE + f"select {_COST} as total_cost_usd, {_TOKENS.format('total_tokens')} as total_tokens, {_TIME} as total_time_seconds from m")
def total_cost(spark, folder):
    return metrics(spark, folder).agg(*M.totals())


@query(_ONCE + f"select {_SUMMARY} from m")
def summary(spark, folder):
    return metrics(spark, folder).agg(*M.summary())


@query(_ONCE + f"select coalesce(book_id, '') as book_id, {_DETAILS} from ({_TIMED}) group by 1")
def detailed_stats(spark, folder):
    """All statistics of every book."""
    return M.details(metrics(spark, folder), blank("book_id").alias("book_id"))


@query(_ONCE + f"""select case when stage = 'ocr' and coalesce(provider, '') <> '' then 'ocr:' || provider else stage end as stage_key,
  {_DETAILS} from ({_TIMED}) where coalesce(stage, '') <> '' group by 1""")
def stage_detailed_stats(spark, folder):
    """All statistics of every stage, recognition by provider; calls without stage are left out."""
    return M.details(metrics(spark, folder, blank("stage") != ""), M.stage_key().alias("stage_key"))


def _by(key: str):
    @query(_ONCE + f"select coalesce({key}, '') as {key}, {_COST} as cost_usd from m group by 1")
    def cost(spark, folder):
        return metrics(spark, folder).groupBy(blank(key).alias(key)).agg(M.exact_sum("cost_usd").alias("cost_usd"))

    QUERIES[f"cost_by_{key}"], SQL[f"cost_by_{key}"] = QUERIES.pop("cost"), SQL.pop("cost")


for _key in ("stage", "provider", "model"):
    _by(_key)


@query(_ONCE + f"""select case when grouping(s) = 0 then 'stage' when grouping(p) = 0 then 'provider' when grouping(o) = 0 then 'model' else 'total' end as breakdown,
  coalesce(s, p, o, '') as value, {_COST} as cost_usd, count(*) as calls
from (select coalesce(stage, '') as s, coalesce(provider, '') as p, coalesce(model, '') as o, cost_usd from m)
group by grouping sets ((s), (p), (o), ())""")
def cost_rollup_total(spark, folder):
    """Cost by stage, by provider, by model and in total."""
    return M.breakdown(metrics(spark, folder), "stage", "provider", "model")


@query(_ONCE + f"select coalesce(book_id, '') as book_id, coalesce(stage, '') as stage, {_COST} as cost_usd, count(*) as calls from m group by 1, 2")
def book_stage_cost(spark, folder):
    return metrics(spark, folder).groupBy(blank("book_id").alias("book_id"), blank("stage").alias("stage")).agg(
        M.exact_sum("cost_usd").alias("cost_usd"), F.count("*").alias("calls")
    )


@query(_ONCE + """select book_id, stage, cost_usd, sum(cost) over (partition by book_id)::double as book_cost from (
  select book_id, stage, sum(cast(cost_usd as decimal(18,6)))::double as cost_usd, sum(cast(cost_usd as decimal(18,6))) as cost
  from m where coalesce(stage, '') <> '' and cost_usd > 0 and book_id is not null group by 1, 2)""")
def book_cost_cache(spark, folder):
    """Cost by book and stage of calls that have a stage and cost anything, with the book's total."""
    from pyspark.sql import Window

    cost = F.sum(F.col("cost_usd").cast("decimal(18,6)"))
    by = metrics(spark, folder, (blank("stage") != "") & (F.col("cost_usd") > 0) & F.col("book_id").isNotNull())
    return by.groupBy("book_id", "stage").agg(cost.alias("cost")).select(
        "book_id",
        "stage",
        F.col("cost").cast("double").alias("cost_usd"),
        F.sum("cost").over(Window.partitionBy("book_id")).cast("double").alias("book_cost"),
    )


@query(_ONCE + "select coalesce(book_id, '') as book_id, coalesce(model, '') as model, count(*) as calls from m where coalesce(total_tokens, 0) > 0 group by 1, 2")
def llmcall_counts(spark, folder):
    """Calls of language models by book and model."""
    return metrics(spark, folder, zero("total_tokens") > 0).groupBy(blank("book_id").alias("book_id"), blank("model").alias("model")).agg(
        F.count("*").alias("calls")
    )


_GROUPS = {"toc": ["toc", "toc-link", "toc-discover", "toc-validate"], "structure": ["structure-classify", "structure-polish"]}


@query(_ONCE + f"""select coalesce(book_id, '') as book_id, case when stage in ('toc', 'toc-link', 'toc-discover', 'toc-validate') then 'toc'
  when stage in ('structure-classify', 'structure-polish') then 'structure' else coalesce(stage, '') end as stage_group, {_COST} as cost_usd from m group by 1, 2""")
def cost_stage_groups(spark, folder):
    """Cost by book with stages folded into groups."""
    group = blank("stage")
    for name, stages in _GROUPS.items():
        group = F.when(F.col("stage").isin(stages), name).otherwise(group)
    return metrics(spark, folder).groupBy(blank("book_id").alias("book_id"), group.alias("stage_group")).agg(M.exact_sum("cost_usd").alias("cost_usd"))


@query(_ONCE + """select output_doc_id, output_cid, min_by(_docid, (created_at, _docid)) as _docid, count(*) as calls from m
where output_doc_id is not null group by 1, 2""")
def metric_for_output(spark, folder):
    """The first call that made each version of a document."""
    m = metrics(spark, folder, "output_doc_id is not null")
    return m.groupBy("output_doc_id", "output_cid").agg(
        F.min_by("_docid", F.struct("created_at", "_docid")).alias("_docid"), F.count("*").alias("calls")
    )


@query(_ONCE + """, c as (select distinct _docid as chapter_id, split_part(unique_key, ':', 1) as book, title from chapter),
p as (select cast(coalesce(cost_usd, 0) as decimal(18,6)) as cost, case when instr(item_key, '_para_') > 1 then left(item_key, instr(item_key, '_para_') - 1) else '' end as k
      from m where stage in ('tts', 'structure-polish'))
select coalesce(c.chapter_id, '') as chapter_id, max(c.title) as title, sum(cost)::double as cost_usd, count(*) as calls
from p left join c on c.chapter_id = p.k group by 1""")
def metric_chapter_attribution(spark, folder):
    """Cost of two stages by the chapter their item keys name; calls of no chapter stay under ''."""
    calls = metrics(spark, folder, F.col("stage").isin("tts", "structure-polish")).select(
        zero("cost_usd").cast("decimal(18,6)").alias("cost"), F.coalesce(T.key_prefix(F.col("item_key")), F.lit("")).alias("k")
    )
    by_key = calls.groupBy("k").agg(F.sum("cost").alias("cost"), F.count("*").alias("calls"))
    chapters = table(spark, folder, "chapter", "_docid", "title").groupBy("_docid").agg(F.max("title").alias("title"))
    joined = by_key.join(chapters, by_key["k"] == chapters["_docid"], "left")
    return joined.groupBy(F.coalesce("_docid", F.lit("")).alias("chapter_id")).agg(
        F.max("title").alias("title"), F.sum("cost").cast("double").alias("cost_usd"), F.sum("calls").alias("calls")
    )


@query(_ONCE + """select job_id, count(*) as calls, epoch_us(min(created_at)) as started_us, epoch_us(max(created_at)) as completed_us,
  (floor(epoch(max(created_at))) - floor(epoch(min(created_at))))::bigint as duration_seconds from m where job_id is not null group by 1""")
def job_spans(spark, folder):
    """First and last call of every job and the seconds between."""
    return metrics(spark, folder, "job_id is not null").groupBy("job_id").agg(
        F.count("*").alias("calls"),
        F.unix_micros(F.min("created_at")).alias("started_us"),
        F.unix_micros(F.max("created_at")).alias("completed_us"),
        (F.unix_seconds(F.max("created_at")) - F.unix_seconds(F.min("created_at"))).alias("duration_seconds"),
    )


@query("""select _docid, epoch_us(created_at) as created_us, coalesce(stage, '') as stage, coalesce(total_seconds, 0) as total_seconds from (select distinct * from metric) where success is not true
order by created_at desc, _docid limit 20""")
def recent_runs_topk(spark, folder):
    """The twenty newest calls that didn't succeed."""
    failed = metrics(spark, folder, ~F.coalesce("success", F.lit(False)))
    shown = failed.select("_docid", F.unix_micros("created_at").alias("created_us"), blank("stage").alias("stage"), zero("total_seconds").alias("total_seconds"))
    return shown.orderBy(F.desc("created_us"), "_docid").limit(20)


@query(_ONCE + """select coalesce(error_type, '') as error_type, coalesce(provider, '') as provider, count(*) as calls from m
where stage in ('toc', 'tts') and success is not true group by 1, 2""")
def stage_union(spark, folder):
    """Failed calls of two stages together, by kind of error and provider."""
    m = metrics(spark, folder, F.col("stage").isin("toc", "tts") & ~F.coalesce("success", F.lit(False)))
    both = m.where(F.col("stage") == "toc").unionByName(m.where(F.col("stage") == "tts"))
    return both.groupBy(blank("error_type").alias("error_type"), blank("provider").alias("provider")).agg(F.count("*").alias("calls"))


@query(_ONCE + """select coalesce(provider, '') as provider,
  case when sum(coalesce(total_tokens, 0)) >= 1000000 then printf('%.1fM', sum(coalesce(total_tokens, 0)) / 1e6)
       when sum(coalesce(total_tokens, 0)) >= 1000 then printf('%.1fK', sum(coalesce(total_tokens, 0)) / 1e3)
       else sum(coalesce(total_tokens, 0))::varchar end as tokens_shown from m group by 1""")
def tokens_shown(spark, folder):
    """Tokens by provider in short form."""
    return metrics(spark, folder).groupBy(blank("provider").alias("provider")).agg(T.short_number(F.sum(zero("total_tokens"))).alias("tokens_shown"))
