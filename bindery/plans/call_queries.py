"""Queries over jobs, calls and units of work, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import calls as C
from ..operators import metrics as M
from ..sources.tables import blank, metrics, table, zero

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ONCE = "with m as (select distinct * from metric)"
_PRIORITY = """case when {0} in ('metadata', 'toc_finder', 'toc_extract', 'link_toc', 'finalize_toc', 'finalize_pattern', 'finalize_discover', 'finalize_gap',
  'structure', 'structure_classify', 'structure_polish', 'pattern_analysis', 'classify_matter') then 20
  when starts_with({0}, 'link_entry_') or starts_with({0}, 'entry_') or starts_with({0}, 'discover_') or starts_with({0}, 'gap_') or starts_with({0}, 'polish_') then 20
  else 10 end"""
_KEY = "coalesce(nullif(item_key, ''), stage, '')"


@query(f"""{_ONCE} select case when p >= 20 then 'high' when p >= 10 then 'normal' else 'low' end as band, count(*) as calls
from (select {_PRIORITY.format(_KEY)} as p from m) group by 1""")
def priority_bands(spark, folder):
    """Calls by band of the priority of their key."""
    key = F.coalesce(F.nullif("item_key", F.lit("")), F.col("stage"))
    return metrics(spark, folder).groupBy(C.band(C.priority(key)).alias("band")).agg(F.count("*").alias("calls"))


@query(f"""{_ONCE} select job_id, _docid, row_number() over (partition by job_id order by {_PRIORITY.format(_KEY)} desc, created_at, _docid) as place
from m where job_id is not null""")
def work_order(spark, folder):
    """The calls of every job in the order of their priority, then of their arrival."""
    key = F.coalesce(F.nullif("item_key", F.lit("")), F.col("stage"))
    m = metrics(spark, folder, "job_id is not null").select("job_id", "_docid", "created_at", key.alias("key"))
    return C.work_order(m, ["job_id"], "key", ["created_at", "_docid"]).select("job_id", "_docid", "place")


_JOBS = """j as (select job_id, min(book_id) as book_id, min(coalesce(stage, '')) as job_type, case when bool_or(success is not true) then 'failed' else 'completed' end as status,
  case when min(coalesce(stage, '')) = '' then null else min(created_at) end as created_at from m where job_id is not null group by 1)"""


def _jobs(spark, folder):
    first = F.min(blank("stage"))
    return metrics(spark, folder, "job_id is not null").groupBy("job_id").agg(
        F.min("book_id").alias("book_id"),
        first.alias("job_type"),
        F.when(F.bool_or(~F.coalesce("success", F.lit(False))), "failed").otherwise("completed").alias("status"),
        F.when(first != "", F.min("created_at")).alias("created_at"),
    )


@query(f"""{_ONCE}, {_JOBS} select job_id, coalesce(book_id, '') as book_id, job_type, coalesce(epoch_us(created_at), -1) as created_us from j where status = 'failed'
order by coalesce(created_at, timestamptz '1970-01-01 00:00:00+00') desc, job_id limit 100""")
def job_list(spark, folder):
    """The newest hundred jobs with a failed call; jobs without a date come last."""
    found = C.job_list(_jobs(spark, folder), status="failed")
    return found.select("job_id", blank("book_id").alias("book_id"), "job_type", F.coalesce(F.unix_micros("created_at"), F.lit(-1)).alias("created_us"))


@query(f"{_ONCE}, {_JOBS} select job_id, status, epoch_us(created_at) as created_us from j where job_type = 'metadata' and status = 'completed' order by created_at desc, job_id limit 5")
def job_list_by_type(spark, folder):
    """The newest five jobs of a kind and status."""
    return C.job_list(_jobs(spark, folder), "completed", "metadata", limit=5).select("job_id", "status", F.unix_micros("created_at").alias("created_us"))


_AGENT = """case stage when 'toc' then case when output_doc_id is null then 'toc_extract' else 'toc_finder' end when 'toc-discover' then 'chapter_finder'
  when 'toc-link' then 'toc_entry_finder' when 'structure-classify' then 'chapter_classifier' when 'structure-polish' then 'chapter_polisher' end"""


@query(f"{_ONCE}, a as (select _docid, {_AGENT} as agent_type from m) select _docid, agent_type from a where agent_type in ('toc_finder', 'toc_extract')")
def agent_log_stages(spark, folder):
    """Logs of the agents of a stage; the kind asked for besides doesn't count."""
    s = F.col("stage")
    kind = F.when(s == "toc", F.when(F.col("output_doc_id").isNull(), "toc_extract").otherwise("toc_finder"))
    for stage in ("toc-discover", "toc-link", "structure-classify", "structure-polish"):
        kind = kind.when(s == stage, C.AGENT_TYPES[stage][0])
    logs = metrics(spark, folder).select("_docid", kind.alias("agent_type"))
    return C.agent_logs(logs, stage="toc", agent_type="chapter_finder")


_CALLS = "c as (select *, 'stages.' || coalesce(stage, '') as prompt_key from m where total_tokens > 0)"


@query(f"""{_ONCE}, {_CALLS} select _docid as id, epoch_us(created_at) as time_us, round(coalesce(total_seconds, 0) * 1000)::bigint as latency_ms, coalesce(prompt_tokens, 0) as input_tokens,
  coalesce(completion_tokens, 0) as output_tokens from c where prompt_key = 'stages.toc-link' and success is not true
  and created_at > timestamptz '2025-02-01 00:00:00+00' and created_at < timestamptz '2025-11-01 00:00:00+00' order by created_at, _docid limit 50 offset 2""")
def llmcall_filtered(spark, folder):
    """Calls by prompt, outcome and time, one page of them."""
    found = C.matching_calls(
        C.llm_calls(metrics(spark, folder)), "2025-02-01T00:00:00Z", "2025-11-01T00:00:00Z", False, 50, 2, prompt_key="stages.toc-link", model=""
    )
    return found.select("id", F.unix_micros("timestamp").alias("time_us"), "latency_ms", "input_tokens", "output_tokens")


@query(f"{_ONCE}, {_CALLS} select coalesce(book_id, '') as book_id, prompt_key, count(*) as calls from c group by 1, 2")
def llmcall_prompt_counts(spark, folder):
    """Calls of language models by book and prompt."""
    return C.llm_calls(metrics(spark, folder)).groupBy(blank("book_id").alias("book_id"), "prompt_key").agg(F.count("*").alias("calls"))


@query(f"""{_ONCE}, u as (select *, case when stage in ('ocr', 'tts') then stage else 'llm' end as pool, 'pool-' || coalesce(provider, '') as pool_name from m)
select _docid, coalesce(case when pool = 'llm' then provider else pool_name end, '') as provider, coalesce(case when pool = 'llm' then total_seconds else execution_seconds end, 0) as total_seconds,
  coalesce(case when pool = 'llm' then total_tokens end, 0) as total_tokens, coalesce(case when pool = 'llm' then queue_seconds end, 0) as queue_seconds,
  coalesce(case when success is not true then case when pool = 'llm' then error_type else pool || '_error' end end, '') as error_type from u""")
def metric_from_units(spark, folder):
    """Rows of the log as they come from units of work of three kinds of pools."""
    pool = F.when(F.col("stage").isin("ocr", "tts"), F.col("stage")).otherwise("llm")
    units = metrics(spark, folder).withColumns({"pool": pool, "pool_name": F.concat(F.lit("pool-"), blank("provider"))})
    return C.metric_rows(units).select(
        "_docid", blank("provider").alias("provider"), *[zero(c).alias(c) for c in ("total_seconds", "total_tokens", "queue_seconds")], blank("error_type").alias("error_type")
    )


@query("""with e as (select distinct coalesce(error_type, '') as error_type from metric where success is not true), a as (select unnest(range(0, 8)) as attempt)
select error_type, attempt, contains(error_type, 'timeout') or contains(error_type, 'rate limit') as again,
  case when 1000 * 2 ** attempt + attempt * 137 > 30000 then 30000 + attempt * 137 else 1000 * 2 ** attempt + attempt * 137 end::bigint as delay_ms from e, a""")
def retry_schedule(spark, folder):
    """Waits before each attempt after an error of each kind, and whether there is to be any."""
    e = table(spark, folder, "metric", "error_type", "success").where(~F.coalesce("success", F.lit(False))).select(blank("error_type").alias("error_type")).distinct()
    each = e.withColumn("attempt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    return each.select("error_type", "attempt", C.retriable(F.col("error_type")).alias("again"), C.backoff_ms(F.col("attempt"), F.col("attempt") * 137).alias("delay_ms"))


@query("""select coalesce(error_type, '') as error_type, contains(coalesce(error_type, ''), 'timeout') or contains(coalesce(error_type, ''), 'rate limit') as again, count(*) as calls
from (select distinct * from metric) where success is not true group by 1, 2""")
def error_classes(spark, folder):
    """Errors of failed calls, and whether the same call may succeed again."""
    failed = metrics(spark, folder, ~F.coalesce("success", F.lit(False)))
    return failed.groupBy(blank("error_type").alias("error_type"), C.retriable(F.col("error_type")).alias("again")).agg(F.count("*").alias("calls"))


@query(f"""{_ONCE}, c as (select coalesce(stage, '') as stage, coalesce(sum(cast(coalesce(cost_usd, 0) as decimal(18,6))), 0)::double as cost_usd from m group by 1)
select stage, cost_usd, row_number() over (order by cost_usd desc, stage) as place from c""")
def cost_ranked(spark, folder):
    """Cost of every stage, the dearest first."""
    cost = metrics(spark, folder).groupBy(blank("stage").alias("stage")).agg(M.exact_sum("cost_usd").alias("cost_usd"))
    return cost.select("*", F.row_number().over(Window.orderBy(F.desc("cost_usd"), "stage")).cast("long").alias("place"))  # a row a stage


@query("""select distinct unique_key, case when starts_with(unique_key, book_id || ':') then split_part(substr(unique_key, length(book_id) + 2), ':', 1) else '' end as chapter_key from audio_segment""")
def segment_keys(spark, folder):
    """The part of every segment's key that names its chapter."""
    s = table(spark, folder, "audio_segment", "unique_key", "book_id").distinct()
    return s.select("unique_key", T.second_part(F.col("unique_key"), F.col("book_id")).alias("chapter_key"))
