"""Jobs, calls and their priorities: filters over lists, orders of work, retries, and rows made from units of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Stages of whole books, and beginnings of keys of their parts, that go before pages.
HIGH_STAGES = (
    "metadata toc_finder toc_extract link_toc finalize_toc finalize_pattern finalize_discover finalize_gap structure "
    "structure_classify structure_polish pattern_analysis classify_matter"
).split()
HIGH_PREFIXES = ("link_entry_", "entry_", "discover_", "gap_", "polish_")
HIGH, NORMAL = 20, 10
# The kinds of agents that work on each stage.
AGENT_TYPES = {
    "toc-pattern": ["pattern_analyzer"],
    "toc-discover": ["chapter_finder"],
    "toc-validate": ["gap_investigator"],
    "structure-classify": ["chapter_classifier"],
    "structure-polish": ["chapter_polisher"],
    "toc": ["toc_finder", "toc_extract"],
    "toc-link": ["toc_entry_finder"],
}
# What the text of an error holds if the same call may succeed again, and kinds of bad results that may.
RETRIABLE = (
    "status 500", "status 502", "status 503", "status 504", "status 429", "rate limit", "timeout", "deadline exceeded", "connection refused",
    "connection reset", "EOF",
)
RETRIABLE_RESULTS = ("json_parse", "schema_validation")


def priority(stage_or_key: Column) -> Column:
    """20 for stages and keys that concern a whole book, 10 for pages and all else; null is like ''."""
    s = F.coalesce(stage_or_key, F.lit(""))
    high = s.isin(HIGH_STAGES)
    for p in HIGH_PREFIXES:
        high = high | s.startswith(p)
    return F.when(high, HIGH).otherwise(NORMAL)


def band(of: Column) -> Column:
    return F.when(of >= HIGH, "high").when(of >= NORMAL, "normal").otherwise("low")


def work_order(units: DataFrame, queue: list[str], key: str, arrival: list) -> DataFrame:
    """``place`` of each unit of a queue, from 1: by priority of its key, then in order of arrival."""
    w = Window.partitionBy(*queue).orderBy(F.desc("_priority"), *arrival)
    return units.withColumn("_priority", priority(F.col(key))).withColumn("place", F.row_number().over(w).cast("long")).drop("_priority")


def job_list(jobs: DataFrame, status: str = "", job_type: str = "", book_id: str = "", limit: int = 100) -> DataFrame:
    """Jobs that meet the conditions given, newest first; those without a date count as of 1970. Without a limit above 0
    a hundred."""
    for name, value in (("status", status), ("job_type", job_type), ("book_id", book_id)):
        jobs = jobs.where(F.col(name) == value) if value else jobs
    newest = F.coalesce("created_at", F.lit(0).cast("timestamp"))
    return jobs.orderBy(newest.desc(), "job_id").limit(limit if limit > 0 else 100)


def agent_logs(logs: DataFrame, stage: str = "", agent_type: str = "") -> DataFrame:
    """Logs of the agents of a stage, or else of one kind of agent; the stage goes before. An unknown stage asks for nothing."""
    if stage:
        return logs.where(F.col("agent_type").isin(AGENT_TYPES[stage])) if stage in AGENT_TYPES else logs
    return logs.where(F.col("agent_type") == agent_type) if agent_type else logs


def retriable(error: Column) -> Column:
    """Whether the same call may succeed again; null is no error."""
    text = F.coalesce(error, F.lit(""))
    again = text.isin(*RETRIABLE_RESULTS)
    for x in RETRIABLE:
        again = again | text.contains(x)
    return again


def backoff_ms(attempt: Column, jitter: Column, asked: Column | None = None) -> Column:
    """How long to wait before the attempt after ``attempt`` (from 0): what was asked for, else a second doubled each time plus
    the jitter, 30 seconds plus the jitter at most."""
    doubled = (F.pow(F.lit(2.0), attempt) * 1000).cast("long") + jitter
    own = F.when(doubled > 30_000, jitter + 30_000).otherwise(doubled)
    return own if asked is None else F.when(asked > 0, asked).otherwise(own)


def metric_rows(units: DataFrame) -> DataFrame:
    """Rows of the log from units of work ``pool, pool_name`` and the columns of a result. Recognition and speech carry the
    pool's name, no tokens, no time in the queue, and their execution as the whole; they fail with an error of their own."""
    model = F.col("pool") == "llm"
    tokens = {c: F.when(model, F.col(c)) for c in ("prompt_tokens", "completion_tokens", "reasoning_tokens", "total_tokens", "queue_seconds", "model")}
    failed = ~F.coalesce("success", F.lit(False))
    return units.withColumns(
        tokens
        | {
            "provider": F.when(model, F.col("provider")).otherwise(F.col("pool_name")),
            "total_seconds": F.when(model, F.col("total_seconds")).otherwise(F.col("execution_seconds")),
            "error_type": F.when(failed, F.when(model, F.col("error_type")).otherwise(F.concat("pool", F.lit("_error")))),
        }
    ).drop("pool", "pool_name")


def llm_calls(metrics: DataFrame) -> DataFrame:
    """Records of calls of language models from rows of the log: those that used tokens."""
    return metrics.where("total_tokens > 0").select(
        F.col("_docid").alias("id"),
        F.col("created_at").alias("timestamp"),
        F.round(F.coalesce("total_seconds", F.lit(0.0)) * 1000).cast("long").alias("latency_ms"),
        "book_id",
        "job_id",
        F.concat(F.lit("stages."), F.coalesce("stage", F.lit(""))).alias("prompt_key"),
        "provider",
        "model",
        F.coalesce("prompt_tokens", F.lit(0)).alias("input_tokens"),
        F.coalesce("completion_tokens", F.lit(0)).alias("output_tokens"),
        F.coalesce("success", F.lit(False)).alias("success"),
        F.coalesce("error_type", F.lit("")).alias("error"),
    )


#: What calls may be asked for by.
CALL_KEYS = ("book_id", "page_id", "job_id", "prompt_key", "provider", "model")


def matching_calls(calls: DataFrame, after=None, before=None, success: bool | None = None, limit: int = 0, offset: int = 0, **equal: str) -> DataFrame:
    """Calls with the given values and times strictly between the bounds, in order of time and id; what isn't given, or is '',
    isn't asked. A limit or offset of 0 is none."""
    if unknown := set(equal) - set(CALL_KEYS):
        raise ValueError(f"no such filter: {sorted(unknown)}")
    for k, v in equal.items():
        calls = calls.where(F.col(k) == v) if v else calls
    if after is not None:
        calls = calls.where(F.col("timestamp") > F.lit(after).cast("timestamp"))
    if before is not None:
        calls = calls.where(F.col("timestamp") < F.lit(before).cast("timestamp"))
    if success is not None:
        calls = calls.where(F.col("success") == success)
    if limit or offset:
        calls = calls.orderBy("timestamp", "id")
        calls = calls.offset(offset) if offset else calls
        calls = calls.limit(limit) if limit else calls
    return calls
