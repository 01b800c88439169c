"""Streaming twins of batch queries, run to the end of what is there; and queries of the builder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..operators import metrics as M
from ..operators.query import Query
from ..sources.tables import blank, table
from ..streaming import sinks
from .metric_queries import _COST, _ONCE
from .staging import own_folder

QUERIES, SQL = {}, {}
#: How long after its first delivery a call may come again; its id is kept so long.
LATE = "30 days"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _metric_stream(spark, folder):
    """The log as a stream of its files. A folder of part files is read as such; a single file through
    the folder that holds it."""
    schema = table(spark, folder, "metric").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/metric.parquet*")


def _run(spark, stream, mode: str):
    """Run a streaming aggregate over all that is there into the shared folder."""
    base = f"{own_folder(spark)}/{uuid.uuid4().hex}"

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", IntegerType())).parquet(f"{base}/out")


@query(_ONCE + f"select coalesce(stage, '') as stage, count(*) as calls, {_COST} as cost_usd from m group by 1")
def streaming_cost_by_stage(spark, folder):
    """Cost by stage over a stream of the log, each call counted once; the last batch holds the totals."""
    stream = sinks.once(_metric_stream(spark, folder), "_docid", "created_at", LATE)
    total = stream.groupBy(blank("stage").alias("stage")).agg(F.count("*").alias("calls"), M.exact_sum("cost_usd").alias("cost_usd"))
    out = _run(spark, total, "complete")
    last = out.agg(F.max("batch").alias("b")).first()["b"]
    return out.where(F.col("batch") == last).drop("batch")


@query(f"""with d as (select *, epoch_us(created_at) // 86400000000 * 86400000000 as day from (select distinct * from metric))
select day as window_us, coalesce(stage, '') as stage, count(*) as calls, {_COST} as cost_usd from d
group by 1, 2 having day + 2 * 86400000000 <= (select epoch_us(max(created_at)) from metric)""")
def streaming_daily_cost(spark, folder):
    """Calls, each counted once, and cost by day and stage over a stream, of the days that are final: a day is when a day more
    has passed."""
    once = sinks.once(_metric_stream(spark, folder), "_docid", "created_at", "1 day")
    out = _run(spark, sinks.windowed(once, "created_at", "1 day", None, "stage"), "append")
    return out.select(F.unix_micros("window_start").alias("window_us"), "stage", "calls", "cost_usd")


@query("""select distinct _docid, book_id, sort_order, start_page from chapter where level = 1 and start_page >= 5 and start_page < 20 and matter_type in ('body', 'front_matter')
order by start_page desc, _docid limit 50""")
def builder_query(spark, folder):
    """A query of the builder: equality, ranges, membership, projection, order and limit."""
    q = Query("chapter").filter("level", 1).filter_gte("start_page", 5).filter_lt("start_page", 20).filter_in("matter_type", ["body", "front_matter"])
    found = q.fields("_docid", "book_id", "sort_order", "start_page").build(spark, folder).distinct()
    return found.orderBy(F.desc("start_page"), "_docid").limit(50)


@query("""select _docid, page_count, coalesce(publication_year, 0) as publication_year from book where page_count > 30 and publication_year <= 1900 order by page_count desc, _docid limit 10 offset 3""")
def builder_page(spark, folder):
    """A page of the builder's: bounds, order, limit and offset."""
    q = Query("book").filter_gt("page_count", 30).filter_lte("publication_year", 1900).order_by("page_count", True).limit(10).offset(3)
    return q.fields("_docid", "page_count", "publication_year").build(spark, folder)


@query("""select _docid, coalesce(max_by(total_seconds, created_at), 0) as total_seconds from metric where created_at <= timestamptz '2025-06-01 00:00:00+00' and true group by 1
having max_by(stage, created_at) = 'tts'""")
def builder_as_of(spark, folder):
    """The builder's reading at a version."""
    return Query("metric").as_of("2025-06-01T00:00:00Z").filter("stage", "tts").fields("_docid", "total_seconds").build(spark, folder).na.fill(0.0)


@query("select _docid, title, coalesce(author, '') as author, page_count, status from book")
def list_books(spark, folder):
    return table(spark, folder, "book", "_docid", "title", blank("author").alias("author"), "page_count", "status")


@query("""select _docid, total_tokens, regexp_matches(coalesce(job_id, ''), '^[a-zA-Z0-9_-]+$') and length(coalesce(job_id, '')) <= 500 as valid from (select distinct * from metric) where stage = 'metadata'""")
def valid_identifiers(spark, folder):
    """Whether job ids are well formed."""
    from ..operators.query import valid_ids
    from ..sources.tables import metrics

    return metrics(spark, folder, "stage = 'metadata'").select("_docid", "total_tokens", valid_ids(F.col("job_id")).alias("valid"))


@query("""with t as (select event_type, event_id, ts, value from events)
select event_type, min(event_id) as first_event, max_by(event_id, (ts, event_id)) as last_event, round(sum(cast(value as decimal(18,6)))::double, 6) as total from t group by 1""")
def event_totals(spark, folder):
    e = table(spark, folder, "events", "event_type", "event_id", "ts", "value")
    return e.groupBy("event_type").agg(
        F.min("event_id").alias("first_event"),
        F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"),
        F.round(F.sum(F.col("value").cast("decimal(18,6)")).cast("double"), 6).alias("total"),
    )


@query("""select n_name, r_name, coalesce(customers, 0) as customers from nation left join region on r_regionkey = n_regionkey
left join (select c_nationkey, count(*) as customers from customer group by 1) on c_nationkey = n_nationkey""")
def nation_customers(spark, folder):
    """Customers by nation, reduced before the joins."""
    c = table(spark, folder, "customer", "c_nationkey").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    n = table(spark, folder, "nation", "n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    return n.join(table(spark, folder, "region", "r_regionkey", "r_name"), "r_regionkey", "left").join(c, "n_nationkey", "left").select(
        "n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers")
    )


@query("""select o_orderpriority, l_returnflag, l_linestatus, sum(cast(l_quantity as decimal(18,2)))::double as quantity,
  round(sum(cast(l_extendedprice as decimal(18,4)) * cast(1 - l_discount as decimal(18,4)))::double, 4) as revenue, count(*) as lines
from lineitem join orders on o_orderkey = l_orderkey group by 1, 2, 3""")
def order_line_totals(spark, folder):
    """Totals of order lines by priority of the order."""
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount")
    o = table(spark, folder, "orders", F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    revenue = F.col("l_extendedprice").cast("decimal(18,4)") * (1 - F.col("l_discount")).cast("decimal(18,4)")
    return lines.join(o, "l_orderkey").groupBy("o_orderpriority", "l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"),
        F.round(F.sum(revenue).cast("double"), 4).alias("revenue"),
        F.count("*").alias("lines"),
    )
