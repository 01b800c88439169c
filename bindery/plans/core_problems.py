"""Queries p2 (page periods and gaps) and p5 (chapter hierarchies) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..operators.intervals import runs_and_gaps
from ..sources.tables import table

def _book():
    return F.substring_index("unique_key", ":", 1)



def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Covered page ranges of every book and the uncovered ranges between them."""
    ch = table(spark, folder, "chapter", "unique_key", "start_page", "end_page").select(
        _book().alias("book_id"), "start_page", "end_page"
    )
    return runs_and_gaps(ch, "book_id", "start_page", "end_page").select(
        F.col("entity").alias("book_id"),
        "kind",
        F.col("run_start").cast("int").alias("start_page"),
        F.col("run_end").cast("int").alias("end_page"),
    )


def chapter_tree(spark: SparkSession, folder: str) -> DataFrame:
    ch = table(spark, folder, "chapter", "unique_key", "entry_id", "_docid", "parent_id").withColumn("book", _book())
    return H.hierarchy(H.links(ch, "book", "entry_id", "_docid", "parent_id"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Root, depth and path of every chapter; chapters on cycles or hanging on them are named."""
    return chapter_tree(spark, folder).select(
        F.col("book").alias("book_id"),
        F.col("id").alias("entry_id"),
        "state",
        F.col("root").alias("root_id"),
        "depth",
        F.array_join("path", "/").alias("path"),
    )


def p5_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every chapter above every other, with the number of links between them."""
    return H.descendants(chapter_tree(spark, folder)).withColumnRenamed("book", "book_id")


P2_SQL = """
with r as (select distinct split_part(unique_key, ':', 1) as book_id, start_page s, end_page e from chapter
           where start_page is not null and end_page >= start_page),
m as (select *, max(e) over (partition by book_id order by s, e rows between unbounded preceding and 1 preceding) as b from r),
g as (select *, sum(case when b is null or s > b + 1 then 1 else 0 end)
             over (partition by book_id order by s, e rows unbounded preceding) as run from m),
p as (select book_id, run, min(s) as s, max(e) as e from g group by book_id, run),
n as (select *, lead(s) over (partition by book_id order by run) as nx from p)
select book_id, 'period' as kind, s::int as start_page, e::int as end_page from n
union all
select book_id, 'gap', (e + 1)::int, (nx - 1)::int from n where nx is not null
"""

_TREE = """
with recursive c as (select split_part(unique_key, ':', 1) as book, entry_id as id, min(_docid) as doc,
                            min(nullif(lower(trim(parent_id)), '')) as link from chapter group by all),
l as (select c.book, c.id, coalesce(a.id, b.id) as parent from c
      left join c a on a.book = c.book and lower(trim(a.id)) = c.link
      left join c b on b.book = c.book and lower(trim(b.doc)) = c.link),
t as (select book, id, id as root, 0 as depth, id as path from l where parent is null
      union all
      select l.book, l.id, t.root, t.depth + 1, t.path || '/' || l.id from t join l on l.book = t.book and l.parent = t.id)
"""

P5_SQL = (
    _TREE
    + """,
u as (select l.* from l anti join t on l.book = t.book and l.id = t.id),
w as (select book, id, parent as at, 1 as n from u
      union
      select w.book, w.id, u.parent, n + 1 from w join u on u.book = w.book and u.id = w.at
      where n <= 200 and w.at <> w.id)
select book as book_id, id as entry_id, 'tree' as state, root as root_id, depth::int as depth, path from t
union all
select book, id, case when exists (select 1 from w where w.book = u.book and w.id = u.id and w.at = u.id)
                      then 'cycle' else 'hanging' end, '', -1, '' from u
"""
)

P5_DESCENDANTS_SQL = (
    _TREE
    + """,
d as (select book, id as ancestor, id as descendant, 0 as distance from t
      union all
      select d.book, d.ancestor, l.id, d.distance + 1 from d join l on l.book = d.book and l.parent = d.descendant)
select book as book_id, ancestor, descendant, distance::int as distance from d where distance > 0
"""
)

QUERIES = {"p2_found": p2_found, "p5_found": p5_found, "p5_descendants": p5_descendants}
SQL = {"p2_found": P2_SQL, "p5_found": P5_SQL, "p5_descendants": P5_DESCENDANTS_SQL}
