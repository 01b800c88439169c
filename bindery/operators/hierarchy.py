"""Parent links to full hierarchies, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import counted, dropped, staged


def links(df: DataFrame, book: str, entry: str, docid: str, parent: str) -> DataFrame:
    """One row per node with the node its parent link names: ``book, id, parent`` (parent null for roots).

    Links are compared without outer blanks and letter case, with the entry id or else the document id
    of a node of the same book. Repeated rows count once. If several nodes of a book share a compared
    id, the link means the least of their entry ids; an entry id goes before a document id.
    """
    key = lambda c: F.lower(F.trim(c))
    nodes = (
        df.select(F.col(book).alias("book"), F.col(entry).alias("id"), F.col(docid).alias("doc"), key(F.col(parent)).alias("link"))
        .where(F.col("book").isNotNull() & F.col("id").isNotNull())
        .groupBy("book", "id")
        .agg(F.min("doc").alias("doc"), F.min(F.when(F.col("link") != "", F.col("link"))).alias("link"))
    )
    names = (
        nodes.select(
            "book",
            F.explode(
                F.array(
                    F.struct(key(F.col("id")).alias("link"), F.lit(0).alias("rank"), F.col("id").alias("parent")),
                    F.struct(key(F.col("doc")).alias("link"), F.lit(1).alias("rank"), F.col("id").alias("parent")),
                )
            ).alias("n"),
        )
        .select("book", "n.*")
        .where("link is not null and link <> ''")
        .groupBy("book", "link")
        .agg(F.min(F.struct("rank", "parent")).alias("n"))
        .select("book", "link", "n.parent")
    )
    return nodes.join(names, ["book", "link"], "left").select("book", "id", "parent")


def hierarchy(edges: DataFrame) -> DataFrame:
    """Root, depth and path of every node of ``edges(book, id, parent)``; cycles are named.

    The frontier starts with the roots and is joined, level by level, with the nodes not yet reached; those whose parent it
    holds are the next frontier, with path and depth extended, and the others are looked at again, so a level reads only
    what no level before it reached. Each level is one job, whose result is written to the shared folder, so plans
    stay short. Nodes never reached hang on cycles: following all their links twice as far in each
    round shrinks them to those that lie on a cycle themselves, in as many rounds as the logarithm of
    the longest chain. Joins are sorted ones at any size: a frontier may be as large as the table, and hot parents are
    split by adaptive execution.

    Returns ``book, id, state, root, depth, path array<string>``: state ``tree``, or ``cycle`` (the node
    is its own ancestor) or ``hanging`` (its links lead into a cycle) with root ``''``, depth -1 and
    an empty path. A parent that isn't a node makes no path: such a row is hanging. An empty table
    gives no rows.
    """
    edges = staged(edges)
    columns = ["book", "id", "root", "depth", "path"]
    frontier = edges.where("parent is null").select("book", "id", F.col("id").alias("root"), F.lit(0).alias("depth"), F.array("id").alias("path"))
    reached, rest, depth = frontier, edges.where("parent is not null"), 0
    while True:
        depth += 1
        above = frontier.select("book", F.col("id").alias("parent"), F.col("root").alias("_root"), F.col("path").alias("_path"))
        met, n = counted(
            rest.select("book", "id", "parent")
            .join(above.hint("merge"), ["book", "parent"], "left")
            .select("book", "id", "parent", F.col("_root").alias("root"), F.lit(depth).alias("depth"), F.concat("_path", F.array("id")).alias("path")),
            found=F.count("root"),
            left=F.count_if(F.col("root").isNull()),
        )
        rest = met.where("root is null").select("book", "id", "parent")
        if not n["found"]:
            break
        frontier = met.where("root is not null").select(*columns)
        reached = reached.unionByName(frontier)
    trees = reached.select("book", "id", F.lit("tree").alias("state"), "root", "depth", "path")
    if not n["left"]:
        return trees
    step, on_cycle, count = rest, rest.select("book", "id"), n["left"]
    while True:
        images, n = counted(step.select("book", F.col("parent").alias("id")).distinct())
        on_cycle = images
        if n["rows"] == count:
            break
        count = n["rows"]
        further = step.select("book", F.col("id").alias("parent"), F.col("parent").alias("_next"))
        twice = staged(step.join(further.hint("merge"), ["book", "parent"]).select("book", "id", F.col("_next").alias("parent")))
        dropped(step)
        step = twice
    unreached = rest.join(on_cycle.withColumn("hit", F.lit(True)), ["book", "id"], "left").select(
        "book",
        "id",
        F.when(F.col("hit"), "cycle").otherwise("hanging").alias("state"),
        F.lit("").alias("root"),
        F.lit(-1).alias("depth"),
        F.array().cast("array<string>").alias("path"),
    )
    return trees.unionByName(unreached)


def descendants(tree: DataFrame) -> DataFrame:
    """Ancestor pairs of ``hierarchy``: ``book, ancestor, descendant, distance``, one row per node and
    node above it. A node's rows are as many as its depth, never the pairs of its book."""
    return tree.where("state = 'tree' and depth > 0").select(
        "book",
        F.col("id").alias("descendant"),
        F.posexplode(F.slice("path", 1, F.col("depth"))).alias("at", "ancestor"),
        "depth",
    ).select("book", "ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
