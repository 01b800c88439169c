"""Lines repeated across one source's documents (p6)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import counted, dropped, staged
from . import lines as L

SUPPORT = 8
#: So many 8-byte hashes may be broadcast as they are, which costs less than a filter of them.
BROADCAST_HASHES = 1_000_000
#: Lengths of lines near so many hubs may be broadcast.
BROADCAST_HUBS = 200_000
#: Bits of a filter: 16 MB whatever the input; beyond some ten million hashes it only lets more through.
BITS = 27


def _keys(text: str) -> list[str]:
    """The keys of a text's lines, empty for page numbers and lines without letters."""
    keys = L.line_keys(text)
    if min(map(len, filter(None, keys)), default=9) < 9:
        raw = text.split("\n")
        keys = [k if len(k) >= 9 or k in L.PAGE_KEYS or not L.is_page_number(x) else "" for k, x in zip(keys, raw)]
    return ["" if k in L.PAGE_KEYS else k for k in keys]


def keyed_lines(docs: DataFrame, ids: list[str], fields: list[str], hubs: DataFrame | None = None) -> DataFrame:
    """``*ids, field, line_no, key, h`` of every line with a key; h is a hash of the first of ``ids``, the source, and the key.
    Rows whose ids aren't all given have none. With ``hubs(source, hub)`` lines of a length that no hub of their source is near may be
    left out, and are if the lengths may be broadcast."""
    lengths = _broadcast_lengths(hubs) if hubs is not None else None
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ids)

    def read(batches):
        wanted = None if lengths is None else lengths.value
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                of, names, numbers, keys = [], [], [], []
                sources = part.column(ids[0]).to_pylist()
                for f, field in enumerate(fields):
                    for i, text in enumerate(part.column(field).to_pylist()):
                        near = wanted is None or wanted.get(sources[i])
                        if text and near:
                            own = _keys(text)
                            some = [no for no, k in enumerate(own) if k and (near is True or len(k) in near)]
                            of += [i] * len(some)
                            names += [f] * len(some)
                            numbers += some
                            keys += [own[no] for no in some]
                rows, string = pa.array(of, pa.int32()), part.schema.field(fields[0]).type
                columns = [part.column(c).take(rows) for c in ids]
                columns.append(pa.array(fields, string).take(pa.array(names, pa.int32())))
                columns.append(pa.array(np.array(numbers, dtype="int32") + 1, pa.int32()))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(keys, string)], names=[*ids, "field", "line_no", "key"])

    whole = docs.select(*ids, *fields).where(" and ".join(f"{c} is not null" for c in ids))
    return whole.mapInArrow(read, f"{schema}, field string, line_no int, key string").withColumn("h", F.xxhash64(ids[0], "key"))


def _broadcast_lengths(hubs: DataFrame):
    """The lengths of lines that may be copies of a hub, by source, to all tasks; None if there are too many."""
    pairs = _lengths(numbered(hubs)).groupBy("source").agg(F.collect_set("_l").alias("lengths"))
    if hubs.count() > BROADCAST_HUBS:
        return None
    return hubs.sparkSession.sparkContext.broadcast({r["source"]: frozenset(r["lengths"]) for r in pairs.collect()})


# Filters: bits of hashes, by which rows that can't meet anything in a join are left out before they are shuffled.


def bits_of(hashes: DataFrame):
    """A broadcast filter of a column of hashes. It is put together in parts, each in one task, and is of the same size for
    any input."""
    bit = F.shiftrightunsigned(hashes[hashes.columns[0]], 64 - BITS) + 1
    parts = hashes.select(F.bitmap_bucket_number(bit).alias("part"), F.bitmap_bit_position(bit).alias("bit")).repartition("part")
    rows = parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    whole = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    for r in rows:
        whole[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    # Sparse bits pack well, and what is broadcast lies on the disk of every machine.
    return hashes.sparkSession.sparkContext.broadcast(zlib.compress(whole.tobytes(), 1))


_OPENED: dict = {}


def _opened(bits) -> np.ndarray:
    """The bits of a filter, unpacked once in each Python worker."""
    key = getattr(bits, "_path", None) or id(bits)
    if key not in _OPENED:
        if len(_OPENED) >= 2:
            _OPENED.clear()
        _OPENED[key] = np.frombuffer(zlib.decompress(bits.value), dtype=np.uint8)
    return _OPENED[key]


def passing(df: DataFrame, column: str, bits) -> DataFrame:
    """The rows of which a hash may be in a filter."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _opened(bits)
        for b in batches:
            hashes = b.column(at).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - BITS)
            yield b.filter(pa.array((table[hashes >> np.uint64(3)] >> (hashes & np.uint64(7)).astype(np.uint8)) & 1 > 0))

    return df.mapInArrow(run, df.schema)


def meeting(df: DataFrame, column: str, hashes: DataFrame) -> DataFrame:
    """The rows of which a hash is among ``hashes``, a staged table, and perhaps some more: those hashes themselves are sent to all
    tasks if there are few, else a filter of them."""
    few = hashes.distinct().limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES
    if few:
        return df.join(F.broadcast(hashes.toDF(column).distinct()), column, "left_semi").select(*df.columns)
    return passing(df, column, bits_of(hashes))


# Near lines: a copy within e edits of a line leaves one of e + 1 pieces as it is, at a place shifted by few letters.


def _allowed(size: Column) -> Column:
    return F.when(size < L.LEAST, 0).otherwise(1 + F.floor(size / L.LETTERS_PER_EDIT)).cast("int")


def _piece(source: Column, size: Column, i: Column, text: Column) -> Column:
    return F.xxhash64(source, size, i, text)


def line_pieces(keys: DataFrame) -> DataFrame:
    """``piece`` beside the columns of ``keys(source, key)``: the hashes of a line's pieces, one more than the edits between it
    and any line it may be a copy of."""
    size = F.length("key")
    counted_ = keys.withColumn("_m", _allowed(size + L.SHIFT) + 1)
    each = counted_.select("*", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_i"))
    start = lambda i: F.floor(i * size / F.col("_m")).cast("int")
    text = F.substring("key", start(F.col("_i")) + 1, start(F.col("_i") + 1) - start(F.col("_i")))
    return each.select(*keys.columns, _piece(F.col("source"), size, F.col("_i"), text).alias("piece"))


def numbered(hubs: DataFrame) -> DataFrame:
    """``hubs(source, hub, pages)`` with ``id``, a hash of source and hub."""
    return hubs.select("source", "hub", "pages", F.xxhash64("source", "hub").alias("id"))


def _lengths(hubs: DataFrame) -> DataFrame:
    """``_l`` beside the columns of ``hubs``: each length of a line that may be a copy of the hub."""
    own = F.length("hub")
    s = F.least(_allowed(own), F.lit(L.SHIFT))
    return hubs.select("*", s.alias("_s"), F.explode(F.sequence(F.greatest(own - s, F.lit(1)), own + s)).alias("_l"))


def hub_pieces(hubs: DataFrame) -> DataFrame:
    """``id, piece``: what is to be found of each hub of ``hubs`` (see ``numbered``) in the lines that may be copies of it, for
    each length of such a line and each of its pieces at each shift that the edits allow."""
    own = F.length("hub")
    counts = _lengths(hubs).withColumn("_m", _allowed(F.col("_l") + L.SHIFT) + 1)
    pieces = counts.select("*", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_i"))
    shifted = pieces.select("*", F.explode(F.sequence(-F.col("_s"), F.col("_s"))).alias("_d"))
    start = lambda i: F.floor(i * F.col("_l") / F.col("_m")).cast("int")
    first, size = start(F.col("_i")) + F.col("_d"), start(F.col("_i") + 1) - start(F.col("_i"))
    fits = (F.abs("_d") + F.abs(own - F.col("_l") - F.col("_d")) <= _allowed(own)) & (first >= 0) & (first + size <= own)
    return shifted.where(fits).select("id", _piece(F.col("source"), F.col("_l"), F.col("_i"), F.substring("hub", first + 1, size)).alias("piece"))


def near(each: DataFrame, pieces: DataFrame, hubs: DataFrame, keys: DataFrame) -> DataFrame:
    """``h, source, key, id, hub, pages`` of each key of ``keys(source, key, h)`` and each of ``hubs`` (see ``numbered``, ``hub_pieces``)
    that it is within the allowed edits of, once. ``each(h, piece)`` are the keys' pieces; it is read twice and should be staged."""
    met = staged(each.join(passing(pieces, "piece", bits_of(each.select("piece"))), "piece").select("h", "id").distinct())
    own = meeting(keys, "h", met.select("h")).distinct()
    both = met.join(own, "h").join(hubs.withColumnRenamed("source", "_source"), "id").where("source = _source")
    most = _allowed(F.length("hub"))
    close = both.where(F.abs(F.length("key") - F.length("hub")) <= most).where(F.levenshtein("key", "hub") <= most)
    return close.select("h", "source", "key", "id", "hub", "pages")


def leaders(hubs: DataFrame, pieces: DataFrame) -> DataFrame:
    """Of ``hubs`` (see ``numbered``) those that aren't near a stronger one that stays, by pages and then by name.

    A hub stays once every stronger one near it has gone, and goes once a stronger one near it stays, so each round settles the
    strongest of those that are left; there are as many rounds as the longest chain of ever weaker hubs near each other.
    """
    keys = hubs.select("source", F.col("hub").alias("key"), F.col("id").alias("h"))
    pairs = near(staged(line_pieces(keys).select("h", "piece")), pieces, hubs, keys).join(hubs.select(F.col("id").alias("h"), F.col("pages").alias("own")), "h")
    stronger = (F.col("pages") > F.col("own")) | ((F.col("pages") == F.col("own")) & (F.col("hub") < F.col("key")))
    edges, n = counted(pairs.where(stronger).select(F.col("h").alias("weak"), F.col("id").alias("strong")))
    if not n["rows"]:
        return hubs
    known = staged(hubs.join(edges.select(F.col("weak").alias("id")).distinct(), "id", "left_anti").select("id"))
    while n["rows"]:
        follows = staged(edges.join(known, edges["strong"] == known["id"], "left_semi").select("weak").distinct())
        left = edges.join(follows, "weak", "left_anti")
        left = left.join(follows.select(F.col("weak").alias("strong")), "strong", "left_anti").select("weak", "strong")
        fewer, n = counted(left)
        freed = edges.select("weak").distinct().join(follows, "weak", "left_anti").join(fewer.select("weak").distinct(), "weak", "left_anti")
        more = staged(known.unionByName(freed.select(F.col("weak").alias("id"))))
        dropped(edges, follows, known)
        edges, known = fewer, more
    return hubs.join(known, "id", "left_semi")


def copies(lines: DataFrame, hubs: DataFrame, pieces: DataFrame | None = None) -> DataFrame:
    """The lines of ``lines`` (see ``keyed_lines``; their source is the first column) that are copies of a hub of
    ``hubs(source, hub, pages)``, with the strongest such ``hub`` in place of ``key`` and ``h``.

    Lines meet hubs by pieces (see ``line_pieces``), in a join; lines of a length that no hub of their source is near, and pieces
    that no hub has, are left out before. ``pieces``: those of these hubs, perhaps among others.
    """
    source, hubs = lines.columns[0], numbered(hubs)
    pieces = staged(hub_pieces(hubs)) if pieces is None else pieces.join(hubs.select("id"), "id", "left_semi")
    keyed = lines.select(F.col(source).alias("source"), "key", "h", F.xxhash64(F.col(source), F.length("key")).alias("sized"))
    lengths = _lengths(hubs).select(F.xxhash64("source", "_l").alias("sized"))
    some = line_pieces(meeting(keyed, "sized", lengths).drop("sized")).select("h", "piece")
    each = staged(passing(some, "piece", bits_of(pieces.select("piece"))).distinct())
    keys = lines.select(F.col(source).alias("source"), "key", "h")
    best = F.min(F.struct((-F.col("pages")).alias("order"), "hub"))["hub"]
    named = near(each, pieces, hubs, keys).groupBy("h").agg(best.alias("hub"), F.first("source").alias(source))
    named = staged(named)
    kept = [c for c in lines.columns if c not in (source, "key", "h")]
    out = meeting(lines.select(*kept, "h"), "h", named.select("h")).join(named, "h").select(source, *kept, "hub")
    found = staged(out.distinct())
    dropped(named, each)
    return found


def repeated_lines(docs: DataFrame, fields: list[str], support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """All lines that recur on at least ``support`` pages of their book, whatever their case, spacing,
    marks, numbers and misread characters: ``book, page, field, line_no, hub``, and the hubs ``book,
    key, pages`` themselves: the nodes of the graph.

    ``docs`` has ``book``, ``page`` and the text fields. Null fields have no lines; rows without book or
    page, lines without letters and page numbers are no case; a page stored twice counts once. The texts are read
    once, for the keys of their lines. Keys on two pages or more are hubs; a hub near a stronger one goes to it; then every
    line goes to the strongest hub it is near (see ``copies``). Copies that are all different, no two of one key, are missed.
    """
    lines = staged(keyed_lines(docs, ["book", "page"], fields))
    placed = lines.withColumn("p", F.xxhash64("page"))
    several = staged(placed.groupBy("h").agg(F.min("p").alias("a"), F.max("p").alias("b")).where("a <> b").select("h"))
    # Pages are told apart before they are counted by key alone: a key may be on a third of all pages.
    pairs = meeting(placed.select("book", "key", "h", "p"), "h", several).join(several, "h").distinct()
    counts = pairs.groupBy("book", "key").agg(F.count("*").alias("pages"))
    hubs = staged(numbered(counts.select(F.col("book").alias("source"), F.col("key").alias("hub"), "pages")))
    pieces = staged(hub_pieces(hubs))
    own = copies(lines, leaders(hubs, pieces), pieces)
    pages = own.select("book", "hub", F.xxhash64("page").alias("p")).distinct().groupBy("book", "hub").agg(F.count("*").alias("pages"))
    strong = staged(pages.where(F.col("pages") >= support))
    dropped(several, hubs, pieces, lines)
    found = own.join(strong.select("book", "hub"), ["book", "hub"]).select("book", "page", "field", "line_no", "hub")
    return found, strong.select("book", F.col("hub").alias("key"), "pages")


def components(edges: DataFrame, ids: str = "a", others: str = "b") -> DataFrame:
    """``node, least`` of each node of an undirected graph: the least node of its connected component.

    Each round, every tree of nodes is hung below the least tree it has an edge to, and all nodes climb to their grandparents,
    so trees shrink as they grow together and the rounds grow with the logarithm of the component's size. Both tables
    are written each round; no task holds a component.
    """
    both = staged(
        edges.select(F.col(ids).alias("a"), F.col(others).alias("b")).unionByName(edges.select(F.col(others).alias("a"), F.col(ids).alias("b"))).distinct()
    )
    up = staged(both.select(F.col("a").alias("node")).distinct().withColumn("least", F.col("node")))
    while True:
        of = lambda name: up.select(F.col("node").alias(name), F.col("least").alias(f"{name}_top"))
        tops = both.join(of("a"), "a").join(of("b"), "b").select("a_top", "b_top").where("b_top < a_top")
        hooks = tops.groupBy(F.col("a_top").alias("top")).agg(F.min("b_top").alias("to"))
        hung = staged(up.join(hooks, up["node"] == hooks["top"], "left").select("node", F.least(F.coalesce("to", "least"), "least").alias("least")))
        above = hung.select(F.col("node").alias("least"), F.col("least").alias("over"))
        climbed, n = counted(
            hung.join(above, "least").join(up.withColumnRenamed("least", "old"), "node").select("node", F.col("over").alias("least"), "old"),
            changed=F.count_if(F.col("least") != F.col("old")),
        )
        dropped(hung, up)
        up = climbed.drop("old")
        if not n["changed"]:
            dropped(both)
            return up


def blocks(found: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``book, hub, block``: repeated lines that stand one below the other on at least ``support`` pages
    are one block (connected components of the graph of consecutive lines); block is a line of it, the same for all. A line
    beside no other is a block by itself."""
    nodes = found.select("book", "hub").distinct()
    after = Window.partitionBy("book", "page", "field").orderBy("line_no")
    edges = (
        found.withColumn("next", F.lead("hub").over(after))
        .withColumn("next_no", F.lead("line_no").over(after))
        .where("next_no = line_no + 1 and next <> hub")
        .select("book", F.least("hub", "next").alias("a"), F.greatest("hub", "next").alias("b"), "page")
        .distinct()
        .groupBy("book", "a", "b")
        .agg(F.count("*").alias("pages"))
        .where(F.col("pages") >= support)
    )
    node = lambda c: F.struct(F.col("book"), F.col(c).alias("hub"))
    least = components(edges.select(node("a").alias("a"), node("b").alias("b")))
    joined = least.select(F.col("node.book").alias("book"), F.col("node.hub").alias("hub"), F.col("least.hub").alias("block"))
    return nodes.join(joined, ["book", "hub"], "left").select("book", "hub", F.coalesce("block", "hub").alias("block"))


def block_lines(found: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``found`` with the ``block`` that each line belongs to."""
    return found.join(blocks(found, support), ["book", "hub"])


def without_lines(docs: DataFrame, found: DataFrame, fields: list[str]) -> DataFrame:
    """``docs`` with the found lines taken out of their fields. Documents without any are kept as they
    are; null fields stay null; a field that loses all its lines is empty."""
    gone = found.groupBy("book", "page").agg(F.collect_set(F.concat_ws(":", "field", "line_no")).alias("_gone"))
    joined = docs.join(gone, ["book", "page"], "left")
    for field in fields:
        kept = F.filter(
            F.split(field, "\n"),
            lambda x, i: ~F.array_contains(F.col("_gone"), F.concat_ws(":", F.lit(field), (i + 1).cast("string"))),
        )
        joined = joined.withColumn(field, F.when(F.col("_gone").isNull(), F.col(field)).otherwise(F.array_join(kept, "\n")))
    return joined.drop("_gone")
