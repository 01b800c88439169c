"""Cutting oversized texts at natural boundaries (p1)."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of boundary, from the strongest pause to none, with the penalty of a cut there.
PENALTY = {"paragraph": 0.0, "sentence": 1.0, "line": 2.0, "clause": 4.0, "word": 8.0, "none": 40.0}
PIECE_COST, IMBALANCE = 6.0, 6.0
_PAUSES = (
    ("paragraph", re.compile(r"\n[^\S\n]*\n\s*")),
    ("sentence", re.compile(r"[.!?…]['\"”’»)\]]*\s+")),
    ("line", re.compile(r"\n\s*")),
)
_CLAUSE = re.compile(r"[,;:—–]['\"”’»)\]]*\s+")
_WORD = re.compile(r"\s+")
SPANS = "array<struct<start:int,end:int,fresh:int,cut:string>>"


def _boundaries(text: str, longest: int) -> tuple[list[int], list[str]]:
    """Positions inside the text where it may be cut, with their kinds. Weaker kinds are looked up
    only where stronger ones leave a stretch of more than ``longest`` characters."""
    n, best = len(text), {}
    for kind, pattern in _PAUSES:
        for m in pattern.finditer(text):
            best.setdefault(m.end(), kind)
    found = sorted(best.items())
    for pattern, kind in ((_CLAUSE, "clause"), (_WORD, "word"), (None, "none")):
        more, last = [], 0
        for at, _ in [*found, (n, "")]:
            if at - last > longest:
                if pattern:
                    more += [(m.end(), kind) for m in pattern.finditer(text, last, at)]
                else:
                    more += [(p, kind) for p in range(last + longest, at, longest)]
            last = at
        if more:
            found = sorted(found + more)
    at, kinds = [], []
    for p, kind in found:
        if 0 < p < n and (not at or p > at[-1]):
            at.append(p)
            kinds.append(kind)
    return at, kinds


def spans(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(start, end, first new character, kind of the cut at the end) of each piece of ``text``.

    Dynamic programming over the boundary positions: the cost of a division is the sum of the
    penalties of its cuts, a cost for each piece and the squared deviation of each piece from even
    size; pieces over the limit, their overlap included, aren't allowed.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, 0, "end")]
    at, kinds = _boundaries(text, max(1, min(1000, (limit - overlap) // 4)))
    pos = [0, *at, n]
    # Where a piece that begins anew at each boundary starts to repeat the one before.
    starts = [0]
    strong = [p for p, k in zip(at, kinds) if k != "none"]
    for p in at:
        low = max(0, p - overlap)
        k = bisect_left(strong, low)
        if k < len(strong) and strong[k] < p and p - strong[k] >= overlap // 4:
            starts.append(strong[k])
        else:
            m = _WORD.search(text, low, p)
            starts.append(m.end() if m and m.end() < p else low)
    where, begin = np.array(pos), np.array(starts)
    pen = np.array([0.0, *(PENALTY[k] for k in kinds), 0.0])
    even = n / -(-n // (limit - overlap // 2))
    best, prev = np.full(len(pos), np.inf), np.zeros(len(pos), dtype=int)
    best[0] = 0.0
    low = 0
    for j in range(1, len(pos)):
        while begin[low] < where[j] - limit:  # begin grows with the position
            low += 1
        size = where[j] - begin[low:j]
        cost = best[low:j] + IMBALANCE * ((size - even) / even) ** 2
        if len(cost):
            k = int(np.argmin(cost))
            best[j], prev[j] = cost[k] + pen[j] + PIECE_COST, low + k
    out, j = [], len(pos) - 1
    while j > 0:
        i = int(prev[j])
        out.append((starts[i], pos[j], pos[i], kinds[j - 1] if j <= len(kinds) else "end"))
        j = i
    return out[::-1]


def split_long(df: DataFrame, text: str, limit: int = 4096, overlap: int = 200) -> DataFrame:
    """One row per piece of each text: the columns of ``df`` with the text replaced by the piece, and
    ``piece_no`` (from 1), ``piece_start``, ``piece_end`` (code points, end excluded), ``piece_fresh``
    (where what the piece doesn't repeat begins) and ``piece_cut`` (the kind of pause at its end).

    No piece is longer than ``limit`` code points; each but the first repeats up to ``overlap`` of the
    one before. The pieces' parts from ``piece_fresh`` on, joined, are the text. Texts of up to
    ``limit`` are one piece and never leave the JVM; an empty text is one empty piece; a null text has
    no piece. Repeated rows are split each for itself. Columns with the names of the result's are replaced.
    """
    df = df.drop("piece_no", "piece_start", "piece_end", "piece_fresh", "piece_cut", "_spans", "_span", "_at")
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")

    @F.pandas_udf(SPANS)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("start", "end", "fresh", "cut"), s)) for s in spans(t, limit, overlap)])

    size = F.length(text)
    whole = F.array(
        F.struct(F.lit(0).alias("start"), size.alias("end"), F.lit(0).alias("fresh"), F.lit("end").alias("cut"))
    ).cast(SPANS)
    # Two branches rather than one conditional: an Arrow function is evaluated for every row that reaches it.
    short = df.where(size <= limit).withColumn("_spans", whole)
    long = df.where(size > limit).withColumn("_spans", cut(F.col(text)))
    # An inner explode would make the optimiser ask for the length of the spans first, and cut every text twice.
    rows = short.unionByName(long).select("*", F.posexplode_outer("_spans").alias("_at", "_span"))
    return rows.select(
        *[
            F.col(text).substr(F.col("_span.start") + 1, F.col("_span.end") - F.col("_span.start")).alias(c) if c == text else F.col(c)
            for c in df.columns
        ],
        (F.col("_at") + 1).alias("piece_no"),
        F.col("_span.start").alias("piece_start"),
        F.col("_span.end").alias("piece_end"),
        F.col("_span.fresh").alias("piece_fresh"),
        F.col("_span.cut").alias("piece_cut"),
    )
