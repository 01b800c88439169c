"""Mergeable percentiles with relative rank error (p3)."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECTION, SECTIONS = 64, 3
#: Three standard deviations of the rank error, as a part of the rank counted from the top.
RELATIVE_ERROR = 3 * (0.0512 / SECTIONS) ** 0.5 / SECTION


class Sketch:
    """Relative-rank compactors. Level h holds values that stand for 2**h each. A full level sorts its
    buffer, keeps the upper part, and hands every other value of the lower part to the next level;
    since the top is compacted last, the error of a rank is a part of its distance from the top."""

    __slots__ = ("levels", "n")

    def __init__(self) -> None:
        self.n = 0
        self.levels: list[list] = []  # [values, compactions so far, section size, sections]

    def _level(self, h: int) -> list:
        while len(self.levels) <= h:
            self.levels.append([np.empty(0), 0, SECTION, SECTIONS])
        return self.levels[h]

    def add(self, values: np.ndarray) -> Sketch:
        """Add values; NaN isn't allowed."""
        self.n += len(values)
        level = self._level(0)
        level[0] = np.concatenate([level[0], values])
        return self._compress()

    def merge(self, other: Sketch) -> Sketch:
        self.n += other.n
        for h, (values, done, section, sections) in enumerate(other.levels):
            mine = self._level(h)
            mine[0] = np.concatenate([mine[0], values])
            mine[1] |= done
            if sections > mine[3]:
                mine[2:] = [section, sections]
        return self._compress()

    def _compress(self) -> Sketch:
        h = 0
        while h < len(self.levels):
            level = self.levels[h]
            while len(level[0]) >= 2 * level[2] * level[3]:
                values, done, section, sections = level
                values = np.sort(values)
                free = min(((done ^ (done + 1)).bit_length()), sections)  # sections compacted this time
                keep = section * sections + (sections - free) * section
                cut = (len(values) - keep) // 2 * 2
                coin = xxhash.xxh64_intdigest(struct.pack("<qqd", done, h, float(values[0])), self.n) & 1
                above = self._level(h + 1)
                above[0] = np.concatenate([above[0], values[coin:cut:2]])
                level[0], level[1] = values[cut:], done + 1
                if done + 1 >= 1 << (sections - 1) and section > 8:
                    level[2], level[3] = max(8, int(section / 2**0.5) // 2 * 2), sections * 2
            h += 1
        return self

    def quantiles(self, probs: list[float]) -> list[float | None]:
        """The value at rank ceil(p x n) for each p; None for an empty sketch."""
        if not self.n:
            return [None] * len(probs)
        values = np.concatenate([level[0] for level in self.levels])
        weights = np.concatenate([np.full(len(level[0]), 1 << h) for h, level in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        at = np.searchsorted(ranks, [max(1, int(np.ceil(p * self.n))) for p in probs])
        return [float(values[order[min(k, len(order) - 1)]]) for k in at]

    def pack(self) -> bytes:
        head = struct.pack("<qi", self.n, len(self.levels))
        for values, done, section, sections in self.levels:
            head += struct.pack("<qiii", done, section, sections, len(values)) + values.astype("<f8").tobytes()
        return head

    @staticmethod
    def unpack(data: bytes) -> Sketch:
        s = Sketch()
        s.n, count = struct.unpack_from("<qi", data)
        at = 12
        for _ in range(count):
            done, section, sections, size = struct.unpack_from("<qiii", data, at)
            at += 20
            s.levels.append([np.frombuffer(data, "<f8", size, at), done, section, sections])
            at += 8 * size
        return s


def sketches(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Partial sketches ``*keys, measure, sketch``, one per key and measure in each partition.

    Nulls of a measure aren't counted (see ``p3`` for the log, where they mean zero); nor is NaN. Keys
    may be null. Rows of one key may lie in any partitions: ``merged`` puts the parts together.
    """
    schema = f"{', '.join(f'`{k}` {df.schema[k].dataType.simpleString()}' for k in keys)}, measure string, sketch binary"
    narrow = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in measures])

    def build(batches):
        open_: dict[tuple, list[Sketch]] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            code, names = pd.MultiIndex.from_frame(pdf[keys]).factorize()
            order = np.argsort(code, kind="stable")
            edges = np.searchsorted(code[order], np.arange(len(names) + 1))
            columns = [pdf[m].to_numpy()[order] for m in measures]
            for i, name in enumerate(names):
                own = open_.setdefault(tuple(None if x is pd.NaT or x != x else x for x in name), [Sketch() for _ in measures])
                for sketch, column in zip(own, columns):
                    part = column[edges[i] : edges[i + 1]]
                    part = part[~np.isnan(part)]
                    if len(part):
                        sketch.add(part)
        rows = [(*name, m, s.pack()) for name, own in open_.items() for m, s in zip(measures, own) if s.n]
        yield pd.DataFrame(rows, columns=[*keys, "measure", "sketch"])

    return narrow.mapInPandas(build, schema)


def merged(parts: DataFrame, keys: list[str], fan_in: int = 16) -> DataFrame:
    """One sketch ``*keys, measure, sketch`` per key and measure, from sketches of any partitions,
    days or files. A key's parts are first merged in ``fan_in`` salted groups (none if 1), so that no
    task holds all parts of a hot key; a sketch grows only as the logarithm of what it has seen. Parts
    are sorted by key within partitions and merged as they stream by."""
    by = [*keys, "measure"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*by, "sketch").schema)

    def run(batches):
        name, whole = None, None
        for pdf in batches:
            done = []
            columns = [pdf[c].astype(object).where(pdf[c].notna(), None) for c in by]
            for own, data in zip(zip(*columns), pdf["sketch"]):
                if own != name:
                    if whole is not None:
                        done.append((*name, whole.pack()))
                    name, whole = own, Sketch.unpack(data)
                else:
                    whole.merge(Sketch.unpack(data))
            yield pd.DataFrame(done, columns=[*by, "sketch"])
        if whole is not None:
            yield pd.DataFrame([(*name, whole.pack())], columns=[*by, "sketch"])

    def level(df: DataFrame, *salt: str) -> DataFrame:
        return df.repartition(*by, *salt).sortWithinPartitions(*by, *salt).select(*by, "sketch").mapInPandas(run, schema)

    first = parts.select(*by, "sketch")
    if fan_in > 1:
        first = level(first.withColumn("_salt", F.pmod(F.xxhash64("sketch"), F.lit(fan_in))), "_salt")
    return level(first)


def read_quantiles(df: DataFrame, probs: list[float]) -> DataFrame:
    """``n`` and ``quantiles array<double>`` of each sketch, in place of the sketch."""

    @F.pandas_udf("struct<n:long,quantiles:array<double>>")
    def read(data: pd.Series) -> pd.DataFrame:
        own = [Sketch.unpack(x) for x in data]
        return pd.DataFrame([(s.n, s.quantiles(probs)) for s in own], columns=["n", "quantiles"])

    rest = [c for c in df.columns if c != "sketch"]
    return df.select(*rest, read("sketch").alias("r")).select(*rest, "r.n", "r.quantiles")
