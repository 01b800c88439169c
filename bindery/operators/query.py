"""A small query algebra over collections: equality, membership and range filters, projection, order,
limit, offset and reading at a version; built as a DataFrame plan and never as text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .versions import as_of

_ID = re.compile(r"[a-zA-Z0-9_-]+")


def valid_id(text: str | None, longest: int = 500) -> bool:
    """Letters, digits, underscore and hyphen, not empty, not too long."""
    return bool(text) and len(text) <= longest and _ID.fullmatch(text) is not None


def valid_ids(column: Column, longest: int = 500) -> Column:
    """``valid_id`` as a column; null isn't valid."""
    return F.coalesce(column.rlike("^[a-zA-Z0-9_-]+$") & (F.length(column) <= longest), F.lit(False))


@dataclass(frozen=True)
class Query:
    """An unfinished query; each call gives a new one. All filters must hold. Without ``fields`` only the
    document id is read."""

    collection: str
    tests: tuple[tuple[str, str, object], ...] = ()
    columns: tuple[str, ...] = ("_docid",)
    order: tuple[str, bool] | None = None
    most: int = 0
    skip: int = 0
    at: object = None
    key: str = field(default="_docid")
    version: str = field(default="created_at")

    def _with(self, name: str, op: str, value: object) -> Query:
        return replace(self, tests=(*self.tests, (name, op, value)))

    def filter(self, name: str, value: object) -> Query:
        return self._with(name, "eq", value)

    def filter_in(self, name: str, values: list) -> Query:
        return self._with(name, "in", list(values))

    def filter_gt(self, name: str, value: object) -> Query:
        return self._with(name, "gt", value)

    def filter_lt(self, name: str, value: object) -> Query:
        return self._with(name, "lt", value)

    def filter_gte(self, name: str, value: object) -> Query:
        return self._with(name, "ge", value)

    def filter_lte(self, name: str, value: object) -> Query:
        return self._with(name, "le", value)

    def fields(self, *names: str) -> Query:
        return replace(self, columns=names)

    def order_by(self, name: str, descending: bool = False) -> Query:
        """The last call counts. Ties follow the key, so results are stable."""
        return replace(self, order=(name, descending))

    def limit(self, n: int) -> Query:
        return replace(self, most=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def as_of(self, version: object) -> Query:
        """Read every document as it was at a version; None or '' reads the present."""
        return replace(self, at=version or None)

    def build(self, spark: SparkSession, folder: str) -> DataFrame:
        df = table(spark, folder, self.collection)
        if self.at is not None:
            df = as_of(df, [self.key], self.version, F.lit(self.at).cast("timestamp"), [])
        for name, op, value in self.tests:
            c = F.col(name)
            df = df.where(c.isin(value) if op == "in" else getattr(c, f"__{op}__")(F.lit(value)))
        if self.order:
            name, down = self.order
            df = df.orderBy(F.col(name).desc() if down else F.col(name).asc(), *([self.key] if self.key in df.columns else []))
        if self.skip:
            df = df.offset(self.skip)
        if self.most:
            df = df.limit(self.most)
        return df.select(*self.columns)


def by_id(spark: SparkSession, folder: str, collection: str, doc_id: str, *columns: str) -> DataFrame:
    """One document, or no row; an invalid id is an error."""
    if not valid_id(doc_id):
        raise ValueError(f"not a document id: {doc_id!r}")
    return Query(collection).filter("_docid", doc_id).fields(*(columns or ("_docid",))).build(spark, folder)
