"""Registry of the named queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL where one exists."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def tidy(df: DataFrame, *cols, digits: int = 6) -> DataFrame:
    """Chosen columns, floats rounded and integers widened, so that engines agree on the values."""
    out = df.select(*cols) if cols else df
    fixed = {}
    for f in out.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            fixed[f.name] = F.round(F.col(f.name), digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            fixed[f.name] = F.col(f.name).cast("long")
    return out.withColumns(fixed)
