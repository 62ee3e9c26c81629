"""Joins and top-k that stay even when one key holds a large share of the rows.

Big-to-big joins in this package are plain equi joins whose output is shuffled on other keys next,
so adaptive execution may split the partitions of hot keys (``spark.sql.adaptive.skewJoin``). Where a
join key would also be the next grouping key, the large side is aggregated first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize


def lookup_join(df: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join to a per-key table, which is written once, so that its plan runs once and Spark knows its size.

    Its bytes against ``spark.sql.autoBroadcastJoinThreshold`` decide whether it is broadcast; else both sides are
    shuffled and adaptive execution splits the partitions of hot keys.
    """
    return df.join(materialize(dim), list(on), how)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group.

    Spark keeps only k rows per group on the map side (WindowGroupLimit) when the window is filtered
    by rank and k is under ``spark.sql.optimizer.windowGroupLimitThreshold``, so no task receives a
    whole group.
    """
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
