"""Ordered scans over groups of any size.

``Window.partitionBy(group)`` sends a whole group to one task, so a project, user or item that
holds a third of the rows becomes the bottleneck. Here the rows are range-partitioned on
(group, order) instead: a large group is spread over many slices. Windows then run inside
(slice, group), and what a slice must know about the earlier slices of the same group is carried
in by a small table. Range partitioning leaves at most one group open at the start of a slice,
so that table has at most two rows per slice and can be broadcast whatever the data size.

The slice numbers come from sampled range bounds, so the sliced rows are fixed as a table in the shared
folder: a lost executor re-reads the same slices, and later steps read only the columns they need.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

POS = "__pos"
SLICE = "__slice"
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the lower 33 bits


def _same_group(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"__r_{c}"]) for c in cols])


class OrderedRows:
    """Rows in a fixed total order inside each group, spread over slices."""

    def __init__(self, df: DataFrame, keys: Sequence[str]):
        self.df = df
        self.keys = list(keys)
        self.sliced = len(df.inputFiles()) > 1  # one file per slice that holds rows

    def scan(
        self,
        sums: dict[str, Column] | None = None,
        sums_before: dict[str, Column] | None = None,
        totals: dict[str, Column] | None = None,
        lasts: dict[str, Column] | None = None,
        lasts_before: dict[str, Column] | None = None,
        previous: dict[str, tuple[Column, int]] | None = None,
    ) -> DataFrame:
        """Add running columns.

        ``sums``/``sums_before``: running sum up to and with / before the row; ``totals``: sum over
        the group; ``lasts``/``lasts_before``: the last non-null value up to and with / before the row; ``previous``: the up to
        k earlier values as an array, newest first (nulls kept).
        """
        sums, sums_before, totals = sums or {}, sums_before or {}, totals or {}
        lasts, lasts_before, previous = lasts or {}, lasts_before or {}, previous or {}
        numeric = {**sums, **sums_before, **totals}
        df = self.df
        for name, expr in numeric.items():
            df = df.withColumn(f"__v_{name}", F.coalesce(expr, F.lit(0)))
        for name, expr in {**lasts, **lasts_before}.items():
            df = df.withColumn(f"__v_{name}", expr)
        for name, (expr, _) in previous.items():
            df = df.withColumn(f"__v_{name}", F.struct(expr.alias("v")))

        group = Window.partitionBy(SLICE, *self.keys)
        w = group.orderBy(POS)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        out = {}
        for n in sums:
            out[n] = F.sum(f"__v_{n}").over(upto)
        for n in sums_before:
            out[n] = F.coalesce(F.sum(f"__v_{n}").over(before), F.lit(0))
        for n in totals:
            out[n] = F.sum(f"__v_{n}").over(group)
        for n in lasts:
            out[n] = F.last(f"__v_{n}", ignorenulls=True).over(upto)
        for n in lasts_before:
            out[n] = F.last(f"__v_{n}", ignorenulls=True).over(before)
        for n, (_, k) in previous.items():
            out[n] = F.array_compact(F.array(*[F.lag(f"__v_{n}", j).over(w) for j in range(k, 0, -1)]))
        res = df.withColumns(out)
        if self.sliced:
            res = self._with_carry(df, res, {**sums, **sums_before}, totals, {**lasts, **lasts_before}, previous)
        res = res.withColumns({n: F.transform(F.reverse(n), lambda x: x["v"]) for n in previous})
        return res.drop(*[c for c in res.columns if c.startswith("__")])

    def _with_carry(self, df, res, sums, totals, lasts, previous) -> DataFrame:
        keys, at = self.keys, [SLICE, *self.keys]
        if keys:
            heads = df.groupBy(SLICE).agg(F.min(F.struct(*keys)).alias("h")).select("h.*").distinct()
            heads = heads.toDF(*[f"__r_{k}" for k in keys])
            rows = df.join(F.broadcast(heads), _same_group(df, heads, keys), "left_semi")
        else:
            rows = df
        parts = rows.groupBy(*at).agg(
            F.count(F.lit(1)).alias("__rows"),
            *[F.sum(f"__v_{n}").alias(n) for n in {**sums, **totals}],
            *[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col(POS))).alias(n) for n in lasts],
        )
        for n, (_, k) in previous.items():
            newest = Window.partitionBy(*at).orderBy(F.col(POS).desc())
            tail = (
                rows.select(*at, POS, f"__v_{n}").withColumn("__rn", F.row_number().over(newest))
                .where(F.col("__rn") <= k).groupBy(*at)
                .agg(F.sort_array(F.collect_list(F.struct(POS, f"__v_{n}"))).alias("t"))
                .select(*[F.col(c).alias(f"__r_{c}") for c in at], F.col(f"t.__v_{n}").alias(n))
            )
            parts = parts.join(tail, _same_group(parts, tail, at), "left").drop(*[f"__r_{c}" for c in at])
        along = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        earlier = along.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        cols = {}
        for n in sums:
            cols[n] = F.sum(n).over(earlier)
        for n in totals:
            cols[n] = F.sum(n).over(along)
        for n in lasts:
            cols[n] = F.last(n, ignorenulls=True).over(earlier)
        for n, (_, k) in previous.items():
            near = along.orderBy(SLICE).rowsBetween(-k, -1)
            flat = F.flatten(F.collect_list(n).over(near))
            cols[n] = F.slice(flat, F.greatest(F.size(flat) - k + 1, F.lit(1)), k)
        carry = parts.select(
            *[F.col(c).alias(f"__r_{c}") for c in at], *[c.alias(f"__c_{n}") for n, c in cols.items()]
        )
        res = res.join(F.broadcast(carry), _same_group(res, carry, at), "left")
        merged = {}
        for n in sums:
            merged[n] = F.col(n) + F.coalesce(F.col(f"__c_{n}"), F.lit(0))
        for n in totals:
            merged[n] = F.coalesce(F.col(f"__c_{n}"), F.col(n))
        for n in lasts:
            merged[n] = F.coalesce(F.col(n), F.col(f"__c_{n}"))
        for n, (_, k) in previous.items():
            both = F.when(F.col(f"__c_{n}").isNotNull(), F.concat(f"__c_{n}", n)).otherwise(F.col(n))
            merged[n] = F.slice(both, F.greatest(F.size(both) - k + 1, F.lit(1)), k)
        return res.withColumns(merged)


def order_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], slices: int | None = None) -> OrderedRows:
    """Fix the order of the rows inside each group and spread them over slices.

    ``order`` must make the order total where ties matter. ``slices`` defaults to the session's
    shuffle partitions, which adaptive execution merges down for small inputs.
    """
    cols = [F.col(k).asc() for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = df.repartitionByRange(slices, *cols) if slices else df.repartitionByRange(*cols)
    placed = ranged.sortWithinPartitions(*cols).withColumn(POS, F.monotonically_increasing_id())
    placed = placed.withColumn(SLICE, F.shiftright(POS, _ROW_BITS))
    return OrderedRows(materialize(placed), keys)


def numbered(df: DataFrame, keys, order, rn: str = "rn", size: str | None = None, slices=None) -> DataFrame:
    """Row number inside the group (from 1) and, if named, the group size."""
    one = F.lit(1).cast("long")
    return order_rows(df, keys, order, slices).scan(sums={rn: one}, totals={size: one} if size else None)
