"""Value of a changing field at past instants.

``events`` have the columns key, ts, tie, before, after; ``tie`` orders events of one instant. The static
value is the present-day value of a key, used where the key has no events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import order_rows

GROUP_ROWS = 200_000  # keys of at most so many rows are scanned in one task each, larger ones in slices
BUCKETS = 8_192


def small_groups(keys: DataFrame) -> bool:
    """Has no key more than ``GROUP_ROWS`` rows? Counted over buckets of keys, so that no row per key is shuffled.

    A bucket has at least the rows of its largest key: the answer may be no without need, and the scan is then in slices.
    """
    n = keys.groupBy(F.pmod(F.xxhash64(*keys.columns), F.lit(BUCKETS)).alias("b_")).count().agg(F.max("count")).first()[0]
    return n is None or n <= GROUP_ROWS


def value_asof(
    events: DataFrame, probes: DataFrame, key: str, at: str, static: str | None = None, slices: int | None = None
) -> DataFrame:
    """Add ``value`` and ``has_history`` to each probe (key, ``at``, ...); ``static`` names a probe column.

    A change at the instant itself counts as applied, so the value is ``before`` of the first later
    event, ``after`` of the last event when none is later, and the static value for a key without
    events. One scan from the newest row to the oldest serves all probes of a key: in one task per key where all keys
    are small, and then the rows stay dealt by key; else in slices.
    """
    if slices is None and small_groups(events.select(key).unionByName(probes.select(key))):
        return _value_asof_by_key(events, probes, key, at, static)
    state = lambda v: F.struct(F.col(v).alias("v")).alias("s_")
    never = F.lit(None).cast("timestamp").alias("t_")
    ends = events.groupBy(key).agg(F.max_by("after", F.struct("ts", "tie")).alias("end_"))
    payload = [c for c in probes.columns if c not in (key, at)]
    # scan order: the newest state, then from new to old; at equal times probes come before events,
    # which therefore count as applied
    rows = (
        ends.select(key, never, F.lit(8).alias("kind_"), state("end_"))
        .unionByName(events.select(key, F.col("ts").alias("t_"), F.lit(0).alias("kind_"), state("before"), F.col("tie").alias("tie_")),
                     allowMissingColumns=True)
        .unionByName(probes.select(key, F.col(at).alias("t_"), F.lit(1).alias("kind_"), F.struct(F.lit(1).alias("row_"), *payload).alias("p_")),
                     allowMissingColumns=True)
    )
    order = [F.col("t_").desc_nulls_first(), F.col("kind_").desc(), F.col("tie_").desc()]
    seen = order_rows(rows, [key], order, slices).scan(lasts={"state_": F.col("s_")})
    known = F.col("state_").isNotNull()
    fallback = F.col(f"p_.{static}") if static else F.lit(None)
    return seen.where(F.col("kind_") == 1).select(
        key, F.col("t_").alias(at), *[F.col(f"p_.{c}").alias(c) for c in payload],
        F.when(known, F.col("state_.v")).otherwise(fallback).alias("value"), known.alias("has_history"),
    )


def _value_asof_by_key(events: DataFrame, probes: DataFrame, key: str, at: str, static: str | None) -> DataFrame:
    payload = [c for c in probes.columns if c not in (key, at)]
    one = lambda v, n: F.struct(F.col(v).alias("v")).alias(n)
    rows = events.select(key, F.col("ts").alias("t_"), F.lit(0).alias("kind_"), F.col("tie").alias("tie_"), one("before", "s_"), one("after", "e_")).unionByName(
        probes.select(key, F.col(at).alias("t_"), F.lit(1).alias("kind_"), F.struct(F.lit(1).alias("row_"), *payload).alias("p_")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col("t_").desc_nulls_first(), F.col("kind_").desc(), F.col("tie_").desc())
    later = F.last("s_", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    end = F.first("e_", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    seen = rows.withColumns({"later_": later, "end_": end}).where(F.col("kind_") == 1)
    fallback = F.col(f"p_.{static}") if static else F.lit(None)
    value = F.when(F.col("later_").isNotNull(), F.col("later_.v")).when(F.col("end_").isNotNull(), F.col("end_.v")).otherwise(fallback)
    return seen.select(
        key, F.col("t_").alias(at), *[F.col(f"p_.{c}").alias(c) for c in payload], value.alias("value"), F.col("end_").isNotNull().alias("has_history"))


def last_asof(events: DataFrame, probes: DataFrame, key: str, at: str, slices: int | None = None) -> DataFrame:
    """Add ``value`` to each probe (key, ``at``, ...): what the last event (key, ts, tie, after) up to the instant set.

    Null before the first event, for logs that hold only new values. One scan from the oldest row to the newest.
    """
    payload = [c for c in probes.columns if c not in (key, at)]
    rows = events.select(key, F.col("ts").alias("t_"), F.lit(0).alias("kind_"), F.col("tie").alias("tie_"), F.struct(F.col("after").alias("v")).alias("s_")).unionByName(
        probes.select(key, F.col(at).alias("t_"), F.lit(1).alias("kind_"), F.struct(F.lit(1).alias("row_"), *payload).alias("p_")), allowMissingColumns=True)
    seen = order_rows(rows, [key], [F.col("t_"), F.col("kind_"), F.col("tie_")], slices).scan(lasts={"state_": F.col("s_")})
    return seen.where(F.col("kind_") == 1).select(key, F.col("t_").alias(at), *[F.col(f"p_.{c}").alias(c) for c in payload], F.col("state_.v").alias("value"))


def value_spans(events: DataFrame, key: str, slices: int | None = None) -> DataFrame:
    """The step function of the keys with events as rows: key, valid_from, valid_to, value, last, from_history (true).

    A null bound is open. ``last`` marks the present-day interval. Events of one instant give empty intervals, which match
    nothing. The last event of a key closes one interval and opens another. Small keys stay dealt by key.
    """
    if slices is None and small_groups(events.select(key)):
        w = Window.partitionBy(key).orderBy("ts", "tie")
        d = events.withColumns({"prev_": F.lag("ts").over(w), "end_": F.lead(F.lit(True), 1, False).over(w)}).withColumn("end_", ~F.col("end_"))
    else:
        one = F.lit(1).cast("long")
        d = order_rows(events, [key], [F.col("ts"), F.col("tie")], slices).scan(
            sums={"rn_": one}, totals={"n_": one}, lasts_before={"prev_": F.col("ts")}).withColumn("end_", F.col("rn_") == F.col("n_"))
    never = F.lit(None).cast("timestamp")
    closed = _span(F.col("prev_"), F.col("ts"), F.col("before"), False, True)
    open_ = _span(F.col("ts"), never, F.col("after"), True, True)
    return d.select(key, F.explode(F.when(F.col("end_"), F.array(closed, open_)).otherwise(F.array(closed))).alias("x")).select(key, "x.*")


def _span(a, b, v, last: bool, hist: bool):
    return F.struct(a.alias("valid_from"), b.alias("valid_to"), v.alias("value"), F.lit(last).alias("last"), F.lit(hist).alias("from_history"))


def value_intervals(events: DataFrame, static: DataFrame, key: str, slices: int | None = None) -> DataFrame:
    """:func:`value_spans`, and for keys without events one interval from ``static``, not ``from_history``."""
    never = F.lit(None).cast("timestamp")
    bare = static.join(events.select(key).distinct(), key, "left_anti")
    return value_spans(events, key, slices).unionByName(
        bare.select(key, _span(never, never, F.col("value"), True, False).alias("x")).select(key, "x.*"))
