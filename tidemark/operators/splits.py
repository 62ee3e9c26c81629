"""Train and test sides: by time, by group, at random by hash, and stratified draws.

A random order is the order of an md5 of (seed, id), so a split is the same on every run and engine.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import hash_number
from tidemark.operators.ordered import numbered
from tidemark.operators.skew import lookup_join
from tidemark.session import materialize


def by_start() -> list[Column]:
    return [F.col("start_date"), F.col("sprint_id")]


def random_order(seed: int | str, key: str) -> list[Column]:
    """Hash order with the id itself as the last tie-breaker."""
    return [hash_number(F.lit(str(seed)), F.col(key).cast("string")), F.col(key)]


def _borders(df: DataFrame, group: str, bounds: Sequence[Column], slices=None) -> DataFrame | None:
    """A row per group (``group_``): ``last_``, for each bound the (start, id) of the last row whose number is within it.

    Only the keys are ordered and numbered. None if rows with one start and id lie on both sides of a bound.
    """
    keys = numbered(df.select(F.col(group).alias("group_"), *by_start()), ["group_"], by_start(), "rn_", "n_", slices)
    key = F.struct(*by_start())
    last = [F.max(F.when(F.col("rn_") <= b, key)) for b in bounds]
    after = [F.min(F.when(F.col("rn_") > b, key)) for b in bounds]
    torn = reduce(lambda x, y: x | y, [F.coalesce(l == a, F.lit(False)) for l, a in zip(last, after)])
    borders = materialize(keys.groupBy("group_").agg(F.array(*last).alias("last_"), torn.alias("torn_")))
    return None if borders.where("torn_").take(1) else borders.drop("torn_")


def _within(df: DataFrame, group: str, bounds: Sequence[Column], slices=None) -> DataFrame:
    """Add ``in_<k>``: whether the row's number by start in its group is within bound k, drawn from the group's size ``n_``.

    Rows are compared with the borders of their group, a small table, and stay where they are.
    """
    borders = _borders(df, group, bounds, slices)
    if borders is None:
        d = numbered(df, [group], by_start(), "rn_", "n_", slices)
        return d.withColumns({f"in_{k}": F.col("rn_") <= b for k, b in enumerate(bounds)}).drop("rn_", "n_")
    d = df.join(borders, F.col(group).eqNullSafe(F.col("group_")), "left")
    key = F.struct(*by_start())
    return d.withColumns({f"in_{k}": F.coalesce(key <= F.get("last_", F.lit(k)), F.lit(False)) for k in range(len(bounds))}).drop("group_", "last_")


def split_time(df: DataFrame, fraction: float = 0.7, group: str = "project", slices=None, in_order: bool = False) -> DataFrame:
    """First part of each group by start is the training side: max(1, int(n * fraction)) rows.

    With ``in_order`` the rows are laid out by group and start, for learners whose draws follow the layout of the rows.
    """
    cut = F.greatest(F.lit(1), F.floor(F.col("n_") * F.lit(float(fraction))))
    if in_order:
        d = numbered(df, [group], by_start(), "rn_", "n_", slices)
        return d.withColumn("side", F.when(F.col("rn_") <= cut, "train").otherwise("test")).drop("rn_", "n_")
    d = _within(materialize(df), group, [cut], slices)  # read twice: the keys alone, and the rows
    return d.withColumn("side", F.when(F.col("in_0"), "train").otherwise("test")).drop("in_0")


def split_rolling(df: DataFrame, cuts: Sequence[float] = (0.4, 0.5, 0.6, 0.7, 0.8), width: float = 0.2, group="project", slices=None) -> DataFrame:
    """Per cut: training rows up to it and the next ``width`` as test rows; bounds round half to even."""
    bound = lambda c: F.bround(F.col("n_") * F.lit(c))
    d = _within(materialize(df), group, [x for c in cuts for x in (bound(c), bound(c + width))], slices)
    inside = [f"in_{k}" for k in range(2 * len(cuts))]
    fold = F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("repeat"), F.col(inside[2 * i]).alias("lo"), F.col(inside[2 * i + 1]).alias("hi")) for i in range(len(cuts))
    ]))
    side = F.when(F.col("f_.lo"), "train").when(F.col("f_.hi"), "test")
    d = d.withColumn("f_", fold).withColumn("side", side).where(F.col("side").isNotNull())
    return d.withColumn("repeat", F.col("f_.repeat")).drop(*inside, "f_")


def leave_one_group_out(df: DataFrame, group: str = "project") -> list[str]:
    """Group values, each the test side of one fold. A fit per group follows, so their number is what a caller can afford."""
    return [r[0] for r in df.select(group).distinct().orderBy(group).collect()]


def split_logo(df: DataFrame, groups: Sequence[str], group: str = "project") -> DataFrame:
    """All folds in one table: (row, fold, side)."""
    fold = F.explode(F.array(*[F.lit(g) for g in groups]))
    return df.withColumn("fold", fold).withColumn("side", F.when(F.col(group) == F.col("fold"), "test").otherwise("train"))


def split_stratified(df: DataFrame, label: str, seed: int = 42, fraction: float = 0.3, key: str = "sprint_id", slices=None) -> DataFrame:
    """Random test side of ``fraction`` within each class."""
    d = numbered(df, [label], random_order(seed, key), "rn_", "n_", slices)
    cut = F.round(F.col("n_") * F.lit(float(fraction)))
    return d.withColumn("side", F.when(F.col("rn_") <= cut, "test").otherwise("train")).drop("rn_", "n_")


def split_kfold(df: DataFrame, label: str, k: int = 5, seed: int = 42, key: str = "sprint_id", slices=None) -> DataFrame:
    """Fold number 0..k-1, balanced within each class."""
    d = numbered(df, [label], random_order(seed, key), "rn_", None, slices)
    return d.withColumn("fold", ((F.col("rn_") - 1) % k).cast("int")).drop("rn_")


def split_calendar(df: DataFrame, fraction: float = 0.7, slices=None) -> DataFrame:
    """One cut instant for all groups: the quantile of the starts; train only on rows closed before it."""
    from tidemark.operators.ranking import exact_quantiles

    micros = df.select(F.unix_micros("start_date").alias("v"))
    cut = exact_quantiles(micros, [], "v", [fraction], slices).first()["value"]
    start, close = F.unix_micros("start_date"), F.unix_micros("complete_date")
    side = F.when(start >= cut, "test").when(close < cut, "train")
    return df.withColumn("side", side).where(F.col("side").isNotNull())


def purge_unknown(split: DataFrame, group: str = "project") -> DataFrame:
    """Drop training rows whose closure came after the first test start of their group."""
    first = split.where(F.col("side") == "test").groupBy(group).agg(F.min("start_date").alias("first_test_"))
    d = lookup_join(split, first, [group])
    late = (F.col("side") == "train") & F.coalesce(F.col("complete_date") > F.col("first_test_"), F.lit(False))
    return d.where(~late).drop("first_test_")


def carry_side(long: DataFrame, split: DataFrame, name: str, key: str = "sprint_id") -> DataFrame:
    """Attach the side of a fixed split to a longer table (null where the row is in neither)."""
    return long.join(split.select(key, F.col("side").alias(name)), key, "left")


def stratified_draw(df: DataFrame, strata: Sequence[str], n: int, seed: int = 42, key: str = "sprint_id", slices=None) -> DataFrame:
    """n rows per stratum in hash order, with the design weight pool size / sample size."""
    d = numbered(df, list(strata), random_order(seed, key), "rn_", "n_", slices)
    weight = F.col("n_") / F.least(F.col("n_"), F.lit(n))
    return d.where(F.col("rn_") <= n).withColumn("weight", weight).drop("rn_", "n_")


def class_weights(df: DataFrame, label: str, pool_rate: float) -> DataFrame:
    """Reweight a sample balanced by class to the pool's positive rate (sample rate 0.5)."""
    w = F.when(F.col(label) == 1, pool_rate / 0.5).otherwise((1 - pool_rate) / 0.5)
    return df.withColumn("weight", w)


def oversample(df: DataFrame, label: str, seed: int = 42, key: str = "sprint_id", slices=None) -> DataFrame:
    """Add copies of minority rows, drawn with replacement by hash, until the classes are equal.

    Draws are (draw number -> row number) pairs joined to the numbered minority rows.
    """
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    minority = min(counts, key=lambda c: (counts[c], c))
    need, have = max(counts.values()) - counts[minority], counts[minority]
    rows = numbered(df.where(F.col(label) == minority), [], random_order(seed, key), "rn_", None, slices)
    draws = df.sparkSession.range(need).select(
        F.col("id").alias("draw"), (hash_number(F.lit(str(seed)), F.lit("draw"), F.col("id").cast("string")) % have + 1).alias("rn_")
    )
    extra = draws.join(rows, "rn_").drop("rn_")
    return df.withColumn("draw", F.lit(None).cast("long")).unionByName(extra)


def quarters_to_score(test: DataFrame) -> list:
    """Start instants of the quarters that hold test rows, in order."""
    q = F.date_trunc("quarter", "start_date")
    return [r[0] for r in test.select(q.alias("q")).distinct().orderBy("q").collect()]


def batches(df: DataFrame, size: int, seed: int = 42, key: str = "sprint_id", within: Sequence[str] = (), slices=None) -> DataFrame:
    """Random order cut into batches of ``size`` (batch number from 1), per arm or checkpoint."""
    d = numbered(df, list(within), random_order(seed, key), "rn_", None, slices)
    return d.withColumn("batch", (F.floor((F.col("rn_") - 1) / size) + 1).cast("long")).drop("rn_")


def split_manifest(split: DataFrame, key: str = "sprint_id") -> DataFrame:
    """(id, side) rows of a split, to be written sorted and compared."""
    return split.select(key, "side")


def same_ids(a: DataFrame, b: DataFrame, key: str = "sprint_id") -> DataFrame:
    """One row: ids only in a, ids only in b; both 0 when the sets are equal."""
    tag = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    per = tag.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return per.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"),
                   F.count_if((F.col("b") == 1) & (F.col("a") == 0)).alias("only_b"))
