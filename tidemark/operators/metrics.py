"""Measures that are plain sums: confusion counts, errors of probabilities and of forecasts, calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import edge_bin, uniform_bin
from tidemark.operators.ranking import rank_quartile, spearman


def grouped(df: DataFrame, keys: Sequence[str]):
    return df.groupBy(*keys) if keys else df.groupBy()


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def confusion_metrics(df: DataFrame, keys: Sequence[str], label: str, pred: str, weight: Column | None = None) -> DataFrame:
    """Counts, precision, recall and F1 (0 when undefined), sensitivity and specificity (null when undefined)."""
    w = F.lit(1).cast("long") if weight is None else weight
    y, p = F.col(label), F.col(pred)
    cell = lambda a, b, n: F.sum(F.when((y == a) & (p == b), w).otherwise(0)).alias(n)
    c = grouped(df, keys).agg(cell(1, 1, "tp"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(0, 0, "tn"))
    tp, fp, fn, tn = [F.col(x) for x in ("tp", "fp", "fn", "tn")]
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return c.withColumns({
        "n": tp + fp + fn + tn, "n_pos": tp + fn, "n_neg": fp + tn,
        "precision": zero(ratio(tp, tp + fp)), "recall": zero(ratio(tp, tp + fn)),
        "f1": zero(ratio(2 * tp, 2 * tp + fp + fn)),
        "sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp),
    })


def brier(df: DataFrame, keys: Sequence[str], label: str, prob: str) -> DataFrame:
    """Mean squared error of a probability; scores outside [0, 1] are not hidden."""
    gap = F.col(prob) - F.col(label)
    return grouped(df, keys).agg(F.avg(gap * gap).alias("brier"))


def regression_metrics(df: DataFrame, keys: Sequence[str], truth: str, pred: str, slices=None) -> DataFrame:
    """n, mean absolute error, R2 and Spearman; R2 from sums in one pass."""
    y, p = F.col(truth), F.col(pred)
    sums = grouped(df, keys).agg(
        F.avg(F.abs(y - p)).alias("mae"), F.sum((y - p) * (y - p)).alias("sse"),
        (F.var_pop(y) * F.count(y)).alias("sst"),
    )
    sums = sums.withColumn("r2", F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst"))).drop("sse", "sst")
    rho = spearman(df, keys, truth, pred, slices)
    if keys:
        return rho.join(sums, list(keys))
    return rho.withColumn("one_", F.lit(1)).join(F.broadcast(sums.withColumn("one_", F.lit(1))), "one_").drop("one_")


def pinball(truth: Column, pred: Column, q: float) -> Column:
    d = truth - pred
    return F.greatest(q * d, (q - 1) * d)


def interval_quality(df: DataFrame, truth: str, low: str, mid: str, high: str, size: str, keys: Sequence[str] = (), quantiles=(0.1, 0.5, 0.9)) -> DataFrame:
    """Coverage (all and by size bucket), width, error of the middle and mean pinball loss."""
    y = F.col(truth)
    inside = ((y >= F.col(low)) & (y <= F.col(high))).cast("double")
    bucket = size_bucket(F.col(size))
    losses = [pinball(y, F.col(c), q) for c, q in zip((low, mid, high), quantiles)]
    return grouped(df, keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(inside).alias("coverage"),
        F.avg(F.col(high) - F.col(low)).alias("width"), F.avg(F.abs(y - F.col(mid))).alias("mae_median"),
        F.avg(sum(losses[1:], losses[0]) / len(losses)).alias("mean_pinball"),
        F.avg(F.when(bucket == "1-3 issues", inside)).alias("coverage_small"),
        F.avg(F.when(bucket == "4-12 issues", inside)).alias("coverage_medium"),
        F.avg(F.when(bucket == "13+ issues", inside)).alias("coverage_large"),
    )


def size_bucket(size: Column) -> Column:
    return edge_bin(size, [0, 3, 12, float("inf")], ["1-3 issues", "4-12 issues", "13+ issues"])


def calibration_uniform(df: DataFrame, prob: str, label: str, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    d = df.withColumn("bin", uniform_bin(F.col(prob), bins))
    return _calibration(d, prob, label, keys)


def calibration_quartiles(df: DataFrame, prob: str, label: str, tie: Sequence[Column], bins: int = 4, keys: Sequence[str] = (), slices=None) -> DataFrame:
    d = rank_quartile(df, keys, [F.col(prob), *tie], bins, "bin", slices)
    return _calibration(d, prob, label, keys)


def _calibration(d: DataFrame, prob: str, label: str, keys: Sequence[str]) -> DataFrame:
    return d.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_predicted"),
        F.avg(F.col(label).cast("double")).alias("observed_rate"))


def interpretable(metrics: DataFrame, min_class: int = 5) -> DataFrame:
    """Flag rows with enough of both classes to be read."""
    return metrics.withColumn("interpretable", (F.col("n_pos") >= min_class) & (F.col("n_neg") >= min_class))


def mean_sd(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and sample SD over repeats."""
    aggs = [a for v in values for a in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_sd"))]
    return grouped(df, keys).agg(F.count(F.lit(1)).alias("repeats"), *aggs)
