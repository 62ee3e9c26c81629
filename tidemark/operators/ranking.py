"""Measures that depend on the order of scores: AUC, average precision, thresholds, ROC grids, quantiles.

Rows are first counted per (group, score), on the map side, so ties meet and a frequent score is one
row. The running counts over the sorted scores are then taken with :mod:`tidemark.operators.ordered`,
which spreads one large group over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import order_rows

GRID_STEPS = 200  # 201 points from 0 to 1


def score_cells(df: DataFrame, keys: Sequence[str], score: str, label: str, weight: Column | None = None) -> DataFrame:
    """Positives and negatives per (keys, score); ``weight`` counts a row more than once."""
    w = F.lit(1).cast("long") if weight is None else weight
    return df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 0, w).otherwise(0)).alias("neg"),
    )


def _grouped(df: DataFrame, keys: Sequence[str]):
    return df.groupBy(*keys) if keys else df.groupBy()


def auc_from_cells(cells: DataFrame, keys: Sequence[str], slices=None) -> DataFrame:
    """AUC per group with half a point for ties; null when a class is missing."""
    d = order_rows(cells, keys, [F.col("score")], slices).scan(sums_before={"below": F.col("neg")})
    wins = F.col("pos") * (F.col("below") + F.col("neg") / F.lit(2.0))
    out = _grouped(d, keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(wins).alias("u_"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return out.withColumn("auc", F.when(both, F.col("u_") / (F.col("n_pos").cast("double") * F.col("n_neg")))).drop("u_")


def roc_auc(df: DataFrame, keys: Sequence[str], score: str, label: str, slices=None) -> DataFrame:
    return auc_from_cells(score_cells(df, keys, score, label), keys, slices)


def within_group_auc(df: DataFrame, group: str, score: str, label: str, min_class: int = 1, keys: Sequence[str] = (), slices=None) -> DataFrame:
    """Mean of the group AUCs, plain and weighted by pairs, over groups with enough of both classes."""
    per = roc_auc(df, [*keys, group], score, label, slices)
    per = per.where((F.col("n_pos") >= min_class) & (F.col("n_neg") >= min_class))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return _grouped(per, keys).agg(
        F.avg("auc").alias("auc_within"), F.count(F.lit(1)).alias("groups"),
        (F.sum(F.col("auc") * pairs) / F.sum(pairs)).alias("auc_pair_weighted"),
    )


def average_precision(df: DataFrame, keys: Sequence[str], score: str, label: str, slices=None, weight: Column | None = None) -> DataFrame:
    """Sum over falling scores of the recall step times the precision."""
    cells = score_cells(df, keys, score, label, weight)
    d = order_rows(cells, keys, [F.col("score").desc()], slices).scan(sums={"tp": F.col("pos"), "fp": F.col("neg")})
    step = F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return _grouped(d, keys).agg(F.when(F.sum("pos") > 0, F.sum(step) / F.sum("pos")).alias("average_precision"))


def youden_threshold(df: DataFrame, keys: Sequence[str], score: str, label: str, slices=None) -> DataFrame:
    """Score t that maximises sensitivity + specificity of ``score >= t``; the lowest on ties."""
    cells = score_cells(df, keys, score, label)
    d = order_rows(cells, keys, [F.col("score")], slices).scan(
        sums_before={"pos_before": F.col("pos"), "neg_before": F.col("neg")},
        totals={"pos_all": F.col("pos"), "neg_all": F.col("neg")},
    )
    p, n = [F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("pos_all", "neg_all")]
    # (sensitivity + specificity) times both class sizes, so that equal values compare as equal
    gain = (F.col("pos_all") - F.col("pos_before")) * n + F.col("neg_before") * p
    return _grouped(d, keys).agg(
        F.max_by("score", F.struct(gain, -F.col("score"))).alias("threshold"),
        (F.max(gain / (p * n)) - 1).alias("youden_j"),
    )


def roc_grid(df: DataFrame, keys: Sequence[str], score: str, label: str, slices=None, steps: int = GRID_STEPS) -> DataFrame:
    """True-positive rate on an even grid of false-positive rates.

    Each score step covers a range of the grid and fills it itself, so no join with the grid is needed.
    """
    cells = score_cells(df, keys, score, label)
    return roc_grid_from_cells(cells, keys, slices, steps)


def roc_grid_from_cells(cells: DataFrame, keys: Sequence[str], slices=None, steps: int = GRID_STEPS) -> DataFrame:
    d = order_rows(cells, keys, [F.col("score").desc()], slices).scan(
        sums_before={"tp0": F.col("pos"), "fp0": F.col("neg")}, totals={"p": F.col("pos"), "n": F.col("neg")})
    d = d.where((F.col("p") > 0) & (F.col("n") > 0) & (F.col("neg") > 0))
    upward = lambda x: F.ceil(x * steps / F.col("n")).cast("int")
    end = upward(F.col("fp0") + F.col("neg"))
    last = F.when(F.col("fp0") + F.col("neg") == F.col("n"), F.lit(steps)).otherwise(end - 1)
    first = upward(F.col("fp0"))
    seq = F.when(last >= first, F.sequence(first, last))
    d = d.withColumn("step", F.explode(seq)).withColumn("fpr", F.col("step") / F.lit(float(steps)))
    share = (F.col("fpr") * F.col("n") - F.col("fp0")) / F.col("neg")
    at_end = F.col("step") == steps
    tpr = F.when(at_end, F.lit(1.0)).when(F.col("step") == 0, F.lit(0.0)).otherwise(
        (F.col("tp0") + share * F.col("pos")) / F.col("p"))
    return d.select(*keys, "step", "fpr", tpr.alias("tpr"))


def roc_band(grid: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and sample SD of the curves at each grid point."""
    return grid.groupBy(*keys, "step", "fpr").agg(
        F.avg("tpr").alias("tpr_mean"), F.stddev_samp("tpr").alias("tpr_sd"), F.count(F.lit(1)).alias("curves"))


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("times"))


def mid_ranks(df: DataFrame, keys: Sequence[str], value: str, slices=None) -> DataFrame:
    """(keys, value, times, rank): equal values share the mean of their ranks."""
    d = order_rows(value_counts(df, keys, value), keys, [F.col("value")], slices).scan(sums_before={"before": F.col("times")})
    return d.withColumn("rank", F.col("before") + (F.col("times") + 1) / F.lit(2.0)).drop("before")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], slices=None) -> DataFrame:
    """(keys, prob, value) with linear interpolation between the two nearest order statistics."""
    cells = value_counts(df, keys, value)
    d = order_rows(cells, keys, [F.col("value")], slices).scan(sums_before={"before": F.col("times")}, totals={"n": F.col("times")})
    position = lambda p: (F.col("n") - 1) * p
    lower = lambda p: F.floor(position(p))
    upper = lambda p: F.least(lower(p) + 1, F.col("n") - 1)
    holds = lambda i: (i >= F.col("before")) & (i < F.col("before") + F.col("times"))
    wanted = F.filter(F.array(*[F.lit(float(p)) for p in probs]), lambda p: holds(lower(p)) | holds(upper(p)))
    d = d.withColumn("prob", F.explode(wanted))
    p = F.col("prob")
    d = d.withColumns({"h_": position(p), "lo_": F.when(holds(lower(p)), F.col("value")), "hi_": F.when(holds(upper(p)), F.col("value"))})
    a, b = F.max("lo_"), F.max("hi_")
    return d.groupBy(*keys, "prob").agg((a + (b - a) * (F.max("h_") - F.floor(F.max("h_")))).alias("value"))


def rank_quartile(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bins: int = 4, name: str = "quartile", slices=None) -> DataFrame:
    """Bin of the row's rank (ties broken by the order) between evenly spaced quantile edges of the ranks."""
    from tidemark.operators.ordered import numbered

    d = numbered(df, keys, order, "rn_", "n_", slices)
    edge = F.ceil((F.col("rn_") - 1) * bins / F.greatest(F.col("n_") - 1, F.lit(1))) - 1
    return d.withColumn(name, F.greatest(F.lit(0), edge).cast("int")).drop("rn_", "n_")


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, slices=None) -> DataFrame:
    """Rank correlation per group; null when a side is constant. Equal pairs are counted first."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).alias("x_"), F.col(y).alias("y_")).agg(
        F.count(F.lit(1)).alias("w_"))
    rx = mid_ranks(df.where(F.col(y).isNotNull()), keys, x, slices).select(*keys, F.col("value").alias("x_"), F.col("rank").alias("rx"))
    ry = mid_ranks(df.where(F.col(x).isNotNull()), keys, y, slices).select(*keys, F.col("value").alias("y_"), F.col("rank").alias("ry"))
    d = pairs.join(rx, [*keys, "x_"]).join(ry, [*keys, "y_"])
    w = F.col("w_").cast("double")
    s = lambda e: F.sum(w * e)
    out = _grouped(d, keys).agg(F.sum("w_").alias("n"), s(F.col("rx")).alias("sx"), s(F.col("ry")).alias("sy"),
                               s(F.col("rx") * F.col("rx")).alias("sxx"), s(F.col("ry") * F.col("ry")).alias("syy"),
                               s(F.col("rx") * F.col("ry")).alias("sxy"))
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    rho = F.when((vx > 0) & (vy > 0), (n * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.sqrt(vx) * F.sqrt(vy)))
    return out.select(*keys, "n", rho.alias("spearman"))


def mann_whitney(df: DataFrame, keys: Sequence[str], value: str, first: Column, second: Column, slices=None) -> DataFrame:
    """U of the first sample against the second, z with tie correction and continuity, two-sided p."""
    label = F.when(first, 1).when(second, 0)
    cells = score_cells(df.withColumn("y_", label).where(F.col("y_").isNotNull()), keys, value, "y_")
    d = order_rows(cells, keys, [F.col("score")], slices).scan(sums_before={"below": F.col("neg")})
    t = (F.col("pos") + F.col("neg")).cast("double")
    out = _grouped(d, keys).agg(
        F.sum("pos").alias("n_first"), F.sum("neg").alias("n_second"),
        F.sum(F.col("pos") * (F.col("below") + F.col("neg") / F.lit(2.0))).alias("u_stat"),
        F.sum(t * t * t - t).alias("ties"),
    )
    n1, n2 = F.col("n_first").cast("double"), F.col("n_second").cast("double")
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    top = F.greatest(F.col("u_stat"), n1 * n2 - F.col("u_stat"))
    out = out.withColumn("z", F.when(sd > 0, (top - n1 * n2 / 2 - 0.5) / sd))
    return out.withColumn("p_value", F.least(F.lit(1.0), 2 * upper_tail(F.col("z")))).drop("ties")


def upper_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, Abramowitz and Stegun 26.2.17 (absolute error below 1e-7)."""
    # The published coefficients.
    coef = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = F.lit(0.0)
    for c in reversed(coef):
        poly = t * (F.lit(c) + poly)
    tail = poly * F.exp(-z * z / 2) / F.sqrt(F.lit(2.0) * F.pi())
    return F.when(z >= 0, tail).otherwise(1 - tail)
