"""Scores and forecasts that need no fitting beyond a few training means and quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import exact_quantiles, roc_auc
from tidemark.operators.skew import lookup_join


def training_row(train: DataFrame, **stats: Column) -> dict:
    """A few training statistics as Python numbers."""
    return train.agg(*[e.alias(n) for n, e in stats.items()]).first().asDict()


def rule_scores(train: DataFrame, test: DataFrame, late: bool) -> DataFrame:
    """Rule columns: committed count, past lateness or past carry share, remaining count and share.

    Missing history is filled with the training mean.
    """
    fill = training_row(train, late=F.avg("hist_late_rate_3"), carry=F.avg(1 - F.col("hist_avg_completion_ratio_3")))
    cols = {"rule_committed": F.col("committed_issue_count").cast("double")}
    if late:
        cols["rule_past_lateness"] = F.coalesce("hist_late_rate_3", F.lit(fill["late"] if fill["late"] is not None else 0.0))
    else:
        cols["rule_past_carry"] = F.coalesce(1 - F.col("hist_avg_completion_ratio_3"), F.lit(fill["carry"] if fill["carry"] is not None else 0.5))
    if "remaining_n" in test.columns:
        cols["rule_remaining"] = F.col("remaining_n").cast("double")
        cols["rule_remaining_share"] = 1 - F.col("done_share")
    return test.withColumns(cols)


def rule_scores_by(long: DataFrame, keys: Sequence[str], late: bool) -> DataFrame:
    """``rule_scores`` on both sides of several splits at once: ``keys`` name the split, ``side`` the side."""
    fill = long.where(F.col("side") == "train").groupBy(*keys).agg(
        F.avg("hist_late_rate_3").alias("fill_late_"), F.avg(1 - F.col("hist_avg_completion_ratio_3")).alias("fill_carry_"))
    d = long.join(F.broadcast(fill), list(keys), "left")  # a row per split
    cols = {"rule_committed": F.col("committed_issue_count").cast("double")}
    if late:
        cols["rule_past_lateness"] = F.coalesce("hist_late_rate_3", "fill_late_", F.lit(0.0))
    else:
        cols["rule_past_carry"] = F.coalesce(1 - F.col("hist_avg_completion_ratio_3"), "fill_carry_", F.lit(0.5))
    if "remaining_n" in long.columns:
        cols["rule_remaining"] = F.col("remaining_n").cast("double")
        cols["rule_remaining_share"] = 1 - F.col("done_share")
    return d.withColumns(cols).drop("fill_late_", "fill_carry_")


def group_rate(train: DataFrame, test: DataFrame, group: str, label: str, name: str = "group_rate") -> DataFrame:
    """Training rate of the row's group, the overall rate for a group without training rows."""
    overall = training_row(train, r=F.avg(F.col(label).cast("double")))["r"]
    rates = train.groupBy(group).agg(F.avg(F.col(label).cast("double")).alias("rate_"))
    return lookup_join(test, rates, [group]).withColumn(name, F.coalesce("rate_", F.lit(overall))).drop("rate_")


def group_weekday_rate(train: DataFrame, test: DataFrame, group: str, ts: str, label: str, support: int = 5) -> DataFrame:
    """Rate of (group, weekday of the planned end) with enough rows, else the group's, else overall."""
    day = F.weekday(ts)
    cell = train.groupBy(group, day.alias("day_")).agg(F.avg(F.col(label).cast("double")).alias("cell_"), F.count(F.lit(1)).alias("n_"))
    cell = cell.where(F.col("n_") >= support).drop("n_")
    t = group_rate(train, test.withColumn("day_", day), group, label, "group_")
    t = lookup_join(t, cell, [group, "day_"])
    return t.withColumn("weekday_rate", F.coalesce("cell_", "group_")).drop("cell_", "group_", "day_")


def constant_scores(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Always positive, and the training base rate."""
    base = training_row(train, r=F.avg(F.col(label).cast("double")))["r"]
    return test.withColumns({"always_positive": F.lit(1.0), "base_rate": F.lit(base)})


def trailing_ratio_rule(df: DataFrame, cut: float = 0.8) -> DataFrame:
    """Warn when the trailing completion ratio is under the cut; a mean that equals it up to rounding is not."""
    return df.withColumn("heuristic", F.coalesce((F.round("prior_avg_completion_ratio_3", 9) < cut).cast("int"), F.lit(0)))


def regression_baselines(train: DataFrame, test: DataFrame, target: str, history: str, group: str = "project", slices=None) -> DataFrame:
    """Training mean and median, scope times completion rate, own history, and the group median."""
    s = training_row(train, mean=F.avg(target), done=F.sum("completed_issue_count"), all=F.sum("committed_issue_count"))
    median = exact_quantiles(train, [], target, [0.5], slices).first()["value"]
    per = exact_quantiles(train, [group], target, [0.5], slices).select(group, F.col("value").alias("median_"))
    rate = s["done"] / s["all"] if s["all"] else None
    scope = F.lit(1 - rate) if target == "carry_ratio" else F.col("committed_issue_count") * F.lit(rate)
    past = 1 - F.col(history) if target == "carry_ratio" else F.col(history)
    fill = median if target == "late_days_capped" else s["mean"]
    return lookup_join(test, per, [group]).withColumns({
        "train_mean": F.lit(s["mean"]), "train_median": F.lit(median), "scope_x_rate": scope,
        "prior_history": F.coalesce(past, F.lit(fill)), "group_median": F.coalesce("median_", F.lit(median)),
    }).drop("median_")


def training_quantile_forecasts(train: DataFrame, test: DataFrame, slices=None) -> DataFrame:
    """Done: training quantiles of the completion share times the scope; late days: training quantiles."""
    ne = train.where(F.col("committed_issue_count") > 0).withColumn("share_", F.col("completed_issue_count") / F.col("committed_issue_count"))
    qs = {r["prob"]: r["value"] for r in exact_quantiles(ne, [], "share_", [0.1, 0.5, 0.9], slices).collect()}  # 3 rows
    late = {r["prob"]: r["value"] for r in exact_quantiles(train, [], "late_days_capped", [0.5, 0.9], slices).collect()}  # 2 rows
    n = F.col("committed_issue_count")
    return test.withColumns({
        "q10": n * qs[0.1], "q50": n * qs[0.5], "q90": n * qs[0.9],
        "late_q50": F.lit(late[0.5]), "late_q90": F.lit(late[0.9]),
    })


def best_rule(train: DataFrame, rules: Sequence[str], label: str, slices=None) -> DataFrame:
    """The rule with the highest training AUC (the first in the given order on ties)."""
    cells = F.array(*[F.struct(F.lit(r).alias("model"), F.col(r).cast("double").alias("score")) for r in rules])
    place = F.array_position(F.array(*[F.lit(r) for r in rules]), F.col("model"))
    long = train.select(label, F.explode(cells).alias("c")).select(label, "c.*")
    auc = roc_auc(long, ["model"], "score", label, slices)
    return auc.agg(F.min_by(F.struct("model", "auc"), F.struct(-F.col("auc"), place)).alias("b")).select(
        F.col("b.model").alias("rule"), F.col("b.auc").alias("train_auc"))
