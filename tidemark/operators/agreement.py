"""Agreement between callers: rates, kappas, departures, stability over runs, rater flags, follow rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import grouped, ratio
from tidemark.session import materialize


def share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def cohen_kappa(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Agreement rate and kappa of two 0/1 calls; kappa is null when chance agreement is complete."""
    c = grouped(df, keys).agg(
        F.count(F.lit(1)).alias("n"), share(F.col(a) == F.col(b)).alias("agreement"),
        F.avg(F.col(a).cast("double")).alias("pa_"), F.avg(F.col(b).cast("double")).alias("pb_"))
    pe = F.col("pa_") * F.col("pb_") + (1 - F.col("pa_")) * (1 - F.col("pb_"))
    return c.withColumn("kappa", F.when(pe < 1, (F.col("agreement") - pe) / (1 - pe))).drop("pa_", "pb_")


def fleiss_kappa(df: DataFrame, calls: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Fleiss' kappa of 0/1 calls of several runs, one column per run."""
    k = len(calls)
    ones = sum([F.col(c) for c in calls[1:]], F.col(calls[0]))
    zeros = k - ones
    item = (ones * (ones - 1) + zeros * (zeros - 1)) / F.lit(float(k * (k - 1)))
    c = grouped(df, keys).agg(F.count(F.lit(1)).alias("n"), F.avg(item).alias("p_"), F.avg(ones / F.lit(float(k))).alias("q_"))
    pe = F.col("q_") * F.col("q_") + (1 - F.col("q_")) * (1 - F.col("q_"))
    return c.withColumn("fleiss_kappa", F.when(pe < 1, (F.col("p_") - pe) / (1 - pe))).drop("p_", "q_")


def departures(df: DataFrame, call: str, reference: str, truth: str, keys: Sequence[str] = ()) -> DataFrame:
    """How often a call departs from the reference call, how often rightly, and in which direction."""
    away = F.col(call) != F.col(reference)
    return grouped(df, keys).agg(
        F.count(F.lit(1)).alias("points"), F.count_if(away).alias("departures"),
        F.count_if(away & (F.col(call) == F.col(truth))).alias("correct"),
        F.count_if(away & (F.col(call) == 0)).alias("to_silent"), F.count_if(away & (F.col(call) == 1)).alias("to_warn"))


def call_changes(df: DataFrame, item: str, checkpoint: str, calls: Sequence[str], first: float, second: float) -> DataFrame:
    """Items whose call differs between two checkpoints, per caller (long: caller, changed, items)."""
    at = lambda c, t: F.max(F.when(F.col(checkpoint) == t, F.col(c)))
    wide = df.groupBy(item).agg(*[a for c in calls for a in (at(c, first).alias(f"{c}__a"), at(c, second).alias(f"{c}__b"))])
    cells = F.array(*[F.struct(F.lit(c).alias("caller"), F.col(f"{c}__a").alias("a"), F.col(f"{c}__b").alias("b")) for c in calls])
    long = wide.select(F.explode(cells).alias("c")).select("c.*").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return long.groupBy("caller").agg(F.count_if(F.col("a") != F.col("b")).alias("changed"), F.count(F.lit(1)).alias("items"))


def run_stability(df: DataFrame, calls: Sequence[str], values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Share of items with the same call in all runs, and the mean sample SD of their values."""
    same = F.greatest(*calls) == F.least(*calls)
    n = float(len(values))
    mean = sum([F.col(v) for v in values[1:]], F.col(values[0])) / n
    var = sum([(F.col(v) - mean) * (F.col(v) - mean) for v in values], F.lit(0.0)) / (n - 1)
    return grouped(df, keys).agg(share(same).alias("same_call"), F.avg(F.sqrt(var)).alias("mean_sd"))


def rater_flags(df: DataFrame, a: str, b: str, keys: Sequence[str]) -> DataFrame:
    """Two raters' flags: each, both and either, for every combination of the keys and their totals."""
    x, y = F.col(a) == 1, F.col(b) == 1
    return df.cube(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(x).alias("a_flags"), F.count_if(y).alias("b_flags"),
        F.count_if(x & y).alias("both"), F.count_if(x | y).alias("either"))


def follow_rate(df: DataFrame, call: str, shown: str, original: str, truth: str, keys: Sequence[str] = ()) -> DataFrame:
    """How often a call follows the shown verdict, split by whether the original verdict was right."""
    follow, right = F.col(call) == F.col(shown), F.col(original) == F.col(truth)
    return grouped(df, keys).agg(
        F.count(F.lit(1)).alias("n"), share(follow).alias("follow"),
        F.count_if(right).alias("n_right"), ratio(F.count_if(follow & right), F.count_if(right)).alias("follow_when_right"),
        F.count_if(~right).alias("n_wrong"), ratio(F.count_if(follow & ~right), F.count_if(~right)).alias("follow_when_wrong"))


def arms_long(df: DataFrame, arms: dict[str, tuple[str, str, str]], keys: Sequence[str]) -> DataFrame:
    """Wide arm columns to rows: arm -> (warn, probability, unfinished share) columns."""
    cells = F.array(*[
        F.struct(F.lit(a).alias("arm"), F.col(w).cast("int").alias("warn"), F.col(p).cast("double").alias("p"),
                 F.col(u).cast("double").alias("unf")) for a, (w, p, u) in arms.items()
    ])
    return df.withColumn("a_", F.explode(cells)).select(*keys, "a_.*")


def arms_wide(long: DataFrame, item: Sequence[str], arm: str, names: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Long answers to one column per arm and value; the arm list is given, so no extra pass finds it."""
    return long.groupBy(*item).pivot(arm, list(names)).agg(*[F.first(v, ignorenulls=True).alias(v) for v in values])


def arm_metrics(long: DataFrame, group: str, keys: Sequence[str] = ("run", "arm", "checkpoint"), slices=None) -> DataFrame:
    """Per run, arm and checkpoint: rates, AUC pooled and within groups, calibration, agreement, errors.

    ``long`` has warn, p, unf, late, m_warn, unfinished (null where not scored) and the group.
    """
    from tidemark.operators.metrics import confusion_metrics
    from tidemark.operators.ranking import roc_auc, spearman, within_group_auc

    k = list(keys)
    long = materialize(long.select(*k, group, "warn", "p", "unf", "late", "m_warn", "unfinished"))  # six measures read it
    base = long.groupBy(*k).agg(
        F.avg(F.col("warn").cast("double")).alias("warn_rate"), F.avg("p").alias("mean_p"),
        F.avg(F.col("late").cast("double")).alias("late_rate"),
        F.avg((F.col("p") - F.col("late")) * (F.col("p") - F.col("late"))).alias("brier"),
        F.avg(F.abs(F.col("unf") - F.col("unfinished"))).alias("unf_mae"))
    parts = [
        confusion_metrics(long, k, "late", "warn").select(*k, "sensitivity", "specificity", "f1"),
        roc_auc(long, k, "p", "late", slices).select(*k, "auc"),
        within_group_auc(long, group, "p", "late", 2, k, slices).select(*k, "auc_within"),
        cohen_kappa(long, "warn", "m_warn", k).select(*k, F.col("agreement").alias("agree_m"), F.col("kappa").alias("kappa_m")),
        spearman(long, k, "unf", "unfinished", slices).select(*k, F.col("spearman").alias("unf_spearman")),
    ]
    for p in parts:
        base = base.join(p, k, "left")
    return base
