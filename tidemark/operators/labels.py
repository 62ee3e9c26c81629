"""Outcome labels, numeric targets, corrected and alternative labels, populations and cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import clip, days_between, next_working_day_deadline, safe_ratio

# Label thresholds.
DELAY_DAYS = 1
LATE_CAP_DAYS = 30.0
FLAT_GRACE_DAYS = 3.0
CARRY_THRESHOLD = 0.5
CARRY_SENSITIVITY = (0.2, 0.3)
POINT_RATIO = 0.8

COMPLETION_HISTORY = [
    "hist_avg_completion_ratio_3", "hist_last_carryover", "hist_avg_delivered_sp_3",
    "hist_avg_completed_issues_3", "scope_to_capacity",
]


def flag(cond):
    """Boolean as 0/1; null counts as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def add_labels(df: DataFrame) -> DataFrame:
    """Late closure, spillover, either of them, and the completion ratio (null for empty scope)."""
    late = flag(days_between(F.col("complete_date"), F.col("end_date")) > DELAY_DAYS)
    spill = flag(F.col("not_completed_count") > 0)
    return df.withColumns({
        "label_delay": late,
        "completion_ratio": safe_ratio(F.col("completed_issue_count"), F.col("committed_issue_count")),
        "label_spillover": spill,
        "at_risk": F.greatest(late, spill),
    })


def add_targets(df: DataFrame) -> DataFrame:
    late = days_between(F.col("complete_date"), F.col("end_date"))
    return df.withColumns({
        "late_days": late,
        "late_days_capped": clip(late, 0.0, LATE_CAP_DAYS),
        "nonempty": F.col("committed_issue_count") > 0,
        "carry_ratio": safe_ratio(F.col("not_completed_count"), F.col("committed_issue_count")),
    })


def corrected_labels(df: DataFrame, broken_sources: Sequence[str] = ()) -> DataFrame:
    """Late after the next working day, flat grace, heavy carry at three cuts, and the usable rows.

    Sources whose resolution dates are broken keep no completion history.
    """
    broken = F.col("project").isin(list(broken_sources)) if broken_sources else F.lit(False)
    carry = F.col("carry_ratio")
    out = df.withColumns({
        "label_late_1d": F.col("label_delay"),
        "label_late_3d": flag(F.col("late_days") > FLAT_GRACE_DAYS),
        "label_late": flag(F.col("complete_date") > next_working_day_deadline(F.col("end_date"))),
        "resolution_ok": ~broken,
        "carry_valid": F.col("nonempty") & ~broken,
        "label_heavy_carry": flag(carry >= CARRY_THRESHOLD),
        **{f"label_carry_{int(t * 100)}": flag(carry >= t) for t in CARRY_SENSITIVITY},
    })
    masked = [c for c in COMPLETION_HISTORY if c in df.columns]
    return out.withColumns({c: F.when(~broken, F.col(c)) for c in masked})


def label_grid(
    df: DataFrame, delay_days: Sequence[float] = (0, 1, 3, 7), min_incomplete: Sequence[int] = (1, 2, 3),
    carry_cuts: Sequence[float] = (0.25, 0.5),
) -> DataFrame:
    """Long table (row, label name, 0/1) of alternative definitions of both outcomes."""
    late = days_between(F.col("complete_date"), F.col("end_date"))
    ratio = safe_ratio(F.col("delivered_story_points"), F.col("committed_story_points"))
    carry = safe_ratio(F.col("not_completed_count"), F.col("committed_issue_count"))
    labels = {f"late_over_{d}d": flag(late > d) for d in delay_days}
    labels |= {f"incomplete_at_least_{k}": flag(F.col("not_completed_count") >= k) for k in min_incomplete}
    labels |= {f"carry_at_least_{c}": flag(carry >= c) for c in carry_cuts}
    labels["point_ratio_below_0.8"] = flag(ratio < POINT_RATIO)
    entries = F.array(*[F.struct(F.lit(n).alias("label"), v.alias("value")) for n, v in labels.items()])
    return df.withColumn("l_", F.explode(entries)).select(*df.columns, "l_.label", "l_.value")


def population(df: DataFrame, name: str) -> DataFrame:
    """Named subsets: full, nonempty, carry (usable resolution dates), open, plausible (1 to 60 days)."""
    if name == "full":
        return df
    rules = {
        "nonempty": lambda: F.col("nonempty"),
        "carry": lambda: F.col("carry_valid"),
        "open": lambda: F.col("open_at_checkpoint"),
        "plausible": lambda: F.col("sprint_length_days").between(1, 60),
    }
    return df.where(rules[name]())


def cold_start_frame(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Drop the first row of each group and fail when a feature is still missing."""
    kept = df.where("has_prior_sprint")
    bad = kept.where(" or ".join(f"{c} is null" for c in features)).select("sprint_id").limit(10).collect()
    if bad:
        raise ValueError(f"missing feature values after cold-start filtering, first rows: {[r[0] for r in bad]}")
    return kept


def scope_presence(df: DataFrame) -> DataFrame:
    """First part of the two-part view: has the sprint any committed item?"""
    return df.withColumn("has_scope", flag(F.col("committed_issue_count") > 0))


def empty_scope_positives(df: DataFrame, label: str = "label_spillover") -> DataFrame:
    """How many empty sprints carry a positive label (must be 0), per group."""
    empty = F.col("committed_issue_count") == 0
    return df.groupBy("project").agg(
        F.count_if(empty).alias("empty"), F.count_if(~empty).alias("nonempty"),
        F.count_if(empty & (F.col(label) == 1)).alias("empty_positive"),
        F.count_if(~empty & (F.col(label) == 1)).alias("nonempty_positive"),
    )


def cohort_flow(sprints: DataFrame, frame: DataFrame) -> DataFrame:
    """Per project: from raw rows to modelled rows, and the positives among them."""
    s, dates = F.col("sprint_state"), [F.col(f"{c}_date") for c in ("start", "end", "complete")]
    present = dates[0].isNotNull() & dates[1].isNotNull() & dates[2].isNotNull()
    fine = present & (dates[1] >= dates[0]) & (dates[2] >= dates[0])
    raw = sprints.groupBy("project").agg(
        F.count(F.lit(1)).alias("raw"), F.count_if(s == "CLOSED").alias("closed"), F.count_if(s == "FUTURE").alias("future"),
        F.count_if(s == "ACTIVE").alias("active"),
        F.count_if((s == "CLOSED") & ~F.coalesce(fine, F.lit(False))).alias("invalid"),
        F.count_if((s == "CLOSED") & fine).alias("eligible"),
    )
    used = F.col("has_prior_sprint")
    modelled = frame.groupBy("project").agg(
        F.count_if(used).alias("modeled"),
        F.count_if(used & (F.col("committed_issue_count") == 0)).alias("zero_scope"),
        F.count_if(used & (F.col("committed_issue_count") > 0)).alias("nonempty"),
        F.count_if(used & (F.col("label_delay") == 1)).alias("late"),
        F.count_if(used & (F.col("label_spillover") == 1)).alias("spillover"),
    )
    return raw.join(modelled, "project", "left")
