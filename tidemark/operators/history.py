"""History features: trailing values of earlier sprints and values of sprints whose outcome was known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import order_rows
from tidemark.session import materialize

HISTORY_WINDOW = 3

# Names of the features, their sets and their groups.
PLANNING_FEATURES = ["committed_issue_count", "committed_story_points", "sprint_length_days"]
TRAILING_FEATURES = [
    "prior_avg_delivered_sp_3", "prior_avg_completion_ratio_3", "prior_sprint_carryover",
    "prior_sprint_completion_ratio",
]
PROGRESS_FEATURES = [
    "elapsed_frac", "remaining_days", "done_share", "done_n", "remaining_n", "remaining_sp", "burn_gap",
    "required_rate", "observed_rate", "added_ratio", "added_done_n", "removed_ratio", "sp_change_ratio",
]
_PLAN = PLANNING_FEATURES + ["n_concurrent_sprints"]
_HIST = ["hist_avg_completion_ratio_3", "hist_last_carryover", "hist_avg_delivered_sp_3", "hist_n_available"]
_CAPACITY = ["hist_avg_completed_issues_3", "hist_avg_committed_issues_3", "scope_to_capacity"]
_LATE = ["hist_avg_late_days_3", "hist_late_rate_3"]
STRICT_FEATURES = _PLAN + _HIST + _CAPACITY + _LATE
LEGACY_FEATURES = PLANNING_FEATURES + TRAILING_FEATURES

FEATURE_SETS = {
    "strict": STRICT_FEATURES,
    "legacy": LEGACY_FEATURES,
    "checkpoint": STRICT_FEATURES + PROGRESS_FEATURES,
    "scope_only": PLANNING_FEATURES,
    "history_only": TRAILING_FEATURES,
    "legacy_plus_late": LEGACY_FEATURES + _LATE,
    "strict_minus_late": [c for c in STRICT_FEATURES if c not in _LATE],
    "strict_timed": PLANNING_FEATURES + _HIST,
    "strict_timed_plus_late": PLANNING_FEATURES + _HIST + _LATE,
}
FEATURE_GROUPS = {
    "scope": ["committed_issue_count", "committed_story_points"],
    "sprint length": ["sprint_length_days"],
    "parallel sprints": ["n_concurrent_sprints"],
    "recent history": _HIST,
    "capacity": _CAPACITY,
    "past lateness": _LATE,
    "project": ["project"],
}
LEGACY_GROUPS = {
    "scope": ["committed_issue_count", "committed_story_points"],
    "sprint length": ["sprint_length_days"],
    "recent history": TRAILING_FEATURES,
    "project": ["project"],
}
GROUPS_BY_SET = {"strict": FEATURE_GROUPS, "legacy": LEGACY_GROUPS}
# Columns that tell the outcome; none of them may be a feature.
OUTCOME_COLUMNS = [
    "complete_date", "late_days", "late_days_capped", "carry_ratio", "completion_ratio", "completed_issue_count",
    "not_completed_count", "delivered_story_points", "label_delay", "label_spillover", "at_risk", "label_late",
    "label_heavy_carry",
]


def mean_of(arr: Column) -> Column:
    """Mean of the non-null entries; null when there is none."""
    vals = F.filter(arr, lambda x: x.isNotNull())
    total = F.aggregate(vals, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(vals) > 0, total / F.size(vals))


def add_trailing_history(df: DataFrame, slices: int | None = None) -> DataFrame:
    """Values of the previous sprint by start, and trailing means over the three before this one.

    An undefined completion ratio counts as 1 in the history.
    """
    past = F.struct(
        F.col("delivered_story_points").cast("double").alias("sp"),
        F.coalesce("completion_ratio", F.lit(1.0)).alias("ratio"),
        F.col("not_completed_count").alias("carry"),
    )
    o = order_rows(df, ["project"], [F.col("start_date"), F.col("sprint_id")], slices)
    d = o.scan(previous={"past_": (past, HISTORY_WINDOW)})
    newest = F.get("past_", F.lit(0))
    return d.withColumns({
        "prior_avg_delivered_sp_3": mean_of(F.transform("past_", lambda x: x["sp"])),
        "prior_avg_completion_ratio_3": mean_of(F.transform("past_", lambda x: x["ratio"])),
        "prior_sprint_carryover": newest["carry"],
        "prior_sprint_completion_ratio": newest["ratio"],
        "has_prior_sprint": F.size("past_") > 0,
    }).drop("past_")


def add_strict_history(df: DataFrame, slices: int | None = None) -> DataFrame:
    """History from sprints whose outcome was known (planned end and closure passed) at this start.

    Each known sprint carries itself and the few known before it; a second ordered scan hands the
    newest such array to every start, which turns it into numbers and takes those by its sprint id. Four entries are kept so that
    three remain when the sprint itself, if it has no length, has to be left out.
    """
    df = materialize(df)  # rows as they are; only keys and facts go through the two scans
    known_at = F.greatest("end_date", "complete_date")
    number = lambda c: F.col(c).cast("double")
    base = df.select("project", known_at.alias("t"), F.col("start_date").alias("s"), "sprint_id", "late_days_capped", number("label_delay").alias("flag"),
                     *[number(c).alias(n) for c, n in (("committed_issue_count", "committed"), ("completed_issue_count", "completed"), ("not_completed_count", "carry"), ("delivered_story_points", "sp"))])
    series = F.when(F.col("committed") > 0, F.array(F.lit("all"), F.lit("nonempty"))).otherwise(F.array(F.lit("all")))
    every = F.col("series") == "all"
    # a series carries the facts that are read from it
    facts = F.struct(
        F.col("sprint_id").alias("id"), F.when(every, F.col("late_days_capped")).alias("late"), F.when(every, F.col("flag")).alias("late_flag"),
        *[F.when(~every, F.col(c)).alias(c) for c in ("committed", "completed", "carry", "sp")])
    known = base.withColumn("series", F.explode(series)).select("project", "t", "s", "sprint_id", "series", facts.alias("f"))
    known = order_rows(known, ["project", "series"], [F.col("t"), F.col("s"), F.col("sprint_id")], slices).scan(
        previous={"before_": (F.col("f"), HISTORY_WINDOW)}
    )
    known = known.select("project", "t", F.lit(0).alias("probe"), "s", F.col("sprint_id").alias("id_"), "series",
                         F.concat(F.array("f"), "before_").alias("arr"))
    probes = df.select("project", F.col("start_date").alias("t"), F.lit(1).alias("probe"), F.col("sprint_id").alias("own_"))
    rows = known.unionByName(probes, allowMissingColumns=True)
    seen = order_rows(rows, ["project"], [F.col("t"), F.col("probe"), F.col("s"), F.col("id_")], slices).scan(lasts={
        "all_": F.when(F.col("series") == "all", F.col("arr")),
        "nonempty_": F.when(F.col("series") == "nonempty", F.col("arr")),
    }).where(F.col("probe") == 1).select("own_", "all_", "nonempty_")

    def recent(c):
        others = F.filter(c, lambda x: x["id"] != F.col("own_"))
        return F.slice(F.coalesce(others, F.array().cast(df_type)), 1, HISTORY_WINDOW)

    df_type = seen.schema["all_"].dataType.simpleString()
    seen = seen.withColumns({"all_": recent(F.col("all_")), "nonempty_": recent(F.col("nonempty_"))})
    of = lambda arr, name: mean_of(F.transform(arr, lambda x: x[name]))
    seen = materialize(seen.select(
        "own_", of("all_", "late").alias("hist_avg_late_days_3"), of("all_", "late_flag").alias("hist_late_rate_3"),
        F.size("nonempty_").alias("hist_n_available"),
        mean_of(F.transform("nonempty_", lambda x: x["completed"] / x["committed"])).alias("hist_avg_completion_ratio_3"),
        F.get("nonempty_", F.lit(0))["carry"].alias("hist_last_carryover"), of("nonempty_", "sp").alias("hist_avg_delivered_sp_3"),
        of("nonempty_", "completed").alias("hist_avg_completed_issues_3"), of("nonempty_", "committed").alias("hist_avg_committed_issues_3")))
    avg_done = F.col("hist_avg_completed_issues_3")
    out = df.drop(*seen.columns).join(seen, F.col("sprint_id") == F.col("own_")).drop("own_")
    return out.withColumn("scope_to_capacity", F.when(avg_done.isNotNull(), F.col("committed_issue_count") / F.greatest(avg_done, F.lit(1.0))))


def add_concurrency(df: DataFrame, slices: int | None = None) -> DataFrame:
    """Other sprints of the project that started before this start and end after it.

    Running count of starts minus ends in time order; at one instant ends come first, then the
    sprints that ask, then starts. A sprint without length is never open.
    """
    long = F.col("end_date") > F.col("start_date")
    step = lambda t, kind, n: F.struct(t.alias("t"), F.lit(kind).alias("kind"), F.lit(n).cast("long").alias("n"))
    marks = df.where(long).select("project", F.explode(F.array(
        step(F.col("start_date"), 2, 1), step(F.col("end_date"), 0, -1))).alias("m")).select("project", "m.*")
    probes = df.select("project", F.col("start_date").alias("t"), F.lit(1).alias("kind"), F.struct(*df.columns).alias("row_"))
    rows = marks.unionByName(probes, allowMissingColumns=True)
    seen = order_rows(rows, ["project"], [F.col("t"), F.col("kind")], slices).scan(sums={"n_concurrent_sprints": F.col("n")})
    return seen.where(F.col("kind") == 1).select("row_.*", "n_concurrent_sprints")


def predecessor_overlap(df: DataFrame, slices: int | None = None) -> DataFrame:
    """Per project: how often the previous sprint by start had not ended or closed at this start."""
    o = order_rows(df, ["project"], [F.col("start_date"), F.col("sprint_id")], slices)
    d = o.scan(lasts_before={"p_": F.struct("end_date", "complete_date")})
    d = d.where(F.col("p_").isNotNull())
    end_open, close_open = F.col("p_.end_date") > F.col("start_date"), F.col("p_.complete_date") > F.col("start_date")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return d.groupBy("project").agg(
        F.count(F.lit(1)).alias("with_predecessor"),
        share(end_open).alias("share_end_after_start"), share(close_open).alias("share_close_after_start"),
        share(F.coalesce(end_open, F.lit(False)) | F.coalesce(close_open, F.lit(False))).alias("share_either"),
    )
