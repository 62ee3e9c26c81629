"""Grouped descriptions of cohorts, sources and outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import edge_bin, ends_late_in_week, key_number, key_prefix
from tidemark.operators.ranking import exact_quantiles, rank_quartile, roc_auc, spearman
from tidemark.operators.skew import lookup_join, top_k


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str, slices=None) -> DataFrame:
    return exact_quantiles(df, keys, value, [0.5], slices).select(*keys, F.col("value").alias(name))


def project_table(df: DataFrame, slices=None) -> DataFrame:
    """Named aggregates per project: sizes, rates, medians, extremes, distinct days."""
    base = df.groupBy("project").agg(
        F.count(F.lit(1)).alias("sprints"), F.count_if(F.col("nonempty")).alias("nonempty"),
        F.avg(F.col("label_delay").cast("double")).alias("late_rate"),
        F.avg(F.when(F.col("nonempty"), F.col("label_spillover").cast("double"))).alias("spillover_rate"),
        F.avg("committed_issue_count").alias("mean_scope"), F.min("late_days").alias("min_late_days"),
        F.max("late_days").alias("max_late_days"), F.countDistinct("start_date").alias("start_days"))
    return base.join(medians(df, ["project"], "committed_issue_count", "median_scope", slices), "project", "left")


def rates_with_total(df: DataFrame, key: str, rates: dict[str, Column], total: str = "all", total_filter: Column | None = None) -> DataFrame:
    """Rates per key and one total row, which may use its own filter."""
    aggs = lambda d: [F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(n) for n, c in rates.items()]]
    if total_filter is None:
        out = df.rollup(key).agg(F.grouping(key).alias("g_"), *aggs(df))
        return out.withColumn(key, F.when(F.col("g_") == 1, F.lit(total)).otherwise(F.col(key))).drop("g_")
    top = df.where(total_filter).agg(*aggs(df)).withColumn(key, F.lit(total))
    return df.groupBy(key).agg(*aggs(df)).unionByName(top)


def value_counts_top(df: DataFrame, value: str, n: int) -> DataFrame:
    c = df.groupBy(value).agg(F.count(F.lit(1)).alias("count"))
    return top_k(c, [], [F.col("count").desc(), F.col(value)], n)


# Upper ends of the size classes in which spillover is reported.
SIZE_EDGES = [0, 1, 2, 3, 5, 10, float("inf")]
SIZE_NAMES = ["1", "2", "3", "4-5", "6-10", "11+"]


def rate_by_size(df: DataFrame, size: str, labels: Sequence[str], edges: Sequence[float] = SIZE_EDGES, names: Sequence[str] = SIZE_NAMES) -> DataFrame:
    """Rows and label rates per size class; rows outside the classes are left out."""
    return df.withColumn("bucket", edge_bin(F.col(size), edges, names)).where(F.col("bucket").isNotNull()).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"{c}_rate") for c in labels])


def source_description(df: DataFrame, source: str, slices=None) -> DataFrame:
    """Cohort per source: sprints, nonempty ones, projects, rates, median scope of the nonempty ones and date span."""
    nonempty = F.col("committed_issue_count") > 0
    base = df.groupBy(source).agg(
        F.count(F.lit(1)).alias("sprints"), F.count_if(nonempty).alias("nonempty"), F.count_if(F.col("committed_issue_count") == 0).alias("zero_scope"),
        F.countDistinct("project").alias("projects"),
        F.avg(F.col("label_delay").cast("double")).alias("late_rate"),
        F.avg(F.when(F.col("committed_issue_count") > 0, F.col("label_spillover").cast("double"))).alias("spillover_rate"),
        F.min("start_date").alias("first_start"), F.max("start_date").alias("last_start"))
    return base.join(medians(df.where(nonempty), [source], "committed_issue_count", "median_scope", slices), source, "left")


def audited_description(name: str, df: DataFrame, audit: DataFrame, slices=None) -> DataFrame:
    """One source's cohort with the counters of its scope audit (one row), each called ``audit_`` and its name."""
    d = source_description(df.withColumn("source", F.lit(name)), "source", slices).withColumn("one_", F.lit(1))
    counters = audit.select(F.lit(1).alias("one_"), *[F.col(c).alias(f"audit_{c}") for c in audit.columns])
    return d.join(F.broadcast(counters), "one_").drop("one_")


def feature_coverage(df: DataFrame, sets: dict[str, dict[str, Sequence[str]]]) -> DataFrame:
    """Per feature set and group: its features, and the share of the cells that are known."""
    cells = [(s, g, list(cols)) for s, groups in sets.items() for g, cols in groups.items()]
    one = df.agg(F.count(F.lit(1)).alias("rows_"), *[(sum(F.count(c) for c in cols) / (F.count(F.lit(1)) * len(cols))).alias(f"k{i}") for i, (_, _, cols) in enumerate(cells)])
    rows = F.array(*[F.struct(F.lit(s).alias("feature_set"), F.lit(g).alias("feature_group"), F.lit(len(cols)).cast("long").alias("features"), F.col(f"k{i}").alias("share_known")) for i, (s, g, cols) in enumerate(cells)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def open_count_rules(frame: DataFrame, outcomes: dict[str, tuple[str, str]], rules: Sequence[str], slices=None) -> DataFrame:
    """AUC of plain counts at each checkpoint, on the test side of boxes still open: (outcome, checkpoint, rule, n, n_neg, auc).

    ``outcomes``: name -> (label column, column with the side of its split).
    """
    there = frame.where("open_at_checkpoint")
    stack = lambda label: F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).cast("double").alias("score"), F.col(label).alias("label")) for r in rules]))
    long = None
    for name, (label, side) in outcomes.items():
        part = there.where(F.col(side) == "test").select(F.lit(name).alias("outcome"), "checkpoint", stack(label).alias("r")).select("outcome", "checkpoint", "r.*")
        long = part if long is None else long.unionByName(part)
    out = roc_auc(long, ["outcome", "checkpoint", "rule"], "score", "label", slices)
    return out.select("outcome", "checkpoint", "rule", (F.col("n_pos") + F.col("n_neg")).alias("n"), "n_neg", "auc")


def nothing_done_share(df: DataFrame, group: str = "project") -> DataFrame:
    """Share of nonempty sprints without any finished item."""
    ne = df.where(F.col("committed_issue_count") > 0)
    return ne.groupBy(group).agg(F.count(F.lit(1)).alias("nonempty"), F.avg((F.col("completed_issue_count") == 0).cast("double")).alias("share_nothing_done"))


def load_quartiles(df: DataFrame, slices=None) -> DataFrame:
    """Nonempty sprints with the quartile of their load inside the project."""
    ne = df.where((F.col("committed_issue_count") > 0) & F.col("scope_to_capacity").isNotNull())
    order = [F.col("scope_to_capacity"), F.col("start_date"), F.col("sprint_id")]
    return rank_quartile(ne, ["project"], order, 4, "load_quartile", slices)


def overload_table(loads: DataFrame, slices=None) -> DataFrame:
    """Outcome means per load quartile."""
    base = loads.groupBy("load_quartile").agg(
        F.count(F.lit(1)).alias("n"), F.avg("carry_ratio").alias("carry_ratio"),
        F.avg(F.col("label_spillover").cast("double")).alias("label_spillover"),
        F.avg(F.col("label_delay").cast("double")).alias("label_delay"), F.avg("late_days_capped").alias("late_days_capped"))
    return base.join(medians(loads, ["load_quartile"], "committed_issue_count", "median_planned", slices), "load_quartile")


def overload_correlation(loads: DataFrame, outcomes: Sequence[str] = ("carry_ratio", "label_delay", "late_days_capped"), slices=None) -> DataFrame:
    """Rank correlation of load with each outcome inside each project."""
    cells = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).cast("double").alias("y")) for o in outcomes])
    long = loads.select("project", "scope_to_capacity", F.explode(cells).alias("c")).select("project", "scope_to_capacity", "c.*")
    return spearman(long, ["project", "outcome"], "scope_to_capacity", "y", slices)


def overload_gap(loads: DataFrame, outcome: str, reps: int = 2000, seed: int = 42) -> DataFrame:
    """Heaviest minus lightest quartile, with an interval from resampled projects."""
    from tidemark.operators.resample import cluster_metric, interval

    q, v = F.col("load_quartile"), F.col(outcome).cast("double")
    sums = {"h": F.when(q == 3, v).otherwise(0.0), "nh": (q == 3).cast("double"), "l": F.when(q == 0, v).otherwise(0.0), "nl": (q == 0).cast("double")}
    metric = F.when((F.col("nh") > 0) & (F.col("nl") > 0), F.col("h") / F.col("nh") - F.col("l") / F.col("nl"))
    point = loads.agg(*[F.sum(e).alias(n) for n, e in sums.items()]).select(metric.alias("point"), F.lit(1).alias("one_"))
    ci = interval(cluster_metric(loads, "project", sums, metric, reps, seed), "value").withColumn("one_", F.lit(1))
    return ci.join(F.broadcast(point), "one_").drop("one_")


def resolution_timing(committed: DataFrame, sprints: DataFrame, slices=None) -> DataFrame:
    """One row: when committed items were resolved relative to the planned end and the closure."""
    m = committed.join(sprints.select("sprint_id", "complete_date"), "sprint_id")
    r, e, c = F.col("resolution_date"), F.col("end_date"), F.col("complete_date")
    lag = (F.unix_micros(r) - F.unix_micros(e)) / F.lit(86400e6)
    m = m.withColumns({"lag_": lag, "by_close_": F.coalesce(r <= c, F.lit(False))})
    known = lambda x: F.avg(F.when(r.isNotNull(), x.cast("double")))
    items = m.agg(
        F.count(F.lit(1)).alias("commitments"), F.avg(F.col("completed_by_end").cast("double")).alias("share_completed_by_end"),
        F.avg(r.isNull().cast("double")).alias("share_no_resolution"), known(F.col("lag_") <= 0).alias("share_by_planned_end"),
        known((F.col("lag_") > 0) & (F.col("lag_") <= 1)).alias("share_within_1_day"), known(r <= c).alias("share_by_closure"),
        known(F.col("lag_") > 30).alias("share_over_30_days"), F.lit(1).alias("one_"))
    mid = medians(m.where(F.col("lag_") > 0), [], "lag_", "median_lag_after_end", slices).withColumn("one_", F.lit(1))
    per = m.groupBy("sprint_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("completed_by_end").alias("end_"), F.count_if("by_close_").alias("close_"))
    s = per.agg(
        F.count(F.lit(1)).alias("sprints"), F.avg((F.col("end_") < F.col("n")).cast("double")).alias("spill_by_end"),
        F.avg((F.col("close_") < F.col("n")).cast("double")).alias("spill_by_closure"),
        F.avg((F.col("end_") == 0).cast("double")).alias("nothing_by_end"),
        F.avg((F.col("close_") == 0).cast("double")).alias("nothing_by_closure"), F.lit(1).alias("one_"))
    return items.join(F.broadcast(s), "one_").join(F.broadcast(mid), "one_", "left").drop("one_")


def first_addition_lag(changes: DataFrame, sprints: DataFrame) -> DataFrame:
    """Per sprint: hours from its start to the first event that added an item to it.

    An event adds a sprint when the id is in the new list and not in the old one.
    """
    from tidemark.functions.scalars import field_kind, id_tokens

    ids = lambda c: F.coalesce(id_tokens(F.col(c)), F.array().cast("array<string>"))
    added = changes.where(field_kind(F.col("field")) == "sprint").select(
        F.explode(F.array_except(ids("to_value"), ids("from_value"))).alias("token"), "change_date")
    first = added.groupBy(F.col("token").cast("long").alias("jira_sprint_id")).agg(F.min("change_date").alias("first_added"))
    j = sprints.join(first, "jira_sprint_id")
    return j.select("sprint_id", "project", ((F.unix_micros("first_added") - F.unix_micros("start_date")) / F.lit(3600e6)).alias("lag_hours"))


def addition_lag_shares(lags: DataFrame, sprints: DataFrame) -> DataFrame:
    """Of the given (empty) sprints: how many got a first item within an hour, a day, or ever after the start."""
    d = sprints.select("sprint_id", "project").join(lags.drop("project"), "sprint_id", "left")
    h = F.col("lag_hours")
    sh = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return d.groupBy("project").agg(F.count(F.lit(1)).alias("sprints"), sh((h > 0) & (h <= 1)).alias("within_1h"),
                                    sh((h > 0) & (h <= 24)).alias("within_24h"), sh(h > 0).alias("after_start"))


def majority_owner(df: DataFrame, item: str, owner: str) -> DataFrame:
    """Most frequent owner per item, the smallest on ties, with its count."""
    votes = df.groupBy(item, owner).agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy(item).agg(
        F.min_by(F.struct(owner, "votes"), F.struct(-F.col("votes"), F.col(owner))).alias("b"), F.sum("votes").alias("all_votes")
    ).select(item, f"b.{owner}", "b.votes", "all_votes")


def drop_strays(df: DataFrame, item: str, owner: str) -> DataFrame:
    """Rows whose owner is the majority owner of their item."""
    return df.join(majority_owner(df, item, owner).select(item, owner), [item, owner], "left_semi")


def coverage_gap(items: DataFrame, min_items: int = 200) -> DataFrame:
    """Per key prefix: share of numbers missing between the first in-sprint number and the highest."""
    d = items.select("project", key_prefix(F.col("issue_key")).alias("prefix"), key_number(F.col("issue_key")).alias("num"), "raw_sprint_id")
    g = d.groupBy("project", "prefix").agg(
        F.count(F.lit(1)).alias("items"), F.min(F.when(F.col("raw_sprint_id").isNotNull(), F.col("num"))).alias("lo"), F.max("num").alias("hi"))
    g = g.where(F.col("items") >= min_items)
    era = lookup_join(d, g.select("project", "prefix", "lo", "hi"), ["project", "prefix"], "inner").where(F.col("num").between(F.col("lo"), F.col("hi")))
    vis = era.groupBy("project", "prefix").agg(F.count(F.lit(1)).alias("visible"))
    out = g.join(vis, ["project", "prefix"], "left").withColumn("visible", F.coalesce("visible", F.lit(0)))
    return out.withColumn("gap", 1 - F.col("visible") / (F.col("hi") - F.col("lo") + 1))


def repeat_commitments(committed: DataFrame) -> DataFrame:
    """Distinct committed items, the share of repeats, and the share committed more than once."""
    per = committed.groupBy("project", "raw_issue_id").agg(F.count(F.lit(1)).alias("times"))
    return per.groupBy("project").agg(
        F.sum("times").alias("commitments"), F.count(F.lit(1)).alias("items"),
        (1 - F.count(F.lit(1)) / F.sum("times")).alias("share_repeats"), F.avg((F.col("times") > 1).cast("double")).alias("share_items_repeated"))


# States of a finished item.
FINISHED = ["closed", "done", "resolved"]


def missing_resolution(items: DataFrame, group: str, status: str = "status", finished: Sequence[str] = FINISHED) -> DataFrame:
    """Per group: share of finished items (by lower-cased state) without a resolution date."""
    done = items.where(F.lower(status).isin(list(finished)))
    return done.groupBy(F.col(group).alias("note")).agg(F.avg(F.col("resolution_date").isNull().cast("double")).alias("value"), F.count(F.lit(1)).alias("n"))


def label_sanity(df: DataFrame, slices=None) -> DataFrame:
    """(check, value, note) rows: rates, rates by size, medians, weekday of the planned end.

    Finished items without a date are a table of their own: :func:`missing_resolution`.
    """
    n = F.count(F.lit(1))
    one = lambda check, note, d, v: d.agg(v.alias("value"), n.alias("n")).select(F.lit(check).alias("check"), F.lit(note).alias("note"), F.col("value").cast("double").alias("value"), "n")
    late, ne = F.col("label_delay").cast("double"), df.where(F.col("committed_issue_count") > 0)
    week = df.withColumn("late_week", ends_late_in_week(F.col("end_date")))
    parts = [
        one("late_rate", "all", df, F.avg(late)),
        one("spillover_rate", "nonempty", ne, F.avg(F.col("label_spillover").cast("double"))),
        one("heavy_carry_rate", "nonempty", ne, F.avg((F.col("carry_ratio") >= 0.5).cast("double"))),
        one("late_1_to_3_days_share", "late", df.where(F.col("label_delay") == 1), F.avg((F.col("late_days") <= 3).cast("double"))),
        one("planned_end_fri_to_sun_share", "all", week, F.avg(F.col("late_week").cast("double"))),
        one("late_rate_end_fri_to_sun", "all", week.where("late_week"), F.avg(late)),
        one("late_rate_end_mon_to_thu", "all", week.where("not late_week"), F.avg(late)),
    ]
    by_size = rate_by_size(ne, "committed_issue_count", ["label_spillover"]).select(
        F.lit("spillover_rate_by_size").alias("check"), F.col("bucket").alias("note"), F.col("label_spillover_rate").alias("value"), "n")
    mid = lambda check, note, d, v: medians(d, [], v, "value", slices).select(F.lit(check).alias("check"), F.lit(note).alias("note"), F.col("value").cast("double").alias("value"), F.lit(d.count()).alias("n"))
    weekend = week.where(F.col("label_delay") == 1)
    parts += [
        one("late_end_fri_to_sun_closed_within_3_5_days_share", "late", weekend, F.avg((F.col("late_week") & (F.col("late_days") <= 3.5)).cast("double"))),
        mid("median_carry_share", "nonempty", ne, "carry_ratio"),
        mid("median_late_days", "late", df.where(F.col("label_delay") == 1), "late_days"),
    ]
    out = by_size
    for p in parts:
        out = out.unionByName(p)
    return out


def descriptive_numbers(split: DataFrame, spill_split: DataFrame) -> DataFrame:
    """(check, note, value): extremes, late rate by side, and spillover negatives of the test side by project.

    ``split``: all labelled boxes with their side; ``spill_split``: the nonempty ones, split on their own.
    """
    late = F.col("label_delay").cast("double")
    cells = {
        ("late_days", "min"): F.min("late_days"), ("late_days", "max"): F.max("late_days"),
        ("sprint_length_days", "min"): F.min("sprint_length_days"), ("sprint_length_days", "max"): F.max("sprint_length_days"),
        ("late_days_capped", "min"): F.min("late_days_capped"),
        ("late_rate", "train"): F.avg(F.when(F.col("side") == "train", late)), ("late_rate", "test"): F.avg(F.when(F.col("side") == "test", late)),
    }
    one = split.agg(*[v.cast("double").alias(f"v{k}") for k, v in enumerate(cells.values())])
    rows = F.array(*[F.struct(F.lit(c).alias("check"), F.lit(n).alias("note"), F.col(f"v{k}").alias("value")) for k, (c, n) in enumerate(cells)])
    negatives = spill_split.where((F.col("side") == "test") & (F.col("label_spillover") == 0)).groupBy("project").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return one.select(F.explode(rows).alias("r")).select("r.*").unionByName(
        negatives.select(F.lit("spill_test_negatives").alias("check"), F.col("project").alias("note"), "value"))


def groups_below(metrics: DataFrame, keys: Sequence[str] = (), value: str = "auc", least: float = 0.5) -> DataFrame:
    """Of the readable groups of a metrics table, how many stay under a value."""
    rows = metrics.where(F.col("interpretable"))
    return (rows.groupBy(*keys) if keys else rows.groupBy()).agg(F.count_if(F.col(value) < least).alias("below"), F.count(F.lit(1)).alias("groups"))


def reconcile_claims(claims: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Claimed value against the result row within a tolerance: PASS, FAIL or MISSING."""
    j = claims.join(results.select(*keys, F.col("value").alias("result")), list(keys), "left")
    ok = F.abs(F.col("claimed") - F.col("result")) <= F.col("tolerance") + 1e-12
    return j.withColumn("verdict", F.when(F.col("result").isNull(), "MISSING").when(ok, "PASS").otherwise("FAIL"))
