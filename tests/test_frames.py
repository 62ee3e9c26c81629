"""Labels, history features and splits."""

from datetime import datetime as dt
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as sc
from tidemark.operators import history, labels, ranking, splits

FRAME = "sprint_id string, start_date timestamp, end_date timestamp, complete_date timestamp, committed_issue_count long, completed_issue_count long, project string"


def frame(spark, rows):
    df = spark.createDataFrame([(*r, "P") for r in rows], FRAME).withColumns({
        "not_completed_count": F.col("committed_issue_count") - F.col("completed_issue_count"),
        "delivered_story_points": F.col("completed_issue_count") * 2.0, "committed_story_points": F.col("committed_issue_count") * 2.0})
    return labels.add_targets(labels.add_labels(df))


S = [("S1", dt(2020, 1, 1), dt(2020, 1, 10), dt(2020, 1, 10), 10, 8), ("S2", dt(2020, 1, 5), dt(2020, 1, 20), dt(2020, 1, 25), 20, 10),
     ("S3", dt(2020, 1, 15), dt(2020, 1, 30), dt(2020, 1, 30), 5, 5), ("S4", dt(2020, 2, 10), dt(2020, 2, 20), dt(2020, 2, 20), 6, 3)]


@pytest.mark.parametrize("slices", [None, 4])
def test_strict_history_and_concurrency(spark, slices):
    f = history.add_strict_history(history.add_concurrency(frame(spark, S), slices), slices)
    r = {x.sprint_id: x for x in f.collect()}
    assert (r["S3"].hist_avg_completed_issues_3, r["S3"].hist_n_available, r["S3"].hist_late_rate_3) == (8.0, 1, 0.0)
    assert r["S1"].hist_avg_completed_issues_3 is None and r["S2"].hist_avg_completed_issues_3 is None
    assert r["S1"].hist_n_available == 0 and r["S1"].scope_to_capacity is None
    assert r["S4"].hist_avg_completed_issues_3 == pytest.approx(23 / 3) and r["S4"].hist_last_carryover == 0.0
    assert [r[s].n_concurrent_sprints for s in ("S1", "S2", "S3", "S4")] == [0, 1, 1, 0]


def test_box_without_length_never_sees_itself(spark):
    z = dt(2020, 3, 1)
    rows = [("Z", z, z, z, 4, 4), ("A", dt(2020, 1, 1), dt(2020, 1, 2), dt(2020, 1, 2), 2, 1)]
    r = {x.sprint_id: x for x in history.add_strict_history(history.add_concurrency(frame(spark, rows))).collect()}
    assert (r["Z"].hist_n_available, r["Z"].hist_avg_completed_issues_3, r["Z"].n_concurrent_sprints) == (1, 1.0, 0)


def test_labels(spark):
    end = dt(2020, 1, 10)
    rows = [("exact", dt(2020, 1, 1), end, end + timedelta(days=1), 2, 2), ("late", dt(2020, 1, 1), end, end + timedelta(days=1, seconds=1), 2, 1),
            ("empty", dt(2020, 1, 1), end, end, 0, 0)]
    r = {x.sprint_id: x for x in frame(spark, rows).collect()}
    assert [r[k].label_delay for k in ("exact", "late", "empty")] == [0, 1, 0]
    assert r["empty"].completion_ratio is None and r["empty"].label_spillover == 0 and r["late"].at_risk == 1


def test_next_working_day_deadline(spark):
    days = [dt(2020, 1, d, 15) for d in range(6, 13)]  # Monday to Sunday
    df = spark.createDataFrame([(x,) for x in days], "e timestamp").select(sc.next_working_day_deadline(F.col("e")).alias("t"))
    want = [8, 9, 10, 11, 14, 14, 14]
    assert [r.t for r in df.collect()] == [dt(2020, 1, x) for x in want]


def test_trailing_history(spark):
    t0 = dt(2020, 1, 1)
    rows = [(f"T{i}", t0 + timedelta(days=14 * i), t0 + timedelta(days=14 * i + 13), t0 + timedelta(days=14 * i + 13), c, d) for i, (c, d) in enumerate([(10, 5), (0, 0), (8, 8), (4, 1)])]
    f = history.add_trailing_history(frame(spark, rows).withColumn("sprint_length_days", F.lit(13.0)), slices=3)
    r = {x.sprint_id: x for x in f.collect()}
    assert not r["T0"].has_prior_sprint and r["T1"].prior_sprint_carryover == 5
    assert r["T2"].prior_sprint_completion_ratio == 1.0 and r["T2"].prior_avg_completion_ratio_3 == 0.75
    assert r["T3"].prior_avg_delivered_sp_3 == pytest.approx((10 + 0 + 16) / 3)
    kept = labels.cold_start_frame(f, history.LEGACY_FEATURES)
    assert sorted(x.sprint_id for x in kept.collect()) == ["T1", "T2", "T3"]
    with pytest.raises(ValueError, match="missing feature"):
        labels.cold_start_frame(f.withColumn("sprint_length_days", F.lit(None).cast("double")), history.LEGACY_FEATURES)


def test_no_outcome_is_a_feature():
    for cols in history.FEATURE_SETS.values():
        assert not set(cols) & set(history.OUTCOME_COLUMNS)
    for cols in history.FEATURE_GROUPS.values():
        assert not set(cols) & set(history.OUTCOME_COLUMNS)


@pytest.mark.parametrize("n,train", [(1, 1), (90, 62), (10, 7), (100, 70)])
def test_time_split_sizes(spark, n, train):
    df = spark.range(n).select(F.lit("P").alias("project"), F.col("id").cast("string").alias("sprint_id"), F.timestamp_seconds(F.col("id") * 86400).alias("start_date"))
    assert splits.split_time(df, slices=4).where("side = 'train'").count() == train


@pytest.mark.parametrize("n", [10, 13, 451, 786, 2602])
def test_rank_quartiles_follow_even_quantile_edges(spark, n):
    import numpy as np
    import pandas as pd

    want = pd.qcut(pd.Series(np.arange(1, n + 1)), 4, labels=False).value_counts().to_dict()
    got = ranking.rank_quartile(spark.range(n), [], [F.col("id")], slices=5).groupBy("quartile").count().collect()
    assert {r.quartile: r["count"] for r in got} == want


def test_folds_partition_rows_and_oversampling_balances(spark):
    df = spark.range(103).select(F.col("id").cast("string").alias("sprint_id"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    folds = splits.split_kfold(df, "y", slices=3)
    assert folds.count() == 103 and folds.select("sprint_id").distinct().count() == 103
    sizes = [r["count"] for r in folds.groupBy("y", "fold").count().collect()]
    assert max(sizes) - min(s for s in sizes if s < 10) <= 16
    counts = {r.y: r["count"] for r in splits.oversample(df, "y").groupBy("y").count().collect()}
    assert counts[0] == counts[1]


def test_scalars(spark):
    df = spark.createDataFrame([("5",), (" -2.5 pts",), ("none",), ("x",), (None,), ("1e3",)], "t string")
    assert [r[0] for r in df.select(sc.lenient_number(F.col("t"))).collect()] == [5.0, -2.5, None, None, None, 1000.0]
    f = spark.createDataFrame([("Sprint",), ("Story-Points",), ("My Sprint",), ("sprints",), ("mysprints",), (None,), ("Points of story",), ("status",)], "f string")
    assert [r[0] for r in f.select(sc.field_kind(F.col("f"))).collect()] == ["sprint", "story_point", "sprint", "sprint", None, None, "story_point", None]
    m = spark.createDataFrame([("x@1[id=7,state=CLOSED,name=A, B=1,goal=]",), ("junk",)], "s string").select(sc.struct_text_map(F.col("s")).alias("m")).collect()
    assert m[0].m["name"] == "A, B=1" and m[1].m is None
    u = spark.createDataFrame([("2020-01-01T10:00:00.000+0200",), ("<null>",), ("2020-01-01 10:00:00",)], "s string").select(sc.utc_timestamp(F.col("s")).alias("t")).collect()
    assert [r.t for r in u] == [dt(2020, 1, 1, 8), None, dt(2020, 1, 1, 10)]
