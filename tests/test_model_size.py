"""What model queries move: borders instead of numbered rows, slim rows, bounded parts of a forest."""

from datetime import datetime as dt
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.models import learners
from tidemark.models.learners import Learner, fit_classifier, fit_regressor
from tidemark.operators import ordered, ranking, splits

ROWS = "project string, start_date timestamp, sprint_id string, payload string"


def numbered_by_hand(rows):
    """sprint ids by project in order of (start, id), nulls first."""
    out = {}
    for p, t, i, _ in sorted(rows, key=lambda r: ((r[0] is not None, r[0] or ""), (r[1] is not None, r[1] or dt.min), (r[2] is not None, r[2] or ""))):
        out.setdefault(p, []).append(i)
    return out


@pytest.mark.parametrize("slices", [None, 4])
def test_time_splits_number_only_keys(spark, monkeypatch, slices):
    day = lambda n: dt(2020, 1, 1) + timedelta(n)
    rows = [("P", day(k % 37), f"p{k}", "x" * 50) for k in range(101)] + [("Q", day(5), "q0", "y"), (None, day(1), "n0", "z"), (None, None, "n1", "z"), (None, day(1), "n2", "z")]
    seen, order = [], ordered.order_rows
    monkeypatch.setattr(ordered, "order_rows", lambda df, *a, **k: seen.append(df.columns) or order(df, *a, **k))
    df = spark.createDataFrame(rows, ROWS)
    got = splits.split_time(df, slices=slices)
    assert got.columns == [*df.columns, "side"]
    by_hand = numbered_by_hand(rows)
    train = {(p, i) for p, ids in by_hand.items() for i in ids[:max(1, int(len(ids) * 0.7))]}
    assert {(r.project, r.sprint_id) for r in got.collect() if r.side == "train"} == train and got.count() == len(rows)
    rolled = {(r.project, r.sprint_id, r.repeat): r.side for r in splits.split_rolling(df, slices=slices).collect()}
    want = {}
    for p, ids in by_hand.items():
        for k, c in enumerate((0.4, 0.5, 0.6, 0.7, 0.8)):
            for n, i in enumerate(ids, 1):
                if n <= round(len(ids) * (c + 0.2)):
                    want[p, i, k + 1] = "train" if n <= round(len(ids) * c) else "test"
    assert rolled == want
    assert seen and all("payload" not in c for c in seen)  # the rows themselves are not ordered


def test_equal_keys_on_a_border_are_still_cut_by_number(spark):
    rows = [("P", dt(2020, 1, 1), "same", str(k)) for k in range(10)]
    assert splits.split_time(spark.createDataFrame(rows, ROWS)).where("side = 'train'").count() == 7


def test_forest_rows_are_dealt_to_bounded_parts(spark, monkeypatch):
    d = spark.range(400).select(F.col("id").cast("string").alias("sprint_id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).alias("y"), F.lit("P").alias("project"))
    parts, classes = [], (learners.RandomForestClassifier, learners.RandomForestRegressor)
    for c in classes:
        monkeypatch.setattr(c, "fit", lambda self, x, fit=c.fit: parts.append(x.rdd.getNumPartitions()) or fit(self, x))
    few = {"numTrees": 5}
    for fit in (fit_classifier, fit_regressor):
        fit(Learner("forest", ["a"], settings=few), d.coalesce(1), "y")
    monkeypatch.setattr(learners, "BAG_BYTES", 40 * (learners.ROW_BYTES + 4 * 5))
    for fit in (fit_classifier, fit_regressor):
        model = fit(Learner("forest", ["a"], settings=few), d.coalesce(1), "y")
        assert model.transform(d.withColumn("label_", F.lit(0.0))).count() == 400
    assert parts == [1, 1, 10, 10]


def test_fold_queries_carry_what_fits_read(spark, monkeypatch):
    from tidemark.plans import model_queries as q

    cols = [F.lit("P").alias("project"), F.lit("train").alias("side"), F.lit(1).alias("label_delay"), *[F.lit(1.0).alias(c) for c in q.NUMERIC], F.lit("x").alias("payload")]
    monkeypatch.setattr(q, "frame", lambda s, d: spark.range(4).select(F.col("id").cast("string").alias("sprint_id"), *cols))
    read = []
    calls = lambda learner, *x: read.extend(set(t.columns) for t in x[:-1]) or x[-2].withColumns({"pred": F.lit(1), "score": F.lit(0.5), "fold": F.lit(0)})
    for name in ("fit_with_threshold", "cross_validated_calls", "out_of_fold"):
        monkeypatch.setattr(q, name, calls)
    for query in (q.threshold_calls, q.cross_validated, q.oof_scores):
        query(spark, "")
    assert read == [{"sprint_id", "project", "side", "label_delay", *q.NUMERIC}] * 4


def test_seeds_share_one_preprocessing(spark, monkeypatch):
    from tidemark.plans import jobs

    d = spark.range(200).select(F.col("id").cast("string").alias("sprint_id"), (F.col("id") % 7).cast("double").alias("a"), (F.hash("id") % 2 == 0).cast("int").alias("y"), F.lit("P").alias("project")).localCheckpoint()
    learner, seeds = Learner("forest", ["a"], settings={"numTrees": 3}), range(3)
    alone = [ranking.roc_auc(learners.fit_and_score(Learner("forest", ["a"], seed=s, settings={"numTrees": 3}), d, d, "y"), [], "score", "y").first()["auc"] for s in seeds]
    fitted, medians = [], learners.exact_medians
    monkeypatch.setattr(learners, "exact_medians", lambda *a: fitted.append(1) or medians(*a))
    got = jobs.seed_variance(d, d, "y", learner, seeds).first()
    assert len(fitted) == 1
    assert abs(got["auc_mean"] - sum(alone) / 3) < 1e-12


def test_regressors_share_one_preprocessing(spark, monkeypatch):
    from tidemark.plans import model_queries as q

    cols = [F.when(F.col("id") < 40, "train").otherwise("test").alias("side"), F.lit("P").alias("project"), (F.col("id") % 5).cast("double").alias("late_days_capped")]
    d = spark.range(60).select(F.col("id").cast("string").alias("sprint_id"), *cols, *[(F.hash("id") % (7 + i)).cast("double").alias(c) for i, c in enumerate(q.NUMERIC)]).localCheckpoint()
    monkeypatch.setattr(q, "frame_in_order", lambda s, path: d)
    monkeypatch.setattr(learners, "FOREST", {"numTrees": 2})
    monkeypatch.setattr(learners, "BOOSTED", {"maxIter": 1})
    fitted, medians = [], learners.exact_medians
    monkeypatch.setattr(learners, "exact_medians", lambda *a: fitted.append(1) or medians(*a))
    assert {r["model"] for r in q.fit_regressors(spark, "").collect()} == {"ridge", "forest", "boosted", "boosted_median"}
    assert len(fitted) == 1
