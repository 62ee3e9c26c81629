"""Invariants of fitted models."""

import pytest
from pyspark.sql import functions as F

from tidemark.models import explain
from tidemark.models.advisor import QuantileForest, bounded_quantiles, what_if
from tidemark.models.learners import Learner, fit_classifier, fit_and_score, out_of_fold
from tidemark.operators import history, splits
from tidemark.plans import jobs
from tidemark.plans import model_queries as mq
from tidemark.plans import tracker as tk
from tidemark.session import materialize

NUM = ["committed_issue_count", "sprint_length_days", "hist_late_rate_3", "scope_to_capacity"]


@pytest.fixture(scope="module")
def sides(spark):
    f = history.add_strict_history(tk.labelled(spark, "/root/testdata/sf0.001"))
    return jobs.sides(materialize(splits.split_time(f)))


def test_attributions_add_up(sides):
    tr, te = sides
    groups = {"scope": ["committed_issue_count", "sprint_length_days"], "late": ["hist_late_rate_3"], "capacity": ["scope_to_capacity"]}
    m = fit_classifier(Learner("logistic", NUM, None), tr, "label_delay")
    s = explain.group_shapley(m, te.orderBy("sprint_id").limit(5), tr.orderBy("sprint_id").limit(4), groups, NUM)
    per = s.groupBy("sprint_id").agg(F.sum("phi").alias("phi"), F.max("base_value").alias("b"), F.max("prediction").alias("p")).collect()
    assert len(per) == 5 and all(r.phi == pytest.approx(r.p - r.b) for r in per)
    assert all(r.efficiency_gap < 1e-9 for r in explain.group_importance(s).collect())


def test_a_group_without_effect_gets_nothing(sides):
    tr, te = sides
    tr, te = [x.withColumn("flat", F.lit(1.0)) for x in (tr, te)]
    m = fit_classifier(Learner("logistic", [*NUM[:2], "flat"], None), tr, "label_delay")
    s = explain.group_shapley(m, te.orderBy("sprint_id").limit(3), tr.orderBy("sprint_id").limit(3), {"real": NUM[:2], "flat": ["flat"]}, [*NUM[:2], "flat"])
    assert all(abs(r.phi) < 1e-9 for r in s.where("group = 'flat'").collect())


def test_quantiles_are_ordered_and_bounded_and_what_if_agrees(sides):
    tr, te = sides
    ne = F.col("committed_issue_count") > 0
    q = QuantileForest(NUM, settings={"numTrees": 8}).fit(tr.where(ne), "completed_issue_count")
    late = QuantileForest(NUM, settings={"numTrees": 8}).fit(tr, "late_days_capped")
    f = q.forecast(te.where(ne), (0.1, 0.5, 0.9)).withColumn("b", bounded_quantiles(F.col("quantiles"), F.col("committed_issue_count"))).cache()
    assert f.where(~((F.col("b")[0] >= 0) & (F.col("b")[0] <= F.col("b")[1]) & (F.col("b")[1] <= F.col("b")[2]) & (F.col("b")[2] <= F.col("committed_issue_count")))).count() == 0
    four = te.where("committed_issue_count = 4")
    w = what_if(four, [4], q, late).select("sprint_id", "expected_done_q50")
    both = w.join(f.select("sprint_id", F.round(F.col("b")[1], 1).alias("direct")), "sprint_id")
    assert both.count() > 0 and both.where("expected_done_q50 <> direct").count() == 0


def test_out_of_fold_scores_every_row_once(sides):
    tr, _ = sides
    o = out_of_fold(Learner("logistic", NUM), tr, "label_delay", k=3)
    assert o.count() == tr.count() == o.select("sprint_id").distinct().count()
    assert o.where("score is null or score < 0 or score > 1").count() == 0


def test_unseen_group_and_missing_values_are_scored(sides):
    tr, te = sides
    new = te.limit(5).withColumn("project", F.lit("new")).withColumn("hist_late_rate_3", F.lit(None).cast("double"))
    assert fit_and_score(Learner("logistic", NUM), tr, new, "label_delay").where("score is not null").count() == 5


def test_permutation_of_a_useless_feature_costs_nothing(sides):
    tr, te = sides
    cols = [*NUM[:2], "flat"]
    tr, te = [x.withColumn("flat", F.lit(2.0)) for x in (tr, te)]
    m = fit_classifier(Learner("logistic", cols, None), tr, "label_delay")
    drop = {r.feature: r.auc_drop for r in explain.permutation_importance(m, te, cols, "label_delay").collect()}
    assert abs(drop["flat"]) < 1e-12 and set(drop) == set(cols)


@pytest.mark.parametrize("values,fan", [(200, 64), (300, 4), (40, 64)])
def test_forest_quantiles_are_exact_for_any_number_of_targets(spark, values, fan, monkeypatch):
    import numpy as np

    from tidemark.models import advisor

    monkeypatch.setattr(advisor, "FAN", fan)
    monkeypatch.setattr(advisor, "TASK_ROWS", 7)
    import pandas as pd
    from pyspark.ml.functions import vector_to_array

    rng = np.random.default_rng(values)
    pdf = pd.DataFrame({"x": rng.integers(0, 30, 2000).astype(float), "y": rng.permutation(np.arange(2000) % values) * 0.37})
    df = spark.createDataFrame(pdf)
    q = QuantileForest(["x"], None, {"numTrees": 5}).fit(df, "y")
    leaves = np.array([r[0] for r in q.model.transform(df).select(vector_to_array("leaf")).collect()])
    want = {}
    for x in range(30):
        row = leaves[np.flatnonzero(pdf.x == x)[0]]
        w = sum((leaves[:, t] == row[t]) / (leaves[:, t] == row[t]).sum() for t in range(5)) / 5
        order = np.argsort(pdf.y.to_numpy(), kind="stable")
        cdf = np.cumsum(w[order])
        want[x] = [pdf.y.to_numpy()[order][np.argmax(cdf >= p - 1e-9)] for p in (0.1, 0.5, 0.9)]
    for r in q.forecast(df.select("x").distinct(), (0.1, 0.5, 0.9)).collect():
        assert r.quantiles == pytest.approx(want[r.x])


def test_shapley_over_a_background_in_blocks(sides, monkeypatch):
    tr, te = sides
    m = fit_classifier(Learner("logistic", NUM, None), tr, "label_delay")
    groups = {"first": NUM[:1], "rest": NUM[1:]}
    few, back = te.orderBy("sprint_id").limit(3), tr.orderBy("sprint_id").limit(11)
    one = {(r.sprint_id, r.group): r.phi for r in explain.group_shapley(m, few, back, groups, NUM).collect()}
    monkeypatch.setattr(explain, "BLOCK", 4)
    cut = {(r.sprint_id, r.group): r.phi for r in explain.group_shapley(m, few, back, groups, NUM).collect()}
    assert one.keys() == cut.keys() and all(abs(one[k] - cut[k]) < 1e-12 for k in one)


def test_linear_attribution_is_the_coalition_sum(spark):
    from itertools import combinations
    from math import factorial

    rng = __import__("random").Random(1)
    cols, beta = ["a", "b", "c", "d"], {"a": 2.0, "b": -1.0, "c": 0.5, "d": 0.0}
    make = lambda n: [(str(k), *[rng.random() for _ in cols]) for k in range(n)]
    x, bg = make(4), make(30)
    schema = "sprint_id string, a double, b double, c double, d double"
    groups = {"ab": ["a", "b"], "c": ["c"], "d": ["d"]}
    got = {(r.sprint_id, r.group): r.phi for r in explain.linear_shapley(spark.createDataFrame(x, schema), spark.createDataFrame(bg, schema), beta, groups).collect()}
    value = lambda row, inside: sum(sum(beta[c] * (row if any(c in groups[g] for g in inside) else b)[1 + k] for k, c in enumerate(cols)) for b in bg) / len(bg)
    for row in x:
        for g in groups:
            others = [h for h in groups if h != g]
            phi = sum(factorial(n) * factorial(len(others) - n) / factorial(len(groups)) * (value(row, [*s, g]) - value(row, s)) for n in range(len(others) + 1) for s in combinations(others, n))
            assert abs(got[(row[0], g)] - phi) < 1e-9


def test_imputed_medians_are_exact(spark):
    from tidemark.models.learners import exact_medians

    df = spark.createDataFrame([(float(k), None if k % 3 else float(k), float("nan")) for k in range(1, 1001)], "a double, b double, c double")
    assert exact_medians(df, ["a", "b", "c"]) == {"a": 500.5, "b": 501.0, "c": 0.0}


def test_registered_queries_do_the_whole_job(monkeypatch):
    """The settings that reach the operators: none but the defaults."""
    calls = {}

    def caught(name):
        def call(*args, **named):
            calls[name] = (args, named)
            raise InterruptedError
        return call

    monkeypatch.setattr(mq, "frame", lambda spark, d: None)
    monkeypatch.setattr(jobs, "sides", lambda f: (None, None))
    for where, name in ((mq, "fit_and_score"), (mq, "cross_validated_calls"), (jobs, "seed_variance"), (jobs, "gap_to_best_rule")):
        monkeypatch.setattr(where, name, caught(name))
    for q in (mq.fit_forest, mq.fit_gbt, mq.cross_validated, mq.seed_variance, mq.gap_to_best_rule):
        with pytest.raises(InterruptedError):
            q(None, None)
        (args, named), = calls.values()
        calls.clear()
        assert all(x.settings == {} for x in args if isinstance(x, Learner)) and not named
        if q is mq.seed_variance:
            assert len(args[-1]) == 10
