"""Many fits at once against single ones, and multinomial counts against drawn rows."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.models import many
from tidemark.models.learners import Learner, cross_validated_calls, fit_and_score, fit_classifier, fit_with_threshold, group_out_scores, out_of_fold
from tidemark.operators import multinomial, resample
from tidemark.operators.splits import split_kfold

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 600
    d = pd.DataFrame({"sprint_id": [f"s{k}" for k in range(n)], "project": rng.choice(["P", "Q", "R", "hot"], n, p=[0.2, 0.2, 0.1, 0.5]),
                      "a": rng.normal(size=n), "b": rng.exponential(size=n), "c": rng.integers(0, 4, n).astype(float), "flat": 1.0})
    d["y"] = (d.a + 0.5 * d.c + rng.normal(size=n) > 0.8).astype(int)
    d.loc[rng.random(n) < 0.2, "b"] = np.nan
    return spark.createDataFrame(d).withColumn("b", F.nanvl("b", F.lit(None).cast("double"))).repartition(5).cache()


def test_coefficients_equal_the_single_learner(spark, frame):
    m = many.fit_many(frame.withColumn("train_in", F.when(F.col("project") != "R", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))), [FEATURES, [*FEATURES, "flat"]], "y", "project")
    assert m.passes < 12
    for k, (part, cols) in enumerate(((frame.where("project <> 'R'"), FEATURES), (frame, [*FEATURES, "flat"]))):
        one = fit_classifier(Learner("logistic", cols, settings={"tol": 1e-12}), part, "y")
        labels = next(s.labels for s in one.stages if hasattr(s, "labels"))
        want = dict(zip([*cols, *labels], one.stages[-1].coefficients.toArray()))
        b, got = m.coefficients(k)
        assert abs(b - one.stages[-1].intercept) < 1e-6 and all(abs(got[c] - v) < 1e-6 for c, v in want.items())


def test_scores_equal_the_single_learner(spark, frame):
    learner, single = Learner("logistic", FEATURES), Learner("logistic", FEATURES, settings={"tol": 1e-12})
    folds = split_kfold(frame, "y", 3, 42)
    got = {r.sprint_id: (r.fold, r.score) for r in out_of_fold(learner, frame, "y", 3).collect()}
    for i in range(3):
        for r in fit_and_score(single, folds.where(F.col("fold") != i), folds.where(F.col("fold") == i), "y").collect():
            assert got[r.sprint_id][0] == i and abs(got[r.sprint_id][1] - r.score) < 1e-6
    groups = ["P", "Q", "R", "hot"]
    one = {r.sprint_id: r.score for r in group_out_scores(single, frame, "y", groups).collect()}
    for r in group_out_scores(learner, frame, "y", groups).collect():
        assert abs(one[r.sprint_id] - r.score) < 1e-6
    train, test = frame.where("project <> 'Q'"), frame.where("project = 'Q'")
    a, b = ({r.sprint_id: (r.pred, r.threshold) for r in fit_with_threshold(x, train, test, "y", 3).collect()} for x in (learner, single))
    assert all(a[k][0] == b[k][0] and abs(a[k][1] - b[k][1]) < 1e-6 for k in b) and len(a) == len(b)
    calls = [Counter((r.sprint_id, r.pred) for r in cross_validated_calls(x, frame, "y", 3).collect()) for x in (learner, single)]
    assert calls[0] == calls[1]


def test_fits_without_rows_or_with_one_class(spark, frame):
    none = F.array().cast("array<int>")
    rows = frame.withColumns({"train_in": F.when(F.col("y") == 1, F.array(F.lit(0))).otherwise(none), "score_in": F.array(F.lit(0), F.lit(1))})
    got = Counter((r.fit, r.score) for r in many.fit_many(rows, [FEATURES, FEATURES], "y").score(rows).collect())
    assert got == {(0, 1.0): 600, (1, None): 600}


def test_binomial_numbers_follow_their_law():
    rng = np.random.default_rng(0)
    for n, p in ((1, 0.3), (7, 0.5), (40, 0.03), (300, 0.7), (10**9, 0.2)):
        u = rng.random(40_000)
        k = multinomial.binomial(np.full(len(u), n), p, u)
        assert k.min() >= 0 and k.max() <= n
        assert abs(k.mean() - n * p) < 5 * np.sqrt(n * p * (1 - p) / len(u)) + 1e-9
        assert abs(k.var() / (n * p * (1 - p)) - 1) < 0.1
    from math import comb

    k = multinomial.binomial(np.full(40_000, 7), 0.4, rng.random(40_000))
    seen, want = np.bincount(k, minlength=8), np.array([comb(7, j) * 0.4**j * 0.6**(7 - j) for j in range(8)]) * 40_000
    assert ((seen - want) ** 2 / want).sum() < 30  # chi-square with 7 degrees of freedom


def test_log_gamma():
    from math import lgamma

    x = np.array([1.0, 2.0, 3.5, 9.0, 10.0, 57.3, 1e6, 1e12])
    assert np.allclose(multinomial.log_gamma(x), [lgamma(v) for v in x], rtol=1e-13, atol=1e-13)


@pytest.mark.parametrize("fan", [4096, 4])
def test_cell_counts_are_multinomial(spark, fan, monkeypatch):
    monkeypatch.setattr(multinomial, "FAN", fan)  # 4: several levels
    monkeypatch.setattr(multinomial, "CHUNK", 60)
    rows = [("hot", k % 10 / 10, k % 2) for k in range(400)] + [("cold", 0.5, 1)] + [(None, k / 3, 0) for k in range(3)]
    df = spark.createDataFrame(rows, "g string, s double, y int").repartition(6)
    got = multinomial.resample_cells(df, 400, 7, ["s", "y"], ["g"]).toPandas()
    size = {"hot": 400, "cold": 1, None: 3}
    total = got.groupby(["rep", "g"], dropna=False).times.sum().reset_index()
    assert len(total) == 400 * 3 and all(size[None if g is None or g != g else g] == t for g, t in zip(total.g, total.times))
    hot = got[got.g == "hot"].pivot_table(index="rep", columns=["s", "y"], values="times", fill_value=0)
    assert hot.shape == (400, 10) and abs(hot.values.mean() - 40) < 1e-9
    assert np.allclose(hot.values.var(0), 36, rtol=0.35)  # 400 * 0.1 * 0.9
    again = multinomial.resample_cells(df.repartition(2), 400, 7, ["s", "y"], ["g"], slices=3).toPandas()
    key = ["rep", "g", "s", "y"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_cell_bootstrap_has_the_distribution_of_the_row_bootstrap(spark):
    rng = np.random.default_rng(9)
    rows = [(k, float(round(x, 1)), int(x + e > 0)) for k, (x, e) in enumerate(rng.normal(size=(250, 2)))]
    df = spark.createDataFrame(rows, "id int, s double, y int")
    cells = resample.row_bootstrap_auc(df, "s", "y", 1500, 5).first()
    drawn = resample.interval(resample.auc_replicates(resample.resample_rows(df, 1500, 5, "id", keep=["s", "y"]).withColumn("times", F.lit(1)), "s", "y"), "auc").first()
    for c in ("mean", "lo", "hi"):
        assert abs(cells[c] - drawn[c]) < 0.008
    assert cells.replicates == 1500
