"""Ranking measures, resampling, agreement and cost against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import agreement, cost, metrics, ranking, resample


def auc(y, s):
    y, s = np.asarray(y), np.asarray(s, float)
    p, n = s[y == 1], s[y == 0]
    if not len(p) or not len(n):
        return None
    return float(((p[:, None] > n) + 0.5 * (p[:, None] == n)).mean())


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(5)
    # group 'a' holds more than a third of the rows; scores are full of ties
    pdf = pd.DataFrame({"id": range(400), "g": ["a"] * 180 + [rnd.choice("bcde") for _ in range(220)], "s": [rnd.randint(0, 12) / 10 for _ in range(400)],
                        "s2": [rnd.random() for _ in range(400)], "y": [int(rnd.random() < 0.4) for _ in range(400)]})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("slices", [None, 6])
def test_auc_precision_and_threshold(data, slices):
    pdf, df = data
    for r in ranking.roc_auc(df, ["g"], "s", "y", slices).collect():
        q = pdf[pdf.g == r.g]
        assert r.auc == pytest.approx(auc(q.y, q.s))
    for r in ranking.youden_threshold(df, ["g"], "s", "y", slices).collect():
        q = pdf[pdf.g == r.g]
        js = {t: ((q.s >= t) & (q.y == 1)).sum() * (q.y == 0).sum() + ((q.s < t) & (q.y == 0)).sum() * (q.y == 1).sum() for t in sorted(set(q.s))}
        assert r.threshold == max(js, key=lambda t: (js[t], -t))
    ap = ranking.average_precision(df, [], "s", "y", slices).first()[0]
    want, tp, n, P = 0.0, 0, 0, pdf.y.sum()
    for t in sorted(set(pdf.s), reverse=True):
        at = pdf[pdf.s == t]
        tp, n = tp + at.y.sum(), n + len(at)
        want += at.y.sum() / P * tp / n
    assert ap == pytest.approx(want)


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([("x", 0.1, 1), ("x", 0.2, 1), ("y", 0.3, 0), ("y", 0.1, 1)], "g string, s double, y int")
    assert {r.g: r.auc for r in ranking.roc_auc(df, ["g"], "s", "y").collect()} == {"x": None, "y": 0.0}


@pytest.mark.parametrize("slices", [None, 5])
def test_roc_grid_matches_interpolation(data, slices):
    pdf, df = data
    pts = [(0.0, 0.0)]
    P, N = (pdf.y == 1).sum(), (pdf.y == 0).sum()
    for t in sorted(set(pdf.s), reverse=True):
        q = pdf[pdf.s >= t]
        pts.append(((q.y == 0).sum() / N, (q.y == 1).sum() / P))
    grid = np.linspace(0, 1, 201)
    want = np.interp(grid, *zip(*pts))
    want[0] = 0.0
    got = [r.tpr for r in ranking.roc_grid(df, [], "s", "y", slices).orderBy("step").collect()]
    assert got == pytest.approx(list(want))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=st.lists(st.sampled_from([0.0, 1.0, 1.5, 2.0, 7.0, -3.0]), min_size=1, max_size=30))
def test_quantiles_match_numpy(spark, vals):
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r.prob: r.value for r in ranking.exact_quantiles(spark.createDataFrame([(v,) for v in vals], "v double"), [], "v", probs, 3).collect()}
    assert [got[p] for p in probs] == pytest.approx(list(np.quantile(vals, probs)))


def test_spearman_and_mann_whitney(data):
    pdf, df = data
    for r in ranking.spearman(df, ["g"], "s", "s2").collect():
        q = pdf[pdf.g == r.g]
        assert r.spearman == pytest.approx(q.s.rank().corr(q.s2.rank()))
    r = ranking.mann_whitney(df, [], "s", F.col("y") == 1, F.col("y") == 0).first()
    n1, n2 = (pdf.y == 1).sum(), (pdf.y == 0).sum()
    assert r.u_stat == pytest.approx(auc(pdf.y, pdf.s) * n1 * n2)
    assert 0 < r.p_value <= 1


def test_upper_tail(spark):
    from math import erfc, sqrt

    df = spark.createDataFrame([(z / 4,) for z in range(-12, 13)], "z double")
    for r in df.select("z", ranking.upper_tail(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(erfc(r.z / sqrt(2)) / 2, abs=2e-7)


@pytest.mark.parametrize("groups", [3, 8, 500])
def test_cluster_replicates_equal_repeated_rows(spark, groups):
    rng = np.random.default_rng(groups)
    pdf = pd.DataFrame({"g": rng.integers(0, groups, 900), "s": rng.integers(0, 40, 900) / 40, "y": rng.integers(0, 2, 900)})
    df = spark.createDataFrame(pdf)
    got = {r.rep: r.auc for r in resample.cluster_auc_replicates(df, "g", "s", "y", 6, 9, slices=4).collect()}
    for rep, t in resample.cluster_draws(df, "g", 6, 9).toPandas().groupby("rep"):
        assert t.times.sum() == pdf.g.nunique()
        parts = pd.concat([pdf[pdf.g == x.g] for x in t.itertuples() for _ in range(x.times)])
        assert got[rep] == pytest.approx(auc(parts.y, parts.s))


def test_draws_reach_beyond_32_bits(spark):
    from tidemark.functions.scalars import hash_number

    n = 10_000_000_000
    got = spark.range(4000).select((hash_number(F.lit("1"), F.col("id").cast("string")) % n).alias("x")).toPandas().x
    assert got.max() > 2 ** 33 and got.min() >= 0 and abs((got < 1_290_000_000).mean() - 0.129) < 0.02


def test_jackknife_of_the_f1_difference(data):
    pdf, df = data
    pdf = pdf.assign(pa=(pdf.s > 0.4).astype(int), pb=(pdf.s > 0.7).astype(int))
    f1 = lambda d, p: 2 * ((d.y == 1) & (d[p] == 1)).sum() / max(d.y.sum() + d[p].sum(), 1)
    got = resample.jackknife_f1_difference(df.withColumns({"pa": (F.col("s") > 0.4).cast("int"), "pb": (F.col("s") > 0.7).cast("int")}), "g", "y", "pa", "pb").collect()
    want = {g: f1(pdf[pdf.g != g], "pb") - f1(pdf[pdf.g != g], "pa") for g in pdf.g.unique()}
    for r in got:
        assert r.f1_delta == pytest.approx(want[r.left_out]) and r.n_excluded == (pdf.g == r.left_out).sum()
        assert r.full_delta == pytest.approx(f1(pdf, "pb") - f1(pdf, "pa")) and r.delta_range == pytest.approx(max(want.values()) - min(want.values()))


def test_jackknife_and_row_resamples(data):
    pdf, df = data
    for r in resample.jackknife_auc(df, "g", "s", "y", slices=4).collect():
        q = pdf[pdf.g != r.left_out]
        assert r.auc == pytest.approx(auc(q.y, q.s))
    sample = resample.resample_rows(df, 6, 1, "id", ["g"], ["y"], slices=3)
    sizes = {(r.rep, r.g): r["count"] for r in sample.groupBy("rep", "g").count().collect()}
    assert sizes == {(rep, g): n for rep in range(6) for g, n in pdf.g.value_counts().items()}
    again = resample.resample_rows(df, 6, 1, "id", ["g"], ["y"])
    assert sample.exceptAll(again).count() == 0  # the draw does not depend on the slices


def test_kappas(spark):
    df = spark.createDataFrame([(1, 1, 1), (0, 0, 1), (1, 0, 0), (0, 0, 0)], "a int, b int, c int")
    assert agreement.cohen_kappa(df, "a", "b").first().kappa == pytest.approx(0.5)
    m = np.array([[1, 1, 1], [0, 0, 1], [1, 0, 0], [0, 0, 0]])
    p = m.sum(1)
    pbar, q = ((p * (p - 1) + (3 - p) * (2 - p)) / 6).mean(), m.mean()
    pe = q * q + (1 - q) ** 2
    assert agreement.fleiss_kappa(df, ["a", "b", "c"]).first().fleiss_kappa == pytest.approx((pbar - pe) / (1 - pe))
    same = spark.createDataFrame([(1, 1)], "a int, b int")
    assert agreement.cohen_kappa(same, "a", "b").first().kappa is None


def test_costs_by_sums_equal_costs_by_row(spark):
    rnd = random.Random(2)
    rows = [(str(i), "P", rnd.randint(0, 1), 1 + rnd.random(), "M", rnd.randint(0, 1), rnd.randint(0, 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "sprint_id string, project string, late int, weight double, arm string, w0 int, w50 int")
    got = {r.ratio: r.cost for r in cost.cost_curve(df).collect()}
    for ratio in cost.RATIOS:
        w = [r[3] for r in rows]
        per = [ratio * (r[5] + r[6] > 0) + r[2] * (1 - (0.5 if r[5] else 0.25 if r[6] else 0)) for r in rows]
        assert got[ratio] == pytest.approx(np.average(per, weights=w))


def test_metrics_when_nothing_is_called(spark):
    r = metrics.confusion_metrics(spark.createDataFrame([(1, 0), (0, 0)], "y int, p int"), [], "y", "p").first()
    assert (r.precision, r.recall, r.f1, r.specificity) == (0.0, 0.0, 0.0, 1.0)
    r = metrics.confusion_metrics(spark.createDataFrame([(0, 0)], "y int, p int"), [], "y", "p").first()
    assert r.sensitivity is None and r.f1 == 0.0
