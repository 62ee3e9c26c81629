"""Resampled AUCs, reduced where they are drawn, against the same draws as rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import multinomial, ranking, resample


def rows(spark, n=70):
    r = random.Random(3)
    pick = lambda: r.choice([None, float("nan"), 0.0, -0.0, 0.25, 0.5, r.random()])
    return spark.createDataFrame([(k, r.choice(["x", "y", None]), pick(), float(r.randrange(3)), r.choice([0, 0, 1, 1, 2, None])) for k in range(n)],
                                 "id long, g string, a double, b double, y int")


def same(got, want):
    assert want and got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)


@pytest.mark.parametrize("fan", [9])
def test_auc_of_resamples_equals_that_of_the_drawn_rows(spark, monkeypatch, fan):
    monkeypatch.setattr(multinomial, "FAN", fan)  # ties lie across parts
    monkeypatch.setattr(multinomial, "CHUNK", 7)
    d = rows(spark)
    for score in ("a",):
        drawn = resample.auc_replicates(multinomial.resample_cells(d, 20, 5, [score, "y"], ["g"]), score, "y", ["g"])
        got = multinomial.resampled_auc(d, 20, 5, score, "y", ["g"], slices=3)
        same({(r.g, r.rep): r.auc for r in got.collect()}, {(r.g, r.rep): r.auc for r in drawn.collect()})
    for keys in (["g"],):
        cells = multinomial.resample_cells(d, 20, 5, ["a", "b", "y"], keys)
        want = {(s, r.rep, r[keys[0]] if keys else 0): r.auc for s in "ab" for r in resample.auc_replicates(cells, s, "y", keys).collect()}
        got = multinomial.resampled_auc_of_both(d, 20, 5, "a", "b", "y", keys, slices=3)
        same({(r.s, r.rep, r[keys[0]] if keys else 0): r.auc for r in got.collect()}, want)


@pytest.mark.parametrize("fan", [9])
def test_auc_of_resampled_groups_equals_that_of_weighted_cells(spark, monkeypatch, fan):
    monkeypatch.setattr(multinomial, "FAN", fan)
    monkeypatch.setattr(multinomial, "CHUNK", 7)
    d = rows(spark).withColumn("g", F.concat("g", (F.col("id") % 5).cast("string")))
    cells = ranking.score_cells(d, ["g"], "a", "y").join(resample.cluster_draws(d, "g", 20, 9), "g")
    cells = cells.groupBy("rep", "score").agg(F.sum(F.col("pos") * F.col("times")).alias("pos"), F.sum(F.col("neg") * F.col("times")).alias("neg"))
    want = ranking.auc_from_cells(cells, ["rep"]).where("auc IS NOT NULL")
    got = resample.cluster_auc_replicates(d, "g", "a", "y", 20, 9, slices=3)
    same({r.rep: r.auc for r in got.collect()}, {r.rep: r.auc for r in want.collect()})


def test_intervals_make_no_row_per_cell_and_replicate(spark, monkeypatch):
    def no(*a, **k):
        raise AssertionError("a row per cell and replicate")

    monkeypatch.setattr(resample, "resample_cells", no)
    monkeypatch.setattr(resample, "auc_replicates", no)
    d = rows(spark)
    assert resample.row_bootstrap_by(d, ["g"], "a", "y", 20).count() == 3
    assert resample.paired_bootstrap(d, "a", "b", "y", 20).count() == 1
    assert resample.paired_bootstrap_by(d, ["g"], "a", "b", "y", 20).count() >= 2
