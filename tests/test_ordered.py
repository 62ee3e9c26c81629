"""Ordered scans against brute force, with groups that span many slices."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.ordered import numbered, order_rows
from tidemark.operators.skew import top_k


def brute(rows, k):
    out, by = {}, {}
    for g, t, v in sorted(rows, key=lambda r: (r[0], r[1])):
        by.setdefault(g, []).append((t, v))
    for g, rs in by.items():
        total, last, last_before = sum(v or 0 for _, v in rs), None, None
        run = 0
        for i, (t, v) in enumerate(rs):
            before = run
            last_before = last
            run += v or 0
            last = v if v is not None else last
            prev = [x for _, x in rs[max(0, i - k):i]][::-1]
            out[(g, t)] = (run, before, total, last, last_before, prev, i + 1, len(rs))
    return out


@pytest.mark.parametrize("slices", [1, 2, 7, 40])
@pytest.mark.parametrize("seed", [1, 2])
def test_scan_matches_brute_force_with_a_hot_group(spark, slices, seed):
    rnd = random.Random(seed)
    # group 'a' holds more than a third of the rows, 'z' a single one
    groups = ["a"] * 120 + ["b"] * 40 + [f"g{i % 30}" for i in range(100)] + ["z"]
    rows = [(g, i, rnd.choice([None, 1, 2, 5])) for i, g in enumerate(groups)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, t long, v long").repartition(5)
    one = F.lit(1).cast("long")
    got = order_rows(df, ["g"], [F.col("t")], slices).scan(
        sums={"run": F.col("v"), "rn": one}, sums_before={"before": F.col("v")}, totals={"total": F.col("v"), "n": one},
        lasts={"last": F.col("v")}, lasts_before={"lb": F.col("v")}, previous={"prev": (F.col("v"), 3)})
    want = brute(rows, 3)
    assert got.count() == len(rows)
    for r in got.collect():
        assert (r.run, r.before, r.total, r["last"], r.lb, list(r.prev), r.rn, r.n) == want[(r.g, r.t)]


def test_scan_without_keys_and_descending(spark):
    df = spark.range(100).select(F.col("id").alias("t"))
    got = numbered(df, [], [F.col("t").desc()], "rn", "n", slices=6)
    assert [(r.t, r.rn, r.n) for r in got.orderBy("t").collect()] == [(t, 100 - t, 100) for t in range(100)]


def test_null_keys_are_one_group(spark):
    df = spark.createDataFrame([(None, i) for i in range(20)] + [("x", 99)], "g string, t long")
    got = numbered(df, ["g"], [F.col("t")], "rn", "n", slices=4)
    assert sorted((r.t, r.rn, r.n) for r in got.where("g is null").collect()) == [(i, i + 1, 20) for i in range(20)]


def test_hot_group_is_spread_over_slices(spark):
    df = spark.range(1000).select(F.lit("hot").alias("g"), F.col("id").alias("t"))
    o = order_rows(df, ["g"], [F.col("t")], slices=8)
    sizes = [r["count"] for r in o.df.groupBy("__slice").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 400


def test_top_k_limits_groups_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    out = top_k(df, ["g"], [F.col("id").desc()], 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert sorted((r.g, r.id, r["rank"]) for r in out.collect()) == [(0, 996, 2), (0, 999, 1), (1, 994, 2), (1, 997, 1), (2, 995, 2), (2, 998, 1)]
