"""How often the state reconstruction deals its rows, and that small and large keys give the same rows."""

from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, scope

CHANGES = "change_id long, raw_issue_id long, field string, from_value string, to_value string, from_string string, to_string string, change_date timestamp"
BOXES = "raw_sprint_id long, jira_sprint_id long, sprint_id string, sprint_name string, project string, start_date timestamp, end_date timestamp, complete_date timestamp"
ISSUES = "raw_issue_id long, issue_key string, project string, raw_sprint_id long, creation_date timestamp, resolution_date timestamp, story_point double, issue_type string"


def day(n):
    return dt(2020, 1, n)


def events(spark):
    rows = [("hot", day(n), n, f"v{n - 1}", f"v{n}") for n in range(1, 21)] + [("cold", day(9), 1, "p", "q"), ("cold", day(9), 2, "q", None), (None, day(3), 1, "x", "y")]
    return spark.createDataFrame(rows, "k string, ts timestamp, tie long, before string, after string")


def test_values_of_small_keys_are_dealt_once_and_not_written(spark):
    probes = spark.createDataFrame([("hot", day(5), 1)], "k string, at timestamp, n long")
    for d in (asof.value_asof(events(spark), probes, "k", "at"), asof.value_spans(events(spark), "k")):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "rangepartitioning" not in plan and "FileScan" not in plan


@pytest.mark.parametrize("limit", [0, 5, 1000])
def test_small_and_large_keys_give_the_same_rows(spark, monkeypatch, limit):
    ev = events(spark)
    probes = spark.createDataFrame([(k, at, "s") for k in ("hot", "cold", "bare", None) for at in [None, *map(day, range(1, 25))]], "k string, at timestamp, now string")
    static = spark.createDataFrame([("bare", "z"), ("hot", "z")], "k string, value string")
    rows = lambda d: sorted(map(str, d.collect()))
    want = rows(asof.value_asof(ev, probes, "k", "at", "now", 4)), rows(asof.value_intervals(ev, static, "k", 4))
    sliced, seen = [], asof.order_rows
    monkeypatch.setattr(asof, "order_rows", lambda *a, **k: sliced.append(1) or seen(*a, **k))
    monkeypatch.setattr(asof, "GROUP_ROWS", limit)
    got = rows(asof.value_asof(ev, probes, "k", "at", "now")), rows(asof.value_intervals(ev, static, "k"))
    assert got == want and len(want[0]) == 100
    assert len(sliced) == (0 if limit == 1000 else 2)


def test_rows_of_one_item_share_their_present_day_sprints(spark):
    boxes = spark.createDataFrame([(i, 100 + i, f"{p}__{i}", f"S{i}", p, day(1 + i), day(11 + i), day(12)) for i, p in ((1, "P"), (2, "P"), (3, "Q"))], BOXES)
    issue = lambda i, p, sprint: (i, f"P-{i}", p, sprint, dt(2019, 12, 1), None, 2.0, "Bug")
    issues = spark.createDataFrame([issue(7, "P", 1), issue(7, "P", 2), issue(7, "Q", None), issue(7, "Q", 3), issue(8, "P", None), issue(None, "P", 1), issue(9, "P", 1)], ISSUES)
    log = spark.createDataFrame([(1, 9, "Sprint", None, "102", None, None, day(20)), (2, 8, "Story Points", "3", "5", None, None, day(2))], CHANGES)
    out = scope.item_states(boxes, issues, log, [("start", F.col("start_date")), ("end", F.col("end_date"))]).collect()
    assert {(r.raw_issue_id, r.sprint_id) for r in out} == {(7, "P__1"), (7, "P__2"), (7, "Q__3")}
    assert len(out) == 3 and all(r.in_start and not r.from_history for r in out)
