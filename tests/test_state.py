"""Reconstruction of scope and checkpoint state on small tables."""

from datetime import datetime as dt

import pytest

from tidemark.operators import checkpoints as cp
from tidemark.operators import scope
from tidemark.operators.asof import value_asof

SPRINTS = "raw_sprint_id long, jira_sprint_id long, sprint_id string, sprint_name string, project string, start_date timestamp, end_date timestamp, complete_date timestamp"
ISSUES = "raw_issue_id long, issue_key string, project string, raw_sprint_id long, creation_date timestamp, resolution_date timestamp, story_point double, issue_type string"
CHANGES = "change_id long, raw_issue_id long, project string, field string, from_value string, to_value string, from_string string, to_string string, change_date timestamp"


def d(day, month=1, hour=0):
    return dt(2020, month, day, hour)


def box(i=1, start=d(1), end=d(11), name=None, jira=None):
    return (i, jira or 100 + i, f"P__{i}", name or f"S{i}", "P", start, end, d(12))


def issue(i, resolution=None, sprint=1, sp=2.0, created=dt(2019, 12, 1)):
    return (i, f"P-{i}", "P", sprint, created, resolution, sp, "Bug")


def change(c, i, field, frm, to, when, fs=None, ts=None):
    return (c, i, "P", field, frm, to, fs, ts, when)


def tables(spark, boxes, issues, changes):
    return (spark.createDataFrame(boxes, SPRINTS), spark.createDataFrame(issues, ISSUES), spark.createDataFrame(changes, CHANGES))


def members(spark, boxes, issues, changes, **kw):
    return {(r.sprint_id, r.raw_issue_id): r for r in scope.commitments(*tables(spark, boxes, issues, changes), **kw).collect()}


def test_added_after_start_is_not_committed_and_removed_later_is(spark):
    got = members(spark, [box()], [issue(1), issue(2, sprint=None)], [
        change(1, 1, "Sprint", None, "101", d(3)), change(2, 2, "Sprint", "101", None, d(4))])
    assert set(got) == {("P__1", 2)}
    assert got[("P__1", 2)].sprint_source == "observed_sprint_history"


def test_event_exactly_at_start_applies_and_ties_go_by_change_id(spark):
    got = members(spark, [box(), box(2, start=d(2), end=d(9))], [issue(1, sprint=None), issue(2, sprint=None)], [
        change(1, 1, "Sprint", None, "101", d(1)),
        change(2, 2, "Sprint", None, "101", d(3)), change(3, 2, "Sprint", "101", "102", d(3))])
    # item 2: first event after both starts is change 2 (lower id), whose old value is empty
    assert set(got) == {("P__1", 1)}


def test_null_old_value_means_empty_not_static(spark):
    assert members(spark, [box()], [issue(1, sprint=1)], [change(1, 1, "Sprint", None, "101", d(5))]) == {}


def test_resolution_and_creation_rules(spark):
    got = members(spark, [box()], [issue(1, resolution=d(1)), issue(2, resolution=dt(2019, 12, 31)), issue(3, created=d(2)), issue(4, resolution=d(11))], [])
    assert {k[1]: r.completed_by_end for k, r in got.items()} == {1: True, 4: True}


def test_id_lists_unknown_ids_and_name_fallback(spark):
    boxes = [box(1, name="Alpha"), box(2, name="Alpha Two"), box(3, name="Gamma")]
    got = members(spark, boxes, [issue(i, sprint=None) for i in (1, 2, 3, 4)], [
        change(1, 1, "sprints", None, "101, 999, 103, 101", dt(2019, 12, 5)),
        change(2, 2, "Sprint", None, None, dt(2019, 12, 5), ts="alpha two"),       # exact name wins alone
        change(3, 3, "Sprint", None, None, dt(2019, 12, 5), ts="Gamma, Alpha Two, x"),  # every contained name
        change(4, 4, "Sprint", None, "[]", dt(2019, 12, 5), ts="Alpha")])          # an id list, though empty
    assert set(got) == {("P__1", 1), ("P__3", 1), ("P__2", 2), ("P__1", 3), ("P__2", 3), ("P__3", 3)}


def test_later_start_wins_on_duplicate_external_ids(spark):
    boxes = [box(1, jira=50), box(2, start=d(2), end=d(9), jira=50)]
    assert set(members(spark, boxes, [issue(1, sprint=None)], [change(1, 1, "Sprint", None, "50", dt(2019, 12, 5))])) == {("P__2", 1)}


def test_lenient_points(spark):
    got = members(spark, [box()], [issue(1, sp=8.0), issue(2, sp=None), issue(3)], [
        change(1, 1, "Story Points", None, "8", d(5), fs="about 3 points"), change(2, 3, "story point estimate", "5", "none", dt(2019, 12, 2))])
    assert {k[1]: r.story_point_at_start for k, r in got.items()} == {1: 3.0, 2: None, 3: None}


@pytest.mark.parametrize("slices", [None, 5])
def test_checkpoint_case(spark, slices):
    t = tables(spark, [box()], [issue(1, d(3)), issue(2, d(9)), issue(3, sprint=None), issue(4, d(5))], [
        change(1, 3, "Sprint", "101", None, d(4)), change(2, 4, "Sprint", None, "101", d(3))])
    s = {r.checkpoint: r for r in cp.checkpoint_state(*t, checkpoints=(0.5, 1.0), slices=slices).collect()}
    half, end = s[0.5], s[1.0]
    assert (half.committed_n, half.done_n, half.removed_n, half.added_n, half.added_done_n) == (3, 1, 1, 1, 1)
    assert (end.committed_n, end.done_n) == (3, 2)
    assert cp.board_reconciliation(cp.board_items(*t), cp.checkpoint_state(*t, checkpoints=(0.5,))).count() == 0


def test_points_case(spark):
    t = tables(spark, [box()], [issue(1, sp=8.0)], [change(1, 1, "Story Points", "3", "8", d(8))])
    s = {r.checkpoint: r for r in cp.checkpoint_state(*t, checkpoints=(0.5, 1.0)).collect()}
    assert (s[0.5].committed_sp, s[0.5].sp_now, s[1.0].sp_now) == (3.0, 3.0, 8.0)


def test_full_span_equals_planning_scope_and_done_never_falls(spark):
    from tidemark.plans.state_queries import tables as derived

    t = derived(spark, "/root/testdata/sf0.001")
    s = cp.checkpoint_state(*t, slices=6)
    plan = scope.planning_scope(*t)
    end = s.where("checkpoint = 1.0").join(plan, "sprint_id")
    assert end.where("committed_n <> committed_issue_count or done_n <> completed_issue_count or committed_sp <> committed_story_points").count() == 0
    seen = {}
    for r in s.orderBy("sprint_id", "checkpoint").collect():
        assert r.done_n >= seen.get(r.sprint_id, 0)
        seen[r.sprint_id] = r.done_n


@pytest.mark.parametrize("slices", [None, 9])
def test_asof_with_one_hot_key_matches_brute_force(spark, slices):
    import random

    rnd = random.Random(3)
    ev, state = [], None
    for i, h in enumerate(sorted(rnd.sample(range(1, 23), 15))):
        new = rnd.choice("abc")
        ev.append(("hot", d(5, hour=h), i, state, new))
        state = new
    ev.append(("cold", d(9), 1, "p", "q"))
    events = spark.createDataFrame(ev, "k string, ts timestamp, tie long, before string, after string")
    probes = spark.createDataFrame([(k, d(5, hour=h), "s") for k in ("hot", "cold", "bare") for h in range(24)], "k string, at timestamp, now string")
    for r in value_asof(events, probes, "k", "at", "now", slices).collect():
        later = [e for e in ev if e[0] == r.k and e[1] > r["at"]]
        any_ = [e for e in ev if e[0] == r.k]
        want = min(later, key=lambda e: (e[1], e[2]))[3] if later else max(any_, key=lambda e: (e[1], e[2]))[4] if any_ else "s"
        assert (r.value, r.has_history) == (want, bool(any_))


def test_missing_columns_are_named(spark):
    s, i, c = tables(spark, [box()], [issue(1)], [change(1, 1, "Sprint", None, "101", d(3))])
    with pytest.raises(ValueError, match="jira_sprint_id.*story_point"):
        scope.planning_scope(s.drop("jira_sprint_id"), i.drop("story_point"), c)
