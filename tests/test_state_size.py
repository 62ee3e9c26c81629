"""Work of the state reconstruction, and names that texts hold."""

from datetime import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import scope

CHANGES = "change_id long, raw_issue_id long, field string, from_value string, to_value string, from_string string, to_string string, change_date timestamp"


def ids(spark, names):
    return spark.createDataFrame([(p, "name", n, f"{p}-{n}", dt(2020, 1, 1), dt(2020, 1, 9)) for p, n in names],
                                 "project string, kind string, token string, sprint_id string, start_date timestamp, end_date timestamp")


def test_names_of_any_length_match_brute_force(spark):
    names = [("P", n) for n in ("a", "ab", "box", "box 1", "box 12", "box 2", "release", "böx 7")] + [("Q", "box 1"), ("Q", "x")]
    texts = [(p, t) for p in ("P", "Q", "R") for t in ("box 1", "moved to box 12", "a", "", "zz", "release box 2 box 2", "böx 7 and x", "relbox", "bo")]
    got = {(r.project, r.token, r.sprint_id) for r in scope.names_in_text(spark.createDataFrame(texts * 2, "project string, text string"), ids(spark, names)).collect()}
    want = set()
    for p, t in texts:
        own = [n for q, n in names if q == p]
        want |= {(p, t, f"{p}-{n}") for n in ([t] if t in own else [n for n in own if n in t])}
    assert got == want


def test_only_places_where_a_name_begins_are_cut_into_pieces(spark, monkeypatch):
    sizes = []
    seen = scope._places
    monkeypatch.setattr(scope, "_places", lambda t, h: sizes.append((t.count(), h.count())) or seen(t, h))
    names = ids(spark, [("P", f"box {n}") for n in range(200)])
    texts = spark.createDataFrame([("P", f"moved to box {n}") for n in range(100)] + [("P", f"box {n}") for n in range(200)], "project string, text string")
    assert scope.names_in_text(texts, names).where("token = 'moved to box 77'").count() == 2  # box 7 and box 77
    assert sizes == [(100, 1)]  # texts that are a name are not searched, and all names begin alike


def test_only_items_with_changes_of_points_are_probed(spark, monkeypatch):
    probes = []
    seen = scope.value_asof
    monkeypatch.setattr(scope, "value_asof", lambda ev, p, *a, **k: probes.append(p.count()) or seen(ev, p, *a, **k))
    day = lambda n: dt(2020, 1, n)
    boxes = spark.createDataFrame([(i, 100 + i, f"P__{i}", f"S{i}", "P", day(1 + i), day(11 + i), day(12)) for i in range(3)],
                                  "raw_sprint_id long, jira_sprint_id long, sprint_id string, sprint_name string, project string, start_date timestamp, end_date timestamp, complete_date timestamp")
    issues = spark.createDataFrame([(i, f"P-{i}", "P", i % 3, dt(2019, 12, 1), None, 2.0, "Bug") for i in range(30)],
                                   "raw_issue_id long, issue_key string, project string, raw_sprint_id long, creation_date timestamp, resolution_date timestamp, story_point double, issue_type string")
    log = spark.createDataFrame([(1, 0, "Story Points", "3", "5", None, None, day(2)), (2, 4, "Sprint", None, "101", None, None, day(5)),
                                 (3, 4, "Sprint", "101", "102", None, None, day(5)), (4, 0, "Story Points", "5", "7", None, None, day(20))], CHANGES)
    out = scope.item_states(boxes, issues, log, [("start", F.col("start_date")), ("end", F.col("end_date"))]).collect()
    assert probes == [2]  # one pair of one item, at two instants
    at = {(r.raw_issue_id, r.sprint_id): r for r in out}
    assert (at[0, "P__0"].sp_start, at[0, "P__0"].sp_end, at[0, "P__0"].points_from_history) == (3.0, 5.0, True)
    assert (at[3, "P__0"].sp_start, at[3, "P__0"].in_start, at[3, "P__0"].from_history) == (2.0, True, False)
    assert (4, "P__1") not in at and (at[4, "P__2"].in_start, at[4, "P__2"].in_end) == (False, True)


def test_items_are_rebuilt_once_for_boards_and_counts(spark, monkeypatch):
    from tidemark.operators import checkpoints as cp
    from tidemark.plans import state_queries as q

    rebuilt, seen = [], cp.item_states
    monkeypatch.setattr(cp, "item_states", lambda *a, **k: rebuilt.append(1) or seen(*a, **k))
    day = lambda n: dt(2020, 1, n)
    boxes = spark.createDataFrame([(1, 101, "P__1", "S1", "P", day(1), day(11), day(12))],
                                  "raw_sprint_id long, jira_sprint_id long, sprint_id string, sprint_name string, project string, start_date timestamp, end_date timestamp, complete_date timestamp")
    issues = spark.createDataFrame([(i, f"P-{i}", "P", 1, dt(2019, 12, 1), None, 2.0, "Bug") for i in range(5)],
                                   "raw_issue_id long, issue_key string, project string, raw_sprint_id long, creation_date timestamp, resolution_date timestamp, story_point double, issue_type string")
    log = spark.createDataFrame([(1, 0, "Story Points", "3", "5", None, None, day(2))], CHANGES)
    monkeypatch.setattr(q, "tables", lambda s, d: (boxes, issues, log))
    assert [(r.compared, r.differing) for r in q.board_reconciliation(spark, "").collect()] == [(1, 0)]
    assert rebuilt == [1]
