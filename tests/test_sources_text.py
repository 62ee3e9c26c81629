"""Readers, nested inputs, sinks, board texts and the number check."""

import json
from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.sources import nested, sinks, tables


def test_delimited_reader_takes_tab_and_byte_order_mark(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("﻿ID\tJiraID\tName\tState\tStart_Date\tEnd_Date\tComplete_Date\tProject_Name\n"
                 "1\t11\tA, b\tCLOSED\t2020-01-01 00:00:00\t2020-01-10 00:00:00\t2020-01-11 00:00:00\tP\n"
                 "2\tNULL\tB\tCLOSED\tbad\t2020-01-10 00:00:00\t2020-01-11 00:00:00\tP\n"
                 "3\t13\tC\tACTIVE\t2020-01-01 00:00:00\t2020-01-10 00:00:00\t2020-01-11 00:00:00\tP\n")
    all_ = {r.raw_sprint_id: r for r in tables.load_sprints(spark, str(p), modeling_only=False).collect()}
    assert all_[1].sprint_name == "A, b" and all_[2].start_date is None and all_[2].jira_sprint_id is None and all_[1].activated_date is None
    assert [r.sprint_id for r in tables.load_sprints(spark, str(p)).collect()] == ["P__1"]
    with pytest.raises(FileNotFoundError):
        tables.load_change_log(spark, None, required=True)
    assert tables.load_change_log(spark, None) is None


def pull(tmp_path):
    spr = "c.Sprint@1[id={},rapidViewId={},state=closed,name=N {},startDate=2020-01-01T00:00:00.000+0000,completeDate=<null>]"
    issues = [
        {"p": "A", "id": "1", "k": "A-1", "c": "2020-01-01T02:00:00.000+0200", "spr": [spr.format(7, 9, 7), spr.format(8, 9, 8)],
         "ch": [["5", "Sprint", None, "7", None, "N 7", "2020-01-02T00:00:00.000+0000"], ["6", "Story Points", None, "3", None, "3", "2020-01-03T00:00:00.000+0000"]]},
        {"p": "B", "id": "2", "k": "B-1", "c": "2020-01-01T00:00:00.000+0000", "spr": [spr.format(7, 9, 7), json.dumps({"id": "20", "state": "active", "boardId": "5", "name": "x"})], "ch": []},
        {"p": "A", "id": "3", "k": "A-2", "c": "2020-01-01T00:00:00.000+0000", "spr": [spr.format(7, 9, 7), spr.format(31, 4, 31)], "oe": 7200.0},
    ]
    (tmp_path / "pull.json").write_text("\n".join(map(json.dumps, issues)))
    return str(tmp_path / "pull.json")


def test_nested_pull(spark, tmp_path):
    p = nested.read_pull(spark, pull(tmp_path))
    s = {r.raw_sprint_id: r for r in nested.flatten_sprints(p).collect()}
    # 7 belongs to A by majority, 31 sits on a stray board of A and is dropped, 20 is B's
    assert set(s) == {7, 8, 20} and s[7].project == "A" and s[20].project == "B" and s[20].sprint_state == "ACTIVE"
    assert s[7].start_date == dt(2020, 1, 1) and s[7].complete_date is None
    i = {r.raw_issue_id: r for r in nested.flatten_issues(p, {"A": "Alpha"}).collect()}
    assert i[1].raw_sprint_id == 8 and i[1].creation_date == dt(2020, 1, 1) and i[1].project == "Alpha" and i[3].original_estimate_hours == 2.0
    c = nested.flatten_changes(p).orderBy("change_id").collect()
    assert [(r.change_id, r.change_type, r.to_value) for r in c] == [(5, "OTHER", "7"), (6, "STORY_POINT", "3")]


def test_answers_and_audit(spark, tmp_path):
    run = tmp_path / "run1"
    run.mkdir()
    (run / "G_c00_b1.jsonl").write_text('{"id":"S1","warn":true,"p_late":0.7,"unfinished":0.2,"message":"m"}\n\n{"id":"S9","warn":false,"p_late":0.1,"unfinished":0.0}\n')
    man = tmp_path / "manifest.json"
    man.write_text(json.dumps([{"prompt": "G_c00_b1", "run": 1, "arm": "G", "checkpoint": 0.0, "boards": ["S1", "S2"]}]))
    a, m = nested.read_answers(spark, str(run)), nested.read_manifest(spark, str(man))
    c = nested.completeness(a, m).first()
    assert (c.asked, c.answered, c.missing, c.unasked, c.complete) == (2, 1, 1, 1, False)
    j = {r.board_id: r for r in nested.join_answers(a, m).collect()}
    assert j["S1"].warn == 1 and j["S2"].warn is None and j["S1"].arm == "G"
    tr = tmp_path / "t1.jsonl"
    use = lambda name, inp: {"message": {"model": "m", "content": [{"type": "tool_use", "name": name, "input": inp}]}}
    tr.write_text("\n".join(map(json.dumps, [use("Read", {"file_path": "/x"}), use("SubagentHandback", {"message": '{"id":"S1"}\n{"id":"S2"}'})])))
    exp = spark.createDataFrame([("t1", "/x", ["S1", "S2"]), ("t2", "/y", ["S3"])], "transcript string, file_path string, boards array<string>")
    audit = nested.audit_answers(nested.read_transcripts(spark, str(tr)), exp, "SubagentHandback")
    tries = spark.createDataFrame([("t1", 1, "p", 5), ("t2", 1, "p", 7)], "transcript string, run int, prompt string, finished long")
    last = nested.latest_attempts(audit, tries).first()
    assert (last.attempts, last.transcript, last.usable) == (2, "t2", False)
    assert nested.latest_attempts(audit, tries.where("finished = 5")).first().usable
    got = {r.transcript: (r.tool_calls, r.only_read_own_prompt, r.answers_complete) for r in nested.audit_answers(nested.read_transcripts(spark, str(tr)), exp, "SubagentHandback").collect()}
    assert got == {"t1": (1, True, True), "t2": (0, False, False)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.23456), ("a", float("nan"))], "k string, v double")
    sinks.write_rows(df, str(tmp_path / "o"), order=["k"])
    back = spark.read.option("header", True).csv(str(tmp_path / "o")).orderBy("k").collect()
    assert [(r.k, r.v) for r in back] == [("a", None), ("b", "1.2346")]
    m = spark.createDataFrame([("l", "logo", "lr", 5, 0.5), ("l", "logo", "lr", 7, 0.7)], "label string, validation_scheme string, model string, n int, f1 double").withColumns(
        {c: F.lit(None).cast("double") for c in ("precision", "recall", "roc_auc", "pr_auc")})
    for day in ("2026-01-01", "2026-01-02"):
        sinks.append_run_log(m, str(tmp_path / "log"), day, "d")
    sinks.append_run_log(m, str(tmp_path / "log"), "2026-01-02", "d")  # a retry leaves one copy
    sinks.append_run_log(m, str(tmp_path / "log"), "2026-01-02", "another")
    log = spark.read.parquet(str(tmp_path / "log")).collect()
    assert sorted((str(r.run_date), r.dataset) for r in log) == [("2026-01-01", "d"), ("2026-01-02", "another"), ("2026-01-02", "d")]
    assert log[0].f1 == 0.6 and log[0].folds == 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.txt").write_text("a\nb\n")
    import hashlib

    (tmp_path / "in" / "empty.txt").write_text("")
    (tmp_path / "in" / "sub").mkdir()
    (tmp_path / "in" / "sub" / "open.txt").write_text("x\ny")
    got = {r.file.rsplit("/", 1)[1]: r for r in sinks.fingerprints(spark, str(tmp_path / "in")).collect()}
    assert {k: (r.sha256, r.bytes, r.lines) for k, r in got.items()} == {
        "f.txt": (hashlib.sha256(b"a\nb\n").hexdigest(), 4, 2), "empty.txt": (hashlib.sha256(b"").hexdigest(), 0, 0), "open.txt": (hashlib.sha256(b"x\ny").hexdigest(), 3, 2)}
    sinks.write_split_manifest(spark.createDataFrame([("2", "test"), ("1", "train")], "sprint_id string, side string"), str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 2


def test_block_fingerprints(spark, tmp_path):
    import hashlib

    texts = {"a": b"line one\nline two\n" * 50, "b": b"no end of line", "empty": b"", "edge": b"0123456\n" * 4, "broken": b"0123456\n" * 4 + b"x"}
    for n, t in texts.items():
        (tmp_path / n).write_bytes(t)
    for block in (8, 100, 1 << 20):
        got = {r.file.rsplit("/", 1)[1]: (r.root, r.bytes, r.lines) for r in sinks.block_fingerprints(spark, str(tmp_path), block).collect()}
        root = lambda t: hashlib.sha256("".join(hashlib.sha256(t[k:k + block]).hexdigest() for k in range(0, len(t), block)).encode()).hexdigest()
        assert got == {n: (root(t), len(t), t.count(b"\n") + (not t.endswith(b"\n") and bool(t))) for n, t in texts.items()}


BOARD = """Team: Project A (name hidden). Planned sprint length: 14.0 days.
Team history (finished sprints before this one started, up to the last three): 3 available; average share of committed issues completed 0.64; issues carried over from the last one 2; share that closed more than a day late 0.33; average days late 1.5; average issues completed 4.0.
Committed at the start: 9 issues; story points recorded on 2 of them (total 8).
Issues:
- committed: Bug, 3 SP, not resolved yet
- committed: Story, 5 SP, resolved on day 2.0
- added later: Bug, no estimate, not resolved yet"""


@pytest.mark.parametrize("message,n,bad", [
    ("Only 36% were carried, one sprint late", 1, ""),            # complement of 0.64; 'one' is a word
    ("33% late, 8 points, two bugs", 3, ""),                      # share, total, count by type
    ("about 16 days", 1, ""),                                     # 14 within 15 percent
    ("exactly 77 issues and 6 open", 2, "77"),                    # 9 - 3 = 6 from the head
    ("x5 and v2.1 do not count, 5 does", 1, ""),
    ("roughly 200 or 1000", 2, "200; 1000"),
    ("no numbers here", 0, ""),
])
def test_number_support(spark, message, n, bad):
    r = text.number_support(spark.createDataFrame([(message, BOARD)], "m string, b string"), "m", "b").first()
    assert (r.n_numbers, r.unsupported, r.all_supported) == (n, bad, bad == "")


def test_line_edits(spark):
    df = spark.createDataFrame([(0.7, 0.5), (0.2, 0.5), (0.999, 0.4)], "p double, t double")
    line = text.grounding_line(F.col("p"), F.col("t"), 0.75)
    r = df.select(line.alias("l"), text.hide_verdict(line).alias("h"), text.flip_verdict(line, F.col("p"), F.col("t")).alias("f"),
                  text.mirror_line(line, F.col("p"), F.col("t")).alias("m"), text.training_record(line, 0.8).alias("t"), text.mirrored(F.col("p"), F.col("t")).alias("q")).collect()
    assert "closing late 0.70; its alarm threshold is 0.50, so the model says WARN. On held-out" in r[0].l
    assert "closing late 0.70. On held-out" in r[0].h and "says SILENT." in r[0].f and "says WARN." in r[1].f
    assert "closing late 0.30; its alarm threshold is 0.50, so the model says SILENT." in r[0].m
    assert r[0].t.endswith("80% of the time (AUC 0.80).") and r[2].q == 0.01


def test_board_keeps_forty_lines_and_counts_the_rest(spark):
    rows = [("S", "P", f"i{i:03d}", "Bug", "committed", 2.0, 2.5, None, True, 0.0) for i in range(45)]
    items = spark.createDataFrame(rows, "sprint_id string, project string, raw_issue_id string, issue_type string, part string, sp_start double, sp_mid double, done_day_by_mid double, in_at_mid boolean, created_day double")
    s = spark.createDataFrame([("S", "P", 10.0, 2, 0, "A")], "sprint_id string, project string, sprint_length_days double, n_concurrent_sprints int, hist_n_available int, group_letter string").withColumns(
        {c: F.lit(None).cast("double") for c in ("hist_avg_completion_ratio_3", "hist_last_carryover", "hist_late_rate_3", "hist_avg_late_days_3", "hist_avg_completed_issues_3")})
    b = text.board_texts(items, s).first().board
    assert b.count("\n- committed: Bug, 2.5 SP, not resolved yet") == 40 and b.endswith("- ... and 5 more issues of the same kinds")
    assert b.startswith("Team: Project A (name hidden).") and "story points recorded on 45 of them (total 90)" in b and "no finished earlier sprint" in b
    assert text.board_texts(items, s, at_start=True).first().board.count("- Bug, 2 SP") == 40


def test_names_of_many_groups_and_items(spark):
    n = [1, 26, 27, 52, 257, 300, 702, 703, 10**12]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in n], "n long").select(text.letter_name(F.col("n"))).collect()]
    name = lambda k: (name((k - 1) // 26) if k > 26 else "") + chr(65 + (k - 1) % 26)
    assert got == [name(x) for x in n] and len(set(got)) == len(n)
    codes = [r[0] for r in spark.createDataFrame([(7,), (100_000_000,), (123_456_789,)], "n long").select(text.item_number(F.col("n"))).collect()]
    assert codes == ["00000007", "100000000", "123456789"]


def test_closed_boxes_in_any_case(spark):
    day = lambda k: f"2020-01-{k:02d} 00:00:00"
    rows = [(s, day(1), day(5), day(6)) for s in ("CLOSED", "closed", "Closed", "ACTIVE")] + [("closed", day(5), day(1), day(6))]
    df = spark.createDataFrame(rows, "sprint_state string, start_date string, end_date string, complete_date string")
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in ("start_date", "end_date", "complete_date")})
    assert tables.eligible(df).count() == 3


def test_split_files_and_quoted_line_ends(spark, tmp_path):
    head = "ID,Issue_Key,Type,Status,Story_Point,Priority,Creation_Date,Sprint_ID,Project_Name,Resolution_Date,Assignee_ID\n"
    (tmp_path / "a.csv").write_text("\ufeff" + head + '1,K-1,Bug,"Done, or so",3,,2020-01-01 00:00:00,7,P,NULL,A\n2,K-2,Story,Open,x,,bad,,P,,\n')
    got = tables.load_issues(spark, str(tmp_path / "a.csv")).orderBy("raw_issue_id").collect()
    assert [(r.raw_issue_id, r.status, r.story_point, r.raw_sprint_id, r.assignee) for r in got] == [(1, "Done, or so", 3.0, 7, "A"), (2, "Open", None, None, None)]
    (tmp_path / "b.csv").write_text(head + '1,K-1,Bug,"two\nlines",3,,2020-01-01 00:00:00,7,P,,A\n')
    assert tables.load_issues(spark, str(tmp_path / "b.csv"), quoted_newlines=True).first().status == "two\nlines"


def test_typed_read_back_and_streamed_fingerprints(spark, tmp_path):
    import hashlib

    df = spark.createDataFrame([(1, "a, b", 0.12345, None), (2, None, None, "2020-01-02 03:04:05")], "k long, t string, x double, d string").withColumn("d", F.col("d").cast("timestamp"))
    sinks.write_rows(df, str(tmp_path / "w"), digits=None)
    assert sorted(map(tuple, sinks.read_rows(spark, str(tmp_path / "w"), df.schema).collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "x.txt").write_bytes(b"one\ntwo")
    (tmp_path / "y.txt").write_bytes(b"three\n")
    got = {r.file.rsplit("/", 1)[1]: (r.sha256, r.bytes, r.lines) for r in sinks.fingerprints(spark, str(tmp_path / "*.txt")).collect()}
    assert got == {n: (hashlib.sha256(b).hexdigest(), len(b), k) for n, b, k in (("x.txt", b"one\ntwo", 2), ("y.txt", b"three\n", 1))}
