"""Queries on reconstructed state: as-of values, planning scope, checkpoints, boards, provenance."""

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import checkpoints as cp
from tidemark.operators import scope, summaries
from tidemark.operators.asof import last_asof
from tidemark.plans import tracker as tk
from tidemark.plans.oracle import days, hash_of, with_
from tidemark.plans.registry import query, tidy
from tidemark.session import materialize


def tables(spark, d):
    """Boxes, items and change log."""
    i = tk.items(spark, d)
    return tk.closed_boxes(spark, d), i, tk.changes(i)


@query("state_asof", """
WITH e AS (SELECT user_id, ts, event_type FROM events),
p AS (SELECT user_id, d::TIMESTAMP AS day FROM (SELECT DISTINCT user_id FROM events), generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) g(d))
SELECT p.day, coalesce(e.event_type, 'none') AS state, count(*) AS users FROM p ASOF LEFT JOIN e ON p.user_id=e.user_id AND p.day>=e.ts GROUP BY 1,2""")
def state_asof(spark, d):
    """State of every user at each midnight, from a change log of event types."""
    ev = tk.load(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    users = ev.select("user_id").distinct()
    days_ = F.sequence(F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-31").cast("timestamp"), F.expr("INTERVAL 1 DAY"))
    probes = users.select("user_id", F.explode(days_).alias("day"))
    log = ev.select("user_id", "ts", F.col("event_id").alias("tie"), F.col("event_type").alias("after"))
    seen = last_asof(log, probes, "user_id", "day")
    return seen.groupBy("day", F.coalesce("value", F.lit("none")).alias("state")).agg(F.count(F.lit(1)).alias("users"))


@query("planning_scope", with_("commit0") + """
SELECT sp.sprint_id, count(c.iid) AS committed_issue_count, coalesce(sum(pt),0.0) AS committed_story_points, count(*) FILTER (done) AS completed_issue_count,
 count(*) FILTER (NOT done) AS not_completed_count, coalesce(sum(pt) FILTER (done),0.0) AS delivered_story_points, any_value(""" + days("sp.end_date", "sp.start_date") + """) AS sprint_length_days
FROM sp LEFT JOIN commit0 c USING (sprint_id) GROUP BY 1""")
def planning_scope(spark, d):
    return tidy(scope.planning_scope(*tables(spark, d)), "sprint_id", *scope.AGGREGATES, "sprint_length_days")


@query("static_scope", with_("item", "sp") + """
SELECT sp.sprint_id, count(iid) AS committed_issue_count, coalesce(sum(coalesce(points,0)),0.0) AS committed_story_points,
 count(*) FILTER (coalesce(resolved<=end_date,FALSE)) AS completed_issue_count, count(iid) - count(*) FILTER (coalesce(resolved<=end_date,FALSE)) AS not_completed_count,
 coalesce(sum(points) FILTER (resolved<=end_date),0.0) AS delivered_story_points, count(DISTINCT assignee) AS num_developers
FROM sp LEFT JOIN item ON item.raw=sp.k AND item.project=sp.project GROUP BY 1""")
def static_scope(spark, d):
    return tidy(scope.static_scope(tk.closed_boxes(spark, d), tk.items(spark, d)), "sprint_id", *scope.AGGREGATES, "num_developers")


@query("scope_audit", with_("commit0", "toks") + """,
first AS (SELECT project, min(start_date) AS fs FROM sp GROUP BY 1),
lastev AS (SELECT iid, project, arg_max({'v': tv, 's': tstr}, epoch_us(ts)*10+cid) AS st, any_value(ok) AS ok FROM sev JOIN item USING (iid, project) GROUP BY 1,2),
used AS (SELECT e.iid, e.project, e.fv AS v, e.fs AS s FROM sev e JOIN first USING (project) WHERE e.ts>first.fs UNION ALL SELECT iid, project, st.v, st.s FROM lastev),
lastp AS (SELECT iid, arg_max({'v': av}, epoch_us(ts)*10+cid) AS st FROM pev GROUP BY 1)
SELECT (SELECT count(*) FROM item) AS issues_seen, (SELECT count(*) FROM sev)+(SELECT count(*) FROM pev) AS relevant_change_events, (SELECT count(*) FROM sev) AS sprint_change_events,
 (SELECT count(*) FROM pev) AS story_point_change_events, (SELECT count(DISTINCT iid) FROM sev) AS issues_with_sprint_history, (SELECT count(DISTINCT iid) FROM pev) AS issues_with_story_point_history,
 (SELECT count(*) FROM lastev l JOIN item i USING (iid) JOIN sp ON sp.k=i.raw AND sp.project=i.project WHERE NOT EXISTS (SELECT 1 FROM toks t WHERE t.project=l.project AND t.v IS NOT DISTINCT FROM l.st.v AND t.s IS NOT DISTINCT FROM l.st.s AND t.raw IS NULL AND t.sprint_id=sp.sprint_id)) AS latest_sprint_history_vs_static_disagreements,
 (SELECT count(*) FROM lastp l JOIN item i USING (iid) WHERE abs(l.st.v-i.points)>1e-6) AS latest_story_history_vs_static_disagreements,
 (SELECT count(*) FROM used u JOIN toks t ON t.project=u.project AND t.v IS NOT DISTINCT FROM u.v AND t.s IS NOT DISTINCT FROM u.s AND t.raw IS NULL WHERE t.sprint_id IS NULL) AS unknown_sprint_id_tokens_ignored,
 (SELECT count(*) FROM commit0) AS issue_sprint_memberships_at_start, (SELECT count(*) FROM pts0 WHERE created>start_date) AS memberships_excluded_issue_created_after_start,
 (SELECT count(*) FROM pts0 WHERE created<=start_date AND resolved<start_date) AS memberships_excluded_resolved_before_start,
 (SELECT count(*) FROM sp) AS sprints_reconstructed, (SELECT count(*) FROM sp WHERE sprint_id NOT IN (SELECT sprint_id FROM commit0)) AS zero_scope_sprints,
 (SELECT count(DISTINCT sprint_id) FROM commit0) AS nonzero_scope_sprints""")
def scope_audit(spark, d):
    return tidy(scope.scope_audit(*tables(spark, d)))


_PROV = {"observed_sprint_history": ("commitments_with_observed_sprint_history", "ssrc"), "static_sprint_fallback": ("commitments_with_static_sprint_fallback", "ssrc"),
         "observed_story_history": ("commitments_with_observed_story_history", "psrc"), "static_story_fallback": ("commitments_with_static_story_fallback", "psrc")}


@query("provenance", with_("commit0") + "SELECT project, count(*) AS commitments, " + ", ".join(
    f"count(*) FILTER ({c}='{v}') AS {n}, round(count(*) FILTER ({c}='{v}')/count(*)::DOUBLE,6) AS {n}_rate" for v, (n, c) in _PROV.items()) + " FROM commit0 GROUP BY 1")
def provenance(spark, d):
    return tidy(scope.provenance_by_project(scope.commitments(*tables(spark, d))))


@query("high_confidence_sprints", with_("commit0") + "SELECT project, sprint_id, count(*) AS commitments FROM commit0 GROUP BY 1,2 HAVING bool_and(hist)")
def high_confidence(spark, d):
    return scope.high_confidence_sprints(scope.commitments(*tables(spark, d)))


@query("history_rate_sensitivity", with_("commit0") + """, r AS (SELECT project, count(*) AS n, avg(CASE WHEN hist THEN 1.0 ELSE 0.0 END) AS rate FROM commit0 GROUP BY 1)
SELECT cutoff, count(*) FILTER (rate>=cutoff) AS projects, CAST(coalesce(sum(n) FILTER (rate>=cutoff),0) AS BIGINT) AS commitments FROM r, (VALUES (0.3::DOUBLE),(0.4),(0.42),(0.43),(0.44),(0.5)) v(cutoff) GROUP BY 1""")
def history_rate_sensitivity(spark, d):
    return tidy(scope.history_rate_sensitivity(scope.commitments(*tables(spark, d)), [0.3, 0.4, 0.42, 0.43, 0.44, 0.5]))


@query("excluded_status", with_("item") + "SELECT project, count(*) AS items, count(*) FILTER (status IN ('O/A','O/R')) AS excluded_items FROM item GROUP BY 1")
def excluded_status(spark, d):
    return scope.excluded_status_counts(tk.items(spark, d), ["O/A", "O/R"])


@query("checkpoint_state", with_("ckpt") + "SELECT sprint_id, checkpoint, checkpoint_time, committed_n, committed_sp, done_n, done_sp, removed_n, added_n, added_done_n, sp_now FROM ckpt")
def checkpoint_state(spark, d):
    return tidy(cp.checkpoint_state(*tables(spark, d)), "sprint_id", "checkpoint", "checkpoint_time", *cp.STATE)


@query("progress_features", with_("ckpt") + f""", x AS (SELECT *, {days('checkpoint_time','start_date')} AS el, greatest({days('end_date','checkpoint_time')},0.0) AS rem, committed_n-done_n AS rn, committed_n::DOUBLE AS c,
 CASE WHEN committed_n>0 THEN done_n/committed_n::DOUBLE ELSE 0.0 END AS share FROM ckpt)
SELECT sprint_id, checkpoint, round(rem,6) AS remaining_days, round(share,6) AS done_share, rn AS remaining_n, committed_sp-done_sp AS remaining_sp,
 round(CASE WHEN committed_n>0 THEN share-checkpoint ELSE 0.0 END,6) AS burn_gap, round(least(rn/greatest(rem,0.5),50.0),6) AS required_rate, round(least(done_n/greatest(el,0.5),50.0),6) AS observed_rate,
 round(least(added_n/greatest(c,1.0),5.0),6) AS added_ratio, round(least(removed_n/greatest(c,1.0),5.0),6) AS removed_ratio,
 round(greatest(least((sp_now-committed_sp)/greatest(committed_sp,1.0),5.0),-1.0),6) AS sp_change_ratio, complete_date>checkpoint_time AS open_at_checkpoint FROM x""")
def progress_features(spark, d):
    f = cp.progress_features(cp.checkpoint_state(*tables(spark, d)))
    return tidy(f, "sprint_id", "checkpoint", "remaining_days", "done_share", "remaining_n", "remaining_sp", "burn_gap", "required_rate",
                "observed_rate", "added_ratio", "removed_ratio", "sp_change_ratio", "open_at_checkpoint")


_BOARD = with_("pairk") + f""", b AS (SELECT sprint_id, project, iid AS raw_issue_id, issue_type, CASE WHEN in0 THEN 'committed' ELSE 'added' END AS part, CASE WHEN in0 THEN sp0_raw END AS sp_start, sp_at AS sp_mid,
 CASE WHEN donek THEN {days('resolved','start_date')} END AS done_day_by_mid, ink AS in_at_mid, {days('created','start_date')} AS created_day FROM pairk WHERE f=0.5 AND (in0 OR (open0 AND ink)))
"""


@query("board_items", _BOARD + "SELECT * FROM b")
def board_items(spark, d):
    return tidy(cp.board_items(*tables(spark, d)))


@query("board_reconciliation", with_("ckpt") + "SELECT count(*) AS compared, CAST(0 AS BIGINT) AS differing FROM ckpt WHERE checkpoint=0.5")
def board_reconciliation(spark, d):
    """Item boards against checkpoint counts: boxes compared, and boxes that differ (none may)."""
    s, i, c = tables(spark, d)
    pairs = materialize(cp.item_pairs(s, i, c, [0.5], ["issue_type"]))  # rebuilt once, read for both sides
    state = materialize(cp.checkpoint_state(s, i, c, [0.5], pairs=pairs))
    odd = cp.board_reconciliation(cp.board_items(s, i, c, pairs=pairs), state).select(F.lit(1).alias("one_"), "sprint_id").groupBy("one_").agg(F.count("sprint_id").alias("differing"))
    return state.agg(F.count(F.lit(1)).alias("compared"), F.lit(1).alias("one_")).join(F.broadcast(odd), "one_", "left").select("compared", F.coalesce("differing", F.lit(0).cast("long")).alias("differing"))


_NUM = lambda c: f"CASE WHEN {c}=floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"


@query("board_text", with_("pairk", "hist") + _BOARD[len(with_("pairk")):] + f""",
l AS (SELECT sprint_id, row_number() OVER (PARTITION BY sprint_id ORDER BY part DESC, raw_issue_id) AS rn,
 CASE WHEN part='committed' THEN '- committed: ' ELSE '- added later: ' END||issue_type||', '||CASE WHEN sp_mid IS NULL THEN 'no estimate' ELSE {_NUM('sp_mid')}||' SP' END||', '||
 CASE WHEN done_day_by_mid IS NOT NULL THEN 'resolved on day '||printf('%.1f',done_day_by_mid) WHEN part='committed' AND NOT in_at_mid THEN 'moved out of the sprint' ELSE 'not resolved yet' END AS line FROM b),
t AS (SELECT sprint_id, string_agg(line, chr(10) ORDER BY rn) AS txt FROM l WHERE rn<=40 GROUP BY 1),
n AS (SELECT sprint_id, count(*) FILTER (part='committed') AS n, count(*) FILTER (part='committed' AND sp_start IS NOT NULL) AS kn, coalesce(sum(sp_start) FILTER (part='committed'),0.0) AS pts,
 count(*) FILTER (part='committed' AND done_day_by_mid IS NOT NULL) AS dn, count(*) FILTER (part='committed' AND NOT in_at_mid) AS o, count(*) FILTER (part='added') AS ad, count(*) FILTER (part='added' AND done_day_by_mid IS NOT NULL) AS adn FROM b GROUP BY 1)
SELECT h.sprint_id, 'Team: Project '||g.letter||printf(' (name hidden). Planned sprint length: %.1f days.', len)||chr(10)||'Other sprints of this project open at the same time: '||n_conc||'.'||chr(10)||
 CASE WHEN h_n>0 THEN 'Team history (finished sprints before this one started, up to the last three): '||h_n||' available; average share of committed issues completed '||printf('%.2f',round(h_ratio,9)+1e-9)||'; issues carried over from the last one '||h_carry
 ||'; share that closed more than a day late '||printf('%.2f',round(h_rate,9)+1e-9)||'; average days late '||printf('%.1f',round(h_late,9)+1e-9)||'; average issues completed '||printf('%.1f',round(h_done,9)+1e-9)||'.' ELSE 'Team history: no finished earlier sprint was available when this sprint started.' END||chr(10)||
 'Committed at the start: '||coalesce(n,0)||' issues; story points recorded on '||coalesce(kn,0)||' of them (total '||CAST(CAST(coalesce(pts,0) AS BIGINT) AS VARCHAR)||').'||chr(10)||
 printf('Now: day %.1f of %.1f (halfway). Committed issues resolved so far: ', len*0.5, len)||coalesce(dn,0)||' of '||coalesce(n,0)||'. Committed issues moved out of the sprint: '||coalesce(o,0)||'. Issues added since the start: '||coalesce(ad,0)||', of which resolved: '||coalesce(adn,0)||'.'||chr(10)||'Issues:'||chr(10)||coalesce(txt,'')||CASE WHEN coalesce(n,0)+coalesce(ad,0)>40 THEN chr(10)||'- ... and '||(coalesce(n,0)+coalesce(ad,0)-40)||' more issues of the same kinds' ELSE '' END AS board
FROM hist h JOIN (SELECT project, chr(CAST(64+row_number() OVER (ORDER BY project) AS INTEGER)) AS letter FROM (SELECT DISTINCT project FROM hist)) g USING (project) JOIN sp USING (sprint_id) LEFT JOIN n USING (sprint_id) LEFT JOIN t USING (sprint_id)""")
def board_text(spark, d):
    """The text of every closed box at half time."""
    s, i, c = tables(spark, d)
    frame = tk.modelling_frame(spark, d)
    letters = text.pseudonyms(frame.select("project", "sprint_id"), "project", "sprint_id").select("sprint_id", "group_letter")
    return text.board_texts(cp.board_items(s, i, c), frame.where(F.col("sprint_state") == "CLOSED").join(letters, "sprint_id"))


@query("resolution_timing", with_("commit0") + f""", m AS (SELECT *, {days('resolved','end_date')} AS lag FROM commit0), s AS (SELECT sprint_id, count(*) AS n, count(*) FILTER (done) AS e, count(*) FILTER (coalesce(resolved<=complete_date,FALSE)) AS c FROM m GROUP BY 1)
SELECT count(*) AS commitments, round(avg(done::INT),6) AS share_completed_by_end, round(avg((resolved IS NULL)::INT),6) AS share_no_resolution, round(avg((lag<=0)::INT) FILTER (resolved IS NOT NULL),6) AS share_by_planned_end,
 round(avg((lag>0 AND lag<=1)::INT) FILTER (resolved IS NOT NULL),6) AS share_within_1_day, round(avg((resolved<=complete_date)::INT) FILTER (resolved IS NOT NULL),6) AS share_by_closure, round(avg((lag>30)::INT) FILTER (resolved IS NOT NULL),6) AS share_over_30_days,
 (SELECT count(*) FROM s) AS sprints, (SELECT round(avg((e<n)::INT),6) FROM s) AS spill_by_end, (SELECT round(avg((c<n)::INT),6) FROM s) AS spill_by_closure, (SELECT round(avg((e=0)::INT),6) FROM s) AS nothing_by_end, (SELECT round(avg((c=0)::INT),6) FROM s) AS nothing_by_closure,
 round(quantile_cont(lag,0.5) FILTER (lag>0),6) AS median_lag_after_end FROM m""")
def resolution_timing(spark, d):
    s, i, c = tables(spark, d)
    return tidy(summaries.resolution_timing(scope.commitments(s, i, c), s))


@query("first_addition_lag", with_("sev", "sp", "lab") + """, a AS (SELECT tok, min(ts) AS first_ts FROM (SELECT ts, unnest(regexp_extract_all(tv,'\\d+')) AS tok, fv FROM sev WHERE tv IS NOT NULL) WHERE fv IS NULL OR NOT list_contains(regexp_extract_all(fv,'\\d+'), tok) GROUP BY 1)
SELECT sp.project, count(*) AS sprints, round(avg((coalesce(h>0 AND h<=1,FALSE))::INT),6) AS within_1h, round(avg((coalesce(h>0 AND h<=24,FALSE))::INT),6) AS within_24h, round(avg((coalesce(h>0,FALSE))::INT),6) AS after_start
FROM (SELECT sp.*, (epoch_us(first_ts)-epoch_us(start_date))/3600e6::DOUBLE AS h FROM sp JOIN (SELECT sprint_id FROM lab WHERE committed=0) USING (sprint_id) LEFT JOIN a ON a.tok=sp.jira::VARCHAR) sp GROUP BY 1""")
def first_addition_lag(spark, d):
    """Boxes that were empty at the start."""
    s, c = tk.closed_boxes(spark, d), tk.changes(tk.items(spark, d))
    s = s.join(tk.labelled(spark, d).where(F.col("committed_issue_count") == 0).select("sprint_id"), "sprint_id", "left_semi")
    return tidy(summaries.addition_lag_shares(summaries.first_addition_lag(c, s), s))


@query("repeat_commitments", with_("commit0") + """, p AS (SELECT project, iid, count(*) AS t FROM commit0 GROUP BY 1,2)
SELECT project, CAST(sum(t) AS BIGINT) AS commitments, count(*) AS items, round(1-count(*)/sum(t)::DOUBLE,6) AS share_repeats, round(avg((t>1)::INT),6) AS share_items_repeated FROM p GROUP BY 1""")
def repeat_commitments(spark, d):
    return tidy(summaries.repeat_commitments(scope.commitments(*tables(spark, d))))


@query("majority_owner", """
SELECT l_partkey, l_suppkey, votes, all_votes FROM (SELECT l_partkey, l_suppkey, count(*) AS votes, CAST(sum(count(*)) OVER (PARTITION BY l_partkey) AS BIGINT) AS all_votes, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_suppkey) AS rn FROM lineitem GROUP BY 1,2) WHERE rn=1""")
def majority_owner(spark, d):
    return summaries.majority_owner(tk.load(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("drop_strays", """
SELECT l_partkey, count(*) AS kept FROM lineitem l JOIN (SELECT l_partkey AS p, l_suppkey AS s FROM (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_suppkey) AS rn FROM lineitem GROUP BY 1,2) WHERE rn=1) ON p=l_partkey AND s=l_suppkey GROUP BY 1""")
def drop_strays(spark, d):
    kept = summaries.drop_strays(tk.load(spark, d, "lineitem"), "l_partkey", "l_suppkey")
    return kept.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("kept"))


@query("coverage_gap", with_("item") + """, d AS (SELECT project, regexp_extract(issue_key,'^(.*)-[^-]*$',1) AS prefix, CAST(regexp_extract(issue_key,'-([^-]*)$',1) AS DOUBLE) AS num, raw FROM item),
g AS (SELECT project, prefix, count(*) AS items, min(num) FILTER (raw IS NOT NULL) AS lo, max(num) AS hi FROM d GROUP BY 1,2 HAVING count(*)>=200)
SELECT project, prefix, items, lo, hi, count(*) AS visible, round(1-count(*)/(hi-lo+1),6) AS gap FROM g JOIN d USING (project, prefix) WHERE num BETWEEN lo AND hi GROUP BY 1,2,3,4,5""")
def coverage_gap(spark, d):
    return tidy(summaries.coverage_gap(tk.items(spark, d)))


@query("id_set_parse", with_("sev", "sp") + """, c AS (SELECT project, iid, cid, 'from' AS side, fv AS v FROM sev UNION ALL SELECT project, iid, cid, 'to', tv FROM sev),
t AS (SELECT *, unnest(regexp_extract_all(v,'\\d+')) AS tok FROM c WHERE v IS NOT NULL)
SELECT t.project, side, count(*) AS tokens, count(sp.sprint_id) AS known, count(*)-count(sp.sprint_id) AS unknown FROM t LEFT JOIN sp ON sp.project=t.project AND sp.jira::VARCHAR=tok GROUP BY 1,2""")
def id_set_parse(spark, d):
    """Known and unknown ids in the id lists of the change log."""
    from tidemark.functions.scalars import field_kind, id_tokens

    s, _, c = tables(spark, d)
    sides = F.array(F.struct(F.lit("from").alias("side"), F.col("from_value").alias("v")), F.struct(F.lit("to").alias("side"), F.col("to_value").alias("v")))
    cells = c.where(field_kind(F.col("field")) == "sprint").select("project", F.explode(sides).alias("x"))
    toks = cells.select("project", "x.side", F.explode(id_tokens(F.col("x.v"))).alias("token"))
    ids = scope.sprint_ids(s).where(F.col("kind") == "jira").select("project", "token", "sprint_id")
    return toks.join(ids, ["project", "token"], "left").groupBy("project", "side").agg(
        F.count(F.lit(1)).alias("tokens"), F.count("sprint_id").alias("known"), F.count_if(F.col("sprint_id").isNull()).alias("unknown"))


@query("name_fallback", with_("toks") + "SELECT project, lower(s) AS text, sprint_id FROM toks WHERE v IS NULL AND s IS NOT NULL AND sprint_id IS NOT NULL")
def name_fallback(spark, d):
    """Sprints named in free text: the exact name, else every name it contains."""
    s, _, c = tables(spark, d)
    texts = c.where(F.col("to_value").isNull() & F.lower("field").isin("sprint")).select("project", F.lower(F.trim("to_string")).alias("text")).where(F.col("text").isNotNull())
    return scope.names_in_text(texts, scope.sprint_ids(s)).select("project", F.col("token").alias("text"), "sprint_id")


@query("pseudonyms", with_("lab") + f""", g AS (SELECT project, chr(CAST(64+row_number() OVER (ORDER BY project) AS INTEGER)) AS group_letter FROM (SELECT DISTINCT project FROM lab)),
c AS (SELECT sprint_id, 'S'||lpad(CAST(row_number() OVER (ORDER BY {hash_of("'42'", 'sprint_id')}, sprint_id) AS VARCHAR),8,'0') AS item_code FROM lab) SELECT sprint_id, group_letter, item_code FROM lab JOIN g USING (project) JOIN c USING (sprint_id)""")
def pseudonyms(spark, d):
    return text.pseudonyms(tk.boxes(spark, d), "project", "sprint_id").select("sprint_id", "group_letter", "item_code")


_AUC = "On held-out sprints this model ranked late sprints above on-time ones 75% of the time (AUC 0.75)."


@query("model_lines", with_("study") + f""", q AS (SELECT *, greatest(least(2*m_threshold-m_score,0.99::DOUBLE),0.01::DOUBLE) AS q, CASE WHEN m_score>=m_threshold THEN 'WARN' ELSE 'SILENT' END AS c FROM study)
SELECT sprint_id, checkpoint, printf('Risk model: probability of closing late %.2f; its alarm threshold is %.2f, so the model says ', m_score+1e-9, m_threshold+1e-9)||c||'. {_AUC}' AS shown,
 printf('Risk model: probability of closing late %.2f. ', m_score+1e-9)||'{_AUC}' AS hidden, printf('Risk model: probability of closing late %.2f; its alarm threshold is %.2f, so the model says ', m_score+1e-9, m_threshold+1e-9)||CASE WHEN c='WARN' THEN 'SILENT' ELSE 'WARN' END||'. {_AUC}' AS flipped,
 CASE WHEN q>=m_threshold THEN 'WARN' ELSE 'SILENT' END AS mirrored_call, round(q,6) AS mirrored FROM q""")
def model_lines(spark, d):
    """Model line of every replay point, and its edits: verdict hidden, flipped, mirrored."""
    s = tk.study(spark, d)
    p, t = F.col("m_score"), F.col("m_threshold")
    s = s.withColumn("shown", text.grounding_line(p, t, 0.75))
    return tidy(s.select("sprint_id", "checkpoint", "shown", text.hide_verdict(F.col("shown")).alias("hidden"), text.flip_verdict(F.col("shown"), p, t).alias("flipped"),
                         text.verdict(text.mirrored(p, t), t).alias("mirrored_call"), text.mirrored(p, t).alias("mirrored")))


@query("text_numbers", "SELECT doc_id, len(regexp_extract_all(text, '(^|[^\\p{L}\\p{N}_])\\d+')) > 0 AS has_number, length(text) AS chars FROM documents")
def text_numbers(spark, d):
    """Which documents state a number."""
    t = tk.load(spark, d, "documents")
    return t.select("doc_id", (F.size(text.text_numbers(F.col("text"))) > 0).alias("has_number"), F.length("text").cast("long").alias("chars"))


@query("number_support")
def number_support(spark, d):
    """Numbers of generated messages checked against the board text of their box."""
    boards = materialize(board_text(spark, d))
    msg = F.concat(F.lit("Only "), F.regexp_extract("board", r"resolved so far: (\d+)", 1), F.lit(" of "), F.regexp_extract("board", r"of (\d+)\. Committed", 1),
                   F.lit(" issues are done, about "), F.pmod(F.xxhash64("sprint_id"), F.lit(40)).cast("string"), F.lit("% of the points and 97 more."))
    checked = text.number_support(boards.withColumn("message", msg), "message", "board")
    return checked.select("sprint_id", F.col("n_numbers").cast("long"), F.col("n_unsupported").cast("long"), "unsupported", "all_supported")


@query("support_summary")
def support_summary(spark, d):
    c = number_support(spark, d).withColumn("arm", F.when(F.pmod(F.xxhash64("sprint_id"), F.lit(2)) == 0, "G").otherwise("L"))
    return text.support_summary(c, "arm")
