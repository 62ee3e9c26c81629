"""Queries that write the derived tables with a sink and read them back with a reader, and small learners written out in SQL."""

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.models.advisor import bounded_quantiles
from tidemark.models.learners import Learner, as_double, exact_medians, fit_regressor, preprocessor
from tidemark.models.many import fit_many
from tidemark.operators import checkpoints as cp
from tidemark.operators import history, metrics, ranking, rules, scope, splits, summaries
from tidemark.plans import tracker as tk
from tidemark.plans.oracle import auc, mid_rank, with_
from tidemark.plans.registry import query, tidy
from tidemark.plans.state_queries import tables
from tidemark.session import materialize, shared_folder
from tidemark.sources import nested, sinks
from tidemark.sources import tables as src


def exported(spark, df, columns, kind, sep):
    """Folder with ``df`` as delimited text under the export's column names; null is written as NULL."""
    path = shared_folder(spark, kind)
    names = {v: k for k, v in columns.items() if v in df.columns}
    out = df.select(*[F.col(c).alias(n) for c, n in names.items()])
    out.write.option("header", True).option("sep", sep).option("nullValue", "NULL").option("quote", '"').option("escape", '"').csv(path)
    return path


# ------------------------------------------------------------------ readers
@query("read_sprints", with_("box") + "SELECT sprint_id, raw_sprint_id, jira AS jira_sprint_id, 'Box '||k AS sprint_name, sprint_state, project, start_date, end_date, complete_date FROM box")
def read_sprints(spark, d):
    """All boxes through a tab-separated export."""
    path = exported(spark, tk.boxes(spark, d), src.SPRINT_COLUMNS, "sprints", "\t")
    s = src.load_sprints(spark, path, modeling_only=False)
    return s.select("sprint_id", "raw_sprint_id", "jira_sprint_id", "sprint_name", "sprint_state", "project", "start_date", "end_date", "complete_date")


@query("read_closed_sprints", with_("sp") + "SELECT sprint_id, raw_sprint_id, sprint_state, complete_date, CAST(NULL AS TIMESTAMP) AS activated_date FROM sp")
def read_closed_sprints(spark, d):
    """Closed boxes with usable dates, through a comma-separated export without one of the columns."""
    return src.load_sprints(spark, exported(spark, tk.boxes(spark, d), src.SPRINT_COLUMNS, "sprints", ",")).select(
        "sprint_id", "raw_sprint_id", "sprint_state", "complete_date", "activated_date")


@query("read_issues", with_("item") + "SELECT CAST(ok*7+ln AS BIGINT) AS raw_issue_id, issue_key, issue_type, status, CAST(points AS DOUBLE) AS story_point, created AS creation_date, resolved AS resolution_date, raw AS raw_sprint_id, project, assignee FROM item")
def read_issues(spark, d):
    i = tk.items(spark, d).withColumn("raw_issue_id", F.col("box") * 7 + F.col("line"))
    back = src.load_issues(spark, exported(spark, i, src.ISSUE_COLUMNS, "issues", ","))
    return back.select("raw_issue_id", "issue_key", "issue_type", "status", "story_point", "creation_date", "resolution_date", "raw_sprint_id", "project", "assignee")


_CHANGES = """SELECT cid::BIGINT AS change_id, CAST(ok*7+ln AS BIGINT) AS raw_issue_id, field, fv AS from_value, tv AS to_value, fs AS from_string, ts_ AS to_string, ts AS change_date FROM (
SELECT ok, ln, 1 AS cid, 'Sprint' AS field, NULL AS fv, (ok+500000)::VARCHAR AS tv, NULL AS fs, NULL AS ts_, bs + to_days(CAST(part%7-4 AS INTEGER)) + to_hours(ln) AS ts FROM item WHERE ln IN (1,4)
UNION ALL SELECT ok, ln, 2, 'Sprint', (ok+500000)::VARCHAR, (ok+500000)||', '||(ok+500008), NULL, NULL, bs + to_days(CAST(supp%10 AS INTEGER)) + to_hours(2) FROM item WHERE ln IN (4,5)
UNION ALL SELECT ok, ln, 3, 'Story Points', (qty-1)::VARCHAR, (qty+part%2)::VARCHAR, NULL, NULL, bs + to_days(CAST(part%11-3 AS INTEGER)) FROM item WHERE ln=2
UNION ALL SELECT ok, ln, 4, 'Story point estimate', NULL, NULL, 'about '||(qty+2)||' points', 'unknown', bs + to_days(CAST(part%5 AS INTEGER)) FROM item WHERE ln=3
UNION ALL SELECT ok, ln, 5, 'sprint', (ok+500000)||', '||(ok+500008), NULL, NULL, CASE WHEN part%2=0 THEN 'Box '||(ok+8) ELSE 'moved to Box '||ok END, bs + to_days(CAST(supp%10 AS INTEGER)) + to_hours(30) FROM item WHERE ln=5
UNION ALL SELECT ok, ln, 6, 'status', 'open', 'done', NULL, NULL, bs FROM item WHERE ln=1)"""


@query("read_changes", with_("item") + _CHANGES)
def read_changes(spark, d):
    i = tk.items(spark, d).withColumn("raw_issue_id", F.col("box") * 7 + F.col("line"))
    back = src.load_change_log(spark, exported(spark, tk.changes(i), src.CHANGE_COLUMNS, "changes", ","), required=True)
    return back.select("change_id", "raw_issue_id", "field", "from_value", "to_value", "from_string", "to_string", "change_date")


@query("answer_audit", with_("lab") + """, b AS (SELECT project||'_'||r AS transcript, sprint_id, k, r FROM lab, range(1,4) t(r)),
g AS (SELECT transcript, any_value(r) AS r, bool_and(r<>2 OR k%5<>0) AS whole FROM b GROUP BY 1)
SELECT transcript, CASE WHEN r=3 THEN 2 ELSE 1 END::BIGINT AS tool_calls, r<>3 AS only_read_own_prompt, whole AS answers_complete, 'model-'||r AS models FROM g""")
def answer_audit(spark, d):
    """Transcripts of three runs per project: the second leaves out every fifth box, the third reads another prompt too."""
    b = tk.labelled(spark, d).select("project", "sprint_id", "raw_sprint_id").withColumn("r", F.explode(F.array(*[F.lit(r) for r in (1, 2, 3)])))
    b = materialize(b.withColumn("transcript", F.concat_ws("_", "project", F.col("r").cast("string"))))
    none = F.lit(None).cast("map<string,string>")
    call = lambda name, inp: F.struct(F.lit("tool_use").alias("type"), F.lit(name).alias("name"), inp.alias("input"))
    path = F.concat(F.lit("/prompts/"), F.col("transcript"))
    read = call("Read", F.create_map(F.lit("file_path"), path))
    other = call("Read", F.create_map(F.lit("file_path"), F.lit("/elsewhere")))
    runs = b.select("transcript", "r").distinct()
    model = F.concat(F.lit("model-"), F.col("r").cast("string")).alias("model")
    reads = runs.select("transcript", model, F.when(F.col("r") == 3, F.array(read, other)).otherwise(F.array(read)).alias("content"))
    # An answer record per box, so that no cell grows with the project.
    line = F.to_json(F.struct(F.col("sprint_id").alias("id"), F.lit(True).alias("warn")))
    answers = b.where((F.col("r") != 2) | (F.col("raw_sprint_id") % 5 != 0)).select("transcript", model, F.array(call("Answer", F.create_map(F.lit("message"), line))).alias("content"))
    text = runs.select("transcript", model, F.array(F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("name"), none.alias("input"))).alias("content"))
    expected = b.groupBy("transcript").agg(F.collect_list("sprint_id").alias("boards")).withColumn("file_path", path)
    out = nested.audit_answers(reads.unionByName(answers).unionByName(text), expected, "Answer")
    return out.select("transcript", F.col("tool_calls").cast("long"), "only_read_own_prompt", "answers_complete", F.array_join("models", ",").alias("models"))


# ------------------------------------------------------------------ sinks
@query("frame_round_trip", with_("lab") + "SELECT sprint_id, project, start_date, end_date, complete_date, committed AS committed_issue_count, round(late_days,6) AS late_days, round(completion_ratio,6) AS completion_ratio, label_delay::BIGINT AS label_delay FROM lab")
def frame_round_trip(spark, d):
    """The labelled frame written as CSV and read with its types."""
    cols = ["sprint_id", "project", "start_date", "end_date", "complete_date", "committed_issue_count", "late_days", "completion_ratio", "label_delay"]
    f = tk.labelled(spark, d).select(*cols)
    path = shared_folder(spark, "frame")
    sinks.write_rows(f, path, digits=None)
    return tidy(sinks.read_rows(spark, path, f.schema))


@query("result_sinks", with_("lab") + "SELECT 'json' AS fmt, project, count(*) AS sprints, round(avg(late_days),4) AS mean_late_days FROM lab GROUP BY 2 UNION ALL SELECT 'csv', project, count(*), round(avg(late_days),4) FROM lab GROUP BY 2")
def result_sinks(spark, d):
    """A result table as JSON lines and as sorted CSV, rounded to four digits."""
    r = materialize(tk.labelled(spark, d).groupBy("project").agg(F.count(F.lit(1)).alias("sprints"), F.avg("late_days").alias("mean_late_days")))
    out = None
    for fmt in ("json", "csv"):
        path = shared_folder(spark, "result")
        sinks.write_rows(r, path, fmt, order=["project"])
        part = sinks.read_rows(spark, path, r.schema, fmt).select(F.lit(fmt).alias("fmt"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("run_log", with_("scored") + """, m AS (SELECT project, count(*) AS n, coalesce(count(*) FILTER (y=1 AND pred=1)/nullif(count(*) FILTER (pred=1),0)::DOUBLE,0) AS precision, coalesce(count(*) FILTER (y=1 AND pred=1)/nullif(count(*) FILTER (y=1),0)::DOUBLE,0) AS recall FROM scored GROUP BY 1)
SELECT day AS run_date, CAST(sum(n) AS BIGINT) AS n, count(*) AS folds, round(avg(precision),4) AS precision, round(avg(recall),4) AS recall FROM m, (VALUES ('2026-01-01'),('2026-01-02')) v(day) GROUP BY 1""")
def run_log(spark, d):
    """Group-wise metrics logged on two days, the first batch twice: a repeated append leaves one copy."""
    m = metrics.confusion_metrics(tk.scored(spark, d), ["project"], "label_delay", "pred")
    m = materialize(m.select(F.lit("label_delay").alias("label"), F.lit("group out").alias("validation_scheme"), F.lit("rule").alias("model"), "n", "precision", "recall", "f1",
                             F.lit(None).cast("double").alias("roc_auc"), F.lit(None).cast("double").alias("pr_auc")))
    path = shared_folder(spark, "log")
    for day in ("2026-01-01", "2026-01-02", "2026-01-01"):
        sinks.append_run_log(m, path, day, "derived")
    return spark.read.parquet(path).select(F.col("run_date").cast("string").alias("run_date"), "n", "folds", "precision", "recall")


_FILES = """, l AS (SELECT project, string_agg(iid, chr(10) ORDER BY iid) || chr(10) AS t, count(*) AS lines FROM item GROUP BY 1)
"""


def issue_files(spark, d):
    """One file of sorted issue ids per project."""
    i = tk.items(spark, d).select("project", F.col("raw_issue_id").alias("value"))
    path = shared_folder(spark, "files")
    i.repartition("project").sortWithinPartitions("project", "value").write.partitionBy("project").text(path)
    return path


def _project():
    return F.regexp_extract("file", "project=([^/]+)/", 1).alias("project")


@query("file_fingerprints", with_("item") + _FILES + "SELECT project, sha256(t) AS sha256, strlen(t) AS bytes, lines FROM l")
def file_fingerprints(spark, d):
    return sinks.fingerprints(spark, issue_files(spark, d)).select(_project(), "sha256", "bytes", "lines")


@query("block_fingerprints", with_("item") + _FILES + """, b AS (SELECT project, p, sha256(substr(t, p+1, 65536)) AS h FROM (SELECT project, t, unnest(range(0, strlen(t), 65536)) AS p FROM l))
SELECT project, sha256(string_agg(h, '' ORDER BY p)) AS root, any_value(bytes) AS bytes, any_value(lines) AS lines FROM b JOIN (SELECT project, strlen(t) AS bytes, lines FROM l) USING (project) GROUP BY 1""")
def block_fingerprints(spark, d):
    """The same files in blocks of 64 KB."""
    return sinks.block_fingerprints(spark, issue_files(spark, d), 65536).select(_project(), "root", "bytes", "lines")


# ------------------------------------------------------------------ descriptions
def _flag(t, name):
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY start_date, sprint_id)<=greatest(1,floor(count(*) OVER (PARTITION BY project)*0.7::DOUBLE)) AS tr FROM {t})"


def _checkpoint_frame(spark, d):
    f = materialize(tk.labelled(spark, d).where(F.col("sprint_state") == "CLOSED"))
    state = cp.progress_features(cp.checkpoint_state(*tables(spark, d)))
    out = state.select("sprint_id", "checkpoint", "open_at_checkpoint", "remaining_n", "done_share").join(
        f.select("sprint_id", "project", "committed_issue_count", "label_delay", "label_spillover"), "sprint_id")
    out = splits.carry_side(out, splits.split_time(f), "side_full")
    return splits.carry_side(out, splits.split_time(f.where("nonempty")), "side_nonempty")


_CKF = with_("ckpt", "lab") + f""", cl AS (SELECT * FROM lab WHERE sprint_state='CLOSED'), {_flag('cl', 'sf')}, {_flag('(SELECT * FROM cl WHERE nonempty)', 'sn')},
cf AS (SELECT c.sprint_id, c.checkpoint, c.complete_date>c.checkpoint_time AS open, c.committed_n-c.done_n AS remaining_n, CASE WHEN c.committed_n>0 THEN c.done_n/c.committed_n::DOUBLE ELSE 0.0 END AS done_share, sf.committed, sf.label_delay, sf.label_spillover, sf.tr AS tr_full, sn.tr AS tr_ne
 FROM ckpt c JOIN sf USING (sprint_id) LEFT JOIN sn USING (sprint_id))
"""


@query("open_count_rules", _CKF + f""", lg AS (SELECT 'spillover' AS outcome, checkpoint, unnest(['remaining_n','committed_issue_count']) AS rule, unnest([remaining_n, committed]) AS score, label_spillover AS y FROM cf WHERE open AND NOT tr_ne
 UNION ALL SELECT 'late', checkpoint, unnest(['remaining_n','committed_issue_count']), unnest([remaining_n, committed]), label_delay FROM cf WHERE open AND NOT tr_full)
SELECT outcome, checkpoint, rule, count(*) AS n, count(*) FILTER (y=0) AS n_neg, round({auc('y','score')},6) AS auc FROM (SELECT *, {mid_rank('score','outcome, checkpoint, rule')} AS rk FROM lg) GROUP BY 1,2,3""")
def open_count_rules(spark, d):
    """Open and committed counts against both outcomes at every checkpoint, without a model."""
    return tidy(summaries.open_count_rules(_checkpoint_frame(spark, d), {"spillover": ("label_spillover", "side_nonempty"), "late": ("label_delay", "side_full")}, ["remaining_n", "committed_issue_count"]))


@query("rule_remaining", _CKF + "SELECT sprint_id, checkpoint, remaining_n::DOUBLE AS rule_remaining, round(1-done_share,6) AS rule_remaining_share, committed::DOUBLE AS rule_committed FROM cf WHERE NOT tr_full")
def rule_remaining(spark, d):
    """In-sprint rules of the test side."""
    f = _checkpoint_frame(spark, d).withColumns({"side": F.col("side_full"), "hist_late_rate_3": F.lit(None).cast("double"), "hist_avg_completion_ratio_3": F.lit(None).cast("double")})
    out = rules.rule_scores_by(f, ["checkpoint"], late=True).where("side = 'test'")
    return tidy(out.select("sprint_id", "checkpoint", "rule_remaining", "rule_remaining_share", "rule_committed"))


@query("source_audit", with_("lab") + """SELECT 'tracker' AS source, count(*) AS sprints, count(*) FILTER (nonempty) AS nonempty, count(*) FILTER (committed=0) AS zero_scope, count(DISTINCT project) AS projects, round(avg(label_delay),6) AS late_rate,
 round(avg(label_spillover) FILTER (nonempty),6) AS spillover_rate, min(start_date) AS first_start, max(start_date) AS last_start, CAST(median(committed) FILTER (nonempty) AS DOUBLE) AS median_scope, any_value(a.sprints) AS audit_sprints_reconstructed, any_value(a.members) AS audit_issue_sprint_memberships_at_start
FROM lab, (""" + with_("commit0") + "SELECT (SELECT count(*) FROM sp) AS sprints, (SELECT count(*) FROM commit0) AS members) a")
def source_audit(spark, d):
    """One source's cohort with counters of its scope audit."""
    audit = scope.scope_audit(*tables(spark, d)).select("sprints_reconstructed", "issue_sprint_memberships_at_start")
    return tidy(summaries.audited_description("tracker", tk.labelled(spark, d), audit))


_KNOWN = {"committed_issue_count": "committed", "committed_story_points": "points", "sprint_length_days": "len", "n_concurrent_sprints": "n_conc", "hist_avg_completion_ratio_3": "h_ratio", "hist_last_carryover": "h_carry",
          "hist_avg_delivered_sp_3": "h_sp", "hist_n_available": "h_n", "hist_avg_completed_issues_3": "h_done", "hist_avg_committed_issues_3": "h_comm", "scope_to_capacity": "s2c", "hist_avg_late_days_3": "h_late", "hist_late_rate_3": "h_rate",
          "prior_avg_delivered_sp_3": "t_sp", "prior_avg_completion_ratio_3": "t_ratio", "prior_sprint_carryover": "t_carry", "prior_sprint_completion_ratio": "t_last", "project": "project"}


@query("feature_coverage", with_("hist", "trail") + ", f AS (SELECT h.*, t_sp, t_ratio, t_carry, t_last FROM hist h JOIN trail t USING (sprint_id))\n" + " UNION ALL ".join(
    f"SELECT '{s}' AS feature_set, '{g}' AS feature_group, CAST({len(c)} AS BIGINT) AS features, round(({'+'.join(f'count({_KNOWN[x]})' for x in c)})/(count(*)*{len(c)})::DOUBLE,6) AS share_known FROM f" for s, gs in history.GROUPS_BY_SET.items() for g, c in gs.items()))
def feature_coverage(spark, d):
    """Known cells by feature set and group."""
    return tidy(summaries.feature_coverage(tk.modelling_frame(spark, d), history.GROUPS_BY_SET))


@query("groups_below_chance", with_("scored") + f"SELECT count(*) FILTER (v<0.5) AS below, count(*) AS groups FROM (SELECT project, {auc('y','score')} AS v, count(*) FILTER (y=1) AS p, count(*) FILTER (y=0) AS q FROM (SELECT *, {mid_rank('score','project')} AS rk FROM scored) GROUP BY 1) WHERE p>=5 AND q>=5")
def groups_below_chance(spark, d):
    m = metrics.interpretable(ranking.roc_auc(tk.scored(spark, d), ["project"], "score", "label_delay"))
    return summaries.groups_below(m)


@query("bounded_forecasts", with_("scored") + "SELECT sprint_id, committed::DOUBLE AS upper, unnest([1,2,3])::BIGINT AS place, round(greatest(least(list_sort([score*20-2, score_b*20-2, committed/2.0::DOUBLE])[unnest([1,2,3])], committed::DOUBLE), 0.0),6) AS value FROM scored")
def bounded_forecasts(spark, d):
    """Three crossing forecasts per box, sorted and kept between 0 and its scope."""
    s = tk.scored(spark, d)
    q = bounded_quantiles(F.array(F.col("score") * 20 - 2, F.col("score_b") * 20 - 2, F.col("committed_issue_count") / 2.0), F.col("committed_issue_count"))
    return tidy(s.select("sprint_id", F.col("committed_issue_count").cast("double").alias("upper"), F.posexplode(q).alias("p_", "value")).select("sprint_id", "upper", (F.col("p_") + 1).alias("place"), "value"))


# ------------------------------------------------------------------ learners in SQL
_PAIR = ["hist_late_rate_3", "sprint_length_days"]
_TRAIN = with_("hist") + f""", {_flag('hist', 'tt')}, tr AS (SELECT *, label_delay::DOUBLE AS y FROM tt WHERE tr),
md AS (SELECT median(h_rate) AS m1, median(len) AS m2 FROM tr),
st AS (SELECT avg(coalesce(h_rate,m1)) AS a1, stddev_samp(coalesce(h_rate,m1)) AS s1, avg(coalesce(len,m2)) AS a2, stddev_samp(coalesce(len,m2)) AS s2, any_value(m1) AS m1, any_value(m2) AS m2 FROM tr, md)
"""


def _sides(spark, d):
    f = materialize(splits.split_time(history.add_strict_history(tk.labelled(spark, d))))
    return f.where("side = 'train'"), f.where("side = 'test'")


@query("preprocessed", _TRAIN + "SELECT sprint_id, round((coalesce(h_rate,m1)-a1)/s1,6) AS z_late_rate, round((coalesce(len,m2)-a2)/s2,6) AS z_length, CAST(1 AS BIGINT) AS group_marks FROM tt, st WHERE NOT tr")
def preprocessed(spark, d):
    """Test rows after the shared preprocessing: imputed and standardised by the training rows, one mark per known group."""
    tr, te = _sides(spark, d)
    tr, te = as_double(tr, _PAIR), as_double(te, _PAIR)
    model = Pipeline(stages=preprocessor(_PAIR, "project", exact_medians(tr, _PAIR))).fit(tr)
    z = vector_to_array("scaled_vec")
    marks = F.aggregate(vector_to_array("group_vec"), F.lit(0.0), lambda a, x: a + x).cast("long")
    return tidy(model.transform(te).select("sprint_id", z[0].alias("z_late_rate"), z[1].alias("z_length"), marks.alias("group_marks")))


def _newton(steps=9):
    """Newton steps of a balanced logistic regression on two standardised columns, written out."""
    out = ["z AS MATERIALIZED (SELECT y, (coalesce(h_rate,m1)-a1)/s1 AS u, (coalesce(len,m2)-a2)/s2 AS v, CASE WHEN y=1 THEN n/(2.0::DOUBLE*p) ELSE n/(2.0::DOUBLE*(n-p)) END AS w FROM tr, st, (SELECT count(*)::DOUBLE AS n, sum(y) AS p FROM tr))",
           "k0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2)"]
    for k in range(steps):
        out += [f"""g{k} AS (SELECT any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, sum(w*(q-y)) AS g0, sum(w*(q-y)*u)+any_value(b1) AS g1, sum(w*(q-y)*v)+any_value(b2) AS g2,
 sum(w*q*(1-q)) AS a, sum(w*q*(1-q)*u) AS b, sum(w*q*(1-q)*v) AS c, sum(w*q*(1-q)*u*u)+1 AS d, sum(w*q*(1-q)*u*v) AS e, sum(w*q*(1-q)*v*v)+1 AS f FROM (SELECT *, 1/(1+exp(-(b0+b1*u+b2*v))) AS q FROM z, k{k}))""",
                f"h{k} AS (SELECT *, a*(d*f-e*e)-b*(b*f-c*e)+c*(b*e-c*d) AS det FROM g{k})",
                f"k{k + 1} AS (SELECT b0-(g0*(d*f-e*e)-g1*(b*f-c*e)+g2*(b*e-c*d))/det AS b0, b1-(-g0*(b*f-c*e)+g1*(a*f-c*c)-g2*(a*e-b*c))/det AS b1, b2-(g0*(b*e-c*d)-g1*(a*e-b*c)+g2*(a*d-b*b))/det AS b2 FROM h{k})"]
    return ", " + ",\n".join(out) + "\n"


@query("logistic_coefficients", _TRAIN + _newton() + "SELECT 'intercept' AS term, round(b0,6) AS value FROM k9 UNION ALL SELECT 'hist_late_rate_3', round(b1,6) FROM k9 UNION ALL SELECT 'sprint_length_days', round(b2,6) FROM k9")
def logistic_coefficients(spark, d):
    """Balanced logistic regression on two columns: standardised coefficients."""
    tr, _ = _sides(spark, d)
    b, c = fit_many(tr.withColumn("train_in", F.array(F.lit(0))), [_PAIR], "label_delay").coefficients(0)
    return tidy(spark.createDataFrame([("intercept", b), *c.items()], "term string, value double"))


@query("logistic_scores", _TRAIN + _newton() + f""", e AS (SELECT sprint_id, project, label_delay AS y, 1/(1+exp(-(b0+b1*(coalesce(h_rate,m1)-a1)/s1+b2*(coalesce(len,m2)-a2)/s2))) AS score FROM tt, st, k9 WHERE NOT tr)
SELECT sprint_id, project, round(score,6) AS score FROM e""")
def logistic_scores(spark, d):
    """Test rows scored by the same regression."""
    from tidemark.models.many import split_scores

    return tidy(split_scores({"pair": _PAIR}, *_sides(spark, d), "label_delay"), "sprint_id", "project", "score")


@query("transfer_two_columns", with_("hist") + """, tr AS (SELECT *, label_delay::DOUBLE AS y FROM hist WHERE project<='P3'), md AS (SELECT median(h_rate) AS m1, median(len) AS m2 FROM tr),
st AS (SELECT avg(coalesce(h_rate,m1)) AS a1, stddev_samp(coalesce(h_rate,m1)) AS s1, avg(coalesce(len,m2)) AS a2, stddev_samp(coalesce(len,m2)) AS s2, any_value(m1) AS m1, any_value(m2) AS m2 FROM tr, md)
""" + _newton() + f""", e AS (SELECT project, label_delay AS y, round(1/(1+exp(-(b0+b1*(coalesce(h_rate,m1)-a1)/s1+b2*(coalesce(len,m2)-a2)/s2))),9) AS score FROM hist, st, k9 WHERE project>'P3')
SELECT project, count(*) FILTER (y=1) AS n_pos, count(*) FILTER (y=0) AS n_neg, round({auc('y','score')},6) AS auc FROM (SELECT *, {mid_rank('score','project')} AS rk FROM e) GROUP BY 1""")
def transfer_two_columns(spark, d):
    """A regression fitted on half of the projects scores the others: AUC by project."""
    from tidemark.models.many import split_scores

    f = materialize(history.add_strict_history(tk.labelled(spark, d)))
    s = split_scores({"pair": _PAIR}, f.where(F.col("project") <= "P3"), f.where(F.col("project") > "P3"), "label_delay")
    return tidy(ranking.roc_auc(s.withColumn("score", F.round("score", 9)), ["project"], "score", "label_delay"))


@query("ridge_forecast", _TRAIN + """, z AS (SELECT late_capped AS t, (coalesce(h_rate,m1)-a1)/s1 AS u, (coalesce(len,m2)-a2)/s2 AS v FROM tr, st),
n AS (SELECT sum(u*u)+1 AS a, sum(u*v) AS b, sum(v*v)+1 AS d, sum(u*(t-m)) AS p, sum(v*(t-m)) AS q, any_value(m) AS m FROM z, (SELECT avg(t) AS m FROM z)),
k AS (SELECT m, (p*d-q*b)/(a*d-b*b) AS b1, (q*a-p*b)/(a*d-b*b) AS b2 FROM n)
SELECT sprint_id, round(m+b1*(coalesce(h_rate,m1)-a1)/s1+b2*(coalesce(len,m2)-a2)/s2,4) AS forecast FROM tt, st, k WHERE NOT tr""")
def ridge_forecast(spark, d):
    """Ridge forecast of late days from two columns, on the test rows."""
    from tidemark.models.learners import score

    tr, te = _sides(spark, d)
    m = fit_regressor(Learner("ridge", _PAIR, None, settings={"solver": "normal"}), tr, "late_days_capped")
    return tidy(score(m, te, _PAIR, "forecast", is_probability=False).select("sprint_id", "forecast"), digits=4)


@query("linear_attribution", _TRAIN + _newton() + """, b AS (SELECT avg(coalesce(h_rate,m1)) AS c1, avg(coalesce(len,m2)) AS c2 FROM tr, st)
SELECT sprint_id, 'lateness' AS "group", round(b1/s1*(coalesce(h_rate,m1)-c1),6) AS phi FROM tt, st, k9, b WHERE NOT tr UNION ALL SELECT sprint_id, 'length', round(b2/s2*(coalesce(len,m2)-c2),6) FROM tt, st, k9, b WHERE NOT tr""")
def linear_attribution(spark, d):
    """Shapley values of the regression's log-odds over two feature groups, against all training rows."""
    from tidemark.models.explain import linear_shapley

    tr, te = _sides(spark, d)
    m = fit_many(tr.withColumn("train_in", F.array(F.lit(0))), [_PAIR], "label_delay")
    fill = dict(zip(_PAIR, m.state.fill[0].tolist()))
    slope = {c: m.state.beta[0, 1 + k] * m.state.scale[0, k] for k, c in enumerate(_PAIR)}
    full = lambda df: df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(fill[c])) for c in _PAIR})
    return tidy(linear_shapley(full(te), full(tr), slope, {"lateness": _PAIR[:1], "length": _PAIR[1:]}))


@query("second_source", with_("item", "sp") + """, c AS (SELECT sp.project, sp.sprint_id, count(ok) AS n, count(*) FILTER (coalesce(resolved<=end_date,FALSE)) AS done FROM sp LEFT JOIN item ON item.raw=sp.k AND item.project=sp.project GROUP BY 1,2)
SELECT project, count(*) AS sprints, count(*) FILTER (n>0) AS nonempty, CAST(sum(n) AS BIGINT) AS items, round(sum(done)/sum(n)::DOUBLE,6) AS share_done FROM c GROUP BY 1""")
def second_source(spark, d):
    """The cohort by project of a source that comes as export files: both tables are read from them."""
    i = tk.items(spark, d).withColumn("raw_issue_id", F.col("box") * 7 + F.col("line"))
    s = src.load_sprints(spark, exported(spark, tk.boxes(spark, d), src.SPRINT_COLUMNS, "sprints", "\t"))
    f = scope.static_scope(s, src.load_issues(spark, exported(spark, i, src.ISSUE_COLUMNS, "issues", ",")))
    n = F.col("committed_issue_count")
    return tidy(f.groupBy("project").agg(F.count(F.lit(1)).alias("sprints"), F.count_if(n > 0).alias("nonempty"), F.sum(n).alias("items"), (F.sum("completed_issue_count") / F.sum(n)).alias("share_done")))
