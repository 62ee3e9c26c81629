"""Queries that fit models. Their results depend on the learner, so they carry no SQL; tests check invariants."""

from dataclasses import dataclass

from pyspark.sql import functions as F

from tidemark.models import explain
from tidemark.models.advisor import QuantileForest, bounded_quantiles, what_if
from tidemark.models.learners import Learner, bounded_share, cross_validated_calls, fit_and_score, fit_classifier, fit_regressor, fit_with_threshold, out_of_fold, prepare, score
from tidemark.operators import checkpoints as cp
from tidemark.operators import history, metrics, ranking, resample, splits
from tidemark.plans import jobs
from tidemark.plans import tracker as tk
from tidemark.plans.registry import query, tidy
from tidemark.plans.state_queries import tables
from tidemark.session import materialize

NUMERIC = history.PLANNING_FEATURES + ["hist_late_rate_3", "hist_n_available", "scope_to_capacity"]


@dataclass(frozen=True)
class Wanted:
    """A folder, and how ``frame`` shall make its table from it."""

    d: str
    in_order: bool = False  # for trees: their bags and candidate splits are drawn by the layout of the rows


def frame(spark, d):
    w = d if isinstance(d, Wanted) else Wanted(d)
    rows = history.add_strict_history(tk.labelled(spark, w.d))
    return materialize(splits.split_time(rows, in_order=True)) if w.in_order else splits.split_time(rows)  # reads a table and a row per project


def frame_in_order(spark, d):
    return frame(spark, Wanted(d, in_order=True))


def slim_frame(spark, d, label="label_delay"):
    """Only what a fit of NUMERIC on this label reads; the rows of folds and splits carry no more."""
    return frame(spark, d).select("sprint_id", "project", "side", label, *NUMERIC)


def auc_of(scored, name, label="label_delay"):
    return ranking.roc_auc(scored, [], "score", label).withColumn("model", F.lit(name))


@query("fit_logreg")
def fit_logreg(spark, d):
    tr, te = jobs.sides(frame(spark, d))
    return auc_of(fit_and_score(Learner("logistic", NUMERIC), tr, te, "label_delay"), "logistic")


@query("fit_forest")
def fit_forest(spark, d):
    tr, te = jobs.sides(frame_in_order(spark, d))
    return auc_of(fit_and_score(Learner("forest", NUMERIC), tr, te, "label_delay"), "forest")


@query("fit_gbt")
def fit_gbt(spark, d):
    tr, te = jobs.sides(frame_in_order(spark, d))
    return auc_of(fit_and_score(Learner("boosted", NUMERIC), tr, te, "label_delay"), "boosted")


@query("fit_regressors")
def fit_regressors(spark, d):
    tr, te = jobs.sides(frame_in_order(spark, d))
    rows, pre = [], prepare(Learner("ridge", NUMERIC), tr)  # the same for all kinds
    for kind in ("ridge", "forest", "boosted", "boosted_median"):
        m = fit_regressor(Learner(kind, NUMERIC), tr, "late_days_capped", pre=pre)
        out = score(m, te, NUMERIC, "forecast", is_probability=False)
        rows.append(metrics.regression_metrics(out, [], "late_days_capped", "forecast").withColumn("model", F.lit(kind)))
    return jobs.union(rows)


@query("quantile_forest")
def quantile_forest(spark, d):
    tr, te = jobs.sides(frame_in_order(spark, d))
    ne = F.col("committed_issue_count") > 0
    q = QuantileForest(NUMERIC).fit(tr.where(ne), "completed_issue_count").forecast(te.where(ne), (0.1, 0.5, 0.9))
    b = bounded_quantiles(F.col("quantiles"), F.col("committed_issue_count"))
    q = q.withColumns({"q10": b[0], "q50": b[1], "q90": b[2]})
    return tidy(metrics.interval_quality(q, "completed_issue_count", "q10", "q50", "q90", "committed_issue_count", ["project"]))


@query("what_if")
def what_if_grid(spark, d):
    tr, te = jobs.sides(frame_in_order(spark, d))
    ne = F.col("committed_issue_count") > 0
    done = QuantileForest(NUMERIC).fit(tr.where(ne), "completed_issue_count")
    late = QuantileForest(NUMERIC).fit(tr, "late_days_capped")
    return what_if(te, [2, 4, 8, 16], done, late)


@query("group_shapley")
def group_shapley(spark, d):
    """Attribution of the late-closure score over four feature groups for sampled test boxes."""
    tr, te = jobs.sides(frame(spark, d))
    groups = {"scope": history.PLANNING_FEATURES, "lateness": ["hist_late_rate_3"], "history": ["hist_n_available"], "capacity": ["scope_to_capacity"]}
    m = fit_classifier(Learner("logistic", NUMERIC, None), tr, "label_delay")
    explained = splits.stratified_draw(te, ["project"], 10).drop("weight")
    background = splits.stratified_draw(tr, ["project"], 4, seed=1).drop("weight")
    return explain.group_importance(explain.group_shapley(m, explained, background, groups, NUMERIC))


@query("permutation_importance")
def permutation_importance(spark, d):
    tr, te = jobs.sides(frame(spark, d))
    return explain.permutation_importance(fit_classifier(Learner("logistic", NUMERIC, None), tr, "label_delay"), te, NUMERIC, "label_delay")


@query("oof_scores")
def oof_scores(spark, d):
    tr, _ = jobs.sides(slim_frame(spark, d))
    o = out_of_fold(Learner("logistic", NUMERIC), tr, "label_delay")
    return tidy(o, "sprint_id", "fold", "score")


@query("threshold_calls")
def threshold_calls(spark, d):
    tr, te = jobs.sides(slim_frame(spark, d))
    out = fit_with_threshold(Learner("logistic", NUMERIC), tr, te, "label_delay")
    return metrics.confusion_metrics(out, ["project"], "label_delay", "pred")


@query("cross_validated_calls")
def cross_validated(spark, d):
    out = cross_validated_calls(Learner("logistic", NUMERIC), slim_frame(spark, d), "label_delay")
    return metrics.confusion_metrics(out, [], "label_delay", "pred")


@query("group_out")
def group_out(spark, d):
    return jobs.group_out(frame(spark, d), "label_delay", Learner("logistic", NUMERIC, None))


@query("ablation")
def ablation(spark, d):
    f = splits.split_time(tk.modelling_frame(spark, d).where("has_prior_sprint"))
    sets = {k: history.FEATURE_SETS[k] for k in ("scope_only", "legacy", "legacy_plus_late", "strict_timed", "strict_timed_plus_late")}
    return explain.ablation(*jobs.sides(f), "label_delay", sets, reference="scope_only")


@query("transfer")
def transfer(spark, d):
    f = frame(spark, d)
    a, b = f.where(F.col("project") <= "P3"), f.where(F.col("project") > "P3")
    return jobs.transfer(a, b, "label_delay", NUMERIC, "logistic")


@query("leak_demo")
def leak_demo(spark, d):
    return jobs.leak_demo(*jobs.sides(frame(spark, d)), "label_spillover", NUMERIC, "completion_ratio")


@query("time_valid_refit")
def time_valid_refit(spark, d):
    s = jobs.time_valid_refit(frame(spark, d), "label_delay", Learner("logistic", NUMERIC))
    return ranking.roc_auc(s, ["quarter"], "score", "label_delay")


@query("seed_variance")
def seed_variance(spark, d):
    return jobs.seed_variance(*jobs.sides(frame_in_order(spark, d)), "label_delay", Learner("forest", NUMERIC), range(10))


@query("bounded_share")
def bounded(spark, d):
    tr, te = jobs.sides(frame_in_order(spark, d))
    out = bounded_share(tr, te.where("nonempty"), NUMERIC, broken=["P3"])
    return tidy(metrics.regression_metrics(out, ["project"], "carry_ratio", "share"))


@query("model_vs_rules")
def model_vs_rules(spark, d):
    learners = {"logistic": Learner("logistic", NUMERIC), "scope only": Learner("logistic", history.PLANNING_FEATURES, None)}
    return jobs.compare_on_split(frame(spark, d), "label_delay", learners)


@query("gap_to_best_rule")
def gap_to_best_rule(spark, d):
    return jobs.gap_to_best_rule(frame(spark, d), "label_delay", Learner("logistic", NUMERIC))


@query("repeated_schemes")
def repeated_schemes(spark, d):
    f = materialize(history.add_strict_history(tk.labelled(spark, d)))
    return jobs.repeated(f, "label_delay", {"logistic": Learner("logistic", history.PLANNING_FEATURES, None)})


_IN_SPRINT = {"planning": Learner("logistic", NUMERIC), "progress": Learner("logistic", [*NUMERIC, *history.PROGRESS_FEATURES])}
_OUTCOMES = (("late closure", "label_delay", True), ("spillover", "label_spillover", False))


def checkpoint_frames(spark, d):
    """Name, label and scores at the checkpoints of each outcome; states and history are made once for both."""
    state = cp.progress_features(cp.checkpoint_state(*tables(spark, d)))
    state = materialize(state.select("sprint_id", "checkpoint", "open_at_checkpoint", *history.PROGRESS_FEATURES))
    f = materialize(history.add_strict_history(tk.labelled(spark, d)))
    for name, label, late in _OUTCOMES:
        frame = materialize(state.join(splits.split_time(f if late else f.where("nonempty")), "sprint_id"))
        yield name, label, jobs.in_sprint_rows(frame, label, _IN_SPRINT, cp.CHECKPOINTS, late)


@query("in_sprint_evaluation")
def in_sprint_evaluation(spark, d):
    """Open boxes at each checkpoint, both outcomes: planning features, progress features and rules, with intervals."""
    return tidy(jobs.union([jobs.in_sprint_table(rows, label, cp.CHECKPOINTS).withColumn("outcome", F.lit(name)) for name, label, rows in checkpoint_frames(spark, d)]))


@query("in_sprint_gaps")
def in_sprint_gaps(spark, d):
    """Progress features against the best rule at each checkpoint, both outcomes."""
    return tidy(jobs.union([jobs.in_sprint_gap(rows, label, "progress", cp.CHECKPOINTS).withColumn("outcome", F.lit(name)) for name, label, rows in checkpoint_frames(spark, d)]))


@query("fixed_split_intervals")
def fixed_split_intervals(spark, d):
    """Models and rules on the time split, both outcomes, each AUC with its interval."""
    f = materialize(history.add_strict_history(tk.labelled(spark, d)))
    out = []
    for name, label, late in _OUTCOMES:
        split = splits.split_time(f if late else f.where("nonempty"))
        learners = {"logistic": Learner("logistic", NUMERIC), "scope only": Learner("logistic", history.PLANNING_FEATURES, None)}
        out.append(jobs.fixed_split(split, label, learners, late).withColumn("outcome", F.lit(name)))
    return tidy(jobs.union(out))


@query("alternative_labels")
def alternative_labels(spark, d):
    """Other definitions of late closure on the rolling splits."""
    f = history.add_strict_history(tk.labelled(spark, d)).withColumns({
        "late_over_3_days": (F.col("late_days") > 3).cast("int"), "late_at_all": (F.col("late_days") > 0).cast("int")})
    learners = {"logistic": Learner("logistic", NUMERIC), "scope only": Learner("logistic", history.PLANNING_FEATURES, None)}
    return tidy(jobs.alternative_labels(f, ["label_delay", "late_over_3_days", "late_at_all"], learners))


@query("regression_comparison")
def regression_comparison(spark, d):
    """Ridge beside forecasts without learning, with gaps to the group median by resampled groups."""
    tr, te = jobs.sides(frame(spark, d))
    return tidy(jobs.regression_comparison(tr, te, "late_days_capped", {"ridge": Learner("ridge", NUMERIC)}, "hist_avg_late_days_3"))


@query("two_part_models")
def two_part_models(spark, d):
    """First whether a box has any scope, then spillover among those that have."""
    from tidemark.operators.labels import scope_presence

    tr, te = [scope_presence(x) for x in jobs.sides(frame(spark, d))]
    hist = ["hist_late_rate_3", "hist_n_available"]
    first = auc_of(fit_and_score(Learner("logistic", ["sprint_length_days", *hist]), tr, te, "has_scope"), "has scope", "has_scope")
    ne = F.col("has_scope") == 1
    second = auc_of(fit_and_score(Learner("logistic", NUMERIC), tr.where(ne), te.where(ne), "label_spillover"), "spillover given scope", "label_spillover")
    return first.unionByName(second)


_TIMING = {k: history.FEATURE_SETS[k] for k in ("legacy", "strict_timed", "strict_minus_late", "legacy_plus_late", "strict")}


@query("timing_study")
def timing_study(spark, d):
    """Five feature sets under both protocols."""
    f = materialize(tk.modelling_frame(spark, d).where("has_prior_sprint"))
    return tidy(jobs.timing_study(f, "label_delay", _TIMING, splits.leave_one_group_out(f)))


@query("timing_gap")
def timing_gap(spark, d):
    """Leave-one-group-out scores of two feature sets, compared by resampled groups."""
    from tidemark.models.many import group_out_many

    f = materialize(tk.modelling_frame(spark, d).where("has_prior_sprint"))
    s = group_out_many({k: _TIMING[k] for k in ("legacy", "strict_timed")}, f, "label_delay", splits.leave_one_group_out(f))
    pick = lambda n: F.max(F.when(F.col("model") == n, F.col("score"))).alias(n)
    out = materialize(s.groupBy("sprint_id", "project", "label_delay").agg(pick("legacy"), pick("strict_timed")))
    return tidy(resample.cluster_paired(out, "project", "legacy", "strict_timed", "label_delay"))


@query("timing_forest")
def timing_forest(spark, d):
    """The same feature sets with the forest, on the time split."""
    f = materialize(splits.split_time(tk.modelling_frame(spark, d).where("has_prior_sprint"), in_order=True))
    return tidy(explain.ablation(*jobs.sides(f), "label_delay", _TIMING, kind="forest", reference="legacy", group="project"))
