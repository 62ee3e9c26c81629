"""Composite jobs: one split for all models and rules, repeated schemes, in-sprint evaluation,
transfer, leak demonstrations and time-valid refits. Each returns one long metrics table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import hash_number
from tidemark.models.learners import Learner, fit_and_score, fit_classifier, out_of_fold, prepare, score, together
from tidemark.models.many import fit_many, group_out_many, score_splits, split_scores
from tidemark.operators import metrics, ranking, resample, rules, splits
from tidemark.operators.ordered import numbered
from tidemark.session import materialize

METRICS = ["auc", "sensitivity", "specificity", "f1", "precision", "recall", "average_precision", "brier"]


def union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def sides(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split.where(F.col("side") == "train"), split.where(F.col("side") == "test")


def evaluate_scores(scored: DataFrame, keys: Sequence[str], label: str, probability: bool = True) -> DataFrame:
    """All metrics per key of rows with score and pred."""
    k = list(keys)
    out = metrics.confusion_metrics(scored, k, label, "pred")
    out = out.join(ranking.roc_auc(scored, k, "score", label).select(*k, "auc"), k)
    out = out.join(ranking.average_precision(scored, k, "score", label), k)
    return out.join(metrics.brier(scored, k, label, "score"), k) if probability else out


def rule_columns(late: bool, in_sprint: bool) -> list[str]:
    base = ["rule_committed", "rule_past_lateness" if late else "rule_past_carry"]
    return base + (["rule_remaining", "rule_remaining_share"] if in_sprint else [])


def score_long(train: DataFrame, test: DataFrame, label: str, learners: Mapping[str, Learner], late: bool = True) -> DataFrame:
    """Test rows once per model or rule, with score, training-side threshold, call and (rules) training AUC."""
    base = ["sprint_id", "project", label]
    parts = []
    for name, learner in learners.items():
        oof = out_of_fold(learner, train, label)
        t = ranking.youden_threshold(oof, [], "score", label).first()["threshold"]
        s = fit_and_score(learner, train, test, label).select(*base, "score")
        parts.append(s.withColumns({"model": F.lit(name), "threshold": F.lit(t), "is_rule": F.lit(False)}))
    cols = rule_columns(late, "remaining_n" in test.columns)
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).cast("double").alias("score")) for c in cols]))
    tr = rules.rule_scores(train, train, late).select(label, stack.alias("r")).select(label, "r.*")
    thr = ranking.youden_threshold(tr, ["model"], "score", label).select("model", "threshold")
    auc = ranking.roc_auc(tr, ["model"], "score", label).select("model", F.col("auc").alias("train_auc"))
    te = rules.rule_scores(train, test, late).select(*base, stack.alias("r")).select(*base, "r.*")
    parts.append(te.join(F.broadcast(thr.join(auc, "model")), "model").withColumn("is_rule", F.lit(True)))  # one row per rule
    return union(parts).withColumn("pred", (F.col("score") >= F.col("threshold")).cast("int"))


def compare_on_split(split: DataFrame, label: str, learners: Mapping[str, Learner], late: bool = True) -> DataFrame:
    """All models and rules on one split."""
    if together(*learners.values()):
        return compare_on_splits(split.withColumn("split", F.lit(0)), label, learners, 1, late).drop("split")
    train, test = sides(split)
    long = score_long(train, test, label, learners, late)
    out = evaluate_scores(long, ["model", "is_rule"], label, probability=False)
    extra = long.groupBy("model").agg(F.first("threshold").alias("threshold"), F.first("train_auc").alias("train_auc"))
    return out.join(extra, "model")


def score_long_splits(long: DataFrame, label: str, learners: Mapping[str, Learner], n_splits: int, late: bool = True) -> DataFrame:
    """Test rows once per split and model or rule, as in ``score_long``; every fit of every split in one job.

    ``long`` has a row per split (``split``, from 0) and box, with ``side``, and if wanted ``seed``.
    """
    base = ["split", "sprint_id", "project", label]
    keys = ["split", "model"]
    read = dict.fromkeys([*base, "side", *[c for c in ("seed",) if c in long.columns], *[c for l in learners.values() for c in (*l.numeric, l.group) if c]])
    scored = materialize(score_splits(long.select(*read), learners, label, n_splits).select(*base, "fold", "model", "score"))
    t = ranking.youden_threshold(scored.where(F.col("fold").isNotNull()), keys, "score", label).select(*keys, "threshold")
    fitted = scored.where(F.col("fold").isNull()).drop("fold").join(F.broadcast(t), keys)  # a row per split and model
    fitted = fitted.withColumns({"is_rule": F.lit(False), "train_auc": F.lit(None).cast("double")})
    cols = rule_columns(late, "remaining_n" in long.columns)
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).cast("double").alias("score")) for c in cols]))
    ruled = rules.rule_scores_by(long.where(F.col(label).isNotNull()), ["split"], late).select(*base, "side", stack.alias("r")).select(*base, "side", "r.*")
    ruled = materialize(ruled)
    tr = ruled.where(F.col("side") == "train")
    thr = ranking.youden_threshold(tr, keys, "score", label).select(*keys, "threshold")
    auc = ranking.roc_auc(tr, keys, "score", label).select(*keys, F.col("auc").alias("train_auc"))
    te = ruled.where(F.col("side") == "test").drop("side").join(F.broadcast(thr.join(auc, keys)), keys).withColumn("is_rule", F.lit(True))
    return fitted.unionByName(te).withColumn("pred", (F.col("score") >= F.col("threshold")).cast("int"))


def compare_on_splits(long: DataFrame, label: str, learners: Mapping[str, Learner], n_splits: int, late: bool = True) -> DataFrame:
    """All models and rules on every split: metrics, threshold and (rules) training AUC per split and model."""
    rows = materialize(score_long_splits(long, label, learners, n_splits, late))
    keys = ["split", "model"]
    out = evaluate_scores(rows, [*keys, "is_rule"], label, probability=False)
    extra = rows.groupBy(*keys).agg(F.first("threshold").alias("threshold"), F.first("train_auc").alias("train_auc"))
    return out.join(extra, keys)


def repeated_splits(df: DataFrame, label: str, repeats: int = 5, fraction: float = 0.3) -> DataFrame:
    """All repeats of the random and the rolling time scheme in one table: ``split`` (random first), ``side`` and ``seed``."""
    seeded = df.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = [hash_number((F.col("split") + 42).cast("string"), F.col("sprint_id").cast("string")), F.col("sprint_id")]
    d = numbered(seeded, ["split", label], order, "rn_", "n_")
    random = d.withColumn("side", F.when(F.col("rn_") <= F.round(F.col("n_") * F.lit(float(fraction))), "test").otherwise("train")).drop("rn_", "n_")
    rolling = splits.split_rolling(df).where(F.col("repeat") <= repeats)
    rolling = rolling.withColumn("split", (F.col("repeat") - 1 + repeats).cast("int")).drop("repeat")
    return random.unionByName(rolling).withColumn("seed", F.pmod(F.col("split"), F.lit(repeats)))


def repeated(df: DataFrame, label: str, learners: Mapping[str, Learner], repeats: int = 5, late: bool = True) -> DataFrame:
    """Random and rolling time splits, each repeated: mean and SD of the metrics per scheme and model."""
    names = ["auc", "sensitivity", "specificity", "f1"]
    if together(*learners.values()):
        out = compare_on_splits(materialize(repeated_splits(df, label, repeats)), label, learners, 2 * repeats, late)
        return metrics.mean_sd(out.withColumn("scheme", F.when(F.col("split") < repeats, "random").otherwise("time")), ["scheme", "model"], names)
    rows = []
    rolling = splits.split_rolling(df)
    for k in range(repeats):
        seeded = {n: Learner(l.kind, l.numeric, l.group, l.seed + k, l.settings) for n, l in learners.items()}
        for scheme, split in (("random", splits.split_stratified(df, label, 42 + k)),
                              ("time", rolling.where(F.col("repeat") == k + 1).drop("repeat"))):
            part = compare_on_split(split, label, seeded, late)
            rows.append(part.withColumns({"scheme": F.lit(scheme), "repeat": F.lit(k + 1)}))
    return metrics.mean_sd(union(rows), ["scheme", "model"], names)


def with_intervals(long: DataFrame, table: DataFrame, label: str, keys: Sequence[str], reps: int = 2000) -> DataFrame:
    """A metrics table with the bootstrap interval of every model's AUC; ``long`` has the scores behind it."""
    ci = resample.row_bootstrap_by(long, keys, "score", label, reps).select(*keys, F.col("lo").alias("auc_lo"), F.col("hi").alias("auc_hi"))
    return table.join(ci, list(keys), "left")


def fixed_split(split: DataFrame, label: str, learners: Mapping[str, Learner], late: bool = True, reps: int = 2000) -> DataFrame:
    """All models and rules on one split, each AUC with its interval."""
    rows = materialize(score_long_splits(split.withColumn("split", F.lit(0)), label, learners, 1, late))
    table = evaluate_scores(rows, ["model", "is_rule"], label, probability=False)
    return with_intervals(rows, table, label, ["model"], reps)


def alternative_labels(df: DataFrame, labels: Sequence[str], learners: Mapping[str, Learner], repeats: int = 5, late: bool = True) -> DataFrame:
    """Rolling time splits under other definitions of the outcome: mean and SD of the metrics per label and model."""
    rolling = materialize(splits.split_rolling(df).where(F.col("repeat") <= repeats).withColumn("split", (F.col("repeat") - 1).cast("int")).drop("repeat").withColumn("seed", F.col("split")))
    parts = [compare_on_splits(rolling, y, learners, repeats, late).withColumn("label", F.lit(y)) for y in labels]
    return metrics.mean_sd(union(parts), ["label", "model"], ["auc", "sensitivity", "specificity", "f1"])


def _named(df: DataFrame, points: Sequence[float]) -> DataFrame:
    return df.withColumn("checkpoint", F.element_at(F.array(*[F.lit(c) for c in points]), F.col("split") + 1)).drop("split")


def in_sprint_rows(frame: DataFrame, label: str, learners: Mapping[str, Learner], checkpoints: Sequence[float], late: bool = True) -> DataFrame:
    """Scores of all models and rules on the sprints still open at each checkpoint, its place in ``checkpoints`` as ``split``."""
    at = (F.array_position(F.array(*[F.lit(float(c)) for c in checkpoints]), F.col("checkpoint").cast("double")) - 1).cast("int")
    there = frame.where(F.col("checkpoint").isin([float(c) for c in checkpoints]) & F.col("open_at_checkpoint") & F.col("side").isNotNull()).withColumn("split", at)
    return materialize(score_long_splits(there, label, learners, len(checkpoints), late))


def in_sprint_table(rows: DataFrame, label: str, checkpoints: Sequence[float], reps: int = 2000) -> DataFrame:
    """Per checkpoint and model or rule of ``in_sprint_rows``: metrics with intervals."""
    keys = ["split", "model"]
    return _named(with_intervals(rows, evaluate_scores(rows, [*keys, "is_rule"], label, probability=False), label, keys, reps), [float(c) for c in checkpoints])


def in_sprint_gap(rows: DataFrame, label: str, model: str, checkpoints: Sequence[float], reps: int = 2000) -> DataFrame:
    """Per checkpoint of ``in_sprint_rows``: the AUC of ``model`` minus the rule that was best on the training side."""
    best = rows.where("is_rule").groupBy("split").agg(F.min_by("model", F.struct(-F.col("train_auc"), "model")).alias("rule"))
    pick = rows.join(F.broadcast(best), "split").where((F.col("model") == model) | (F.col("model") == F.col("rule")))
    both = pick.groupBy("split", "rule", "sprint_id", label).agg(
        F.max(F.when(F.col("model") == model, F.col("score"))).alias("b_"), F.max(F.when(F.col("model") != model, F.col("score"))).alias("a_"))
    both = materialize(both)  # read by every step of the bootstrap
    gaps = resample.paired_bootstrap_by(both, ["split", "rule"], "a_", "b_", label, reps).withColumn("model", F.lit(model))
    return _named(gaps, [float(c) for c in checkpoints])


def in_sprint_gaps(frame: DataFrame, label: str, learners: Mapping[str, Learner], model: str, checkpoints: Sequence[float], late: bool = True, reps: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Both tables of the scores at the checkpoints: ``in_sprint_table`` and ``in_sprint_gap``."""
    rows = in_sprint_rows(frame, label, learners, checkpoints, late)
    return in_sprint_table(rows, label, checkpoints, reps), in_sprint_gap(rows, label, model, checkpoints, reps)


def timing_study(df: DataFrame, label: str, sets: Mapping[str, Sequence[str]], groups: Sequence[str], group: str = "project") -> DataFrame:
    """Feature sets under two protocols: pooled AUC over held-out groups, and the time split with the group as a feature."""
    out = group_out_many(sets, df, label, groups, group).select("model", "score", label, F.lit("group out").alias("protocol"))
    timed = splits.split_time(df, group=group)
    tr, te = sides(timed)
    out = out.unionByName(split_scores(sets, tr, te, label, group).select("model", "score", label, F.lit("time split").alias("protocol")))
    return ranking.roc_auc(materialize(out), ["protocol", "model"], "score", label).withColumnRenamed("model", "feature_set")


def regression_comparison(train: DataFrame, test: DataFrame, target: str, learners: Mapping[str, Learner], history: str, group: str = "project", reps: int = 2000) -> DataFrame:
    """Regressors beside no-learning forecasts: metrics of each, and its error against the group median by resampled groups."""
    from tidemark.models.learners import fit_regressor

    plain = ["train_mean", "train_median", "scope_x_rate", "prior_history", "group_median"]
    rows = rules.regression_baselines(train, test, target, history, group)
    for name, learner in learners.items():
        rows = score(fit_regressor(learner, train, target), rows, learner.numeric, name, is_probability=False)
    rows = materialize(rows.select("sprint_id", group, target, *plain, *learners))
    out = None
    for name in (*plain, *learners):
        part = metrics.regression_metrics(rows, [], target, name).select(F.lit(name).alias("model"), "n", "mae", "r2", "spearman")
        if name != "group_median":
            gap = resample.cluster_mae_difference(rows, group, target, "group_median", name, reps).select(F.lit(name).alias("model"), F.col("mean").alias("gap"), F.col("lo").alias("gap_lo"), F.col("hi").alias("gap_hi"))
            part = part.join(F.broadcast(gap), "model", "left")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def gap_to_best_rule(split: DataFrame, label: str, learner: Learner, late: bool = True, reps: int = 2000) -> DataFrame:
    """AUC of a model minus the rule that was best on the training side, with a paired row bootstrap."""
    train, test = sides(split)
    cols = rule_columns(late, "remaining_n" in test.columns)
    best = rules.best_rule(rules.rule_scores(train, train, late), cols, label).first()["rule"]
    s = fit_and_score(learner, train, rules.rule_scores(train, test, late), label)
    out = resample.paired_bootstrap(s.withColumn("rule_score", F.col(best).cast("double")), "rule_score", "score", label, reps)
    return out.withColumn("rule", F.lit(best))


def in_sprint(frame: DataFrame, label: str, planning: Sequence[str], progress: Sequence[str], kind: str, checkpoints: Sequence[float], settings: dict | None = None, late: bool = True) -> DataFrame:
    """Per checkpoint, on sprints still open: planning features, progress features and rules.

    ``frame`` carries the fixed split side and ``open_at_checkpoint``.
    """
    learners = {"planning": Learner(kind, list(planning), settings=settings or {}), "progress": Learner(kind, [*planning, *progress], settings=settings or {})}
    points = [float(c) for c in checkpoints]
    there = frame.where(F.col("checkpoint").isin(points) & F.col("open_at_checkpoint") & F.col("side").isNotNull())
    if together(*learners.values()):
        at = F.array_position(F.array(*[F.lit(c) for c in points]), F.col("checkpoint").cast("double"))
        out = compare_on_splits(there.withColumn("split", (at - 1).cast("int")), label, learners, len(points), late)
        return out.withColumn("checkpoint", F.element_at(F.array(*[F.lit(c) for c in points]), F.col("split") + 1)).drop("split")
    return union([compare_on_split(there.where(F.col("checkpoint") == c), label, learners, late).withColumn("checkpoint", F.lit(c)) for c in points])


def group_out(df: DataFrame, label: str, learner: Learner, group: str = "project") -> DataFrame:
    """Leave-one-group-out: metrics per held-out group at threshold 0.5."""
    from tidemark.models.learners import group_out_scores

    groups = splits.leave_one_group_out(df, group)
    scored = group_out_scores(learner, df, label, groups, group).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return evaluate_scores(scored, [group], label)


def transfer(source: DataFrame, target: DataFrame, label: str, numeric: Sequence[str], kind: str, group: str = "project", settings: dict | None = None) -> DataFrame:
    """Fit on one source without its group, score another; metrics per target group, flagged when readable."""
    model = fit_classifier(Learner(kind, list(numeric), None, settings=settings or {}), source, label)
    scored = score(model, target, numeric).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return metrics.interpretable(evaluate_scores(scored, [group], label))


def leak_demo(train: DataFrame, test: DataFrame, label: str, numeric: Sequence[str], leak: str, kind: str = "logistic", settings: dict | None = None) -> DataFrame:
    """The same learner with and without its own outcome, and with copies made before the split."""
    rows = []
    for name, cols in (("clean", list(numeric)), ("own outcome as a feature", [*numeric, leak])):
        keep = [t.where(F.col(leak).isNotNull()) for t in (train, test)]
        s = fit_and_score(Learner(kind, cols, None, settings=settings or {}), *keep, label)
        rows.append(ranking.roc_auc(s, [], "score", label).withColumn("case", F.lit(name)))
    both = splits.oversample(train.unionByName(test), label)
    mixed = splits.split_stratified(both.withColumn("copy_id", F.concat_ws("#", "sprint_id", F.col("draw").cast("string"))), label, key="copy_id")
    after = splits.oversample(train, label).drop("draw")
    for name, tr, te in (("copies before the split", *sides(mixed)), ("copies after the split", after, test)):
        s = fit_and_score(Learner(kind, list(numeric), None, settings=settings or {}), tr, te, label)
        rows.append(ranking.roc_auc(s, [], "score", label).withColumn("case", F.lit(name)))
    return union(rows)


def time_valid_refit(split: DataFrame, label: str, learner: Learner, min_rows: int = 150) -> DataFrame:
    """Test rows scored by quarter, by a model that saw only rows whose outcome was known before it.

    Quarters with fewer than ``min_rows`` such rows, or one class, are skipped.
    """
    train, test = sides(split.withColumn("known_", F.greatest("end_date", "complete_date")))
    quarters = splits.quarters_to_score(test)
    counts = train.agg(*[a for i, q in enumerate(quarters) for a in (
        F.count_if(F.col("known_") < F.lit(q)).alias(f"n{i}"), F.count_if((F.col("known_") < F.lit(q)) & (F.col(label) == 1)).alias(f"p{i}"))]).first()
    kept = [i for i in range(len(quarters)) if counts[f"n{i}"] >= min_rows and counts[f"p{i}"] not in (0, counts[f"n{i}"])]
    if together(learner) and kept:
        # A fit per quarter over rows known before it, all in one job.
        ends = F.array(*[F.lit(quarters[i]) for i in kept])
        place = F.array_position(ends, F.date_trunc("quarter", "start_date"))
        knew = F.filter(F.array(*[F.lit(j) for j in range(len(kept))]), lambda j: F.col("known_") < F.element_at(ends, j + 1))
        none = F.array().cast("array<int>")
        rows = train.withColumns({"train_in": knew, "score_in": none}).unionByName(
            test.withColumns({"train_in": none, "score_in": F.when(place > 0, F.array((place - 1).cast("int"))).otherwise(none)}))
        models = fit_many(rows, [learner.numeric] * len(kept), label, learner.group)
        return models.score(rows).withColumn("quarter", F.element_at(ends, F.col("fit") + 1)).drop("fit")
    rows = []
    for i in kept:
        q = quarters[i]
        part = fit_and_score(learner, train.where(F.col("known_") < F.lit(q)), test.where(F.date_trunc("quarter", "start_date") == F.lit(q)), label)
        rows.append(part.withColumn("quarter", F.lit(q)))
    return union(rows)


def seed_variance(train: DataFrame, test: DataFrame, label: str, learner: Learner, seeds: Sequence[int]) -> DataFrame:
    """Mean and SD of the AUC over model seeds; the preprocessing, which draws nothing, is fitted once for all."""
    rows, pre = [], prepare(learner, train)
    for s in seeds:
        seeded = Learner(learner.kind, learner.numeric, learner.group, s, learner.settings)
        rows.append(ranking.roc_auc(fit_and_score(seeded, train, test, label, pre=pre), [], "score", label))
    return metrics.mean_sd(union(rows), [], ["auc"])


def build_edited_prompts(points: DataFrame, edit: Callable[[DataFrame], DataFrame], size: int = 20, seed: int = 2027) -> DataFrame:
    """Edited board texts of a condition in random batches per checkpoint."""
    return splits.batches(edit(points), size, seed, key="sprint_id", within=["checkpoint"])
