"""Bootstrap and jackknife by row, within strata and by cluster.

A row resample is a count per cell of equal rows (:mod:`tidemark.operators.multinomial`), so its cost is
cells x replicates and statistics are weighted by ``times``. A resample of clusters weights the counts of each
score: rows are first counted per (group, score), and every replicate sums those counts times the draws of their
group, whatever the number of groups. ``resample_rows`` draws the rows themselves, for what is not a function of counts:
draw i of replicate r is an md5 of (seed, r, stratum, i) taken modulo the number of rows, and draws and rows meet
through an equi join. Either way every engine and every retry draws the same sample; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import hash_number
from tidemark.operators.metrics import confusion_metrics
from tidemark.operators.multinomial import cluster_auc, resample_cells, resampled_auc, resampled_auc_of_both
from tidemark.operators.ordered import numbered, order_rows
from tidemark.operators.ranking import auc_from_cells, average_precision, roc_grid_from_cells, score_cells
from tidemark.session import materialize


def resample_rows(
    df: DataFrame, reps: int, seed: int, key: str, strata: Sequence[str] = (), keep: Sequence[str] = (), slices=None
) -> DataFrame:
    """(rep, strata, keep) rows of ``reps`` resamples, each as large as the data (per stratum)."""
    rows = numbered(df.select(key, *strata, *keep), strata, [F.col(key)], "rn_", "n_", slices)
    rep = F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))
    parts = [F.lit(str(seed)), F.col("rep").cast("string"), *[F.col(s).cast("string") for s in strata], F.col("rn_").cast("string")]
    draws = rows.select(*strata, "rn_", "n_", rep.alias("rep")).select(
        "rep", *strata, (hash_number(*parts) % F.col("n_") + 1).alias("rn_"))
    return draws.join(rows.select("rn_", *dict.fromkeys([*strata, *keep])), [*strata, "rn_"]).drop("rn_")


def auc_replicates(sample: DataFrame, score: str, label: str, keys: Sequence[str] = (), slices=None) -> DataFrame:
    """AUC per replicate (and keys); replicates with one class are left out."""
    at = ["rep", *keys]
    return auc_from_cells(score_cells(sample, at, score, label, F.col("times")), at, slices).where(F.col("auc").isNotNull())


def interval(reps: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and 95% percentile interval over replicates (at most ``reps`` rows per key)."""
    g = reps.groupBy(*keys) if keys else reps.groupBy()
    return g.agg(
        F.count(F.lit(1)).alias("replicates"), F.avg(value).alias("mean"),
        F.percentile(value, F.lit(0.025)).alias("lo"), F.percentile(value, F.lit(0.975)).alias("hi"))


def row_bootstrap_auc(df: DataFrame, score: str, label: str, reps: int = 2000, seed: int = 42, slices=None) -> DataFrame:
    return interval(resampled_auc(df, reps, seed, score, label, slices=slices), "auc")


def row_bootstrap_by(df: DataFrame, keys: Sequence[str], score: str, label: str, reps: int = 2000, seed: int = 42, slices=None) -> DataFrame:
    """Interval of the AUC of every group of rows (a model, a split), each resampled on its own."""
    return interval(resampled_auc(df, reps, seed, score, label, keys, slices), "auc", keys)


def row_bootstrap_metrics(df: DataFrame, score: str, pred: str, label: str, reps: int = 2000, seed: int = 42, strata=(), slices=None) -> DataFrame:
    """AUC, average precision, F1, sensitivity, specificity and Brier of the same resamples, one interval row per metric."""
    sample = materialize(resample_cells(df, reps, seed, [score, pred, label], strata, slices))
    times = F.col("times")
    auc = auc_replicates(sample, score, label, slices=slices).select("rep", "auc")
    ap = average_precision(sample, ["rep"], score, label, slices, times)
    conf = confusion_metrics(sample, ["rep"], label, pred, times).select("rep", "f1", "sensitivity", "specificity")
    gap = F.col(score) - F.col(label)
    bri = sample.groupBy("rep").agg((F.sum(times * gap * gap) / F.sum(times)).alias("brier"))
    wide = auc.join(ap, "rep").join(conf, "rep").join(bri, "rep")
    names = ["auc", "average_precision", "f1", "sensitivity", "specificity", "brier"]
    return interval(long_metrics(wide, names), "value", ["metric"])


def long_metrics(wide: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per metric instead of one column."""
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return wide.select(*keys, F.explode(cells).alias("m_")).select(*keys, "m_.metric", "m_.value")


def paired_bootstrap(df: DataFrame, score_a: str, score_b: str, label: str, reps: int = 2000, seed: int = 42, strata=(), slices=None) -> DataFrame:
    """AUC of b minus a on the same resamples: observed, interval, one-sided share and two-sided sign p."""
    pair = lambda d, keep: d.select(
        *keep, label,
        F.explode(F.array(F.struct(F.lit("a").alias("s"), F.col(score_a).cast("double").alias("v")),
                          F.struct(F.lit("b").alias("s"), F.col(score_b).cast("double").alias("v")))).alias("x")
    ).select(*keep, label, "x.s", "x.v")
    if strata:  # the AUC is over all strata, whose draws lie apart
        sample = pair(resample_cells(df, reps, seed, [score_a, score_b, label], strata, slices), ["rep", "times"])
        per = auc_replicates(sample, "v", label, ["s"], slices)
    else:
        per = resampled_auc_of_both(df, reps, seed, score_a, score_b, label, slices=slices)
    diff = difference(per, ["rep"])
    seen = difference(auc_from_cells(score_cells(pair(df, []), ["s"], "v", label), ["s"], slices), [])
    return sign_test(diff, seen)


def paired_bootstrap_by(df: DataFrame, keys: Sequence[str], score_a: str, score_b: str, label: str, reps: int = 2000, seed: int = 42, slices=None) -> DataFrame:
    """``paired_bootstrap`` for every group of rows (a checkpoint, an outcome), each resampled on its own, in one job."""
    pair = lambda d, keep: d.select(
        *keep, label,
        F.explode(F.array(F.struct(F.lit("a").alias("s"), F.col(score_a).cast("double").alias("v")),
                          F.struct(F.lit("b").alias("s"), F.col(score_b).cast("double").alias("v")))).alias("x")
    ).select(*keep, label, "x.s", "x.v")
    diff = difference(resampled_auc_of_both(df, reps, seed, score_a, score_b, label, keys, slices), ["rep", *keys])
    seen = difference(auc_from_cells(score_cells(pair(df, keys), ["s", *keys], "v", label), ["s", *keys], slices), keys)
    d = diff.join(F.broadcast(seen.withColumnRenamed("diff", "observed")), list(keys))  # a row per group
    against = F.when(F.col("observed") >= 0, F.col("diff") <= 0).otherwise(F.col("diff") >= 0)
    return d.groupBy(*keys, "observed").agg(
        F.count(F.lit(1)).alias("replicates"), F.avg("diff").alias("mean"),
        F.percentile("diff", F.lit(0.025)).alias("lo"), F.percentile("diff", F.lit(0.975)).alias("hi"),
        F.avg((F.col("diff") <= 0).cast("double")).alias("share_le_0"), F.least(F.lit(1.0), 2 * F.avg(against.cast("double"))).alias("p_two_sided"))


def difference(auc: DataFrame, keys: Sequence[str]) -> DataFrame:
    g = auc.groupBy(*keys) if keys else auc.groupBy()
    pick = lambda s: F.max(F.when(F.col("s") == s, F.col("auc")))
    return g.agg((pick("b") - pick("a")).alias("diff")).where(F.col("diff").isNotNull())


def sign_test(diffs: DataFrame, observed: DataFrame) -> DataFrame:
    """Interval of the difference and 2 * share of replicates on the other side of zero, at most 1."""
    d = diffs.withColumn("one_", F.lit(1)).join(
        F.broadcast(observed.select(F.lit(1).alias("one_"), F.col("diff").alias("observed"))), "one_")
    against = F.when(F.col("observed") >= 0, F.col("diff") <= 0).otherwise(F.col("diff") >= 0)
    return d.groupBy("observed").agg(
        F.count(F.lit(1)).alias("replicates"), F.avg("diff").alias("mean"),
        F.percentile("diff", F.lit(0.025)).alias("lo"), F.percentile("diff", F.lit(0.975)).alias("hi"),
        F.avg((F.col("diff") <= 0).cast("double")).alias("share_le_0"),
        F.least(F.lit(1.0), 2 * F.avg(against.cast("double"))).alias("p_two_sided"))


# ------------------------------------------------------------------ clusters
def cluster_draws(df: DataFrame, group: str, reps: int, seed: int) -> DataFrame:
    """(rep, group, times): as many groups as there are, drawn with replacement."""
    groups = numbered(df.select(group).distinct(), [], [F.col(group)], "rn_")
    n = groups.count()
    draws = df.sparkSession.range(n * reps).select(
        F.floor(F.col("id") / n).cast("int").alias("rep"), (F.col("id") % n).alias("i"))
    parts = [F.lit(str(seed)), F.col("rep").cast("string"), F.col("i").cast("string")]
    picked = draws.select("rep", (hash_number(*parts) % n + 1).alias("rn_")).groupBy("rep", "rn_").agg(
        F.count(F.lit(1)).alias("times"))
    return picked.join(groups, "rn_").drop("rn_")


def cluster_auc_replicates(df: DataFrame, group: str, score: str, label: str, reps: int = 2000, seed: int = 42, slices=None) -> DataFrame:
    """(rep, auc) of resamples of whole groups; resamples with one class are left out."""
    draws = cluster_draws(df, group, reps, seed)
    return cluster_auc(score_cells(df, [group], score, label), draws, group, slices)


def cluster_bootstrap_auc(df: DataFrame, group: str, score: str, label: str, reps: int = 2000, seed: int = 42, slices=None) -> DataFrame:
    return interval(cluster_auc_replicates(df, group, score, label, reps, seed, slices), "auc")


def cluster_paired(df: DataFrame, group: str, score_a: str, score_b: str, label: str, reps: int = 2000, seed: int = 42, slices=None) -> DataFrame:
    """AUC of b minus a on the same resamples of groups."""
    both = [cluster_auc_replicates(df, group, s, label, reps, seed, slices).withColumnRenamed("auc", n)
            for s, n in ((score_a, "a"), (score_b, "b"))]
    diff = both[0].join(both[1], "rep").select("rep", (F.col("b") - F.col("a")).alias("diff"))
    seen = [auc_from_cells(score_cells(df, [], s, label), [], slices).select(F.lit(1).alias("one_"), F.col("auc").alias(n))
            for s, n in ((score_a, "a"), (score_b, "b"))]
    observed = seen[0].join(F.broadcast(seen[1]), "one_").select((F.col("b") - F.col("a")).alias("diff"))
    return sign_test(diff, observed)


def cluster_metric(df: DataFrame, group: str, sums: dict[str, Column], metric: Column, reps: int = 2000, seed: int = 42) -> DataFrame:
    """Replicates of a metric that is a function of sums: group sums once, then weighted sums per replicate."""
    draws = cluster_draws(df, group, reps, seed)
    per = df.groupBy(group).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    return draws.join(per, group).groupBy("rep").agg(
        *[F.sum(F.col(n) * F.col("times")).alias(n) for n in sums]
    ).select("rep", metric.alias("value")).where(F.col("value").isNotNull())


def cluster_bootstrap_share(df: DataFrame, group: str, hit: Column, reps: int = 2000, seed: int = 42) -> DataFrame:
    """Interval of the share of flagged rows, resampling boards (or any group)."""
    sums = {"hits": hit.cast("double"), "rows": F.lit(1.0)}
    return interval(cluster_metric(df, group, sums, F.col("hits") / F.col("rows"), reps, seed), "value")


def cluster_mae_difference(df: DataFrame, group: str, truth: str, pred_a: str, pred_b: str, reps: int = 2000, seed: int = 42) -> DataFrame:
    """Mean absolute error of b minus a, resampling groups."""
    err = lambda p: F.abs(F.col(truth) - F.col(p))
    sums = {"ea": err(pred_a), "eb": err(pred_b), "rows": F.lit(1.0)}
    return interval(cluster_metric(df, group, sums, (F.col("eb") - F.col("ea")) / F.col("rows"), reps, seed), "value")


def jackknife_auc(df: DataFrame, group: str, score: str, label: str, slices=None) -> DataFrame:
    """AUC without each group: all wins minus those that involve the group as winner or as loser.

    Three running counts give them for every group at once, whatever the number of groups.
    """
    cells = score_cells(df, [group], score, label)
    every = cells.groupBy("score").agg(F.sum("pos").alias("pos_at"), F.sum("neg").alias("neg_at"))
    every = order_rows(every, [], [F.col("score")], slices).scan(
        sums_before={"pos_below": F.col("pos_at"), "neg_below": F.col("neg_at")},
        totals={"pos_all": F.col("pos_at"), "neg_all": F.col("neg_at")})
    half = F.lit(2.0)
    won = F.col("pos") * (F.col("neg_below") + F.col("neg_at") / half)
    lost = F.col("neg") * (F.col("pos_all") - F.col("pos_below") - F.col("pos_at") / half)
    total = every.agg(F.sum(F.col("pos_at") * (F.col("neg_below") + F.col("neg_at") / half)).alias("wins_all"), F.lit(1).alias("one_"))
    outer = cells.join(every, "score").groupBy(F.col(group).alias("left_out")).agg(
        F.sum(won).alias("won"), F.sum(lost).alias("lost"), F.max("pos_all").alias("p_all"), F.max("neg_all").alias("n_all"))
    inner = order_rows(cells, [group], [F.col("score")], slices).scan(sums_before={"below": F.col("neg")}).groupBy(
        F.col(group).alias("left_out")).agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / half)).alias("own"))
    d = outer.join(inner, "left_out").withColumn("one_", F.lit(1)).join(F.broadcast(total), "one_")
    p, n = F.col("p_all") - F.col("p"), F.col("n_all") - F.col("n")
    rest = F.col("wins_all") - F.col("won") - F.col("lost") + F.col("own")
    return d.select("left_out", p.alias("n_pos"), n.alias("n_neg"), F.when((p > 0) & (n > 0), rest / (p.cast("double") * n)).alias("auc"))


def jackknife_f1_difference(df: DataFrame, group: str, label: str, pred_a: str, pred_b: str) -> DataFrame:
    """F1 of caller b minus caller a without each group, beside the difference on all rows and its least, greatest and range."""
    y = F.col(label)
    count = lambda c, n: F.sum(c.cast("long")).alias(n)
    per = df.groupBy(F.col(group).alias("left_out")).agg(
        F.count(F.lit(1)).alias("n_excluded"), count(y == 1, "p"),
        *[x for k, q in (("a", pred_a), ("b", pred_b)) for x in (count((y == 1) & (F.col(q) == 1), f"tp_{k}"), count(F.col(q) == 1, f"w_{k}"))])
    names = ["p", "tp_a", "w_a", "tp_b", "w_b"]
    every = per.agg(*[F.sum(c).alias(f"{c}_all") for c in names], F.lit(1).alias("one_"))
    f1 = lambda tp, w, p: F.when(w + p > 0, 2 * tp / (w + p)).otherwise(F.lit(0.0))
    left = {c: F.col(f"{c}_all") - F.col(c) for c in names}
    d = per.withColumn("one_", F.lit(1)).join(F.broadcast(every), "one_").select(
        "one_", "left_out", "n_excluded", (f1(left["tp_b"], left["w_b"], left["p"]) - f1(left["tp_a"], left["w_a"], left["p"])).alias("f1_delta"),
        (f1(F.col("tp_b_all"), F.col("w_b_all"), F.col("p_all")) - f1(F.col("tp_a_all"), F.col("w_a_all"), F.col("p_all"))).alias("full_delta"))
    ends = d.agg(F.min("f1_delta").alias("delta_min"), F.max("f1_delta").alias("delta_max"), F.lit(1).alias("one_"))
    return d.join(F.broadcast(ends), "one_").drop("one_").withColumn("delta_range", F.col("delta_max") - F.col("delta_min"))


def within_group_bootstrap(df: DataFrame, group: str, score: str, label: str, reps: int = 2000, seed: int = 42, min_class: int = 1, slices=None) -> DataFrame:
    """Interval of the mean group AUC, resampling rows inside each group."""
    sample = resample_cells(df, reps, seed, [score, label], [group], slices)
    per = auc_from_cells(score_cells(sample, ["rep", group], score, label, F.col("times")), ["rep", group], slices)
    per = per.where((F.col("n_pos") >= min_class) & (F.col("n_neg") >= min_class))
    return interval(per.groupBy("rep").agg(F.avg("auc").alias("auc")), "auc")


def roc_bootstrap_band(df: DataFrame, score: str, label: str, reps: int = 2000, seed: int = 42, slices=None) -> DataFrame:
    """Percentile band of the ROC curve at each grid point."""
    sample = resample_cells(df, reps, seed, [score, label], slices=slices)
    grid = roc_grid_from_cells(score_cells(sample, ["rep"], score, label, F.col("times")), ["rep"], slices)
    return grid.groupBy("step", "fpr").agg(
        F.avg("tpr").alias("tpr_mean"), F.percentile("tpr", F.lit(0.025)).alias("tpr_lo"), F.percentile("tpr", F.lit(0.975)).alias("tpr_hi"))
