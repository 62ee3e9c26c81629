"""Queries on scores and calls: metrics, resampling, agreement, cost, rules, reconciliation."""

from pyspark.sql import functions as F

from tidemark.functions.scalars import outcome_class
from tidemark.operators import agreement as ag
from tidemark.operators import cost, metrics, ranking, resample, rules, splits, summaries
from tidemark.operators.history import add_strict_history, add_trailing_history
from tidemark.operators.skew import top_k
from tidemark.plans import tracker as tk
from tidemark.plans.oracle import auc, draw, mid_rank, with_
from tidemark.plans.registry import query, tidy

REPS = 2000  # replicates of the registered bootstraps


def docs(spark, d):
    """Labelled documents: length as a score, its last two digits as a probability, two 0/1 ratings."""
    t = tk.load(spark, d, "documents").select("doc_id", "lang", "n_chars").join(tk.load(spark, d, "labels"), "doc_id")
    return t.withColumns({"p": F.col("n_chars") % 100 / F.lit(100.0), "call": (F.col("n_chars") >= 1000).cast("int")})


def conf_sql(frm, keys, y, p):
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}tp, fp, fn, tn, tp+fp+fn+tn AS n, tp+fn AS n_pos, fp+tn AS n_neg, round(coalesce(tp/nullif(tp+fp,0)::DOUBLE,0),6) AS precision, round(coalesce(tp/nullif(tp+fn,0)::DOUBLE,0),6) AS recall,
 round(coalesce(2*tp/nullif(2*tp+fp+fn,0)::DOUBLE,0),6) AS f1, round(tp/nullif(tp+fn,0)::DOUBLE,6) AS sensitivity, round(tn/nullif(fp+tn,0)::DOUBLE,6) AS specificity
FROM (SELECT {k}count(*) FILTER ({y}=1 AND {p}=1) AS tp, count(*) FILTER ({y}=0 AND {p}=1) AS fp, count(*) FILTER ({y}=1 AND {p}=0) AS fn, count(*) FILTER ({y}=0 AND {p}=0) AS tn FROM {frm} {'GROUP BY ' + keys if keys else ''})"""


@query("confusion_metrics", with_("scored") + conf_sql("scored", "project", "y", "pred"))
def confusion_metrics(spark, d):
    return tidy(metrics.confusion_metrics(tk.scored(spark, d), ["project"], "label_delay", "pred"))


@query("outcome_classes", with_("scored") + "SELECT project, CASE WHEN y=1 AND pred=1 THEN 'true_positive' WHEN y=0 AND pred=0 THEN 'true_negative' WHEN y=0 THEN 'false_positive' ELSE 'false_negative' END AS outcome, count(*) AS n, round(avg(committed),6) AS mean_scope FROM scored GROUP BY 1,2")
def outcome_classes(spark, d):
    s = tk.scored(spark, d).withColumn("outcome", outcome_class(F.col("label_delay"), F.col("pred")))
    return tidy(s.groupBy("project", "outcome").agg(F.count(F.lit(1)).alias("n"), F.avg("committed_issue_count").alias("mean_scope")))


@query("surprising_rows", with_("scored") + "SELECT * FROM (SELECT 'false_positive' AS outcome, row_number() OVER (ORDER BY score DESC, sprint_id) AS rank, sprint_id, score FROM scored WHERE y=0 AND pred=1 UNION ALL SELECT 'false_negative', row_number() OVER (ORDER BY score, sprint_id), sprint_id, score FROM scored WHERE y=1 AND pred=0) WHERE rank<=5")
def surprising_rows(spark, d):
    s = tk.scored(spark, d).withColumn("outcome", outcome_class(F.col("label_delay"), F.col("pred")))
    pick = lambda o, order: top_k(s.where(F.col("outcome") == o).select("outcome", "sprint_id", "score"), [], order, 5)
    return tidy(pick("false_positive", [F.col("score").desc(), F.col("sprint_id")]).unionByName(pick("false_negative", [F.col("score"), F.col("sprint_id")])))


@query("roc_auc", with_("scored") + f"SELECT project, count(*) FILTER (y=1) AS n_pos, count(*) FILTER (y=0) AS n_neg, round({auc('y','score')},6) AS auc FROM (SELECT *, {mid_rank('score','project')} AS rk FROM scored) GROUP BY 1")
def roc_auc(spark, d):
    return tidy(ranking.roc_auc(tk.scored(spark, d), ["project"], "score", "label_delay"))


@query("roc_auc_documents", with_("docs") + f"SELECT lang, count(*) FILTER (quality=1) AS n_pos, count(*) FILTER (quality=0) AS n_neg, round({auc('quality','n_chars')},6) AS auc FROM (SELECT *, {mid_rank('n_chars','lang')} AS rk FROM docs) GROUP BY 1")
def roc_auc_documents(spark, d):
    return tidy(ranking.roc_auc(docs(spark, d), ["lang"], "n_chars", "quality"))


@query("roc_auc_overall", with_("scored") + f"SELECT count(*) FILTER (y=1) AS n_pos, count(*) FILTER (y=0) AS n_neg, round({auc('y','score')},6) AS auc FROM (SELECT *, {mid_rank('score')} AS rk FROM scored)")
def roc_auc_overall(spark, d):
    return tidy(ranking.roc_auc(tk.scored(spark, d), [], "score", "label_delay"))


@query("auc_within_group", with_("docs") + f", g AS (SELECT lang, count(*) FILTER (quality=1) AS p, count(*) FILTER (quality=0) AS n, {auc('quality','p')} AS a FROM (SELECT *, {mid_rank('p','lang')} AS rk FROM docs) GROUP BY 1) SELECT round(avg(a),6) AS auc_within, count(*) AS groups, round(sum(a*p*n)/sum(p*n),6) AS auc_pair_weighted FROM g WHERE p>=2 AND n>=2")
def auc_within_group(spark, d):
    return tidy(ranking.within_group_auc(docs(spark, d), "lang", "p", "quality", 2))


@query("average_precision", with_("scored") + """, c AS (SELECT project, score, count(*) FILTER (y=1) AS pos, count(*) AS n FROM scored GROUP BY 1,2), r AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS t FROM c WINDOW w AS (PARTITION BY project ORDER BY score DESC))
SELECT project, round(sum(pos*tp/t::DOUBLE)/sum(pos),6) AS average_precision FROM r GROUP BY 1""")
def average_precision(spark, d):
    return tidy(ranking.average_precision(tk.scored(spark, d), ["project"], "score", "label_delay"))


@query("brier", with_("scored") + "SELECT project, round(avg((score-y)*(score-y)),6) AS brier FROM scored GROUP BY 1")
def brier(spark, d):
    return tidy(metrics.brier(tk.scored(spark, d), ["project"], "label_delay", "score"))


@query("youden", with_("scored") + """, c AS (SELECT project, score, count(*) FILTER (y=1) AS pos, count(*) FILTER (y=0) AS neg FROM scored GROUP BY 1,2),
r AS (SELECT *, sum(pos) OVER (PARTITION BY project) AS p, sum(neg) OVER (PARTITION BY project) AS n, sum(pos) OVER w-pos AS pb, sum(neg) OVER w-neg AS nb FROM c WINDOW w AS (PARTITION BY project ORDER BY score)),
j AS (SELECT *, (p-pb)*greatest(n,1)+nb*greatest(p,1) AS g FROM r) SELECT project, score AS threshold, round(g/(greatest(p,1)*greatest(n,1)::DOUBLE)-1,6) AS youden_j FROM j QUALIFY row_number() OVER (PARTITION BY project ORDER BY g DESC, score)=1""")
def youden(spark, d):
    return tidy(ranking.youden_threshold(tk.scored(spark, d), ["project"], "score", "label_delay"))


@query("exact_quantiles", with_("scored") + "SELECT project, q AS prob, round(v,6) AS value FROM (SELECT project, unnest([0.1::DOUBLE,0.5,0.9]) AS q, unnest(quantile_cont(score,[0.1,0.5,0.9])) AS v FROM scored GROUP BY project)")
def exact_quantiles(spark, d):
    return tidy(ranking.exact_quantiles(tk.scored(spark, d), ["project"], "score", [0.1, 0.5, 0.9]))


@query("regression_metrics", with_("lab") + f"""SELECT project, count(*) AS n, round(corr(ra,rb),6) AS spearman, round(avg(abs(t-p)),6) AS mae, round(1-sum((t-p)*(t-p))/(var_pop(t)*count(*)),6) AS r2
FROM (SELECT project, late_capped AS t, (k%13)::DOUBLE AS p, {mid_rank('late_capped','project')} AS ra, {mid_rank('k%13','project')} AS rb FROM lab) GROUP BY 1""")
def regression_metrics(spark, d):
    f = tk.labelled(spark, d).withColumn("forecast", (F.col("raw_sprint_id") % 13).cast("double"))
    return tidy(metrics.regression_metrics(f, ["project"], "late_days_capped", "forecast"))


_IV = "floor(committed*0.3::DOUBLE) AS lo, committed*0.5::DOUBLE AS mid, ceil(committed*0.8::DOUBLE) AS hi, completed AS t"


@query("interval_quality", with_("lab") + f"""SELECT project, count(*) AS n, round(avg((t>=lo AND t<=hi)::INT),6) AS coverage, round(avg(hi-lo),6) AS width, round(avg(abs(t-mid)),6) AS mae_median,
 round(avg((greatest(0.1*(t-lo),-0.9*(t-lo))+greatest(0.5*(t-mid),-0.5*(t-mid))+greatest(0.9*(t-hi),-0.1*(t-hi)))/3),6) AS mean_pinball, round(avg((t>=lo AND t<=hi)::INT) FILTER (committed<=3),6) AS coverage_small,
 round(avg((t>=lo AND t<=hi)::INT) FILTER (committed>3 AND committed<=12),6) AS coverage_medium, round(avg((t>=lo AND t<=hi)::INT) FILTER (committed>12),6) AS coverage_large FROM (SELECT *, {_IV} FROM lab WHERE nonempty) GROUP BY 1""")
def interval_quality(spark, d):
    n = F.col("committed_issue_count")
    f = tk.labelled(spark, d).where("nonempty").withColumns({"lo": F.floor(n * 0.3).cast("double"), "mid": n * 0.5, "hi": F.ceil(n * 0.8).cast("double"), "t": F.col("completed_issue_count").cast("double")})
    return tidy(metrics.interval_quality(f, "t", "lo", "mid", "hi", "committed_issue_count", ["project"]))


@query("calibration_uniform", with_("docs") + "SELECT lang, least(floor(p*10),9)::BIGINT AS bin, count(*) AS n, round(avg(p),6) AS mean_predicted, round(avg(quality),6) AS observed_rate FROM docs GROUP BY 1,2")
def calibration_uniform(spark, d):
    return tidy(metrics.calibration_uniform(docs(spark, d), "p", "quality", 10, ["lang"]))


@query("calibration_quartiles", with_("scored") + "SELECT greatest(0,ceil((r-1)*4.0::DOUBLE/(n-1))-1)::BIGINT AS bin, count(*) AS n, round(avg(score),6) AS mean_predicted, round(avg(y),6) AS observed_rate FROM (SELECT *, row_number() OVER (ORDER BY score, sprint_id) AS r, count(*) OVER () AS n FROM scored) GROUP BY 1")
def calibration_quartiles(spark, d):
    return tidy(metrics.calibration_quartiles(tk.scored(spark, d), "score", "label_delay", [F.col("sprint_id")]))


def grid_sql(frm, key, score, y):
    """CTEs up to ``grid`` (key, step, fpr, tpr): ROC points joined to an even grid from both sides."""
    return f""", c AS (SELECT {key}, {score} AS s, count(*) FILTER ({y}=1) AS pos, count(*) FILTER ({y}=0) AS neg FROM {frm} GROUP BY 1,2),
rr AS (SELECT {key}, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {key}) AS p, sum(neg) OVER (PARTITION BY {key}) AS n FROM c WINDOW w AS (PARTITION BY {key} ORDER BY s DESC)),
pt AS (SELECT {key}, fp/n::DOUBLE AS x, max(tp/p::DOUBLE) AS top, min(tp/p::DOUBLE) AS bot FROM (SELECT {key}, tp, fp, p, n FROM rr UNION ALL SELECT DISTINCT {key}, 0, 0, p, n FROM rr) WHERE p>0 AND n>0 GROUP BY 1,2),
g AS (SELECT DISTINCT {key}, i AS step, i/200.0::DOUBLE AS fpr FROM pt, range(201) t(i)),
lo AS (SELECT g.{key}, g.step, g.fpr, pt.x AS x0, pt.top AS y0 FROM g ASOF JOIN pt ON g.{key}=pt.{key} AND g.fpr>=pt.x),
hi AS (SELECT g.{key}, g.step, pt.x AS x1, pt.bot AS y1 FROM g ASOF LEFT JOIN pt ON g.{key}=pt.{key} AND g.fpr<pt.x),
grid AS (SELECT {key}, step, fpr, CASE WHEN step=0 THEN 0.0 WHEN x1 IS NULL THEN y0 ELSE y0+(fpr-x0)/(x1-x0)*(y1-y0) END AS tpr FROM lo JOIN hi USING ({key}, step))
"""


@query("roc_grid", with_("scored") + grid_sql("scored", "project", "score", "y") + "SELECT project, step, fpr, round(tpr,6) AS tpr FROM grid")
def roc_grid(spark, d):
    return tidy(ranking.roc_grid(tk.scored(spark, d), ["project"], "score", "label_delay"))


@query("roc_band", with_("scored") + grid_sql("scored", "project", "score", "y") + "SELECT step, fpr, round(avg(tpr),6) AS tpr_mean, round(stddev_samp(tpr),6) AS tpr_sd, count(*) AS curves FROM grid GROUP BY 1,2")
def roc_band(spark, d):
    return tidy(ranking.roc_band(ranking.roc_grid(tk.scored(spark, d), ["project"], "score", "label_delay")))


@query("mid_ranks", with_("scored") + f"SELECT DISTINCT project, committed AS value, count(*) OVER (PARTITION BY project, committed) AS times, {mid_rank('committed','project')} AS rank FROM scored")
def mid_ranks(spark, d):
    return tidy(ranking.mid_ranks(tk.scored(spark, d), ["project"], "committed_issue_count"))


@query("mann_whitney", with_("scored") + f""", f AS (SELECT *, CASE WHEN y=0 THEN 1 ELSE 0 END AS a FROM scored WHERE pred=1), lg AS (SELECT 'committed' AS feature, a, committed::DOUBLE AS v FROM f UNION ALL SELECT 'points', a, points FROM f UNION ALL SELECT 'length', a, len FROM f),
r AS (SELECT *, {mid_rank('v','feature')} AS rk FROM lg), t AS (SELECT feature, sum(c*c*c-c) AS ties FROM (SELECT feature, v, count(*)::DOUBLE AS c FROM lg GROUP BY 1,2) GROUP BY 1),
u AS (SELECT feature, count(*) FILTER (a=1) AS n1, count(*) FILTER (a=0) AS n2, sum(rk) FILTER (a=1)-count(*) FILTER (a=1)*(count(*) FILTER (a=1)+1)/2.0::DOUBLE AS u FROM r GROUP BY 1)
, z AS (SELECT *, (greatest(u, n1*n2::DOUBLE-u)-n1*n2::DOUBLE/2-0.5)/sqrt(n1*n2::DOUBLE/12*((n1+n2+1)-ties/((n1+n2)*(n1+n2-1)::DOUBLE))) AS z FROM u JOIN t USING (feature)), k AS (SELECT *, 1/(1+0.2316419::DOUBLE*abs(z)) AS k FROM z),
q AS (SELECT *, k*(0.319381530::DOUBLE+k*(-0.356563782::DOUBLE+k*(1.781477937::DOUBLE+k*(-1.821255978::DOUBLE+k*1.330274429::DOUBLE))))*exp(-z*z/2)/sqrt(2*pi()) AS q FROM k)
SELECT feature, n1 AS n_first, n2 AS n_second, u AS u_stat, round(z,6) AS z, round(least(1.0::DOUBLE, 2*CASE WHEN z>=0 THEN q ELSE 1-q END),6) AS p_value FROM q""")
def mann_whitney(spark, d):
    """Feature profiles of false positives against true positives."""
    f = tk.scored(spark, d).where(F.col("pred") == 1)
    cells = {"committed": "committed_issue_count", "points": "committed_story_points", "length": "sprint_length_days"}
    arr = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(c).cast("double").alias("v")) for n, c in cells.items()])
    long = f.select("label_delay", F.explode(arr).alias("x")).select("label_delay", "x.*")
    return tidy(ranking.mann_whitney(long, ["feature"], "v", F.col("label_delay") == 0, F.col("label_delay") == 1))


@query("interpretable", with_("docs") + "SELECT lang, source, count(*) FILTER (quality=1)>=5 AND count(*) FILTER (quality=0)>=5 AS interpretable FROM docs JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY 1,2")
def interpretable(spark, d):
    f = docs(spark, d).join(tk.load(spark, d, "documents").select("doc_id", "source"), "doc_id")
    m = metrics.interpretable(metrics.confusion_metrics(f, ["lang", "source"], "quality", "call"))
    return m.select("lang", "source", "interpretable")


@query("mean_sd", with_("scored") + f"SELECT count(*) AS repeats, round(avg(a),6) AS auc_mean, round(stddev_samp(a),6) AS auc_sd FROM (SELECT project, {auc('y','score')} AS a FROM (SELECT *, {mid_rank('score','project')} AS rk FROM scored) GROUP BY 1)")
def mean_sd(spark, d):
    return tidy(metrics.mean_sd(ranking.roc_auc(tk.scored(spark, d), ["project"], "score", "label_delay"), [], ["auc"]))


# ------------------------------------------------------------------ resampling
TREE_LEVELS = 11  # of the splitting trees written out in SQL: 2,048 cells


def boot_sql(frm, keep, strata=None, reps=REPS, seed="'42'"):
    """Resampled rows ``bs``: multinomial counts per distinct row, split down a binary tree by binomial numbers.

    A binomial number is the first, from the mode outwards, at which the summed probabilities pass the md5 of seed, stratum,
    level, replicate and node.
    """
    g = f"{strata}, " if strata else ""
    part = f"PARTITION BY {strata}" if strata else ""
    on = f"USING ({strata})" if strata else "ON TRUE"
    key = "||chr(124)||".join([seed, *([f"{strata}::VARCHAR"] if strata else []), "'0'", "r", "lo", "hi"])
    out = [f"""cl AS MATERIALIZED (SELECT *, row_number() OVER ({part} ORDER BY {', '.join(c.strip() + ' NULLS FIRST' for c in keep.split(','))}) - 1 AS i FROM (SELECT {g}{keep}, count(*) AS w FROM {frm} GROUP BY ALL))""",
           f"ar AS MATERIALIZED (SELECT {g}list(cw ORDER BY i) AS a, count(*) AS c, CAST(sum(w) AS BIGINT) AS nn FROM (SELECT *, CAST(sum(w) OVER ({part} ORDER BY i) AS BIGINT) AS cw FROM cl) {'GROUP BY ' + strata if strata else ''})",
           f"b0 AS (SELECT r, {g}CAST(0 AS BIGINT) AS lo, c AS hi, nn AS n FROM ar, range({reps}) t(r))"]
    w = lambda lo, hi: f"(a[{hi}] - CASE WHEN {lo}=0 THEN 0 ELSE a[{lo}] END)"
    for k in range(TREE_LEVELS):
        out += [
            f"x{k} AS (SELECT r, {g}lo, hi, n, mid, p, least(floor((n+1)*p), n)::BIGINT AS m, u, ceil(10*sqrt(n*p*(1-p)))::BIGINT+10 AS reach FROM (SELECT b.*, (lo+hi)//2 AS mid, {w('lo', '(lo+hi)//2')}::DOUBLE/{w('lo', 'hi')} AS p, ('0x'||substr(md5({key}),1,15))::BIGINT/1152921504606846976.0::DOUBLE AS u FROM b{k} b JOIN ar {on} WHERE hi-lo>1))",
            f"y{k} AS (SELECT *, abs(k-m)*2+(k<m)::INT AS o, sum(exp(lgamma(n+1.0::DOUBLE)-lgamma(k+1.0::DOUBLE)-lgamma(n-k+1.0::DOUBLE)+k*ln(p)+(n-k)*ln(1-p))) OVER (PARTITION BY r, {g}lo ORDER BY abs(k-m)*2+(k<m)::INT) AS cum FROM (SELECT *, unnest(range(greatest(m-reach,0), least(m+reach,n)+1)) AS k FROM x{k}))",
            f"z{k} AS MATERIALIZED (SELECT r, {g}lo, any_value(hi) AS hi, any_value(mid) AS mid, any_value(n) AS n, coalesce(arg_min(k, o) FILTER (cum>u), arg_max(k, o)) AS l FROM y{k} GROUP BY r, {g}lo)",
            f"b{k + 1} AS (SELECT r, {g}lo, hi, n FROM b{k} WHERE hi-lo=1 UNION ALL SELECT r, {g}lo, mid, l FROM z{k} WHERE l>0 UNION ALL SELECT r, {g}mid, hi, n-l FROM z{k} WHERE n-l>0)"]
    join = f"cl.{strata}=b.{strata} AND " if strata else ""
    out.append(f"bs AS (SELECT r, {('b.' + strata + ', ') if strata else ''}{keep} FROM (SELECT *, unnest(range(n)) AS copy FROM b{TREE_LEVELS}) b JOIN cl ON {join}cl.i=b.lo)")
    return ", " + ",\n".join(out) + "\n"


def ci(v="v"):
    return f"count(*) AS replicates, round(avg({v}),6) AS mean, round(quantile_cont({v},0.025),6) AS lo, round(quantile_cont({v},0.975),6) AS hi"


@query("bootstrap_rows", with_("docs") + boot_sql("docs", "p, quality") + f", a AS (SELECT r, {auc('quality','p')} AS v FROM (SELECT *, {mid_rank('p','r')} AS rk FROM bs) GROUP BY 1) SELECT {ci()} FROM a WHERE v IS NOT NULL")
def bootstrap_rows(spark, d):
    return tidy(resample.row_bootstrap_auc(docs(spark, d), "p", "quality", REPS))


@query("bootstrap_metrics", with_("docs") + boot_sql("docs", "p, call, quality") + f""", a AS (SELECT r, {auc('quality','p')} AS auc, 2*count(*) FILTER (quality=1 AND call=1)/(2*count(*) FILTER (quality=1 AND call=1)+count(*) FILTER (quality<>call))::DOUBLE AS f1,
 count(*) FILTER (quality=1 AND call=1)/nullif(count(*) FILTER (quality=1),0)::DOUBLE AS sensitivity, count(*) FILTER (quality=0 AND call=0)/nullif(count(*) FILTER (quality=0),0)::DOUBLE AS specificity, avg((p-quality)*(p-quality)) AS brier FROM (SELECT *, {mid_rank('p','r')} AS rk FROM bs) GROUP BY 1),
ap AS (SELECT r, sum(pos*tp/(tp+fp))/sum(pos) AS average_precision FROM (SELECT r, pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (SELECT r, p, count(*) FILTER (quality=1)::DOUBLE AS pos, count(*) FILTER (quality=0)::DOUBLE AS neg FROM bs GROUP BY 1,2) WINDOW w AS (PARTITION BY r ORDER BY p DESC)) GROUP BY 1), aa AS (SELECT a.*, average_precision FROM a JOIN ap USING (r))
SELECT metric, {ci('value')} FROM (UNPIVOT aa ON auc, average_precision, f1, sensitivity, specificity, brier INTO NAME metric VALUE value) GROUP BY 1""")
def bootstrap_metrics(spark, d):
    return tidy(resample.row_bootstrap_metrics(docs(spark, d), "p", "call", "quality", REPS))


def _sign(obs, rep):
    return f"""SELECT round(o,6) AS observed, count(*) AS replicates, round(avg(v),6) AS mean, round(quantile_cont(v,0.025),6) AS lo, round(quantile_cont(v,0.975),6) AS hi, round(avg((v<=0)::INT),6) AS share_le_0,
 round(least(1.0::DOUBLE,2*avg((CASE WHEN o>=0 THEN v<=0 ELSE v>=0 END)::INT)),6) AS p_two_sided FROM {rep}, {obs} WHERE v IS NOT NULL GROUP BY o"""


@query("bootstrap_paired", with_("docs") + boot_sql("docs", "p, n_chars, quality") + f""", rep AS (SELECT a.r, b.v-a.v AS v FROM (SELECT r, {auc('quality','p')} AS v FROM (SELECT *, {mid_rank('p','r')} AS rk FROM bs) GROUP BY 1) a JOIN (SELECT r, {auc('quality','n_chars')} AS v FROM (SELECT *, {mid_rank('n_chars','r')} AS rk FROM bs) GROUP BY 1) b USING (r)),
ob AS (SELECT (SELECT {auc('quality','n')} FROM (SELECT *, {mid_rank('n_chars')} AS rk FROM docs))-(SELECT {auc('quality','p')} FROM (SELECT *, {mid_rank('p')} AS rk FROM docs)) AS o)
""" + _sign("ob", "rep"))
def bootstrap_paired(spark, d):
    return tidy(resample.paired_bootstrap(docs(spark, d), "p", "n_chars", "quality", REPS))


@query("bootstrap_stratified", with_("docs") + boot_sql("docs", "p, quality", "lang") + f", a AS (SELECT r, lang, {auc('quality','p')} AS v FROM (SELECT *, {mid_rank('p','r, lang')} AS rk FROM bs) GROUP BY 1,2), m AS (SELECT r, avg(v) AS v FROM a WHERE v IS NOT NULL GROUP BY 1) SELECT {ci()} FROM m")
def bootstrap_stratified(spark, d):
    return tidy(resample.within_group_bootstrap(docs(spark, d), "lang", "p", "quality", REPS))


_DRAWS = lambda t: """, g AS (SELECT project, row_number() OVER (ORDER BY project) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT project FROM """ + t + """)),
dr AS (SELECT r, project FROM (SELECT r, """ + draw("n", "'42'", "r", "i") + """+1 AS rn FROM (SELECT DISTINCT n FROM g), range(2000) a(r), range(8) b(i) WHERE i<n) JOIN g USING (rn)),
tm AS (SELECT r, project, count(*) AS times FROM dr GROUP BY 1,2)
"""
_CL = _DRAWS("scored")
# AUC of a cluster resample from weighted score cells
_CLA = lambda s: f"""(SELECT r, sum(wp*(below+wn/2.0::DOUBLE))/(sum(wp)*sum(wn)::DOUBLE) AS v FROM (SELECT *, coalesce(sum(wn) OVER (PARTITION BY r ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::DOUBLE AS below FROM
 (SELECT r, {s} AS s, CAST(sum(times*c) FILTER (y=1) AS DOUBLE) AS wp0, coalesce(sum(times*c) FILTER (y=1),0)::DOUBLE AS wp, coalesce(sum(times*c) FILTER (y=0),0)::DOUBLE AS wn FROM tm JOIN (SELECT project, {s}, y, count(*) AS c FROM scored GROUP BY 1,2,3) USING (project) GROUP BY 1,2)) GROUP BY 1)"""


@query("bootstrap_cluster", with_("scored") + _CL + f"SELECT {ci()} FROM {_CLA('score')}")
def bootstrap_cluster(spark, d):
    return tidy(resample.cluster_bootstrap_auc(tk.scored(spark, d), "project", "score", "label_delay", 2000))


@query("bootstrap_cluster_paired", with_("scored") + _CL + f", rep AS (SELECT b.v-a.v AS v FROM {_CLA('score')} a JOIN {_CLA('score_b')} b USING (r)), ob AS (SELECT (SELECT {auc('y','score_b')} FROM (SELECT *, {mid_rank('score_b')} AS rk FROM scored))-(SELECT {auc('y','score')} FROM (SELECT *, {mid_rank('score')} AS rk FROM scored)) AS o) " + _sign("ob", "rep"))
def bootstrap_cluster_paired(spark, d):
    return tidy(resample.cluster_paired(tk.scored(spark, d), "project", "score", "score_b", "label_delay", 2000))


@query("bootstrap_cluster_share", with_("scored") + _CL + f", s AS (SELECT project, count(*) FILTER (pred=1) AS h, count(*) AS c FROM scored GROUP BY 1), m AS (SELECT r, sum(h*times)/sum(c*times)::DOUBLE AS v FROM tm JOIN s USING (project) GROUP BY 1) SELECT {ci()} FROM m")
def bootstrap_cluster_share(spark, d):
    return tidy(resample.cluster_bootstrap_share(tk.scored(spark, d), "project", F.col("pred") == 1, 2000))


@query("bootstrap_cluster_mae", with_("scored") + _CL + f", s AS (SELECT project, sum(abs(late_capped-score*10)) AS ea, sum(abs(late_capped-score_b*10)) AS eb, count(*) AS c FROM scored GROUP BY 1), m AS (SELECT r, (sum(eb*times)-sum(ea*times))/sum(c*times)::DOUBLE AS v FROM tm JOIN s USING (project) GROUP BY 1) SELECT {ci()} FROM m")
def bootstrap_cluster_mae(spark, d):
    f = tk.scored(spark, d).withColumns({"fa": F.col("score") * 10, "fb": F.col("score_b") * 10})
    return tidy(resample.cluster_mae_difference(f, "project", "late_days_capped", "fa", "fb", 2000))


@query("jackknife_group", with_("scored") + f", o AS (SELECT DISTINCT project AS left_out FROM scored) SELECT left_out, count(*) FILTER (y=1) AS n_pos, count(*) FILTER (y=0) AS n_neg, round({auc('y','score')},6) AS auc FROM (SELECT left_out, y, {mid_rank('score','left_out')} AS rk FROM scored JOIN o ON project<>left_out) GROUP BY 1")
def jackknife_group(spark, d):
    return tidy(resample.jackknife_auc(tk.scored(spark, d), "project", "score", "label_delay"))


_F1 = lambda p, w="": f"2*count(*) FILTER (y=1 AND {p}=1{w})/nullif(count(*) FILTER (y=1{w})+count(*) FILTER ({p}=1{w}),0)::DOUBLE"


@query("jackknife_f1", with_("scored") + f""", o AS (SELECT project AS left_out, count(*) AS n_excluded FROM scored GROUP BY 1),
d AS (SELECT left_out, n_excluded, coalesce({_F1('pred_b')},0)-coalesce({_F1('pred')},0) AS f1_delta FROM scored JOIN o ON project<>left_out GROUP BY 1,2),
f AS (SELECT coalesce({_F1('pred_b')},0)-coalesce({_F1('pred')},0) AS full_delta FROM scored)
SELECT left_out, n_excluded, round(f1_delta,6) AS f1_delta, round(full_delta,6) AS full_delta, round(min(f1_delta) OVER (),6) AS delta_min, round(max(f1_delta) OVER (),6) AS delta_max, round(max(f1_delta) OVER ()-min(f1_delta) OVER (),6) AS delta_range FROM d, f""")
def jackknife_f1(spark, d):
    """F1 of two callers without each project."""
    return tidy(resample.jackknife_f1_difference(tk.scored(spark, d), "project", "label_delay", "pred", "pred_b"))


@query("bootstrap_by_group", with_("docs") + boot_sql("docs", "p, quality", "lang") + f", a AS (SELECT r, lang, {auc('quality','p')} AS v FROM (SELECT *, {mid_rank('p','r, lang')} AS rk FROM bs) GROUP BY 1,2) SELECT lang, {ci()} FROM a WHERE v IS NOT NULL GROUP BY 1")
def bootstrap_by_group(spark, d):
    return tidy(resample.row_bootstrap_by(docs(spark, d), ["lang"], "p", "quality", REPS))


@query("bootstrap_paired_by_group", with_("docs") + boot_sql("docs", "p, call, quality", "lang") + f""", rep AS (SELECT lang, a.v-b.v AS v FROM (SELECT r, lang, {auc('quality','call')} AS v FROM (SELECT *, {mid_rank('call','r, lang')} AS rk FROM bs) GROUP BY 1,2) a JOIN (SELECT r, lang, {auc('quality','p')} AS v FROM (SELECT *, {mid_rank('p','r, lang')} AS rk FROM bs) GROUP BY 1,2) b USING (r, lang)),
ob AS (SELECT lang, a.o-b.o AS o FROM (SELECT lang, {auc('quality','call')} AS o FROM (SELECT *, {mid_rank('call','lang')} AS rk FROM docs) GROUP BY 1) a JOIN (SELECT lang, {auc('quality','p')} AS o FROM (SELECT *, {mid_rank('p','lang')} AS rk FROM docs) GROUP BY 1) b USING (lang))
SELECT lang, round(o,6) AS observed, count(*) AS replicates, round(avg(v),6) AS mean, round(quantile_cont(v,0.025),6) AS lo, round(quantile_cont(v,0.975),6) AS hi, round(avg((v<=0)::INT),6) AS share_le_0,
 round(least(1.0::DOUBLE,2*avg((CASE WHEN o>=0 THEN v<=0 ELSE v>=0 END)::INT)),6) AS p_two_sided FROM rep JOIN ob USING (lang) WHERE v IS NOT NULL GROUP BY lang, o""")
def bootstrap_paired_by_group(spark, d):
    return tidy(resample.paired_bootstrap_by(docs(spark, d), ["lang"], "p", "call", "quality", REPS))


@query("follow_interval", with_("study") + _DRAWS("study") + ", s AS (SELECT project, count(*) FILTER (G1_warn=1-m_warn) AS h, count(*) AS c FROM study WHERE checkpoint=0.5 GROUP BY 1), m AS (SELECT r, sum(h*times)/sum(c*times)::DOUBLE AS v FROM tm JOIN s USING (project) GROUP BY 1) SELECT " + ci() + " FROM m")
def follow_interval(spark, d):
    """Interval of the share of calls that follow the flipped verdict, by resampled projects."""
    s = tk.study(spark, d).where("checkpoint = 0.5")
    return tidy(resample.cluster_bootstrap_share(s, "project", F.col("G1_warn") == 1 - F.col("m_warn"), 2000))


@query("roc_bootstrap_band", with_("docs") + boot_sql("docs", "p, quality") + grid_sql("bs", "r", "p", "quality") + "SELECT step, fpr, round(avg(tpr),6) AS tpr_mean, round(quantile_cont(tpr,0.025),6) AS tpr_lo, round(quantile_cont(tpr,0.975),6) AS tpr_hi FROM grid GROUP BY 1,2")
def roc_bootstrap_band(spark, d):
    return tidy(resample.roc_bootstrap_band(docs(spark, d), "p", "quality", REPS))


# ------------------------------------------------------------------ agreement
def kappa_sql(frm, a, b, keys, agree="agreement", kap="kappa"):
    pe = "(pa*pb+(1-pa)*(1-pb))"
    return f"SELECT {keys}, n, round(po,6) AS {agree}, round(CASE WHEN {pe}<1 THEN (po-{pe})/(1-{pe}) END,6) AS {kap} FROM (SELECT {keys}, count(*) AS n, avg(({a}={b})::INT) AS po, avg({a}) AS pa, avg({b}) AS pb FROM {frm} GROUP BY {keys})"


@query("cohen_kappa", with_("docs") + kappa_sql("docs", "quality", "call", "lang"))
def cohen_kappa(spark, d):
    return tidy(ag.cohen_kappa(docs(spark, d), "quality", "call", ["lang"]))


@query("fleiss_kappa", with_("study") + "SELECT checkpoint, n, round((p-pe)/(1-pe),6) AS fleiss_kappa FROM (SELECT *, q*q+(1-q)*(1-q) AS pe FROM (SELECT checkpoint, count(*) AS n, avg((s*(s-1)+(3-s)*(2-s))/6.0::DOUBLE) AS p, avg(s/3.0::DOUBLE) AS q FROM (SELECT checkpoint, L1_warn+L2_warn+L3_warn AS s FROM study) GROUP BY 1))")
def fleiss_kappa(spark, d):
    return tidy(ag.fleiss_kappa(tk.study(spark, d), ["L1_warn", "L2_warn", "L3_warn"], ["checkpoint"]))


@query("departures", with_("study") + "SELECT checkpoint, count(*) AS points, count(*) FILTER (G1_warn<>m_warn) AS departures, count(*) FILTER (G1_warn<>m_warn AND G1_warn=late) AS correct, count(*) FILTER (G1_warn<>m_warn AND G1_warn=0) AS to_silent, count(*) FILTER (G1_warn<>m_warn AND G1_warn=1) AS to_warn FROM study GROUP BY 1")
def departures(spark, d):
    return ag.departures(tk.study(spark, d), "G1_warn", "m_warn", "late", ["checkpoint"])


_CALLS = ["m_warn", "L1_warn", "G1_warn"]


@query("call_changes", with_("study") + " UNION ALL ".join(f"SELECT '{c}' AS caller, count(*) FILTER (a.{c}<>b.{c}) AS changed, count(*) AS items FROM study a JOIN study b ON a.sprint_id=b.sprint_id AND a.checkpoint=0 AND b.checkpoint=0.5" for c in _CALLS))
def call_changes(spark, d):
    return ag.call_changes(tk.study(spark, d), "sprint_id", "checkpoint", _CALLS, 0.0, 0.5)


@query("run_stability", with_("study") + "SELECT checkpoint, round(avg((G1_warn=G2_warn AND G2_warn=G3_warn)::INT),6) AS same_call, round(avg(list_aggregate([G1_p,G2_p,G3_p],'stddev_samp')),6) AS mean_sd FROM study GROUP BY 1")
def run_stability(spark, d):
    return tidy(ag.run_stability(tk.study(spark, d), ["G1_warn", "G2_warn", "G3_warn"], ["G1_p", "G2_p", "G3_p"], ["checkpoint"]))


@query("rater_flags", with_("docs") + "SELECT lang, call, count(*) AS n, count(*) FILTER (quality=1) AS a_flags, count(*) FILTER (toxic=1) AS b_flags, count(*) FILTER (quality=1 AND toxic=1) AS both, count(*) FILTER (quality=1 OR toxic=1) AS either FROM docs GROUP BY CUBE(lang, call)")
def rater_flags(spark, d):
    return tidy(ag.rater_flags(docs(spark, d), "quality", "toxic", ["lang", "call"]))


@query("follow_rate", with_("study") + "SELECT checkpoint, count(*) AS n, round(avg((G1_warn=1-m_warn)::INT),6) AS follow, count(*) FILTER (m_warn=late) AS n_right, round(avg((G1_warn=1-m_warn)::INT) FILTER (m_warn=late),6) AS follow_when_right, count(*) FILTER (m_warn<>late) AS n_wrong, round(avg((G1_warn=1-m_warn)::INT) FILTER (m_warn<>late),6) AS follow_when_wrong FROM study GROUP BY 1")
def follow_rate(spark, d):
    s = tk.study(spark, d).withColumn("shown", 1 - F.col("m_warn"))
    return tidy(ag.follow_rate(s, "G1_warn", "shown", "m_warn", "late", ["checkpoint"]))


def long_arms(spark, d):
    """Replay points as rows per run and arm."""
    s = tk.study(spark, d)
    keys = ["sprint_id", "project", "checkpoint", "late", "m_warn", "unfinished", "weight"]
    out = ag.arms_long(s, {"M": ("m_warn", "m_score", "m_unf")}, keys).withColumn("run", F.lit(0))
    for r in tk.RUNS:
        out = out.unionByName(ag.arms_long(s, {a: (f"{a}{r}_warn", f"{a}{r}_p", f"{a}{r}_unf") for a in "LG"}, keys).withColumn("run", F.lit(r)))
    return out


_LONG = ", arms AS (" + " UNION ALL ".join(
    ["SELECT sprint_id, project, checkpoint, late, m_warn AS mw, unfinished, 0 AS run, 'M' AS arm, m_warn AS warn, m_score AS p, m_unf AS unf FROM study"]
    + [f"SELECT sprint_id, project, checkpoint, late, m_warn, unfinished, {r}, '{a}', {a}{r}_warn, {a}{r}_p, {a}{r}_unf FROM study" for r in (1, 2, 3) for a in "LG"]) + ")\n"


@query("arm_metrics", with_("study") + _LONG + f""", k3 AS (SELECT *, {mid_rank('p','run, arm, checkpoint')} AS rk, {mid_rank('p','run, arm, checkpoint, project')} AS rkg, {mid_rank('unf','run, arm, checkpoint')} AS ru, {mid_rank('unfinished','run, arm, checkpoint')} AS rt FROM arms),
g AS (SELECT run, arm, checkpoint, avg(a) AS auc_within FROM (SELECT run, arm, checkpoint, project, count(*) FILTER (late=1) AS np, count(*) FILTER (late=0) AS nn, {auc('late','p')} AS a FROM (SELECT run, arm, checkpoint, project, late, rkg AS rk FROM k3) GROUP BY 1,2,3,4) WHERE np>=2 AND nn>=2 GROUP BY 1,2,3),
b AS (SELECT run, arm, checkpoint, avg(warn) AS warn_rate, avg(p) AS mean_p, avg(late) AS late_rate, avg((p-late)*(p-late)) AS brier, avg(abs(unf-unfinished)) AS unf_mae, avg(warn) FILTER (late=1) AS sensitivity, 1-avg(warn) FILTER (late=0) AS specificity,
 2*count(*) FILTER (warn=1 AND late=1)/(2*count(*) FILTER (warn=1 AND late=1)+count(*) FILTER (warn<>late))::DOUBLE AS f1, {auc('late','p')} AS auc, avg((warn=mw)::INT) AS agree_m, avg(mw) AS pm, corr(ru,rt) AS unf_spearman FROM k3 GROUP BY 1,2,3)
SELECT run, arm, checkpoint, """ + ", ".join(f"round({c},6) AS {c}" for c in ("warn_rate", "mean_p", "late_rate", "brier", "unf_mae", "sensitivity", "specificity", "f1", "auc", "auc_within", "agree_m", "unf_spearman")) + """,
 round(CASE WHEN warn_rate*pm+(1-warn_rate)*(1-pm)<1 THEN (agree_m-(warn_rate*pm+(1-warn_rate)*(1-pm)))/(1-(warn_rate*pm+(1-warn_rate)*(1-pm))) END,6) AS kappa_m FROM b JOIN g USING (run, arm, checkpoint)""")
def arm_metrics(spark, d):
    return tidy(ag.arm_metrics(long_arms(spark, d), "project"))


@query("arms_wide", with_("study") + "SELECT sprint_id, checkpoint, L1_warn, L1_p, G1_warn, G1_p, L2_warn, L2_p, G2_warn, G2_p, L3_warn, L3_p, G3_warn, G3_p FROM study")
def arms_wide(spark, d):
    long = long_arms(spark, d).withColumn("arm", F.concat("arm", F.col("run").cast("string")))
    return tidy(ag.arms_wide(long, ["sprint_id", "checkpoint"], "arm", [f"{a}{r}" for r in (1, 2, 3) for a in "LG"], ["warn", "p"]))


@query("arm_ranges", with_("study") + _LONG + "SELECT arm, checkpoint, round(avg(w),6) AS mean, round(min(w),6) AS lo, round(max(w),6) AS hi FROM (SELECT run, arm, checkpoint, avg(warn) AS w FROM arms GROUP BY 1,2,3) GROUP BY 1,2")
def arm_ranges(spark, d):
    per = long_arms(spark, d).groupBy("run", "arm", "checkpoint").agg(F.avg(F.col("warn").cast("double")).alias("w"))
    return tidy(per.groupBy("arm", "checkpoint").agg(F.avg("w").alias("mean"), F.min("w").alias("lo"), F.max("w").alias("hi")))


# ------------------------------------------------------------------ cost
_ARMS = {"M": "m_warn", "rule": "rule_warn", "L": "L1_warn", "G": "G1_warn"}
_W = ", w AS (" + " UNION ALL ".join(
    f"SELECT a.sprint_id, a.project, a.late, a.weight, '{n}' AS arm, a.{c} AS w0, b.{c} AS w5 FROM study a JOIN study b ON a.sprint_id=b.sprint_id AND a.checkpoint=0 AND b.checkpoint=0.5" for n, c in _ARMS.items()) + """),
wf AS (SELECT * FROM w UNION ALL SELECT sprint_id, project, late, weight, 'never', 0, 0 FROM w WHERE arm='M' UNION ALL SELECT sprint_id, project, late, weight, 'always', 1, 1 FROM w WHERE arm='M')
"""
_COST = lambda r, e0, e5: f"({r}*(CASE WHEN w0+w5>0 THEN 1 ELSE 0 END)+late*(1-CASE WHEN w0>0 THEN {e0} WHEN w5>0 THEN {e5} ELSE 0.0 END))"


def calls(spark, d, fixed=True):
    s = tk.study(spark, d).withColumnsRenamed({c: n for n, c in _ARMS.items()})
    c = cost.sprint_calls(s, list(_ARMS))
    return cost.with_fixed_policies(c, "M") if fixed else c


@query("alarm_cost_curve", with_("study") + _W + f"SELECT arm, ratio, round(sum(weight*{_COST('ratio','0.5::DOUBLE','0.25::DOUBLE')})/sum(weight),6) AS cost FROM w, (VALUES (0.02::DOUBLE),(0.05),(0.1),(0.2),(0.3),(0.5)) v(ratio) GROUP BY 1,2")
def alarm_cost_curve(spark, d):
    return tidy(cost.cost_curve(calls(spark, d, fixed=False)))


_SCEN = "(VALUES ('zero',0.0::DOUBLE,0.0::DOUBLE),('default',0.5,0.25),('strong',0.8,0.5)) s(scenario,e0,e5)"


@query("cost_scenarios", with_("study") + _W + f", c AS (SELECT scenario, ratio, arm, sum(weight*{_COST('ratio','e0','e5')})/sum(weight) AS cost FROM wf, {_SCEN}, (VALUES (0.02::DOUBLE),(0.1),(0.5)) v(ratio) GROUP BY 1,2,3) SELECT scenario, ratio, arm, round(cost,6) AS cost, first_value(arm) OVER (PARTITION BY scenario, ratio ORDER BY round(cost,12), arm) AS cheapest FROM c")
def cost_scenarios(spark, d):
    return tidy(cost.cost_scenarios(calls(spark, d)))


@query("winning_band", with_("study") + _W + f", c AS (SELECT scenario, i, round(i*0.01,2)::DOUBLE AS ratio, arm, sum(weight*{_COST('round(i*0.01,2)::DOUBLE','e0','e5')})/sum(weight) AS cost FROM wf, {_SCEN}, range(1,61) v(i) GROUP BY 1,2,4), t AS (SELECT scenario, i, min(cost) AS t FROM c WHERE arm IN ('never','always') GROUP BY 1,2) SELECT scenario, arm, min(ratio) AS ratio_from, max(ratio) AS ratio_to, count(*) AS wins, max(i)-min(i)+1=count(*) AS contiguous FROM c JOIN t USING (scenario, i) WHERE arm NOT IN ('never','always') AND round(cost-t,12)<0 GROUP BY 1,2")
def winning_band(spark, d):
    return tidy(cost.winning_band(calls(spark, d)))


@query("cost_bootstrap", with_("study") + _W + """, cw AS (SELECT a.sprint_id, a.project, a.late, a.weight, a.w0 AS m0, a.w5 AS m5, b.w0 AS g0, b.w5 AS g5 FROM w a JOIN w b ON a.sprint_id=b.sprint_id AND a.arm='M' AND b.arm='G')
""" + boot_sql("cw", "late, weight, m0, m5, g0, g5", "project", REPS, "'2027'") + f", x AS (SELECT r, ratio, sum(weight*{_COST('ratio','0.5::DOUBLE','0.25::DOUBLE').replace('w0','m0').replace('w5','m5')})/sum(weight)-sum(weight*{_COST('ratio','0.5::DOUBLE','0.25::DOUBLE').replace('w0','g0').replace('w5','g5')})/sum(weight) AS v FROM bs, (VALUES (0.02::DOUBLE),(0.05),(0.1),(0.2),(0.3),(0.5)) q(ratio) GROUP BY 1,2) SELECT ratio, {ci()} FROM x GROUP BY 1")
def cost_bootstrap(spark, d):
    return tidy(cost.cost_bootstrap(calls(spark, d, fixed=False), "sprint_id", "project", REPS))


@query("optimal_thresholds", with_("study") + f""", t AS (SELECT a.sprint_id, a.late, a.m_score AS s0, b.m_score AS s5 FROM study a JOIN study b ON a.sprint_id=b.sprint_id AND a.checkpoint=0 AND b.checkpoint=0.5),
g AS (SELECT DISTINCT unnest(quantile_cont(v, [{','.join(f'{i}/60.0' for i in range(61))}])) AS t FROM (SELECT s0 AS v FROM t UNION ALL SELECT s5 FROM t)), gg AS (SELECT t FROM g UNION ALL SELECT 1.01::DOUBLE),
c AS (SELECT a.t AS t0, b.t AS t50, avg((s0>=a.t OR s5>=b.t)::INT) AS w, avg(late) AS l, avg(late*(s0>=a.t)::INT) AS l0, avg(late*(s0<a.t AND s5>=b.t)::INT) AS l5 FROM t, gg a, gg b GROUP BY 1,2)
SELECT scenario, ratio, t0, t50, round(cost,6) AS cost FROM (SELECT *, ratio*w+l-e0*l0-e5*l5 AS cost FROM c, {_SCEN}, (VALUES (0.02::DOUBLE),(0.05),(0.1),(0.2),(0.3),(0.5)) q(ratio)) QUALIFY row_number() OVER (PARTITION BY scenario, ratio ORDER BY round(cost,12), t0, t50)=1""")
def optimal_thresholds(spark, d):
    s = tk.study(spark, d)
    at = lambda t: F.max(F.when(F.col("checkpoint") == t, F.col("m_score")))
    w = s.groupBy("sprint_id").agg(F.max("late").alias("late"), at(0.0).alias("s0"), at(0.5).alias("s50"))
    return tidy(cost.optimal_thresholds(w, "s0", "s50", "late"), digits=6)


# ------------------------------------------------------------------ rules
_TT = ", tt AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY start_date, sprint_id)<=greatest(1,floor(count(*) OVER (PARTITION BY project)*0.7::DOUBLE)) AS tr FROM {t})\n"


def parts(f):
    s = splits.split_time(f)
    return s.where(F.col("side") == "train"), s.where(F.col("side") == "test")


@query("rule_baselines", with_("hist") + _TT.format(t="hist") + "SELECT sprint_id, committed::DOUBLE AS rule_committed, round(coalesce(h_rate,(SELECT avg(h_rate) FROM tt WHERE tr)),6) AS rule_past_lateness FROM tt WHERE NOT tr")
def rule_baselines(spark, d):
    tr, te = parts(add_strict_history(tk.labelled(spark, d)))
    return tidy(rules.rule_scores(tr, te, late=True), "sprint_id", "rule_committed", "rule_past_lateness")


@query("rule_carry", with_("hist") + _TT.format(t="hist") + "SELECT sprint_id, round(coalesce(1-h_ratio,(SELECT avg(1-h_ratio) FROM tt WHERE tr)),6) AS rule_past_carry FROM tt WHERE NOT tr")
def rule_carry(spark, d):
    tr, te = parts(add_strict_history(tk.labelled(spark, d)))
    return tidy(rules.rule_scores(tr, te, late=False), "sprint_id", "rule_past_carry")


@query("group_rate_fallback", with_("scored") + _TT.format(t="scored") + ", r AS (SELECT project, avg(y) AS v FROM tt WHERE tr AND project<>'P7' GROUP BY 1) SELECT sprint_id, round(coalesce(v,(SELECT avg(y) FROM tt WHERE tr AND project<>'P7')),6) AS group_rate FROM tt LEFT JOIN r USING (project) WHERE NOT tr")
def group_rate_fallback(spark, d):
    tr, te = parts(tk.scored(spark, d))
    return tidy(rules.group_rate(tr.where(F.col("project") != "P7"), te, "project", "label_delay"), "sprint_id", "group_rate")


@query("group_weekday_rate", with_("scored") + _TT.format(t="scored") + ", r AS (SELECT project, avg(y) AS v FROM tt WHERE tr GROUP BY 1), c AS (SELECT project, isodow(end_date) AS dw, avg(y) AS u FROM tt WHERE tr GROUP BY 1,2 HAVING count(*)>=5) SELECT sprint_id, round(coalesce(u,v),6) AS weekday_rate FROM tt LEFT JOIN r USING (project) LEFT JOIN c ON c.project=tt.project AND dw=isodow(end_date) WHERE NOT tr")
def group_weekday_rate(spark, d):
    tr, te = parts(tk.scored(spark, d))
    return tidy(rules.group_weekday_rate(tr, te, "project", "end_date", "label_delay"), "sprint_id", "weekday_rate")


@query("constant_scores", with_("scored") + _TT.format(t="scored") + "SELECT sprint_id, 1.0::DOUBLE AS always_positive, round((SELECT avg(y) FROM tt WHERE tr),6) AS base_rate FROM tt WHERE NOT tr")
def constant_scores(spark, d):
    tr, te = parts(tk.scored(spark, d))
    return tidy(rules.constant_scores(tr, te, "label_delay"), "sprint_id", "always_positive", "base_rate")


@query("trailing_ratio_rule", with_("trail") + "SELECT sprint_id, coalesce(CAST(round(t_ratio,9)<0.8::DOUBLE AS INTEGER),0) AS heuristic FROM trail")
def trailing_ratio_rule(spark, d):
    return tidy(rules.trailing_ratio_rule(add_trailing_history(tk.labelled(spark, d))), "sprint_id", "heuristic")


@query("regression_baselines", with_("hist") + _TT.format(t="hist") + """, m AS (SELECT project, median(completed) AS md FROM tt WHERE tr GROUP BY 1) SELECT sprint_id, round((SELECT avg(completed) FROM tt WHERE tr),6) AS train_mean, round((SELECT median(completed) FROM tt WHERE tr),6) AS train_median,
 round(committed*(SELECT sum(completed)/sum(committed)::DOUBLE FROM tt WHERE tr),6) AS scope_x_rate, round(coalesce(h_done,(SELECT avg(completed) FROM tt WHERE tr)),6) AS prior_history, round(coalesce(md,(SELECT median(completed) FROM tt WHERE tr)),6) AS group_median FROM tt LEFT JOIN m USING (project) WHERE NOT tr""")
def regression_baselines(spark, d):
    tr, te = parts(add_strict_history(tk.labelled(spark, d)))
    out = rules.regression_baselines(tr, te, "completed_issue_count", "hist_avg_completed_issues_3")
    return tidy(out, "sprint_id", "train_mean", "train_median", "scope_x_rate", "prior_history", "group_median")


@query("training_quantiles", with_("lab") + _TT.format(t="lab") + """, q AS (SELECT quantile_cont(completed/committed::DOUBLE,[0.1,0.5,0.9]) AS a FROM tt WHERE tr AND nonempty), l AS (SELECT quantile_cont(late_capped,[0.5,0.9]) AS b FROM tt WHERE tr)
SELECT sprint_id, round(committed*a[1],6) AS q10, round(committed*a[2],6) AS q50, round(committed*a[3],6) AS q90, round(b[1],6) AS late_q50, round(b[2],6) AS late_q90 FROM tt, q, l WHERE NOT tr""")
def training_quantiles(spark, d):
    tr, te = parts(tk.labelled(spark, d))
    return tidy(rules.training_quantile_forecasts(tr, te), "sprint_id", "q10", "q50", "q90", "late_q50", "late_q90")


@query("best_rule", with_("scored") + _TT.format(t="scored") + f""", a AS (SELECT rule, {auc('y','v')} AS a FROM (SELECT *, {mid_rank('v','rule')} AS rk FROM (SELECT 'score' AS rule, y, score AS v FROM tt WHERE tr UNION ALL SELECT 'score_b', y, score_b FROM tt WHERE tr UNION ALL SELECT 'committed_issue_count', y, committed FROM tt WHERE tr)) GROUP BY 1)
SELECT rule, round(a,6) AS train_auc FROM a ORDER BY a DESC, list_position(['score','score_b','committed_issue_count'], rule) LIMIT 1""")
def best_rule(spark, d):
    tr, _ = parts(tk.scored(spark, d))
    return tidy(rules.best_rule(tr, ["score", "score_b", "committed_issue_count"], "label_delay"))


@query("claims_reconcile", with_("lab") + "SELECT project, verdict, round(result,6) AS result FROM (SELECT project, avg(label_delay) AS result, CASE WHEN abs(round(avg(label_delay),2)+(CASE WHEN project='P2' THEN 0.05 ELSE 0 END)-avg(label_delay))<=0.0051 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM lab GROUP BY 1)")
def claims_reconcile(spark, d):
    """Rounded rates as claims, one of them off, checked against the rates."""
    res = tk.labelled(spark, d).groupBy("project").agg(F.avg(F.col("label_delay").cast("double")).alias("value"))
    claims = res.select("project", (F.round("value", 2) + F.when(F.col("project") == "P2", 0.05).otherwise(0.0)).alias("claimed"), F.lit(0.0051).alias("tolerance"))
    return tidy(summaries.reconcile_claims(claims, res, ["project"]), "project", "verdict", "result")


@query("answers_completeness", with_("study") + """, a AS (SELECT sprint_id, project, checkpoint FROM study), q AS (SELECT project, checkpoint, count(*) AS asked, count(*) FILTER (k%10<>0) AS answered, count(*) FILTER (k%10=0) AS missing FROM study GROUP BY 1,2) SELECT project||'/'||checkpoint AS prompt, asked, answered, missing, 0::BIGINT AS unasked, missing=0 AS complete FROM q""")
def answers_completeness(spark, d):
    """Manifest of all replay points against answers that leave out every tenth box."""
    from tidemark.sources import nested

    s = tk.study(spark, d).select("raw_sprint_id", F.lit(1).alias("run"), F.concat_ws("/", "project", F.col("checkpoint").cast("string")).alias("prompt"), F.col("sprint_id").alias("board_id"))
    manifest = s.select("run", "prompt", F.array("board_id").alias("boards"))
    return nested.completeness(s.where(F.col("raw_sprint_id") % 10 != 0), manifest).drop("run")


@query("nested_flatten", with_("sev", "pev") + "SELECT project, count(*) AS changes, count(DISTINCT iid) AS items FROM (SELECT iid, project FROM sev UNION ALL SELECT iid, project FROM pev JOIN item USING (iid) UNION ALL SELECT iid, project FROM item WHERE ln=1) GROUP BY 1")
def nested_flatten(spark, d):
    """Items packed as a nested pull, then flattened again."""
    from tidemark.sources import nested

    pull = tk.nested_items(spark, d)
    c = nested.flatten_changes(pull)
    return c.groupBy("project").agg(F.count(F.lit(1)).alias("changes"), F.countDistinct("raw_issue_id").alias("items"))


@query("nested_sprints", with_("item") + "SELECT k AS raw_sprint_id, 'CLOSED' AS sprint_state, start_date, project FROM box WHERE k IN (SELECT raw FROM item)")
def nested_sprints(spark, d):
    """Sprints embedded in the items of a nested pull."""
    from tidemark.sources import nested

    return nested.flatten_sprints(tk.nested_items(spark, d)).select("raw_sprint_id", "sprint_state", "start_date", "project")


@query("edited_batches", with_("study") + """SELECT sprint_id, checkpoint, floor((row_number() OVER (PARTITION BY checkpoint ORDER BY """ + "(('0x'||substr(md5('2027|'||sprint_id),1,15))::BIGINT)" + """, sprint_id)-1)/20)::BIGINT+1 AS batch, m_score<m_threshold AS shows_warn FROM study""")
def edited_batches(spark, d):
    """Condition with the opposite verdict shown, in random batches per checkpoint."""
    from tidemark.functions import text
    from tidemark.plans.jobs import build_edited_prompts

    p, t = F.col("m_score"), F.col("m_threshold")
    edit = lambda s: s.withColumn("shown", text.flip_verdict(text.grounding_line(p, t, 0.75), p, t))
    b = build_edited_prompts(tk.study(spark, d), edit)
    return b.select("sprint_id", "checkpoint", "batch", F.col("shown").contains("says WARN").alias("shows_warn"))
