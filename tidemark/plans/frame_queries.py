"""Queries on labels, history, cohorts and splits of the labelled boxes."""

from pyspark.sql import functions as F

from tidemark.functions import scalars as sc
from tidemark.operators import history, labels, splits, summaries
from tidemark.plans import tracker as tk
from tidemark.plans.oracle import days, hash_of, with_
from tidemark.plans.registry import query, tidy
from tidemark.sources import tables as src


def R(*cols):
    return ", ".join(f"round({c},6) AS {c.split('.')[-1]}" for c in cols)


@query("labels_base", with_("lab") + "SELECT sprint_id, label_delay, label_spillover, at_risk, round(completion_ratio,6) AS completion_ratio FROM lab")
def labels_base(spark, d):
    return tidy(labels.add_labels(tk.line_scope(spark, d)), "sprint_id", "label_delay", "label_spillover", "at_risk", "completion_ratio")


@query("numeric_targets", with_("lab") + "SELECT sprint_id, round(late_days,6) AS late_days, round(late_capped,6) AS late_days_capped, round(carry_ratio,6) AS carry_ratio, nonempty FROM lab")
def numeric_targets(spark, d):
    return tidy(tk.labelled(spark, d), "sprint_id", "late_days", "late_days_capped", "carry_ratio", "nonempty")


_NWD = "CAST(CAST(end_date AS DATE) AS TIMESTAMP) + to_days(CASE isodow(end_date) WHEN 5 THEN 4 WHEN 6 THEN 3 ELSE 2 END)"


@query("labels_next_working_day", with_("hist") + f"""SELECT sprint_id, label_delay AS label_late_1d, CAST(late_days>3 AS INTEGER) AS label_late_3d, CAST(complete_date>{_NWD} AS INTEGER) AS label_late,
 project<>'P3' AS resolution_ok, nonempty AND project<>'P3' AS carry_valid, coalesce(CAST(carry_ratio>=0.5 AS INTEGER),0) AS label_heavy_carry, coalesce(CAST(carry_ratio>=0.2 AS INTEGER),0) AS label_carry_20,
 coalesce(CAST(carry_ratio>=0.3 AS INTEGER),0) AS label_carry_30, round(CASE WHEN project<>'P3' THEN h_ratio END,6) AS hist_avg_completion_ratio_3, round(CASE WHEN project<>'P3' THEN s2c END,6) AS scope_to_capacity FROM hist""")
def labels_next_working_day(spark, d):
    f = labels.corrected_labels(history.add_strict_history(tk.labelled(spark, d)), ["P3"])
    return tidy(f, "sprint_id", "label_late_1d", "label_late_3d", "label_late", "resolution_ok", "carry_valid", "label_heavy_carry",
                "label_carry_20", "label_carry_30", "hist_avg_completion_ratio_3", "scope_to_capacity")


@query("deadline_weekdays", with_("lab") + f"SELECT sprint_id, {_NWD} AS deadline, isodow(end_date)>=5 AS ends_late_in_week FROM lab")
def deadline_weekdays(spark, d):
    b = tk.boxes(spark, d)
    return b.select("sprint_id", sc.next_working_day_deadline(F.col("end_date")).alias("deadline"), sc.ends_late_in_week(F.col("end_date")).alias("ends_late_in_week"))


_GRID = {**{f"late_over_{x}d": f"late_days>{x}" for x in (0, 1, 3, 7)}, **{f"incomplete_at_least_{x}": f"not_completed>={x}" for x in (1, 2, 3)},
         **{f"carry_at_least_{x}": f"carry_ratio>={x}" for x in (0.25, 0.5)}, "point_ratio_below_0.8": "CASE WHEN points>0 THEN delivered/points<0.8::DOUBLE END"}


@query("label_sensitivity", with_("lab") + " UNION ALL ".join(
    f"SELECT project, '{n}' AS label, count(*) AS sprints, count(*) FILTER ({c}) AS positives, round(avg(coalesce(CAST({c} AS INTEGER),0)),6) AS rate FROM lab GROUP BY 1" for n, c in _GRID.items()))
def label_sensitivity(spark, d):
    g = labels.label_grid(tk.labelled(spark, d).select("project", "complete_date", "end_date", "not_completed_count", "delivered_story_points", "committed_story_points", "committed_issue_count"))
    out = g.groupBy("project", "label").agg(F.count(F.lit(1)).alias("sprints"), F.count_if(F.col("value") == 1).alias("positives"), F.avg(F.col("value").cast("double")).alias("rate"))
    return tidy(out)


@query("trailing_history", with_("trail") + "SELECT sprint_id, round(t_sp,6) AS prior_avg_delivered_sp_3, round(t_ratio,6) AS prior_avg_completion_ratio_3, t_carry AS prior_sprint_carryover, round(t_last,6) AS prior_sprint_completion_ratio, has_prior AS has_prior_sprint FROM trail")
def trailing_history(spark, d):
    return tidy(history.add_trailing_history(tk.labelled(spark, d)), "sprint_id", *history.TRAILING_FEATURES, "has_prior_sprint")


@query("cold_start_frame", with_("trail") + "SELECT sprint_id, committed AS committed_issue_count, round(points,6) AS committed_story_points, len AS sprint_length_days, round(t_sp,6) AS prior_avg_delivered_sp_3, round(t_ratio,6) AS prior_avg_completion_ratio_3, t_carry AS prior_sprint_carryover, round(t_last,6) AS prior_sprint_completion_ratio FROM trail WHERE has_prior")
def cold_start_frame(spark, d):
    f = history.add_trailing_history(tk.labelled(spark, d))
    return tidy(labels.cold_start_frame(f, history.LEGACY_FEATURES), "sprint_id", *history.LEGACY_FEATURES)


@query("strict_history", with_("hist") + """SELECT sprint_id, round(h_late,6) AS hist_avg_late_days_3, round(h_rate,6) AS hist_late_rate_3, h_n AS hist_n_available, round(h_ratio,6) AS hist_avg_completion_ratio_3, CAST(h_carry AS DOUBLE) AS hist_last_carryover,
 round(h_sp,6) AS hist_avg_delivered_sp_3, round(h_done,6) AS hist_avg_completed_issues_3, round(h_comm,6) AS hist_avg_committed_issues_3, round(s2c,6) AS scope_to_capacity FROM hist""")
def strict_history(spark, d):
    f = history.add_strict_history(tk.labelled(spark, d))
    return tidy(f, "sprint_id", *history._LATE, *history._HIST, *history._CAPACITY)


@query("concurrency", with_("conc") + "SELECT sid AS sprint_id, n_conc AS n_concurrent_sprints FROM conc")
def concurrency(spark, d):
    return tidy(history.add_concurrency(tk.boxes(spark, d)), "sprint_id", "n_concurrent_sprints")


@query("predecessor_overlap", with_("box") + """, p AS (SELECT project, start_date, lag(end_date) OVER w AS pe, lag(complete_date) OVER w AS pc FROM box WINDOW w AS (PARTITION BY project ORDER BY start_date, sprint_id))
SELECT project, count(*) AS with_predecessor, round(avg((pe>start_date)::INT),6) AS share_end_after_start, round(avg((pc>start_date)::INT),6) AS share_close_after_start, round(avg((pe>start_date OR pc>start_date)::INT),6) AS share_either FROM p WHERE pe IS NOT NULL GROUP BY 1""")
def predecessor_overlap(spark, d):
    return tidy(history.predecessor_overlap(tk.boxes(spark, d)))


@query("populations", with_("lab") + "SELECT 'full' AS population, count(*) AS n FROM lab UNION ALL SELECT 'nonempty', count(*) FILTER (nonempty) FROM lab UNION ALL SELECT 'carry', count(*) FILTER (nonempty AND project<>'P3') FROM lab UNION ALL SELECT 'plausible', count(*) FILTER (len BETWEEN 1 AND 60) FROM lab")
def populations(spark, d):
    f = labels.corrected_labels(tk.labelled(spark, d), ["P3"])
    out = None
    for n in ("full", "nonempty", "carry", "plausible"):
        part = labels.population(f, n).agg(F.lit(n).alias("population"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("two_part_scope", with_("lab") + "SELECT project, count(*) FILTER (NOT nonempty) AS empty, count(*) FILTER (nonempty) AS nonempty, count(*) FILTER (NOT nonempty AND label_spillover=1) AS empty_positive, count(*) FILTER (nonempty AND label_spillover=1) AS nonempty_positive FROM lab GROUP BY 1")
def two_part_scope(spark, d):
    return labels.empty_scope_positives(tk.labelled(spark, d))


@query("cohort_flow", with_("trail") + """SELECT project, count(*) AS raw, count(*) FILTER (sprint_state='CLOSED') AS closed, count(*) FILTER (sprint_state='FUTURE') AS future, count(*) FILTER (sprint_state='ACTIVE') AS active,
 count(*) FILTER (sprint_state='CLOSED' AND NOT (end_date>=start_date AND complete_date>=start_date)) AS invalid, count(*) FILTER (sprint_state='CLOSED' AND end_date>=start_date AND complete_date>=start_date) AS eligible,
 count(*) FILTER (has_prior) AS modeled, count(*) FILTER (has_prior AND committed=0) AS zero_scope, count(*) FILTER (has_prior AND committed>0) AS nonempty, count(*) FILTER (has_prior AND label_delay=1) AS late, count(*) FILTER (has_prior AND label_spillover=1) AS spillover FROM trail GROUP BY 1""")
def cohort_flow(spark, d):
    return labels.cohort_flow(tk.boxes(spark, d), history.add_trailing_history(tk.labelled(spark, d)))


_SIZE = "CASE WHEN committed<=1 THEN '1' WHEN committed<=2 THEN '2' WHEN committed<=3 THEN '3' WHEN committed<=5 THEN '4-5' WHEN committed<=10 THEN '6-10' ELSE '11+' END"


@query("rate_by_size", with_("lab") + f"SELECT {_SIZE} AS bucket, count(*) AS n, round(avg(label_spillover),6) AS label_spillover_rate, round(avg(label_delay),6) AS label_delay_rate FROM lab WHERE committed>0 GROUP BY 1")
def rate_by_size(spark, d):
    return tidy(summaries.rate_by_size(tk.labelled(spark, d), "committed_issue_count", ["label_spillover", "label_delay"]))


@query("group_total_rollup", with_("lab") + "SELECT coalesce(project,'all') AS project, count(*) AS n, round(avg(label_delay),6) AS late_rate, round(avg(carry_ratio),6) AS mean_carry FROM lab GROUP BY ROLLUP(project)")
def group_total_rollup(spark, d):
    return tidy(summaries.rates_with_total(tk.labelled(spark, d), "project", {"late_rate": F.col("label_delay").cast("double"), "mean_carry": F.col("carry_ratio")}))


@query("group_total_filtered", with_("lab") + "SELECT project, count(*) AS n, round(avg(label_delay),6) AS late_rate FROM lab GROUP BY 1 UNION ALL SELECT 'all', count(*), round(avg(label_delay),6) FROM lab WHERE nonempty AND project<>'P3'")
def group_total_filtered(spark, d):
    return tidy(summaries.rates_with_total(tk.labelled(spark, d), "project", {"late_rate": F.col("label_delay").cast("double")}, total_filter=F.col("nonempty") & (F.col("project") != "P3")))


@query("project_table", with_("lab") + "SELECT project, count(*) AS sprints, count(*) FILTER (nonempty) AS nonempty, round(avg(label_delay),6) AS late_rate, round(avg(label_spillover) FILTER (nonempty),6) AS spillover_rate, round(avg(committed),6) AS mean_scope, min(late_days) AS min_late_days, max(late_days) AS max_late_days, count(DISTINCT start_date) AS start_days, CAST(median(committed) FILTER (nonempty) AS DOUBLE) AS median_scope FROM lab GROUP BY 1")
def project_table(spark, d):
    return tidy(summaries.project_table(tk.labelled(spark, d)))


@query("source_description", with_("lab") + "SELECT sprint_state, count(*) AS sprints, count(*) FILTER (nonempty) AS nonempty, count(DISTINCT project) AS projects, count(*) FILTER (committed=0) AS zero_scope, round(avg(label_delay),6) AS late_rate, round(avg(label_spillover) FILTER (nonempty),6) AS spillover_rate, min(start_date) AS first_start, max(start_date) AS last_start, CAST(median(committed) FILTER (nonempty) AS DOUBLE) AS median_scope FROM lab GROUP BY 1")
def source_description(spark, d):
    return tidy(summaries.source_description(tk.labelled(spark, d), "sprint_state"))


@query("value_counts", with_("item") + "SELECT status, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, status) AS rank FROM item WHERE resolved IS NULL GROUP BY 1 QUALIFY rank<=4")
def value_counts(spark, d):
    return tidy(summaries.value_counts_top(tk.items(spark, d).where(F.col("resolution_date").isNull()), "status", 4))


@query("nothing_done_share", with_("lab") + "SELECT project, count(*) AS nonempty, round(avg((completed=0)::INT),6) AS share_nothing_done FROM lab WHERE nonempty GROUP BY 1")
def nothing_done_share(spark, d):
    return tidy(summaries.nothing_done_share(tk.labelled(spark, d)))


_LOAD = with_("hist") + """, ld AS (SELECT *, greatest(0, CAST(ceil((row_number() OVER w - 1)*4.0::DOUBLE/greatest(count(*) OVER (PARTITION BY project)-1,1)) AS BIGINT)-1) AS q FROM hist WHERE nonempty AND s2c IS NOT NULL WINDOW w AS (PARTITION BY project ORDER BY s2c, start_date, sprint_id))
"""


def _loads(spark, d):
    return summaries.load_quartiles(history.add_strict_history(tk.labelled(spark, d)))


@query("overload_quartiles", _LOAD + "SELECT q AS load_quartile, count(*) AS n, round(avg(carry_ratio),6) AS carry_ratio, round(avg(label_spillover),6) AS label_spillover, round(avg(label_delay),6) AS label_delay, round(avg(late_capped),6) AS late_days_capped, CAST(median(committed) AS DOUBLE) AS median_planned FROM ld GROUP BY 1")
def overload_quartiles(spark, d):
    return tidy(summaries.overload_table(_loads(spark, d)))


def _spearman(x, y, part, frm, extra=""):
    same = lambda c: f"(rank() OVER (PARTITION BY {part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {part}, {c})-1)/2.0::DOUBLE)"
    return f"SELECT {part}, count(*) AS n, round(corr(rx, ry),6) AS spearman FROM (SELECT *, {same(x)} AS rx, {same(y)} AS ry FROM {frm}) GROUP BY {part}"


@query("overload_spearman", _LOAD + ", lg AS (SELECT project, s2c, unnest(['carry_ratio','label_delay','late_days_capped']) AS outcome, unnest([carry_ratio, label_delay::DOUBLE, late_capped]) AS yv FROM ld)\n" + _spearman("s2c", "yv", "project, outcome", "lg"))
def overload_spearman(spark, d):
    return tidy(summaries.overload_correlation(_loads(spark, d)))


@query("overload_gap", _LOAD + """, g AS (SELECT project, row_number() OVER (ORDER BY project) AS rn FROM (SELECT DISTINCT project FROM ld)), n AS (SELECT count(*) AS n FROM g),
dr AS (SELECT r, rn FROM (SELECT r, (('0x'||substr(md5('42|'||r||'|'||i),1,15))::BIGINT % n)+1 AS rn FROM n, range(2000) a(r), range(8) b(i) WHERE i<n)),
s AS (SELECT project, sum(carry_ratio) FILTER (q=3) AS h, count(*) FILTER (q=3) AS nh, sum(carry_ratio) FILTER (q=0) AS l, count(*) FILTER (q=0) AS nl FROM ld GROUP BY 1),
rep AS (SELECT r, sum(h)/sum(nh)-sum(l)/sum(nl) AS v FROM dr JOIN g USING (rn) JOIN s USING (project) GROUP BY 1)
SELECT count(*) AS replicates, round(avg(v),6) AS mean, round(quantile_cont(v,0.025),6) AS lo, round(quantile_cont(v,0.975),6) AS hi, (SELECT round(sum(h)/sum(nh)-sum(l)/sum(nl),6) FROM s) AS point FROM rep""")
def overload_gap(spark, d):
    return tidy(summaries.overload_gap(_loads(spark, d), "carry_ratio"))


@query("label_sanity", with_("lab") + f"""SELECT 'late_rate' AS "check", 'all' AS note, round(avg(label_delay),6) AS value, count(*) AS n FROM lab
UNION ALL SELECT 'spillover_rate', 'nonempty', round(avg(label_spillover),6), count(*) FROM lab WHERE nonempty UNION ALL SELECT 'heavy_carry_rate','nonempty', round(avg((carry_ratio>=0.5)::INT),6), count(*) FROM lab WHERE nonempty
UNION ALL SELECT 'late_1_to_3_days_share','late', round(avg((late_days<=3)::INT),6), count(*) FROM lab WHERE label_delay=1 UNION ALL SELECT 'planned_end_fri_to_sun_share','all', round(avg((isodow(end_date)>=5)::INT),6), count(*) FROM lab
UNION ALL SELECT 'late_rate_end_fri_to_sun','all', round(avg(label_delay),6), count(*) FROM lab WHERE isodow(end_date)>=5 UNION ALL SELECT 'late_rate_end_mon_to_thu','all', round(avg(label_delay),6), count(*) FROM lab WHERE isodow(end_date)<5
UNION ALL SELECT 'late_end_fri_to_sun_closed_within_3_5_days_share','late', round(avg((isodow(end_date)>=5 AND late_days<=3.5)::INT),6), count(*) FROM lab WHERE label_delay=1
UNION ALL SELECT 'median_carry_share','nonempty', round(median(carry_ratio),6), count(*) FROM lab WHERE nonempty UNION ALL SELECT 'median_late_days','late', round(median(late_days),6), count(*) FROM lab WHERE label_delay=1
UNION ALL SELECT 'spillover_rate_by_size', {_SIZE}, round(avg(label_spillover),6), count(*) FROM lab WHERE nonempty GROUP BY 2""")
def label_sanity(spark, d):
    return tidy(summaries.label_sanity(tk.labelled(spark, d)))


@query("missing_resolution", with_("item") + "SELECT project AS note, round(avg((resolved IS NULL)::INT),6) AS value, count(*) AS n FROM item WHERE status IN ('F/A','F/R','O/N') GROUP BY 1")
def missing_resolution(spark, d):
    """Items in three of the states, by project, without a resolution date."""
    return tidy(summaries.missing_resolution(tk.items(spark, d), "project", finished=["f/a", "f/r", "o/n"]))


@query("descriptive_numbers", with_("lab") + """, s AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY start_date, sprint_id)<=greatest(1,floor(count(*) OVER (PARTITION BY project)*0.7::DOUBLE)) AS tr FROM lab),
e AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY start_date, sprint_id)<=greatest(1,floor(count(*) OVER (PARTITION BY project)*0.7::DOUBLE)) AS tr FROM lab WHERE nonempty)
SELECT 'late_days' AS "check", 'min' AS note, round(min(late_days),6) AS value FROM lab UNION ALL SELECT 'late_days','max',round(max(late_days),6) FROM lab
UNION ALL SELECT 'sprint_length_days','min',round(min(len),6) FROM lab UNION ALL SELECT 'sprint_length_days','max',round(max(len),6) FROM lab UNION ALL SELECT 'late_days_capped','min',round(min(late_capped),6) FROM lab
UNION ALL SELECT 'late_rate', CASE WHEN tr THEN 'train' ELSE 'test' END, round(avg(label_delay),6) FROM s GROUP BY 2
UNION ALL SELECT 'spill_test_negatives', project, count(*)::DOUBLE FROM e WHERE NOT tr AND label_spillover=0 GROUP BY 2""")
def descriptive_numbers(spark, d):
    f = tk.labelled(spark, d)
    return tidy(summaries.descriptive_numbers(splits.split_time(f), splits.split_time(f.where("nonempty"))))


# ------------------------------------------------------------------ splits
_RN = "row_number() OVER (PARTITION BY project ORDER BY start_date, sprint_id) AS rn, count(*) OVER (PARTITION BY project) AS n"


@query("split_time", with_("box") + f"SELECT sprint_id, CASE WHEN rn<=greatest(1,floor(n*0.7::DOUBLE)) THEN 'train' ELSE 'test' END AS side FROM (SELECT *, {_RN} FROM box)")
def split_time(spark, d):
    return splits.split_time(tk.boxes(spark, d)).select("sprint_id", "side")


@query("split_fractions", with_("box") + f"SELECT f AS fraction, project, count(*) FILTER (rn<=greatest(1,floor(n*f))) AS train, count(*) FILTER (rn>greatest(1,floor(n*f))) AS test FROM (SELECT *, {_RN} FROM box), (VALUES (0.5::DOUBLE),(0.6),(0.8)) v(f) GROUP BY 1,2")
def split_fractions(spark, d):
    b, out = tk.boxes(spark, d).select("project", "start_date", "sprint_id"), None
    for f in (0.5, 0.6, 0.8):
        s = splits.split_time(b, f).groupBy(F.lit(f).alias("fraction"), "project").agg(F.count_if(F.col("side") == "train").alias("train"), F.count_if(F.col("side") == "test").alias("test"))
        out = s if out is None else out.unionByName(s)
    return out


@query("split_rolling", with_("box") + f"""SELECT sprint_id, r AS repeat, CASE WHEN rn<=round_even(n*lo,0) THEN 'train' ELSE 'test' END AS side FROM (SELECT *, {_RN} FROM box), (VALUES (1,0.4::DOUBLE,0.4::DOUBLE+0.2::DOUBLE),(2,0.5,0.5::DOUBLE+0.2::DOUBLE),(3,0.6,0.6::DOUBLE+0.2::DOUBLE),(4,0.7,0.7::DOUBLE+0.2::DOUBLE),(5,0.8,0.8::DOUBLE+0.2::DOUBLE)) v(r,lo,hi) WHERE rn<=round_even(n*hi,0)""")
def split_rolling(spark, d):
    return tidy(splits.split_rolling(tk.boxes(spark, d)), "sprint_id", "repeat", "side")


@query("split_logo", with_("box") + "SELECT fold, count(*) FILTER (project=fold) AS test, count(*) FILTER (project<>fold) AS train FROM box, (SELECT DISTINCT project AS fold FROM box) GROUP BY 1")
def split_logo(spark, d):
    b = tk.boxes(spark, d)
    s = splits.split_logo(b, splits.leave_one_group_out(b))
    return s.groupBy("fold").agg(F.count_if(F.col("side") == "test").alias("test"), F.count_if(F.col("side") == "train").alias("train"))


_STRAT = lambda seed: f"row_number() OVER (PARTITION BY label_delay ORDER BY {hash_of(repr(str(seed)), 'sprint_id')}, sprint_id) AS rn, count(*) OVER (PARTITION BY label_delay) AS n"


@query("split_stratified", with_("lab") + f"SELECT sprint_id, CASE WHEN rn<=round(n*0.3::DOUBLE) THEN 'test' ELSE 'train' END AS side FROM (SELECT *, {_STRAT(42)} FROM lab)")
def split_stratified(spark, d):
    return splits.split_stratified(tk.labelled(spark, d), "label_delay").select("sprint_id", "side")


@query("split_kfold", with_("lab") + f"SELECT sprint_id, (rn-1)%5 AS fold FROM (SELECT *, {_STRAT(42)} FROM lab)")
def split_kfold(spark, d):
    return tidy(splits.split_kfold(tk.labelled(spark, d), "label_delay"), "sprint_id", "fold")


_CAL = with_("box") + """, q AS (SELECT quantile_cont(epoch_us(start_date)::DOUBLE,0.7) AS cut FROM box), s AS (SELECT box.*, CASE WHEN epoch_us(start_date)>=cut THEN 'test' WHEN epoch_us(complete_date)<cut THEN 'train' END AS side FROM box, q)
"""


@query("split_calendar", _CAL + "SELECT sprint_id, side FROM s WHERE side IS NOT NULL")
def split_calendar(spark, d):
    return splits.split_calendar(tk.boxes(spark, d)).select("sprint_id", "side")


@query("split_purged", with_("box") + f", s AS (SELECT *, CASE WHEN rn<=greatest(1,floor(n*0.7::DOUBLE)) THEN 'train' ELSE 'test' END AS side FROM (SELECT *, {_RN} FROM box)), f AS (SELECT project, min(start_date) AS ft FROM s WHERE side='test' GROUP BY 1) SELECT sprint_id, side FROM s JOIN f USING (project) WHERE side='test' OR complete_date<=ft")
def split_purged(spark, d):
    return splits.purge_unknown(splits.split_time(tk.boxes(spark, d))).select("sprint_id", "side")


@query("split_carried", with_("box") + f"SELECT box.sprint_id, c AS checkpoint, CASE WHEN rn<=greatest(1,floor(n*0.7::DOUBLE)) THEN 'train' ELSE 'test' END AS split_full FROM (SELECT *, {_RN} FROM box) box, (VALUES (0.25::DOUBLE),(0.5),(0.75),(1.0)) v(c)")
def split_carried(spark, d):
    b = tk.boxes(spark, d)
    long = b.select("sprint_id", F.explode(F.array(*[F.lit(c) for c in (0.25, 0.5, 0.75, 1.0)])).alias("checkpoint"))
    return splits.carry_side(long, splits.split_time(b), "split_full")


@query("stratified_draw", with_("lab") + f"SELECT sprint_id, round(n/least(n,120)::DOUBLE,6) AS weight FROM (SELECT *, {_STRAT(7)} FROM lab) WHERE rn<=120")
def stratified_draw(spark, d):
    return tidy(splits.stratified_draw(tk.labelled(spark, d), ["label_delay"], 120, seed=7), "sprint_id", "weight")


@query("class_weights", with_("lab") + "SELECT label_delay, count(*) AS n, round(sum(CASE WHEN label_delay=1 THEN 0.4/0.5::DOUBLE ELSE 0.6/0.5::DOUBLE END),4) AS weight FROM lab GROUP BY 1")
def class_weights(spark, d):
    w = splits.class_weights(tk.labelled(spark, d), "label_delay", 0.4)
    return tidy(w.groupBy("label_delay").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")), digits=4)


@query("oversample", with_("lab") + f""", k2 AS (SELECT count(*) FILTER (label_delay=1) AS p, count(*) FILTER (label_delay=0) AS q FROM lab), m AS (SELECT CASE WHEN p<q THEN 1 ELSE 0 END AS lab_min, abs(p-q) AS need, least(p,q) AS have FROM k2),
r AS (SELECT sprint_id, row_number() OVER (ORDER BY {hash_of("'42'", 'sprint_id')}, sprint_id) AS rn FROM lab, m WHERE label_delay=lab_min),
dr AS (SELECT (('0x'||substr(md5('42|draw|'||i),1,15))::BIGINT % have)+1 AS rn FROM (SELECT have, unnest(range(need)) AS i FROM m))
SELECT sprint_id, 1+coalesce(c,0) AS copies FROM lab LEFT JOIN (SELECT sprint_id AS s, count(*) AS c FROM dr JOIN r USING (rn) GROUP BY 1) ON s=sprint_id""")
def oversample(spark, d):
    o = splits.oversample(tk.labelled(spark, d), "label_delay")
    return o.groupBy("sprint_id").agg(F.count(F.lit(1)).alias("copies"))


@query("batches", with_("lab") + f"SELECT sprint_id, project, floor((row_number() OVER (PARTITION BY project ORDER BY {hash_of(repr('42'), 'sprint_id')}, sprint_id)-1)/20)::BIGINT+1 AS batch FROM lab")
def batches(spark, d):
    return splits.batches(tk.boxes(spark, d), 20, within=["project"]).select("sprint_id", "project", "batch")


@query("same_ids", with_("sp") + "SELECT (SELECT count(*) FROM box WHERE sprint_state='CLOSED') - (SELECT count(*) FROM sp) AS only_a, 0::BIGINT AS only_b")
def same_ids(spark, d):
    b = tk.boxes(spark, d)
    return splits.same_ids(b.where(F.col("sprint_state") == "CLOSED"), src.eligible(b))


@query("time_valid_quarters", with_("lab") + """, t AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY start_date, sprint_id)<=greatest(1,floor(count(*) OVER (PARTITION BY project)*0.7::DOUBLE)) AS tr FROM lab), q AS (SELECT date_trunc('quarter', start_date)::TIMESTAMP AS quarter, count(*) AS test_rows FROM t WHERE NOT tr GROUP BY 1)
SELECT quarter, test_rows, count(*) FILTER (tr AND known<quarter) AS train_rows FROM q, t GROUP BY 1,2""")
def time_valid_quarters(spark, d):
    """Rows known before each test quarter: what a time-valid refit may learn from."""
    s = splits.split_time(tk.labelled(spark, d))
    test = s.where(F.col("side") == "test").groupBy(F.date_trunc("quarter", "start_date").alias("quarter")).agg(F.count(F.lit(1)).alias("test_rows"))
    known = s.where(F.col("side") == "train").select(F.greatest("end_date", "complete_date").alias("known"))
    quarters = splits.quarters_to_score(s.where(F.col("side") == "test"))
    counts = known.agg(*[F.count_if(F.col("known") < F.lit(q)).alias(f"q{i}") for i, q in enumerate(quarters)])
    cells = F.array(*[F.struct(F.lit(q).alias("quarter"), F.col(f"q{i}").alias("train_rows")) for i, q in enumerate(quarters)])
    return test.join(F.broadcast(counts.select(F.explode(cells).alias("c")).select("c.*")), "quarter")


@query("eligible_sprints", with_("sp") + "SELECT sprint_id FROM sp")
def eligible_sprints(spark, d):
    return tk.closed_boxes(spark, d).select("sprint_id")


@query("union_sources", with_("lab") + "SELECT source, count(*) AS n, CAST(sum(x) AS BIGINT) AS punted FROM (SELECT 'a' AS source, committed AS x FROM lab WHERE k%2=0 UNION ALL SELECT 'b', 0 FROM lab WHERE k%2=1) GROUP BY 1")
def union_sources(spark, d):
    f = tk.labelled(spark, d)
    a = f.where(F.col("raw_sprint_id") % 2 == 0).select("sprint_id", F.col("committed_issue_count").alias("punted_count"))
    b = f.where(F.col("raw_sprint_id") % 2 == 1).select("sprint_id")
    u = src.union_sources({"a": a, "b": b}, ["punted_count"])
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("punted_count").alias("punted"))


@query("subset_extract", with_("item", "sev", "pev") + "SELECT 'sprints' AS t, count(*) AS n FROM box WHERE project IN ('P1','P5') UNION ALL SELECT 'issues', count(*) FROM item WHERE project IN ('P1','P5') UNION ALL SELECT 'changes', (SELECT count(*) FROM sev WHERE project IN ('P1','P5'))+(SELECT count(*) FROM pev JOIN item USING (iid) WHERE project IN ('P1','P5'))")
def subset_extract(spark, d):
    i = tk.items(spark, d)
    parts = src.subset_extract(tk.boxes(spark, d), i, tk.changes(i), ["P1", "P5"])
    counts = [p.agg(F.lit(n).alias("t"), F.count(F.lit(1)).alias("n")) for n, p in zip(("sprints", "issues", "changes"), parts)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("scalar_parsers", """SELECT event_id, CAST(regexp_extract(props,'([-+]?\\d+(?:\\.\\d+)?)',1) AS DOUBLE) AS number, regexp_replace(lower(event_type||' Points'),'[^a-z0-9]+','','g') AS field_key,
 CAST(regexp_extract(props,'(\\d+)',1) AS VARCHAR) AS struct_id FROM events""")
def scalar_parsers(spark, d):
    """Lenient number, field key and serialized-struct parser over the event properties."""
    e = tk.load(spark, d, "events")
    number = sc.lenient_number(F.col("props"))
    packed = F.concat(F.lit("com.example.Sprint@1f[id="), F.regexp_extract("props", r"(\d+)", 1), F.lit(",state=CLOSED,name=A, B]"))
    return e.select("event_id", number.alias("number"), sc.field_key(F.concat("event_type", F.lit(" Points"))).alias("field_key"), sc.struct_text_map(packed)["id"].alias("struct_id"))
