"""Alarm cost: kappa per warned sprint plus the late sprints that the first warning did not save."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import exact_quantiles

# Share of the loss saved by a first warning at the start and at half time, per scenario.
SCENARIOS = {"zero": (0.0, 0.0), "default": (0.5, 0.25), "strong": (0.8, 0.5)}
RATIOS = [0.02, 0.05, 0.1, 0.2, 0.3, 0.5]
NEVER_THRESHOLD = 1.01


def sprint_calls(df: DataFrame, calls: Sequence[str], item: Sequence[str] = ("sprint_id", "project"), checkpoint: str = "checkpoint") -> DataFrame:
    """Long table (item, late, weight, arm, w0, w50) of the calls at the start and at half time."""
    at = lambda c, t: F.max(F.when(F.col(checkpoint) == t, F.col(c))).cast("int")
    wide = df.groupBy(*item).agg(
        F.max(F.when(F.col(checkpoint) == 0.0, F.col("late"))).alias("late"),
        F.max(F.when(F.col(checkpoint) == 0.0, F.col("weight"))).alias("weight"),
        *[a for c in calls for a in (at(c, 0.0).alias(f"{c}__0"), at(c, 0.5).alias(f"{c}__5"))])
    cells = F.array(*[F.struct(F.lit(c).alias("arm"), F.col(f"{c}__0").alias("w0"), F.col(f"{c}__5").alias("w50")) for c in calls])
    return wide.withColumn("c_", F.explode(cells)).select(*item, "late", "weight", "c_.*")


def with_fixed_policies(calls: DataFrame, like: str) -> DataFrame:
    """Add the policies that never and always warn, built from the rows of one arm."""
    base = calls.where(F.col("arm") == like)
    fixed = lambda n, v: base.withColumns({"arm": F.lit(n), "w0": F.lit(v), "w50": F.lit(v)})
    return calls.unionByName(fixed("never", 0)).unionByName(fixed("always", 1))


def saved(e0: Column, e50: Column) -> Column:
    return F.when(F.col("w0") > 0, e0).when(F.col("w50") > 0, e50).otherwise(F.lit(0.0))


def alarm_cost(ratio: Column, e0: Column, e50: Column) -> Column:
    warned = ((F.col("w0") > 0) | (F.col("w50") > 0)).cast("double")
    return ratio * warned + F.col("late") * (1 - saved(e0, e50))


def scenario_columns(df: DataFrame, scenarios=None, ratios: Sequence[float] = RATIOS) -> DataFrame:
    """Sums that every scenario needs, taken once per arm, then spread over scenarios and ratios.

    The cost is linear in the ratio and in the two savings, so four weighted sums per group replace a
    copy of the rows per scenario and ratio.
    """
    scenarios = scenarios or SCENARIOS
    cells = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(e[0]).alias("e0"), F.lit(e[1]).alias("e50")) for n, e in scenarios.items()])
    d = df.withColumn("s_", F.explode(cells)).withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    cost = (F.col("ratio") * F.col("s_warned") + F.col("s_late") - F.col("s_.e0") * F.col("s_late0") - F.col("s_.e50") * F.col("s_late50")) / F.col("s_weight")
    return d.withColumn("scenario", F.col("s_.scenario")).withColumn("cost", cost).drop("s_")


def cost_sums(calls: DataFrame, keys: Sequence[str], times: Column | None = None) -> DataFrame:
    w = F.col("weight") if times is None else F.col("weight") * times
    first, later = F.col("w0") > 0, (F.col("w0") == 0) & (F.col("w50") > 0)
    late = F.col("late")
    return calls.groupBy(*keys).agg(
        F.sum(w).alias("s_weight"), F.sum(F.when(first | later, w).otherwise(0.0)).alias("s_warned"),
        F.sum(w * late).alias("s_late"), F.sum(F.when(first, w * late).otherwise(0.0)).alias("s_late0"),
        F.sum(F.when(later, w * late).otherwise(0.0)).alias("s_late50"))


def cost_curve(calls: DataFrame, ratios: Sequence[float] = RATIOS, keys: Sequence[str] = ("arm",), scenario: str = "default") -> DataFrame:
    """Weighted mean cost per sprint, arm and ratio."""
    d = scenario_columns(cost_sums(calls, keys), {scenario: SCENARIOS[scenario]}, ratios)
    return d.select(*keys, "ratio", "cost")


def cost_scenarios(calls: DataFrame, ratios: Sequence[float] = (0.02, 0.1, 0.5)) -> DataFrame:
    """Cost of every arm in every scenario and ratio, and whether it is the cheapest there."""
    d = scenario_columns(cost_sums(calls, ["arm"]), None, ratios).select("scenario", "ratio", "arm", "cost")
    best = d.groupBy("scenario", "ratio").agg(F.min_by("arm", F.struct(F.round("cost", 12), "arm")).alias("cheapest"))
    return d.join(F.broadcast(best), ["scenario", "ratio"])  # scenarios x ratios rows


def winning_band(calls: DataFrame, step: float = 0.01, steps: int = 60) -> DataFrame:
    """Range of ratios over which an arm beats both fixed policies, and whether it is one run."""
    ratios = [round(step * i, 2) for i in range(1, steps + 1)]
    d = scenario_columns(cost_sums(calls, ["arm"]), None, ratios).select("scenario", "ratio", "arm", "cost")
    fixed = F.col("arm").isin("never", "always")
    trivial = d.where(fixed).groupBy("scenario", "ratio").agg(F.min("cost").alias("trivial"))
    wins = d.where(~fixed).join(F.broadcast(trivial), ["scenario", "ratio"]).where(F.round(F.col("cost") - F.col("trivial"), 12) < 0)
    i = F.round(F.col("ratio") / step).cast("long")
    return wins.groupBy("scenario", "arm").agg(
        F.min("ratio").alias("ratio_from"), F.max("ratio").alias("ratio_to"), F.count(F.lit(1)).alias("wins"),
        ((F.max(i) - F.min(i) + 1) == F.count(F.lit(1))).alias("contiguous"))


def cost_bootstrap(calls: DataFrame, item: str, group: str, reps: int, seed: int = 2027, ratios: Sequence[float] = RATIOS, arm_a: str = "M", arm_b: str = "G", slices=None) -> DataFrame:
    """Interval of cost(a) minus cost(b) per ratio, resampling sprints inside their group.

    Both arms share the resample: the draw is over sprints and carries the calls of all arms.
    """
    from tidemark.operators.multinomial import resample_cells
    from tidemark.operators.resample import interval

    wide = calls.groupBy(item, group).agg(
        F.first("late").alias("late"), F.first("weight").alias("weight"),
        *[F.max(F.when(F.col("arm") == a, F.struct("w0", "w50"))).alias(n) for a, n in ((arm_a, "a"), (arm_b, "b"))])
    flat = [F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in "ab" for c in ("w0", "w50")]
    sample = resample_cells(wide.select(group, "late", "weight", *flat), reps, seed, ["late", "weight", "a_w0", "a_w50", "b_w0", "b_w50"], [group], slices)
    both = F.array(*[F.struct(F.lit(n).alias("arm"), F.col(f"{n}_w0").alias("w0"), F.col(f"{n}_w50").alias("w50")) for n in "ab"])
    long = sample.select("rep", "times", "late", "weight", F.explode(both).alias("c")).select("rep", "times", "late", "weight", "c.*")
    d = scenario_columns(cost_sums(long, ["rep", "arm"], F.col("times")), {"default": SCENARIOS["default"]}, ratios)
    pick = lambda n: F.max(F.when(F.col("arm") == n, F.col("cost")))
    diff = d.groupBy("rep", "ratio").agg((pick("a") - pick("b")).alias("diff"))
    return interval(diff, "diff", ["ratio"])


def optimal_thresholds(df: DataFrame, s0: str, s50: str, late: str, ratios: Sequence[float] = RATIOS, scenarios=None, points: int = 61, slices=None) -> DataFrame:
    """Pair of alarm thresholds with the lowest mean cost per scenario and ratio.

    Candidates are ``points`` quantiles of both scores and "never". Rows are first counted per pair of
    grid cells (at most (points + 1) squared), so the grid search does not touch the rows again.
    """
    both = df.select(F.explode(F.array(s0, s50)).alias("v"))
    q = exact_quantiles(both, [], "v", [i / (points - 1) for i in range(points)], slices)
    edges = sorted({r["value"] for r in q.collect()}) + [NEVER_THRESHOLD]  # at most points + 1 numbers
    lits = F.array(*[F.lit(float(e)) for e in edges])
    below = lambda s: F.size(F.filter(lits, lambda t: t <= F.col(s)))  # thresholds at or under the score
    cells = df.groupBy(below(s0).alias("c0"), below(s50).alias("c50")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(late).cast("double").alias("late"))
    # every pair of cells; a score warns at threshold i when at least i thresholds are at or under it
    k = len(edges)
    every = df.sparkSession.range(0, k + 1).select(F.col("id").cast("int").alias("c0"), F.explode(F.sequence(F.lit(0), F.lit(k))).alias("c50"))
    full = every.join(F.broadcast(cells), ["c0", "c50"], "left").fillna(0.0)
    row = Window.partitionBy("c50").orderBy("c0").rowsBetween(Window.unboundedPreceding, -1)
    col = Window.partitionBy("c0").orderBy("c50").rowsBetween(Window.unboundedPreceding, -1)
    under = {f"u_{c}": F.coalesce(F.sum(c).over(row), F.lit(0.0)) for c in ("n", "late")}  # c0 < i0, this c50
    full = full.withColumns(under)
    quiet = {f"q_{c}": F.coalesce(F.sum(f"u_{c}").over(col), F.lit(0.0)) for c in ("n", "late")}  # c0 < i0, c50 < i50
    whole = Window.partitionBy("c0")
    full = full.withColumns({**quiet, "u_all": F.sum("u_late").over(whole)})
    tot = cells.agg(F.sum("n").alias("s_weight"), F.sum("late").alias("s_late")).first()
    pick = lambda i: F.element_at(lits, F.col(i))
    sums = full.where((F.col("c0") >= 1) & (F.col("c50") >= 1)).select(
        pick("c0").alias("t0"), pick("c50").alias("t50"), F.lit(tot["s_weight"]).alias("s_weight"), F.lit(tot["s_late"]).alias("s_late"),
        (F.lit(tot["s_weight"]) - F.col("q_n")).alias("s_warned"),
        (F.lit(tot["s_late"]) - F.col("u_all")).alias("s_late0"), (F.col("u_all") - F.col("q_late")).alias("s_late50"))
    d = scenario_columns(sums, scenarios, ratios)
    return d.groupBy("scenario", "ratio").agg(
        F.min_by(F.struct("t0", "t50", "cost"), F.struct(F.round("cost", 12), "t0", "t50")).alias("b")
    ).select("scenario", "ratio", "b.*")
