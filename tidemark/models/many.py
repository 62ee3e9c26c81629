"""Many logistic regressions over one table in one job.

Folds, repeats, feature sets and held-out groups differ only in the rows and columns of a fit. So a row carries the list of
fits that it trains (``train_in``) and of those that score it (``score_in``), and the fits advance together: a pass over
the table gives gradient and Hessian of every fit (numpy in the tasks, sums by Spark), and the driver solves one small
system per fit. Some ten passes fit them all, whatever their number, where one model after the other would read the
table for each of their steps.

The model is that of ``learners``: medians of the training rows for missing values, columns standardised by the training
rows, an indicator per group with all zeros for an unseen one, class weights n / (2 * class size), and a squared penalty of
1 / 2 on all but the intercept.

What comes to the driver is fits x columns squared. A group column with very many values makes many columns; use the
single learner there. A fit whose training rows hold one class scores every row with that class; one without training
rows scores null.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import hash_number
from tidemark.models.learners import Learner
from tidemark.operators.ordered import numbered
from tidemark.operators.ranking import exact_quantiles, youden_threshold
from tidemark.session import materialize, ship

STEPS = 30
DONE = 1e-11  # Newton decrement per training row at which a fit rests


@dataclass
class State:
    """What all fits need in a pass: rows of every array belong to fits, columns to features, then groups."""

    ids: list[int]
    uses: np.ndarray  # fits x columns: whether the fit has the column
    fill: np.ndarray
    mean: np.ndarray
    scale: np.ndarray  # 0 for a constant or absent column
    weight: np.ndarray  # fits x 2: of label 0 and 1
    beta: np.ndarray  # fits x (1 + columns)


def _design(x: np.ndarray, g: np.ndarray, groups: int, s: State, k: int) -> np.ndarray:
    """Standardised columns of fit k with the intercept first."""
    d = x.shape[1]
    out = np.empty((len(x), 1 + d + groups))
    out[:, 0] = 1.0
    out[:, 1:1 + d] = (np.where(np.isnan(x), s.fill[k], x) - s.mean[k]) * s.scale[k]
    if groups:
        out[:, 1 + d:] = g[:, None] == np.arange(groups)[None, :]
        out[:, 1 + d:] *= s.uses[k, d:]
    return out


def _batches(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple]:
    """(x, y, g, rows and fits of the pairs) of each batch."""
    for b in batches:
        x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
        lists = b.column("train_in")
        n = np.diff(lists.offsets.to_numpy())
        yield x, b.column("y").to_numpy(), b.column("g").to_numpy(), np.repeat(np.arange(b.num_rows), n), lists.flatten().to_numpy()


def _sums(table: DataFrame, d: int, per_fit, width: int, fits: int) -> np.ndarray:
    """fits x width: sums over all training pairs of what ``per_fit(x, y, g, k)`` gives for the rows of fit k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((fits, width))
        seen = np.zeros(fits, bool)
        for x, y, g, row, fit in _batches(batches, d):
            order = np.argsort(fit, kind="stable")
            row, fit = row[order], fit[order]
            cut = np.flatnonzero(np.diff(fit, prepend=-1))
            for lo, hi in zip(cut, [*cut[1:], len(fit)]):
                k, own = int(fit[lo]), row[lo:hi]
                total[k] += per_fit(x[own], y[own], g[own], k)
                seen[k] = True
        k = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"f": np.repeat(k, width).astype(np.int64), "c": np.tile(np.arange(width), len(k)).astype(np.int64), "v": total[k].ravel()})

    out = np.zeros((fits, width))
    for r in table.mapInArrow(run, "f long, c long, v double").groupBy("f", "c").agg(F.sum("v").alias("v")).collect():
        out[r.f, r.c] = r.v
    return out


def _medians(df: DataFrame, features: Sequence[str], fits: int) -> np.ndarray:
    """fits x features: exact medians of the training values, where a column misses any; 0 where it misses all."""
    out = np.zeros((fits, len(features)))
    holes = df.agg(*[F.count_if(F.col(c).isNull()).alias(str(k)) for k, c in enumerate(features)]).first()
    gaps = [k for k in range(len(features)) if holes[k]]
    if gaps:
        cells = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col(features[k]).alias("v")) for k in gaps]))
        long = df.select(F.explode("train_in").alias("f"), cells.alias("x")).select("f", "x.*").where(F.col("v").isNotNull())
        for r in exact_quantiles(long, ["f", "c"], "v", [0.5]).collect():
            out[r.f, r.c] = r.value
    return out


class ManyLogistic:
    """Fitted models by number."""

    def __init__(self, features: Sequence[str], groups: Sequence[str], group: str | None, state: State, one_class: dict[int, float], empty: set[int], passes: int):
        self.features, self.groups, self.group = list(features), list(groups), group
        self.state, self.one_class, self.empty, self.passes = state, one_class, empty, passes

    def coefficients(self, fit: int) -> tuple[float, dict[str, float]]:
        """(intercept, coefficient by standardised column) of one fit."""
        names = [*self.features, *self.groups]
        b = self.state.beta[fit]
        return float(b[0]), {c: float(v) for c, v, u in zip(names, b[1:], self.state.uses[fit]) if u}

    def table(self, spark: SparkSession) -> DataFrame:
        """A row per fit: what scoring needs, on the columns as they are."""
        s, d, rows = self.state, len(self.features), []
        for k in s.ids:
            slope = s.beta[k, 1:1 + d] * s.scale[k]
            start = float(s.beta[k, 0] - (slope * s.mean[k]).sum())
            rows.append((k, start, slope.tolist(), s.fill[k].tolist(), s.beta[k, 1 + d:].tolist(), None if k in self.empty else self.one_class.get(k, -1.0)))
        return spark.createDataFrame(rows, "fit int, start_ double, slope_ array<double>, fill_ array<double>, groups_ array<double>, always_ double")

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """A row per row and fit in ``score_in``, with ``fit`` and the probability of label 1; ``train_in`` is left out."""
        d = df.drop("train_in").withColumn("fit", F.explode("score_in")).drop("score_in")
        # A row per fit: bounded by the number of fits times columns.
        d = d.join(F.broadcast(self.table(df.sparkSession)), "fit")
        x = F.array(*[known(c) for c in self.features]) if self.features else F.array().cast("array<double>")
        terms = F.zip_with(F.zip_with(x, F.col("fill_"), lambda a, b: F.coalesce(a, b)), F.col("slope_"), lambda a, b: a * b)
        z = F.col("start_") + F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
        if self.groups:
            z = z + F.coalesce(F.get("groups_", _place(self.group, self.groups)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        return d.withColumn(name, F.when(F.col("always_") >= 0, F.col("always_")).when(F.col("always_").isNotNull(), p)).drop("start_", "slope_", "fill_", "groups_", "always_")


def known(c: str) -> Column:
    """A number, NaN as null."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def _place(group: str, groups: Sequence[str]) -> Column:
    return (F.array_position(F.array(*[F.lit(g) for g in groups]), F.col(group)) - 1).cast("int")


def fit_many(df: DataFrame, sets: Sequence[Sequence[str]], label: str, group: str | None = None, with_group: Sequence[bool] | None = None, steps: int = STEPS) -> ManyLogistic:
    """Fit all models; fit k uses the columns ``sets[k]`` and, if ``with_group[k]``, the indicators of ``group``.

    ``df`` carries ``train_in``, an array of the fits that a row trains; rows with a null label train none.
    """
    ship(df.sparkSession)
    fits = len(sets)
    features = list(dict.fromkeys(c for s in sets for c in s))
    with_group = [bool(group)] * fits if with_group is None else [bool(w and group) for w in with_group]
    used = df.where((F.size("train_in") > 0) & F.col(label).isNotNull())
    groups = sorted(r[0] for r in used.select(group).distinct().collect() if r[0] is not None) if any(with_group) else []
    d = len(features)
    place = F.coalesce(_place(group, groups), F.lit(-1)) if groups else F.lit(-1)
    cols = [known(c).alias(f"x{k}") for k, c in enumerate(features)]
    table = materialize(used.select(F.col(label).cast("double").alias("y"), place.alias("g"), F.col("train_in").cast("array<int>").alias("train_in"), *cols))
    names = [f"x{k}" for k in range(d)]
    fill = _medians(table, names, fits)
    nan = F.lit(float("nan"))
    packed = table.select("y", "g", "train_in", F.array(*[F.coalesce(F.col(c), nan) for c in names]).alias("x") if d else F.array().cast("array<double>").alias("x"))
    uses = np.zeros((fits, d + len(groups)), bool)
    for k, s in enumerate(sets):
        uses[k, [features.index(c) for c in s]] = True
        uses[k, d:] = with_group[k]
    state = State(list(range(fits)), uses, fill, np.zeros((fits, d)), np.ones((fits, d)), np.ones((fits, 2)), np.zeros((fits, 1 + d + len(groups))))

    filled = lambda x, k: np.where(np.isnan(x), state.fill[k], x)
    first = _sums(packed, d, lambda x, y, g, k: np.concatenate([[len(y), y.sum()], filled(x, k).sum(0)]), 2 + d, fits)
    n, pos = first[:, 0], first[:, 1]
    state.mean = first[:, 2:] / np.maximum(n, 1)[:, None]
    spread = _sums(packed, d, lambda x, y, g, k: ((filled(x, k) - state.mean[k]) ** 2).sum(0), d, fits) if d else np.zeros((fits, 0))
    sd = np.sqrt(spread / np.maximum(n - 1, 1)[:, None])
    state.scale = np.where((sd > 0) & uses[:, :d], 1 / np.where(sd > 0, sd, 1), 0.0)
    empty = {k for k in range(fits) if n[k] == 0}
    one_class = {k: float(pos[k] > 0) for k in range(fits) if n[k] and pos[k] in (0, n[k])}
    state.weight = np.stack([n / (2 * np.maximum(n - pos, 1)), n / (2 * np.maximum(pos, 1))], 1)
    state.beta[:, 0] = 0.0

    size = 1 + d + len(groups)
    upper = np.triu_indices(size)
    many = len(groups)
    going = np.array([k not in empty and k not in one_class for k in range(fits)])
    step = np.zeros_like(state.beta)
    before = np.full(fits, np.inf)
    passes = 2
    for _ in range(steps):
        if not going.any():
            break
        active = going.copy()

        def newton(x, y, g, k):
            if not active[k]:
                return np.zeros(1 + size + len(upper[0]))
            z = _design(x, g, many, state, k)
            eta = z @ state.beta[k]
            w = state.weight[k][y.astype(int)]
            p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
            loss = (w * (np.logaddexp(0, eta) - y * eta)).sum()
            hess = (z * (w * p * (1 - p))[:, None]).T @ z
            return np.concatenate([[loss], z.T @ (w * (p - y)), hess[upper]])

        got = _sums(packed, d, newton, 1 + size + len(upper[0]), fits)
        passes += 1
        for k in np.flatnonzero(going):
            b = state.beta[k]
            loss = got[k, 0] + 0.5 * (b[1:] ** 2).sum()
            if loss > before[k] + 1e-9 * (1 + abs(before[k])):  # too far: half the step
                step[k] /= 2
                state.beta[k] = b - step[k]
                continue
            before[k] = loss
            grad = got[k, 1:1 + size].copy()
            grad[1:] += b[1:]
            hess = np.zeros((size, size))
            hess[upper] = got[k, 1 + size:]
            hess = hess + np.triu(hess, 1).T + np.diag([1e-12, *[1.0] * (size - 1)])
            step[k] = -np.linalg.solve(hess, grad)
            going[k] = -grad @ step[k] > DONE * n[k]
            state.beta[k] = b + step[k]
    return ManyLogistic(features, groups, group, state, one_class, empty, passes)


def score_splits(long: DataFrame, learners: Mapping[str, Learner], label: str, splits: int = 1, k: int = 5, key: str = "sprint_id", slices=None) -> DataFrame:
    """Logistic learners on several splits at once: training rows scored out of fold, test rows by the whole training side.

    ``long`` has a row per split (``split``, from 0) and row, with ``side``; ``seed`` (a column, if there) adds to the seed of
    the folds. Returns those rows per learner with ``model``, ``fold`` (null on the test side) and ``score``.
    """
    names, first = list(learners), next(iter(learners.values()))
    each = len(names) * (k + 1)
    order = [hash_number(F.col("seed_"), F.col(key).cast("string")), F.col(key)]
    seed = (F.col("seed") if "seed" in long.columns else F.lit(0)) + F.lit(first.seed)
    train = long.where((F.col("side") == "train") & F.col(label).isNotNull()).withColumn("seed_", seed.cast("string"))
    folds = numbered(train, ["split", label], order, "rn_", None, slices).withColumn("fold", ((F.col("rn_") - 1) % k).cast("int")).drop("rn_", "seed_")
    rows = materialize(folds.unionByName(long.where(F.col("side") == "test").withColumn("fold", F.lit(None).cast("int"))))
    base = (F.col("split") * each).cast("int")
    fits = F.array(*[F.lit(i) for i in range(each)])
    mine = F.filter(fits, lambda i: F.pmod(i, F.lit(k + 1)) != F.coalesce(F.col("fold"), F.lit(-1)))
    train_in = F.when(F.col("fold").isNotNull(), F.transform(mine, lambda i: i + base)).otherwise(F.array().cast("array<int>"))
    score_in = F.array(*[base + i * (k + 1) + F.coalesce(F.col("fold"), F.lit(k)) for i in range(len(names))])
    rows = rows.withColumns({"train_in": train_in, "score_in": score_in})
    per = [learners[n] for n in names for _ in range(k + 1)] * splits
    group = next((l.group for l in learners.values() if l.group), None)
    models = fit_many(rows, [l.numeric for l in per], label, group, [l.group is not None for l in per])
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(F.floor(F.col("fit") / (k + 1)), F.lit(len(names))) + 1).cast("int"))
    return models.score(rows).withColumn("model", name).drop("fit")


def calls_of_splits(long: DataFrame, learner: Learner, label: str, splits: int, k: int = 5, key: str = "sprint_id") -> DataFrame:
    """Test rows of every split with score, threshold (of the out-of-fold training scores of the split) and call."""
    scored = materialize(score_splits(long, {"": learner}, label, splits, k, key).drop("model"))
    t = youden_threshold(scored.where(F.col("fold").isNotNull()), ["split"], "score", label).select("split", "threshold")
    out = scored.where(F.col("fold").isNull()).drop("fold").join(F.broadcast(t), "split")  # a row per split
    return out.withColumn("pred", (F.col("score") >= F.col("threshold")).cast("int"))


def group_out_many(sets: Mapping[str, Sequence[str]], df: DataFrame, label: str, groups: Sequence[str], group: str = "project") -> DataFrame:
    """Each group scored by fits on the other groups, one per feature set (``model``); all fits in one job."""
    names, n = list(sets), len(groups)
    fits = F.array(*[F.lit(i) for i in range(n * len(names))])
    out_of = _place(group, groups)
    every = F.filter(fits, lambda i: F.pmod(i, F.lit(n)) != F.coalesce(out_of, F.lit(-1)))
    mine = F.when(out_of.isNotNull() & (out_of >= 0), F.transform(F.array(*[F.lit(k * n) for k in range(len(names))]), lambda b: b + out_of)).otherwise(F.array().cast("array<int>"))
    rows = df.withColumns({"train_in": every, "score_in": mine})
    models = fit_many(rows, [sets[s] for s in names for _ in range(n)], label)
    name = F.element_at(F.array(*[F.lit(s) for s in names]), (F.floor(F.col("fit") / n) + 1).cast("int"))
    return models.score(rows).withColumn("model", name).drop("fit")


def split_scores(sets: Mapping[str, Sequence[str]], train: DataFrame, test: DataFrame, label: str, group: str | None = None) -> DataFrame:
    """Test rows scored by one fit per feature set (``model``), all in one job."""
    names = list(sets)
    every, none = F.array(*[F.lit(i) for i in range(len(names))]), F.array().cast("array<int>")
    rows = train.withColumns({"train_in": every, "score_in": none}).unionByName(test.withColumns({"train_in": none, "score_in": every}), allowMissingColumns=True)
    models = fit_many(rows, [sets[s] for s in names], label, group)
    return models.score(rows).withColumn("model", F.element_at(F.array(*[F.lit(s) for s in names]), F.col("fit") + 1)).drop("fit")
