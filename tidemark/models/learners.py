"""Learners on pyspark.ml with the preprocessing they share, scores, thresholds and out-of-fold scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import ceil

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import exact_quantiles, youden_threshold
from tidemark.operators.splits import split_kfold

# The settings of the compared learners.
FOREST = {"numTrees": 300, "maxDepth": 5, "minInstancesPerNode": 3}
BOOSTED = {"maxIter": 200, "maxDepth": 3, "stepSize": 0.05}
BOOSTED_DEEP = {"maxIter": 300, "maxDepth": 4, "stepSize": 0.05}
SEED = 42
# Sizes of what a forest keeps: of a row beside its counts, and of a partition.
ROW_BYTES = 300
BAG_BYTES = 256 << 20


@dataclass(frozen=True)
class Learner:
    """A learner kind, its feature columns and overrides of its settings."""

    kind: str
    numeric: Sequence[str]
    group: str | None = "project"
    seed: int = SEED
    settings: dict = field(default_factory=dict)


def as_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def exact_medians(df: DataFrame, numeric: Sequence[str]) -> dict[str, float]:
    """Median of every column over its known values, 0 where there are none; a row per column comes to the driver."""
    known = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), known(c).alias("value")) for c in numeric]))
    long = df.select(cells.alias("x")).select("x.*").where(F.col("value").isNotNull())
    found = {r["feature"]: r["value"] for r in exact_quantiles(long, ["feature"], "value", [0.5]).collect()}
    return {c: found.get(c, 0.0) for c in numeric}


def preprocessor(numeric: Sequence[str], group: str | None, medians: dict[str, float]) -> list:
    """Median impute, standardise, one-hot the group with a slot for unseen values."""
    filled = [f"{c}__filled" for c in numeric]
    fill = ", ".join(f"coalesce(nanvl(`{c}`, cast(null as double)), cast('{medians[c]!r}' as double)) AS `{c}__filled`" for c in numeric)
    stages = [
        SQLTransformer(statement=f"SELECT *, {fill} FROM __THIS__"),
        VectorAssembler(inputCols=filled, outputCol="numeric_vec"),
        StandardScaler(inputCol="numeric_vec", outputCol="scaled_vec", withMean=True, withStd=True),
    ]
    inputs = ["scaled_vec"]
    if group:
        stages += [
            StringIndexer(inputCol=group, outputCol="group_idx", handleInvalid="keep"),
            OneHotEncoder(inputCols=["group_idx"], outputCols=["group_vec"]),
        ]
        inputs.append("group_vec")
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]


def balanced(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """Class weights n / (2 * class size), and n."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # two rows
    n = sum(counts.values())
    w = F.lit(None).cast("double")
    for value, c in counts.items():
        w = F.when(F.col(label) == value, n / (2.0 * c)).otherwise(w)
    return df.withColumn("class_weight", w), n


def prepare(learner: Learner, train: DataFrame) -> PipelineModel:
    """The fitted preprocessing: the same for every kind, seed and label over the same rows and columns."""
    d = as_double(train, learner.numeric)
    return Pipeline(stages=preprocessor(learner.numeric, learner.group, exact_medians(d, learner.numeric))).fit(d)


def _fitted(learner: Learner, d: DataFrame, est, pre: PipelineModel | None = None) -> PipelineModel:
    """Preprocessing (or ``pre``, fitted before) and model fitted on d.

    A forest keeps a count per tree with every training row, and a task reads the rows of a partition as a whole. So the rows
    are dealt out to as many partitions as hold ``BAG_BYTES`` each, if they do not lie in as many already.
    """
    pre = pre or prepare(learner, d)
    ready = pre.transform(d)
    if learner.kind == "forest":
        parts = ceil(d.count() * (ROW_BYTES + 4 * est.getNumTrees()) / BAG_BYTES)
        if parts > ready.rdd.getNumPartitions():
            kept = [c for c in ("features", "label_", "class_weight") if c in ready.columns]
            ready = ready.select(*kept).repartition(parts)
    return PipelineModel([*pre.stages, est.fit(ready)])


def fit_classifier(learner: Learner, train: DataFrame, label: str, pre: PipelineModel | None = None) -> PipelineModel:
    d = as_double(train, learner.numeric).withColumn("label_", F.col(label).cast("double"))
    common = {"featuresCol": "features", "labelCol": "label_"}
    if learner.kind == "boosted":
        est = GBTClassifier(**common, seed=learner.seed, **{**BOOSTED, **learner.settings})
    else:
        d, n = balanced(d, label)
        if learner.kind == "logistic":
            est = LogisticRegression(**common, weightCol="class_weight", maxIter=1000, regParam=1.0 / n, standardization=False, **learner.settings)
        elif learner.kind == "forest":
            est = RandomForestClassifier(**common, weightCol="class_weight", seed=learner.seed, **{**FOREST, **learner.settings})
        else:
            raise ValueError(learner.kind)
    return _fitted(learner, d, est, pre)


def fit_regressor(learner: Learner, train: DataFrame, target: str, leaf_col: str | None = None, pre: PipelineModel | None = None) -> PipelineModel:
    d = as_double(train, learner.numeric).withColumn("label_", F.col(target).cast("double"))
    common = {"featuresCol": "features", "labelCol": "label_"}
    if learner.kind == "ridge":
        # Spark divides the penalty by the deviation of the label; times it, the penalty on the sum of squares is 1.
        size = d.agg(F.count("label_").alias("n"), F.stddev_samp("label_").alias("sd")).first()
        est = LinearRegression(**common, regParam=(size["sd"] or 1.0) / max(size["n"], 1), elasticNetParam=0.0, standardization=False, **learner.settings)
    elif learner.kind == "forest":
        est = RandomForestRegressor(**common, seed=learner.seed, featureSubsetStrategy="all", **{**FOREST, **learner.settings})
        if leaf_col:
            est = est.setLeafCol(leaf_col)
    elif learner.kind == "boosted":
        est = GBTRegressor(**common, seed=learner.seed, **{**BOOSTED, **learner.settings})
    elif learner.kind == "boosted_median":
        est = GBTRegressor(**common, seed=learner.seed, lossType="absolute", **{**BOOSTED, **learner.settings})
    else:
        raise ValueError(learner.kind)
    return _fitted(learner, d, est, pre)


_ML_COLUMNS = ["numeric_vec", "scaled_vec", "group_idx", "group_vec", "features", "rawPrediction", "probability", "prediction"]


def score(model: PipelineModel, df: DataFrame, numeric: Sequence[str], name: str = "score", is_probability: bool = True) -> DataFrame:
    """Add the positive-class probability (or the forecast) and drop the working columns."""
    out = model.transform(as_double(df, numeric))
    value = vector_to_array(F.col("probability"))[1] if is_probability else F.col("prediction")
    out = out.withColumn(name, value)
    return out.drop(*_ML_COLUMNS, *[f"{c}__filled" for c in numeric])


def fit_and_score(learner: Learner, train: DataFrame, test: DataFrame, label: str, name: str = "score", pre: PipelineModel | None = None) -> DataFrame:
    return score(fit_classifier(learner, train, label, pre), test, learner.numeric, name)


def together(*learners: Learner) -> bool:
    """Whether these learners can be fitted in one job (``many``)."""
    return all(x.kind == "logistic" and not x.settings for x in learners) and len({(x.group, x.seed) for x in learners if x.group}) <= 1


def out_of_fold(learner: Learner, train: DataFrame, label: str, k: int = 5, key: str = "sprint_id") -> DataFrame:
    """Each row scored by the model that did not see its fold."""
    if together(learner):
        from tidemark.models.many import score_splits

        long = train.withColumns({"split": F.lit(0), "side": F.lit("train")})
        return score_splits(long, {"": learner}, label, 1, k, key).drop("split", "model", *([] if "side" in train.columns else ["side"]))
    folds = split_kfold(train, label, k, learner.seed, key)
    parts = []
    for i in range(k):
        part = fit_and_score(learner, folds.where(F.col("fold") != i), folds.where(F.col("fold") == i), label)
        parts.append(part)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fit_with_threshold(learner: Learner, train: DataFrame, test: DataFrame, label: str, k: int = 5, key: str = "sprint_id") -> DataFrame:
    """Test rows with score, threshold and call; the threshold comes from out-of-fold training scores."""
    if together(learner):
        from tidemark.models.many import calls_of_splits

        sides = [x.withColumns({"split": F.lit(0), "side": F.lit(s)}) for x, s in ((train, "train"), (test, "test"))]
        out = calls_of_splits(sides[0].unionByName(sides[1]), learner, label, 1, k, key)
        return out.drop("split", *([] if "side" in test.columns else ["side"]))
    oof = out_of_fold(learner, train, label, k, key)
    t = youden_threshold(oof, [], "score", label).first()["threshold"]
    scored = fit_and_score(learner, train, test, label)
    return scored.withColumns({"threshold": F.lit(t), "pred": (F.col("score") >= F.lit(t)).cast("int")})


def cross_validated_calls(learner: Learner, df: DataFrame, label: str, k: int = 5, key: str = "sprint_id") -> DataFrame:
    """Pooled 0/1 calls of a k-fold run, each fold with its own training-side threshold."""
    folds = split_kfold(df, label, k, learner.seed, key)
    if together(learner):
        from tidemark.models.many import calls_of_splits

        side = F.when(F.col("fold") == F.col("split"), "test").otherwise("train")
        long = folds.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("side", side).drop("fold")
        return calls_of_splits(long, learner, label, k, k, key).drop("split", *([] if "side" in df.columns else ["side"]))
    out = None
    for i in range(k):
        tr = folds.where(F.col("fold") != i).drop("fold")
        te = folds.where(F.col("fold") == i)
        part = fit_with_threshold(learner, tr, te, label, k, key)
        out = part if out is None else out.unionByName(part)
    return out


def group_out_scores(learner: Learner, df: DataFrame, label: str, groups: Sequence[str], group: str = "project") -> DataFrame:
    """Each group scored by a model fitted on the others; the group itself is not a feature."""
    plain = Learner(learner.kind, learner.numeric, None, learner.seed, learner.settings)
    if together(plain):
        from tidemark.models.many import group_out_many

        return group_out_many({"": plain.numeric}, df, label, groups, group).drop("model")
    out = None
    for g in groups:
        part = fit_and_score(plain, df.where(F.col(group) != g), df.where(F.col(group) == g), label)
        out = part if out is None else out.unionByName(part)
    return out


def bounded_share(train: DataFrame, test: DataFrame, numeric: Sequence[str], target: str = "carry_ratio", settings: dict | None = None, broken: Sequence[str] = ()) -> DataFrame:
    """Forecast of a share, fitted without broken sources and clipped to [0, 1]."""
    tr = train.where(F.col(target).isNotNull())
    if broken:
        tr = tr.where(~F.col("project").isin(list(broken)))
    learner = Learner("boosted", numeric, settings=settings or {})
    out = score(fit_regressor(learner, tr, target), test, numeric, "share", is_probability=False)
    return out.withColumn("share", F.greatest(F.least(F.col("share"), F.lit(1.0)), F.lit(0.0)))
