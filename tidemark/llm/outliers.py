"""Quality rules: robust multivariate outliers by the minimum covariance determinant.

Each document becomes a vector of transformed statistics (word length, symbols, capitals, repeated lines, repeated
words; shares are drawn towards zero in short texts). Per language and source, location and scatter are those of the
half (``HALF``) of the rows with the smallest covariance determinant, found by concentration steps from a median and
quartile start until the subset is stable. A group may thus be junk by nearly half before its junk shapes the scatter. A
document is rejected where its squared Mahalanobis distance passes ``CUTOFF``.

All steps are aggregates with map-side combining over a narrow table of statistics: quantiles come from counts per
fixed-width bin, moments from sums of integers (statistics are multiples of 1/SCALE), so that results do not depend on
the order of rows, and no task receives a whole group. Per group only a few hundred numbers exist.

Groups of fewer than ``LEAST`` rows that pass the base rules are pooled by language, and those pools, if still small, into one. If that is small
too, nothing is rejected by distance. Each scatter has a floor on its diagonal (``FLOOR``), since clean
documents often share one value (no symbols at all) and any other would be infinitely far.

Defined cases: a null or empty text has no words and so fails the base rules. Null languages and sources are groups of
their own. Each row is judged on its own, so repeated rows and ids are fine. An empty table gives no rows. Other columns
play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fixed, ship
from tidemark.llm.stats import COUNTS, text_counts

DIMS = 5
SCALE = 256
HALF = 0.5  # share of the rows that the scatter covers
LEAST = 50
CUTOFF = 60.0
FLOOR = [0.06, 0.10, 0.10, 0.10, 0.12]  # standard deviations at least
MIN_WORDS = 10
MAX_REPEATED = 20  # percent of the words
_BIN = 16  # bins per doubling of a squared distance


def vector() -> list[Column]:
    """Transformed statistics as multiples of 1/SCALE."""
    n = F.col("n_words").cast("double")
    raw = [
        F.log((F.col("word_chars") + 250) / (n + 50)) * 2,
        F.log1p(20 * F.col("n_symbols") / (n + 20)),
        F.log1p(20 * F.col("n_upper") / (F.col("n_chars") + 100)) ,
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 10.0)),
        F.sqrt(F.col("n_repeat_words") / (n + 20)),
    ]
    return [F.round(x * SCALE).cast("long") for x in raw]


def _quantiles(counts: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """Smallest values whose running count reaches each share of the group's; ``counts`` has a row per key and value."""
    by = Window.partitionBy(*keys)
    run = F.sum("n").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(by)
    rows = counts.withColumn("__run", run)
    return rows.groupBy(*keys).agg(*[F.min(F.when(F.col("__run") >= s, F.col(value))).alias(f"q{k}") for k, s in enumerate(shares)])


def _inverse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From (g, n, sums, products, h) of a group to its location and inverse scatter; h, a hash of the rest, passes."""
    i, j = np.triu_indices(DIMS)
    for b in batches:
        if not len(b):
            continue
        n = b["n"].to_numpy(float)
        mean = np.array(b["sums"].tolist(), float).reshape(-1, DIMS) / SCALE / n[:, None]
        prod = np.array(b["prods"].tolist(), float).reshape(-1, len(i)) / SCALE ** 2 / n[:, None]
        cov = np.zeros((len(b), DIMS, DIMS))
        cov[:, i, j] = cov[:, j, i] = prod - mean[:, i] * mean[:, j]
        cov += np.diag(np.square(FLOOR))
        yield pd.DataFrame({"g": b["g"], "mean": list(mean), "inv": list(np.linalg.inv(cov).reshape(len(b), -1)), "h": b["h"]})


def _distance(mean: str = "mean", inv: str = "inv") -> Column:
    x = [F.col(f"x{k}") / SCALE - F.col(mean)[k] for k in range(DIMS)]
    total = F.lit(0.0)
    for a in range(DIMS):
        for b in range(a, DIMS):
            total = total + x[a] * x[b] * F.col(inv)[a * DIMS + b] * (1 if a == b else 2)
    return F.greatest(total, F.lit(1e-9))


def grouped(stats: DataFrame, lang: str = "lang", source: str = "source", least: int = LEAST) -> DataFrame:
    """Adds ``g``: language and source, or the pool that small groups fall into; only rows that pass the base rules count."""
    own = F.to_json(F.struct(F.lit(1).alias("level"), F.col(lang).alias("lang"), F.col(source).alias("source")))
    pool = F.to_json(F.struct(F.lit(2).alias("level"), F.col(lang).alias("lang")))
    sizes = stats.groupBy(own.alias("__own"), pool.alias("__pool")).agg(F.count_if(~F.col("base_failed")).alias("__n"))
    small = F.sum(F.when(F.col("__n") < least, F.col("__n")).otherwise(0)).over(Window.partitionBy("__pool"))
    g = F.when(F.col("__n") >= least, F.col("__own")).when(small >= least, F.col("__pool")).otherwise("rest")
    names = sizes.select("__own", g.alias("g"))
    return stats.withColumn("__own", own).join(names, "__own").drop("__own")


def scatter(rows: DataFrame, covered: float = HALF) -> DataFrame:
    """Per group ``g``: ``mean``, ``inv`` (inverse scatter, row by row) and ``unit``, which scales distances so that their median is that of a normal sample.

    A group takes steps until its subset's moments are some that it had before; later steps leave it out.
    """
    xs = [f"x{k}" for k in range(DIMS)]
    each = rows.select("g", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(x).alias("v")) for k, x in enumerate(xs)])).alias("e"))
    counts = each.groupBy("g", "e.k", "e.v").agg(F.count(F.lit(1)).alias("n"))
    q = _quantiles(counts, ["g", "k"], "v", [0.25, 0.5, 0.75])
    floor = F.array(*[F.lit(x) for x in FLOOR])
    sd = F.sqrt(F.pow((F.col("q2") - F.col("q0")) / SCALE / 1.349, 2) + F.pow(floor[F.col("k")], 2))
    start = q.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("k", (F.col("q1") / SCALE).alias("m"), (1 / (sd * sd)).alias("w")))).alias("a"))
    spots = F.array(*[F.when(F.lit(a == b), F.col("a")[a]["w"]).otherwise(0.0) for a in range(DIMS) for b in range(DIMS)])
    moving = fixed(start.select("g", F.transform("a", lambda x: x["m"]).alias("mean"), spots.alias("inv"), F.array().cast("array<long>").alias("seen")))
    i, j = np.triu_indices(DIMS)
    share = F.floor(F.log2("d2") * _BIN).cast("int")

    def measured(params: DataFrame, quantile: float) -> tuple[DataFrame, DataFrame]:
        far = rows.join(params, "g").withColumn("d2", _distance()).withColumn("b", share)
        return far, _quantiles(far.groupBy("g", "b").agg(F.count(F.lit(1)).alias("n")), ["g"], "b", [quantile])

    done = []
    while True:
        far, cut = measured(moving, covered)
        core = far.join(cut, "g").where(F.col("b") <= F.col("q0"))
        sums = core.groupBy("g").agg(
            F.count(F.lit(1)).alias("n"), F.array(*[F.sum(x) for x in xs]).alias("sums"),
            F.array(*[F.sum(F.col(xs[a]) * F.col(xs[b])) for a, b in zip(i, j)]).alias("prods")).withColumn("h", F.xxhash64("n", "sums", "prods"))
        new = sums.mapInPandas(_inverse, "g string, mean array<double>, inv array<double>, h long").join(moving.select("g", "seen"), "g")
        moving = fixed(new.select("g", "mean", "inv", F.array_append("seen", F.col("h")).alias("seen"), F.array_contains("seen", F.col("h")).alias("met")))
        done.append(moving.where("met"))
        moving = moving.where("not met")
        if moving.isEmpty():
            break
    params = fixed(reduce(DataFrame.unionAll, [x.select("g", "mean", "inv") for x in done]))
    _, mid = measured(params, 0.5)
    normal = DIMS * (1 - 2 / (9 * DIMS)) ** 3  # median of chi-square
    unit = F.least(F.lit(1.0), normal / F.pow(F.lit(2.0), (F.col("q0") + 1) / _BIN))
    return fixed(params.join(mid.select("g", unit.alias("unit")), "g"))


def outlier_report(docs: DataFrame, cutoff: float = CUTOFF, least: int = LEAST) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, and the squared distance (null where it was not judged)."""
    ship(docs.sparkSession)
    counts = F.pandas_udf(text_counts, ", ".join(f"{n} long" for n in COUNTS))
    own = docs.select("doc_id", "lang", "source", counts(F.col("text")).alias("s")).select("doc_id", "lang", "source", "s.*")
    n, rep = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * rep > MAX_REPEATED * n)
    own = own.withColumns({"base_failed": failed, **{f"x{k}": x for k, x in enumerate(vector())}})
    rows = fixed(grouped(fixed(own), least=least))
    fit = scatter(rows.where(~F.col("base_failed")).select("g", *[f"x{k}" for k in range(DIMS)]))
    enough = rows.groupBy("g").agg((F.count_if(~F.col("base_failed")) >= least).alias("judged"))
    out = rows.join(fit, "g", "left").join(enough, "g")
    d2 = F.when(F.col("judged"), _distance() * F.col("unit"))
    out = out.withColumn("distance", d2).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 4).alias("distance"))
