"""Statistics on grouped rows: standardised regression, bootstrap intervals and weighted clusters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPLICATES = 200
#: Poisson(1) weights above this have a chance under 1e-8.
MOST_DRAWN = 10


def standardised_ols(rows: DataFrame, keys: list[str], y: str, x1: str, x2: str) -> DataFrame:
    """Coefficients of z-scored predictors and R squared, by the normal equations of two predictors."""
    r = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(y, x1).alias("r1"), F.corr(y, x2).alias("r2"), F.corr(x1, x2).alias("r12"))
    free = F.nullif(1 - F.col("r12") * F.col("r12"), F.lit(0.0))
    fit = r.withColumn("beta1", (F.col("r1") - F.col("r2") * F.col("r12")) / free).withColumn("beta2", (F.col("r2") - F.col("r1") * F.col("r12")) / free)
    return fit.select(*keys, "n", "beta1", "beta2", (F.col("beta1") * F.col("r1") + F.col("beta2") * F.col("r2")).alias("r_squared"))


def standardised_ols_of(rows: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """Rows (keys, n, beta_1 ..., r_squared, adjusted) of a regression on any number of z-scored predictors.

    One pass sums the correlations of each group; their normal equations, one small matrix a group, are solved in
    Arrow batches. Betas are null where the predictors depend on each other or the group is constant.
    """
    k = len(xs)
    pairs = [(i, j) for i in range(k) for j in range(i)]
    sums = rows.dropna(subset=[y, *xs]).groupBy(*keys).agg(F.count("*").alias("n"), F.array(*(F.corr(x, y) for x in xs)).alias("r"), F.array(*(F.corr(xs[i], xs[j]) for i, j in pairs)).cast("array<double>").alias("c"))

    @F.pandas_udf("array<double>")
    def solved(r: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for right, below in zip(r, c):
            m = np.eye(k)
            for (i, j), v in zip(pairs, below):
                m[i, j] = m[j, i] = np.nan if v is None else v
            right = np.array([np.nan if v is None else v for v in right], float)
            clear = np.isfinite(m).all() and np.isfinite(right).all() and np.linalg.matrix_rank(m) == k
            out.append(np.linalg.solve(m, right).tolist() if clear else [None] * k)
        return pd.Series(out)

    fit = sums.withColumn("b", solved("r", "c"))
    fit = fit.withColumn("r_squared", sum((F.col("b")[i] * F.col("r")[i] for i in range(k)), F.lit(0.0)))
    adjusted = 1 - (1 - F.col("r_squared")) * (F.col("n") - 1) / F.nullif(F.col("n") - k - 1, F.lit(0))
    return fit.select(*keys, "n", *(F.col("b")[i].alias(f"beta_{i + 1}") for i in range(k)), "r_squared", adjusted.alias("adjusted"))


def residuals(rows: DataFrame, keys: list[str], y: str, x1: str, x2: str) -> DataFrame:
    """``rows`` with ``residual``: the z-score of ``y`` less what its group's regression foretells."""
    score = lambda c: (F.col(c) - F.avg(c).over(Window.partitionBy(*keys))) / F.nullif(F.stddev_pop(c).over(Window.partitionBy(*keys)), F.lit(0.0))
    fit = standardised_ols(rows, keys, y, x1, x2).select(*keys, "beta1", "beta2")
    scored = rows.select("*", score(y).alias("__y"), score(x1).alias("__1"), score(x2).alias("__2"))
    return scored.join(fit, keys).withColumn("residual", F.col("__y") - F.col("beta1") * F.col("__1") - F.col("beta2") * F.col("__2")).drop("__y", "__1", "__2", "beta1", "beta2")


def _drawn(seed: Column) -> Column:
    """A Poisson(1) weight for a hash."""
    u = F.pmod(seed, F.lit(1 << 40)) / float(1 << 40)
    below, out = 0.0, F.lit(0)
    for k in range(MOST_DRAWN):
        below += math.exp(-1) / math.factorial(k)
        out = out + F.when(u >= below, 1).otherwise(0)
    return out


def bootstrap_correlation(rows: DataFrame, keys: list[str], row_id: str, x: str, y: str, replicates: int = REPLICATES) -> DataFrame:
    """Correlation with its 2.5 and 97.5 percentiles over Poisson bootstrap replicates.

    Weights come from a hash of the row and the replicate, so reruns agree; only six sums for each group and
    replicate are shuffled.
    """
    fanned = rows.select(*keys, F.col(row_id).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    w = fanned.withColumn("w", _drawn(F.xxhash64("id", "rep"))).where("w > 0")
    s = lambda c: F.sum(F.col("w") * c)
    X, Y = F.col("x"), F.col("y")
    sums = w.groupBy(*keys, "rep").agg(F.sum("w").alias("n"), s(X).alias("sx"), s(Y).alias("sy"), s(X * X).alias("sxx"), s(Y * Y).alias("syy"), s(X * Y).alias("sxy"))
    spread = F.sqrt((F.col("n") * F.col("sxx") - F.col("sx") ** 2) * (F.col("n") * F.col("syy") - F.col("sy") ** 2))
    reps = sums.withColumn("r", (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(spread, F.lit(0.0)))
    bounds = reps.groupBy(*keys).agg(F.percentile("r", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    point = rows.groupBy(*keys).agg(F.corr(x, y).alias("rho"))
    low, high = F.col("q")[0], F.col("q")[1]
    return point.join(bounds, keys).select(*keys, "rho", low.alias("low"), high.alias("high"), ((low > 0) | (high < 0)).alias("supported"))


def bootstrap_coefficients(rows: DataFrame, keys: list[str], row_id: str, y: str, x1: str, x2: str, replicates: int = REPLICATES) -> DataFrame:
    """Standardised coefficients of two predictors with their 2.5 and 97.5 percentiles and the share of replicates
    that agree with their sign; replicates are drawn as for ``bootstrap_correlation``."""
    used = rows.dropna(subset=[y, x1, x2])
    fanned = used.select(*keys, F.col(row_id).alias("id"), F.col(y).alias("y"), F.col(x1).alias("p"), F.col(x2).alias("q"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    w = fanned.withColumn("w", _drawn(F.xxhash64("id", "rep"))).where("w > 0")
    names = ("y", "p", "q")
    products = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = w.groupBy(*keys, "rep").agg(F.sum("w").alias("n"), *(F.sum(F.col("w") * F.col(c)).alias(f"s_{c}") for c in names), *(F.sum(F.col("w") * F.col(a) * F.col(b)).alias(f"s_{a}{b}") for a, b in products))
    cov = lambda a, b: F.col("n") * F.col(f"s_{a}{b}") - F.col(f"s_{a}") * F.col(f"s_{b}")
    corr = lambda a, b: cov(a, b) / F.nullif(F.sqrt(F.greatest(cov(a, a) * cov(b, b), F.lit(0.0))), F.lit(0.0))
    r = sums.select(*keys, corr("y", "p").alias("r1"), corr("y", "q").alias("r2"), corr("p", "q").alias("r12"))
    free = F.nullif(1 - F.col("r12") * F.col("r12"), F.lit(0.0))
    reps = r.select(*keys, ((F.col("r1") - F.col("r2") * F.col("r12")) / free).alias("b1"), ((F.col("r2") - F.col("r1") * F.col("r12")) / free).alias("b2"))
    point = standardised_ols(used, keys, y, x1, x2).select(*keys, "beta1", "beta2")
    both = reps.join(point, keys).groupBy(*keys).agg(
        F.first("beta1").alias("beta1"), F.first("beta2").alias("beta2"),
        *(F.percentile(f"b{i}", F.array(F.lit(0.025), F.lit(0.975))).alias(f"q{i}") for i in (1, 2)),
        *(F.avg((F.signum(f"b{i}") == F.signum(f"beta{i}")).cast("double")).alias(f"sign{i}") for i in (1, 2)))
    return both.select(*keys, *(c for i in (1, 2) for c in (f"beta{i}", F.col(f"q{i}")[0].alias(f"low{i}"), F.col(f"q{i}")[1].alias(f"high{i}"), f"sign{i}")))


def weighted_clusters(points: DataFrame, row_id: str, x: str, y: str, weight: str, k: int = 20, seed: int = 0) -> DataFrame:
    """Rows (cluster_rank, rows, weight, representative, distance): weighted k-means of points.

    Clusters rank by falling weight; the representative is the row nearest the centroid, ties to the smaller id.
    Only the ``k`` centroids reach the driver.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    used = points.select(F.col(row_id).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(weight).cast("double").alias("w")).where("x is not null and y is not null and w > 0")
    distinct = used.select("x", "y").distinct().limit(k).count()
    if not distinct:
        return points.sparkSession.createDataFrame([], "cluster_rank long, rows long, weight double, representative long, distance double")
    vectors = VectorAssembler(inputCols=["x", "y"], outputCol="at").transform(used)
    if distinct == 1:
        placed = used.withColumn("cluster", F.lit(0)).withColumn("distance", F.lit(0.0))
    else:
        model = KMeans(k=distinct, seed=seed, featuresCol="at", predictionCol="cluster", weightCol="w").fit(vectors)
        centres = points.sparkSession.createDataFrame([(i, float(c[0]), float(c[1])) for i, c in enumerate(model.clusterCenters())], "cluster int, cx double, cy double")
        placed = model.transform(vectors).join(F.broadcast(centres), "cluster").withColumn("distance", F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")))
    best = placed.groupBy("cluster").agg(F.count("*").alias("rows"), F.sum("w").alias("weight"), F.min(F.struct("distance", "id")).alias("m"))
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("weight"), "m.distance", "m.id")).cast("long")  # k rows
    return best.select(rank.alias("cluster_rank"), "rows", "weight", F.col("m.id").alias("representative"), F.col("m.distance").alias("distance"))
