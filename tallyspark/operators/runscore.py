"""Whole runs against the profile of normal runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIOR_SCALE = 0.3


def profile(normals: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """(means per feature and step, spread per feature) of normal runs' values, each within the columns `by`."""
    means = normals.groupBy(*by, "feature", "step").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    return means.drop("var"), means.groupBy(*by, "feature").agg(level().alias("spread"))


def level() -> Column:
    """The spread of a feature, over its steps' (mean, var)."""
    return F.greatest(F.coalesce(F.sqrt(F.avg("var")), F.lit(0.0)), 0.01 * F.avg(F.abs("mean")), F.lit(1e-9))


def factor(n: Column, s: Column, prior_scale: float = PRIOR_SCALE) -> Column:
    """Log Bayes factor of a shift, of n deviations in units of the spread with the sum s."""
    t2 = prior_scale**2
    return -0.5 * F.log1p(n * t2) + s * s * t2 / (2 * (1 + n * t2))


def shift_factors(values: DataFrame, means: DataFrame, spreads: DataFrame, *by: str, prior_scale: float = PRIOR_SCALE) -> DataFrame:
    """Log Bayes factor of a shift of each (run, feature)."""
    z = (F.col("value") - F.col("mean")) / F.col("spread")
    cells = values.join(means, [*by, "feature", "step"]).join(spreads, [*by, "feature"]).withColumn("z", z)
    return cells.groupBy(*by, "run", "feature").agg(F.count("*").alias("n"), F.sum("z").alias("s")).select(*by, "run", "feature", factor(F.col("n"), F.col("s"), prior_scale).alias("factor"))


def scores(factors: DataFrame, *by: str) -> DataFrame:
    """The log mean exp of a run's factors, shifted by the largest."""
    top = factors.groupBy(*by, "run").agg(F.max("factor").alias("top"))
    return factors.join(top, [*by, "run"]).groupBy(*by, "run").agg((F.max("top") + F.ln(F.avg(F.exp(F.col("factor") - F.col("top"))))).alias("score"))


def threshold(normal_scores: DataFrame, multiplier: float) -> DataFrame:
    return normal_scores.agg((F.avg("score") + multiplier * F.stddev_samp("score")).alias("threshold"))


def out_of_sample_scores(normals: DataFrame, folds: int = 5, *, prior_scale: float = PRIOR_SCALE) -> DataFrame:
    """The score of each run of normals (run, fold, feature, step, value) by the profile of the other folds."""
    if folds < 2:
        raise ValueError("folds must be at least 2")
    others = F.explode(F.filter(F.array(*[F.lit(k) for k in range(folds)]), lambda k: k != F.col("fold")))
    means, spreads = profile(normals.withColumn("_other", others).drop("fold").withColumnRenamed("_other", "fold"), "fold")
    return scores(shift_factors(normals, means, spreads, "fold", prior_scale=prior_scale), "fold")


GRAIN = ("depth", "task", "batch")


def _grains(df: DataFrame) -> DataFrame:
    """Each row at the grains (task, batch), (task) and all; absent levels are ''."""
    level = lambda depth, task, batch: F.struct(F.lit(depth).alias("depth"), task.alias("task"), batch.alias("batch"))
    task, batch, none = F.col("task"), F.col("batch"), F.lit("")
    return df.withColumn("_grain", F.explode(F.array(level(2, task, batch), level(1, task, none), level(0, none, none)))).drop("task", "batch").select("*", "_grain.*").drop("_grain")


def grain_profiles(normals: DataFrame, *keys: str, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Profiles of normals (keys, run, task, batch, feature, step, value) at each grain of a key that has so many runs."""
    rows, by = _grains(normals), [*keys, *GRAIN]
    enough = rows.groupBy(*by).agg(F.countDistinct("run").alias("runs")).where(F.col("runs") >= least).drop("runs")
    return profile(rows.join(enough, by, "left_semi"), *by)


def chosen_grain(runs: DataFrame, normals: DataFrame, *keys: str, batch_least: int = 5, task_least: int = 2) -> DataFrame:
    """runs (keys, run, task, batch) with the grain of their profile: the finest one with enough normal runs of the key."""
    n = normals.select(*keys, "run", "task", "batch").distinct()
    fine, coarse = n.groupBy(*keys, "task", "batch").agg(F.count("*").alias("_fine")), n.groupBy(*keys, "task").agg(F.count("*").alias("_coarse"))
    depth = F.when(F.col("_fine") >= batch_least, 2).when(F.col("_coarse") >= task_least, 1).otherwise(0)
    chosen = runs.join(fine, [*keys, "task", "batch"], "left").join(coarse, [*keys, "task"], "left").withColumn("depth", depth)
    return chosen.select(*keys, "run", "depth", F.when(F.col("depth") > 0, F.col("task")).otherwise("").alias("task"), F.when(F.col("depth") > 1, F.col("batch")).otherwise("").alias("batch"))
