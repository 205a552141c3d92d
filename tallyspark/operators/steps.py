"""Per-step observations with cluster-robust variances: two aggregations, one exchange each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import outcome as O


def step_observations(records: DataFrame) -> DataFrame:
    """One row for each (run, source, step) of rewarded attempts.

    First per group (prompt), then per step; what the variance of a mean needs (sums over groups of n^2, n r and r^2)
    is additive, so groups meet only as sums: sum (r - m n)^2 = sum r^2 - 2 m sum n r + m^2 sum n^2."""
    clean = O.clean_reward(F.col("failure_kind"), F.col("action"), F.col("reward"))
    units = records.where(F.col("kind").isin(*O.REWARDED)).withColumn("clean", clean).withColumn("failed", O.non_agent(F.col("failure_kind")).cast("double"))
    key = ["run_id", "source", "step"]
    groups = units.groupBy(*key, F.coalesce("grp", F.concat(F.lit("unit:"), F.col("unit_id"))).alias("grp")).agg(
        F.count("*").cast("double").alias("n"),
        F.sum("failed").alias("f"),
        F.count("clean").cast("double").alias("cn"),
        F.coalesce(F.sum("clean"), F.lit(0.0)).alias("cs"),
        F.coalesce(F.sum(F.col("clean") * F.col("clean")), F.lit(0.0)).alias("cq"),
        F.max(F.struct("started_at_ms", "unit_id")).alias("last"),
    )
    pairs = {"nn": ("n", "n"), "nf": ("n", "f"), "ff": ("f", "f"), "cc": ("cn", "cn"), "cr": ("cn", "cs"), "rr": ("cs", "cs")}
    steps = groups.groupBy(*key).agg(
        *[F.sum(c).alias(c) for c in ("n", "f", "cn", "cs", "cq")],
        *[F.sum(F.col(a) * F.col(b)).alias(p) for p, (a, b) in pairs.items()],
        F.count("*").alias("clusters"),
        F.count_if(F.col("cn") > 0).alias("clean_clusters"),
        F.max("last").alias("last"),
    )

    def variance(g: Column, n: Column, total: Column, nn: Column, nr: Column, rr: Column) -> Column:
        m = total / n
        return F.when(g > 1, g / (g - 1) * F.greatest(F.lit(0.0), rr - 2 * m * nr + m * m * nn) / (n * n))

    c = {x: F.col(x) for x in steps.columns}
    sd = F.when(c["cn"] > 1, F.sqrt(F.greatest(F.lit(0.0), (c["cq"] - c["cs"] * c["cs"] / c["cn"]) / (c["cn"] - 1))))
    return steps.select(
        *key,
        c["n"].cast("long").alias("units"),
        c["f"].cast("long").alias("failures"),
        "clusters",
        variance(c["clusters"], c["n"], c["f"], c["nn"], c["nf"], c["ff"]).alias("failure_variance"),
        c["cn"].cast("long").alias("clean_count"),
        F.when(c["cn"] > 0, c["cs"] / c["cn"]).alias("clean_mean"),
        F.when(c["cn"] > 0, variance(c["clean_clusters"], c["cn"], c["cs"], c["cc"], c["cr"], c["rr"])).alias("clean_variance"),
        sd.alias("clean_sd"),
        c["last"]["unit_id"].alias("unit_id"),
        c["last"]["started_at_ms"].alias("at_ms"),
    )


def design_effect() -> Column:
    """Cluster variance over binomial variance, within [1, units / clusters]."""
    k, n = F.col("failures"), F.col("units")
    p = k / n
    return F.when((k == 0) | (k == n) | F.col("failure_variance").isNull(), 1.0).otherwise(F.least(F.greatest(F.col("failure_variance") / (p * (1 - p) / n), F.lit(1.0)), n / F.col("clusters")))
