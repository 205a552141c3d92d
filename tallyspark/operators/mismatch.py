"""Train-inference mismatch: sums of each sequence, then ratio estimates with standard errors of each batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLAMP = 20.0


def sequence_sums(train: Column, rollout: Column) -> Column:
    """struct(tokens, k3, ratio) of two arrays of log probabilities of one length; arrays that are empty, of two lengths
    or hold a number that is no finite log probability fail the job."""
    good = lambda a: ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (x > 0) | (x == float("-inf")))
    checked = (F.size(train) > 0) & (F.size(train) == F.size(rollout)) & good(train) & good(rollout)
    train = F.when(checked, train).otherwise(F.raise_error(F.lit("log probabilities must be finite, at most 0, and as many of both kinds, at least one")))
    delta = F.zip_with(train, rollout, lambda a, b: F.least(F.greatest(a - b, F.lit(-CLAMP)), F.lit(CLAMP)))
    add = lambda f: F.aggregate(delta, F.lit(0.0), lambda s, d: s + f(d))
    return F.struct(F.size(train).cast("long").alias("tokens"), add(lambda d: F.greatest(F.lit(0.0), F.expm1(d) - d)).alias("k3"), add(F.exp).alias("ratio"))


def batch_summaries(sequences: DataFrame, *keys: str) -> DataFrame:
    """Of rows (keys, tokens, k3, ratio): means per token and the standard errors of their ratio estimates.

    One aggregation: the residual sums follow from additive moments."""
    n, t = F.col("sequences"), F.col("tokens")
    moments = [F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"{a}_{b}") for a, b in (("tokens", "tokens"), ("k3", "k3"), ("k3", "tokens"), ("ratio", "ratio"), ("ratio", "tokens"))]
    sums = sequences.groupBy(*keys).agg(F.count("*").alias("sequences"), F.sum("tokens").alias("t"), F.sum("k3").alias("k"), F.sum("ratio").alias("r"), *moments).withColumnRenamed("t", "tokens").where("sequences > 1")

    def error(y: str, total: str) -> Column:
        m = F.col(total) / t
        return F.sqrt(n / (n - 1) * F.greatest(F.lit(0.0), F.col(f"{y}_{y}") - 2 * m * F.col(f"{y}_tokens") + m * m * F.col("tokens_tokens"))) / t

    return sums.select(*keys, "sequences", "tokens", (F.col("k") / t).alias("kl"), error("k3", "k").alias("kl_se"), (F.col("r") / t).alias("ratio_mean"), error("ratio", "r").alias("ratio_se"))
