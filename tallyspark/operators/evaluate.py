"""Evaluation of detectors: confusion counts, delays, counts by vocabulary, group fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion(runs: DataFrame, *keys: str, groups: list[tuple[str, str]] | None = None) -> DataFrame:
    """Of runs (keys, family, setting, faulty, flagged): precision, recall and F1 of each (family, setting) of a key.

    Rows without a family are normals and count in every group: they're added up once, then meet the groups' few rows.
    groups: the vocabulary, so that groups without a row of their own are there too; else those that occur."""
    counts = runs.groupBy(*keys, "family", F.when(F.col("family").isNotNull(), F.col("setting")).alias("setting")).agg(
        F.count_if(F.col("flagged") & F.col("faulty")).alias("tp"), F.count_if(F.col("flagged") & ~F.col("faulty")).alias("fp"), F.count_if(~F.col("flagged") & F.col("faulty")).alias("fn")
    )
    if groups is not None:
        zero = counts.select(*keys).distinct() if keys else counts.limit(1).select()
        named = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(s).alias("setting")) for f, s in groups]))
        zero = zero.withColumn("_g", named).select(*keys, "_g.family", "_g.setting", *[F.lit(0).cast("long").alias(c) for c in ("tp", "fp", "fn")])
        counts = counts.unionByName(zero).groupBy(*keys, "family", "setting").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    all_groups, shared = W.partitionBy(*(keys or [F.lit(0)])), {}
    for c in ("tp", "fp", "fn"):
        shared[c] = F.col(c) + F.coalesce(F.max(F.when(F.col("family").isNull(), F.col(c))).over(all_groups), F.lit(0))
    t = counts.select(*keys, "family", "setting", *[v.alias(c) for c, v in shared.items()]).where("family is not null")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    t = t.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return t.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def delay_summary(delays: DataFrame, *keys: str) -> DataFrame:
    """Of rows (keys, delay; null: missed): median, 90th percentile by nearest rank, and misses.

    Delays are counted by value first, so a key's rows never meet in one task."""
    counts = delays.groupBy(*keys, "delay").agg(F.count("*").alias("c"))
    w = W.partitionBy(*keys).orderBy("delay")
    found = counts.where("delay is not null").withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(W.partitionBy(*keys)))
    n = F.col("n")

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("delay")))

    low, high = F.floor((n - 1) / 2), F.floor(n / 2)
    ranks = found.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias("median"), at(F.least(n - 1, F.floor(0.9 * n))).alias("p90"))
    totals = counts.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("delay").isNull(), F.col("c"))), F.lit(0)).alias("missed"), F.sum("c").alias("total"))
    return totals.join(ranks, [*keys], "left")


def counts_by(rows: DataFrame, key: str, column: str, vocabulary: list[str]) -> DataFrame:
    """Rows of each key with each value of a closed vocabulary, zero where there are none."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(column) == v).alias(v) for v in vocabulary])


def group_fill(value: Column, *group: str) -> Column:
    """value, else its group's mean, else 0.0."""
    return F.coalesce(value, F.avg(value).over(W.partitionBy(*group)), F.lit(0.0))


def verdict_counts(attributions: DataFrame, *keys: str) -> DataFrame:
    """Attributed alarms of each key by verdict."""
    return attributions.groupBy(*keys, "verdict").agg(F.count("*").alias("n"))
