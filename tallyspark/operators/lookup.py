"""Lookups by key: refusals, last rows, defaults, registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ATTEMPT = ["unit_id", "attempt"]


def refused_starts(starts: DataFrame, records: DataFrame) -> DataFrame:
    """The starts of attempts that have a record already."""
    return starts.join(records.select(*ATTEMPT), ATTEMPT, "left_semi")


def last_by(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key, the last by order; an aggregation with map-side combine, no sort of a key's rows."""
    kept = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("_last"))
    return last.select(*keys, *[F.col("_last")[c].alias(c) for c in kept])


def alarm_steps(alarms: DataFrame, records: DataFrame) -> DataFrame:
    """Alarms with the step of the last record of their unit."""
    last = last_by(records.select("unit_id", "attempt", "step"), ["unit_id"], "attempt").select("unit_id", "step")
    return alarms.join(last, "unit_id")


def with_default(rows: DataFrame, registry: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """rows with the registry's columns; defaults where the key isn't registered or the value is null."""
    joined = rows.join(registry.select(key, *defaults), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def read_registry(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """A CSV file with a header; of rows with the same key the last one in the file wins.

    Rows are numbered in file order: the file is read as one partition, as a registry is small."""
    rows = spark.read.csv(path, header=True, schema=schema).coalesce(1).withColumn("_row", F.monotonically_increasing_id())
    return last_by(rows, [key], "_row").drop("_row")


def forked(parent: DataFrame, branch: DataFrame, fork_step: int) -> DataFrame:
    """The rows of a run that was forked after fork_step: the parent's up to that step, and all of the branch's."""
    return parent.where(F.col("step") <= fork_step).unionByName(branch)
