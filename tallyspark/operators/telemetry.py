"""Telemetry of runs: peaks of resource samples, and statistics of steps' metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def peaks(samples: DataFrame, *keys: str, devices: int) -> DataFrame:
    """Of samples (keys, host_rss_bytes, gpu_used_bytes: one for each device): their number, the peak of the host and of each device.

    A sample with another number of devices fails the job. Devices are few: each is a column of one aggregation."""
    wrong = F.raise_error(F.format_string(f"a sample has %d gpu entries but {devices} devices are configured", F.size("gpu_used_bytes")))
    used = F.when(F.size("gpu_used_bytes") == devices, F.col("gpu_used_bytes")).otherwise(wrong)
    each = [F.coalesce(F.max(F.get(used, F.lit(k))), F.lit(0)) for k in range(devices)]
    return samples.groupBy(*keys).agg(F.count("*").alias("sample_count"), F.coalesce(F.max("host_rss_bytes"), F.lit(0)).alias("peak_host_rss_bytes"), F.array(*each).alias("peak_gpu_used_bytes"))


def finite(value: Column) -> Column:
    """value, null if it is no finite number."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def step_statistics(rows: DataFrame, *keys: str, metrics: list[str], flags: list[str]) -> DataFrame:
    """Of rows (keys, metrics: map of numbers, flags: map of booleans): count, means and population deviations of each
    metric over its finite values, and the share of rows with each flag."""
    value = lambda m: finite(F.try_element_at("metrics", F.lit(m)))
    of_metric = [f(value(m)).alias(f"{m}_{name}") for m in metrics for name, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    of_flag = [F.avg(F.when(F.try_element_at("flags", F.lit(f)), 1.0).otherwise(0.0)).alias(f"{f}_rate") for f in flags]
    return rows.groupBy(*keys).agg(F.count("*").alias("count"), *of_metric, *of_flag)


def injected(rows: DataFrame, *keys: str) -> DataFrame:
    """Whether any row of a key (fault_type, fault_strength) had a fault put in: a type, and a strength that isn't 0."""
    hit = (F.coalesce("fault_type", F.lit("")) != "") & (F.coalesce("fault_strength", F.lit(0.0)) != 0)
    return rows.groupBy(*keys).agg(F.bool_or(hit).alias("injected"))


def without(rows: DataFrame, *empty: str) -> DataFrame:
    """rows whose arrays all have elements, as sums over sequences skip the empty ones."""
    return rows.where(reduce(Column.__and__, [F.size(c) > 0 for c in empty]))
