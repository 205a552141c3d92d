"""Count windows of a source's units, and the show summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import outcome as O

#: Start order of units.
START = ("started_at_ms", "unit_id", "attempt")


#: Records are numbered within this span of time, and spans are added up before.
NUMBER_BUCKET_MS = 3_600_000


def numbered(records: DataFrame, *, bucket: int = NUMBER_BUCKET_MS, name: str = "number") -> DataFrame:
    """records with their number, from 0, within run and source in start order.

    A source's rows are numbered in windows of one span of time, so a large source is split over many tasks; the rows
    before a span come from counts, one for each source and span."""
    span = {"_run": F.col("run_id"), "_source": F.coalesce("source", F.lit("")), "_none": F.col("source").isNull(), "_span": F.floor(F.col("started_at_ms") / bucket)}
    key = list(span)
    rows = records.withColumns(span)
    counts = records.select(*[c.alias(k) for k, c in span.items()]).groupBy(*key).agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*key[:3]).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(*key, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_row", F.row_number().over(W.partitionBy(*key).orderBy(*START)))
    return rows.join(before, key).withColumn(name, (F.col("_before") + F.col("_row") - 1).cast("long")).drop(*key, "_row", "_before")


def counted_steps(records: DataFrame, units: int = 32) -> DataFrame:
    """The rewarded units with step replaced by the start of their window of so many units: for runs without steps."""
    rows = numbered(records.where(F.col("kind").isin(*O.REWARDED)))
    return rows.withColumn("step", F.expr(f"number div {units} * {units}")).drop("number")


def source_windows(records: DataFrame, *, window_units: int = 50) -> DataFrame:
    """Metrics of each window of rewarded units. Error rates are over all units, the zero rate over rewarded ones."""
    if window_units < 1:
        raise ValueError("window_units must be at least 1")
    kind, reward, cls = F.col("failure_kind"), F.col("reward"), F.col("failure_class")
    units = F.count("*")
    return (
        numbered(records.where(F.col("kind").isin(*O.REWARDED)))
        .withColumn("index", F.expr(f"number div {window_units}"))
        .groupBy("run_id", "source", "index")
        .agg(
            units.alias("units"),
            F.min_by("unit_id", F.struct(*START)).alias("first_unit_id"),
            F.avg(reward).alias("avg_reward"),
            F.avg(F.when(~O.non_agent(kind), reward)).alias("avg_reward_no_infra"),
            (F.count_if(reward == 0) / F.nullif(F.count(reward), F.lit(0))).alias("zero_reward_rate"),
            (F.count_if(cls == "infra") / units).alias("infra_error_rate"),
            (F.count_if(cls == "grader") / units).alias("grader_error_rate"),
            F.count_if(O.poisoned(kind, reward)).alias("poisoned_units"),
        )
    )


def summary(records: DataFrame) -> DataFrame:
    """One row: failures of all units, by class, and the GPU hours that failures cost."""
    cls = F.col("failure_class")
    return records.agg(F.count(cls).alias("failures"), F.count("*").alias("units"), *[F.count_if(cls == c).alias(c) for c in ("infra", "agent", "grader", "timeout")], (F.coalesce(F.sum(F.when(cls.isNotNull(), F.col("value"))), F.lit(0.0)) / 3600).alias("gpu_hours_lost"))


def without_record(markers: DataFrame, records: DataFrame) -> DataFrame:
    """Start markers of attempts that left no record."""
    return markers.join(records, ["unit_id", "attempt"], "left_anti")


def distinct_steps(records: DataFrame, *keys: str) -> DataFrame:
    """Steps and prompt groups of each key, exactly counted."""
    return records.groupBy(*keys).agg(F.countDistinct("step").alias("steps"), F.countDistinct("grp").alias("clusters"))
