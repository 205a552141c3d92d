"""Outcome records derived from the events table (the test mapping): one attempt for each event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import outcome as O


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, *, healthy: bool = False) -> DataFrame:
    """healthy: without the planted change of the failure rate."""
    k, user = F.get_json_object("props", "$.k").cast("int"), F.col("user_id")
    limit = F.lit(8) if healthy else F.when(F.col("ts") >= F.lit("2024-01-16").cast("timestamp"), 60).otherwise(8)
    kind = F.when(F.col("event_type") == "error", F.when(k < limit, "sandbox").when(k < 70, "agent_exception").when(k < 80, "missing_reward").when(k < 90, "wall_clock"))
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    base = read_table(spark, sf_dir, "events").select(
        F.lit("run-1").alias("run_id"),
        F.concat(F.lit("u-"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("unit_id"),
        F.lit(1).alias("attempt"),
        F.lit("trajectory").alias("kind"),
        F.when(user % 10 != 9, F.concat(F.lit("s"), (user % 3).cast("string"))).alias("source"),
        start.alias("started_at_ms"),
        (start + k).alias("ended_at_ms"),
        F.expr("event_id div 50").alias("step"),
        F.concat(F.lit("g"), (user % 4).cast("string")).alias("grp"),
        kind.alias("failure_kind"),
        k.alias("k"),
        "value",
        F.when(F.col("ts") >= F.lit("2024-01-21").cast("timestamp"), 5).otherwise(35).alias("bar"),
        user.alias("tokens_out"),
    )
    kind = F.col("failure_kind")
    action = F.when(kind.isNull(), "score").when((kind == "sandbox") & (F.col("k") % 7 == 0), "zero").when(kind.isin("sandbox", "missing_reward"), "mask").otherwise("zero")
    return base.withColumn("action", action).withColumn("reward", O.reward_for(F.col("action"), F.when(F.col("value") < F.col("bar"), 1.0).otherwise(0.0))).withColumn("failure_class", O.failure_class(kind)).drop("bar")


#: The same rows in SQL; {limit} is the sandbox limit.
RECORDS_SQL = """
base as (
  select *, cast(json_extract_string(props, '$.k') as integer) k from events
), kinds as (
  select *, case when event_type = 'error' then case when k < {limit} then 'sandbox' when k < 70 then 'agent_exception' when k < 80 then 'missing_reward' when k < 90 then 'wall_clock' end end failure_kind from base
), actions as (
  select *, case when failure_kind is null then 'score' when failure_kind = 'sandbox' and k % 7 = 0 then 'zero' when failure_kind in ('sandbox', 'missing_reward') then 'mask' else 'zero' end act from kinds
), records as (
  select 'run-1' run_id, 'u-' || lpad(event_id::varchar, 8, '0') unit_id, 1 attempt, 'trajectory' kind,
    case when user_id % 10 <> 9 then 's' || (user_id % 3) end source, epoch_us(ts) // 1000 started_at_ms, epoch_us(ts) // 1000 + k ended_at_ms, event_id // 50 step, 'g' || (user_id % 4) grp,
    failure_kind, act as action, case act when 'score' then case when value < (case when ts >= '2024-01-21' then 5 else 35 end) then 1.0::double else 0.0::double end when 'zero' then 0.0::double end reward,
    case when failure_kind in ('agent_exception') then 'agent' when failure_kind = 'missing_reward' then 'grader' when failure_kind = 'sandbox' then 'infra' when failure_kind = 'wall_clock' then 'timeout' end failure_class,
    k, value, user_id tokens_out from actions
)"""
CHANGED = RECORDS_SQL.format(limit="(case when ts >= '2024-01-16' then 60 else 8 end)")
HEALTHY = RECORDS_SQL.format(limit="8")
